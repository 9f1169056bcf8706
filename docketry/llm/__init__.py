"""Training-data operators (problems 1-10 of TESTDATA.md).

Nothing outside this subpackage imports it; ``__spark_entry__`` adds
``queries.QUERIES`` and ``queries.ORACLES`` only when it can be imported.
"""
