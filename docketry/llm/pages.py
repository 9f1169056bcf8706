"""One pass over the stored releases that several operators share.

``read_pages`` applies the residue model (problem 7) and the page reader
(problem 2) to every record in Arrow batches.  It is a narrow transformation:
no shuffle, one Python pass, memory bounded by an Arrow batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.llm import residue
from docketry.llm.site import site_lines

#: Columns of read_pages that a caller may ask for.
FIELDS = {
    "is_case": ("boolean", pa.bool_()),
    "site": ("array<int>", pa.list_(pa.int32())),
    "body": ("string", pa.string()),
}


def model_of(actions: DataFrame) -> residue.Model:
    """Fit on the bounded sample; an empty table gives a model that finds nothing."""
    rows = residue.sample(actions)
    return residue.fit(rows) if rows else residue.Model({}, (residue.NEVER,) * 3)


def read_pages(actions: DataFrame, want: tuple[str, ...], keep: tuple[str, ...] = ("id",), cases: bool | None = None, model=None, post=None) -> DataFrame:
    """Rows of ``actions`` with the columns ``keep`` and those of ``want``.

    post: (names, DDL types, function); the function makes those columns, as
    Arrow arrays, of the batch's bodies in the same Python pass.
    cases: True keeps only problem 7's cases, False only the others, None all.
    Null and empty texts have no site lines, an empty body and are no case
    (unless the headline is).
    """
    spark = actions.sparkSession
    shared = spark.sparkContext.broadcast(model or model_of(actions))
    names = [*keep, *want]
    types = dict(actions.dtypes)
    schema = ", ".join(f"`{c}` {types[c] if c in keep else FIELDS[c][0]}" for c in names)
    if post:
        names += post[0]
        schema += "".join(f", {n} {t}" for n, t in zip(post[0], post[1]))
    need_body = bool(post) or "body" in want
    need_site = need_body or "site" in want

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = residue.Reader(shared.value)
        for b in batches:
            heads, texts = b.column("headline").to_pylist(), b.column("raw_text").to_pylist()
            rows, bodies, out = [], [], {c: [] for c in want}
            for i, (h, t) in enumerate(zip(heads, texts)):
                lines = reader.lines(t)
                case = reader.is_case(h, t, lines)
                if cases is not None and case != cases:
                    continue
                rows.append(i)
                site = site_lines(*lines) if t and need_site and not case else []
                if "is_case" in out:
                    out["is_case"].append(case)
                if "site" in out:
                    out["site"].append(site)
                if need_body:
                    drop = set(site)
                    body = "\n".join(x for n, x in enumerate(lines[0], 1) if n not in drop).rstrip() if t else ""
                    bodies.append(body)
                    if "body" in out:
                        out["body"].append(body)
            kept = b.select(list(keep)).take(pa.array(rows, pa.int64())) if len(rows) < b.num_rows else b.select(list(keep))
            cols = [*kept.columns, *(pa.array(out[c], FIELDS[c][1]) for c in want)]
            if post:
                cols += post[2](bodies)
            yield pa.RecordBatch.from_arrays(cols, names=names)

    src = actions.select(*[F.col(c) for c in dict.fromkeys([*keep, "headline", "raw_text"])])
    return src.mapInArrow(run, schema)
