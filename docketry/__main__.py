"""python -m docketry list | run NAME DIR [--csv PATH | --json PATH] | actions DIR [filters] | action DIR ID | process DIR OUT | report DIR"""

from __future__ import annotations

import argparse

FILTERS = ("state", "category", "action_type", "defendant", "since", "until", "min_amount", "q")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="docketry", description=__doc__)
    sub = p.add_subparsers(dest="what", required=True)
    sub.add_parser("list", help="names of the queries")
    r = sub.add_parser("run", help="one query, shown or exported whole")
    r.add_argument("name")
    r.add_argument("dir")
    r.add_argument("--csv")
    r.add_argument("--json", help="a document with the count and all rows")
    a = sub.add_parser("actions", help="a page of actions as JSON lines")
    a.add_argument("dir")
    for f in FILTERS:
        a.add_argument("--" + f.replace("_", "-"), type=float if f == "min_amount" else str)
    a.add_argument("--limit", type=int, default=50)
    a.add_argument("--offset", type=int, default=0)
    one = sub.add_parser("action", help="one action with its body as JSON")
    one.add_argument("dir")
    one.add_argument("id")
    x = sub.add_parser("process", help="extract what waits; writes actions and child tables")
    x.add_argument("dir")
    x.add_argument("out")
    sub.add_parser("report", help="the report in markdown").add_argument("dir")
    return p


def main() -> None:
    a = parser().parse_args()

    from docketry.plans import api, catalog, derived

    queries = catalog.QUERIES | derived.QUERIES
    if a.what == "list":
        print(*sorted(queries), sep="\n")
        return
    from pyspark.sql import SparkSession

    from docketry.operators import extract
    from docketry.plans.report import report
    from docketry.sources.sinks import write_csv, write_document
    from docketry.tables import load

    spark = SparkSession.builder.appName("docketry").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if a.what == "report":
        print(report(spark, a.dir))
    elif a.what == "actions":
        page = api.list_actions(spark, a.dir, a.limit, a.offset, **{f: getattr(a, f) for f in FILTERS})
        print(*page.toJSON().collect(), sep="\n")  # a page: 500 rows at most
    elif a.what == "action":
        print(*api.get_action(spark, a.dir, a.id).toJSON().collect(), sep="\n")
    elif a.what == "process":
        actions, nested = extract.processed(load(spark, a.dir, "enforcement_actions"))
        for name, t in {"enforcement_actions": actions, **extract.star(nested)}.items():
            t.write.mode("overwrite").parquet(f"{a.out}/{name}.parquet")
    elif a.csv:
        write_csv(queries[a.name](spark, a.dir), a.csv)
    elif a.json:
        write_document(queries[a.name](spark, a.dir), a.json, a.name)
    else:
        queries[a.name](spark, a.dir).show(50, truncate=False)


if __name__ == "__main__":
    main()
