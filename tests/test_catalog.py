"""The relational catalogue against DuckDB over the smallest tables, and on empty ones."""

import math
import os

import duckdb
import pytest

from docketry.plans import api, catalog, derived, report
from docketry.tables import DDL, load, schema, schema_diff, violations

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
NAMES = sorted(catalog.SQL) + sorted(derived.ORACLES)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for f in os.listdir(DATA):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{DATA}/{f}')")
    return c


def norm(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, float):
        return round(v, 6)
    return v.isoformat()[:19] if hasattr(v, "isoformat") else v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(str(tuple(norm(r[i]) for i in order)) for r in data)


@pytest.mark.parametrize("name", NAMES)
def test_matches_duckdb(spark, con, name):
    query = (catalog.QUERIES | derived.QUERIES)[name](spark, DATA)
    cur = con.execute((catalog.ORACLES | derived.ORACLES)[name])
    columns = [x[0] for x in cur.description]
    assert sorted(query.columns) == sorted(columns)
    assert rows(query.columns, query.collect()) == rows(columns, cur.fetchall())


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("empty")
    for name in os.listdir(DATA):
        spark.read.parquet(f"{DATA}/{name}").limit(0).write.parquet(f"{root}/{name}")
    return str(root)


@pytest.mark.parametrize("name", ["o03_db_stats", "o06_get_action", "o11_top_defendants", "o15_list_states", "o25_report_types", "o29_year_over_year", "o43_category_trend", "j11_extract", "k04_resolve", "l04_duplicate_pairs", "l05_clusters", "l07_settlement_bands", "j01_verdict", "k05_review", "l06_linked", "m06_processed", "m06_children", "m08_backfilled", "m09_resolved", "o05_nested_actions", "o06_nested_action", "o33_dash_settlements", "o49_sample", "i03_details", "a08_scraped", "a11_archive"])
def test_empty_tables(spark, empty, name):
    (catalog.QUERIES | derived.QUERIES)[name](spark, empty).collect()


def test_schema(spark):
    a = load(spark, DATA, "enforcement_actions")
    assert "Missing column: enforcement_actions.summary" in schema_diff(a, "enforcement_actions")
    assert {r.rule: r["rows"] for r in violations(a, "enforcement_actions").collect()}["id isn't unique"] == 0
    assert all(schema(t).fields for t in DDL)


def test_filters_reach_the_scan(spark):
    plan = catalog.QUERIES["o20_report_coverage"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(quality_score,0.1)" in plan and "raw_text" not in plan


def test_pages_of_actions(spark):
    first, second = (api.list_actions(spark, DATA, limit=20, offset=o).collect() for o in (0, 20))
    whole = api.filtered(spark, DATA).select("id", "date_announced").collect()
    want = [r.id for r in sorted(whole, key=lambda r: (-(r.date_announced.toordinal() if r.date_announced else -1), r.id))][:40]
    assert [r.id for r in first + second] == want
    one = api.get_action(spark, DATA, want[0]).collect()
    assert len(one) == 1 and one[0].id == want[0] and api.get_action(spark, DATA, "none").count() == 0
    assert api.filtered(spark, DATA, q="%_%").count() == 0
    with pytest.raises(ValueError):
        api.list_actions(spark, DATA, limit=501)


def test_report_and_command_line(spark, capsys, monkeypatch, tmp_path):
    from docketry import __main__ as cli

    for args in (["list"], ["actions", DATA, "--state", "ca", "--limit", "3"], ["run", "o02_action_count", DATA, "--json", str(tmp_path / "j")], ["process", DATA, str(tmp_path / "out")]):
        monkeypatch.setattr("sys.argv", ["docketry", *args])
        cli.main()
    out = capsys.readouterr().out
    assert "o02_action_count" in out and '"state":"CA"' in out
    assert load(spark, str(tmp_path / "out"), "enforcement_actions").count() == load(spark, DATA, "enforcement_actions").count()
    text = report.report(spark, DATA)
    assert "## Overview" in text and "## Quality" in text
