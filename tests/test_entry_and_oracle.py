"""Driver contract and a sample of Spark-vs-DuckDB oracle comparisons."""

import decimal

import duckdb
import pytest

import __spark_entry__ as E
from ordersight.plans.catalog import all_oracles, all_queries
from ordersight.sources.star import TABLES

SF = "/root/testdata/sf0.001"
SAMPLE = ["scalar_kpis", "revenue_by_state", "monthly_trend", "market_model_v2",
          "expansion_targets", "generate_insights", "run_checks", "audit_final", "bi_geo_drill",
          "load_from_df"]


def norm(v):
    if isinstance(v, decimal.Decimal):
        return repr(float(v))
    if isinstance(v, float):
        return repr(v)
    if isinstance(v, (list, tuple)):
        return repr([norm(x) for x in v])
    return str(v)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def test_entry(spark):
    df = E.entry(spark)
    assert df.columns == ["ship_state", "revenue", "orders", "fulfillment_rate", "revenue_share_pct"]
    assert df.count() > 0


def test_every_query_has_callable_and_most_have_oracle():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    q, o = all_queries(), all_oracles()  # the library's own; the text operators have their tests in tests/llm
    assert len(q) >= 120 and len(o) >= len(q) - 5
    assert set(q) <= set(E.queries())


@pytest.mark.parametrize("key", SAMPLE)
def test_oracle_sample(spark, con, key):
    sdf = E.queries()[key](spark, SF)
    rel = con.sql(E.oracle_sql()[key])
    assert sorted(sdf.columns) == sorted(rel.columns)
    order = sorted(sdf.columns)
    s = sorted("|".join(norm(r[c]) for c in order) for r in sdf.collect())
    cols = rel.columns
    o = sorted("|".join(norm(dict(zip(cols, r))[c]) for c in order) for r in rel.fetchall())
    assert s == o


def test_entry_imports_without_a_session():
    import subprocess
    import sys
    root = __import__("os").path.dirname(__import__("os").path.dirname(__file__))
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as E; "
                          "print(len(E.queries()), len(E.oracle_sql()))"],
                         cwd=root, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr[-2000:]


def test_no_cartesian_or_python_rows_in_plans(spark):
    """Plan-only check (no execution) of every registered query that does not
    materialise intermediate tables at definition time."""
    side_effects = ("ins_", "chk_", "run_checks", "sink_", "csv", "watch", "scan_", "load_infile",
                    "top_findings", "table_counts", "run_summary", "export_insights", "parse_insight",
                    "sort_by_impact", "insight", "generate", "periodic_refresh", "_stream", "_stored")
    bad = []
    for key, fn in E.queries().items():
        if any(s in key for s in side_effects):
            continue
        plan = fn(spark, SF)._jdf.queryExecution().executedPlan().toString()
        for flag in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"):
            if flag in plan:
                bad.append((key, flag))
    assert bad == []
