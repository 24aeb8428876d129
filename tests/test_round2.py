"""Edge cases of amounts, ranks, sinks, file sources and streams."""

import random

import pytest
from pyspark.sql import functions as F

from ordersight.functions.flags import unparsable_amounts
from ordersight.functions.stats import distributed_rank, rank_by
from ordersight.operators import checks as CK
from ordersight.operators.clean import load_clean
from ordersight.operators.report import parse_insight_json
from ordersight.plans import sqlpack
from ordersight.schema import LOAD_COLUMNS, RAW_EXPORT_HEADERS
from ordersight.sources import files, sinks
from ordersight.streaming import watch

LINES = "order_id string, order_date string, status string, ship_state string, amount string"


def test_large_and_small_amounts_survive(spark):
    rows = [(f"o{i}", "04-30-22", "Shipped", "Goa", a) for i, a in enumerate(["10000000000.00", "0.004", "5", "abc", "", None, "-1"])]
    df = spark.createDataFrame(rows, LINES)
    assert sorted(float(r.amount) for r in load_clean(df).collect()) == [0.004, 5.0, 1e10]
    assert tuple(unparsable_amounts(df).first()) == (7, 1)


def test_sums_beyond_ten_to_the_fourteenth(spark):
    one = spark.range(20_001).select(F.lit("Goa").alias("ship_state"), F.lit("9999999999.00").cast("decimal(12,2)").alias("amount"),
                                     F.lit("Shipped").alias("status"), F.lit("Set").alias("category"), F.lit("Amazon").alias("fulfillment"),
                                     F.lit(1).alias("is_fulfilled"), F.lit(1).alias("amount_valid"))
    for name in sqlpack.REPORTS:
        rows = sqlpack.run(spark, name, one).collect()
        assert len(rows) == 1
        if "revenue_share_pct" in rows[0].asDict():
            assert rows[0].revenue_share_pct == 100.0 and rows[0].total_revenue == 9999999999 * 20_001


def test_one_scan_in_every_report(spark, capsys):
    from ordersight.plans.queries import sql_table
    t = sql_table(spark, "/root/testdata/sf0.001")
    for name in sqlpack.REPORTS:
        sqlpack.run(spark, name, t).explain("formatted")
        assert capsys.readouterr().out.split("===")[0].count("lineitem") <= 1


@pytest.mark.parametrize("adaptive", ["true", "false"])
@pytest.mark.parametrize("ascending", [True, False])
def test_distributed_rank_without_exchange_reuse(spark, adaptive, ascending):
    conf = {"spark.sql.exchange.reuse": "false", "spark.sql.adaptive.enabled": adaptive}
    before = {k: spark.conf.get(k) for k in conf}
    rnd = random.Random(1)
    df = spark.createDataFrame([(i, rnd.randrange(30_000) / 7) for i in range(50_000)], "k long, v double")
    want = {r.k: r.r for r in df.select("k", rank_by("v", "average", ascending).alias("r")).collect()}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        got = {r.k: r.rank for r in distributed_rank(df, "v", "average", ascending, partitions=16).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == want


def test_distributed_rank_of_a_million_values(spark):
    df = spark.range(1_000_000).select(((F.col("id") * 7919) % 1_000_003).cast("decimal(20,2)").alias("v"))
    before = spark.conf.get("spark.sql.exchange.reuse")
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        ranked = distributed_rank(df, "v", "min", ascending=True)
        order = ranked.orderBy("v").select("rank", F.monotonically_increasing_id().alias("m"))
        assert order.agg(F.min("rank"), F.max("rank"), F.count_distinct("rank")).first() == (1, 1_000_000, 1_000_000)
        wrong = ranked.alias("a").join(ranked.alias("b"), F.col("b.rank") == F.col("a.rank") + 1).where("b.v <= a.v").count()
        assert wrong == 0
    finally:
        spark.conf.set("spark.sql.exchange.reuse", before)


def test_empty_rerun_replaces_only_its_job(spark, tmp_path):
    path = str(tmp_path / "f")
    one = spark.createDataFrame([("a", 1)], "t string, n int")
    sinks.sink_insights(one, path, "job-1")
    sinks.sink_insights(one, path, "job/2")
    sinks.sink_insights(one.limit(0), path, "job-1")
    assert sinks.read_job(spark, path, "job-1").count() == 0
    assert [tuple(r) for r in sinks.read_job(spark, path, "job/2").collect()] == [("a", 1, "job/2")]


def test_summary_sample_does_not_depend_on_order(spark):
    rows = [("o1", i % 5) for i in range(40)]
    a, b = (sinks.clean_summary(spark.createDataFrame(r, "order_id string, n int").repartition(p)).first()
            for r, p in ((rows, 1), (rows[::-1], 7)))
    assert a.sample_rows == b.sample_rows and len(a.sample_rows) == 10 and a.total_rows == 40


def export(folder, dates, style='"A ""q"", B"'):
    folder.mkdir()
    head = ",".join(RAW_EXPORT_HEADERS)
    lines = [f"{i},o{i},{d},Shipped,Amazon,Amazon.in,Std,{style},SK,Set,M,AS,Shipped,2,INR,10.5,Goa,goa,403001,IN,,TRUE,Easy Ship," for i, d in enumerate(dates)]
    (folder / "a.csv").write_text("\n".join([head, *lines]) + "\n")
    return str(folder)


def test_quoted_text_and_both_year_forms(spark, tmp_path):
    path = export(tmp_path / "in", ["04-30-22", "04-30-2022"])
    for r in files.load_infile(spark, path).collect():
        assert (str(r.order_date), r.style, r.ship_state, r.b2b_flag) == ("2022-04-30", 'A "q", B', "goa", "TRUE")
    typed = files.scan_text_schema(spark, path).collect()
    assert all(r["ship-state"] == "goa" and r["Style"] == 'A "q", B' for r in typed)
    batch = load_clean(files.scan_csv(spark, path)).groupBy("ship_state").agg(F.sum("amount").alias("r")).collect()
    q = watch.watch_csv_dir(spark, path, str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination()
    stream = spark.read.parquet(str(tmp_path / "out")).collect()
    assert [(r.ship_state, float(r.r)) for r in batch] == [(r.ship_state, float(r.revenue)) for r in stream] == [("GOA", 21.0)]


def test_positional_load_of_nineteen_columns(spark, tmp_path):
    values = dict(zip(LOAD_COLUMNS, "o1,04-30-2022,Shipped,Amazon,Amazon.in,Std,ST,SK,Set,M,AS,Shipped,2,INR,10.5,Goa,goa,TRUE,Easy".split(",")))
    (tmp_path / "l").mkdir()
    (tmp_path / "l" / "a.csv").write_text("any header\n" + ",".join(values.values()) + "\n")
    r = files.load_infile(spark, str(tmp_path / "l"), columns=LOAD_COLUMNS).first()
    assert (r.order_id, str(r.order_date), r.quantity, float(r.amount), r.b2b_flag, r.is_fulfilled, r.amount_valid) == ("o1", "2022-04-30", 2, 10.5, "TRUE", 0, 1)


def test_replayed_batch_does_not_double(spark, tmp_path):
    path = export(tmp_path / "in", ["04-30-22"])
    for ck in ("c1", "c2"):  # a fresh checkpoint replays batch 0 into the same output
        watch.watch_csv_dir(spark, path, str(tmp_path / "out"), str(tmp_path / ck)).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1


def test_fence_after_newlines(spark):
    text = '\n\n```json\n[{"title": "T", "impact": "High"}]\n```\n'
    assert [r.title for r in parse_insight_json(spark.createDataFrame([(text,)], "text string")).collect()] == ["T"]


def test_cluster_without_shared_folder_is_refused():
    from ordersight.session import checkpoint_dir

    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"
        getConf = lambda self: Conf()
        getCheckpointDir = lambda self: None

    class Session:
        sparkContext, conf = Context(), Conf()
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        checkpoint_dir(Session())


def test_top_findings_and_weak_market_hold_no_one_task_window(spark, capsys):
    rows = spark.createDataFrame([(1, "t", "medium", "m", f"e{i}", float(i), None, None) for i in range(20)],
                                 "check_pos int, type string, severity string, message string, entity string, value double, drop_percent double, states array<string>")
    top = CK.top_findings(rows)
    assert [r.value for r in top.collect()] == [19.0, 18.0, 17.0, 16.0, 15.0]
    top.explain()
    assert "Window" not in capsys.readouterr().out
    assert CK.top_findings(rows.unionByName(rows.limit(1).withColumn("severity", F.lit("high")))).count() == 1
    states = spark.createDataFrame([("A", 100.0), ("B", 1.0)], "ship_state string, revenue double")
    weak = CK.chk_weak_market(states.withColumn("revenue", F.col("revenue").cast("decimal(38,2)")))
    assert [r.entity for r in weak.collect()] == ["B"]
    weak.explain()
    assert "Window" not in capsys.readouterr().out


def test_bundle_tables_equal_separate_aggregates(spark):
    from ordersight.operators import kpis as K
    from ordersight.operators import market as MK
    from ordersight.operators.bundle import kpi_bundle
    from ordersight.plans.queries import valid
    v = valid(spark, "/root/testdata/sf0.001")
    v = v.withColumn("order_id", F.when(F.col("order_id") != "1", F.col("order_id")))  # some lines without an order id
    rows = lambda df: sorted(map(str, df.collect()))
    record = kpi_bundle(v).record()
    assert len(record) == 10
    for name, want in {"scalar_kpis": K.scalar_kpis(v), "revenue_by_state": K.revenue_by_state(v), "revenue_by_category": K.revenue_by_category(v),
                       "monthly_trend": K.monthly_trend(v), "fulfillment_by_state": K.fulfillment_by_state(v), "b2b_vs_b2c": K.b2b_vs_b2c(v),
                       "expansion_model": MK.expansion_model(v, 2), "expansion_targets": MK.expansion_targets(v, 2),
                       "by_channel": K.by_channel(v), "by_fulfillment_method": K.by_fulfillment_method(v)}.items():
        assert rows(record[name]) == rows(want), name


def test_one_run_from_mapped_file_to_sinks(spark, tmp_path):
    from ordersight.plans.job import run_job
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("Order No,When,State ,Order Status,Sale Amount\no1,04-30-22,goa,Shipped,100\no2,05-01-22,delhi,Cancelled,50\no3,05-02-22,goa,Shipped,0\n")
    mapping = {"order_id": "Order No", "order_date": "When", "ship_state": "State", "status": "Order Status", "amount": "Sale Amount"}
    for _ in range(2):  # a re-run replaces
        paths = run_job(spark, str(tmp_path / "in"), str(tmp_path / "out"), "j1", mapping)
    got = {name: sinks.read_job(spark, p, "j1") for name, p in paths.items()}
    assert got["summary"].first().total_rows == 2
    assert {(r.ship_state, float(r.revenue)) for r in got["revenue_by_state"].collect()} == {("GOA", 100.0), ("DELHI", 50.0)}
    assert got["scalar_kpis"].first().total_orders == 2 and got["findings"].count() >= 1


@pytest.mark.parametrize("rows", ["id", "id % 7", "if(id % 3 = 0, null, id * 0.37 - 900)", "if(id < 1900, 5, id)", "cast(null as long)"])
def test_distributed_percentile_equals_percentile(spark, rows):
    from ordersight.functions.stats import distributed_percentile
    for n in (1, 2001):
        df = spark.range(n).select(F.expr(rows).alias("v"))
        for q in (0.0, 0.1, 0.999):
            want = df.agg(F.percentile(F.col("v").cast("double"), F.lit(q))).first()[0]
            assert spark.range(1).select(distributed_percentile(df, "v", q, partitions=4).alias("p")).first().p == want


def test_customer_quantile_gathers_no_distinct_values(spark, capsys):
    from ordersight.plans import queries as Q
    Q.q_ins_riskfree_customers(spark, "/root/testdata/sf0.001").explain()
    plan = capsys.readouterr().out
    assert "percentile(" not in plan and "_before" in plan
