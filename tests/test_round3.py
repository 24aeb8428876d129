"""Ranks of several columns at once, date formats of a column, sketches, status stream, dense ids."""

import random

import pytest
from pyspark.sql import functions as F

from ordersight.functions import dates as D
from ordersight.functions.stats import avg_rank, distributed_ranks, min_rank
from ordersight.operators import bundle as B
from ordersight.sources import files as FS
from ordersight.streaming import status as ST


@pytest.mark.parametrize("method,window", [("average", avg_rank), ("min", min_rank)])
@pytest.mark.parametrize("parts", [1, 5, 40])
def test_several_ranks_equal_the_windows(spark, method, window, parts):
    rng = random.Random(parts)
    rows = [(i, rng.choice([None, 1.5, 2.5, float(rng.randrange(50))]), rng.choice([None, 7.0, float(rng.randrange(5))])) for i in range(600)]
    df = spark.createDataFrame(rows, "id long, a double, b double")
    got = distributed_ranks(df, "id", {"a": "ra", "b": "rb"}, method, partitions=parts)
    want = df.select("*", window("a").alias("ra"), window("b").alias("rb"))
    assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect()))


def test_several_ranks_have_no_one_task_step(spark, capsys):
    df = spark.range(1000).select(F.col("id").alias("k"), (F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 11).cast("double").alias("b"))
    distributed_ranks(df, "k", {"a": "ra", "b": "rb"}).explain()
    plan = capsys.readouterr().out
    assert "SinglePartition" not in plan and "Window" in plan


def dates(spark, values):
    return spark.createDataFrame([(v,) for v in values], "t string")


def test_a_13th_day_decides_for_the_whole_column(spark):
    df = dates(spark, ["01/02/2022", "13/02/2022", " 03/04/2022 ", None, "", "junk"])
    col, ambiguous = D.parse_date_column(df, "t")
    assert [str(r[0]) for r in df.select(col).collect()] == ["2022-02-01", "2022-02-13", "2022-04-03", "None", "None", "None"] and not ambiguous
    us = dates(spark, ["01/02/2022", "02/13/2022"])
    col, ambiguous = D.parse_date_column(us, "t")
    assert [str(r[0]) for r in us.select(col).collect()] == ["2022-01-02", "2022-02-13"] and not ambiguous


def test_an_ambiguous_column_is_reported(spark):
    df = dates(spark, ["01/02/2022", "03/04/2022"])
    col, ambiguous = D.parse_date_column(df, "t")
    assert ambiguous and [str(r[0]) for r in df.select(col).collect()] == ["2022-01-02", "2022-03-04"]
    same = dates(spark, ["02/02/2022", "05/05/2022"])
    assert not D.parse_date_column(same, "t")[1]  # both ways read the same days
    for empty in ([], [None, ""], ["junk"]):
        col, ambiguous = D.parse_date_column(dates(spark, empty), "t")
        assert not ambiguous and all(r[0] is None for r in dates(spark, empty).select(col).collect())
    assert not D.parse_date_column(dates(spark, ["2022-01-31", "2022-02-01"]), "t")[1]


def test_sketched_orders_are_near(spark):
    n = 40_000
    v = spark.range(n).select((F.col("id") % 30_000).cast("string").alias("order_id"), (F.col("id") % 3).cast("string").alias("ship_state"),
                              F.lit("c").alias("category"), F.lit("2022-01").alias("year_month"), F.lit("f").alias("fulfillment"),
                              F.lit(None).cast("string").alias("sales_channel"), (F.col("id") % 2).cast("int").alias("is_b2b"))
    exact = {(r["gid"], r["key"]): r["orders"] for r in B.order_counts(v).collect()}
    near = {(r["gid"], r["key"]): r["orders"] for r in B.approximate_orders(v).collect()}
    assert set(exact) == set(near) and all(abs(near[k] - x) <= 0.05 * x for k, x in exact.items())


def test_status_stream_in_any_order_and_after_a_replay(spark, tmp_path):
    rng = random.Random(4)
    rows = [(rng.randrange(20), rng.choice("abc"), rng.randrange(30), i) for i in range(400)]
    schema = "user_id long, event_type string, ts long, event_id long"
    want = sorted(map(tuple, ST.latest(spark.createDataFrame(rows, schema)).collect()))
    src = tmp_path / "in"
    for k in range(8):
        rng.shuffle(rows)
        some = rows[k::8] if k < 4 else rows  # later files hold everything again
        spark.createDataFrame(some, schema).coalesce(1).write.mode("append").parquet(str(src))
        q = ST.upsert_stream(spark.readStream.schema(schema).parquet(str(src)), str(tmp_path / "out"), str(tmp_path / "ckpt"))
        q.awaitTermination()
    assert sorted(map(tuple, ST.current(spark, str(tmp_path / "out")).collect())) == want
    q = ST.upsert_stream(spark.readStream.schema(schema).parquet(str(src)), str(tmp_path / "out2"), str(tmp_path / "ckpt2"))
    q.awaitTermination()
    assert sorted(map(tuple, ST.current(spark, str(tmp_path / "out2")).collect())) == want


@pytest.mark.parametrize("block", ["64", "500", "128m"])
def test_dense_ids_for_any_split_size(spark, tmp_path, block):
    for k in range(3):
        (tmp_path / f"f{k}.csv").write_text("".join(f"{k},{i}\n" for i in range(50 * k, 50 * k + 40)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", block)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        rows = FS.numbered(spark.read.schema("k int, i int").csv(str(tmp_path)), "n").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert [r["i"] for r in sorted(rows, key=lambda r: r["n"])] == [50 * k + j for k in range(3) for j in range(40)]
    assert sorted(r["n"] for r in rows) == list(range(120))
