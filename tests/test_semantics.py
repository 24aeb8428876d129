"""Edge cases of the semantic rulings and of the partitioning."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from ordersight.functions.dates import parse_date
from ordersight.functions.text import WS_CHARS, py_strip
from ordersight.operators import clean as C
from ordersight.operators import kpis as K
from ordersight.plans import sqlpack


def test_two_digit_year_pivot_and_strict_formats(spark):
    df = spark.createDataFrame([("04-30-95",), ("04-30-22",), ("4-3-22",), ("12-31-68",),
                                ("01-01-69",), ("2022-04-30",), ("bad",), (None,)], "d string")
    got = [r.x for r in df.select(parse_date("d").alias("x")).collect()]
    assert got == [dt.date(1995, 4, 30), dt.date(2022, 4, 30), dt.date(2022, 4, 3),
                   dt.date(2068, 12, 31), dt.date(1969, 1, 1), None, None, None]


def test_python_strip_semantics(spark):
    vals = ["  Goa\t", "　BIHAR ", "\x0bDelhi\x1c", "  ", None, "in side"]
    df = spark.createDataFrame([(v,) for v in vals], "s string")
    got = [r.x for r in df.select(py_strip("s").alias("x")).collect()]
    assert got == [None if v is None else v.strip() for v in vals]
    assert set(WS_CHARS) == {chr(c) for c in range(0x3001) if chr(c).isspace()}


def test_null_groups_d10(spark):
    rows = [("o1", "04-01-22", "Shipped", None, None, "Set", 1, "10", None, "FALSE"),
            ("o2", "04-02-22", "Shipped", "Amazon", "Amazon.in", None, 1, "20", "GOA", "FALSE"),
            ("o3", "bad", "Shipped", "Amazon", "Amazon.in", "Set", 1, "30", "GOA", "FALSE")]
    cols = ("order_id string, order_date string, status string, fulfillment string, "
            "sales_channel string, category string, quantity int, amount string, "
            "ship_state string, is_b2b_raw string")
    v = C.load_clean(spark.createDataFrame(rows, cols))
    states = {r.ship_state: float(r.revenue) for r in K.revenue_by_state(v).collect()}
    assert states == {None: 10.0, "GOA": 50.0}          # NULL state is its own group
    cats = {r.category for r in K.revenue_by_category(v).collect()}
    assert cats == {None, "Set"}
    assert {r.sales_channel for r in K.by_channel(v).collect()} == {"Amazon.in"}   # null dropped
    assert {r.fulfillment for r in K.by_fulfillment_method(v).collect()} == {"Amazon"}
    months = [(r.year_month, float(r.revenue)) for r in K.monthly_trend(v).collect()]
    assert months == [("2022-04", 30.0)]                # undated line left out of the trend


def test_sql_round_half_up(spark):
    # AVG(1.00, 1.01) = 1.005 -> 1.01 (half up, decimal arithmetic)
    rows = [("a", "X", 1.00, 1, 1), ("b", "X", 1.01, 1, 1), ("c", "Y", 2.00, 0, 1)]
    t = spark.createDataFrame(rows, "order_id string, category string, amount double, "
                                    "is_fulfilled int, amount_valid int") \
        .withColumn("amount", F.col("amount").cast("decimal(12,2)"))
    out = {r.category: r for r in sqlpack.run(spark, "sql_category_aov", t).collect()}
    assert out["X"].avg_order_value == pytest.approx(1.01)
    rate = sqlpack.run(spark, "sql_fulfill_overall", t).collect()[0][0]
    assert rate == pytest.approx(66.67)                  # 2/3 -> 66.666.. -> 66.67


@pytest.mark.parametrize("method", ["average", "min"])
def test_distributed_rank_equals_window_rank(spark, method):
    import random
    from ordersight.functions.stats import distributed_rank, rank_by
    rnd = random.Random(7)
    rows = [(i, float(rnd.randint(0, 40)) if i % 17 else None) for i in range(600)]
    rows += [(1000 + i, 5.0) for i in range(300)]          # one value held by a third of rows
    df = spark.createDataFrame(rows, "k long, v double")
    want = {r.k: r.r for r in df.select("k", rank_by("v", method).alias("r")).collect()}
    got = {r.k: r.rank for r in distributed_rank(df, "v", method, partitions=6).collect()}
    assert got == want
