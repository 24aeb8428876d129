"""Workbook sheets as DataFrame aggregates over the RAW fact table (no amount
filter, no state normalisation: 'DELHI', 'Delhi' and 'delhi' stay apart).
Table-wide averages are window aggregates over the per-state aggregate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordersight.functions.flags import fulfilled
from ordersight.functions.stats import ratio
from ordersight.operators.kpis import all_rows, exact_mean_over

# FIXED VALUES: members kept by the channel filter and the excluded state.
CHANNEL_MEMBERS = ("Amazon.in", "Non-Amazon")
EXCLUDED_STATE = "Odisha"
# FIXED VALUES: explicit member order of the state axis (spellings as listed).
STATE_MEMBER_ORDER = (
    "MAHARASHTRA", "DELHI", "Delhi", "delhi", "New Delhi", "PUNJAB", "Punjab", "punjab", "PB",
    "Punjab/Mohali/Zirakpur", "RAJASTHAN", "Rajasthan", "rajasthan", "Rajshthan", "rajsthan", "RJ",
    "ODISHA", "Odisha", "Orissa", "orissa", "PUDUCHERRY", "Pondicherry", "NL", "AR", "APO",
)


def shipped_flag(df: DataFrame) -> DataFrame:
    return df.withColumn("shipped_flag", fulfilled("status", "bi"))


def _rate():
    """SUM(flag) / COUNT(order id) as a fraction (non-distinct count)."""
    return ratio(F.sum(fulfilled("status", "bi")), F.count("order_id"))


def bi_fulfillment_rate(df: DataFrame) -> DataFrame:
    """Rate by raw state."""
    return df.groupBy("ship_state").agg(_rate().alias("fulfillment_rate"))


def filter_channel_in(df: DataFrame, members=CHANNEL_MEMBERS) -> DataFrame:
    """Keep the listed channels."""
    return df.filter(F.col("sales_channel").isin(*members))


def filter_state_not_in(df: DataFrame, excluded=(EXCLUDED_STATE,)) -> DataFrame:
    """Every member except the excluded ones; null states are kept."""
    return df.filter(F.col("ship_state").isNull() | ~F.col("ship_state").isin(*excluded))


def bi_category_perf(df: DataFrame, channel_filter: bool = False) -> DataFrame:
    """SUM(amount) and rate by category (second sheet: channel filter)."""
    if channel_filter:
        df = filter_channel_in(df)
    return df.groupBy("category").agg(F.sum("amount").cast("decimal(38,2)").alias("revenue"),
                                      _rate().alias("fulfillment_rate"))


def bi_efficiency(df: DataFrame) -> DataFrame:
    """Per state SUM(amount) and COUNT(order id) with the table-wide
    averages of both (window aggregates over the per-state table)."""
    per = df.groupBy("ship_state").agg(F.sum("amount").alias("revenue"),
                                       F.count("order_id").alias("order_count"))
    return per.select("ship_state", F.col("revenue").cast("decimal(38,2)").alias("revenue"),
                      "order_count", exact_mean_over("revenue").alias("avg_revenue"),
                      exact_mean_over("order_count").alias("avg_order_count"))


def bi_fulfillment_quality(df: DataFrame) -> DataFrame:
    """Per state rate and SUM(amount) with pane averages; state filter."""
    per = filter_state_not_in(df).groupBy("ship_state").agg(
        _rate().alias("fulfillment_rate"), F.sum("amount").alias("revenue"))
    return per.select("ship_state", "fulfillment_rate",
                      F.col("revenue").cast("decimal(38,2)").alias("revenue"),
                      F.round(F.avg("fulfillment_rate").over(all_rows()), 9).alias("avg_fulfillment_rate"),
                      exact_mean_over("revenue").alias("avg_revenue"))


def bi_revenue_by_state(df: DataFrame) -> DataFrame:
    """SUM(amount) by raw state."""
    return df.groupBy("ship_state").agg(F.sum("amount").cast("decimal(38,2)").alias("revenue"))


def bi_geo_drill(df: DataFrame) -> DataFrame:
    """The country -> state -> city drill path as one ROLLUP."""
    g = df.rollup("ship_country", "ship_state", "ship_city").agg(
        F.sum("amount").cast("decimal(38,2)").alias("revenue"),
        F.count(F.lit(1)).alias("lines"),
        (F.lit(3) - F.grouping("ship_country") - F.grouping("ship_state")
         - F.grouping("ship_city")).cast("int").alias("level"))
    return g


def manual_sort(df: DataFrame, col: str, members=STATE_MEMBER_ORDER) -> DataFrame:
    """T5: explicit member order; members not listed follow, by name."""
    arr = F.array(*[F.lit(m) for m in members])
    pos = F.array_position(arr, F.col(col))
    sort_pos = F.when(pos > 0, pos).otherwise(F.lit(len(members) + 1)).cast("int")
    return df.withColumn("sort_pos", sort_pos).orderBy("sort_pos", col)


def member_except(df: DataFrame, excluded=(EXCLUDED_STATE,)) -> DataFrame:
    """The member set minus the excluded members (EXCEPT of key sets)."""
    members = df.select("ship_state").distinct()
    drop = df.sparkSession.createDataFrame([(m,) for m in excluded], "ship_state string")
    return members.exceptAll(drop)
