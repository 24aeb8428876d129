"""KPI aggregates over cleaned, valid order lines.

One generic ``kpi_by(df, dim, metrics)`` builds every per-dimension table in a
single ``groupBy().agg()``: partial aggregation runs map-side, so the shuffle
carries one row per (group, partition) for the additive measures. A distinct
order count adds one shuffle keyed by (group, order_id); map-side
de-duplication keeps a hot group or a hot order from overloading a task.

Money is summed as decimal (exact, order-independent) and turned into double
only for ratios, so results do not depend on partitioning.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ordersight.functions.stats import lag_change_pct, pct, ratio

# Base aggregates: name -> aggregate expression builder.
BASE = {
    "revenue": lambda: F.sum("amount"),
    "orders": lambda: F.count_distinct("order_id"),
    "lines": lambda: F.count(F.lit(1)),
    "quantity": lambda: F.sum("quantity"),
    "fulfilled": lambda: F.sum("is_fulfilled"),
    "amount_n": lambda: F.count("amount"),
    "b2b_revenue": lambda: F.sum(F.when(F.col("is_b2b") == 1, F.col("amount"))),
}


def aggregate(df: DataFrame, dims, bases) -> DataFrame:
    dims = [dims] if isinstance(dims, str) else list(dims or [])
    aggs = [BASE[b]().alias(b) for b in bases]
    return df.groupBy(*dims).agg(*aggs) if dims else df.agg(*aggs)


MONEY = "decimal(38,2)"


def money(col: str):
    """Exact money column as it leaves an operator."""
    return F.col(col).cast(MONEY)


def exact_mean(col):
    """Mean of a decimal column as sum / count in double: exact sum, so the
    value does not depend on partitioning or order."""
    c = F.col(col) if isinstance(col, str) else col
    return F.try_divide(F.sum(c).cast("double"), F.count(c).cast("double"))


def all_rows():
    """A window over all rows of a (bounded, aggregated) frame."""
    return Window.partitionBy()


def share_of_total(df: DataFrame, col: str = "revenue", out: str = "revenue_share_pct") -> DataFrame:
    """value / total * 100, the total taken as a window aggregate over the
    aggregated frame itself. The frame is bounded by a dimension's
    cardinality, so gathering it costs little, and the fact table is scanned
    once (a scalar subquery would re-run the aggregation: a second scan)."""
    return df.withColumn(out, pct(F.col(col), F.sum(col).over(all_rows())))


def exact_mean_over(col, window=None):
    """``exact_mean`` as a window aggregate (default: over all rows)."""
    w = window if window is not None else all_rows()
    c = F.col(col) if isinstance(col, str) else col
    return F.try_divide(F.sum(c).over(w).cast("double"), F.count(c).over(w).cast("double"))


# ---- scalar KPIs (A1-A6) ------------------------------------------------------

def scalar_kpis(df: DataFrame, aggregated: bool = False) -> DataFrame:
    """One row: total_revenue, total_orders, total_quantity, avg_order_value
    (mean line amount), fulfillment_rate (mean flag x 100), b2b_revenue_share.
    ``aggregated``: ``df`` already is the one-row base-measure total."""
    a = df if aggregated else aggregate(df, None, ["revenue", "orders", "quantity", "amount_n",
                                                   "lines", "fulfilled", "b2b_revenue"])
    return a.select(
        money("revenue").alias("total_revenue"),
        F.col("orders").alias("total_orders"),
        F.coalesce(F.col("quantity"), F.lit(0)).cast("bigint").alias("total_quantity"),
        ratio(F.col("revenue"), F.col("amount_n")).alias("avg_order_value"),
        pct(F.col("fulfilled"), F.col("lines")).alias("fulfillment_rate"),
        pct(F.coalesce(F.col("b2b_revenue"), F.lit(0)), F.col("revenue")).alias("b2b_revenue_share"),
    )


def total_revenue(df):
    return scalar_kpis(df).select("total_revenue")


def total_orders(df):
    return scalar_kpis(df).select("total_orders")


def total_quantity(df):
    return scalar_kpis(df).select("total_quantity")


def avg_order_value(df):
    return scalar_kpis(df).select("avg_order_value")


def fulfillment_rate(df):
    return scalar_kpis(df).select("fulfillment_rate")


def b2b_revenue_share(df):
    return scalar_kpis(df).select("b2b_revenue_share")


# ---- per-dimension tables (A7-A14) ---------------------------------------------

def kpi_by(df: DataFrame, dim: str, metrics, aggregated: bool = False) -> DataFrame:
    """Generic per-dimension KPI table.

    metrics (any subset, output order kept): revenue, orders, quantity,
    fulfilled, fulfillment_rate (mean flag x 100), order_fulfillment_rate
    (fulfilled / distinct orders x 100), avg_order_value (revenue / orders),
    avg_line_amount (mean amount), revenue_share_pct (share of total).
    """
    need = set()
    for m in metrics:
        need |= {
            "revenue": {"revenue"}, "orders": {"orders"}, "quantity": {"quantity"},
            "fulfilled": {"fulfilled"}, "fulfillment_rate": {"fulfilled", "lines"},
            "order_fulfillment_rate": {"fulfilled", "orders"},
            "avg_order_value": {"revenue", "orders"},
            "avg_line_amount": {"revenue", "amount_n"},
            "revenue_share_pct": {"revenue"}, "lines": {"lines"},
        }[m]
    bases = [b for b in BASE if b in need]
    a = df if aggregated else aggregate(df, dim, bases)
    if "revenue_share_pct" in metrics:
        a = share_of_total(a, "revenue", "revenue_share_pct")
    cols = {
        "revenue": money("revenue"),
        "orders": F.col("orders"),
        "lines": F.col("lines"),
        "quantity": F.col("quantity").cast("bigint"),
        "fulfilled": F.col("fulfilled").cast("bigint"),
        "fulfillment_rate": pct(F.col("fulfilled"), F.col("lines")),
        "order_fulfillment_rate": pct(F.col("fulfilled"), F.col("orders")),
        "avg_order_value": ratio(F.col("revenue"), F.col("orders")),
        "avg_line_amount": ratio(F.col("revenue"), F.col("amount_n")),
        "revenue_share_pct": F.col("revenue_share_pct"),
    }
    return a.select(F.col(dim), *[cols[m].alias(m) for m in metrics])


def revenue_by_state(df: DataFrame, aggregated: bool = False) -> DataFrame:
    """ship_state, revenue, orders, fulfillment_rate, revenue_share_pct;
    revenue descending (state breaks ties). ``aggregated``: ``df`` already
    holds per-state base measures (revenue, orders, lines, fulfilled)."""
    if aggregated:
        a = share_of_total(df, "revenue", "revenue_share_pct")
        out = a.select("ship_state", money("revenue").alias("revenue"), "orders",
                       pct(F.col("fulfilled"), F.col("lines")).alias("fulfillment_rate"),
                       "revenue_share_pct")
    else:
        out = kpi_by(df, "ship_state", ["revenue", "orders", "fulfillment_rate",
                                        "revenue_share_pct"])
    return out.orderBy(F.desc("revenue"), F.asc("ship_state"))


def revenue_by_category(df: DataFrame, with_quantity: bool = True,
                        aggregated: bool = False) -> DataFrame:
    """Category, revenue, orders, [quantity], fulfillment_rate,
    avg_order_value = revenue / distinct orders."""
    metrics = ["revenue", "orders"] + (["quantity"] if with_quantity else []) + [
        "fulfillment_rate", "avg_order_value"]
    return kpi_by(df, "category", metrics, aggregated).orderBy(F.desc("revenue"), F.asc("category"))


def monthly_trend(df: DataFrame, aggregated: bool = False) -> DataFrame:
    """A9 + W3: year_month, revenue, orders, revenue_mom_pct (vs previous present
    month row). Undated lines are left out of the trend."""
    m = kpi_by(df.filter(F.col("year_month").isNotNull()), "year_month", ["revenue", "orders"],
               aggregated)
    return (m.withColumn("revenue_mom_pct", lag_change_pct("revenue", "year_month"))
             .orderBy("year_month"))


def fulfillment_by_state(df: DataFrame, aggregated: bool = False) -> DataFrame:
    """A10: total_orders (distinct), fulfilled (lines), revenue,
    fulfillment_rate = fulfilled / distinct orders x 100 (may exceed 100),
    revenue_share_pct."""
    a = df if aggregated else aggregate(df, "ship_state", ["revenue", "orders", "fulfilled"])
    a = share_of_total(a, "revenue", "revenue_share_pct")
    return a.select(
        "ship_state",
        F.col("orders").alias("total_orders"),
        F.col("fulfilled").cast("bigint").alias("fulfilled"),
        money("revenue").alias("revenue"),
        pct(F.col("fulfilled"), F.col("orders")).alias("fulfillment_rate"),
        F.col("revenue_share_pct"),
    )


def b2b_vs_b2c(df: DataFrame, aggregated: bool = False) -> DataFrame:
    """Segment (B2B/B2C), revenue, orders."""
    a = df if aggregated else aggregate(df, "is_b2b", ["revenue", "orders"])
    return a.select(
        F.when(F.col("is_b2b") == 1, "B2B").when(F.col("is_b2b") == 0, "B2C")
         .otherwise(F.col("is_b2b").cast("string")).alias("segment"),
        money("revenue").alias("revenue"), F.col("orders"))


def by_channel(df: DataFrame, aggregated: bool = False) -> DataFrame:
    """sales_channel, revenue, orders, avg_order_value; null keys dropped."""
    return (kpi_by(df.filter(F.col("sales_channel").isNotNull()), "sales_channel",
                   ["revenue", "orders", "avg_order_value"], aggregated)
            .orderBy(F.desc("revenue"), F.asc("sales_channel")))


def by_fulfillment_method(df: DataFrame, aggregated: bool = False) -> DataFrame:
    """Fulfillment, revenue, orders, fulfillment_rate; null keys dropped."""
    return (kpi_by(df.filter(F.col("fulfillment").isNotNull()), "fulfillment",
                   ["revenue", "orders", "fulfillment_rate"], aggregated)
            .orderBy(F.desc("revenue"), F.asc("fulfillment")))


def state_aov(df: DataFrame) -> DataFrame:
    """Mean line amount per state."""
    return kpi_by(df, "ship_state", ["avg_line_amount"]).withColumnRenamed(
        "avg_line_amount", "avg_order_value")


def join_state_aov(df: DataFrame) -> DataFrame:
    """State metrics with the per-state mean amount. Both sides of the
    source's left join are per-state aggregates of the same lines, so every
    state of the left side has its right-side row: the join equals ONE
    aggregate carrying both measures (one scan and one shuffle instead of two
    aggregations plus a join)."""
    a = share_of_total(aggregate(df, "ship_state", ["revenue", "orders", "fulfilled", "amount_n"]),
                       "revenue", "revenue_share_pct")
    return a.select(
        "ship_state",
        F.col("orders").alias("total_orders"),
        F.col("fulfilled").cast("bigint").alias("fulfilled"),
        money("revenue").alias("revenue"),
        pct(F.col("fulfilled"), F.col("orders")).alias("fulfillment_rate"),
        F.col("revenue_share_pct"),
        ratio(F.col("revenue"), F.col("amount_n")).alias("avg_order_value"),
    )


# ---- statistics over group tables (A36-A39) -----------------------------------

def mean_of_groups(table: DataFrame, col: str, out: str | None = None) -> DataFrame:
    """Unweighted mean over the rows of an aggregated table (one row)."""
    dtype = dict(table.dtypes)[col]
    mean = exact_mean(col) if dtype.startswith("decimal") else F.avg(col)
    return table.agg(mean.alias(out or f"mean_{col}"))


def quantile_of_groups(table: DataFrame, col: str, q: float, out: str) -> DataFrame:
    """Exact, linearly interpolated quantile over an aggregated table (one row)."""
    return table.agg(F.percentile(F.col(col).cast("double"), F.lit(q)).alias(out))


def group_stats(df: DataFrame, bundle=None) -> DataFrame:
    """A37-A39 on state revenue: mean, median, 10 % quantile; plus mean state
    fulfillment rate and category means (AOV, rate). State and category tables
    come from the one-pass KPI bundle (one scan of the lines)."""
    from ordersight.operators.bundle import kpi_bundle
    b = bundle or kpi_bundle(df)
    s = b.states.agg(
        exact_mean("revenue").alias("mean_state_revenue"),
        F.percentile("revenue", F.lit(0.5)).alias("median_state_revenue"),
        F.percentile("revenue", F.lit(0.1)).alias("p10_state_revenue"),
        F.avg("fulfillment_rate").alias("mean_state_rate"))
    c = b.categories.agg(F.avg("avg_order_value").alias("mean_category_aov"),
                         F.avg("fulfillment_rate").alias("mean_category_rate"))
    return s.select("*", c.select("mean_category_aov").scalar().alias("mean_category_aov"),
                    c.select("mean_category_rate").scalar().alias("mean_category_rate"))
