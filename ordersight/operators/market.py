"""Market scoring over per-state aggregates: ranks, composite expansion score,
expansion targets, quadrants, top-k selections.

Ranks and "top k" are global orderings; they run on the per-state aggregate
(size bounded by the number of distinct states), never on order lines.
Thresholds (median, means, overall rate) are window aggregates over the same
per-state aggregate, so the order lines are scanned once; no cross join or
driver round trip is needed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ordersight.functions.stats import distributed_ranks, pct, rank_by, ratio
from ordersight.operators.kpis import (aggregate, all_rows, exact_mean_over, money,
                                       monthly_trend, revenue_by_state, share_of_total)

# FIXED VALUES: quadrant labels of the fulfillment-vs-revenue chart.
QUADRANTS = ("Star market", "Revenue leakage", "Expansion target", "Low priority")


STATE_BASES = ["revenue", "orders", "lines", "fulfilled", "amount_n"]


def state_aggregate(df: DataFrame) -> DataFrame:
    """ONE per-state aggregate carrying every base measure the state tables
    need (revenue, distinct orders, lines, fulfilled, non-null amounts)."""
    return aggregate(df, "ship_state", STATE_BASES)


def state_base(df: DataFrame, with_aov: bool = False, aggregated: bool = False) -> DataFrame:
    """Per-state totals: distinct orders, fulfilled lines, revenue,
    rate = fulfilled / distinct orders x 100, share, [mean amount].
    ``aggregated``: ``df`` already is ``state_aggregate`` output."""
    agg = df if aggregated else aggregate(
        df, "ship_state", ["revenue", "orders", "fulfilled"] + (["amount_n"] if with_aov else []))
    a = share_of_total(agg, "revenue", "revenue_share_pct")
    cols = [F.col("ship_state"),
            F.col("orders").alias("total_orders"),
            F.col("fulfilled").cast("bigint").alias("fulfilled"),
            money("revenue").alias("revenue"),
            pct(F.col("fulfilled"), F.col("orders")).alias("fulfillment_rate"),
            F.col("revenue_share_pct")]
    if with_aov:
        cols.append(ratio(F.col("revenue"), F.col("amount_n")).alias("avg_order_value"))
    return a.select(*cols)


def expansion_model(df: DataFrame, pillars: int = 2, method: str = "average",
                    aggregated: bool = False) -> DataFrame:
    """W7 (2 pillars: revenue, rate) / W8 (3 pillars: + mean amount):
    descending ranks (``method`` average or min), composite = sum, ascending."""
    return _model(df, pillars, method, aggregated).orderBy("composite_score", "ship_state")


def _model(df: DataFrame, pillars: int, method: str, aggregated: bool) -> DataFrame:
    base = state_base(df, with_aov=pillars == 3, aggregated=aggregated)
    ranked = base.withColumns({
        "revenue_rank": rank_by("revenue", method),
        "fulfillment_rank": rank_by("fulfillment_rate", method),
    })
    composite = F.col("revenue_rank") + F.col("fulfillment_rank")
    if pillars == 3:
        ranked = ranked.withColumn("aov_rank", rank_by("avg_order_value", method))
        composite = composite + F.col("aov_rank")
    return ranked.withColumn("composite_score", composite)


def market_totals(df: DataFrame) -> DataFrame:
    """The base measures of ``state_base`` for a market dimension of any size (no share
    of the total, which needs all markets together)."""
    a = aggregate(df, "ship_state", ["revenue", "orders", "fulfilled", "amount_n"])
    return a.select("ship_state", F.col("orders").alias("total_orders"), F.col("fulfilled").cast("bigint").alias("fulfilled"),
                    money("revenue").alias("revenue"), pct(F.col("fulfilled"), F.col("orders")).alias("fulfillment_rate"),
                    ratio(F.col("revenue"), F.col("amount_n")).alias("avg_order_value"))


def expansion_model_at_any_grain(markets: DataFrame, pillars: int = 3, method: str = "average") -> DataFrame:
    """W5-W8 for a market dimension of any size: all pillars' ranks from one pass
    (``distributed_ranks``), no one-task window. ``markets``: ``market_totals``, written."""
    outs = {"revenue": "revenue_rank", "fulfillment_rate": "fulfillment_rank"} | ({"avg_order_value": "aov_rank"} if pillars == 3 else {})
    ranked = distributed_ranks(markets, "ship_state", outs, method)
    score = F.col("revenue_rank") + F.col("fulfillment_rank")
    return ranked.withColumn("composite_score", score + F.col("aov_rank") if pillars == 3 else score)


def expansion_targets(df: DataFrame, pillars: int = 2, k: int = 10,
                      aggregated: bool = False) -> DataFrame:
    """States with revenue below the median state revenue and rate above
    the mean state rate; rate descending (state breaks ties); first k."""
    model = _model(df, pillars, "average", aggregated)
    cols = model.columns
    # thresholds as window aggregates over the per-state model (one fact scan)
    t = model.withColumns({
        "_median": F.percentile(F.col("revenue").cast("double"), F.lit(0.5)).over(all_rows()),
        "_mean_rate": F.avg("fulfillment_rate").over(all_rows())})
    return (t.filter((F.col("revenue") < F.col("_median"))
                     & (F.col("fulfillment_rate") > F.col("_mean_rate")))
             .select(*cols).orderBy(F.desc("fulfillment_rate"), F.asc("ship_state")).limit(k))


def rank_states(df: DataFrame, method: str) -> DataFrame:
    """W1 (min) / W2 (average) ranks of state revenue and state rate."""
    base = state_base(df)
    return base.select("ship_state",
                       rank_by("revenue", method).alias("revenue_rank"),
                       rank_by("fulfillment_rate", method).alias("fulfillment_rank"))


def top_states(df: DataFrame, k: int) -> DataFrame:
    """First k rows of revenue by state (revenue desc, state asc)."""
    return revenue_by_state(df).limit(k)


def last_months(df: DataFrame, n: int = 12) -> DataFrame:
    """The last n months of the trend, in month order."""
    return monthly_trend(df).orderBy(F.desc("year_month")).limit(n).orderBy("year_month")


def last_month(df: DataFrame) -> DataFrame:
    """Last month row and the one before (month_pos 1 = last)."""
    last2 = monthly_trend(df).orderBy(F.desc("year_month")).limit(2)
    return last2.withColumn("month_pos",
                            F.row_number().over(Window.orderBy(F.desc("year_month"))).cast("bigint"))


def name_list(df: DataFrame, name_col: str, order_cols, k: int, out: str = "names") -> DataFrame:
    """The first k names (in ``order_cols`` order) joined by ', '. Only the
    k selected rows are gathered."""
    top = df.orderBy(*order_cols).limit(k)
    top = top.withColumn("_pos", F.row_number().over(Window.orderBy(*order_cols)))
    ordered = F.array_sort(F.collect_list(F.struct(F.col("_pos"), F.col(name_col).alias("n"))))
    return top.agg(F.array_join(F.transform(ordered, lambda x: x["n"]), ", ").alias(out))


def market_quadrant(df: DataFrame, k: int = 25) -> DataFrame:
    """R2: top-k states; compared with the overall line fulfillment rate and
    the mean revenue of those k rows -> Star / Leakage / Expansion / Low.
    One per-state aggregate; the overall rate and the top-k mean are window
    aggregates over it (no second scan of the order lines)."""
    a = state_aggregate(df)
    a = a.withColumns({
        "_rate_all": pct(F.sum("fulfilled").over(all_rows()), F.sum("lines").over(all_rows())),
        "_total": F.sum("revenue").over(all_rows())})
    st = a.select("ship_state", money("revenue").alias("revenue"), "orders",
                  pct(F.col("fulfilled"), F.col("lines")).alias("fulfillment_rate"),
                  pct(F.col("revenue"), F.col("_total")).alias("revenue_share_pct"), "_rate_all")
    top = st.orderBy(F.desc("revenue"), F.asc("ship_state")).limit(k)
    top = top.withColumn("_avg_rev", exact_mean_over("revenue"))
    hi_rev = F.col("revenue") > F.col("_avg_rev")
    ok_rate = F.col("fulfillment_rate") >= F.col("_rate_all")
    quadrant = (F.when(hi_rev & ok_rate, QUADRANTS[0])
                 .when(hi_rev & ~ok_rate, QUADRANTS[1])
                 .when(~hi_rev & ok_rate, QUADRANTS[2])
                 .otherwise(QUADRANTS[3]))
    return top.select("ship_state", "revenue", "orders", "fulfillment_rate", "revenue_share_pct",
                      quadrant.alias("quadrant"))


def state_bars(df: DataFrame, k: int = 12, highlight: int = 3) -> DataFrame:
    """Top-k states with rate and a flag on the first ``highlight``."""
    top = top_states(df, k)
    pos = F.row_number().over(Window.orderBy(F.desc("revenue"), F.asc("ship_state")))
    return top.select("ship_state", "revenue", "fulfillment_rate",
                      (pos <= highlight).cast("int").alias("is_top"))
