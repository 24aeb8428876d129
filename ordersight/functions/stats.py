"""Ranking and ratio helpers.

Ranks are global by definition (no partition), so a window without
``partitionBy`` moves its input into one task. They are applied only to
aggregated frames whose size is bounded by a dimension's cardinality (states,
categories, months), never to order lines.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def _c(col):
    return F.col(col) if isinstance(col, str) else col


def ratio(num, den) -> Column:
    """num / den in double; 0 or null denominator -> null (never throws)."""
    return F.try_divide(_c(num).cast("double"), _c(den).cast("double"))


def pct(num, den) -> Column:
    """num / den * 100 in double (same operation order as the SQL oracle)."""
    return ratio(num, den) * F.lit(100)


def min_rank(col, ascending: bool = False) -> Column:
    """SQL RANK(): ties share the minimum rank; nulls ordered last."""
    c = _c(col)
    order = c.asc_nulls_last() if ascending else c.desc_nulls_last()
    return F.rank().over(Window.orderBy(order)).cast("bigint")


def avg_rank(col, ascending: bool = False) -> Column:
    """pandas ``rank(method='average')``: ties get the mean of their positions;
    null values stay unranked (null)."""
    c = _c(col)
    order = c.asc_nulls_last() if ascending else c.desc_nulls_last()
    first = F.rank().over(Window.orderBy(order))
    ties = F.count(F.lit(1)).over(Window.partitionBy(c))
    return F.when(c.isNull(), F.lit(None).cast("double")).otherwise(
        first.cast("double") + (ties.cast("double") - F.lit(1.0)) / F.lit(2.0))


def rank_by(col, method: str = "average", ascending: bool = False) -> Column:
    if method == "average":
        return avg_rank(col, ascending)
    if method == "min":
        return min_rank(col, ascending)
    raise ValueError(f"unknown rank method {method!r}")


def lag_change_pct(col, order_col) -> Column:
    """(x / previous row's x - 1) * 100; first row null (row-based, not calendar)."""
    prev = F.lag(_c(col)).over(Window.orderBy(_c(order_col)))
    return (F.try_divide(_c(col).cast("double"), prev.cast("double")) - F.lit(1)) * F.lit(100)


def _below(value: Column, cuts: list, dtype) -> Column:
    """Number of cut points below a value: among every n-th one first, then among the n
    behind it, so thousands of ranges don't mean thousands of comparisons a row."""
    if not cuts:
        return F.lit(0)
    n = max(1, math.isqrt(len(cuts)))

    def held(some) -> Column:
        return F.array(*[F.lit(x).cast(dtype) for x in some])
    coarse = F.size(F.filter(held(cuts[n - 1::n]), lambda c: c < value)) * n
    return coarse + F.size(F.filter(F.slice(held(cuts), coarse + 1, F.lit(n)), lambda c: c < value))


def _ranged_counts(df, col: str, ascending: bool, partitions: int | None):
    """Steps 1 to 3 of ``distributed_rank``: the distinct values with their row counts
    (``_ties``); the same with ``_range`` and the rows before a value within its range
    (``_before``); a row per range with its rows (``_size``) and those before it
    (``_offset``)."""
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    c = F.col(col)
    order = c.asc() if ascending else c.desc()
    vals = df.filter(c.isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("_ties"))
    marks = [k / n for k in range(1, n)]
    cuts = vals.agg(F.percentile_approx(c, marks).alias("q")).first()["q"] if marks else None
    place = _below(c, sorted(set(cuts or [])), df.schema[col].dataType)
    ranged = vals.withColumn("_range", place if ascending else -place)
    w_local = (Window.partitionBy("_range").orderBy(order)
               .rowsBetween(Window.unboundedPreceding, -1))
    local = ranged.withColumn("_before", F.coalesce(F.sum("_ties").over(w_local), F.lit(0)))
    sizes = ranged.groupBy("_range").agg(F.sum("_ties").alias("_size"))
    offsets = sizes.withColumn(
        "_offset", F.coalesce(F.sum("_size").over(
            Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return vals, local, offsets


def distributed_rank(df, col: str, method: str = "average", ascending: bool = False,
                     out: str = "rank", partitions: int | None = None):
    """Global rank of ``col`` without gathering rows in one task.

    For dimensions too large for a single-partition window (e.g. customers):
    1. distinct values with their row counts (partial aggregation, so a value
       held by a large share of rows is combined map-side);
    2. quantiles of the distinct values cut them into ``partitions`` ranges. The
       boundaries are found once (a few numbers on the driver), so a value's
       range is a fixed function of the value, however often the plan is run;
       inside each range an exclusive running count gives the local offset;
    3. per-range totals (at most one row per range) give each range's offset;
    4. min rank = 1 + rows with a better value; average rank adds
       (ties - 1) / 2; the rank joins back on the value (a hot value is a hot
       join key, which AQE's skew join splits).
    Nulls: unranked with the average method (pandas); ranked last as one tie
    group with the min method (SQL RANK() ... NULLS LAST).
    """
    c = F.col(col)
    vals, local, offsets = _ranged_counts(df, col, ascending, partitions)
    # at most one row per range
    ranks = local.join(F.broadcast(offsets.select("_range", "_offset")), "_range")
    first = F.col("_offset") + F.col("_before") + F.lit(1)
    if method == "average":
        rank = first.cast("double") + (F.col("_ties").cast("double") - F.lit(1.0)) / F.lit(2.0)
    elif method == "min":
        rank = first.cast("bigint")
    else:
        raise ValueError(f"unknown rank method {method!r}")
    ranks = ranks.select(c, rank.alias(out))
    joined = df.join(ranks, col, "left")
    if method == "min":
        non_null = vals.agg(F.sum("_ties")).scalar()
        joined = joined.withColumn(out, F.when(c.isNull(), (non_null + F.lit(1)).cast("bigint"))
                                   .otherwise(F.col(out)))
    return joined


def distributed_percentile(df, col: str, q: float, partitions: int | None = None) -> Column:
    """``F.percentile`` of all rows (linear between the two order statistics around
    (rows - 1) * q, nulls left out) as a one-row subquery, without a map of all
    distinct values in one task: the values are counted by range as in
    ``distributed_rank`` and only the one or two values that hold the order
    statistics come together. Finding the ranges' cuts runs ``df`` once."""
    d = df.select(F.col(col).cast("double").alias("_value"))
    _, local, offsets = _ranged_counts(d, "_value", True, partitions)
    # at most one row per range; with the rows of all ranges
    offsets = offsets.withColumn("_at", (F.sum("_size").over(Window.partitionBy()) - 1) * F.lit(float(q)))
    first = F.col("_offset") + F.col("_before")

    def held(rank: Column) -> Column:
        return (first <= rank) & (rank < first + F.col("_ties"))
    two = (local.join(F.broadcast(offsets.select("_range", "_offset", "_at")), "_range")
                .filter(held(F.floor("_at")) | held(F.ceil("_at"))))
    low, high, at = F.min("_value"), F.max("_value"), F.max("_at")
    return two.agg(F.when(low == high, low).otherwise((F.ceil(at) - at) * low + (at - F.floor(at)) * high)).scalar()


def distributed_ranks(df, key: str, outs: dict[str, str], method: str = "average", ascending: bool = False,
                      partitions: int | None = None):
    """Global ranks of several columns ({column: name of its rank}) of a table with a
    unique ``key``, of any size, in one pass and without a one-task window.

    The columns' values become (column, value) rows. One aggregate finds all columns'
    range cuts (a few numbers on the driver); the values are counted, placed and ranked
    within (column, range), and each range's offset comes from its column's ranges; one
    join by (column, value) and one sum by key bring all ranks back. Values compare as
    doubles. Nulls as in ``distributed_rank``. ``df`` is run twice, so pass a written table.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cols = list(outs)
    marks = [k / n for k in range(1, n)] or [0.5]
    found = df.agg(*[F.percentile_approx(F.col(c).cast("double"), marks).alias(f"cuts{i}") for i, c in enumerate(cols)],
                   *[F.count(c).alias(f"count{i}") for i, c in enumerate(cols)]).first()
    long = df.select(F.col(key).alias("_key"), F.explode(F.array(*[F.struct(F.lit(i).alias("_col"), F.col(c).cast("double").alias("_value")) for i, c in enumerate(cols)])).alias("p"))
    long = long.select("_key", "p.*").filter(F.col("_value").isNotNull())
    counts = long.groupBy("_col", "_value").agg(F.count(F.lit(1)).alias("_ties"))
    place = F.lit(0)
    for i in range(len(cols)):
        place = F.when(F.col("_col") == i, _below(F.col("_value"), sorted(set(found[f"cuts{i}"] or [])), "double")).otherwise(place)
    ranged = counts.withColumn("_range", place if ascending else -place)
    order = F.col("_value").asc() if ascending else F.col("_value").desc()
    inside = Window.partitionBy("_col", "_range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    local = ranged.withColumn("_before", F.coalesce(F.sum("_ties").over(inside), F.lit(0)))
    # a row per column and range
    sizes = ranged.groupBy("_col", "_range").agg(F.sum("_ties").alias("_size"))
    earlier = Window.partitionBy("_col").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_col", "_range", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_offset"))
    first = F.col("_offset") + F.col("_before") + F.lit(1)
    rank = first.cast("double") + (F.col("_ties").cast("double") - F.lit(1.0)) / F.lit(2.0) if method == "average" else first.cast("bigint")
    ranks = local.join(F.broadcast(offsets), ["_col", "_range"]).select("_col", "_value", rank.alias("_rank"))
    wide = long.join(ranks, ["_col", "_value"]).groupBy("_key").agg(
        *[F.max(F.when(F.col("_col") == i, F.col("_rank"))).alias(outs[c]) for i, c in enumerate(cols)])
    joined = df.join(wide, F.col(key).eqNullSafe(F.col("_key")), "left").drop("_key")
    if method == "min":
        joined = joined.withColumns({outs[c]: F.coalesce(outs[c], F.lit(found[f"count{i}"] + 1).cast("bigint")) for i, c in enumerate(cols)})
    return joined
