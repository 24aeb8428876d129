"""Data audits of the SQL cleaning script, before and after cleaning.

All are single aggregates (partial aggregation map-side, one small shuffle).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def round_pct2(num, den):
    """ROUND(num / den * 100, 2) in decimal arithmetic (integer operands are not
    divided as floats), returned as double; den = 0 -> null."""
    q = F.try_divide(num.cast("decimal(20,0)"), den.cast("decimal(20,0)"))
    return F.round(q * F.lit(100), 2).cast("double")


def audit_total_rows(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("total_rows"))


def audit_date_range(df: DataFrame) -> DataFrame:
    return df.agg(F.min("order_date").alias("start_date"), F.max("order_date").alias("end_date"))


def audit_null_amounts(df: DataFrame) -> DataFrame:
    """Null amounts (first script) and null-or-non-positive amounts (second)."""
    a = F.col("amount")
    return df.agg(F.count_if(a.isNull()).alias("null_amount_rows"),
                  F.count_if(a.isNull() | (a <= 0)).alias("invalid_amount_rows"))


def audit_status_counts(df: DataFrame) -> DataFrame:
    return (df.groupBy("status").agg(F.count(F.lit(1)).alias("cnt"))
              .orderBy(F.desc("cnt"), F.asc("status")))


def audit_state_case(df: DataFrame) -> DataFrame:
    """Raw state counts HAVING COUNT(DISTINCT UPPER(state)) >= 1, which keeps every
    non-null spelling, so nulls are filtered first; ordered by the upper-cased
    spelling."""
    return (df.filter(F.col("ship_state").isNotNull())
              .groupBy("ship_state").agg(F.count(F.lit(1)).alias("cnt"))
              .orderBy(F.upper("ship_state"), "ship_state"))


def audit_state_norm(df: DataFrame) -> DataFrame:
    """Count by UPPER(TRIM(state)) (group by an expression)."""
    return (df.groupBy(F.upper(F.trim("ship_state")).alias("normalised_state"))
              .agg(F.count(F.lit(1)).alias("cnt")).orderBy("normalised_state"))


def distinct_status(df: DataFrame) -> DataFrame:
    """SELECT DISTINCT status."""
    return df.select("status").distinct()


def audit_final(df: DataFrame, variant: str = "v2") -> DataFrame:
    """Final audit after the SQL cleaning (flags present). v1 sums CASE WHEN
    without ELSE, so a count with no matching row is NULL; v2 gives 0."""
    # one additive aggregate by (state, category); the distinct counts are taken over its rows
    part = lambda cond: F.sum(F.when(cond, F.lit(1)))
    per = df.groupBy("ship_state", "category").agg(
        F.count(F.lit(1)).alias("n"), F.sum("is_fulfilled").alias("f"), part(F.col("amount_valid") == 0).alias("bad"),
        part(F.col("b2b_flag") == "B2B").alias("b2b"), part(F.col("b2b_flag") == "B2C").alias("b2c"))

    def cnt(name):
        s = F.sum(name)
        return s if variant == "v1" else F.coalesce(s, F.lit(0)).cast("bigint")
    return per.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("total_rows"),
        F.count_distinct("ship_state").alias("distinct_states"),
        cnt("bad").cast("bigint").alias("invalid_amount_rows"),
        F.sum("f").cast("bigint").alias("fulfilled_orders"),
        round_pct2(F.sum("f"), F.sum("n")).alias("overall_fulfillment_rate_pct"),
        F.count_distinct("category").alias("distinct_categories"),
        cnt("b2b").cast("bigint").alias("b2b_orders"),
        cnt("b2c").cast("bigint").alias("b2c_orders"),
    )
