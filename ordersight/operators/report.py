"""Report data sets and JSON boundary helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ordersight.functions.text import py_strip
from ordersight.operators import insights as IN
from ordersight.schema import INSIGHT, RATE_TARGET


def rate_status(scalars: DataFrame, target: float = RATE_TARGET) -> DataFrame:
    """R1: 'On Target' when the overall rate >= 85, else 'Below Target'."""
    return scalars.select("fulfillment_rate", F.when(F.col("fulfillment_rate") >= target, "On Target")
                          .otherwise("Below Target").alias("rate_status"))


def run_summary(df: DataFrame, insights: DataFrame | None = None, bundle=None) -> DataFrame:
    """One row per run: orders, revenue, insight count, rows, rate. The
    KPI bundle (one pass over the lines) supplies the totals and the insights."""
    from ordersight.operators.bundle import kpi_bundle
    b = bundle or kpi_bundle(df)
    ins = insights if insights is not None else IN.generate_insights(df, bundle=b)
    n_ins = ins.agg(F.count(F.lit(1))).scalar()
    n_rows = b.totals.select(F.col("lines").cast("bigint")).scalar()
    return b.scalars.select("total_orders", "total_revenue", n_ins.alias("insight_count"),
                            n_rows.alias("total_rows"), "fulfillment_rate")


def export_json(table: DataFrame) -> DataFrame:
    """K4: each row of a KPI table as one JSON record (NaN -> null first)."""
    from ordersight.operators.clean import nan_to_null
    return nan_to_null(table).select(F.to_json(F.struct(*table.columns)).alias("record"))


def export_insights_json(insights: DataFrame) -> DataFrame:
    """K5: insight rows as JSON records with the six INSIGHT fields."""
    return insights.select(F.to_json(F.struct(*[f.name for f in INSIGHT.fields])).alias("record"))


def table_counts(tables: dict, counted: dict | None = None) -> DataFrame:
    """K6: row count of each named table, as one union of 1-row aggregates.
    ``counted``: one-row frames (column ``lines``) of counts already known."""
    out = None
    known = {name: t.select(F.col("lines").alias("row_count")) for name, t in (counted or {}).items()}
    for name, t in {**known, **tables}.items():
        c = t if name in known else t.agg(F.count(F.lit(1)).alias("row_count"))
        c = c.select(F.lit(name).alias("table_name"), "row_count")
        out = c if out is None else out.unionByName(c)
    return out


INSIGHT_DEFAULTS = {"title": "Insight", "detail": "", "impact": "Medium", "action": "",
                    "category": "Revenue", "metric_value": ""}


def strip_code_fence(col) -> F.Column:
    """Text between the first pair of ``` fences (leading 'json' dropped),
    stripped; text without a leading fence is only stripped."""
    c = py_strip(col)
    inner = F.split(c, "```", -1).getItem(1)
    inner = F.when(inner.startswith("json"), F.substring(inner, 5, 1 << 30)).otherwise(inner)
    return py_strip(F.when(c.startswith("```"), inner).otherwise(c))


def parse_insight_json(texts: DataFrame, col: str = "text") -> DataFrame:
    """K9: JSON array text -> INSIGHT rows with per-field defaults, ordered by
    impact. Unparsable text yields no row."""
    arr = F.from_json(strip_code_fence(F.col(col)), T.ArrayType(
        T.StructType([T.StructField(k, T.StringType()) for k in INSIGHT_DEFAULTS])))
    rows = texts.select(F.explode(arr).alias("i")).select(
        *[F.coalesce(F.col(f"i.{k}"), F.lit(v)).alias(k) for k, v in INSIGHT_DEFAULTS.items()])
    return rows.orderBy(IN.impact_rank(), "title")
