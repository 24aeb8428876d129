"""Analysis checks: KPI tables -> FINDING rows (type, severity, message, ...).

Columns: check_pos, type, severity, message, entity, value, drop_percent,
states. Means are window aggregates over the aggregated (small) tables.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ordersight.functions.render import fill, fixed
from ordersight.operators import kpis as K

# FIXED VALUES: finding messages; ``{name}`` marks a value filled in per row.
MESSAGES = {
    "underperforming_category": "Category '{category}' earns ₹{revenue} vs avg ₹{avg}",
    "weak_market": "'{state}' is a weak market — only ₹{revenue} revenue",
    "mom_revenue_drop": "Revenue dropped {drop}% from {prev} to {last}",
    "low_fulfillment_rate": "Only {rate}% orders fulfilled — major operational risk",
    "expansion_opportunity": "{n} states identified as expansion targets",
}


@dataclass
class CheckConfig:
    category_ratio: float = 0.5
    market_ratio: float = 0.3
    mom_drop_pct: float = 20.0
    low_rate: float = 60.0
    default_rate: float = 100.0


def _finding(df, pos, type_, severity, message, entity=None, value=None, drop=None,
             states=None) -> DataFrame:
    none = lambda t: F.lit(None).cast(t)
    return df.select(
        F.lit(pos).cast("int").alias("check_pos"), F.lit(type_).alias("type"),
        F.lit(severity).alias("severity"), message.alias("message"),
        (entity if entity is not None else none("string")).alias("entity"),
        (value.cast("double") if value is not None else none("double")).alias("value"),
        (drop.cast("double") if drop is not None else none("double")).alias("drop_percent"),
        (states if states is not None else none(T.ArrayType(T.StringType()))).alias("states"))


def chk_category(cats: DataFrame, cfg: CheckConfig = CheckConfig()) -> DataFrame:
    """Category revenue < 0.5 x mean category revenue -> high."""
    avg = cats.agg(K.exact_mean("revenue")).scalar()  # one row; the categories stay distributed
    rows = cats.filter(F.col("revenue") < avg * cfg.category_ratio)
    return _finding(rows, 1, "underperforming_category", "high",
                    fill(MESSAGES["underperforming_category"], category=F.col("category"),
                         revenue=fixed("revenue", 0), avg=fixed(avg, 0)),
                    F.col("category"), F.col("revenue"))


def chk_weak_market(states: DataFrame, cfg: CheckConfig = CheckConfig()) -> DataFrame:
    """State revenue < 0.3 x mean state revenue -> medium."""
    mean = states.agg(K.exact_mean("revenue")).scalar()  # one row; the states stay distributed
    rows = states.filter(F.col("revenue") < mean * cfg.market_ratio)
    return _finding(rows, 2, "weak_market", "medium",
                    fill(MESSAGES["weak_market"], state=F.col("ship_state"),
                         revenue=fixed("revenue", 0)),
                    F.col("ship_state"), F.col("revenue"))


def chk_mom_drop(trend: DataFrame, cfg: CheckConfig = CheckConfig()) -> DataFrame:
    """Last vs previous month (needs two months); previous > 0 and drop
    > 20 % -> critical, drop_percent rounded to 2 places."""
    last2 = trend.orderBy(F.desc("year_month")).limit(2)
    row = last2.agg(F.count(F.lit(1)).alias("n"),
                    F.max_by(F.struct("year_month", "revenue"), F.col("year_month")).alias("last"),
                    F.min_by(F.struct("year_month", "revenue"), F.col("year_month")).alias("prev"))
    pr, lr = F.col("prev.revenue").cast("double"), F.col("last.revenue").cast("double")
    row = (row.filter((F.col("n") >= 2) & (pr > 0))
              .withColumn("drop", (pr - lr) / pr * F.lit(100))
              .filter(F.col("drop") > cfg.mom_drop_pct))
    return _finding(row, 3, "mom_revenue_drop", "critical",
                    fill(MESSAGES["mom_revenue_drop"], drop=fixed("drop", 1),
                         prev=F.col("prev.year_month"), last=F.col("last.year_month")),
                    drop=F.bround(F.col("drop").cast("decimal(38,6)"), 2))


def chk_low_rate(scalars: DataFrame, cfg: CheckConfig = CheckConfig()) -> DataFrame:
    """C4: overall fulfillment rate < 60 (100 when absent) -> critical."""
    rate = F.coalesce(F.col("fulfillment_rate"), F.lit(cfg.default_rate))
    rows = scalars.withColumn("r", rate).filter(F.col("r") < cfg.low_rate)
    return _finding(rows, 4, "low_fulfillment_rate", "critical",
                    fill(MESSAGES["low_fulfillment_rate"], rate=fixed("r", 1)),
                    value=F.col("r"))


def chk_expansion(targets: DataFrame) -> DataFrame:
    """Expansion targets present -> low, with the ordered list of states
    (targets are at most k rows, so the list is bounded)."""
    ordered = F.array_sort(F.collect_list(F.struct(
        F.lit(0) - F.col("fulfillment_rate"), F.col("ship_state").alias("s"))))
    row = targets.agg(F.count(F.lit(1)).alias("n"), ordered.alias("a")).filter(F.col("n") > 0)
    return _finding(row, 5, "expansion_opportunity", "low",
                    fill(MESSAGES["expansion_opportunity"], n=F.col("n").cast("string")),
                    states=F.transform(F.col("a"), lambda x: x["s"]))


def run_checks(df: DataFrame, cfg: CheckConfig = CheckConfig(), bundle=None) -> DataFrame:
    """C1-C5 concatenated in order (KPI tables computed once)."""
    from ordersight.operators.bundle import kpi_bundle
    b = bundle or kpi_bundle(df)
    parts = [chk_category(b.categories, cfg), chk_weak_market(b.states, cfg),
             chk_mom_drop(b.months, cfg), chk_low_rate(b.scalars, cfg),
             chk_expansion(b.targets)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.orderBy("check_pos", F.desc("value"), "entity")


def top_findings(findings: DataFrame, k: int = 5) -> DataFrame:
    """First k findings of severity high/critical in emit order; when there
    is none, the first k findings of all."""
    order = [F.col("check_pos"), F.desc("value"), F.col("entity")]
    hi = F.col("severity").isin("high", "critical")
    # ordered limits (k rows of each task meet) and a one-row aggregate, no window over all findings
    any_hi = findings.agg(F.coalesce(F.max(hi.cast("int")), F.lit(0))).scalar()
    top = findings.filter(hi).orderBy(*order).limit(k)
    return top.unionByName(findings.orderBy(*order).limit(k).filter(any_hi == 0))
