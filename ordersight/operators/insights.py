"""Insight rules: KPI tables -> INSIGHT rows.

Each rule is a DataFrame expression over an aggregated KPI table (bounded by a
dimension's cardinality); thresholds are parameters. Means, totals and
quantiles of a KPI table are window aggregates over that small table; the
overall rate and the name lists are scalar subqueries over small tables. Output columns: rule_id, rule_pos, impact,
category, entity, metric (double), title, detail, action, metric_value.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ordersight.functions.render import fill, fixed, grouped0
from ordersight.functions.stats import pct
from ordersight.operators import kpis as K
from ordersight.operators import market as MK
from ordersight.schema import IMPACT_ORDER

# FIXED VALUES: insight texts. ``{name}`` marks a value filled in per row;
# state and category names inside the advice are configuration defaults.
TEXT = {
    "concentration": {
        "title": "Revenue dangerously concentrated: {names}",
        "detail": "These {n} states account for {pct}% of total revenue. One logistics disruption hits the whole business.",
        "action": "Run targeted campaigns in mid-tier states (RAJASTHAN, PUNJAB, ODISHA). Goal: reduce top-3 concentration below 45%.",
        "metric": "{pct}% in top {n} states",
    },
    "mom_drop": {
        "title": "Revenue dropped {abs_mom}% last month",
        "detail": "Month {month}: Revenue fell to ₹{revenue}. Needs immediate investigation.",
        "action": "Check if top states (MAHARASHTRA, KARNATAKA) saw order drops. Cross-check with fulfilment method — Merchant-fulfilled may be slower.",
        "metric": "{mom}% MoM",
    },
    "mom_dip": {
        "title": "Moderate revenue dip of {abs_mom}% last month",
        "detail": "Month {month}: ₹{revenue}. Watch next cycle closely.",
        "action": "Review category mix — check if low-AOV categories (Blouse, Bottom) are crowding out high-value ones (Set, Kurta).",
        "metric": "{mom}% MoM",
    },
    "mom_growth": {
        "title": "Strong revenue growth of +{mom}% last month",
        "detail": "Month {month}: Revenue reached ₹{revenue}.",
        "action": "Identify what drove growth — new state, category spike, or B2B order. Replicate the conditions.",
        "metric": "+{mom}% MoM",
    },
    "leakage": {
        "title": "{state}: High revenue, poor fulfillment",
        "detail": "₹{revenue} revenue but only {rate}% fulfillment rate (avg: {avg_rate}%).",
        "action": "Switch {state} orders to Amazon-fulfilled (FBA). Merchant fulfillment is costing you completed sales in your best market.",
        "metric": "{rate}% fulfillment",
    },
    "expansion": {
        "title": "{n} states show strong logistics but low penetration",
        "detail": "Top target: {state} — {rate}% fulfillment on only ₹{revenue} revenue.",
        "action": "Prioritise ad spend and seller promotions in: {names}. Infrastructure is ready — only demand generation is missing.",
        "metric": "{n} expansion markets",
    },
    "weak_category": {
        "title": "{category}: low AOV and poor fulfillment",
        "detail": "Avg order ₹{aov} (avg ₹{avg_aov}) and {rate}% fulfillment (avg {avg_rate}%).",
        "action": "Consider bundling {category} with high-AOV items (Set, Kurta) to raise basket size. Review delivery SLA for this category.",
        "metric": "AOV ₹{aov}",
    },
    "b2b_growth": {
        "title": "B2B orders are {share}% of revenue — growth lever",
        "detail": "B2B exists and is generating revenue, but is not the primary channel. B2B orders typically have higher AOV and repeat rates.",
        "action": "Build a dedicated B2B landing page on Amazon Business. Offer bulk pricing for categories like Kurta and Set. Target corporate gifting season.",
        "metric": "{share}% B2B share",
    },
    "b2b_protect": {
        "title": "B2B is {share}% of revenue — protect this channel",
        "detail": "B2B is a significant revenue driver. Retention and account management matter more than acquisition at this stage.",
        "action": "Ensure dedicated account manager for top B2B buyers. Set up auto-reorder or subscription model for repeat B2B customers.",
        "metric": "{share}% B2B share",
    },
    "method_gap": {
        "title": "Amazon-fulfilled orders are {gap}% better at fulfillment",
        "detail": "Amazon: {amazon}% vs Merchant: {merchant}%. Merchant-fulfilled orders are leaking revenue through cancellations.",
        "action": "Migrate top-selling SKUs (Set, Kurta) from Merchant to FBA. Calculate FBA fee vs cancellation loss — the math almost always favours FBA.",
        "metric": "{gap}% fulfillment gap",
    },
    "riskfree": {
        "title": "{names}: near-perfect fulfillment, almost no revenue",
        "detail": "{n} states with ≥95% fulfillment but bottom-10% revenue. Zero operational risk to scale here.",
        "action": "Run low-budget test campaigns in {names}. If demand exists, logistics is already proven — scale quickly.",
        "metric": "{n} risk-free markets",
    },
}


@dataclass
class InsightConfig:
    """Thresholds of the rules (defaults are the source application's)."""
    concentration_top: int = 3
    concentration_pct: float = 50.0
    mom_high: float = -10.0
    mom_medium: float = -5.0
    mom_growth: float = 15.0
    expansion_names: int = 5
    b2b_low: float = 5.0
    b2b_high: float = 30.0
    method_gap: float = 5.0
    riskfree_rate: float = 95.0
    riskfree_quantile: float = 0.10
    riskfree_names: int = 4
    text: dict = field(default_factory=lambda: {k: dict(v) for k, v in TEXT.items()})


COLUMNS = ["rule_id", "rule_pos", "impact", "category", "entity", "metric",
           "title", "detail", "action", "metric_value"]


def _out(df: DataFrame, rule_id: str, rule_pos: int, impact, category, entity, metric,
         title, detail, action, metric_value) -> DataFrame:
    lit = lambda v: F.lit(v) if isinstance(v, str) else v
    return df.select(
        F.lit(rule_id).alias("rule_id"), F.lit(rule_pos).cast("int").alias("rule_pos"),
        lit(impact).alias("impact"), lit(category).alias("category"),
        (entity if entity is not None else F.lit(None).cast("string")).cast("string").alias("entity"),
        metric.cast("double").alias("metric"),
        title.alias("title"), lit(detail).alias("detail"), lit(action).alias("action"),
        metric_value.alias("metric_value"))


# ---- I1 ---------------------------------------------------------------------

def ins_concentration(states: DataFrame, cfg: InsightConfig = InsightConfig()) -> DataFrame:
    """Top-N states' combined revenue share > threshold -> High / Revenue."""
    n = cfg.concentration_top
    order = [F.desc("revenue"), F.asc("ship_state")]
    top = states.withColumn("_total", F.sum("revenue").over(K.all_rows())).orderBy(*order).limit(n)
    names = MK.name_list(states, "ship_state", order, n).select("names").scalar()
    row = top.agg(pct(F.sum("revenue"), F.first("_total")).alias("p")).withColumn("names", names)
    row = row.filter(F.col("p") > cfg.concentration_pct)
    t = cfg.text["concentration"]
    v = dict(names=F.col("names"), pct=fixed("p", 0), n=F.lit(str(n)))
    return _out(row, "ins_concentration", 1, "High", "Revenue", F.col("names"), F.col("p"),
                fill(t["title"], **v), fill(t["detail"], **v), fill(t["action"], **v),
                fill(t["metric"], **v))


# ---- I2 ---------------------------------------------------------------------

def ins_mom_trend(trend: DataFrame, cfg: InsightConfig = InsightConfig()) -> DataFrame:
    """Last non-null MoM (needs >= 2 of them): < -10 High/Alert, < -5
    Medium/Alert, > 15 Low/Growth."""
    t = trend.filter(F.col("revenue_mom_pct").isNotNull())
    last = t.agg(F.count(F.lit(1)).alias("n"),
                 F.max_by(F.struct("year_month", "revenue", "revenue_mom_pct"),
                          F.col("year_month")).alias("l"))
    last = last.filter(F.col("n") >= 2).select("l.*")
    mom, ym = F.col("revenue_mom_pct"), F.col("year_month")
    high, med, grow = mom < cfg.mom_high, mom < cfg.mom_medium, mom > cfg.mom_growth
    last = last.filter(high | med | grow)
    v = dict(abs_mom=fixed(F.abs(mom), 1), mom=fixed(mom, 1), month=ym,
             revenue=grouped0("revenue"))
    d, m, g = cfg.text["mom_drop"], cfg.text["mom_dip"], cfg.text["mom_growth"]

    def pick(field):
        return (F.when(high, fill(d[field], **v)).when(med, fill(m[field], **v))
                 .otherwise(fill(g[field], **v)))
    return _out(
        last, "ins_mom_trend", 2,
        F.when(high, "High").when(med, "Medium").otherwise("Low"),
        F.when(high | med, "Alert").otherwise("Growth"), ym, mom,
        pick("title"), pick("detail"), pick("action"), pick("metric"))


# ---- I3 ---------------------------------------------------------------------

def ins_leakage(states: DataFrame, overall_rate, cfg: InsightConfig = InsightConfig()) -> DataFrame:
    """Per state: revenue above the mean state revenue and rate below the
    overall rate -> High / Fulfillment."""
    rows = (states.withColumn("_mean_rev", K.exact_mean_over("revenue"))
                  .filter((F.col("revenue") > F.col("_mean_rev"))
                          & (F.col("fulfillment_rate") < overall_rate)))
    t = cfg.text["leakage"]
    v = dict(state=F.col("ship_state"), revenue=grouped0("revenue"),
             rate=fixed("fulfillment_rate", 1), avg_rate=fixed(overall_rate, 1))
    return _out(rows, "ins_leakage", 3, "High", "Fulfillment", F.col("ship_state"),
                F.col("fulfillment_rate"), fill(t["title"], **v), fill(t["detail"], **v),
                fill(t["action"], **v), fill(t["metric"], **v))


# ---- I4 ---------------------------------------------------------------------

def ins_expansion(targets: DataFrame, cfg: InsightConfig = InsightConfig()) -> DataFrame:
    """Expansion targets present -> one Medium / Expansion row: count, first
    target, first names."""
    order = [F.desc("fulfillment_rate"), F.asc("ship_state")]
    names = MK.name_list(targets, "ship_state", order, cfg.expansion_names).select("names").scalar()
    row = targets.agg(F.count(F.lit(1)).alias("n"),
                      F.min_by(F.struct("ship_state", "fulfillment_rate", "revenue"),
                               F.struct(F.lit(0) - F.col("fulfillment_rate"),
                                        F.col("ship_state"))).alias("t"))
    row = row.filter(F.col("n") > 0).withColumn("names", names)
    t = cfg.text["expansion"]
    v = dict(n=F.col("n").cast("string"), state=F.col("t.ship_state"),
             rate=fixed("t.fulfillment_rate", 1), revenue=grouped0("t.revenue"),
             names=F.col("names"))
    return _out(row, "ins_expansion", 4, "Medium", "Expansion", F.col("t.ship_state"), F.col("n"),
                fill(t["title"], **v), fill(t["detail"], **v), fill(t["action"], **v),
                fill(t["metric"], **v))


# ---- I5 ---------------------------------------------------------------------

def ins_weak_category(cats: DataFrame, cfg: InsightConfig = InsightConfig()) -> DataFrame:
    """Per category: AOV below the mean AOV and rate below the mean rate ->
    Medium / Revenue."""
    w = K.all_rows()
    rows = (cats.withColumns({"_a": F.avg("avg_order_value").over(w),
                              "_r": F.avg("fulfillment_rate").over(w)})
                .filter((F.col("avg_order_value") < F.col("_a"))
                        & (F.col("fulfillment_rate") < F.col("_r"))))
    avg_aov, avg_ff = F.col("_a"), F.col("_r")
    t = cfg.text["weak_category"]
    v = dict(category=F.col("category"), aov=grouped0("avg_order_value"),
             avg_aov=grouped0(avg_aov), rate=fixed("fulfillment_rate", 1),
             avg_rate=fixed(avg_ff, 1))
    return _out(rows, "ins_weak_category", 5, "Medium", "Revenue", F.col("category"),
                F.col("avg_order_value"), fill(t["title"], **v), fill(t["detail"], **v),
                fill(t["action"], **v), fill(t["metric"], **v))


# ---- I6 ---------------------------------------------------------------------

def ins_b2b(scalars: DataFrame, cfg: InsightConfig = InsightConfig()) -> DataFrame:
    """B2B share in (5, 30) -> Medium / Growth; >= 30 -> Low / Revenue."""
    s = F.col("b2b_revenue_share")
    growth = (s > cfg.b2b_low) & (s < cfg.b2b_high)
    protect = s >= cfg.b2b_high
    rows = scalars.filter(growth | protect)
    v = dict(share=fixed(s, 1))
    gt, pt = cfg.text["b2b_growth"], cfg.text["b2b_protect"]

    def pick(field):
        return F.when(growth, fill(gt[field], **v)).otherwise(fill(pt[field], **v))
    return _out(rows, "ins_b2b", 6, F.when(growth, "Medium").otherwise("Low"),
                F.when(growth, "Growth").otherwise("Revenue"), None, s,
                pick("title"), pick("detail"), pick("action"), pick("metric"))


# ---- I7 ---------------------------------------------------------------------

def ins_method_gap(methods: DataFrame, cfg: InsightConfig = InsightConfig()) -> DataFrame:
    """Amazon vs Merchant rate gap > 5 points -> High / Fulfillment (needs at
    least two methods and both present; the highest-revenue row of each)."""
    up = F.upper("fulfillment")
    key = F.struct(F.lit(0) - F.col("revenue"), F.col("fulfillment"))
    row = methods.agg(
        F.count(F.lit(1)).alias("n"),
        F.min_by(F.when(up == "AMAZON", F.col("fulfillment_rate")),
                 F.when(up == "AMAZON", key)).alias("amz"),
        F.min_by(F.when(up == "MERCHANT", F.col("fulfillment_rate")),
                 F.when(up == "MERCHANT", key)).alias("mer"),
        F.count_if(up == "AMAZON").alias("n_amz"), F.count_if(up == "MERCHANT").alias("n_mer"))
    row = (row.filter((F.col("n") >= 2) & (F.col("n_amz") > 0) & (F.col("n_mer") > 0))
              .withColumn("gap", F.col("amz") - F.col("mer"))
              .filter(F.col("gap") > cfg.method_gap))
    t = cfg.text["method_gap"]
    v = dict(gap=fixed("gap", 1), amazon=fixed("amz", 1), merchant=fixed("mer", 1))
    return _out(row, "ins_method_gap", 7, "High", "Fulfillment", None, F.col("gap"),
                fill(t["title"], **v), fill(t["detail"], **v), fill(t["action"], **v),
                fill(t["metric"], **v))


# ---- I8 ---------------------------------------------------------------------

def ins_riskfree(states: DataFrame, cfg: InsightConfig = InsightConfig(), p10: Column | None = None) -> DataFrame:
    """States with rate >= 95 and revenue <= the 10 % quantile -> one Low /
    Expansion row naming the first four.

    ``p10``: the quantile, for a market dimension of any size
    ``functions.stats.distributed_percentile``; by default ``F.percentile``, whose
    final task holds every distinct revenue, as the states are few."""
    if p10 is None:
        p10 = states.agg(F.percentile(F.col("revenue").cast("double"), F.lit(cfg.riskfree_quantile))).scalar()
    perfect = states.filter((F.col("fulfillment_rate") >= cfg.riskfree_rate) & (F.col("revenue") <= p10))
    order = [F.desc("revenue"), F.asc("ship_state")]
    names = MK.name_list(perfect, "ship_state", order, cfg.riskfree_names).select("names").scalar()
    row = perfect.agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 0).withColumn("names", names)
    t = cfg.text["riskfree"]
    v = dict(n=F.col("n").cast("string"), names=F.col("names"))
    return _out(row, "ins_riskfree", 8, "Low", "Expansion", F.col("names"), F.col("n"),
                fill(t["title"], **v), fill(t["detail"], **v), fill(t["action"], **v),
                fill(t["metric"], **v))


# ---- I9 ---------------------------------------------------------------------

def impact_rank(col="impact"):
    """T4: High, Medium, Low, anything else."""
    c = F.col(col)
    expr = F.lit(len(IMPACT_ORDER))
    for i, name in reversed(list(enumerate(IMPACT_ORDER))):
        expr = F.when(c == name, F.lit(i)).otherwise(expr)
    return expr


def generate_insights(df: DataFrame, cfg: InsightConfig = InsightConfig(),
                      pillars: int = 2, bundle=None) -> DataFrame:
    """I1-I8 over the KPI tables of valid lines, concatenated, stably ordered by
    impact (then rule, then entity). The KPI tables are computed once
    (``operators.bundle``) unless a bundle is passed in."""
    from ordersight.operators.bundle import kpi_bundle
    b = bundle or kpi_bundle(df, pillars)
    states, scal = b.states, b.scalars
    overall_rate = scal.select("fulfillment_rate").scalar()
    parts = [
        ins_concentration(states, cfg),
        ins_mom_trend(b.months, cfg),
        ins_leakage(states, overall_rate, cfg),
        ins_expansion(b.targets, cfg),
        ins_weak_category(b.categories, cfg),
        ins_b2b(scal, cfg),
        ins_method_gap(b.methods, cfg),
        ins_riskfree(states, cfg),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.orderBy(impact_rank(), F.col("rule_pos"), F.col("entity"))


def insight_counts(insights: DataFrame) -> DataFrame:
    """Total, High count, total minus Low ("actions prioritised")."""
    return insights.agg(
        F.count(F.lit(1)).alias("insight_count"),
        F.count_if(F.col("impact") == "High").alias("high_count"),
        (F.count(F.lit(1)) - F.count_if(F.col("impact") == "Low")).alias("actions_prioritized"))
