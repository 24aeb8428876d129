"""Registered queries (Spark) with their DuckDB oracle text.

Inputs are always the star-schema tables under ``sf_dir``; the order lines are
rebuilt from them by ``sources.star`` and every operator runs over all lines.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ordersight.operators import clean as C
from ordersight.operators import kpis as K
from ordersight.plans import oracle as O
from ordersight.plans.catalog import register
from ordersight.sources.star import sales_view


def sales(spark, sf, skewed=False):
    return sales_view(spark, sf, skewed)


def valid(spark, sf, skewed=False, policy="exact"):
    return C.load_clean(sales_view(spark, sf, skewed), fulfilled_policy=policy)


M, P, R = O.money, O.pct, O.ratio


# =============================================================================
# Scalar KPIs
# =============================================================================

SCALAR_SQL = f"""SELECT {M('SUM(amount)')} AS total_revenue,
  COUNT(DISTINCT order_id) AS total_orders,
  CAST(COALESCE(SUM(quantity), 0) AS BIGINT) AS total_quantity,
  {R('SUM(amount)', 'COUNT(amount)')} AS avg_order_value,
  {P('SUM(is_fulfilled)', 'COUNT(*)')} AS fulfillment_rate,
  {P('COALESCE(SUM(CASE WHEN is_b2b = 1 THEN amount END), 0)', 'SUM(amount)')} AS b2b_revenue_share
FROM valid"""


@register("scalar_kpis", O.with_ctes(SCALAR_SQL))
def q_scalar_kpis(spark, sf):
    """A1-A6 in one aggregate over valid lines."""
    return K.scalar_kpis(valid(spark, sf))


for _col in ("total_revenue", "total_orders", "total_quantity", "avg_order_value",
             "fulfillment_rate", "b2b_revenue_share"):
    def _mk(col):
        def q(spark, sf):
            return getattr(K, col)(valid(spark, sf))
        q.__doc__ = f"{col} over valid lines."
        return q
    register(_col, O.with_ctes(f"SELECT {_col} FROM ({SCALAR_SQL})"))(_mk(_col))


# =============================================================================
# Per-dimension KPI tables
# =============================================================================

REV_BY_STATE_SQL = f"""SELECT ship_state, {M('SUM(amount)')} AS revenue,
  COUNT(DISTINCT order_id) AS orders,
  {P('SUM(is_fulfilled)', 'COUNT(*)')} AS fulfillment_rate,
  {P('SUM(amount)', 'SUM(SUM(amount)) OVER ()')} AS revenue_share_pct
FROM valid GROUP BY ship_state"""


@register("revenue_by_state", O.with_ctes(REV_BY_STATE_SQL + " ORDER BY revenue DESC, ship_state"))
def q_revenue_by_state(spark, sf):
    return K.revenue_by_state(valid(spark, sf))


REV_BY_CAT_SQL = f"""SELECT category, {M('SUM(amount)')} AS revenue,
  COUNT(DISTINCT order_id) AS orders, CAST(SUM(quantity) AS BIGINT) AS quantity,
  {P('SUM(is_fulfilled)', 'COUNT(*)')} AS fulfillment_rate,
  {R('SUM(amount)', 'COUNT(DISTINCT order_id)')} AS avg_order_value
FROM valid GROUP BY category"""


@register("revenue_by_category", O.with_ctes(REV_BY_CAT_SQL))
def q_revenue_by_category(spark, sf):
    return K.revenue_by_category(valid(spark, sf))


MONTHLY_SQL = f"""SELECT year_month, revenue, orders,
  (CAST(revenue AS DOUBLE) / CAST(LAG(revenue) OVER (ORDER BY year_month) AS DOUBLE) - 1) * 100
    AS revenue_mom_pct
FROM (SELECT year_month, {M('SUM(amount)')} AS revenue, COUNT(DISTINCT order_id) AS orders
      FROM valid WHERE year_month IS NOT NULL GROUP BY year_month) m"""


@register("monthly_trend", O.with_ctes(MONTHLY_SQL))
def q_monthly_trend(spark, sf):
    return K.monthly_trend(valid(spark, sf))


@register("mom_pct", O.with_ctes(f"SELECT year_month, revenue_mom_pct FROM ({MONTHLY_SQL})"))
def q_mom_pct(spark, sf):
    """Month-over-month change vs the previous present month."""
    return K.monthly_trend(valid(spark, sf)).select("year_month", "revenue_mom_pct")


FBS_SQL = f"""SELECT ship_state, COUNT(DISTINCT order_id) AS total_orders,
  CAST(SUM(is_fulfilled) AS BIGINT) AS fulfilled, {M('SUM(amount)')} AS revenue,
  {P('SUM(is_fulfilled)', 'COUNT(DISTINCT order_id)')} AS fulfillment_rate,
  {P('SUM(amount)', 'SUM(SUM(amount)) OVER ()')} AS revenue_share_pct
FROM valid GROUP BY ship_state"""


@register("fulfillment_by_state", O.with_ctes(FBS_SQL))
def q_fulfillment_by_state(spark, sf):
    return K.fulfillment_by_state(valid(spark, sf))


@register("share_of_total", O.with_ctes(
    f"SELECT ship_state, revenue_share_pct FROM ({REV_BY_STATE_SQL})"))
def q_share_of_total(spark, sf):
    """Each state's revenue / total revenue x 100."""
    return K.revenue_by_state(valid(spark, sf)).select("ship_state", "revenue_share_pct")


@register("b2b_vs_b2c", O.with_ctes(f"""SELECT CASE WHEN is_b2b = 1 THEN 'B2B' ELSE 'B2C' END AS segment,
  {M('SUM(amount)')} AS revenue, COUNT(DISTINCT order_id) AS orders
FROM valid GROUP BY is_b2b"""))
def q_b2b_vs_b2c(spark, sf):
    return K.b2b_vs_b2c(valid(spark, sf))


@register("by_channel", O.with_ctes(f"""SELECT sales_channel, {M('SUM(amount)')} AS revenue,
  COUNT(DISTINCT order_id) AS orders,
  {R('SUM(amount)', 'COUNT(DISTINCT order_id)')} AS avg_order_value
FROM valid WHERE sales_channel IS NOT NULL GROUP BY sales_channel"""))
def q_by_channel(spark, sf):
    return K.by_channel(valid(spark, sf))


BY_METHOD_SQL = f"""SELECT fulfillment, {M('SUM(amount)')} AS revenue,
  COUNT(DISTINCT order_id) AS orders, {P('SUM(is_fulfilled)', 'COUNT(*)')} AS fulfillment_rate
FROM valid WHERE fulfillment IS NOT NULL GROUP BY fulfillment"""


@register("by_fulfillment_method", O.with_ctes(BY_METHOD_SQL))
def q_by_fulfillment_method(spark, sf):
    return K.by_fulfillment_method(valid(spark, sf))


STATE_AOV_SQL = f"""SELECT ship_state, {R('SUM(amount)', 'COUNT(amount)')} AS avg_order_value
FROM valid GROUP BY ship_state"""


@register("state_aov", O.with_ctes(STATE_AOV_SQL))
def q_state_aov(spark, sf):
    return K.state_aov(valid(spark, sf))


@register("join_state_aov", O.with_ctes(
    f"SELECT f.*, a.avg_order_value FROM ({FBS_SQL}) f LEFT JOIN ({STATE_AOV_SQL}) a "
    f"ON f.ship_state = a.ship_state"))
def q_join_state_aov(spark, sf):
    """State metrics left-joined with the per-state mean amount."""
    return K.join_state_aov(valid(spark, sf))


GROUP_STATS_SQL = f"""SELECT s.*, c.mean_category_aov, c.mean_category_rate FROM
 (SELECT {R('SUM(revenue)', 'COUNT(revenue)')} AS mean_state_revenue,
         quantile_cont(CAST(revenue AS DOUBLE), 0.5) AS median_state_revenue,
         quantile_cont(CAST(revenue AS DOUBLE), 0.1) AS p10_state_revenue,
         round(AVG(fulfillment_rate), 9) AS mean_state_rate
  FROM ({REV_BY_STATE_SQL}) st) s,
 (SELECT round(AVG(avg_order_value), 9) AS mean_category_aov,
         round(AVG(fulfillment_rate), 9) AS mean_category_rate FROM ({REV_BY_CAT_SQL}) ct) c"""


@register("group_stats", O.with_ctes(GROUP_STATS_SQL))
def q_group_stats(spark, sf):
    """Mean / median / 10 % quantile of state revenue, mean state rate,
    category means (double means rounded to 9 places)."""
    g = K.group_stats(valid(spark, sf))
    return g.select("mean_state_revenue", "median_state_revenue", "p10_state_revenue",
                    F.round("mean_state_rate", 9).alias("mean_state_rate"),
                    F.round("mean_category_aov", 9).alias("mean_category_aov"),
                    F.round("mean_category_rate", 9).alias("mean_category_rate"))


@register("median_of_groups", O.with_ctes(
    f"SELECT quantile_cont(CAST(revenue AS DOUBLE), 0.5) AS median_state_revenue "
    f"FROM ({REV_BY_STATE_SQL}) st"))
def q_median_of_groups(spark, sf):
    """Median of state revenue (linear interpolation)."""
    return K.quantile_of_groups(K.revenue_by_state(valid(spark, sf)), "revenue", 0.5,
                                "median_state_revenue")


@register("p10_of_groups", O.with_ctes(
    f"SELECT quantile_cont(CAST(revenue AS DOUBLE), 0.1) AS p10_state_revenue "
    f"FROM ({REV_BY_STATE_SQL}) st"))
def q_p10_of_groups(spark, sf):
    """10 % quantile of state revenue (linear interpolation)."""
    return K.quantile_of_groups(K.revenue_by_state(valid(spark, sf)), "revenue", 0.1,
                                "p10_state_revenue")


@register("mean_of_groups", O.with_ctes(
    f"SELECT {R('SUM(revenue)', 'COUNT(revenue)')} AS mean_state_revenue FROM ({REV_BY_STATE_SQL}) st"))
def q_mean_of_groups(spark, sf):
    """Unweighted mean of state revenue."""
    return K.mean_of_groups(K.revenue_by_state(valid(spark, sf)), "revenue", "mean_state_revenue")


# =============================================================================
# Audits (A15-A21, U2) and the SQL pack
# =============================================================================

from ordersight.operators import audit as A  # noqa: E402
from ordersight.plans import sqlpack  # noqa: E402

SQLT_CTE = """sqlt AS (SELECT order_id, order_date, status, fulfillment, sales_channel, category,
  quantity, amount, upper(trim(ship_state)) AS ship_state, upper(trim(ship_city)) AS ship_city,
  CASE WHEN upper(trim(status)) IN ('SHIPPED', 'SHIPPED - DELIVERED TO BUYER') THEN 1 ELSE 0 END
    AS is_fulfilled,
  CASE WHEN amount IS NULL OR amount <= 0 THEN 0 ELSE 1 END AS amount_valid,
  CASE WHEN upper(trim(is_b2b_raw)) IN ('TRUE', '1', 'YES', 'B2B') THEN 'B2B' ELSE 'B2C' END
    AS b2b_flag
FROM sales)"""


def sql_table(spark, sf):
    """The fact table after the SQL cleaning script's UPDATEs."""
    return C.sql_flags(sales(spark, sf))


def _sq(body):
    return O.with_ctes(body, extra=SQLT_CTE)


@register("audit_total_rows", _sq("SELECT COUNT(*) AS total_rows FROM sales"))
def q_audit_total_rows(spark, sf):
    return A.audit_total_rows(sales(spark, sf))


@register("audit_date_range", _sq(
    "SELECT MIN(order_date) AS start_date, MAX(order_date) AS end_date FROM sales"))
def q_audit_date_range(spark, sf):
    return A.audit_date_range(sales(spark, sf))


@register("audit_null_amounts", _sq(
    "SELECT COUNT(*) FILTER (WHERE amount IS NULL) AS null_amount_rows, "
    "COUNT(*) FILTER (WHERE amount IS NULL OR amount <= 0) AS invalid_amount_rows FROM sales"))
def q_audit_null_amounts(spark, sf):
    """Null (first script) and null-or-non-positive (second) amounts."""
    return A.audit_null_amounts(sales(spark, sf))


@register("audit_status_counts", _sq(
    "SELECT status, COUNT(*) AS cnt FROM sales GROUP BY status ORDER BY cnt DESC"))
def q_audit_status_counts(spark, sf):
    return A.audit_status_counts(sales(spark, sf))


@register("audit_state_case", _sq(
    "SELECT ship_state, COUNT(*) AS cnt FROM sales GROUP BY ship_state "
    "HAVING COUNT(DISTINCT upper(ship_state)) >= 1 ORDER BY upper(ship_state)"))
def q_audit_state_case(spark, sf):
    return A.audit_state_case(sales(spark, sf))


@register("audit_state_norm", _sq(
    "SELECT upper(trim(ship_state)) AS normalised_state, COUNT(*) AS cnt FROM sales "
    "GROUP BY upper(trim(ship_state)) ORDER BY normalised_state"))
def q_audit_state_norm(spark, sf):
    return A.audit_state_norm(sales(spark, sf))


@register("distinct_status", _sq("SELECT DISTINCT status FROM sales"))
def q_distinct_status(spark, sf):
    return A.distinct_status(sales(spark, sf))


def _final_sql(v1: bool):
    e = "" if v1 else " ELSE 0"
    return _sq(f"""SELECT COUNT(*) AS total_rows, COUNT(DISTINCT ship_state) AS distinct_states,
  CAST(SUM(CASE WHEN amount_valid = 0 THEN 1{e} END) AS BIGINT) AS invalid_amount_rows,
  CAST(SUM(is_fulfilled) AS BIGINT) AS fulfilled_orders,
  {O.round_rate_pct('SUM(is_fulfilled)', 'COUNT(*)')} AS overall_fulfillment_rate_pct,
  COUNT(DISTINCT category) AS distinct_categories,
  CAST(SUM(CASE WHEN b2b_flag = 'B2B' THEN 1{e} END) AS BIGINT) AS b2b_orders,
  CAST(SUM(CASE WHEN b2b_flag = 'B2C' THEN 1{e} END) AS BIGINT) AS b2c_orders
FROM sqlt""")


@register("audit_final", _final_sql(False))
def q_audit_final(spark, sf):
    """A21, second script: counts with ELSE 0."""
    return A.audit_final(sql_table(spark, sf), "v2")


@register("audit_final_v1", _final_sql(True))
def q_audit_final_v1(spark, sf):
    """A21, first script: CASE without ELSE (NULL when no row matches)."""
    return A.audit_final(sql_table(spark, sf), "v1")


_MONEY = M("SUM(amount)")
_RAVG = O.round_avg_money("amount")
_SHIP = "SUM(CASE WHEN status = 'Shipped' THEN 1 ELSE 0 END)"
_TOT_ALL = "(SELECT SUM(amount) FROM sqlt)"
_TOT_VALID = "(SELECT SUM(amount) FROM sqlt WHERE amount_valid = 1)"

SQLPACK_ORACLE = {
    "overall_revenue_aov_v1": f"SELECT {_MONEY} AS total_revenue, {_RAVG} AS avg_order_value FROM sqlt",
    "overall_revenue_aov": f"SELECT {_MONEY} AS total_revenue, COUNT(*) AS total_orders, "
                           f"{_RAVG} AS avg_order_value FROM sqlt WHERE amount_valid = 1",
    "sql_revenue_by_state_v1": f"SELECT ship_state, {_MONEY} AS total_revenue, COUNT(*) AS total_orders "
                               f"FROM sqlt GROUP BY ship_state",
    "sql_revenue_by_state": f"SELECT ship_state, {_MONEY} AS total_revenue, COUNT(*) AS total_orders "
                            f"FROM sqlt WHERE amount_valid = 1 GROUP BY ship_state",
    "sql_revenue_share_v1": f"SELECT ship_state, {_MONEY} AS total_revenue, "
                            f"{O.round_share_pct('SUM(amount)', _TOT_ALL)} AS revenue_share_pct "
                            f"FROM sqlt GROUP BY ship_state",
    "sql_revenue_share": f"SELECT ship_state, {_MONEY} AS total_revenue, "
                         f"{O.round_share_pct('SUM(amount)', _TOT_VALID)} AS revenue_share_pct "
                         f"FROM sqlt WHERE amount_valid = 1 GROUP BY ship_state",
    "sql_category_aov": f"SELECT category, {_MONEY} AS total_revenue, COUNT(*) AS total_orders, "
                        f"{_RAVG} AS avg_order_value FROM sqlt WHERE amount_valid = 1 GROUP BY category",
    "sql_fulfill_by_state_v1": f"SELECT ship_state, COUNT(*) AS total_orders, CAST({_SHIP} AS BIGINT) AS shipped_orders, "
                               f"{O.round_rate_pct(_SHIP, 'COUNT(*)')} AS fulfillment_rate "
                               f"FROM sqlt GROUP BY ship_state",
    "sql_fulfill_by_state": f"SELECT ship_state, COUNT(*) AS total_orders, CAST(SUM(is_fulfilled) AS BIGINT) AS fulfilled_orders, "
                            f"{O.round_rate_pct('SUM(is_fulfilled)', 'COUNT(*)')} AS fulfillment_rate_pct "
                            f"FROM sqlt GROUP BY ship_state",
    "sql_fulfill_overall": f"SELECT {O.round_rate_pct('SUM(is_fulfilled)', 'COUNT(*)')} "
                           f"AS overall_fulfillment_rate_pct FROM sqlt",
    "sql_fulfill_by_category": f"SELECT category, COUNT(*) AS total_orders, CAST(SUM(is_fulfilled) AS BIGINT) AS fulfilled_orders, "
                               f"{O.round_rate_pct('SUM(is_fulfilled)', 'COUNT(*)')} AS fulfillment_rate_pct "
                               f"FROM sqlt GROUP BY category",
    "sql_fulfill_by_method": f"SELECT fulfillment, COUNT(*) AS total_orders, {_MONEY} AS total_revenue, "
                             f"{O.round_rate_pct('SUM(is_fulfilled)', 'COUNT(*)')} AS fulfillment_rate_pct "
                             f"FROM sqlt WHERE amount_valid = 1 GROUP BY fulfillment",
    "market_model_v1": f"""WITH sm AS (SELECT ship_state, {_MONEY} AS total_revenue,
    {O.round_share_pct('SUM(amount)', _TOT_ALL)} AS revenue_share_pct,
    {O.round_rate_pct(_SHIP, 'COUNT(*)')} AS fulfillment_rate
  FROM sqlt GROUP BY ship_state)
SELECT ship_state, total_revenue, revenue_share_pct, fulfillment_rate,
  RANK() OVER (ORDER BY total_revenue DESC) AS revenue_rank,
  RANK() OVER (ORDER BY fulfillment_rate DESC) AS fulfillment_rank,
  RANK() OVER (ORDER BY total_revenue DESC) + RANK() OVER (ORDER BY fulfillment_rate DESC) AS composite_score
FROM sm""",
    "market_model_v2": f"""WITH sm AS (SELECT ship_state, {_MONEY} AS total_revenue,
    {O.round_share_pct('SUM(amount)', _TOT_VALID)} AS revenue_share_pct,
    {O.round_rate_pct('SUM(is_fulfilled)', 'COUNT(*)')} AS fulfillment_rate,
    {_RAVG} AS avg_order_value, COUNT(*) AS total_orders
  FROM sqlt WHERE amount_valid = 1 GROUP BY ship_state),
r AS (SELECT *, RANK() OVER (ORDER BY total_revenue DESC) AS revenue_rank,
  RANK() OVER (ORDER BY fulfillment_rate DESC) AS fulfillment_rank,
  RANK() OVER (ORDER BY avg_order_value DESC) AS aov_rank FROM sm)
SELECT *, revenue_rank + fulfillment_rank + aov_rank AS composite_score FROM r""",
}

_SQLPACK_DOCS = {
    "overall_revenue_aov_v1": "A22 first script: SUM and ROUND(AVG, 2) over all rows.",
    "overall_revenue_aov": "A22 second script: + COUNT(*), valid amounts only.",
    "sql_revenue_by_state_v1": "A23 first script: SUM, COUNT(*) by state, all rows.",
    "sql_revenue_by_state": "A23 second script: valid amounts only.",
    "sql_revenue_share_v1": "A24 first script: share via uncorrelated scalar subquery.",
    "sql_revenue_share": "A24 second script: DECIMAL cast, valid only.",
    "sql_category_aov": "A25: SUM, COUNT(*), ROUND(AVG, 2) by category.",
    "sql_fulfill_by_state_v1": "A26 first script: 'Shipped' only.",
    "sql_fulfill_by_state": "A26 second script: is_fulfilled, exact decimal division.",
    "sql_fulfill_overall": "A27: one overall rate.",
    "sql_fulfill_by_category": "A28: rate by category.",
    "sql_fulfill_by_method": "A29: count, revenue, rate by method, valid only.",
    "market_model_v1": "W5/W1: state metrics, two RANK()s, composite.",
    "market_model_v2": "W6/W1: rounded metrics, three RANK()s, composite.",
}

for _name, _oracle in SQLPACK_ORACLE.items():
    def _mk_sqlpack(name):
        def q(spark, sf):
            return sqlpack.run(spark, name, sql_table(spark, sf))
        q.__doc__ = _SQLPACK_DOCS[name]
        return q
    register(_name, _sq(_oracle))(_mk_sqlpack(_name))


# =============================================================================
# Market model: ranks, expansion, targets, quadrants, top-k (W1-W2, W7-W9,
# T1-T3, T8, R2, R3)
# =============================================================================

from ordersight.operators import market as MK  # noqa: E402


def state_base_sql(with_aov=False):
    aov = f",\n  {R('SUM(amount)', 'COUNT(amount)')} AS avg_order_value" if with_aov else ""
    return f"""SELECT ship_state, COUNT(DISTINCT order_id) AS total_orders,
  CAST(SUM(is_fulfilled) AS BIGINT) AS fulfilled, {M('SUM(amount)')} AS revenue,
  {P('SUM(is_fulfilled)', 'COUNT(DISTINCT order_id)')} AS fulfillment_rate,
  {P('SUM(amount)', 'SUM(SUM(amount)) OVER ()')} AS revenue_share_pct{aov}
FROM valid GROUP BY ship_state"""


def avg_rank_sql(x):
    return (f"CASE WHEN {x} IS NULL THEN NULL ELSE "
            f"CAST(RANK() OVER (ORDER BY {x} DESC NULLS LAST) AS DOUBLE) + "
            f"(CAST(COUNT(*) OVER (PARTITION BY {x}) AS DOUBLE) - 1.0) / 2.0 END")


def min_rank_sql(x):
    return f"RANK() OVER (ORDER BY {x} DESC NULLS LAST)"


def model_sql(pillars=2, method="average"):
    rk = avg_rank_sql if method == "average" else min_rank_sql
    if pillars == 3:
        return f"""SELECT *, revenue_rank + fulfillment_rank + aov_rank AS composite_score FROM (
  SELECT *, {rk('revenue')} AS revenue_rank, {rk('fulfillment_rate')} AS fulfillment_rank,
         {rk('avg_order_value')} AS aov_rank FROM ({state_base_sql(True)}) b) r"""
    return f"""SELECT *, revenue_rank + fulfillment_rank AS composite_score FROM (
  SELECT *, {rk('revenue')} AS revenue_rank, {rk('fulfillment_rate')} AS fulfillment_rank
  FROM ({state_base_sql(False)}) b) r"""


@register("expansion_model_v1", O.with_ctes(model_sql(2)))
def q_expansion_model_v1(spark, sf):
    """Two pillars (revenue, rate), average ranks, composite ascending."""
    return MK.expansion_model(valid(spark, sf), 2, "average")


@register("expansion_model_v3", O.with_ctes(model_sql(3)))
def q_expansion_model_v3(spark, sf):
    """Three pillars (+ mean amount), average ranks."""
    return MK.expansion_model(valid(spark, sf), 3, "average")


@register("rank_average", O.with_ctes(
    f"SELECT ship_state, {avg_rank_sql('revenue')} AS revenue_rank, "
    f"{avg_rank_sql('fulfillment_rate')} AS fulfillment_rank FROM ({state_base_sql()}) b"))
def q_rank_average(spark, sf):
    """Pandas-style average ranks (ties share the mean position)."""
    return MK.rank_states(valid(spark, sf), "average")


@register("rank_min", O.with_ctes(
    f"SELECT ship_state, {min_rank_sql('revenue')} AS revenue_rank, "
    f"{min_rank_sql('fulfillment_rate')} AS fulfillment_rank FROM ({state_base_sql()}) b"))
def q_rank_min(spark, sf):
    """SQL RANK() (ties share the minimum rank)."""
    return MK.rank_states(valid(spark, sf), "min")


def targets_sql(pillars=2):
    return O.with_ctes(
        "SELECT * FROM m WHERE revenue < (SELECT quantile_cont(CAST(revenue AS DOUBLE), 0.5) FROM m) "
        "AND fulfillment_rate > (SELECT AVG(fulfillment_rate) FROM m) "
        "ORDER BY fulfillment_rate DESC, ship_state LIMIT 10",
        extra=f"m AS ({model_sql(pillars)})")


@register("expansion_targets", targets_sql(2))
def q_expansion_targets(spark, sf):
    """Revenue < median and rate > mean rate; rate desc; first 10."""
    return MK.expansion_targets(valid(spark, sf), 2)


@register("expansion_targets_v3", targets_sql(3))
def q_expansion_targets_v3(spark, sf):
    """T3 over the three-pillar model."""
    return MK.expansion_targets(valid(spark, sf), 3)


TOP_SQL = f"SELECT * FROM ({REV_BY_STATE_SQL}) s ORDER BY revenue DESC, ship_state LIMIT {{k}}"


@register("top_states_k", O.with_ctes(TOP_SQL.format(k=5)))
def q_top_states_k(spark, sf):
    """The first 5 states by revenue."""
    return MK.top_states(valid(spark, sf), 5)


@register("last_12_months", O.with_ctes(
    f"SELECT * FROM ({MONTHLY_SQL}) t ORDER BY year_month DESC LIMIT 12"))
def q_last_12_months(spark, sf):
    """The last 12 months of the trend."""
    return MK.last_months(valid(spark, sf), 12)


@register("last_month", O.with_ctes(
    f"SELECT *, ROW_NUMBER() OVER (ORDER BY year_month DESC) AS month_pos FROM "
    f"(SELECT * FROM ({MONTHLY_SQL}) t ORDER BY year_month DESC LIMIT 2) l"))
def q_last_month(spark, sf):
    """Last month and the month before."""
    return MK.last_month(valid(spark, sf))


@register("name_list_k", O.with_ctes(
    f"SELECT string_agg(ship_state, ', ' ORDER BY revenue DESC, ship_state) AS names "
    f"FROM ({TOP_SQL.format(k=3)}) t"))
def q_name_list_k(spark, sf):
    """Names of the top 3 states joined by ', '."""
    return MK.name_list(K.revenue_by_state(valid(spark, sf)), "ship_state",
                        [F.desc("revenue"), F.asc("ship_state")], 3)


def quadrant_sql(k):
    return O.with_ctes(
        f"""SELECT t.*, CASE
  WHEN t.revenue > a.avg_rev AND t.fulfillment_rate >= r.rate THEN 'Star market'
  WHEN t.revenue > a.avg_rev AND t.fulfillment_rate < r.rate THEN 'Revenue leakage'
  WHEN t.revenue <= a.avg_rev AND t.fulfillment_rate >= r.rate THEN 'Expansion target'
  ELSE 'Low priority' END AS quadrant
FROM top t, (SELECT {R('SUM(revenue)', 'COUNT(revenue)')} AS avg_rev FROM top) a,
     (SELECT {P('SUM(is_fulfilled)', 'COUNT(*)')} AS rate FROM valid) r""",
        extra=f"top AS ({TOP_SQL.format(k=k)})")


@register("market_quadrant", quadrant_sql(25))
def q_market_quadrant(spark, sf):
    """R2: top 25 states classified against the overall rate and their mean revenue."""
    return MK.market_quadrant(valid(spark, sf), 25)


@register("market_quadrant_report", quadrant_sql(20))
def q_market_quadrant_report(spark, sf):
    """R2, report variant: top 20 states."""
    return MK.market_quadrant(valid(spark, sf), 20)


@register("state_bars", O.with_ctes(
    f"SELECT ship_state, revenue, fulfillment_rate, "
    f"CAST(ROW_NUMBER() OVER (ORDER BY revenue DESC, ship_state) <= 3 AS INT) AS is_top "
    f"FROM ({TOP_SQL.format(k=12)}) t"))
def q_state_bars(spark, sf):
    """Top 12 states with rate, first three flagged."""
    return MK.state_bars(valid(spark, sf), 12, 3)


# =============================================================================
# Insight rules (I1-I9, A36) and checks
# =============================================================================

from ordersight.functions.render import sql_fixed as F0_, sql_grouped0 as G0  # noqa: E402
from ordersight.operators import checks as CK  # noqa: E402
from ordersight.operators import insights as IN  # noqa: E402

from ordersight.functions.render import sql_fill  # noqa: E402


def F0(x):
    return F0_(x, 0)


def F1(x):
    return F0_(x, 1)


def _txt(rule, **parts):
    """title, detail, action, metric_value of a rule as SQL expressions."""
    t = IN.TEXT[rule]
    return [sql_fill(t[f], **parts) for f in ("title", "detail", "action", "metric")]


def _case(cond, a, b):
    return f"CASE WHEN {cond} THEN {a} ELSE {b} END"


KPI_CTES = f"""st AS ({REV_BY_STATE_SQL}),
sc AS ({SCALAR_SQL}),
tr AS ({MONTHLY_SQL}),
ct AS ({REV_BY_CAT_SQL}),
fm AS ({BY_METHOD_SQL}),
mdl AS ({model_sql(2)}),
tg AS (SELECT * FROM mdl WHERE revenue < (SELECT quantile_cont(CAST(revenue AS DOUBLE), 0.5) FROM mdl)
       AND fulfillment_rate > (SELECT AVG(fulfillment_rate) FROM mdl)
       ORDER BY fulfillment_rate DESC, ship_state LIMIT 10),
pf AS (SELECT * FROM st WHERE fulfillment_rate >= 95
       AND revenue <= (SELECT quantile_cont(CAST(revenue AS DOUBLE), 0.1) FROM st))"""

INS_COLS = "rule_id, rule_pos, impact, category, entity, metric, title, detail, action, metric_value"

_CONC = _txt("concentration", names="names", pct=F0("p"), n="'3'")
_MD = _txt("mom_drop", abs_mom=F1("abs(mom)"), mom=F1("mom"), month="year_month", revenue=G0("revenue"))
_MI = _txt("mom_dip", abs_mom=F1("abs(mom)"), mom=F1("mom"), month="year_month", revenue=G0("revenue"))
_MG = _txt("mom_growth", abs_mom=F1("abs(mom)"), mom=F1("mom"), month="year_month", revenue=G0("revenue"))
_LK = _txt("leakage", state="ship_state", revenue=G0("revenue"), rate=F1("fulfillment_rate"),
           avg_rate=F1("r"))
_EX = _txt("expansion", n="CAST(n AS VARCHAR)", state="top_state", rate=F1("top_rate"),
           revenue=G0("top_rev"), names="names")
_WC = _txt("weak_category", category="category", aov=G0("avg_order_value"), avg_aov=G0("a"),
           rate=F1("fulfillment_rate"), avg_rate=F1("r"))
_BG = _txt("b2b_growth", share=F1("s"))
_BP = _txt("b2b_protect", share=F1("s"))
_GP = _txt("method_gap", gap=F1("gap"), amazon=F1("amz"), merchant=F1("mer"))
_RF = _txt("riskfree", n="CAST(n AS VARCHAR)", names="names")
_TXT_COLS = ("title", "detail", "action", "metric_value")


def _cols(exprs):
    return ",\n  ".join(f"{e} AS {c}" for e, c in zip(exprs, _TXT_COLS))


def _mom_pick(i):
    return f"CASE WHEN mom < -10 THEN {_MD[i]} WHEN mom < -5 THEN {_MI[i]} ELSE {_MG[i]} END"


INS_SQL = {
    "ins_concentration": f"""SELECT 'ins_concentration' AS rule_id, 1 AS rule_pos, 'High' AS impact,
  'Revenue' AS category, names AS entity, p AS metric,
  {_cols(_CONC)}
FROM (SELECT {P('SUM(revenue)', '(SELECT SUM(revenue) FROM st)')} AS p,
             string_agg(ship_state, ', ' ORDER BY revenue DESC, ship_state) AS names
      FROM (SELECT * FROM st ORDER BY revenue DESC, ship_state LIMIT 3) t) x
WHERE p > 50""",
    "ins_mom_trend": f"""SELECT 'ins_mom_trend' AS rule_id, 2 AS rule_pos,
  CASE WHEN mom < -10 THEN 'High' WHEN mom < -5 THEN 'Medium' ELSE 'Low' END AS impact,
  CASE WHEN mom < -5 THEN 'Alert' ELSE 'Growth' END AS category, year_month AS entity, mom AS metric,
  {_cols([_mom_pick(i) for i in range(4)])}
FROM (SELECT year_month, revenue, revenue_mom_pct AS mom, COUNT(*) OVER () AS n
      FROM tr WHERE revenue_mom_pct IS NOT NULL ORDER BY year_month DESC LIMIT 1) l
WHERE n >= 2 AND (mom < -10 OR mom < -5 OR mom > 15)""",
    "ins_leakage": f"""SELECT 'ins_leakage' AS rule_id, 3 AS rule_pos, 'High' AS impact,
  'Fulfillment' AS category, ship_state AS entity, fulfillment_rate AS metric,
  {_cols(_LK)}
FROM st, (SELECT fulfillment_rate AS r FROM sc) s,
     (SELECT {R('SUM(revenue)', 'COUNT(revenue)')} AS m FROM st) a
WHERE revenue > m AND fulfillment_rate < r""",
    "ins_expansion": f"""SELECT 'ins_expansion' AS rule_id, 4 AS rule_pos, 'Medium' AS impact,
  'Expansion' AS category, top_state AS entity, CAST(n AS DOUBLE) AS metric,
  {_cols(_EX)}
FROM (SELECT COUNT(*) AS n FROM tg) c,
     (SELECT ship_state AS top_state, fulfillment_rate AS top_rate, revenue AS top_rev FROM tg
      ORDER BY fulfillment_rate DESC, ship_state LIMIT 1) t,
     (SELECT string_agg(ship_state, ', ' ORDER BY fulfillment_rate DESC, ship_state) AS names
      FROM (SELECT * FROM tg ORDER BY fulfillment_rate DESC, ship_state LIMIT 5) q) nm
WHERE n > 0""",
    "ins_weak_category": f"""SELECT 'ins_weak_category' AS rule_id, 5 AS rule_pos, 'Medium' AS impact,
  'Revenue' AS category, category AS entity, avg_order_value AS metric,
  {_cols(_WC)}
FROM ct, (SELECT AVG(avg_order_value) AS a, AVG(fulfillment_rate) AS r FROM ct) m
WHERE avg_order_value < a AND fulfillment_rate < r""",
    "ins_b2b": f"""SELECT 'ins_b2b' AS rule_id, 6 AS rule_pos,
  CASE WHEN s > 5 AND s < 30 THEN 'Medium' ELSE 'Low' END AS impact,
  CASE WHEN s > 5 AND s < 30 THEN 'Growth' ELSE 'Revenue' END AS category,
  CAST(NULL AS VARCHAR) AS entity, s AS metric,
  {_cols([_case('s > 5 AND s < 30', _BG[i], _BP[i]) for i in range(4)])}
FROM (SELECT b2b_revenue_share AS s FROM sc) x WHERE (s > 5 AND s < 30) OR s >= 30""",
    "ins_method_gap": f"""SELECT 'ins_method_gap' AS rule_id, 7 AS rule_pos, 'High' AS impact,
  'Fulfillment' AS category, CAST(NULL AS VARCHAR) AS entity, gap AS metric,
  {_cols(_GP)}
FROM (SELECT amz, mer, amz - mer AS gap FROM (
  SELECT COUNT(*) AS n,
    first(fulfillment_rate ORDER BY revenue DESC, fulfillment) FILTER (WHERE upper(fulfillment) = 'AMAZON') AS amz,
    first(fulfillment_rate ORDER BY revenue DESC, fulfillment) FILTER (WHERE upper(fulfillment) = 'MERCHANT') AS mer,
    COUNT(*) FILTER (WHERE upper(fulfillment) = 'AMAZON') AS n_amz,
    COUNT(*) FILTER (WHERE upper(fulfillment) = 'MERCHANT') AS n_mer
  FROM fm) y WHERE n >= 2 AND n_amz > 0 AND n_mer > 0) z
WHERE gap > 5""",
    "ins_riskfree": f"""SELECT 'ins_riskfree' AS rule_id, 8 AS rule_pos, 'Low' AS impact,
  'Expansion' AS category, names AS entity, CAST(n AS DOUBLE) AS metric,
  {_cols(_RF)}
FROM (SELECT COUNT(*) AS n FROM pf) c,
     (SELECT string_agg(ship_state, ', ' ORDER BY revenue DESC, ship_state) AS names
      FROM (SELECT * FROM pf ORDER BY revenue DESC, ship_state LIMIT 4) q) nm
WHERE n > 0""",
}

GEN_INS_SQL = " UNION ALL ".join(f"SELECT {INS_COLS} FROM ({s})" for s in INS_SQL.values())


def _ins(body, skewed=False):
    return O.with_ctes(body, skewed=skewed, extra=KPI_CTES)


def _insight_rule(name, df):
    """One rule over the KPI table it needs; tables that a rule names twice are
    written once. Only the leakage rule needs two tables, hence the bundle."""
    from ordersight.operators.bundle import kpi_bundle, materialize
    states = lambda: materialize(K.revenue_by_state(df), "states")
    one = {"ins_concentration": lambda: IN.ins_concentration(states()),
           "ins_mom_trend": lambda: IN.ins_mom_trend(K.monthly_trend(df)),
           "ins_leakage": lambda: _insight_rule_from_bundle(name, kpi_bundle(df)),
           "ins_expansion": lambda: IN.ins_expansion(materialize(MK.expansion_targets(df, 2), "targets")),
           "ins_weak_category": lambda: IN.ins_weak_category(K.revenue_by_category(df)),
           "ins_b2b": lambda: IN.ins_b2b(K.scalar_kpis(df)),
           "ins_method_gap": lambda: IN.ins_method_gap(K.by_fulfillment_method(df)),
           "ins_riskfree": lambda: IN.ins_riskfree(states())}
    return one[name]()


for _name, _body in INS_SQL.items():
    def _mk_rule(name):
        def q(spark, sf):
            return _insight_rule(name, valid(spark, sf))
        q.__doc__ = f"Insight rule {name} over the KPI tables of valid lines."
        return q
    register(_name, _ins(_body))(_mk_rule(_name))


@register("ins_concentration_skewed", _ins(INS_SQL["ins_concentration"], skewed=True))
def q_ins_concentration_skewed(spark, sf):
    """I1 on the five-zone view, where the top three hold most revenue."""
    return _insight_rule("ins_concentration", valid(spark, sf, skewed=True))


@register("generate_insights", _ins(GEN_INS_SQL))
def q_generate_insights(spark, sf):
    """All eight rules, ordered by impact."""
    return IN.generate_insights(valid(spark, sf))


@register("generate_insights_skewed", _ins(GEN_INS_SQL, skewed=True))
def q_generate_insights_skewed(spark, sf):
    """I9 on the five-zone view."""
    return IN.generate_insights(valid(spark, sf, skewed=True))


@register("insight_counts", _ins(
    "SELECT COUNT(*) AS insight_count, COUNT(*) FILTER (WHERE impact = 'High') AS high_count, "
    f"COUNT(*) - COUNT(*) FILTER (WHERE impact = 'Low') AS actions_prioritized FROM ({GEN_INS_SQL}) g"))
def q_insight_counts(spark, sf):
    """Insight total, High count, total minus Low."""
    return IN.insight_counts(IN.generate_insights(valid(spark, sf)))


CHK_COLS = "check_pos, type, severity, message, entity, value, drop_percent, states"
_NULLS = "CAST(NULL AS DOUBLE) AS drop_percent, CAST(NULL AS VARCHAR[]) AS states"

CHK_SQL = {
    "chk_category": f"""SELECT 1 AS check_pos, 'underperforming_category' AS type, 'high' AS severity,
  {sql_fill(CK.MESSAGES['underperforming_category'], category='category', revenue=F0('revenue'), avg=F0('av'))} AS message,
  category AS entity, CAST(revenue AS DOUBLE) AS value, {_NULLS}
FROM ct, (SELECT {R('SUM(revenue)', 'COUNT(revenue)')} AS av FROM ct) a WHERE revenue < av * 0.5""",
    "chk_weak_market": f"""SELECT 2 AS check_pos, 'weak_market' AS type, 'medium' AS severity,
  {sql_fill(CK.MESSAGES['weak_market'], state='ship_state', revenue=F0('revenue'))} AS message,
  ship_state AS entity, CAST(revenue AS DOUBLE) AS value, {_NULLS}
FROM st, (SELECT {R('SUM(revenue)', 'COUNT(revenue)')} AS av FROM st) a WHERE revenue < av * 0.3""",
    "chk_mom_drop": f"""SELECT 3 AS check_pos, 'mom_revenue_drop' AS type, 'critical' AS severity,
  {sql_fill(CK.MESSAGES['mom_revenue_drop'], drop=F1('dr'), prev='py', last='ly')} AS message,
  CAST(NULL AS VARCHAR) AS entity, CAST(NULL AS DOUBLE) AS value,
  CAST(round_even(CAST(dr AS DECIMAL(38,6)), 2) AS DOUBLE) AS drop_percent, CAST(NULL AS VARCHAR[]) AS states
FROM (SELECT *, (CAST(pr AS DOUBLE) - CAST(lr AS DOUBLE)) / CAST(pr AS DOUBLE) * 100 AS dr FROM (
  SELECT COUNT(*) AS n, arg_max(year_month, year_month) AS ly, arg_max(revenue, year_month) AS lr,
         arg_min(year_month, year_month) AS py, arg_min(revenue, year_month) AS pr
  FROM (SELECT * FROM tr ORDER BY year_month DESC LIMIT 2) l2) x) y
WHERE n >= 2 AND pr > 0 AND dr > 20""",
    "chk_low_rate": f"""SELECT 4 AS check_pos, 'low_fulfillment_rate' AS type, 'critical' AS severity,
  {sql_fill(CK.MESSAGES['low_fulfillment_rate'], rate=F1('r'))} AS message,
  CAST(NULL AS VARCHAR) AS entity, r AS value, {_NULLS}
FROM (SELECT COALESCE(fulfillment_rate, 100.0) AS r FROM sc) x WHERE r < 60""",
    "chk_expansion": f"""SELECT 5 AS check_pos, 'expansion_opportunity' AS type, 'low' AS severity,
  {sql_fill(CK.MESSAGES['expansion_opportunity'], n='CAST(n AS VARCHAR)')} AS message,
  CAST(NULL AS VARCHAR) AS entity, CAST(NULL AS DOUBLE) AS value, CAST(NULL AS DOUBLE) AS drop_percent,
  states
FROM (SELECT COUNT(*) AS n, list(ship_state ORDER BY fulfillment_rate DESC, ship_state) AS states FROM tg) x
WHERE n > 0""",
}

RUN_CHECKS_SQL = " UNION ALL ".join(f"SELECT {CHK_COLS} FROM ({s})" for s in CHK_SQL.values())


def _check(name, df):
    """One check over the KPI table it needs (written once if read twice)."""
    from ordersight.operators.bundle import materialize
    parts = {"chk_category": lambda: CK.chk_category(materialize(K.revenue_by_category(df), "categories")),
             "chk_weak_market": lambda: CK.chk_weak_market(materialize(K.revenue_by_state(df), "states")),
             "chk_mom_drop": lambda: CK.chk_mom_drop(K.monthly_trend(df)),
             "chk_low_rate": lambda: CK.chk_low_rate(K.scalar_kpis(df)),
             "chk_expansion": lambda: CK.chk_expansion(MK.expansion_targets(df, 2))}
    return parts[name]()


for _name, _body in CHK_SQL.items():
    def _mk_chk(name):
        def q(spark, sf):
            return _check(name, valid(spark, sf))
        q.__doc__ = f"Check {name} over the KPI tables of valid lines."
        return q
    register(_name, _ins(_body))(_mk_chk(_name))


@register("chk_weak_market_skewed", _ins(CHK_SQL["chk_weak_market"], skewed=True))
def q_chk_weak_market_skewed(spark, sf):
    """C2 on the five-zone view (one zone under 0.3 x mean)."""
    return _check("chk_weak_market", valid(spark, sf, skewed=True))


@register("run_checks", _ins(RUN_CHECKS_SQL))
def q_run_checks(spark, sf):
    """C1-C5 in order."""
    return CK.run_checks(valid(spark, sf))


@register("run_checks_skewed", _ins(RUN_CHECKS_SQL, skewed=True))
def q_run_checks_skewed(spark, sf):
    """C6 on the five-zone view."""
    return CK.run_checks(valid(spark, sf, skewed=True))


def _top_findings_sql(skewed=False):
    return _ins(f"""SELECT {CHK_COLS} FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY severity IN ('high', 'critical')
              ORDER BY check_pos, value DESC NULLS LAST, entity ASC NULLS FIRST) AS pos,
         MAX(CAST(severity IN ('high', 'critical') AS INT)) OVER () AS any_hi
  FROM ({RUN_CHECKS_SQL}) f) r
WHERE (any_hi = 1 AND severity IN ('high', 'critical') AND pos <= 5) OR (any_hi = 0 AND pos <= 5)""",
                skewed=skewed)


@register("top_findings", _top_findings_sql())
def q_top_findings(spark, sf):
    """First five high/critical findings (all findings when none is)."""
    from ordersight.operators.bundle import materialize
    return CK.top_findings(materialize(CK.run_checks(valid(spark, sf)), "findings"))


# =============================================================================
# Single-step cleaning operators (P1-P26), sources S3/S5/S6
# =============================================================================

from ordersight.functions import dates as D  # noqa: E402
from ordersight.functions import flags as FL  # noqa: E402
from ordersight.schema import LOAD_DEFAULTS, MAPPED_DEFAULTS  # noqa: E402
from ordersight.sources.star import raw_export_view  # noqa: E402

from ordersight.functions.text import sql_strip as SS  # noqa: E402


def _s(body, policy="exact"):
    return O.with_ctes(body, policy=policy)


def raw_canonical(spark, sf):
    """The text export with headers trimmed and renamed (all strings)."""
    return C.rename_canonical(C.trim_headers(raw_export_view(spark, sf)))


@register("clean_state", _s(f"SELECT order_id, ship_state AS raw_state, upper({SS('ship_state')}) AS ship_state FROM sales"))
def q_clean_state(spark, sf):
    """ship_state upper + Python-style strip."""
    return sales(spark, sf).select("order_id", F.col("ship_state").alias("raw_state"),
                                   C.clean_state().alias("ship_state"))


@register("clean_city", _s(f"SELECT order_id, ship_city AS raw_city, upper({SS('ship_city')}) AS ship_city FROM sales"))
def q_clean_city(spark, sf):
    """ship_city upper + strip."""
    return sales(spark, sf).select("order_id", F.col("ship_city").alias("raw_city"),
                                   C.clean_city().alias("ship_city"))


@register("clean_category_status", _s(
    f"SELECT order_id, {SS('category')} AS category, {SS('status')} AS status FROM sales"))
def q_clean_category_status(spark, sf):
    """Strip category and status (no upper)."""
    return sales(spark, sf).select("order_id", C.clean_text("category").alias("category"),
                                   C.clean_text("status").alias("status"))


RAWX = "SELECT order_id, strftime(order_date, '%m-%d-%y') AS date_text, CAST(amount AS VARCHAR) AS amount_text FROM sales"
ANY_FMTS = ["%m-%d-%y", "%m-%d-%y", "%Y-%m-%d", "%m-%d-%Y", "%m-%d-%Y", "%Y/%m/%d", "%m/%d/%Y",
            "%m/%d/%Y", "%m/%d/%y", "%m/%d/%y", "%d-%b-%y", "%d-%b-%Y", "%Y%m%d"]


@register("parse_date", _s(
    f"SELECT order_id, date_text, CAST(try_strptime(date_text, '%m-%d-%y') AS DATE) AS order_date FROM ({RAWX}) r"))
def q_parse_date(spark, sf):
    """Strict month-day-2-digit-year text -> date (bad -> null)."""
    r = raw_canonical(spark, sf)
    return r.select("order_id", F.col("order_date").alias("date_text"),
                    D.parse_date("order_date").alias("order_date"))


@register("parse_date_any", _s(
    "SELECT order_id, date_text, CAST(coalesce(" +
    ", ".join(f"try_strptime(date_text, '{f}')" for f in ANY_FMTS) +
    f") AS DATE) AS order_date FROM ({RAWX}) r"))
def q_parse_date_any(spark, sf):
    """P5: lenient date parse, first format that parses wins."""
    r = raw_canonical(spark, sf)
    return r.select("order_id", F.col("order_date").alias("date_text"),
                    D.parse_date_any("order_date").alias("order_date"))


@register("year_month", _s("SELECT order_id, order_date, strftime(order_date, '%Y-%m') AS year_month FROM sales"))
def q_year_month(spark, sf):
    """Yyyy-MM month label."""
    return sales(spark, sf).select("order_id", "order_date", D.year_month("order_date").alias("year_month"))


for _key, _policy, _doc in (("fulfilled_exact", "exact", "P7: stripped status in the exact set."),
                            ("fulfilled_regex", "regex", "P8: ship/deliver/complet/fulfil, any case."),
                            ("fulfilled_upper_in", "upper_in", "P9: UPPER(TRIM(status)) IN (...)."),
                            ("shipped_flag", "shipped_only", "P10: status = 'Shipped'."),
                            ("shipped_flag_bi", "bi", "P11: two values, no stripping.")):
    def _mk_flag(policy, doc):
        def q(spark, sf):
            return sales(spark, sf).select("order_id", "status",
                                           FL.fulfilled("status", policy).alias("is_fulfilled"))
        q.__doc__ = doc
        return q
    register(_key, _s(f"SELECT order_id, status, {O.fulfilled_sql('status', _policy)} AS is_fulfilled FROM sales"))(
        _mk_flag(_policy, _doc))


@register("b2b_int", _s(
    f"SELECT order_id, is_b2b_raw, CASE WHEN upper({SS('is_b2b_raw')}) IN ('TRUE', '1', 'YES') THEN 1 ELSE 0 END AS is_b2b FROM sales"))
def q_b2b_int(spark, sf):
    """Raw TRUE/1/YES -> 1 else 0."""
    return sales(spark, sf).select("order_id", "is_b2b_raw", FL.b2b_int("is_b2b_raw").alias("is_b2b"))


@register("b2b_label", _s(
    "SELECT order_id, is_b2b_raw, CASE WHEN upper(trim(is_b2b_raw)) IN ('TRUE', '1', 'YES', 'B2B') "
    "THEN 'B2B' ELSE 'B2C' END AS b2b_flag FROM sales"))
def q_b2b_label(spark, sf):
    """TRUE/1/YES/B2B -> 'B2B' else 'B2C'."""
    return sales(spark, sf).select("order_id", "is_b2b_raw", FL.b2b_label("is_b2b_raw").alias("b2b_flag"))


@register("coerce_amount", _s(
    f"SELECT order_id, amount_text, TRY_CAST({SS('amount_text')} AS DECIMAL(38,6)) AS amount FROM ({RAWX}) r"))
def q_coerce_amount(spark, sf):
    """Amount text -> decimal(38,6), bad -> null."""
    r = raw_canonical(spark, sf)
    return r.select("order_id", F.col("amount").alias("amount_text"),
                    FL.coerce_amount(r, "amount").alias("amount"))


@register("valid_amount_filter", _s("SELECT order_id, amount FROM sales WHERE amount > 0"))
def q_valid_amount_filter(spark, sf):
    """Keep amount > 0 (pushed into the scan)."""
    return C.valid_sales(sales(spark, sf)).select("order_id", "amount")


@register("amount_valid_flag", _s(
    "SELECT order_id, amount, CASE WHEN amount IS NULL OR amount <= 0 THEN 0 ELSE 1 END AS amount_valid FROM sales"))
def q_amount_valid_flag(spark, sf):
    """0 if null or <= 0 else 1, every row kept."""
    return sales(spark, sf).select("order_id", "amount", FL.amount_valid("amount").alias("amount_valid"))


@register("add_column_if_absent", _s(
    f"SELECT order_id, status, {O.fulfilled_sql('status', 'upper_in')} AS is_fulfilled FROM sales"))
def q_add_column_if_absent(spark, sf):
    """Add is_fulfilled when absent, then set it (UPDATE)."""
    s = C.add_column_if_absent(sales(spark, sf), "is_fulfilled", F.lit(None).cast("int"))
    return s.withColumn("is_fulfilled", FL.fulfilled("status", "upper_in")).select(
        "order_id", "status", "is_fulfilled")


@register("update_set", O.with_ctes(
    "SELECT order_id, ship_state, ship_city, is_fulfilled, amount_valid, b2b_flag FROM sqlt",
    extra=SQLT_CTE))
def q_update_set(spark, sf):
    """The cleaning UPDATEs as one projection into a new table."""
    return sql_table(spark, sf).select("order_id", "ship_state", "ship_city", "is_fulfilled",
                                       "amount_valid", "b2b_flag")


def _defaults_sql(defaults):
    cols = ", ".join(f"{v!r} AS {k}" if isinstance(v, str) else f"{v} AS {k}" for k, v in defaults.items())
    return _s(f"SELECT order_id, order_date, amount, {cols} FROM sales")


@register("default_missing", _defaults_sql(LOAD_DEFAULTS))
def q_default_missing(spark, sf):
    """A table with only id/date/amount gets the load defaults."""
    s = sales(spark, sf).select("order_id", "order_date", "amount")
    return C.default_missing(s)


@register("default_missing_mapped", _defaults_sql(MAPPED_DEFAULTS))
def q_default_missing_mapped(spark, sf):
    """P20: a mapped table with only id/date/amount gets the mapping defaults."""
    s = sales(spark, sf).select("order_id", "order_date", "amount")
    return C.default_missing_mapped(s)


@register("synthetic_order_id", _s(
    "SELECT ship_state, COUNT(*) AS lines, COUNT(*) AS distinct_ids, CAST(SUM(amount) AS DECIMAL(38,2)) AS amount "
    "FROM sales GROUP BY ship_state"))
def q_synthetic_order_id(spark, sf):
    """Lines without an order id get a unique synthetic id (not dense): per
    state as many distinct ids as lines."""
    s = C.synthetic_order_id(sales(spark, sf).drop("order_id"))
    return s.groupBy("ship_state").agg(F.count(F.lit(1)).alias("lines"), F.count_distinct("order_id").alias("distinct_ids"),
                                       F.sum("amount").cast("decimal(38,2)").alias("amount"))


@register("null_amount_rows", _s("SELECT order_id, amount FROM sales WHERE amount IS NULL"))
def q_null_amount_rows(spark, sf):
    """The lines with a null amount (first script's audit filter)."""
    return sales(spark, sf).filter(F.col("amount").isNull()).select("order_id", "amount")


@register("nan_to_null", O.with_ctes(MONTHLY_SQL))
def q_nan_to_null(spark, sf):
    """P25: NaN -> null in the floating columns of a KPI table (monthly trend)."""
    return C.nan_to_null(K.monthly_trend(valid(spark, sf)))


@register("drop_null_mom", O.with_ctes(f"SELECT * FROM ({MONTHLY_SQL}) m WHERE revenue_mom_pct IS NOT NULL"))
def q_drop_null_mom(spark, sf):
    """Drop trend rows without a MoM value."""
    return C.drop_null(K.monthly_trend(valid(spark, sf)), ["revenue_mom_pct"])


@register("rename_canonical", _s(
    "SELECT order_id, strftime(order_date, '%m-%d-%y') AS order_date, status, fulfillment, sales_channel, "
    "ship_service AS ship_service, style, sku, category, size, asin, courier_status, "
    "CAST(quantity AS VARCHAR) AS quantity, currency, CAST(amount AS VARCHAR) AS amount, ship_city, "
    "ship_state, ship_country AS \"ship-country\", is_b2b_raw, fulfillment_type FROM sales"))
def q_rename_canonical(spark, sf):
    """S2 + S3: trim headers, rename export headers to canonical names."""
    r = raw_canonical(spark, sf)
    return r.drop("index", "ship-postal-code", "promotion-ids", "Unnamed: 22")


@register("sales_ddl", O.with_ctes(
    "SELECT order_id, order_date, status, fulfillment, sales_channel, ship_service, style, sku, "
    "category, size, asin, courier_status, quantity, currency, amount, ship_city, ship_state, "
    "is_b2b_raw AS b2b_flag, 0 AS is_fulfilled, 1 AS amount_valid FROM sales"))
def q_sales_ddl(spark, sf):
    """The lines conformed to the 20-column table, flag defaults applied."""
    return C.conform_ddl_v2(sales(spark, sf))


LOAD_FROM_DF_SQL = f"""SELECT order_id, order_date, {SS('status')} AS status,
  upper({SS('ship_state')}) AS ship_state, upper({SS('ship_city')}) AS ship_city,
  {SS('category')} AS category, strftime(order_date, '%Y-%m') AS year_month,
  {O.fulfilled_sql(SS('status'), 'regex')} AS is_fulfilled, 0 AS is_b2b, amount
FROM sales WHERE amount > 0"""


@register("load_from_df", _s(LOAD_FROM_DF_SQL))
def q_load_from_df(spark, sf):
    """Lenient load of an already-loaded table (defaults, any date format,
    regex fulfillment, B2B 0, valid amounts)."""
    return C.load_from_df(sales(spark, sf)).select(
        "order_id", "order_date", "status", "ship_state", "ship_city", "category", "year_month",
        "is_fulfilled", "is_b2b", "amount")


# =============================================================================
# Workbook sheets
# =============================================================================

from ordersight.operators import bi as BI  # noqa: E402

BI_RATE = (f"CAST(SUM({O.fulfilled_sql('status', 'bi')}) AS DOUBLE) / CAST(COUNT(order_id) AS DOUBLE)")


@register("bi_fulfillment_rate", _s(f"SELECT ship_state, {BI_RATE} AS fulfillment_rate FROM sales GROUP BY ship_state"))
def q_bi_fulfillment_rate(spark, sf):
    """SUM(flag) / COUNT(order id) by raw state."""
    return BI.bi_fulfillment_rate(sales(spark, sf))


@register("bi_category_perf", _s(
    f"SELECT category, {M('SUM(amount)')} AS revenue, {BI_RATE} AS fulfillment_rate FROM sales GROUP BY category"))
def q_bi_category_perf(spark, sf):
    """Revenue and rate by category."""
    return BI.bi_category_perf(sales(spark, sf))


@register("bi_category_perf_channel", _s(
    f"SELECT category, {M('SUM(amount)')} AS revenue, {BI_RATE} AS fulfillment_rate FROM sales "
    f"WHERE sales_channel IN ('Amazon.in', 'Non-Amazon') GROUP BY category"))
def q_bi_category_perf_channel(spark, sf):
    """A31 second sheet with the P23 channel filter."""
    return BI.bi_category_perf(sales(spark, sf), channel_filter=True)


@register("filter_channel_in", _s(
    "SELECT order_id, sales_channel FROM sales WHERE sales_channel IN ('Amazon.in', 'Non-Amazon')"))
def q_filter_channel_in(spark, sf):
    """Channel member filter."""
    return BI.filter_channel_in(sales(spark, sf)).select("order_id", "sales_channel")


@register("filter_state_not_in", _s(
    "SELECT order_id, ship_state FROM sales WHERE ship_state IS NULL OR ship_state NOT IN ('Odisha')"))
def q_filter_state_not_in(spark, sf):
    """All members except 'Odisha' (nulls kept)."""
    return BI.filter_state_not_in(sales(spark, sf)).select("order_id", "ship_state")


@register("bi_efficiency", _s(f"""SELECT ship_state, {M('revenue')} AS revenue, order_count,
  {R('SUM(revenue) OVER ()', 'COUNT(revenue) OVER ()')} AS avg_revenue,
  {R('SUM(order_count) OVER ()', 'COUNT(order_count) OVER ()')} AS avg_order_count
FROM (SELECT ship_state, SUM(amount) AS revenue, COUNT(order_id) AS order_count FROM sales GROUP BY ship_state) p"""))
def q_bi_efficiency(spark, sf):
    """Per-state revenue and order count with table-wide averages."""
    return BI.bi_efficiency(sales(spark, sf))


@register("bi_fulfillment_quality", _s(f"""SELECT ship_state, fulfillment_rate, {M('revenue')} AS revenue,
  round(AVG(fulfillment_rate) OVER (), 9) AS avg_fulfillment_rate,
  {R('SUM(revenue) OVER ()', 'COUNT(revenue) OVER ()')} AS avg_revenue
FROM (SELECT ship_state, {BI_RATE} AS fulfillment_rate, SUM(amount) AS revenue FROM sales
      WHERE ship_state IS NULL OR ship_state NOT IN ('Odisha') GROUP BY ship_state) p"""))
def q_bi_fulfillment_quality(spark, sf):
    """Per-state rate and revenue with pane averages, 'Odisha' excluded."""
    return BI.bi_fulfillment_quality(sales(spark, sf))


@register("bi_revenue_by_state", _s(f"SELECT ship_state, {M('SUM(amount)')} AS revenue FROM sales GROUP BY ship_state"))
def q_bi_revenue_by_state(spark, sf):
    """Revenue by raw state."""
    return BI.bi_revenue_by_state(sales(spark, sf))


@register("bi_geo_drill", _s(f"""SELECT ship_country, ship_state, ship_city, {M('SUM(amount)')} AS revenue,
  COUNT(*) AS lines,
  CAST(3 - GROUPING(ship_country) - GROUPING(ship_state) - GROUPING(ship_city) AS INT) AS level
FROM sales GROUP BY ROLLUP (ship_country, ship_state, ship_city)"""))
def q_bi_geo_drill(spark, sf):
    """Country -> state -> city drill path as one ROLLUP."""
    return BI.bi_geo_drill(sales(spark, sf))


_ORDER_LIST = ", ".join("'" + m + "'" for m in BI.STATE_MEMBER_ORDER)


@register("manual_sort", _s(f"""SELECT ship_state, revenue,
  CAST(CASE WHEN list_position([{_ORDER_LIST}], ship_state) > 0 THEN list_position([{_ORDER_LIST}], ship_state)
       ELSE {len(BI.STATE_MEMBER_ORDER) + 1} END AS INT) AS sort_pos
FROM (SELECT ship_state, {M('SUM(amount)')} AS revenue FROM sales GROUP BY ship_state) p"""))
def q_manual_sort(spark, sf):
    """T5: states in the explicit member order (others after, by name)."""
    return BI.manual_sort(BI.bi_revenue_by_state(sales(spark, sf)), "ship_state")


@register("member_except", _s("SELECT DISTINCT ship_state FROM sales EXCEPT SELECT 'Odisha'"))
def q_member_except(spark, sf):
    """State members except the excluded member."""
    return BI.member_except(sales(spark, sf))


@register("member_union", _s(
    "SELECT DISTINCT sales_channel FROM sales WHERE sales_channel = 'Amazon.in' "
    "UNION SELECT DISTINCT sales_channel FROM sales WHERE sales_channel = 'Non-Amazon'"))
def q_member_union(spark, sf):
    """Union of two member selections (distinct)."""
    s = sales(spark, sf).select("sales_channel")
    return (s.filter(F.col("sales_channel") == "Amazon.in")
             .union(s.filter(F.col("sales_channel") == "Non-Amazon")).distinct())


# =============================================================================
# Report data sets and JSON boundary
# =============================================================================

from ordersight.operators import report as RP  # noqa: E402


@register("rate_status", O.with_ctes(
    f"SELECT fulfillment_rate, CASE WHEN fulfillment_rate >= 85 THEN 'On Target' ELSE 'Below Target' END "
    f"AS rate_status FROM ({SCALAR_SQL}) s"))
def q_rate_status(spark, sf):
    """Overall rate against the 85 % target."""
    return RP.rate_status(K.scalar_kpis(valid(spark, sf)))


@register("run_summary", _ins(
    f"SELECT total_orders, total_revenue, (SELECT COUNT(*) FROM ({GEN_INS_SQL}) g) AS insight_count, "
    f"(SELECT COUNT(*) FROM valid) AS total_rows, fulfillment_rate FROM sc"))
def q_run_summary(spark, sf):
    """Orders, revenue, insight count, rows, rate for one run."""
    return RP.run_summary(valid(spark, sf))


@register("export_json", O.with_ctes(
    f"SELECT to_json(struct_pack(ship_state := ship_state, revenue := revenue, orders := orders, "
    f"fulfillment_rate := fulfillment_rate, revenue_share_pct := revenue_share_pct))::VARCHAR AS record "
    f"FROM ({REV_BY_STATE_SQL}) s"))
def q_export_json(spark, sf):
    """K4: revenue by state as JSON records."""
    return RP.export_json(K.revenue_by_state(valid(spark, sf)))


EXPORT_INS_SQL = (f"SELECT to_json(struct_pack(title := title, detail := detail, impact := impact, "
                  f"action := action, category := category, metric_value := metric_value))::VARCHAR AS record "
                  f"FROM ({GEN_INS_SQL}) g")


@register("export_insights_json", _ins(EXPORT_INS_SQL))
def q_export_insights_json(spark, sf):
    """K5: insights as JSON records."""
    return RP.export_insights_json(IN.generate_insights(valid(spark, sf)))


@register("table_counts", _ins(
    f"SELECT 'cleaned_orders' AS table_name, (SELECT COUNT(*) FROM valid) AS row_count "
    f"UNION ALL SELECT 'revenue_by_state', (SELECT COUNT(*) FROM st) "
    f"UNION ALL SELECT 'revenue_by_category', (SELECT COUNT(*) FROM ct) "
    f"UNION ALL SELECT 'monthly_trend', (SELECT COUNT(*) FROM tr) "
    f"UNION ALL SELECT 'insights', (SELECT COUNT(*) FROM ({GEN_INS_SQL}) g) "
    f"UNION ALL SELECT 'findings', (SELECT COUNT(*) FROM ({RUN_CHECKS_SQL}) c)"))
def q_table_counts(spark, sf):
    """K6: row counts of the tables one run produces."""
    from ordersight.operators.bundle import kpi_bundle
    v = valid(spark, sf)
    b = kpi_bundle(v)
    return RP.table_counts({
        "revenue_by_state": b.states,
        "revenue_by_category": b.categories, "monthly_trend": b.months,
        "insights": IN.generate_insights(v, bundle=b), "findings": CK.run_checks(v, bundle=b)},
        counted={"cleaned_orders": b.totals})


@register("parse_insight_json", _ins(
    f"SELECT title, detail, impact, action, category, metric_value FROM ({GEN_INS_SQL}) g"))
def q_parse_insight_json(spark, sf):
    """K9: fenced JSON array text (one per insight record) -> INSIGHT rows."""
    recs = RP.export_insights_json(IN.generate_insights(valid(spark, sf)))
    texts = recs.select(F.concat(F.lit("```json\n["), F.col("record"), F.lit("]\n```")).alias("text"))
    return RP.parse_insight_json(texts)


# =============================================================================
# File sources (S1-S4, S7), streaming (ST1) and records (K7)
# =============================================================================

import uuid as _uuid  # noqa: E402

from ordersight.operators import records as RC  # noqa: E402
from ordersight.session import scratch_path  # noqa: E402
from ordersight.sources import files as FS  # noqa: E402
from ordersight.sources.star import read_table, table_bytes  # noqa: E402
from ordersight.streaming import watch as WT  # noqa: E402

_CSV_DIRS: dict = {}


def csv_export_dir(spark, sf, by_order=False):
    """The raw export of ``sf`` written once per application as CSV (``by_order``: a
    file for each shuffle partition, every order's lines in one file)."""
    key = (spark.sparkContext.applicationId, sf, by_order)
    if key not in _CSV_DIRS:
        path = scratch_path(spark, f"csv-export-{_uuid.uuid4().hex[:8]}")
        files = max(int(spark.conf.get("spark.sql.shuffle.partitions")),
                    int(spark.conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum", "1")))
        FS.write_csv_export(raw_export_view(spark, sf), path, *((files, "Order ID") if by_order else ()))
        _CSV_DIRS[key] = path
    return _CSV_DIRS[key]


@register("scan_csv", O.with_ctes(REV_BY_STATE_SQL))
def q_scan_csv(spark, sf):
    """S1-S3 end to end: CSV export (text) -> headers trimmed and renamed ->
    cleaned (dates and amounts parsed) -> revenue by state."""
    lines = FS.scan_csv(spark, csv_export_dir(spark, sf))
    return K.revenue_by_state(C.load_clean(lines))


@register("load_infile", O.with_ctes(
    "SELECT order_id, order_date, status, fulfillment, sales_channel, ship_service, style, sku, "
    "category, size, asin, courier_status, quantity, currency, amount, ship_city, ship_state, "
    "is_b2b_raw AS b2b_flag, 0 AS is_fulfilled, 1 AS amount_valid FROM sales"))
def q_load_infile(spark, sf):
    """Positional bulk load of the CSV into the 20-column table."""
    return FS.load_infile(spark, csv_export_dir(spark, sf))


@register("scan_text_schema", O.with_ctes(
    'SELECT order_id AS "Order ID", status AS "Status", ship_state AS "ship-state", '
    'quantity AS "Qty", CAST(amount AS DOUBLE) AS "Amount" FROM sales'))
def q_scan_text_schema(spark, sf):
    """The typed 24-column text scan (projected to five columns)."""
    return FS.scan_text_schema(spark, csv_export_dir(spark, sf)).select(
        "Order ID", "Status", "ship-state", "Qty", "Amount")


@register("watch_csv_dir", O.with_ctes(REV_BY_STATE_SQL))
def q_watch_csv_dir(spark, sf):
    """ST1: a CSV export of many files arrives in a watched folder; the streaming
    job (availableNow) writes revenue by state per source file; the result is the
    files' tables put together."""
    out = scratch_path(spark, f"watch-out-{_uuid.uuid4().hex[:8]}")
    ckpt = scratch_path(spark, f"watch-ckpt-{_uuid.uuid4().hex[:8]}")
    q = WT.watch_csv_dir(spark, csv_export_dir(spark, sf, by_order=True), out, ckpt)
    q.awaitTermination()
    return WT.over_files(spark.read.parquet(out))


def _mixed_export(spark, sf):
    """The raw export as one folder of files with three column orders, one column more or
    less, and quoted line breaks and quotes in an address that no KPI reads."""
    path = scratch_path(spark, f"csv-mixed-{_uuid.uuid4().hex[:8]}")
    raw = raw_export_view(spark, sf).drop("index", "Unnamed: 22")
    note = F.concat(F.lit('line one, "'), F.col("ship-city"), F.lit('"\n\n'), F.col("SKU"), F.lit(',\r\nend"'))
    layouts = [raw.select(*reversed(raw.columns)), raw.withColumn("Note", note).select("Note", *raw.columns),
               raw.drop("promotion-ids").withColumn("ship-address", note)]
    key = F.pmod(F.xxhash64("SKU", "Qty", "Amount"), F.lit(3))
    for k, layout in enumerate(layouts):
        FS.write_csv_export(layout.where(key == k), f"{path}/{k}")
    return path


@register("scan_csv_layouts", O.with_ctes(REV_BY_STATE_SQL))
def q_scan_csv_layouts(spark, sf):
    """S1-S3 over files of differing headers and quoted line breaks: the same table."""
    path = _mixed_export(spark, sf)
    return K.revenue_by_state(C.load_clean(FS.scan_csv(spark, [f"{path}/{k}" for k in range(3)])))


@register("scan_csv_breaks", O.with_ctes(
    "SELECT sku, COUNT(*) AS n_lines, SUM(CASE WHEN has THEN 1 ELSE 0 END) AS n_notes, "
    "MIN(CASE WHEN has THEN concat('line one, \"', ship_city, '\"', chr(10), chr(10), sku, ',', chr(13), chr(10), 'end\"') END) AS least_note FROM kept GROUP BY sku",
    extra="kept AS (SELECT *, ship_city <> '' AS has FROM sales)"))
def q_scan_csv_breaks(spark, sf):
    """S1 with quoted line breaks in every record: the multi-line field comes back as it was written."""
    path = scratch_path(spark, f"csv-breaks-{_uuid.uuid4().hex[:8]}")
    raw = raw_export_view(spark, sf)
    note = F.concat(F.lit('line one, "'), F.col("ship-city"), F.lit('"\n\n'), F.col("SKU"), F.lit(',\r\nend"'))
    FS.write_csv_export(raw.withColumn("Note", note), path)
    lines = FS.scan_csv(spark, path)
    return lines.groupBy("sku").agg(F.count(F.lit(1)).alias("n_lines"), F.count("Note").alias("n_notes"), F.min("Note").alias("least_note"))


_SLICE_BYTES = 1 << 30


def _export_units(spark, sf, key, parts):
    """The raw export as ``parts`` folders of CSV files, dealt by ``key``, in a slice of the
    orders for each GB of order lines (that is what the joins' shuffles take disk for at once)."""
    path = scratch_path(spark, f"csv-units-{_uuid.uuid4().hex[:8]}")
    slices = 1 + table_bytes(spark, sf, "lineitem") // _SLICE_BYTES
    return FS.deal_csv_export(raw_export_view(spark, sf), path, key, parts, F.col("Order ID"), slices)


_JOB_TABLES = {"revenue_by_state": "ship_state", "revenue_by_category": "category", "monthly_trend": "year_month",
               "fulfillment_by_state": "ship_state", "b2b_vs_b2c": "is_b2b", "by_channel": "sales_channel",
               "by_fulfillment_method": "fulfillment"}


@register("watch_kpi_job", O.with_ctes("\nUNION ALL ".join(
    [f"SELECT job, '{t}' AS kpi_table, COUNT(DISTINCT {d}) AS n_rows, {M('SUM(amount)')} AS revenue FROM of_job GROUP BY job" for t, d in _JOB_TABLES.items()]
    + [f"SELECT job, 'scalar_kpis' AS kpi_table, CAST(1 AS BIGINT) AS n_rows, {M('SUM(amount)')} AS revenue FROM of_job GROUP BY job"]),
    extra="of_job AS (SELECT *, concat('unit-', CAST(CAST(order_id AS BIGINT) % 2 AS VARCHAR)) AS job FROM valid)"))
def q_watch_kpi_job(spark, sf):
    """ST1: the whole KPI job for every arriving export (a folder of CSV files): ten
    tables, insights and findings each, by the stream; revenue and rows of the tables."""
    from ordersight.sources.jobs import JobStore
    from ordersight.streaming import arrivals as AR
    src = _export_units(spark, sf, F.col("Order ID").cast("long"), 2)
    out, ckpt = (scratch_path(spark, f"{n}-{_uuid.uuid4().hex[:8]}") for n in ("jobs", "jobs-ckpt"))
    AR.watch(spark, src, out, ckpt, unit="folder").awaitTermination()
    store = JobStore(spark, out)
    parts = [store.read_all(t).groupBy(F.col("job_id").alias("job")).agg(F.lit(t).alias("kpi_table"), F.count(F.lit(1)).alias("n_rows"),
                                                                        F.sum("revenue").cast("decimal(38,2)").alias("revenue")) for t in _JOB_TABLES]
    parts.append(store.read_all("scalar_kpis").select(F.col("job_id").alias("job"), F.lit("scalar_kpis").alias("kpi_table"), F.lit(1).cast("long").alias("n_rows"),
                                                      F.col("total_revenue").alias("revenue")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _refreshed(spark, sf):
    """Three exports taken in by two refreshes: two of them first, one only in part, then the third and the whole of that one."""
    from ordersight.streaming import refresh as RF
    src = _export_units(spark, sf, F.xxhash64("SKU"), 3)
    out = scratch_path(spark, f"refresh-{_uuid.uuid4().hex[:8]}")
    arrived = scratch_path(spark, f"refresh-in-{_uuid.uuid4().hex[:8]}")

    def arrive(k):
        FS.move_export(spark, f"{src}/unit-{k}", f"{arrived}/unit-{k}")
    arrive(0)
    part = spark.read.option("header", True).option("escape", '"').csv(f"{src}/unit-1").where("Qty % 2 = 0")
    FS.write_csv_export(part, f"{arrived}/unit-1", compressed=True)
    RF.refresh(spark, arrived, out, "folder")
    arrive(1)
    arrive(2)
    RF.refresh(spark, arrived, out, "folder")
    return RF.refreshed(spark, out)


@register("periodic_refresh", O.with_ctes(REV_BY_STATE_SQL))
def q_periodic_refresh(spark, sf):
    """ST2: revenue by state after two incremental refreshes (orders go over the units,
    one unit is rewritten in between) equals the batch result."""
    return _refreshed(spark, sf).states


@register("periodic_refresh_scalars", O.with_ctes(SCALAR_SQL))
def q_periodic_refresh_scalars(spark, sf):
    """ST2: the scalar KPIs after the same refreshes."""
    return _refreshed(spark, sf).scalars


@register("upsert_status", """SELECT user_id, event_type AS status, ts AS updated_at, event_id
FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn
      FROM events) e WHERE rn = 1""")
def q_upsert_status(spark, sf):
    """K7: last-write-wins status per key (latest event per user)."""
    return RC.upsert_status(read_table(spark, sf, "events"))


# =============================================================================
# Remaining primitives: S2, J2-J4, T4, U1, sinks K1-K3
# =============================================================================

from ordersight.sources import sinks as SK  # noqa: E402


@register("trim_headers", _s('SELECT order_id AS "Order ID", sales_channel AS "Sales Channel" FROM sales'))
def q_trim_headers(spark, sf):
    """Headers blank-stripped ("Sales Channel " -> "Sales Channel")."""
    return C.trim_headers(raw_export_view(spark, sf)).select("Order ID", "Sales Channel")


@register("share_scalar_subquery", O.with_ctes(
    f"SELECT ship_state, {M('SUM(amount)')} AS revenue, "
    f"{P('SUM(amount)', '(SELECT SUM(amount) FROM valid)')} AS revenue_share_pct FROM valid GROUP BY ship_state"))
def q_share_scalar_subquery(spark, sf):
    """Each state's revenue / the whole table's total x 100 (the total summed over the states: one scan)."""
    per = valid(spark, sf).groupBy("ship_state").agg(F.sum("amount").alias("r"))
    return K.share_of_total(per, "r").select("ship_state", F.col("r").cast("decimal(38,2)").alias("revenue"), "revenue_share_pct")


@register("scalar_threshold_join", O.with_ctes(
    f"SELECT ship_state, revenue, m AS mean_state_revenue FROM ({REV_BY_STATE_SQL}) s, "
    f"(SELECT {R('SUM(revenue)', 'COUNT(revenue)')} AS m FROM ({REV_BY_STATE_SQL}) t) a WHERE revenue > m"))
def q_scalar_threshold_join(spark, sf):
    """States whose revenue is above the mean state revenue (row vs a
    whole-table scalar)."""
    st = K.revenue_by_state(valid(spark, sf)).withColumn(
        "mean_state_revenue", K.exact_mean_over("revenue"))
    return st.filter(F.col("revenue") > F.col("mean_state_revenue")).select(
        "ship_state", "revenue", "mean_state_revenue")


@register("method_pair", O.with_ctes(
    "SELECT max(CASE WHEN upper(fulfillment) = 'AMAZON' THEN fulfillment_rate END) AS amazon_rate, "
    "max(CASE WHEN upper(fulfillment) = 'MERCHANT' THEN fulfillment_rate END) AS merchant_rate "
    f"FROM ({BY_METHOD_SQL}) m"))
def q_method_pair(spark, sf):
    """The Amazon row and the Merchant row of one table side by side."""
    m = K.by_fulfillment_method(valid(spark, sf))
    up = F.upper("fulfillment")
    return m.agg(F.max(F.when(up == "AMAZON", F.col("fulfillment_rate"))).alias("amazon_rate"),
                 F.max(F.when(up == "MERCHANT", F.col("fulfillment_rate"))).alias("merchant_rate"))


@register("sort_by_impact", _ins(
    f"SELECT rule_id, entity, impact, CASE impact WHEN 'High' THEN 0 WHEN 'Medium' THEN 1 "
    f"WHEN 'Low' THEN 2 ELSE 3 END AS impact_rank FROM ({GEN_INS_SQL}) g"))
def q_sort_by_impact(spark, sf):
    """T4: insights with their impact order (High, Medium, Low, other)."""
    return IN.generate_insights(valid(spark, sf)).select(
        "rule_id", "entity", "impact", IN.impact_rank().alias("impact_rank"))


@register("insights_union", _ins(GEN_INS_SQL))
def q_insights_union(spark, sf):
    """The eight rule outputs concatenated (union by name)."""
    v = valid(spark, sf)
    from ordersight.operators.bundle import kpi_bundle
    b = kpi_bundle(v)
    parts = [_insight_rule_from_bundle(n, b) for n in INS_SQL]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _insight_rule_from_bundle(name, b):
    if name == "ins_concentration":
        return IN.ins_concentration(b.states)
    if name == "ins_mom_trend":
        return IN.ins_mom_trend(b.months)
    if name == "ins_leakage":
        return IN.ins_leakage(b.states, b.scalars.select("fulfillment_rate").scalar())
    if name == "ins_expansion":
        return IN.ins_expansion(b.targets)
    if name == "ins_weak_category":
        return IN.ins_weak_category(b.categories)
    if name == "ins_b2b":
        return IN.ins_b2b(b.scalars)
    if name == "ins_method_gap":
        return IN.ins_method_gap(b.methods)
    return IN.ins_riskfree(b.states)


def _job_id(sf):
    """The job id the registered sink queries store under."""
    return "job-1"


@register("sink_kpis", O.with_ctes(f"SELECT *, 'job-1' AS job_id FROM ({REV_BY_STATE_SQL}) s"))
def q_sink_kpis(spark, sf):
    """K2: the run's whole KPI record (scalars and nine tables, from one bundle)
    stored per job, then the job's revenue-by-state partition read back."""
    from ordersight.operators.bundle import kpi_bundle
    path = scratch_path(spark, f"kpis-{_uuid.uuid4().hex[:8]}")
    SK.sink_kpis(kpi_bundle(valid(spark, sf)).record(), path, _job_id(sf))
    return SK.read_job(spark, f"{path}/revenue_by_state", _job_id(sf))


@register("sink_insights", _ins(f"SELECT *, 'job-1' AS job_id FROM ({RUN_CHECKS_SQL}) c"))
def q_sink_insights(spark, sf):
    """K3: a job's findings stored in its partition, then read back."""
    path = scratch_path(spark, f"findings-{_uuid.uuid4().hex[:8]}")
    SK.sink_insights(CK.run_checks(valid(spark, sf)), path, _job_id(sf))
    return SK.read_job(spark, path, _job_id(sf))


_SUMMARY_COLUMNS = ["order_id", "order_date", "status", "fulfillment", "sales_channel", "ship_service", "style", "sku", "category", "size", "asin",
                    "courier_status", "quantity", "currency", "amount", "ship_city", "ship_state", "ship_country", "is_b2b_raw", "fulfillment_type",
                    "year_month", "is_fulfilled", "is_b2b", "amount_valid"]


@register("sink_clean_summary", O.with_ctes(f"""SELECT (SELECT COUNT(*) FROM valid) AS total_rows, '{",".join(_SUMMARY_COLUMNS)}' AS columns,
  rn - 1 AS place, order_id, sku, ship_state, amount, CAST(order_date AS VARCHAR) AS order_date, 'job-1' AS job_id
FROM (SELECT *, ROW_NUMBER() OVER (ORDER BY {", ".join(f"{c} NULLS FIRST" for c in _SUMMARY_COLUMNS)}) AS rn FROM valid) v WHERE rn <= 10"""))
def q_sink_clean_summary(spark, sf):
    """K1: per job total rows, column list and a 10-row sample, stored in the
    job's partition and read back; the sample's rows one by one."""
    path = scratch_path(spark, f"clean-summary-{_uuid.uuid4().hex[:8]}")
    SK.sink_clean_summary(valid(spark, sf), path, _job_id(sf))
    got = SK.read_job(spark, path, _job_id(sf)).select("total_rows", F.array_join("columns", ",").alias("columns"), F.posexplode("sample_rows").alias("place", "row"), "job_id")
    return got.select("total_rows", "columns", F.col("place").cast("long").alias("place"), *[
        F.get_json_object("row", f"$.{c}").cast(t).alias(c) for c, t in (
            ("order_id", "string"), ("sku", "string"), ("ship_state", "string"), ("amount", "decimal(12,2)"), ("order_date", "string"))], "job_id")


# =============================================================================
# Customer grain: a high-cardinality market dimension
# =============================================================================

from ordersight.sources.star import customer_sales_view  # noqa: E402

CUST_CTES = (f"WITH cs AS ({O.customer_sales_sql()}),\n"
             f"cv AS (SELECT order_id, order_date, {O.sql_strip('status')} AS status, "
             f"upper({O.sql_strip('ship_state')}) AS ship_state, amount, "
             f"{O.fulfilled_sql('status')} AS is_fulfilled FROM cs WHERE amount > 0),\n"
             f"st AS ({REV_BY_STATE_SQL.replace('FROM valid', 'FROM cv')})\n")


@register("chk_weak_market_customers", CUST_CTES + CHK_SQL["chk_weak_market"])
def q_chk_weak_market_customers(spark, sf):
    """C2 at customer grain (customer key as the market, discounted price as
    the amount): many groups, uneven revenue. The grouped rows are written once;
    the mean is a one-row subquery over them, no window over all customers."""
    from ordersight.operators.bundle import materialize
    v = C.load_clean(customer_sales_view(spark, sf))
    per = v.groupBy("ship_state").agg(F.sum("amount").cast(K.MONEY).alias("revenue"))
    return CK.chk_weak_market(materialize(per, "customer-revenue"))


def _customer_states(spark, sf):
    """Revenue and rate per customer key, written once."""
    from ordersight.operators.bundle import materialize
    v = C.load_clean(customer_sales_view(spark, sf))
    return materialize(K.kpi_by(v, "ship_state", ["revenue", "orders", "fulfillment_rate"]), "customer-states")


@register("ins_riskfree_customers", CUST_CTES.rstrip("\n") + f""",
pf AS (SELECT * FROM st WHERE fulfillment_rate >= 40
       AND revenue <= (SELECT quantile_cont(CAST(revenue AS DOUBLE), 0.1) FROM st))
{INS_SQL["ins_riskfree"]}""")
def q_ins_riskfree_customers(spark, sf):
    """I8 at customer grain with a rate threshold of 40, where it fires; the
    quantile is found by ranges of revenue."""
    from ordersight.functions.stats import distributed_percentile
    cfg = IN.InsightConfig(riskfree_rate=40.0)
    states = _customer_states(spark, sf)
    return IN.ins_riskfree(states, cfg, distributed_percentile(states, "revenue", cfg.riskfree_quantile))


@register("chk_category_customers", CUST_CTES.rstrip("\n") + f""",
ct AS (SELECT ship_state AS category, revenue FROM st)
{CHK_SQL["chk_category"]}""")
def q_chk_category_customers(spark, sf):
    """C1 with the customer key as the category, where it fires."""
    return CK.chk_category(_customer_states(spark, sf).withColumnRenamed("ship_state", "category"))


@register("rank_average_customers", CUST_CTES.replace("st AS (", "st0 AS (").rstrip("\n")
          + f",\nst AS (SELECT ship_state, revenue FROM st0)\n"
          f"SELECT ship_state, revenue, {avg_rank_sql('revenue')} AS revenue_rank FROM st")
def q_rank_average_customers(spark, sf):
    """W2 at customer grain with the distributed rank (no single-partition
    window): pandas-style average rank of customer revenue."""
    from ordersight.functions.stats import distributed_rank
    v = C.load_clean(customer_sales_view(spark, sf))
    st = K.revenue_by_state(v).select("ship_state", "revenue")
    return distributed_rank(st, "revenue", "average", out="revenue_rank")


@register("expansion_model_customers", CUST_CTES.rstrip("\n") + f""",
b AS (SELECT ship_state, COUNT(DISTINCT order_id) AS total_orders, CAST(SUM(is_fulfilled) AS BIGINT) AS fulfilled, {M('SUM(amount)')} AS revenue,
  {P('SUM(is_fulfilled)', 'COUNT(DISTINCT order_id)')} AS fulfillment_rate, {R('SUM(amount)', 'COUNT(amount)')} AS avg_order_value FROM cv GROUP BY ship_state)
SELECT *, revenue_rank + fulfillment_rank + aov_rank AS composite_score FROM (
  SELECT *, {avg_rank_sql('revenue')} AS revenue_rank, {avg_rank_sql('fulfillment_rate')} AS fulfillment_rank,
         {avg_rank_sql('avg_order_value')} AS aov_rank FROM b) r""")
def q_expansion_model_customers(spark, sf):
    """W8 at customer grain: three pillars ranked in one pass, no one-task window."""
    from ordersight.operators.bundle import materialize
    v = C.load_clean(customer_sales_view(spark, sf))
    return MK.expansion_model_at_any_grain(materialize(MK.market_totals(v), "customer-totals"), 3)


@register("market_model_customers", CUST_CTES.rstrip("\n") + f""",
b AS (SELECT ship_state, COUNT(DISTINCT order_id) AS total_orders, CAST(SUM(is_fulfilled) AS BIGINT) AS fulfilled, {M('SUM(amount)')} AS revenue,
  {P('SUM(is_fulfilled)', 'COUNT(DISTINCT order_id)')} AS fulfillment_rate, {R('SUM(amount)', 'COUNT(amount)')} AS avg_order_value FROM cv GROUP BY ship_state)
SELECT *, revenue_rank + fulfillment_rank AS composite_score FROM (
  SELECT *, {min_rank_sql('revenue')} AS revenue_rank, {min_rank_sql('fulfillment_rate')} AS fulfillment_rank FROM b) r""")
def q_market_model_customers(spark, sf):
    """W5 / W6's SQL ranks at customer grain, two pillars."""
    from ordersight.operators.bundle import materialize
    v = C.load_clean(customer_sales_view(spark, sf))
    return MK.expansion_model_at_any_grain(materialize(MK.market_totals(v), "customer-totals"), 2, "min")


@register("approximate_orders", O.with_ctes("\nUNION ALL ".join(
    f"SELECT '{d}' AS dimension, CAST({d} AS VARCHAR) AS key, COUNT(DISTINCT order_id) AS orders, TRUE AS within FROM valid GROUP BY {d}"
    for d in ("ship_state", "category", "year_month", "fulfillment", "sales_channel", "is_b2b"))
    + "\nUNION ALL SELECT 'all', CAST(NULL AS VARCHAR), COUNT(DISTINCT order_id), TRUE FROM valid"))
def q_approximate_orders(spark, sf):
    """A2 by sketches over the whole cube, beside the exact counts: within 5 % (six
    standard errors) or two orders."""
    from ordersight.operators import bundle as BD
    v = valid(spark, sf)
    exact = BD.order_counts(v)
    near = BD.approximate_orders(v).select(F.col("gid").alias("_gid"), F.col("key").alias("_key"), F.col("orders").alias("near"))
    both = exact.join(near, (F.col("gid") == F.col("_gid")) & F.col("key").eqNullSafe(F.col("_key")), "left")
    names = F.create_map(*[F.lit(x) for d in [*BD.DIMS, None] for x in (BD._gid(d, BD.DIMS), d or "all")])
    error = F.abs(F.col("near") - F.col("orders"))
    return both.select(F.element_at(names, F.col("gid")).alias("dimension"), "key", "orders",
                       F.coalesce((error <= 2) | (error <= 0.05 * F.col("orders")), F.lit(False)).alias("within"))


_EVIDENCE = [("MM-dd-yyyy", "%m-%d-%Y"), ("dd-MM-yyyy", "%d-%m-%Y"), ("yyyy-MM-dd", "%Y-%m-%d")]


@register("infer_date_format", O.with_ctes("SELECT *, parsed = max(parsed) OVER () AS chosen, FALSE AS ambiguous FROM (" + "\nUNION ALL ".join(
    f"SELECT '{f}' AS format, COUNT(try_strptime(t, '{py}')) AS parsed, COUNT(*) AS total FROM text" for f, py in _EVIDENCE) + ") e",
    extra="text AS (SELECT strftime(order_date, '%d-%m-%Y') AS t FROM sales WHERE order_date IS NOT NULL)"))
def q_infer_date_format(spark, sf):
    """P5 for a whole column: day-first dates are told from month-first ones by the values."""
    text = sales(spark, sf).where("order_date is not null").select(F.date_format("order_date", "dd-MM-yyyy").alias("t"))
    return D.date_format_evidence(text, "t", tuple(f for f, _ in _EVIDENCE)).drop("place")


@register("sink_kpis_all", O.with_ctes("\nUNION ALL ".join(
    [f"SELECT '{t}' AS kpi_table, COUNT(DISTINCT {d}) AS n_rows, {M('SUM(amount)')} AS revenue FROM valid" for t, d in _JOB_TABLES.items()]
    + [f"SELECT 'scalar_kpis' AS kpi_table, CAST(1 AS BIGINT) AS n_rows, {M('SUM(amount)')} AS revenue FROM valid"]
    + [f"SELECT 'expansion_model' AS kpi_table, COUNT(*) AS n_rows, {M('SUM(revenue)')} AS revenue FROM m"]
    + [f"SELECT 'expansion_targets' AS kpi_table, COUNT(*) AS n_rows, {M('SUM(revenue)')} AS revenue FROM (" + targets_sql(2).split("SELECT * FROM m", 1)[1].join(["SELECT * FROM m", ") t"])]),
    extra=f"m AS ({model_sql(2)})"))
def q_sink_kpis_all(spark, sf):
    """K2: all ten tables of a run, stored in one commit and read back: rows and revenue of each."""
    from ordersight.operators.bundle import kpi_bundle
    from ordersight.sources.jobs import JobStore
    store = JobStore(spark, scratch_path(spark, f"kpis-{_uuid.uuid4().hex[:8]}"))
    record = kpi_bundle(valid(spark, sf)).record()
    store.commit(_job_id(sf), record)
    parts = [store.read(_job_id(sf), t).agg(F.lit(t).alias("kpi_table"), F.count(F.lit(1)).alias("n_rows"),
                                            F.sum("total_revenue" if t == "scalar_kpis" else "revenue").cast("decimal(38,2)").alias("revenue")) for t in record]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@register("upsert_status_stream", """SELECT user_id, event_type AS status, ts AS updated_at, event_id
FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn
      FROM events) e WHERE rn = 1""")
def q_upsert_status_stream(spark, sf):
    """K7 as a stream: events arrive in files of mixed times, some of them twice, a few files a trigger."""
    from ordersight.streaming import status as ST
    src, out, ckpt = (scratch_path(spark, f"{n}-{_uuid.uuid4().hex[:8]}") for n in ("events", "status", "status-ckpt"))
    events = read_table(spark, sf, "events").select("user_id", "event_type", "ts", "event_id")
    twice = events.where(F.pmod(F.xxhash64("event_id"), F.lit(10)) == 0)
    events.unionByName(twice).repartition(12, F.xxhash64("event_id", F.rand(7))).write.parquet(src)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 4).parquet(src)
    ST.upsert_stream(stream, out, ckpt).awaitTermination()
    return ST.current(spark, out)


@register("dense_order_id", """SELECT row_number() OVER () - 1 AS line_no, l_orderkey, l_linenumber FROM lineitem""")
def q_dense_order_id(spark, sf):
    """Dense ids 0, 1, ... in file order."""
    return FS.numbered(read_table(spark, sf, "lineitem"), "line_no").select("line_no", "l_orderkey", "l_linenumber")


@register("update_set_stored", O.with_ctes("""SELECT status, COUNT(*) AS n_lines, CAST(SUM(CASE WHEN hit THEN 0 ELSE amount END) AS DECIMAL(38,2)) AS amount, SUM(CASE WHEN hit THEN 1 ELSE 0 END) AS zeroed
FROM (SELECT CASE WHEN hit THEN 'Returned' ELSE status END AS status, amount, hit FROM (
  SELECT status, amount, coalesce(order_date BETWEEN DATE '1995-03-01' AND DATE '1995-03-31', FALSE) AS hit FROM sales) x) y GROUP BY status"""))
def q_update_set_stored(spark, sf):
    """P18 on a stored table: one month's lines are updated by copy-on-write, the other files stay."""
    from ordersight.sources.stored import StoredTable
    table = StoredTable(spark, scratch_path(spark, f"stored-{_uuid.uuid4().hex[:8]}"))
    table.write(sales(spark, sf).withColumn("zeroed", F.lit(0)), "order_date", 12)
    table.update(F.col("order_date").between("1995-03-01", "1995-03-31"), {"status": F.lit("Returned"), "amount": F.lit(0), "zeroed": F.lit(1)})
    return table.read().groupBy("status").agg(F.count(F.lit(1)).alias("n_lines"), F.sum("amount").cast("decimal(38,2)").alias("amount"),
                                              F.sum("zeroed").alias("zeroed"))
