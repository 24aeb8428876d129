"""DuckDB SQL text used as an independent oracle for the Spark operators.

Each oracle query starts from the same star-schema tables and rebuilds the
canonical order lines (``sales``), the cleaned lines (``clean``) and the valid
lines (``valid``) as CTEs, then states the operator in plain SQL.
"""

from __future__ import annotations

from ordersight.functions.text import sql_strip
from ordersight.schema import (B2B_TRUE_TOKENS, FULFILLED_STATUSES, FULFILLED_STATUSES_UPPER,
                               FULFILLED_STEMS_REGEX)


def _in_list(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def sales_sql(skewed: bool = False) -> str:
    state = ("concat('ZONE_', CAST(CAST(floor(sqrt(n_nationkey)) AS INT) AS VARCHAR))"
             if skewed else
             "CASE l_linenumber % 3 WHEN 0 THEN concat(' ', lower(n_name)) "
             "WHEN 1 THEN n_name ELSE concat(n_name, ' ') END")
    return f"""SELECT CAST(l_orderkey AS VARCHAR) AS order_id,
  CAST(o_orderdate AS DATE) AS order_date,
  CASE WHEN o_orderstatus='F' AND l_returnflag='N' THEN 'Shipped - Delivered to Buyer'
       WHEN o_orderstatus='F' AND l_returnflag='A' THEN ' Shipped'
       WHEN o_orderstatus='F' THEN 'Shipped - Returned to Seller'
       WHEN o_orderstatus='P' AND l_returnflag='A' THEN 'Shipped'
       WHEN o_orderstatus='P' THEN 'Pending'
       WHEN l_returnflag='A' THEN 'Cancelled' ELSE 'Unshipped' END AS status,
  CASE WHEN l_returnflag='R' OR (l_returnflag='N' AND l_linestatus='F') THEN 'Merchant' ELSE 'Amazon' END AS fulfillment,
  CASE WHEN c_mktsegment='HOUSEHOLD' THEN 'Non-Amazon' ELSE 'Amazon.in' END AS sales_channel,
  CAST(NULL AS VARCHAR) AS ship_service,
  p_name AS style, CAST(l_partkey AS VARCHAR) AS sku, p_type AS category,
  CAST(p_size AS VARCHAR) AS size, p_brand AS asin, l_returnflag AS courier_status,
  CAST(l_quantity AS INT) AS quantity, 'INR' AS currency,
  CASE WHEN l_orderkey % 97 = 0 THEN CAST(0 AS DECIMAL(12,2))
       WHEN l_linenumber = 7 AND l_orderkey % 10 = 0 THEN CAST(NULL AS DECIMAL(12,2))
       ELSE CAST(l_extendedprice AS DECIMAL(12,2)) END AS amount,
  concat('City_', CAST(c_custkey % 50 AS VARCHAR)) AS ship_city,
  {state} AS ship_state,
  r_name AS ship_country,
  CASE WHEN c_mktsegment='MACHINERY' THEN 'TRUE' ELSE 'FALSE' END AS is_b2b_raw,
  CAST(NULL AS VARCHAR) AS fulfillment_type
FROM lineitem JOIN orders ON l_orderkey=o_orderkey JOIN customer ON o_custkey=c_custkey
JOIN nation ON c_nationkey=n_nationkey JOIN region ON n_regionkey=r_regionkey
JOIN part ON l_partkey=p_partkey"""


def customer_sales_sql() -> str:
    """Order lines at customer grain (customer key as the market dimension)."""
    return """SELECT CAST(l_orderkey AS VARCHAR) AS order_id, CAST(o_orderdate AS DATE) AS order_date,
  CASE WHEN o_orderstatus='F' AND l_returnflag='N' THEN 'Shipped - Delivered to Buyer'
       WHEN o_orderstatus='F' AND l_returnflag='A' THEN ' Shipped'
       WHEN o_orderstatus='F' THEN 'Shipped - Returned to Seller'
       WHEN o_orderstatus='P' AND l_returnflag='A' THEN 'Shipped'
       WHEN o_orderstatus='P' THEN 'Pending'
       WHEN l_returnflag='A' THEN 'Cancelled' ELSE 'Unshipped' END AS status,
  CAST(o_custkey AS VARCHAR) AS ship_state,
  CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))) AS DECIMAL(12,2))
    AS amount
FROM lineitem JOIN orders ON l_orderkey=o_orderkey"""


def fulfilled_sql(expr: str, policy: str = "exact") -> str:
    if policy == "exact":
        cond = f"{sql_strip(expr)} IN ({_in_list(FULFILLED_STATUSES)})"
    elif policy == "regex":
        cond = f"regexp_matches({expr}, '(?i)({FULFILLED_STEMS_REGEX})')"
    elif policy == "upper_in":
        cond = f"upper(trim({expr})) IN ({_in_list(FULFILLED_STATUSES_UPPER)})"
    elif policy == "shipped_only":
        cond = f"{expr} = 'Shipped'"
    elif policy == "bi":
        cond = f"{expr} IN ({_in_list(FULFILLED_STATUSES)})"
    else:
        raise ValueError(policy)
    return f"CASE WHEN {cond} THEN 1 ELSE 0 END"


def clean_sql(policy: str = "exact", src: str = "sales") -> str:
    st = sql_strip
    return f"""SELECT order_id, order_date, {st('status')} AS status, fulfillment, sales_channel,
  ship_service, style, sku, {st('category')} AS category, size, asin, courier_status,
  quantity, currency, amount, upper({st('ship_city')}) AS ship_city,
  upper({st('ship_state')}) AS ship_state, ship_country, is_b2b_raw, fulfillment_type,
  strftime(order_date, '%Y-%m') AS year_month,
  {fulfilled_sql('status', policy)} AS is_fulfilled,
  CASE WHEN upper({st('is_b2b_raw')}) IN ({_in_list(B2B_TRUE_TOKENS)}) THEN 1 ELSE 0 END AS is_b2b,
  CASE WHEN amount IS NULL OR amount <= 0 THEN 0 ELSE 1 END AS amount_valid
FROM {src}"""


def with_ctes(body: str, *, policy: str = "exact", skewed: bool = False,
              extra: str = "") -> str:
    """Prefix ``body`` with the sales / clean / valid CTEs."""
    ctes = (f"WITH sales AS ({sales_sql(skewed)}),\n"
            f"clean AS ({clean_sql(policy)}),\n"
            f"valid AS (SELECT * FROM clean WHERE amount > 0)")
    if extra:
        ctes += ",\n" + extra
    if body.lstrip().upper().startswith("WITH"):
        body = f"SELECT * FROM ({body}) q"
    return ctes + "\n" + body


# ---- shared SQL fragments -----------------------------------------------------

def money(expr: str) -> str:
    return f"CAST({expr} AS DECIMAL(38,2))"


def pct(num: str, den: str) -> str:
    return f"(CAST({num} AS DOUBLE) / CAST({den} AS DOUBLE) * 100)"


def ratio(num: str, den: str) -> str:
    return f"(CAST({num} AS DOUBLE) / CAST({den} AS DOUBLE))"


def round_half_up_div(num_int: str, den_int: str, scale_pow: int) -> str:
    """round(num/den, k) half away from zero, exact, as integer arithmetic:
    returns the result scaled by 10**k as an integer expression."""
    return (f"(sign({num_int}) * ((2 * abs({num_int}) * {scale_pow} + ({den_int})) "
            f"// (2 * ({den_int}))))")


def round_avg_money(col: str = "amount") -> str:
    """MySQL ROUND(AVG(decimal(12,2)), 2): AVG kept at scale 6 (half up), then
    rounded to 2 (half up). Exact integer arithmetic, result DOUBLE."""
    cents = f"CAST(SUM({col}) * 100 AS HUGEINT)"
    n = f"COUNT({col})"
    avg6 = round_half_up_div(cents, n, 10 ** 4)
    avg2 = f"(sign({avg6}) * ((2 * abs({avg6}) + 10000) // 20000))"
    return f"CAST({avg2} AS DOUBLE) / 100"


def round_rate_pct(flag_sum: str, n: str) -> str:
    """ROUND(SUM(flag) / n * 100, 2) exactly (half up), result DOUBLE."""
    return f"CAST({round_half_up_div(f'CAST({flag_sum} AS HUGEINT)', n, 10 ** 4)} AS DOUBLE) / 100"


def round_share_pct(part: str, total: str) -> str:
    """ROUND(part / total * 100, 2) for money (decimal) sums, exact half up."""
    p = f"CAST(({part}) * 100 AS HUGEINT)"
    t = f"CAST(({total}) * 100 AS HUGEINT)"
    return f"CAST({round_half_up_div(p, t, 10 ** 4)} AS DOUBLE) / 100"
