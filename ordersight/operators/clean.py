"""Cleaning: one narrow projection over the order lines (no shuffle).

Every step is a built-in column expression, so the whole cleaning runs inside
one whole-stage-codegen span right after the scan, and a later ``amount > 0``
filter is pushed to the parquet reader when the input is a file scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordersight.functions.dates import as_date, parse_date, parse_date_any, year_month
from ordersight.functions.flags import (amount_valid, b2b_int, b2b_label, coerce_amount,
                                        fulfilled)
from ordersight.functions.text import py_strip, upper_strip
from ordersight.schema import (ANY_DATE_FORMATS, COLUMN_MAP, LOAD_DEFAULTS, MAPPED_DEFAULTS,
                               SALES_DDL_V2, SALES_DDL_V2_DEFAULTS, STRICT_DATE_FORMATS)


# ---- header handling (S2, S3) ------------------------------------------------

def trim_headers(df: DataFrame) -> DataFrame:
    """Strip blanks around every header ("Sales Channel " -> "Sales Channel")."""
    return df.toDF(*[c.strip() for c in df.columns])


def rename_canonical(df: DataFrame, column_map: dict | None = None) -> DataFrame:
    """Rename export headers to canonical names; absent headers are ignored."""
    cmap = column_map or COLUMN_MAP
    present = {k: v for k, v in cmap.items() if k in df.columns}
    return df.withColumnsRenamed(present)


# ---- defaults (P17, P19, P20, P21) -------------------------------------------

def add_column_if_absent(df: DataFrame, name: str, value) -> DataFrame:
    if name in df.columns:
        return df
    return df.withColumn(name, value if hasattr(value, "alias") else F.lit(value))


def default_missing(df: DataFrame, defaults: dict | None = None) -> DataFrame:
    """Absent columns become constants (status Shipped, state UNKNOWN, ...)."""
    for name, value in (defaults or LOAD_DEFAULTS).items():
        df = add_column_if_absent(df, name, value)
    return df


def default_missing_mapped(df: DataFrame) -> DataFrame:
    return default_missing(df, MAPPED_DEFAULTS)


def synthetic_order_id(df: DataFrame) -> DataFrame:
    """Absent order id -> a unique id per line (unique, not dense)."""
    return add_column_if_absent(df, "order_id",
                                F.monotonically_increasing_id().cast("string"))


# ---- the cleaning projection (P1-P16) ----------------------------------------

def clean(df: DataFrame, *, fulfilled_policy: str = "exact",
          date_formats=STRICT_DATE_FORMATS, b2b: str = "raw") -> DataFrame:
    """Canonical cleaning of order lines; rows are kept (see ``valid_sales``).

    ship_state / ship_city: upper + Python-style strip; category / status:
    strip; order_date: typed or parsed text (unparsable -> null); year_month;
    is_fulfilled by ``fulfilled_policy``; is_b2b from the raw column when
    present (``b2b='raw'``) or constant 0 (``b2b='zero'``); amount coerced to
    decimal(38,6) unless already decimal (unparsable -> null); amount_valid flag.
    """
    cols = set(df.columns)
    out = {}
    if "ship_state" in cols:
        out["ship_state"] = upper_strip("ship_state")
    if "ship_city" in cols:
        out["ship_city"] = upper_strip("ship_city")
    if "category" in cols:
        out["category"] = py_strip("category")
    if "status" in cols:
        out["status"] = py_strip("status")
    if "order_date" in cols:
        out["order_date"] = as_date(df, "order_date", date_formats)
    if "amount" in cols:
        out["amount"] = coerce_amount(df, "amount")
    df = df.withColumns(out)
    derived = {}
    if "order_date" in cols:
        derived["year_month"] = year_month("order_date")
    derived["is_fulfilled"] = (fulfilled("status", fulfilled_policy, stripped=True)
                               if "status" in cols else F.lit(0))
    if b2b == "raw" and "is_b2b_raw" in cols:
        derived["is_b2b"] = b2b_int("is_b2b_raw")
    else:
        derived["is_b2b"] = F.lit(0)
    if "amount" in cols:
        derived["amount_valid"] = amount_valid("amount")
    return df.withColumns(derived)


def valid_sales(df: DataFrame) -> DataFrame:
    """Keep lines with a positive amount (null-rejecting; pushed to the scan)."""
    return df.filter(F.col("amount") > 0)


def load_clean(df: DataFrame, **kw) -> DataFrame:
    """Standard load path: clean, then drop invalid amounts."""
    return valid_sales(clean(df, **kw))


def load_from_df(df: DataFrame) -> DataFrame:
    """Lenient load path for an already-loaded table: defaults for absent
    columns, any date format, regex fulfillment, B2B constant 0, valid only."""
    df = synthetic_order_id(default_missing(df))
    return valid_sales(clean(df, fulfilled_policy="regex",
                             date_formats=ANY_DATE_FORMATS, b2b="zero"))


# ---- single-step operators (exposed for the catalog and tests) ---------------

def clean_state(col="ship_state"):
    return upper_strip(col)


def clean_city(col="ship_city"):
    return upper_strip(col)


def clean_text(col):
    return py_strip(col)


def parse_order_date(col="order_date"):
    return parse_date(col)


def parse_order_date_any(col="order_date"):
    return parse_date_any(col)


def sql_flags(df: DataFrame) -> DataFrame:
    """The SQL scripts' in-place UPDATEs as one projection: upper(trim) state and
    city, is_fulfilled by UPPER(TRIM) IN, amount_valid, b2b label."""
    out = {
        "ship_state": F.upper(F.trim("ship_state")),
        "ship_city": F.upper(F.trim("ship_city")),
        "is_fulfilled": fulfilled("status", "upper_in"),
        "amount_valid": amount_valid("amount"),
    }
    if "is_b2b_raw" in df.columns:
        out["b2b_flag"] = b2b_label("is_b2b_raw")
    elif "b2b_flag" in df.columns:
        out["b2b_flag"] = b2b_label("b2b_flag")
    return df.withColumns(out)


def conform_ddl_v2(df: DataFrame) -> DataFrame:
    """Project onto the 20-column second-generation table; flag defaults."""
    cols = []
    for field in SALES_DDL_V2.fields:
        if field.name in df.columns:
            cols.append(F.col(field.name).cast(field.dataType).alias(field.name))
        elif field.name == "b2b_flag" and "is_b2b_raw" in df.columns:
            cols.append(F.col("is_b2b_raw").cast("string").alias("b2b_flag"))
        elif field.name in SALES_DDL_V2_DEFAULTS:
            cols.append(F.lit(SALES_DDL_V2_DEFAULTS[field.name]).cast(field.dataType).alias(field.name))
        else:
            cols.append(F.lit(None).cast(field.dataType).alias(field.name))
    return df.select(*cols)


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN -> null in every floating column (export boundary)."""
    out = {c: F.when(F.isnan(c), F.lit(None)).otherwise(F.col(c))
           for c, t in df.dtypes if t in ("double", "float")}
    return df.withColumns(out) if out else df


def drop_null(df: DataFrame, cols) -> DataFrame:
    return df.dropna(subset=list(cols))
