"""0/1 flags and coercions: fulfillment policies, B2B, amount validity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ordersight.functions.text import py_strip, upper_strip
from ordersight.schema import (B2B_LABEL_TOKENS, B2B_TRUE_TOKENS, FULFILLED_STATUSES,
                               FULFILLED_STATUSES_UPPER, FULFILLED_STEMS_REGEX,
                               PARSED_AMOUNT_TYPE, SHIPPED_ONLY)

POLICIES = ("exact", "regex", "upper_in", "shipped_only", "bi")


def _c(col):
    return F.col(col) if isinstance(col, str) else col


def fulfilled(col, policy: str = "exact", stripped: bool = False) -> Column:
    """1 when the status counts as fulfilled under ``policy``, else 0 (null -> 0).

    exact        stripped status in the exact two-value set (case-sensitive)
    regex        contains ship/deliver/complet/fulfil, case-insensitive
    upper_in     UPPER(TRIM(status)) in the upper-cased set (SQL scripts)
    shipped_only status = 'Shipped' with no stripping (first SQL generation)
    bi           status equal to one of the two values, no stripping (workbook)
    ``stripped``: the column is already stripped (skip the strip).
    """
    c = _c(col)
    if policy == "exact":
        cond = (c if stripped else py_strip(c)).isin(*FULFILLED_STATUSES)
    elif policy == "regex":
        cond = c.rlike("(?i)(" + FULFILLED_STEMS_REGEX + ")")
    elif policy == "upper_in":
        cond = F.upper(F.trim(c)).isin(*FULFILLED_STATUSES_UPPER)
    elif policy == "shipped_only":
        cond = c == F.lit(SHIPPED_ONLY)
    elif policy == "bi":
        cond = c.isin(*FULFILLED_STATUSES)
    else:
        raise ValueError(f"unknown fulfillment policy {policy!r}")
    return F.when(cond, F.lit(1)).otherwise(F.lit(0))


def b2b_int(col) -> Column:
    """Raw TRUE/1/YES -> 1, anything else (or null) -> 0."""
    return F.when(upper_strip(_c(col)).isin(*B2B_TRUE_TOKENS), F.lit(1)).otherwise(F.lit(0))


def b2b_label(col) -> Column:
    """SQL form: TRUE/1/YES/B2B -> 'B2B', anything else -> 'B2C'."""
    return (F.when(F.upper(F.trim(_c(col))).isin(*B2B_LABEL_TOKENS), F.lit("B2B"))
            .otherwise(F.lit("B2C")))


def coerce_amount(df, col: str = "amount") -> Column:
    """Text or floating number -> decimal(38,6), a decimal column stays as it is;
    unparsable -> null (never throws). Wide, so that an amount of 10^10 or of
    0.004 survives the ``amount > 0`` filter; outputs round where they show it."""
    dtype = dict(df.dtypes)[col]
    c = F.col(col)
    if dtype.startswith("decimal"):
        return c
    return (py_strip(c) if dtype == "string" else c).try_cast(PARSED_AMOUNT_TYPE)


def unparsable_amounts(df, col: str = "amount"):
    """One row: lines, and lines whose non-empty amount is not a number (these
    become null and are dropped by the validity filter)."""
    c = F.col(col).cast("string")
    bad = c.isNotNull() & (py_strip(c) != "") & coerce_amount(df, col).isNull()
    return df.agg(F.count(F.lit(1)).alias("lines"), F.count_if(bad).alias("unparsable_amounts"))


def amount_valid(col) -> Column:
    """0 if null or <= 0, else 1 (row kept)."""
    c = _c(col)
    return F.when(c.isNull() | (c <= 0), F.lit(0)).otherwise(F.lit(1))
