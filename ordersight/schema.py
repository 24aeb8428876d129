"""Canonical schemas and the fixed values that results depend on."""

from __future__ import annotations

from pyspark.sql import types as T

# --------------------------------------------------------------------------
# FIXED VALUES (must equal the source application's for identical results)
# --------------------------------------------------------------------------

# Status values counted as fulfilled by the exact-set policy.
FULFILLED_STATUSES = ("Shipped", "Shipped - Delivered to Buyer")
# Upper-cased form used by the SQL scripts (UPPER(TRIM(status)) IN ...).
FULFILLED_STATUSES_UPPER = ("SHIPPED", "SHIPPED - DELIVERED TO BUYER")
# Case-insensitive stems of the lenient (regex) policy.
FULFILLED_STEMS_REGEX = "ship|deliver|complet|fulfil"
# The single status counted by the first SQL generation.
SHIPPED_ONLY = "Shipped"

# Raw B2B tokens meaning "business order".
B2B_TRUE_TOKENS = ("TRUE", "1", "YES")
# The SQL scripts additionally accept the label itself.
B2B_LABEL_TOKENS = ("TRUE", "1", "YES", "B2B")

# Date formats of the exports: month-day-two-digit-year, strict.
STRICT_DATE_FORMATS = ("MM-dd-yy", "M-d-yy")
# Formats tried in order by the lenient parser (first that parses wins).
ANY_DATE_FORMATS = ("MM-dd-yy", "M-d-yy", "yyyy-MM-dd", "MM-dd-yyyy", "M-d-yyyy",
                    "yyyy/MM/dd", "MM/dd/yyyy", "M/d/yyyy", "MM/dd/yy", "M/d/yy",
                    "dd-MMM-yy", "dd-MMM-yyyy", "yyyyMMdd")
# Two-digit years below this pivot are 20xx, the rest 19xx (C/Python %y rule).
TWO_DIGIT_YEAR_PIVOT = 69

# Export header -> canonical column (headers are blank-stripped first).
COLUMN_MAP = {
    "Order ID": "order_id",
    "Date": "order_date",
    "Status": "status",
    "Fulfilment": "fulfillment",
    "Sales Channel": "sales_channel",
    "ship-service-level": "ship_service",
    "Style": "style",
    "SKU": "sku",
    "Category": "category",
    "Size": "size",
    "ASIN": "asin",
    "Courier Status": "courier_status",
    "Qty": "quantity",
    "currency": "currency",
    "Amount": "amount",
    "ship-city": "ship_city",
    "ship-state": "ship_state",
    "B2B": "is_b2b_raw",
    "fulfilled-by": "fulfillment_type",
}

# Header order of the raw 24-column export.
RAW_EXPORT_HEADERS = (
    "index", "Order ID", "Date", "Status", "Fulfilment", "Sales Channel ",
    "ship-service-level", "Style", "SKU", "Category", "Size", "ASIN",
    "Courier Status", "Qty", "currency", "Amount", "ship-city", "ship-state",
    "ship-postal-code", "ship-country", "promotion-ids", "B2B", "fulfilled-by",
    "Unnamed: 22",
)

# Defaults for columns absent from an already-loaded table.
LOAD_DEFAULTS = {
    "status": "Shipped",
    "ship_state": "UNKNOWN",
    "ship_city": "UNKNOWN",
    "category": "General",
    "fulfillment": "Unknown",
    "sales_channel": "Unknown",
    "quantity": 1,
}
# Defaults for optional columns absent after header mapping.
MAPPED_DEFAULTS = {
    "fulfillment": "Unknown",
    "sales_channel": "Unknown",
    "category": "General",
    "quantity": 1,
    "ship_city": "Unknown",
    "currency": "INR",
    "sku": "N/A",
    "courier_status": "Unknown",
}

# Header-matching alias table: canonical field -> accepted header spellings,
# in field order. The field "category" is listed twice in the source table;
# its second list is the one in effect (so "type", "product type" and
# "department" are not aliases).
FIELD_ALIASES = {
    "order_id": ["order id", "order_id", "orderid", "id", "order no",
                 "order number", "transaction id", "sale id"],
    "order_date": ["date", "order date", "order_date", "sale date", "created at",
                   "created_at", "purchase date", "transaction date"],
    "status": ["status", "order status", "order_status", "fulfillment status",
               "shipment status", "delivery status"],
    "fulfillment": ["fulfilment", "fulfillment", "fulfilled by", "fulfillment type",
                    "shipping type", "dispatch type"],
    "sales_channel": ["sales channel", "sales_channel", "channel", "platform",
                      "source", "marketplace"],
    "category": ["category", "product category", "item type"],
    "quantity": ["qty", "quantity", "units", "count", "items", "pieces",
                 "no of items"],
    "amount": ["amount", "revenue", "price", "total", "sale amount", "order value",
               "gmv", "selling price", "total amount", "net amount", "gross amount",
               "total_price", "totalprice", "total price", "unit price", "sale value"],
    "ship_city": ["ship city", "ship-city", "shipping city", "city", "delivery city",
                  "customer city"],
    "ship_state": ["ship state", "ship-state", "shipping state", "state",
                   "delivery state", "customer state", "province"],
    "sku": ["sku", "product sku", "item sku", "product code"],
    "courier_status": ["courier status", "courier_status", "tracking status"],
    "currency": ["currency", "currency code"],
}
REQUIRED_FIELDS = ("order_id", "order_date", "status", "amount", "ship_state")
OPTIONAL_FIELDS = ("fulfillment", "sales_channel", "category", "quantity",
                   "ship_city", "sku", "courier_status", "currency")
MATCH_THRESHOLD = 0.6          # accept a header when score >= this
HIGH_CONFIDENCE = 0.8          # shown as "high" from this score

# Insight impact order and categories.
IMPACT_ORDER = ("High", "Medium", "Low")
INSIGHT_CATEGORIES = ("Revenue", "Fulfillment", "Expansion", "Growth", "Alert")
SEVERITIES = ("critical", "high", "medium", "low")

# Fulfillment target of the dashboard card.
RATE_TARGET = 85.0

# --------------------------------------------------------------------------
# Canonical schemas
# --------------------------------------------------------------------------

AMOUNT_TYPE = T.DecimalType(12, 2)  # amounts as the source tables declare them
# Amounts parsed from text: wide, so that neither large nor small amounts are lost.
PARSED_AMOUNT_TYPE = T.DecimalType(38, 6)

SALES = T.StructType([
    T.StructField("order_id", T.StringType()),
    T.StructField("order_date", T.DateType()),
    T.StructField("status", T.StringType()),
    T.StructField("fulfillment", T.StringType()),
    T.StructField("sales_channel", T.StringType()),
    T.StructField("ship_service", T.StringType()),
    T.StructField("style", T.StringType()),
    T.StructField("sku", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("size", T.StringType()),
    T.StructField("asin", T.StringType()),
    T.StructField("courier_status", T.StringType()),
    T.StructField("quantity", T.IntegerType()),
    T.StructField("currency", T.StringType()),
    T.StructField("amount", AMOUNT_TYPE),
    T.StructField("ship_city", T.StringType()),
    T.StructField("ship_state", T.StringType()),
    T.StructField("ship_country", T.StringType()),
    T.StructField("is_b2b_raw", T.StringType()),
    T.StructField("fulfillment_type", T.StringType()),
])

# First SQL generation: 12 columns.
SALES_DDL_V1 = T.StructType([
    T.StructField("order_id", T.StringType()),
    T.StructField("order_date", T.DateType()),
    T.StructField("status", T.StringType()),
    T.StructField("fulfillment", T.StringType()),
    T.StructField("sales_channel", T.StringType()),
    T.StructField("ship_city", T.StringType()),
    T.StructField("ship_state", T.StringType()),
    T.StructField("ship_country", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("quantity", T.IntegerType()),
    T.StructField("amount", T.DecimalType(10, 2)),
    T.StructField("b2b_flag", T.StringType()),
])

# Second SQL generation: 20 columns, two flag columns with defaults.
SALES_DDL_V2 = T.StructType([
    T.StructField("order_id", T.StringType()),
    T.StructField("order_date", T.DateType()),
    T.StructField("status", T.StringType()),
    T.StructField("fulfillment", T.StringType()),
    T.StructField("sales_channel", T.StringType()),
    T.StructField("ship_service", T.StringType()),
    T.StructField("style", T.StringType()),
    T.StructField("sku", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("size", T.StringType()),
    T.StructField("asin", T.StringType()),
    T.StructField("courier_status", T.StringType()),
    T.StructField("quantity", T.IntegerType()),
    T.StructField("currency", T.StringType()),
    T.StructField("amount", AMOUNT_TYPE),
    T.StructField("ship_city", T.StringType()),
    T.StructField("ship_state", T.StringType()),
    T.StructField("b2b_flag", T.StringType()),
    T.StructField("is_fulfilled", T.IntegerType()),
    T.StructField("amount_valid", T.IntegerType()),
])
# Fixed value: column list of the positional load statement (19 columns).
LOAD_COLUMNS = ("order_id", "order_date", "status", "fulfillment", "sales_channel", "ship_service",
                "style", "sku", "category", "size", "asin", "courier_status", "quantity", "currency",
                "amount", "ship_city", "ship_state", "is_b2b_raw", "fulfillment_type")
SALES_DDL_V2_DEFAULTS = {"is_fulfilled": 0, "amount_valid": 1}

# Raw export read as text (no inference pass): every column is a string.
RAW_EXPORT = T.StructType([T.StructField(h, T.StringType()) for h in RAW_EXPORT_HEADERS])

# Typed text-scan schema of the BI workbook (24 columns).
BI_TEXT_SCAN = T.StructType([
    T.StructField("index", T.IntegerType()),
    T.StructField("Order ID", T.StringType()),
    T.StructField("Date", T.StringType()),
    T.StructField("Status", T.StringType()),
    T.StructField("Fulfilment", T.StringType()),
    T.StructField("Sales Channel ", T.StringType()),
    T.StructField("ship-service-level", T.StringType()),
    T.StructField("Style", T.StringType()),
    T.StructField("SKU", T.StringType()),
    T.StructField("Category", T.StringType()),
    T.StructField("Size", T.StringType()),
    T.StructField("ASIN", T.StringType()),
    T.StructField("Courier Status", T.StringType()),
    T.StructField("Qty", T.IntegerType()),
    T.StructField("currency", T.StringType()),
    T.StructField("Amount", T.DoubleType()),
    T.StructField("ship-city", T.StringType()),
    T.StructField("ship-state", T.StringType()),
    T.StructField("ship-postal-code", T.StringType()),
    T.StructField("ship-country", T.StringType()),
    T.StructField("promotion-ids", T.StringType()),
    T.StructField("B2B", T.StringType()),
    T.StructField("fulfilled-by", T.StringType()),
    T.StructField("Unnamed: 22", T.StringType()),
])

INSIGHT = T.StructType([
    T.StructField("title", T.StringType()),
    T.StructField("detail", T.StringType()),
    T.StructField("impact", T.StringType()),
    T.StructField("action", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("metric_value", T.StringType()),
])

FINDING_COLUMNS = ("check_pos", "type", "severity", "message", "entity", "value",
                   "drop_percent", "states")
