"""Order lines in the canonical sales schema, read from a TPC-H-style star schema.

These builders only reshape the given tables into the input schema the
operators expect (including the messy spellings the cleaning must handle).
They do none of the operators' work. Joins carry no hints: Catalyst / AQE
broadcast a side only when its measured size is under
``spark.sql.autoBroadcastJoinThreshold`` and fall back to sort-merge joins
otherwise, so the plan holds when customer/part grow with the data.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ordersight.schema import AMOUNT_TYPE, RAW_EXPORT_HEADERS

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def table_bytes(spark: SparkSession, sf_dir: str, name: str) -> int:
    """The length of a table's files."""
    at = spark._jvm.org.apache.hadoop.fs.Path(os.path.join(sf_dir, f"{name}.parquet"))
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(at).getLength()


def _star_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice",
        "l_returnflag", "l_linestatus")
    orders = read_table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")
    customer = read_table(spark, sf_dir, "customer").select(
        "c_custkey", "c_nationkey", "c_mktsegment")
    nation = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    region = read_table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    part = read_table(spark, sf_dir, "part").select(
        "p_partkey", "p_name", "p_type", "p_brand", "p_size")
    # the orders get their customer's columns before the lines get theirs: an order line is shuffled by part and by order only
    bought = (orders.join(customer, F.col("o_custkey") == customer.c_custkey)
                    .join(nation, F.col("c_nationkey") == nation.n_nationkey)
                    .join(region, F.col("n_regionkey") == region.r_regionkey))
    return li.join(part, F.col("l_partkey") == part.p_partkey).join(bought, F.col("l_orderkey") == F.col("o_orderkey"))


def _status() -> F.Column:
    st, rf = F.col("o_orderstatus"), F.col("l_returnflag")
    return (F.when((st == "F") & (rf == "N"), "Shipped - Delivered to Buyer")
             .when((st == "F") & (rf == "A"), " Shipped")
             .when(st == "F", "Shipped - Returned to Seller")
             .when((st == "P") & (rf == "A"), "Shipped")
             .when(st == "P", "Pending")
             .when(rf == "A", "Cancelled")
             .otherwise("Unshipped"))


def _state(skewed: bool) -> F.Column:
    if skewed:
        return F.concat(F.lit("ZONE_"),
                        F.floor(F.sqrt(F.col("n_nationkey"))).cast("int").cast("string"))
    ln = F.col("l_linenumber") % 3
    return (F.when(ln == 0, F.concat(F.lit(" "), F.lower("n_name")))
             .when(ln == 1, F.col("n_name"))
             .otherwise(F.concat(F.col("n_name"), F.lit(" "))))


def sales_view(spark: SparkSession, sf_dir: str, skewed: bool = False) -> DataFrame:
    """Canonical order lines (SALES schema) over the star schema."""
    j = _star_join(spark, sf_dir)
    amount = (F.when(F.col("l_orderkey") % 97 == 0, F.lit(0).cast(AMOUNT_TYPE))
               .when((F.col("l_linenumber") == 7) & (F.col("l_orderkey") % 10 == 0),
                     F.lit(None).cast(AMOUNT_TYPE))
               .otherwise(F.col("l_extendedprice").cast(AMOUNT_TYPE)))
    return j.select(
        F.col("l_orderkey").cast("string").alias("order_id"),
        F.to_date("o_orderdate").alias("order_date"),
        _status().alias("status"),
        F.when((F.col("l_returnflag") == "R") |
               ((F.col("l_returnflag") == "N") & (F.col("l_linestatus") == "F")),
               "Merchant").otherwise("Amazon").alias("fulfillment"),
        F.when(F.col("c_mktsegment") == "HOUSEHOLD", "Non-Amazon")
         .otherwise("Amazon.in").alias("sales_channel"),
        F.lit(None).cast("string").alias("ship_service"),
        F.col("p_name").alias("style"),
        F.col("l_partkey").cast("string").alias("sku"),
        F.col("p_type").alias("category"),
        F.col("p_size").cast("string").alias("size"),
        F.col("p_brand").alias("asin"),
        F.col("l_returnflag").alias("courier_status"),
        F.round("l_quantity").cast("int").alias("quantity"),
        F.lit("INR").alias("currency"),
        amount.alias("amount"),
        F.concat(F.lit("City_"), (F.col("o_custkey") % 50).cast("string")).alias("ship_city"),
        _state(skewed).alias("ship_state"),
        F.col("r_name").alias("ship_country"),
        F.when(F.col("c_mktsegment") == "MACHINERY", "TRUE").otherwise("FALSE").alias("is_b2b_raw"),
        F.lit(None).cast("string").alias("fulfillment_type"),
    )


def raw_export_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same lines as the 24-column text export (all strings, export headers)."""
    s = sales_view(spark, sf_dir)
    text = {
        "index": F.lit(None).cast("string"),
        "Order ID": F.col("order_id"),
        "Date": F.date_format("order_date", "MM-dd-yy"),
        "Status": F.col("status"),
        "Fulfilment": F.col("fulfillment"),
        "Sales Channel ": F.col("sales_channel"),
        "ship-service-level": F.col("ship_service"),
        "Style": F.col("style"),
        "SKU": F.col("sku"),
        "Category": F.col("category"),
        "Size": F.col("size"),
        "ASIN": F.col("asin"),
        "Courier Status": F.col("courier_status"),
        "Qty": F.col("quantity").cast("string"),
        "currency": F.col("currency"),
        "Amount": F.col("amount").cast("string"),
        "ship-city": F.col("ship_city"),
        "ship-state": F.col("ship_state"),
        "ship-postal-code": F.lit(None).cast("string"),
        "ship-country": F.col("ship_country"),
        "promotion-ids": F.lit(None).cast("string"),
        "B2B": F.col("is_b2b_raw"),
        "fulfilled-by": F.col("fulfillment_type"),
        "Unnamed: 22": F.lit(None).cast("string"),
    }
    return s.select(*[text[h].alias(h) for h in RAW_EXPORT_HEADERS])


def customer_sales_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines at customer grain: customer key as the market dimension and
    discounted price as the amount (many groups, uneven revenue)."""
    li = read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_extendedprice", "l_discount", "l_returnflag")
    orders = read_table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")
    j = li.join(orders, li.l_orderkey == orders.o_orderkey)
    return j.select(
        F.col("l_orderkey").cast("string").alias("order_id"),
        F.to_date("o_orderdate").alias("order_date"),
        _status().alias("status"),
        F.col("o_custkey").cast("string").alias("ship_state"),
        (F.col("l_extendedprice").cast(AMOUNT_TYPE)
         * (F.lit(1) - F.col("l_discount").cast("decimal(4,2)"))).cast(AMOUNT_TYPE).alias("amount"),
    )
