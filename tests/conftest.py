import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from ordersight.session import get_session
    s = get_session("local[4]", app="ordersight-tests", shuffle_partitions=8)
    yield s
    s.stop()


SALES_COLS = ("order_id string, order_date string, status string, fulfillment string, "
              "sales_channel string, category string, quantity int, amount string, "
              "ship_state string, is_b2b_raw string")

# FIXTURES.md section 4: the hand-made golden frame.
GOLDEN = [
    ("A1", "04-30-22", "Shipped", "Amazon", "Amazon.in", "Set", 1, "600", " bihar", "False"),
    ("A1", "04-30-22", "Shipped", "Amazon", "Amazon.in", "Kurta", 1, "400", "BIHAR", "False"),
    ("A2", "05-01-22", "Cancelled", "Merchant", "Amazon.in", "Set", 1, "500", "Goa", "True"),
    ("A3", "05-02-22", "Shipped - Delivered to Buyer", "Merchant", "Non-Amazon", "Kurta", 2, "500",
     "GOA ", "False"),
    ("A4", "06-03-22", "Shipped - Returned to Seller", "Amazon", "Amazon.in", "Set", 1, "1000",
     "Delhi", "False"),
    ("A5", "bad", "Shipped", None, "Amazon.in", "Set", 1, "0", "Delhi", "False"),
    ("A6", "06-04-22", "Shipped", "Amazon", "Amazon.in", "Set", 1, None, "Delhi", "False"),
]


@pytest.fixture(scope="session")
def golden(spark):
    return spark.createDataFrame(GOLDEN, SALES_COLS)
