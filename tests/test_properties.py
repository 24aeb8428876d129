"""Properties over the star-schema view (sf0.001)."""

import pytest
from pyspark.sql import functions as F

from ordersight.operators import clean as C
from ordersight.operators import kpis as K
from ordersight.operators import market as MK
from ordersight.sources.star import sales_view

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def valid(spark):
    return C.load_clean(sales_view(spark, SF))


def test_shares_sum_to_100(valid):
    s = K.revenue_by_state(valid).agg(F.sum("revenue_share_pct")).collect()[0][0]
    assert s == pytest.approx(100)


def test_groups_sum_to_total(valid):
    tot = K.scalar_kpis(valid).collect()[0].total_revenue
    by_state = K.revenue_by_state(valid).agg(F.sum("revenue")).collect()[0][0]
    by_cat = K.revenue_by_category(valid).agg(F.sum("revenue")).collect()[0][0]
    assert tot == by_state == by_cat


def test_average_ranks_sum(valid):
    r = MK.rank_states(valid, "average")
    n = r.count()
    s = r.agg(F.sum("revenue_rank"), F.sum("fulfillment_rank")).collect()[0]
    assert s[0] == pytest.approx(n * (n + 1) / 2) and s[1] == pytest.approx(n * (n + 1) / 2)


def test_quadrant_is_a_partition(valid):
    q = MK.market_quadrant(valid, 25)
    assert q.count() == q.select("ship_state").distinct().count()
    assert {r.quadrant for r in q.collect()} <= set(MK.QUADRANTS)


def test_cleaning_is_idempotent(spark):
    once = C.clean(sales_view(spark, SF)).drop("year_month", "is_fulfilled", "is_b2b", "amount_valid")
    twice = C.clean(once).drop("year_month", "is_fulfilled", "is_b2b", "amount_valid")
    assert once.exceptAll(twice).count() == 0 and twice.exceptAll(once).count() == 0


def test_scan_is_pruned_and_filter_pushed(spark, tmp_path):
    path = str(tmp_path / "clean")
    C.clean(sales_view(spark, SF)).write.parquet(path)
    plan = K.scalar_kpis(C.valid_sales(spark.read.parquet(path)))._jdf.queryExecution() \
        .executedPlan().toString()
    assert "GreaterThan(amount" in plan
    assert "ship_city" not in plan
