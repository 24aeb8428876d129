"""Hand-worked expectations on the golden frame (FIXTURES.md section 4)."""

import pytest
from pyspark.sql import functions as F

from ordersight.operators import checks as CK
from ordersight.operators import clean as C
from ordersight.operators import insights as IN
from ordersight.operators import kpis as K
from ordersight.operators import market as MK


def rows(df, key):
    return {r[key]: r.asDict() for r in df.collect()}


def test_scalars_exact_policy(golden):
    r = K.scalar_kpis(C.load_clean(golden)).collect()[0]
    assert float(r.total_revenue) == 3000
    assert r.total_orders == 4
    assert r.total_quantity == 6
    assert r.avg_order_value == pytest.approx(600)
    assert r.fulfillment_rate == pytest.approx(60)
    assert r.b2b_revenue_share == pytest.approx(100 * 500 / 3000)


def test_regex_policy(golden):
    r = K.scalar_kpis(C.load_clean(golden, fulfilled_policy="regex")).collect()[0]
    assert r.fulfillment_rate == pytest.approx(80)


def test_invalid_rows_dropped_and_dates(golden):
    v = C.load_clean(golden)
    assert sorted(r.order_id for r in v.select("order_id").distinct().collect()) == ["A1", "A2", "A3", "A4"]
    d = {r.order_id: r.order_date for r in C.clean(golden).collect()}
    assert str(d["A1"]) == "2022-04-30" and d["A5"] is None


def test_revenue_by_state(golden):
    r = rows(K.revenue_by_state(C.load_clean(golden)), "ship_state")
    assert set(r) == {"BIHAR", "GOA", "DELHI"}
    assert [float(r[s]["revenue"]) for s in ("BIHAR", "GOA", "DELHI")] == [1000, 1000, 1000]
    assert [r[s]["orders"] for s in ("BIHAR", "GOA", "DELHI")] == [1, 2, 1]
    assert r["BIHAR"]["fulfillment_rate"] == pytest.approx(100)
    assert r["GOA"]["fulfillment_rate"] == pytest.approx(50)
    assert r["DELHI"]["fulfillment_rate"] == pytest.approx(0)
    for s in r.values():
        assert s["revenue_share_pct"] == pytest.approx(100 / 3)


def test_fulfillment_by_state_can_exceed_100(golden):
    r = rows(K.fulfillment_by_state(C.load_clean(golden)), "ship_state")
    assert r["BIHAR"]["fulfillment_rate"] == pytest.approx(200)
    assert r["GOA"]["fulfillment_rate"] == pytest.approx(50)
    assert r["DELHI"]["fulfillment_rate"] == pytest.approx(0)


def test_ranks_and_composite(golden):
    v = C.load_clean(golden)
    avg = rows(MK.rank_states(v, "average"), "ship_state")
    mn = rows(MK.rank_states(v, "min"), "ship_state")
    assert {s: avg[s]["revenue_rank"] for s in avg} == {"BIHAR": 2.0, "GOA": 2.0, "DELHI": 2.0}
    assert {s: mn[s]["revenue_rank"] for s in mn} == {"BIHAR": 1, "GOA": 1, "DELHI": 1}
    m = rows(MK.expansion_model(v, 2), "ship_state")
    assert {s: m[s]["composite_score"] for s in m} == {"BIHAR": 3.0, "GOA": 4.0, "DELHI": 5.0}


def test_expansion_targets_empty(golden):
    assert MK.expansion_targets(C.load_clean(golden)).count() == 0


def test_monthly_trend(golden):
    t = K.monthly_trend(C.load_clean(golden)).collect()
    assert [r.year_month for r in t] == ["2022-04", "2022-05", "2022-06"]
    assert [float(r.revenue) for r in t] == [1000, 1000, 1000]
    assert t[0].revenue_mom_pct is None
    assert t[1].revenue_mom_pct == pytest.approx(0) and t[2].revenue_mom_pct == pytest.approx(0)


def test_methods_and_gap_rule(golden):
    v = C.load_clean(golden)
    r = rows(K.by_fulfillment_method(v), "fulfillment")
    assert float(r["Amazon"]["revenue"]) == 2000 and r["Amazon"]["orders"] == 2
    assert r["Amazon"]["fulfillment_rate"] == pytest.approx(200 / 3)
    assert r["Merchant"]["fulfillment_rate"] == pytest.approx(50)
    ins = IN.generate_insights(v).filter(F.col("rule_id") == "ins_method_gap").collect()
    assert len(ins) == 1 and ins[0].metric == pytest.approx(200 / 3 - 50)
    assert ins[0].impact == "High" and ins[0].metric_value == "16.7% fulfillment gap"


def test_b2b_rule_thresholds(spark):
    def share(s):
        return spark.createDataFrame([(float(s),)], "b2b_revenue_share double")
    assert IN.ins_b2b(share(5.0)).count() == 0
    assert IN.ins_b2b(share(5.1)).collect()[0].impact == "Medium"
    assert IN.ins_b2b(share(29.9)).collect()[0].category == "Growth"
    r = IN.ins_b2b(share(30.0)).collect()[0]
    assert (r.impact, r.category) == ("Low", "Revenue")


def test_mom_rule_thresholds(spark):
    def trend(last):
        return spark.createDataFrame(
            [("2022-01", 100.0, None), ("2022-02", 100.0, 0.0), ("2022-03", 100.0, float(last))],
            "year_month string, revenue double, revenue_mom_pct double")
    assert IN.ins_mom_trend(trend(-10.5)).collect()[0].impact == "High"
    assert IN.ins_mom_trend(trend(-10.0)).collect()[0].impact == "Medium"
    assert IN.ins_mom_trend(trend(-5.0)).count() == 0
    assert IN.ins_mom_trend(trend(15.0)).count() == 0
    assert IN.ins_mom_trend(trend(15.1)).collect()[0].category == "Growth"


def test_checks_low_rate_and_mom(spark):
    s = spark.createDataFrame([(59.9,)], "fulfillment_rate double")
    assert CK.chk_low_rate(s).collect()[0].severity == "critical"
    assert CK.chk_low_rate(spark.createDataFrame([(60.0,)], "fulfillment_rate double")).count() == 0
    t = spark.createDataFrame([("2022-01", 100.0), ("2022-02", 79.0)], "year_month string, revenue double")
    r = CK.chk_mom_drop(t).collect()[0]
    assert r.drop_percent == pytest.approx(21.0)
    t2 = spark.createDataFrame([("2022-01", 100.0), ("2022-02", 80.0)], "year_month string, revenue double")
    assert CK.chk_mom_drop(t2).count() == 0


def test_riskfree_and_category_thresholds(spark):
    from decimal import Decimal
    rows = [(f"S{i}", Decimal(10 * i), 96.0 if i in (1, 2) else 50.0) for i in range(1, 11)]
    states = spark.createDataFrame(rows, "ship_state string, revenue decimal(38,2), fulfillment_rate double")
    # 10 % quantile of 10..100 is 19: only S1 (10) qualifies; S2 (20) is above it
    r = IN.ins_riskfree(states).collect()
    assert len(r) == 1 and r[0].entity == "S1" and r[0].metric == 1.0
    assert r[0].title == "S1: near-perfect fulfillment, almost no revenue"
    cats = spark.createDataFrame([("a", Decimal(100)), ("b", Decimal(100)), ("c", Decimal(20))],
                                 "category string, revenue decimal(38,2)")
    f = CK.chk_category(cats).collect()          # mean 73.33, half of it 36.67 -> only c
    assert [x.entity for x in f] == ["c"] and f[0].message == "Category 'c' earns ₹20 vs avg ₹73"
