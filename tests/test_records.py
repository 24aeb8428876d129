"""Record behaviours of the storage tests, as table jobs."""

import datetime as dt

from ordersight.operators import records as RC

NOW = dt.datetime(2024, 6, 1)


def subs(spark):
    rows = [("s1", "u1", "monthly", dt.datetime(2024, 5, 1), dt.datetime(2024, 5, 31), "active"),
            ("s2", "u1", "sixmonth", dt.datetime(2024, 5, 1), dt.datetime(2024, 10, 28), "active"),
            ("s3", "u2", "monthly", dt.datetime(2024, 4, 1), dt.datetime(2024, 5, 1), "active"),
            ("s4", "u3", "monthly", dt.datetime(2024, 5, 20), dt.datetime(2024, 6, 19), "expired")]
    return spark.createDataFrame(rows, "id string, user_id string, plan string, start_date timestamp, "
                                       "end_date timestamp, status string")


def test_case_insensitive_duplicate_rejected(spark):
    users = spark.createDataFrame(
        [("1", "A@x.com ", dt.datetime(2024, 1, 1)), ("2", "a@X.com", dt.datetime(2024, 1, 2))],
        "id string, email string, created_at timestamp")
    d = RC.dedupe_email(users).collect()
    assert len(d) == 1 and d[0].id == "1" and d[0].email == "a@x.com"
    existing = spark.createDataFrame([("a@x.com",)], "email string")
    incoming = spark.createDataFrame([("9", "A@X.COM", dt.datetime(2024, 2, 1)),
                                      ("8", "b@x.com", dt.datetime(2024, 2, 1))],
                                     "id string, email string, created_at timestamp")
    assert [r.email for r in RC.new_keys_only(existing, incoming).collect()] == ["b@x.com"]


def test_expired_not_active_and_one_of_several(spark):
    s = subs(spark)
    flags = {r.user_id: r.is_active for r in RC.active_flag(s, NOW).collect()}
    assert flags == {"u1": 1, "u2": 0, "u3": 0}
    users = spark.createDataFrame([("u1",), ("u2",), ("u3",)], "id string")
    assert [r.id for r in RC.active_subscribers(users, s, NOW).collect()] == ["u1"]


def test_expiry_touches_only_one_user(spark):
    s = subs(spark)
    out = {r.id: r.status for r in RC.expire_rows(s, NOW, user_id="u1").collect()}
    assert out == {"s1": "expired", "s2": "active", "s3": "active", "s4": "expired"}


def test_plan_end_date(spark):
    df = spark.createDataFrame([("monthly", dt.date(2024, 1, 1)), ("sixmonth", dt.date(2024, 1, 1))],
                               "plan string, start date")
    ends = [r.e for r in df.select(RC.plan_end_date("start", "plan").alias("e")).collect()]
    assert ends == [dt.date(2024, 1, 31), dt.date(2024, 6, 29)]


def test_latest_status_and_job_summary(spark):
    st = spark.createDataFrame([("j1", "ingesting", dt.datetime(2024, 1, 1, 10)),
                                ("j1", "completed", dt.datetime(2024, 1, 1, 11)),
                                ("j2", "failed", dt.datetime(2024, 1, 1, 9))],
                               "job_id string, status string, updated_at timestamp")
    rep = spark.createDataFrame([("j1", "x" * 800)], "job_id string, report_text string")
    out = {r.job_id: r for r in RC.job_summary(st, rep).collect()}
    assert out["j1"].status == "completed" and len(out["j1"].report_preview) == 500
    assert out["j2"].report_preview is None


def test_job_docs_join(spark):
    k = spark.createDataFrame([("j1", 10.0), ("j2", 20.0), ("j3", 5.0)], "job_id string, total_revenue double")
    i = spark.createDataFrame([("j1", 3), ("j2", 1)], "job_id string, total_issues int")
    r = spark.createDataFrame([("j1", "overview")], "job_id string, market_overview string")
    out = {x.job_id: x for x in RC.job_docs_join(k, i, r).collect()}
    assert set(out) == {"j1", "j2"}
    assert out["j1"].market_overview == "overview" and out["j2"].market_overview is None


def test_reports_newest_first(spark):
    rep = spark.createDataFrame([("u1", "a.csv", dt.datetime(2024, 1, 1)),
                                 ("u1", "b.csv", dt.datetime(2024, 3, 1)),
                                 ("u2", "c.csv", dt.datetime(2024, 2, 1)),
                                 ("u1", "d.csv", dt.datetime(2024, 2, 1))],
                                "user_id string, filename string, created_at timestamp")
    assert [r.filename for r in RC.reports_newest_first(rep, "u1").collect()] == ["b.csv", "d.csv", "a.csv"]
