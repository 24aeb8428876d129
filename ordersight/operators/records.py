"""Application records handled as table jobs: latest status per key, job
summaries, e-mail de-duplication, subscription activity and expiry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_per_key(df: DataFrame, key: str, ts: str, tie: str, cols) -> DataFrame:
    """K7: last-write-wins record per key (latest ``ts``; ``tie`` breaks equal
    times). ``max_by`` is a partial aggregate, so a hot key is combined
    map-side and never gathered in one task."""
    latest = F.max_by(F.struct(*[F.col(c) for c in cols]), F.struct(F.col(ts), F.col(tie)))
    return df.groupBy(key).agg(latest.alias("r")).select(key, "r.*")


def upsert_status(events: DataFrame) -> DataFrame:
    """K7 over an event log: current status (last event type) per user."""
    return latest_per_key(events, "user_id", "ts", "event_id", ["event_type", "ts", "event_id"]) \
        .withColumnRenamed("event_type", "status").withColumnRenamed("ts", "updated_at")


def job_summary(status: DataFrame, reports: DataFrame, excerpt: int = 500) -> DataFrame:
    """K8: latest status per job left-joined with the first ``excerpt``
    characters of its report (null when no report yet)."""
    latest = latest_per_key(status, "job_id", "updated_at", "updated_at",
                            ["status", "updated_at"])
    rep = reports.select("job_id", F.substring("report_text", 1, excerpt).alias("report_preview"))
    return latest.join(rep, "job_id", "left")


def job_docs_join(kpis: DataFrame, insights: DataFrame, research: DataFrame) -> DataFrame:
    """A job's KPI record with its insight record (required: inner join)
    and its research record (optional: left join), all keyed by job_id."""
    return kpis.join(insights, "job_id", "inner").join(research, "job_id", "left")


def normalise_email(col="email"):
    c = F.col(col) if isinstance(col, str) else col
    return F.lower(F.trim(c))


def dedupe_email(users: DataFrame) -> DataFrame:
    """Normalise (lower + strip); the earliest row per address wins
    (``min_by`` over (created_at, id): a partial aggregate, so an address
    with very many rows is combined map-side, not gathered in one task)."""
    rest = [c for c in users.columns if c != "email"]
    first = F.min_by(F.struct(*[F.col(c) for c in rest]), F.struct("created_at", "id"))
    return (users.withColumn("email", normalise_email("email"))
                 .groupBy("email").agg(first.alias("r"))
                 .select(*[F.col(f"r.{c}").alias(c) for c in rest], "email"))


def new_keys_only(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming users whose normalised address is not stored yet (one per
    address)."""
    known = existing.select(normalise_email("email").alias("email_norm"))
    fresh = dedupe_email(incoming).withColumnRenamed("email", "email_norm")
    return fresh.join(known, "email_norm", "left_anti").withColumnRenamed("email_norm", "email")


def plan_end_date(start, plan) -> F.Column:
    """Monthly plans end after 30 days, others after 180."""
    s = F.col(start) if isinstance(start, str) else start
    p = F.col(plan) if isinstance(plan, str) else plan
    return F.when(p == "monthly", F.date_add(s, 30)).otherwise(F.date_add(s, 180))


def active_subscribers(users: DataFrame, subs: DataFrame, now) -> DataFrame:
    """Users with at least one active subscription ending after ``now``."""
    live = subs.filter((F.col("status") == "active") & (F.col("end_date") > F.lit(now)))
    return users.join(live.select(F.col("user_id").alias("id")), "id", "left_semi")


def active_flag(subs: DataFrame, now) -> DataFrame:
    """Per user, 1 when any row is active with an end in the future."""
    live = (F.col("status") == "active") & (F.col("end_date") > F.lit(now))
    return subs.groupBy("user_id").agg(F.max(live.cast("int")).alias("is_active"))


def expire_rows(subs: DataFrame, now, user_id=None) -> DataFrame:
    """Status -> 'expired' where active and ended at or before ``now``
    (optionally for one user); other rows unchanged."""
    cond = (F.col("status") == "active") & (F.col("end_date") <= F.lit(now))
    if user_id is not None:
        cond = cond & (F.col("user_id") == user_id)
    return subs.withColumn("status", F.when(cond, F.lit("expired")).otherwise(F.col("status")))


def reports_newest_first(reports: DataFrame, user_id) -> DataFrame:
    """One user's report rows, newest first."""
    return reports.filter(F.col("user_id") == user_id).orderBy(F.desc("created_at"))
