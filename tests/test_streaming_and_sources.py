"""CSV sources and the streaming folder watch (FIXTURES.md section 6)."""

import os

from pyspark.sql import functions as F

from ordersight.operators import clean as C
from ordersight.operators import kpis as K
from ordersight.sources import files as FS
from ordersight.sources.star import raw_export_view, sales_view
from ordersight.streaming import watch as WT

SF = "/root/testdata/sf0.001"


def test_csv_roundtrip_matches_typed_path(spark, tmp_path):
    path = FS.write_csv_export(raw_export_view(spark, SF), str(tmp_path / "csv"), files=2)
    via_csv = K.revenue_by_state(C.load_clean(FS.scan_csv(spark, path))).collect()
    typed = K.revenue_by_state(C.load_clean(sales_view(spark, SF))).collect()
    assert [tuple(r) for r in via_csv] == [tuple(r) for r in typed]


def test_stream_per_file_equals_batch(spark, tmp_path):
    raw = raw_export_view(spark, SF)
    parity = F.col("Order ID").cast("long") % 2
    src = str(tmp_path / "in")
    for p in (0, 1):
        FS.write_csv_export(raw.filter(parity == p), os.path.join(src, f"part{p}"), files=1)
    # the watched folder receives the two files one after the other
    watched = str(tmp_path / "watched")
    os.makedirs(watched)
    out, ckpt = str(tmp_path / "out"), str(tmp_path / "ckpt")
    for p in (0, 1):
        f = [x for x in os.listdir(os.path.join(src, f"part{p}")) if x.endswith(".csv")][0]
        os.link(os.path.join(src, f"part{p}", f), os.path.join(watched, f"export{p}.csv"))
        q = WT.watch_csv_dir(spark, watched, out, ckpt)
        q.awaitTermination()
    res = spark.read.parquet(out)
    assert res.select("source_file").distinct().count() == 2
    for p in (0, 1):
        got = (res.filter(F.col("source_file").endswith(f"export{p}.csv"))
                  .select("ship_state", "revenue", "orders").orderBy("ship_state").collect())
        batch = C.load_clean(C.rename_canonical(C.trim_headers(raw.filter(parity == p))))
        want = (K.revenue_by_state(batch).select("ship_state", "revenue", "orders")
                  .orderBy("ship_state").collect())
        assert [tuple(r) for r in got] == [tuple(r) for r in want]


def test_periodic_refresh_and_sinks(spark, tmp_path):
    from ordersight.sources import sinks as SK
    src = str(tmp_path / "in")
    FS.write_csv_export(raw_export_view(spark, SF), src, files=1)
    out, ckpt = str(tmp_path / "out"), str(tmp_path / "ckpt")
    q = WT.periodic_refresh(spark, src, out, ckpt, interval="1 second")
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert spark.read.parquet(out).select("ship_state").distinct().count() == 25
    # per-job partitions: re-running a job replaces only its own partition
    v = C.load_clean(sales_view(spark, SF))
    path = str(tmp_path / "kpis")
    SK.sink_kpis({"rbs": K.revenue_by_state(v)}, path, "a")
    SK.sink_kpis({"rbs": K.revenue_by_state(v).limit(3)}, path, "b")
    SK.sink_kpis({"rbs": K.revenue_by_state(v).limit(5)}, path, "a")
    assert SK.read_job(spark, path + "/rbs", "a").count() == 5
    assert SK.read_job(spark, path + "/rbs", "b").count() == 3


def test_two_files_in_one_batch_stay_apart(spark, tmp_path):
    raw = raw_export_view(spark, SF)
    parity = F.col("Order ID").cast("long") % 2
    watched = str(tmp_path / "watched")
    os.makedirs(watched)
    for p in (0, 1):
        d = str(tmp_path / f"part{p}")
        FS.write_csv_export(raw.filter(parity == p), d, files=1)
        f = [x for x in os.listdir(d) if x.endswith(".csv")][0]
        os.link(os.path.join(d, f), os.path.join(watched, f"export{p}.csv"))
    out, ckpt = str(tmp_path / "out"), str(tmp_path / "ckpt")
    WT.watch_csv_dir(spark, watched, out, ckpt).awaitTermination()
    res = spark.read.parquet(out)
    assert res.select("batch_id").distinct().count() == 1
    for p in (0, 1):
        got = (res.filter(F.col("source_file").endswith(f"export{p}.csv"))
                  .select("ship_state", "revenue", "orders", "revenue_share_pct")
                  .orderBy("ship_state").collect())
        batch = C.load_clean(C.rename_canonical(C.trim_headers(raw.filter(parity == p))))
        want = (K.revenue_by_state(batch).select("ship_state", "revenue", "orders", "revenue_share_pct")
                  .orderBy("ship_state").collect())
        assert [tuple(r) for r in got] == [tuple(r) for r in want]


def test_watched_export_is_many_files(spark, monkeypatch):
    """The registered query's export: many files, no order in two of them, and each file's table equals plain Python's."""
    from ordersight.functions.flags import fulfilled
    from ordersight.plans import queries as Q
    seen = []
    watch = WT.watch_csv_dir
    monkeypatch.setattr(Q.WT, "watch_csv_dir", lambda s, src, out, ckpt: seen.append((src, out)) or watch(s, src, out, ckpt))
    total = {r.ship_state: r for r in Q.q_watch_csv_dir(spark, SF).collect()}
    (src, out), = seen
    raw = spark.read.option("header", True).option("escape", '"').csv(src).withColumn("file", F.col("_metadata.file_path"))
    raw = C.rename_canonical(C.trim_headers(raw)).withColumn("ok", fulfilled(F.trim("status"))).collect()
    assert len({r.file for r in raw}) > 1
    assert len({(r.file, r.order_id) for r in raw}) == len({r.order_id for r in raw})
    want = {}
    for r in raw:
        if r.amount and float(r.amount) > 0:
            at = want.setdefault((r.file, r.ship_state.strip().upper()), [0, set(), 0, 0])
            at[0] += round(float(r.amount) * 100)
            at[1].add(r.order_id)
            at[2] += r.ok
            at[3] += 1
    got = {(r.source_file, r.ship_state): r for r in spark.read.parquet(out).collect()}
    assert set(got) == set(want)
    for k, (cents, orders, ok, lines) in want.items():
        r = got[k]
        assert (round(r.revenue * 100), r.orders, r.fulfilled, r.lines) == (cents, len(orders), ok, lines)
        file_cents = sum(w[0] for (f, _), w in want.items() if f == k[0])
        assert abs(r.fulfillment_rate - ok / lines * 100) < 1e-9 and abs(r.revenue_share_pct - cents / file_cents * 100) < 1e-9
    for state, r in total.items():
        of = [w for (_, s), w in want.items() if s == state]
        assert (round(r.revenue * 100), r.orders) == (sum(w[0] for w in of), sum(len(w[1]) for w in of))
