"""Incremental refresh equals the batch result after every trigger."""

import random
import time

from pyspark.sql import functions as F

from ordersight.operators import bundle as B
from ordersight.operators.bundle import kpi_bundle
from ordersight.operators.clean import load_clean
from ordersight.sources import files as FS
from ordersight.sources.files import scan_csv
from ordersight.sources.jobs import JobStore
from ordersight.streaming import refresh as RF

HEADER = "Order ID,Date,Status,Fulfilment,Sales Channel ,Category,Qty,Amount,ship-city,ship-state,B2B\n"


def lines(rng, n):
    """Few order ids, so that orders have lines in many files; some without an id, a state or a date."""
    out = []
    for _ in range(n):
        out.append(",".join([rng.choice(["", *[f"o{i}" for i in range(25)]]), rng.choice(["04-30-22", "05-01-22", "bad"]), rng.choice(["Shipped", "Cancelled"]),
                             rng.choice(["Amazon", "Merchant", ""]), "Amazon.in", rng.choice(["Set", "Kurta"]), "1", rng.choice(["10", "20.5", "0", "x"]),
                             "Pune", rng.choice(["goa", "delhi", ""]), rng.choice(["True", "False"])]))
    return HEADER + "\n".join(out) + "\n"


def rows(df):
    return sorted(str(tuple(r)) for r in df.collect())


def same_as_batch(spark, src, out):
    want = kpi_bundle(load_clean(scan_csv(spark, str(src)))).record()
    got = RF.refreshed(spark, out).record()
    assert set(got) == set(want)
    for name in want:
        assert rows(got[name]) == rows(want[name]), name


def test_refresh_equals_batch_after_every_trigger(spark, tmp_path):
    rng = random.Random(1)
    src, out = tmp_path / "in", str(tmp_path / "out")
    src.mkdir()

    def step(**files):
        time.sleep(1.1)
        for name, n in files.items():
            (src / f"{name}.csv").write_text(lines(rng, n))
        assert RF.refresh(spark, str(src), out)
        same_as_batch(spark, src, out)
    step(a=40, b=30)
    step(c=25)
    step(a=10)  # rewritten, shorter
    step(b=35, d=5)
    assert not RF.refresh(spark, str(src), out)  # a replay finds nothing to do
    store = JobStore(spark, out)
    # a refresh that stops between the units and the totals is made up for
    (src / "c.csv").write_text(lines(rng, 12))
    RF.AR.poll(spark, str(src), out, run=RF.store_partials)
    assert RF.merge(spark, out) and not RF.merge(spark, out)
    same_as_batch(spark, src, out)
    # without the version that the totals name, they are made anew
    for _ in range(2):
        RF.store_partials(spark, str(src / "a.csv"), out, "a.csv", {k: v for k, v in store.manifest("a.csv").items() if k in ("unit", "modified", "length", "files")})
    assert RF.merge(spark, out)
    same_as_batch(spark, src, out)


def test_refresh_by_stream(spark, tmp_path):
    rng = random.Random(2)
    src, out = tmp_path / "in", str(tmp_path / "out")
    src.mkdir()
    (src / "a.csv").write_text(lines(rng, 30))
    q = RF.start(spark, str(src), out, str(tmp_path / "ckpt"), interval=None)
    q.awaitTermination()
    assert q.exception() is None
    same_as_batch(spark, src, out)


def test_other_units_lines_are_not_read_again(spark, tmp_path):
    rng = random.Random(3)
    src, out = tmp_path / "in", str(tmp_path / "out")
    src.mkdir()
    for name in "ab":
        (src / f"{name}.csv").write_text(lines(rng, 20))
    RF.refresh(spark, str(src), out)
    versions = {m["job_id"]: m["version"] for m in JobStore(spark, out).manifests()}
    (src / "c.csv").write_text(lines(rng, 20))
    RF.refresh(spark, str(src), out)
    after = {m["job_id"]: m["version"] for m in JobStore(spark, out).manifests()}
    assert [after[j] == versions[j] for j in ("a.csv", "b.csv")] == [True, True] and after["_totals"] != versions["_totals"]
    assert RF.refreshed(spark, out).totals.select(F.col("lines") > 0).first()[0]


def test_a_unit_keeps_one_row_per_order(spark, tmp_path):
    rng = random.Random(4)
    src, out = tmp_path / "in", str(tmp_path / "out")
    src.mkdir()
    for name in "ab":
        (src / f"{name}.csv").write_text(lines(rng, 60))
    RF.refresh(spark, str(src), out)
    store = JobStore(spark, out)
    for unit in ("a.csv", "b.csv"):
        orders = store.read(unit, "orders")
        assert orders.count() == orders.select("order_id").distinct().count() > 0
        assert orders.where("size(keys) <> size(array_distinct(keys))").count() == 0


def test_order_counts_of_odd_values(spark):
    """Null, empty and marked values, a colon within a value, an order with most lines, lines without an order."""
    rng = random.Random(5)
    values = [None, "", "v", ":", "v:", "1:v2", "goa"]
    data = [(rng.choice([None, "", "hot", "hot", "hot", "o1", "o2", "o3"]), *[rng.choice(values) for _ in range(5)], rng.choice([None, 0, 1])) for _ in range(400)]
    dims = ["ship_state", "category", "year_month", "fulfillment", "sales_channel", "is_b2b"]
    df = spark.createDataFrame(data, "order_id string, " + ", ".join(f"{d} string" for d in dims[:-1]) + ", is_b2b int")
    want = {}
    for order, *of in data:
        if order is not None:
            for gid, key in [(B._gid(d, dims), None if x is None else str(x)) for d, x in zip(dims, of)] + [(B._gid(None, dims), None)]:
                want.setdefault((gid, key), set()).add(order)
    assert {(r["gid"], r["key"]): r["orders"] for r in B.order_counts(df).collect()} == {k: len(v) for k, v in want.items()}
    per = B.order_values(df).collect()
    assert len(per) == 5 and max(len(r["keys"]) for r in per) <= 5 * len(values) + 4


def test_export_is_dealt_in_one_pass(spark, tmp_path):
    data = [(str(k) if k % 5 else None, "a, \"b\"" if k % 2 else " x ") for k in range(40)]
    df = spark.createDataFrame(data, "id string, note string")
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(len(b))
            yield b
    path = FS.deal_csv_export(df.mapInArrow(count, df.schema), str(tmp_path / "units"), F.col("id").cast("long") % 2, 3)
    assert seen.value == len(data)  # what the export is made from runs once, not once a unit
    for k in range(3):
        got = spark.read.option("header", True).option("escape", '"').csv(f"{path}/unit-{k}")
        assert got.columns == df.columns
        assert sorted(map(tuple, got.collect())) == sorted(r for r in data if r[0] and int(r[0]) % 2 % 3 == k)
    FS.move_export(spark, f"{path}/unit-1", f"{path}/unit-0")
    assert spark.read.option("header", True).csv(f"{path}/unit-0").count() == sum(1 for r in data if r[0] and int(r[0]) % 2)
