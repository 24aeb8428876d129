"""Disk of the periodic refresh: compressed exports, slices and steps, shuffle files that go after each write."""

import gzip
import random
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from ordersight.operators import clean as C
from ordersight.session import SHUFFLES_GO, settings
from ordersight.sources import files as FS
from ordersight.sources import star as ST
from ordersight.streaming import refresh as RF
from test_refresh import lines, same_as_batch


def shuffle_files(spark):
    dirs = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return {str(f) for d in dirs for f in Path(d.getPath()).rglob("shuffle_*.data")}


def none_left(spark, before):
    for _ in range(40):  # they are deleted in the background
        if not shuffle_files(spark) - before:
            return True
        time.sleep(0.25)
    return False


def test_settings_hold_within_the_block_only(spark):
    key = next(iter(SHUFFLES_GO))
    before = spark.conf.get(key, None)
    with pytest.raises(KeyError), settings(spark, SHUFFLES_GO | {"spark.sql.shuffle.partitions": "3"}):
        assert spark.conf.get(key) == "true" and spark.conf.get("spark.sql.shuffle.partitions") == "3"
        raise KeyError
    assert spark.conf.get(key, None) == before and spark.conf.get("spark.sql.shuffle.partitions") == "8"


def test_an_export_is_compressed_and_leaves_no_shuffle_files(spark, tmp_path):
    data = [(str(k % 50) if k % 5 else None, f"a, \"b\" and more of the same text {k % 3}") for k in range(3000)]
    df = spark.createDataFrame(data, "id string, note string").repartition(3)
    before = shuffle_files(spark)
    path = FS.deal_csv_export(df, str(tmp_path / "units"), F.col("id").cast("long") % 2, 2)
    assert none_left(spark, before)
    files = [f for f in Path(path).rglob("part-*") if f.is_file()]
    assert files and all(f.name.endswith(".csv.gz") for f in files)
    assert sum(f.stat().st_size for f in files) * 4 < sum(len(gzip.decompress(f.read_bytes())) for f in files)
    got = FS.scan_csv_raw(spark, [f"{path}/unit-{k}" for k in range(2)]).select("id", "note").collect()
    assert sorted(map(tuple, got)) == sorted(r for r in data if r[0])


@pytest.mark.parametrize("slices", [1, 3])
def test_an_export_in_slices_has_every_row_once(spark, tmp_path, slices):
    data = [(str(k % 7) if k % 5 else None, k) for k in range(90)]
    df = spark.createDataFrame(data, "id string, n long")
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(len(b))
            yield b
    # the slices' column is null in some rows, which belong to one of the slices as well
    path = FS.deal_csv_export(df.repartition(2, "n").mapInArrow(count, df.schema), str(tmp_path / "units"), F.col("n") % 2, 2, F.col("id"), slices)
    assert seen.value == len(data) * slices  # a source without a filter to push down is run for each slice
    for k in range(2):
        got = spark.read.option("header", True).csv(f"{path}/unit-{k}")
        assert sorted((str(r[0]), int(r[1])) for r in got.collect()) == sorted((str(i), n) for i, n in data if n % 2 == k)


def test_compressed_files_are_read_and_watched(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    text = 'Order ID,Amount,ship-state,Note\n1,10,goa,"one\n""two"", three"\n2,20,goa,x\n'
    (src / "a.csv.gz").write_bytes(gzip.compress(text.encode()))
    (src / "b.csv").write_text("Amount,Order ID\n30,3\n")
    df = FS.scan_csv(spark, str(src))
    assert sorted((r["order_id"], r["amount"], r["Note"]) for r in df.collect()) == [("1", "10", 'one\n"two", three'), ("2", "20", "x"), ("3", "30", None)]
    assert C.load_clean(df).count() == 3
    assert sorted(Path(r["unit"]).name for r in RF.AR.arrivals(spark, str(src)).collect()) == ["a.csv.gz", "b.csv"]


def test_partials_and_totals_leave_no_shuffle_files(spark, tmp_path):
    rng = random.Random(6)
    src, out = tmp_path / "in", str(tmp_path / "out")
    src.mkdir()
    for name in "ab":
        (src / f"{name}.csv").write_text(lines(rng, 40))
    for name in "ab":
        before = shuffle_files(spark)
        RF.store_partials(spark, str(src / f"{name}.csv"), out, f"{name}.csv")
        assert none_left(spark, before)
        before = shuffle_files(spark)
        assert RF.merge(spark, out)
        assert none_left(spark, before)
    same_as_batch(spark, src, out)


def test_a_merge_in_steps_equals_batch(spark, tmp_path, monkeypatch):
    rng = random.Random(7)
    src, out = tmp_path / "in", str(tmp_path / "out")
    src.mkdir()
    monkeypatch.setattr(RF._Tables, "size", lambda self, table: RF.STEP_BYTES if self.versions else 0)
    steps, stepped = [], RF._stepped

    def noted(spark, n, of_step):
        steps.append(n)
        return stepped(spark, n, of_step)
    monkeypatch.setattr(RF, "_stepped", noted)

    def step(**files):
        time.sleep(1.1)
        for name, n in files.items():
            (src / f"{name}.csv").write_text(lines(rng, n))
        assert RF.refresh(spark, str(src), out)
        same_as_batch(spark, src, out)
    step(a=40, b=30)
    step(a=10, c=25)  # one rewritten, one new, one as it was
    assert steps == [2, 4]


def test_a_steps_orders_are_in_no_other(spark, tmp_path):
    rng = random.Random(8)
    out = str(tmp_path / "out")
    (tmp_path / "a.csv").write_text(lines(rng, 200))
    RF.store_partials(spark, str(tmp_path / "a.csv"), out, "a.csv")
    store = RF.JobStore(spark, out)
    every = RF._Tables(store, store.manifests())
    whole = sorted(r["order_id"] for r in every.orders(0, 1).collect())
    parts = [[r["order_id"] for r in every.orders(k, 4).collect()] for k in range(4)]
    assert whole and sorted(x for p in parts for x in p) == whole and sum(map(bool, parts)) > 1
    assert every.size("orders") > 0


TABLES = {
    "region": ("r_regionkey int, r_name string", [(0, "R0"), (1, "R1"), (1, "R1b"), (None, "RN")]),
    "nation": ("n_nationkey int, n_name string, n_regionkey int", [(0, "N0", 0), (1, "N1", 1), (2, "N2", None), (None, "NN", 0)]),
    "customer": ("c_custkey long, c_nationkey int, c_mktsegment string", [(1, 0, "HOUSEHOLD"), (2, 1, "MACHINERY"), (2, 0, "AUTO"), (3, None, "AUTO"), (None, 0, "AUTO"), (4, 2, "AUTO")]),
    "part": ("p_partkey long, p_name string, p_type string, p_brand string, p_size int", [(1, "a", "T", "B", 1), (1, "b", "T", "B", 2), (2, "c", None, "B", 3), (None, "d", "T", "B", 4)]),
    "orders": ("o_orderkey long, o_custkey long, o_orderstatus string, o_orderdate date", [(10, 1, "F", None), (10, 2, "P", None), (11, 2, "O", None), (12, None, "F", None), (None, 1, "F", None), (13, 4, "F", None), (14, 3, "F", None)]),
    "lineitem": ("l_orderkey long, l_partkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_returnflag string, l_linestatus string",
                 [(o, p, n, 1.0, 2.5, "N", "F") for o in (10, 11, 12, 13, 14, 15, None) for p in (1, 2, 3, None) for n in (1, 1, 2)]),
}


def test_order_lines_are_joined_with_orders_that_have_their_customer(spark, tmp_path):
    t = {}
    for name, (schema, rows) in TABLES.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
        t[name] = rows
    want = sorted((str(li[0]), pa[1], f"City_{o[1] % 50}", r[1]) for li in t["lineitem"] for o in t["orders"] for c in t["customer"] for n in t["nation"] for r in t["region"] for pa in t["part"]
                  if all(a is not None and a == b for a, b in ((li[0], o[0]), (o[1], c[0]), (c[1], n[0]), (n[2], r[0]), (li[1], pa[0]))))
    view = ST.sales_view(spark, str(tmp_path))
    assert sorted((r["order_id"], r["style"], r["ship_city"], r["ship_country"]) for r in view.collect()) == want and want
    plan = view._jdf.queryExecution().optimizedPlan().toString().splitlines()
    at, depth = next((k, len(x) - len(x.lstrip(" :+-"))) for k, x in enumerate(plan) if "Join Inner, (o_custkey" in x)
    below = []
    for x in plan[at + 1:]:
        if len(x) - len(x.lstrip(" :+-")) <= depth:
            break
        below.append(x)
    assert any("c_custkey" in x for x in below) and not any("l_partkey" in x for x in below)
