"""Updates of a stored table by copy-on-write."""

import pytest
from pyspark.sql import functions as F

from ordersight.sources.stored import StoredTable


def test_update_rewrites_only_the_files_that_hold_a_row(spark, tmp_path):
    df = spark.range(1000).select("id", (F.col("id") % 7).alias("v"), F.when(F.col("id") % 3 > 0, F.lit("x y")).alias("a b"))
    table = StoredTable(spark, str(tmp_path / "t able"))
    table.write(df, "id", 10)
    before = table.files()
    touched = table.update(F.col("id").between(100, 150), {"v": F.lit(99), "a b": F.col("id").cast("string")})
    assert 1 <= len(touched) <= 3 and set(before) - set(table.files()) == set(touched)
    hit = F.col("id").between(100, 150)
    want = df.select("id", F.when(hit, F.lit(99)).otherwise(F.col("v")).alias("v"), F.when(hit, F.col("id").cast("string")).otherwise(F.col("a b")).alias("a b"))
    assert sorted(map(str, table.read().collect())) == sorted(map(str, want.collect()))
    assert table.update(F.col("id") < 0, {"v": F.lit(1)}) == [] and table.update(F.lit(None).cast("boolean"), {"v": F.lit(1)}) == []
    now = table.files()
    with pytest.raises(Exception):
        table.update(F.col("id") < 5, {"v": F.raise_error(F.lit("no")).cast("long")})
    assert table.files() == now and table.read().count() == 1000
    assert table.update(F.col("a b").isNull(), {"a b": F.lit("none")}) and table.read().where(F.col("a b").isNull()).count() == 0
    assert table.vacuum() and table.vacuum() == [] and table.read().count() == 1000


def test_ranges_grow_with_the_rows_and_cut_a_frequent_value(spark, tmp_path):
    df = spark.range(1000).select("id", F.when(F.col("id") % 10 == 0, F.col("id")).alias("v"))  # nine tenths are null
    table = StoredTable(spark, str(tmp_path / "t"))
    table.write(df, "v", 2, most=100)
    sizes = [r["count"] for r in table.read().groupBy(F.col("_metadata.file_path")).count().collect()]
    assert len(sizes) >= 8 and max(sizes) <= 250 and sum(sizes) == 1000
    assert sorted(map(str, table.read().collect())) == sorted(map(str, df.collect())) and not list((tmp_path / "t" / "staged").glob("*"))
    assert len(table.update(F.col("v") == 500, {"v": F.lit(1)})) == 1
