"""Shards along a Hilbert curve over metadata dimensions.

Each dimension is quantised to 2^bits cells: a number by its approximate quantiles
(one small aggregate), a name by its hash. The cells' place on the Hilbert curve
orders the rows; runs of equal length are cut into shards, so a shard covers a
compact region in all dimensions and a reader can skip files by any of them.

Places are found without a global sort: rows are counted per cell and hash slice of
the rows; running sums over the at most 2^(bits * dimensions) cells, and over the
slices within each cell, give every (cell, slice) its first place; only within
those are rows numbered, so a cell that holds a third of all rows is split into
``slices`` parts. The text is read once, for its size and checksum, and is not
shuffled. DataFrame functions only.

Defined results: a null text has size 16 and the checksum of no bytes; a null
number is in the lowest cell, a null name a name of its own; ties in all
dimensions are ordered by a hash of the row, then by its columns (equal rows may
swap places); an empty table gives no rows; other columns are never read by name.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F


@dataclass(frozen=True)
class Dimension:
    """A metadata column to quantise: ``kind`` is ``number`` or ``name``."""

    column: str
    kind: str


DIMENSIONS = (Dimension("lang", "name"), Dimension("source", "name"), Dimension("n_chars", "number"), Dimension("doc_id", "number"))


def quantised(docs: DataFrame, dims: tuple[Dimension, ...], bits: int) -> list[Column]:
    """One cell number from 0 to 2^bits - 1 for each dimension."""
    cells = 1 << bits
    numbers = [d.column for d in dims if d.kind == "number"]
    cuts: dict[str, list[float]] = {}
    if numbers:  # 2^bits - 1 cut points a column reach the driver
        marks = [k / cells for k in range(1, cells)]
        row = docs.agg(*[F.percentile_approx(F.col(c).cast("double"), marks).alias(f"q{i}") for i, c in enumerate(numbers)]).first()
        cuts = {c: [float(x) for x in row[i] or []] for i, c in enumerate(numbers)}
    out = []
    for d in dims:
        if d.kind == "name":
            out.append(F.pmod(F.xxhash64(d.column), F.lit(cells)).cast("int"))
        else:
            value = F.col(d.column).cast("double")
            out.append(sum((F.when(value > x, 1).otherwise(0) for x in cuts[d.column]), F.lit(0)))
    return out


def with_curve(cells: DataFrame, names: list[str], bits: int) -> DataFrame:
    """Adds ``curve``, the place of the cell ``names`` on the Hilbert curve.

    The public transpose method: undo excess rotations from the highest bit down,
    Gray-encode, interleave the bits.
    """
    n = len(names)
    for q in (1 << k for k in range(bits - 1, 0, -1)):
        p = q - 1
        for i, x in enumerate(names):
            set_ = F.col(x).bitwiseAND(q) != 0
            swap = F.col(names[0]).bitwiseXOR(F.col(x)).bitwiseAND(p)
            new = {names[0]: F.when(set_, F.col(names[0]).bitwiseXOR(p)).otherwise(F.col(names[0]).bitwiseXOR(swap))}
            if i:
                new[x] = F.when(set_, F.col(x)).otherwise(F.col(x).bitwiseXOR(swap))
            cells = cells.withColumns(new)
    for a, b in zip(names, names[1:]):
        cells = cells.withColumn(b, F.col(b).bitwiseXOR(F.col(a)))
    cells = cells.withColumn("_t", F.lit(0))
    for q in (1 << k for k in range(bits - 1, 0, -1)):
        cells = cells.withColumn("_t", F.when(F.col(names[-1]).bitwiseAND(q) != 0, F.col("_t").bitwiseXOR(q - 1)).otherwise(F.col("_t")))
    cells = cells.withColumns({x: F.col(x).bitwiseXOR(F.col("_t")) for x in names}).drop("_t")
    place = F.lit(0).cast("long")
    for bit in range(bits - 1, -1, -1):
        for i, x in enumerate(names):
            place = place + F.shiftleft(F.shiftright(F.col(x), bit).bitwiseAND(1).cast("long"), bit * n + n - 1 - i)
    return cells.withColumn("curve", place)


def shards(docs: DataFrame, count: int = 40, dims: tuple[Dimension, ...] = DIMENSIONS, bits: int = 4, slices: int = 1024) -> DataFrame:
    """``doc_id, size, text_crc32, curve, shard, slot`` of every row; shards' row counts are at most one apart."""
    axes = [f"_x{i}" for i in range(len(dims))]
    body = F.coalesce(docs["text"].cast("string"), F.lit(""))
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), (F.octet_length(body).cast("long") + 16).alias("size"),
                       F.crc32(body.cast("binary")).alias("text_crc32"),
                       *[c.alias(x) for x, c in zip(axes, quantised(docs, dims, bits))])
    cell = sum((F.col(x).cast("long") * (1 << (bits * i)) for i, x in enumerate(axes)), F.lit(0).cast("long"))
    rows = rows.select("doc_id", "size", "text_crc32", cell.alias("cell"),
                       F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(slices)).alias("slice"))

    parts = rows.groupBy("cell", "slice").agg(F.count("*").alias("n"))
    per_cell = parts.groupBy("cell").agg(F.sum("n").alias("cell_n"))
    unpacked = [F.shiftright(F.col("cell"), bits * i).bitwiseAND((1 << bits) - 1).cast("int").alias(x) for i, x in enumerate(axes)]
    curved = with_curve(per_cell.select("cell", "cell_n", *unpacked), axes, bits)
    along = Window.orderBy("curve")  # one row per occupied cell: at most 2^(bits * dimensions)
    first = curved.select("cell", "curve", (F.sum("cell_n").over(along) - F.col("cell_n")).alias("cell_first"),
                          F.sum("cell_n").over(Window.partitionBy()).alias("total"))
    inner = Window.partitionBy("cell").orderBy("slice")
    offsets = (parts.withColumn("before", F.sum("n").over(inner) - F.col("n")).join(first, "cell")
                    .select("cell", "slice", "curve", (F.col("cell_first") + F.col("before")).alias("first"), "total"))

    number = F.row_number().over(Window.partitionBy("cell", "slice").orderBy("doc_id", "text_crc32", "size"))
    placed = rows.withColumn("place", number - 1).join(offsets, ["cell", "slice"]).withColumn("place", F.col("first") + F.col("place"))
    short, long_ = F.expr(f"total div {count}"), F.expr(f"total % {count}")  # the first shards hold one row more
    edge = long_ * (short + 1)
    in_long = F.col("place") < edge
    place_in = F.col("place") - edge
    shard = F.when(in_long, F.expr(f"place div (total div {count} + 1)")).otherwise(long_ + F.floor(place_in / F.greatest(short, F.lit(1))))
    slot = F.when(in_long, F.col("place") % (short + 1)).otherwise(place_in % F.greatest(short, F.lit(1)))
    return placed.select("doc_id", "size", "text_crc32", "curve", shard.cast("int").alias("shard"), slot.cast("long").alias("slot"))


def manifest(docs: DataFrame, assigned: DataFrame, dims: tuple[Dimension, ...] = DIMENSIONS) -> DataFrame:
    """Per shard its rows, bytes, and smallest and largest value of every dimension, for pruning."""
    values = docs.select(docs["doc_id"].cast("long").alias("_id"), *[F.col(d.column).alias(f"_{d.column}") for d in dims])
    both = assigned.join(values, F.col("doc_id").eqNullSafe(F.col("_id")))
    return both.groupBy("shard").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes"),
                                     *[f(f"_{d.column}").alias(f"{n}_{d.column}") for d in dims for n, f in (("min", F.min), ("max", F.max))])


def write_shards(docs: DataFrame, path: str, count: int = 40) -> None:
    """Write ``docs`` as one folder per shard, rows in the order of their slots."""
    assigned = shards(docs, count).select(F.col("doc_id").alias("_id"), F.col("text_crc32").alias("_crc"), "shard", "slot")
    crc = F.crc32(F.coalesce(docs["text"].cast("string"), F.lit("")).cast("binary"))
    (docs.join(assigned.dropDuplicates(["_id", "_crc"]), docs["doc_id"].eqNullSafe(F.col("_id")) & (crc == F.col("_crc"))).drop("_id", "_crc")
         .repartition(count, "shard").sortWithinPartitions("shard", "slot").write.mode("overwrite").partitionBy("shard").parquet(path))
