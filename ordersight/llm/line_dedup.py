"""Line de-duplication by range partitioning with secondary sort.

Each line's key (stripped, lower-cased) becomes a 128-bit hash; rows
(hash, document, line number) are range-partitioned and sorted on ALL those
columns, so a line that a third of the documents share is spread over many
partitions instead of meeting in one task. Every partition streams its rows once
and keeps only the current key's first document as state. What a partition can't
decide alone is its first key, which may have begun in the partition before:
rows of that key's first local document are marked, and resolved against the
partitions' last keys (one row per partition).

The result is one compressed keep bitmap per document that loses lines, not text.

Defined results: null text is one empty line; a null ``doc_id`` is a document
after all others; rows with one ``doc_id`` are one document (none of its lines
is dropped for another of its own rows); equal rows get equal bitmaps; an empty
table gives no bitmaps; other columns are never read by name.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from ordersight.llm.common import Scratch, keyed_text, partitions, slices

ROWS = "h1 long, h2 long, doc_id long, text_key long, line int"
FLAGS = ROWS + ", kind int"
DROP, UNSURE, LAST = 0, 1, 2
BITMAPS = "doc_id long, text_key long, n_dropped int, keep binary"


def line_key(line: bytes) -> bytes:
    """Key of one line: ASCII white space stripped at both ends, A-Z lower-cased."""
    return line.strip(b"\x20\x09\x0a\x0b\x0c\x0d").lower()


def _line_rows(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            digests, doc, at = [], [], []
            for i, body in enumerate(batch.column("body").to_pylist()):
                for n, line in enumerate(body.split(b"\n")):
                    key = line_key(line)
                    if len(key) >= min_chars and (len(key) >= 4 * min_chars or len(key.decode("utf-8", "replace")) >= min_chars):
                        digests.append(xxhash.xxh3_128_digest(key))
                        doc.append(i)
                        at.append(n)
            halves = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            take = pa.array(doc, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(halves[:, 0]), pa.array(halves[:, 1]), batch.column("doc_id").take(take),
                 batch.column("text_key").take(take), pa.array(at, pa.int32())],
                ["h1", "h2", "doc_id", "text_key", "line"])
    return run


def _first_occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stream one sorted partition; state: the current key, its first document, whether it is the partition's first key."""
    state = None  # (h1, h2, first document or None, first key of the partition)
    for batch in batches:
        n = len(batch)
        if not n:
            continue
        h1, h2 = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("h1", "h2"))
        no_id = batch.column("doc_id").is_null().to_numpy(zero_copy_only=False)
        doc = batch.column("doc_id").fill_null(0).to_numpy(zero_copy_only=False)
        start = np.ones(n, bool)
        start[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        goes_on = state is not None and state[0] == h1[0] and state[1] == h2[0]
        begins = np.flatnonzero(start)
        first_doc, first_none = doc[begins].copy(), no_id[begins].copy()
        if goes_on:
            first_doc[0], first_none[0] = (0, True) if state[2] is None else (state[2], False)
        group = np.cumsum(start) - 1
        same = (no_id & first_none[group]) | (~no_id & ~first_none[group] & (doc == first_doc[group]))
        in_first = (group == 0) if state is None or (goes_on and state[3]) else np.zeros(n, bool)
        kind = np.where(~same, DROP, UNSURE).astype(np.int32)
        out = batch.filter(pa.array(~same | in_first))
        yield pa.RecordBatch.from_arrays([*out.columns, pa.array(kind[~same | in_first])], [*out.schema.names, "kind"])
        state = (h1[-1], h2[-1], None if first_none[-1] else int(first_doc[-1]), bool(in_first[-1]))
    if state is not None:
        yield pa.RecordBatch.from_arrays(
            [pa.array([state[0]], pa.int64()), pa.array([state[1]], pa.int64()), pa.array([state[2]], pa.int64()),
             pa.array([0], pa.int64()), pa.array([-1], pa.int32()), pa.array([LAST], pa.int32())],
            ["h1", "h2", "doc_id", "text_key", "line", "kind"])


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        packed, count = [], []
        for lines in batch.column("lines").to_pylist():
            keep = np.ones(8 * (max(lines) // 8 + 1), bool)
            keep[lines] = False
            packed.append(zlib.compress(np.packbits(keep, bitorder="little").tobytes()))
            count.append(len(lines))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("text_key"), pa.array(count, pa.int32()), pa.array(packed, pa.binary())],
            ["doc_id", "text_key", "n_dropped", "keep"])


def kept_lines(body: bytes, keep: bytes | None) -> tuple[list[bytes], int]:
    """The lines a bitmap keeps, and the number of lines before. No bitmap, or a line past its end: kept."""
    lines = body.split(b"\n")
    if keep is None:
        return lines, len(lines)
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), bitorder="little")
    return [x for i, x in enumerate(lines) if i >= len(bits) or bits[i]], len(lines)


def keep_bitmaps(docs: DataFrame, scratch: Scratch, min_chars: int = 10) -> DataFrame:
    """``doc_id, text_key, n_dropped, keep`` for each document that loses lines.

    A line goes if its key has ``min_chars`` code points or more and a smaller
    ``doc_id`` holds the key too. ``keep`` is the zlib-compressed little-endian
    bitmap of kept lines up to the last dropped one; later lines are kept.
    """
    spark = docs.sparkSession
    rows = scratch.table(keyed_text(docs).mapInArrow(_line_rows(min_chars), ROWS), "lines")
    order = [F.col("h1"), F.col("h2"), F.col("doc_id").asc_nulls_last(), F.col("text_key"), F.col("line")]
    flags = scratch.table(
        rows.repartitionByRange(partitions(spark, 4), *order).sortWithinPartitions(*order)
            .mapInArrow(_first_occurrences, FLAGS), "flags")
    scratch.drop("lines")
    held = (flags.where(F.col("kind") == LAST).groupBy("h1", "h2")
                 .agg(F.min("doc_id").alias("first_id"))
                 .select(F.col("h1").alias("k1"), F.col("h2").alias("k2"), "first_id"))
    late = (flags.where(F.col("kind") == UNSURE)
                 .join(held, (F.col("h1") == F.col("k1")) & (F.col("h2") == F.col("k2")))
                 .where(F.col("first_id").isNotNull() & (F.col("doc_id").isNull() | (F.col("doc_id") > F.col("first_id")))))
    cols = ["doc_id", "text_key", "line"]
    drops = flags.where(F.col("kind") == DROP).select(cols).unionByName(late.select(cols))
    return (drops.groupBy("doc_id", "text_key").agg(F.collect_set("line").alias("lines"))
                 .mapInArrow(_bitmaps, BITMAPS))


def with_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """``row``, a struct of all columns of ``docs``, and the document's ``keep`` (null: keeps all)."""
    body = F.coalesce(docs["text"].cast("string"), F.lit(""))
    left = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs["doc_id"].cast("long").alias("own_id"), F.xxhash64(body).alias("own_key"))
    right = bitmaps.select("doc_id", "text_key", "keep")
    return left.join(right, F.col("own_id").eqNullSafe(F.col("doc_id")) & (F.col("own_key") == F.col("text_key")), "left").select("row", "keep")


def dedup_lines(docs: DataFrame, scratch: Scratch, min_chars: int = 10) -> DataFrame:
    """``docs`` with the dropped lines gone from ``text`` and ``n_chars`` (if there) counted anew for these; all rows stay."""
    both = with_bitmaps(docs, scratch.table(keep_bitmaps(docs, scratch, min_chars), "bitmaps"))
    names = docs.columns

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = dict(zip(names, batch.column("row").flatten()))
            for part in slices(iter([pa.RecordBatch.from_arrays([*row.values(), batch.column("keep")], [*names, "keep "])]), "text"):
                columns = dict(zip(names, part.columns))
                keep = part.column(len(names)).to_pylist()
                text = [t if k is None else b"\n".join(kept_lines(t.encode(), k)[0]).decode() for t, k in zip(columns["text"].to_pylist(), keep)]
                if "n_chars" in columns:
                    count = [n if k is None else len(t) for n, t, k in zip(columns["n_chars"].to_pylist(), text, keep)]
                    columns["n_chars"] = pa.array(count, columns["n_chars"].type)
                columns["text"] = pa.array(text, columns["text"].type)
                yield pa.RecordBatch.from_arrays(list(columns.values()), names)
    return both.mapInArrow(cut, docs.schema)
