"""Which rows of a hash table occur in several documents, found in one sorted pass.

Rows (hash, document, position) are range-partitioned and sorted by all these
columns, so one hash that a third of the rows share is cut into many partitions; no
aggregate and no join of the rows is needed. A partition streams its rows with the
current hash's first document as state. A hash at a partition's edge may go on in the
next one: rows of its first local document are marked, and resolved against one row
for the first and the last document of every edge.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ordersight.llm.common import Scratch, partitions

ROWS = "h1 long, h2 int, doc_id long, text_key long, at int"
NAMES = ["h1", "h2", "doc_id", "text_key", "at"]
LATE, FIRST, UNSURE, EDGE = 0, 1, 2, 3


def _out(batch: pa.RecordBatch, rows: np.ndarray, kind: int) -> pa.RecordBatch:
    some = batch.filter(pa.array(rows))
    n = len(some)
    hashes = [some.column("h1"), some.column("h2")] if kind >= UNSURE else [pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32())]
    return pa.RecordBatch.from_arrays([*hashes, *[some.column(c) for c in NAMES[2:]], pa.array(np.full(n, kind, np.int32))], [*NAMES, "kind"])


class _Group:
    """The hash that the rows of a partition have come to."""

    def __init__(self, key, first, edge: bool):
        self.key, self.first, self.last, self.edge = key, first, first, edge
        self.several, self.held = False, []  # rows of the first document, until a second one or the end comes

    def edges(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([self.key[0]] * 2, pa.int64()), pa.array([self.key[1]] * 2, pa.int32()), pa.array([self.first, self.last], pa.int64()),
             pa.array([0, 0], pa.int64()), pa.array([-1, -1], pa.int32()), pa.array([EDGE, EDGE], pa.int32())], [*NAMES, "kind"])

    def over(self, end: bool) -> Iterator[pa.RecordBatch]:
        """What is known as the hash ends, or the partition does."""
        every = lambda b: np.ones(len(b), bool)
        for b in self.held:
            if self.edge or end:
                yield _out(b, every(b), UNSURE)
            elif self.several:
                yield _out(b, every(b), FIRST)
        if self.edge or end:
            yield self.edges()


def _stream(late_only: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in _kinds(batches):
            if len(out) and not (late_only and out.column("kind")[0].as_py() == FIRST):
                yield out
    return run


def _kinds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of one kind each."""
    now: _Group | None = None
    for batch in batches:
        n = len(batch)
        if not n:
            continue
        h1, h2 = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("h1", "h2"))
        none = batch.column("doc_id").is_null().to_numpy(zero_copy_only=False)
        doc = batch.column("doc_id").fill_null(0).to_numpy(zero_copy_only=False)
        at = lambda i: None if none[i] else int(doc[i])
        start = np.ones(n, bool)
        start[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        begins = np.flatnonzero(start)
        group = np.cumsum(start) - 1
        goes_on = now is not None and now.key == (int(h1[0]), int(h2[0]))
        first, first_none = doc[begins].copy(), none[begins].copy()
        if goes_on:
            first[0], first_none[0] = (0, True) if now.first is None else (now.first, False)
        same = (none & first_none[group]) | (~none & ~first_none[group] & (doc == first[group]))
        several = np.logical_or.reduceat(~same, begins)
        yield _out(batch, ~same, LATE)
        # groups with neighbours in this batch on both sides are decided here
        inner = (group > 0) & (group < len(begins) - 1)
        yield _out(batch, same & inner & several[group], FIRST)
        for g in sorted({0, len(begins) - 1}):
            rows = group == g
            if g or not goes_on:
                if now is not None:
                    yield from now.over(False)
                now = _Group((int(h1[begins[g]]), int(h2[begins[g]])), at(begins[g]), edge=now is None)
            now.several |= bool(several[g])
            now.last = at(np.flatnonzero(rows)[-1])
            held = batch.filter(pa.array(rows & same))
            if now.edge:
                yield _out(held, np.ones(len(held), bool), UNSURE)
            else:
                now.held.append(held)
    if now is not None:
        yield from now.over(True)


def repeated_rows(rows: DataFrame, scratch: Scratch, name: str, late_only: bool = False) -> DataFrame:
    """``doc_id, text_key, at, late`` of the rows whose hash occurs in several documents; ``late``: a smaller ``doc_id`` has it too.

    ``rows``: a written table (it is sampled for the ranges). Null ``doc_id`` is one
    document after all others. ``late_only``: leave the others out where that saves
    writing them.
    """
    order = [F.col("h1"), F.col("h2"), F.col("doc_id").asc_nulls_last(), F.col("text_key"), F.col("at")]
    flags = scratch.table(rows.repartitionByRange(partitions(rows.sparkSession, 4), *order).sortWithinPartitions(*order)
                              .mapInArrow(_stream(late_only), ROWS + ", kind int"), name)
    own = ["doc_id", "text_key", "at"]
    sure = flags.where(F.col("kind") <= FIRST).select(*own, (F.col("kind") == LATE).alias("late"))
    ends = (flags.where(F.col("kind") == EDGE).groupBy(F.col("h1").alias("k1"), F.col("h2").alias("k2"))
                 .agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.max(F.col("doc_id").isNull().cast("int")).alias("none"))
                 .where("lo < hi or (lo is not null and none = 1)"))
    # at most four edge rows a partition, so ``ends`` is a bounded side; marked rows stay where they are
    unsure = (flags.where(F.col("kind") == UNSURE).join(F.broadcast(ends), (F.col("h1") == F.col("k1")) & (F.col("h2") == F.col("k2")))
                   .select(*own, (F.col("doc_id").isNull() | (F.col("doc_id") > F.col("lo"))).alias("late")))
    return sure.unionByName(unsure)
