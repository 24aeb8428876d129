"""Hard-negative mining by slot-decomposed selection.

An anchor's positives are its best rows of its own label. A positive with score p
allows negatives with scores from ``low`` to ``high`` hundredths of p. The windows of
one anchor overlap; their upper limits, in order, split the scores into disjoint
slots, and each row of another label falls into one slot at most (the one below the
least upper limit that is not under its score). Every task keeps the best ``k`` rows
of each (anchor, slot), and so does the merge of the tasks. A window's best k rows are
then among the slots at and below its upper limit: going down from the highest slot, a
suffix merge of k rows with k rows answers each window, and its lower limit is applied
last, to rows already in order.

The anchors are the query set. They are matched against all rows in blocks of at most
``block`` anchors, each sent to the tasks; a task multiplies the block with batches of
its rows. Nothing larger than k rows per (anchor, slot, task) leaves a task.

Vectors are quantised to floor(256 * x). Defined results: rows with a null label, a
null vector or a null or non-finite component take no part; components beyond 2^26
after quantising count as 2^26, so that a score fits 64 bits; vectors of unequal
lengths are multiplied over the shorter one; rows that share the anchor's ``vec_id``
are neither positives nor negatives of it; other rows alike in ``vec_id`` and score to
an anchor count once; a null ``vec_id`` is no anchor and comes last among equal scores;
an anchor without positives or without rows in a window has no result rows; an empty
table gives an empty result; other columns are never read by name.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ordersight.llm.common import Scratch, partitions, ship

LIMIT = 2**26
NO_ID = 2**63 - 1  # stands for a null id within tasks
BATCH = 4096  # rows multiplied at a time
WIDE = "decimal(24,0)"
BEST = "anchor_id long, slot int, score long, row_id long"


def quantised(vectors: DataFrame, relabelled: Column | None = None) -> DataFrame:
    """``id, label, q``: the rows that take part, with whole-number components."""
    v = vectors["embedding"].cast("array<double>")
    rows = vectors.select(vectors["vec_id"].cast("long").alias("id"), vectors["label"].cast("long").alias("label"), v.alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = rows.where(F.col("label").isNotNull() & F.col("v").isNotNull() & finite)
    whole = F.transform("v", lambda x: F.greatest(F.lit(-LIMIT), F.least(F.lit(LIMIT), F.floor(F.lit(256.0) * F.greatest(F.lit(-1e9), F.least(F.lit(1e9), x))))).cast("int"))
    return rows.select("id", (F.col("label") if relabelled is None else relabelled).alias("label"), whole.alias("q"))


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of whole numbers, the shorter ones filled with zeros."""
    lengths = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), int(lengths.max()) if len(column) else 0), np.int64)
    out[np.arange(out.shape[1]) < lengths[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products: in floating point while all sums are whole numbers below 2^53."""
    d = min(a.shape[1], b.shape[1])
    a, b = a[:, :d], b[:, :d]
    if not d or int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * d < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


class Best:
    """The best ``k`` rows of every (anchor, slot) so far; rows alike in score and id count once."""

    def __init__(self, anchors: int, slots: int, k: int):
        self.k, self.slots = k, slots
        self.group, self.score, self.row = (np.zeros(0, np.int64) for _ in range(3))
        self.worst = np.full(anchors * slots, np.iinfo(np.int64).min)  # of full groups: the score of the k-th

    def add(self, group: np.ndarray, score: np.ndarray, row: np.ndarray) -> None:
        some = score >= self.worst[group]
        g, s, r = (np.concatenate([old, new[some]]) for old, new in ((self.group, group), (self.score, score), (self.row, row)))
        order = np.lexsort((r, -s, g))
        g, s, r = g[order], s[order], r[order]
        fresh = np.ones(len(g), bool)
        fresh[1:] = (g[1:] != g[:-1]) | (s[1:] != s[:-1]) | (r[1:] != r[:-1])
        g, s, r = g[fresh], s[fresh], r[fresh]
        begin = np.flatnonzero(np.diff(g, prepend=-1))
        place = np.arange(len(g)) - np.repeat(begin, np.diff(begin, append=len(g)))
        self.worst[g[place == self.k - 1]] = s[place == self.k - 1]
        self.group, self.score, self.row = g[place < self.k], s[place < self.k], r[place < self.k]


class Anchors:
    """A block of anchors, sent to the tasks."""

    def __init__(self, rows: list):
        self.ids = np.array([r["id"] for r in rows], np.int64)
        self.labels = np.array([r["label"] for r in rows], np.int64)
        self.q = matrix(pa.array([r["q"] for r in rows], pa.list_(pa.int64())))


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for batch in batches:
        for i in range(0, len(batch), BATCH):
            some = batch.slice(i, BATCH)
            yield (some.column("id").fill_null(NO_ID).to_numpy(), some.column("label").to_numpy(), matrix(some.column("q")))


def _rows(best: Best, anchors: Anchors) -> pa.RecordBatch:
    ids = pa.array(best.row, mask=best.row == NO_ID)
    return pa.RecordBatch.from_arrays([pa.array(anchors.ids[best.group // best.slots]), pa.array((best.group % best.slots).astype(np.int32)),
                                       pa.array(best.score), ids], ["anchor_id", "slot", "score", "row_id"])


def _positives(anchors: Anchors, k: int):
    """A task's best rows of each anchor's label."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(anchors.ids), 1, k)
        for ids, labels, q in _batches(batches):
            score = products(anchors.q, q)
            a, r = np.nonzero((anchors.labels[:, None] == labels) & (anchors.ids[:, None] != ids) & (score >= best.worst[:, None]))
            best.add(a, score[a, r], ids[r])
        yield _rows(best, anchors)
    return run


def _negatives(anchors: Anchors, uppers: np.ndarray, least: np.ndarray, k: int):
    """A task's best rows of each (anchor, slot). uppers: by anchor, the slots' upper limits in ascending order, the first ones unused (least int)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = uppers.shape[1]
        best = Best(len(anchors.ids), slots, k)
        for ids, labels, q in _batches(batches):
            score = products(anchors.q, q)
            fits = (anchors.labels[:, None] != labels) & (anchors.ids[:, None] != ids) & (score <= uppers[:, -1:]) & (score >= least[:, None])
            a, r = np.nonzero(fits)
            s = score[a, r]
            best.add(a * slots + (uppers[a] < s[:, None]).sum(axis=1), s, ids[r])
        yield _rows(best, anchors)
    return run


def _best(rows: DataFrame, k: int) -> DataFrame:
    """The best k of every (anchor, slot) of all tasks, ranked."""
    order = Window.partitionBy("anchor_id", "slot").orderBy(F.col("score").desc(), F.col("row_id").asc_nulls_last())
    return rows.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def anchor_blocks(rows: DataFrame, is_anchor: Column, block: int) -> Iterator[Anchors]:
    """The anchors, one block after another in order of their ids, of ``block`` rows at most."""
    anchors = rows.where(is_anchor).groupBy("id").agg(F.min(F.struct("label", "q")).alias("least")).select("id", "least.label", "least.q")
    after = None
    while True:
        some = (anchors if after is None else anchors.where(F.col("id") > after)).orderBy("id").limit(block).collect()
        if some:
            yield Anchors(some)
        if len(some) < block:
            return
        after = some[-1]["id"]


def _limits(anchors: Anchors, positives: list, k: int, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Upper limits by anchor in ascending order, and the least lower limit (rounded to whole scores)."""
    of: dict[int, list[int]] = {}
    for r in positives:
        if low * r["score"] <= high * r["score"]:
            of.setdefault(r["anchor_id"], []).append(r["score"])
    uppers = np.full((len(anchors.ids), k), np.iinfo(np.int64).min)
    least = np.full(len(anchors.ids), np.iinfo(np.int64).max)
    for at, anchor in enumerate(anchors.ids.tolist()):
        if scores := of.get(anchor):
            limits = sorted({high * s // 100 for s in scores})
            uppers[at, k - len(limits):] = limits
            least[at] = min(-(-low * s // 100) for s in scores)
    return uppers, least


def _hundredths(score: str, share: int) -> Column:
    return F.col(score).cast(WIDE) * share


def _suffixes(slots: int, k: int) -> list[Column]:
    """For each slot, the best k rows of it and all lower slots: merged upwards from the lowest, k rows with k rows."""
    def upto(slot: int) -> Column:
        own = F.transform(F.filter("found", lambda r: r["slot"] == slot),
                          lambda r: F.struct((-r["score"]).alias("less"), r["row_id"].isNull().alias("none"), r["row_id"].alias("row_id")))
        return F.slice(F.array_sort(F.concat(f"upto{slot - 1}", own) if slot else own), 1, k)
    return [upto(slot) for slot in range(slots)]


def hard_negatives(rows: DataFrame, is_anchor: Column, scratch: Scratch, positives: int = 5, k: int = 5, low: int = 80, high: int = 100,
                   block: int = 2048) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for the anchors among ``rows`` (``id, label, q``).

    Of several anchor rows with one id, the least (label, then components) is the anchor.
    """
    spark = rows.sparkSession
    ship(spark)
    rows = scratch.table(rows.select("id", "label", "q"), "rows")
    parts = []
    for number, anchors in enumerate(anchor_blocks(rows, is_anchor, block)):
        sent = spark.sparkContext.broadcast(anchors)  # at most ``block`` anchors
        near = _best(rows.mapInArrow(lambda b, sent=sent: _positives(sent.value, positives)(b), BEST), positives)
        near = scratch.table(near.select("anchor_id", "rank", "score", "row_id"), f"positives-{number}")
        limits = spark.sparkContext.broadcast(_limits(anchors, near.collect(), positives, low, high))
        far = _best(rows.mapInArrow(lambda b, sent=sent, limits=limits: _negatives(sent.value, *limits.value, k)(b), BEST), k)
        # at most positives * k rows of an anchor
        found = far.groupBy("anchor_id").agg(F.collect_list(F.struct("slot", "score", "row_id")).alias("found"))
        for slot, best in enumerate(_suffixes(positives, k)):
            found = found.withColumn(f"upto{slot}", best)
        upto = F.array(*[F.col(f"upto{slot}") for slot in range(positives)])
        # the slot of a positive's upper limit: counted down from the highest one, one for each distinct limit above
        ranked = near.withColumn("limit", F.floor(_hundredths("score", high) / 100))
        above = F.dense_rank().over(Window.partitionBy("anchor_id").orderBy(F.col("limit").desc()))
        ranked = ranked.withColumn("slot", F.lit(positives) - above)
        both = ranked.join(found.select("anchor_id", upto.alias("upto")), "anchor_id")
        window = F.filter(F.get("upto", F.col("slot")), lambda r: (-r["less"].cast(WIDE) * 100).between(_hundredths("score", low), _hundredths("score", high)))
        done = both.select("anchor_id", F.col("row_id").alias("positive_id"), F.col("score").alias("positive_score"), F.posexplode(window).alias("place", "hit"))
        parts.append(scratch.table(done.select("anchor_id", "positive_id", (F.col("place") + 1).cast("int").alias("rank"), F.col("hit.row_id").alias("negative_id"),
                                               "positive_score", (-F.col("hit.less")).alias("negative_score")), f"found-{number}"))
        sent.unpersist()
        limits.unpersist()
    empty = spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    return functools.reduce(DataFrame.unionByName, parts) if parts else empty
