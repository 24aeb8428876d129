"""Ranked lexical search by a dual-tree search: the best documents of every query item.

Scores are whole numbers, sums over an item's distinct terms of weight times impact (a
saturated term frequency, lowered for long documents). A document is a vector of impacts,
an item a vector of weights. Both sides get hierarchies whose nodes hold the coordinate
maxima of the vectors below them, so the product of two nodes' maxima bounds the score
of every pair below. The search goes down both hierarchies together and drops a pair of
nodes whose bound is below the weakest k-th score among the node's items (or is 0):
whole batches go at once, and exactly. Scores are matrix products in floating point,
exact for whole numbers while sums stay below 2^53 (else in 64-bit integers); bounds
are rounded up.

Distribution. Items are taken as distinct texts, in blocks of checked size (at most
``block_bytes`` of text, or one item); a block's terms and tree go to the tasks. Per
block, one pass over all texts leaves each document's length and its counts of the
block's terms as a table; the corpus counts (documents, terms, document frequencies)
are sums of it. The search first takes a sixteenth of that table (by a hash of the
row), whose k-th scores are lower limits for all, and then the rest, so that a task
passes on few rows. Tasks cut their documents into batches of bounded size, each a
tree. The items' best k of all tasks are the result.

Defined results: null texts have no terms; documents without terms don't count; equal
scores come by ascending ``doc_id``, null ids last; equal rows count as rows each; an
item without terms, or whose terms no document holds, has no result rows; items with
equal texts have equal results, each row its own; an empty table on either side gives
an empty result; other columns are never read by name.
"""

from __future__ import annotations

import functools
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ordersight.llm.common import Scratch, ship, slices

#: Bytes that belong to terms as they are: digits, letters and all of a code point from U+0080 on; the others separate.
LOWER = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))
CELLS = 4 << 20  # of a batch's impact matrix
TOP = 1_000_000  # no impact is larger
EXACT = 2**53
LEAF = 8  # vectors below a lowest node, and nodes below each higher one
BEST = "query int, score long, doc_id long"


def terms(body: bytes) -> list[bytes]:
    return body.translate(LOWER).split(b" ")


def counted(body: bytes) -> tuple[int, Counter]:
    """Number of terms, and how often each occurs."""
    found = Counter(terms(body))
    found.pop(b"", None)
    return found.total(), found


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


# ---------------------------------------------------------------- items
class Block:
    """Queries of one block and the numbers of their terms."""

    def __init__(self, bodies: list[bytes]):
        self.terms: dict[bytes, int] = {}
        self.queries = [sorted(self.terms.setdefault(t, len(self.terms)) for t in counted(b)[1]) for b in bodies]

    def weighted(self, df: dict[int, int], n_docs: int) -> list[dict[int, int]]:
        w = {t: weight(n_docs, f) for t, f in df.items()}
        return [{t: w[t] for t in q if t in w} for q in self.queries]


class ItemTree:
    """Items in groups of alike ones, and groups of groups; a group's vector holds its items' maxima.

    Items go in order of their heaviest terms, so that those with rare terms in
    common come together.
    """

    def __init__(self, queries: list[dict[int, int]]):
        numbers = [k for k, q in enumerate(queries) if any(q.values())]
        self.order = sorted(numbers, key=lambda k: sorted(((-w, t) for t, w in queries[k].items()))[:3])
        leaves = [self._group([queries[k] for k in self.order[i:i + LEAF]], i) for i in range(0, len(self.order), LEAF)]
        self.levels = [leaves]
        while len(self.levels[-1]) > LEAF:
            below = self.levels[-1]
            self.levels.append([self._group([dict(zip(g["terms"].tolist(), g["max"].tolist())) for g in below[i:i + LEAF]], i)
                                for i in range(0, len(below), LEAF)])

    @staticmethod
    def _group(vectors: list[dict[int, int]], first: int) -> dict:
        used = sorted({t for v in vectors for t in v})
        rows = np.array([[v.get(t, 0) for t in used] for v in vectors], np.float64).reshape(len(vectors), len(used))
        if rows.sum(axis=1).max() * TOP >= EXACT:
            rows = rows.astype(np.int64)
        return {"first": first, "count": len(vectors), "terms": np.array(used, np.int64), "rows": rows, "max": rows.max(axis=0)}


# ---------------------------------------------------------------- documents
def _vectors(block):
    """Per document: its length in terms, the block's terms it holds, and their counts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = block.value.terms
        for batch in slices(batches):
            lengths, held, times = [], [], []
            for body in batch.column("body").to_pylist():
                n, found = counted(body)
                some = sorted((number[t], found[t]) for t in found.keys() & number.keys())
                lengths.append(n)
                held.append([t for t, _ in some])
                times.append([c for _, c in some])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("hash"), pa.array(lengths, pa.int64()), pa.array(held, pa.list_(pa.int32())),
                                              pa.array(times, pa.list_(pa.int32()))], ["doc_id", "hash", "n_terms", "terms", "times"])
    return run


class Documents:
    """A batch of documents as a matrix of impacts and the coordinate maxima of 8, 64, ... of them."""

    def __init__(self, batch: pa.RecordBatch, n_docs: int, n_terms: int):
        sizes = np.diff(batch.column("terms").offsets.to_numpy())
        held = batch.column("terms").flatten().to_numpy().astype(np.int64)
        tf = batch.column("times").flatten().to_numpy().astype(np.int64)
        row = np.repeat(np.arange(len(batch)), sizes)
        m = np.array([50 + 50 * n * n_docs // n_terms for n in batch.column("n_terms").to_pylist()], np.int64)
        self.columns, at = np.unique(held, return_inverse=True)
        matrix = np.zeros((len(batch), len(self.columns)))
        matrix[row, at] = 1_000_000_000 * tf // (1000 * tf + 20 * m[row])
        # alike documents side by side: in order of their position on the direction that most of the batch's variation has
        order = np.lexsort((batch.column("hash").to_numpy(), _along(matrix)))
        self.ids = batch.column("doc_id").take(pa.array(order))
        self.levels = [matrix[order]]
        while len(self.levels[-1]) > LEAF:
            below = self.levels[-1]
            self.levels.append(np.maximum.reduceat(below, np.arange(0, len(below), LEAF), axis=0))

    def at(self, level: int, nodes: np.ndarray, used: np.ndarray) -> np.ndarray:
        return self.levels[level][np.ix_(nodes, used)]


def _along(matrix: np.ndarray) -> np.ndarray:
    if not matrix.size:
        return np.zeros(len(matrix))
    centred = matrix - matrix.mean(axis=0)
    v = np.random.default_rng(3).standard_normal(matrix.shape[1])
    for _ in range(3):
        v = centred.T @ (centred @ v)
        v /= max(np.linalg.norm(v), 1e-30)
    return centred @ v


def _children(nodes: np.ndarray, size: int) -> np.ndarray:
    below = (nodes[:, None] * LEAF + np.arange(LEAF)).ravel()
    return below[below < size]


class Search:
    """The best k documents of every query so far."""

    def __init__(self, tree: ItemTree, least: np.ndarray, k: int):
        self.tree, self.k = tree, k
        self.least = least  # by query: documents below this score can't be among the best
        self.found: dict[int, list[tuple[int, int, int]]] = {}

    def _limit(self, level: int, node: int) -> int:
        """Least score that an item below a node still takes."""
        group = self.tree.levels[level][node]
        if level:
            return min(self._limit(level - 1, n) for n in range(group["first"], group["first"] + group["count"]))
        return int(min(self.least[q] for q in self.tree.order[group["first"]:group["first"] + group["count"]]))

    def batch(self, docs: Documents) -> None:
        top = len(docs.levels) - 1
        nodes = np.arange(len(docs.levels[top]))
        for node in range(len(self.tree.levels[-1])):
            self._down(docs, len(self.tree.levels) - 1, node, top, nodes)

    def _down(self, docs: Documents, level: int, node: int, at: int, nodes: np.ndarray) -> None:
        """Goes on below the document nodes whose bound with an item node reaches its limit; both sides get one level finer."""
        group = self.tree.levels[level][node]
        place = np.searchsorted(docs.columns, group["terms"])
        place[place == len(docs.columns)] = 0
        held = docs.columns[place] == group["terms"] if len(docs.columns) else np.zeros(len(place), bool)
        used = place[held]
        if not len(used):
            return
        bound = (docs.at(at, nodes, used) @ group["max"][held]) * (1 + 1e-9)
        nodes = nodes[bound >= max(1, self._limit(level, node))]
        if not len(nodes):
            return
        if at:
            nodes, at = _children(nodes, len(docs.levels[at - 1])), at - 1
            if not level:
                return self._down(docs, level, node, at, nodes)
        if level:
            for below in range(group["first"], group["first"] + group["count"]):
                self._down(docs, level - 1, below, at, nodes)
            return None
        scores = docs.at(0, nodes, used).astype(group["rows"].dtype) @ group["rows"][:, held].T
        for j, query in enumerate(self.tree.order[group["first"]:group["first"] + group["count"]]):
            self._take(query, scores[:, j], docs.ids, nodes)
        return None

    def _take(self, query: int, scores: np.ndarray, ids: pa.Array, nodes: np.ndarray) -> None:
        some = np.flatnonzero(scores >= max(1, self.least[query]))
        if not len(some):
            return
        if len(some) > self.k:  # all that reach the k-th score, ties included
            some = some[scores[some] >= np.partition(scores[some], -self.k)[-self.k]]
        new = [(-int(s), d is None, d or 0) for s, d in zip(scores[some], ids.take(pa.array(nodes[some])).to_pylist())]
        best = sorted(self.found.get(query, []) + new)[:self.k]
        self.found[query] = best
        if len(best) == self.k:
            self.least[query] = max(self.least[query], -best[-1][0])

    def rows(self) -> pa.RecordBatch:
        flat = [(q, -s, None if none else d) for q, best in self.found.items() for s, none, d in best]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in flat], t) for k, t in enumerate((pa.int32(), pa.int64(), pa.int64()))],
                                          ["query", "score", "doc_id"])


def _search(sent, n_docs: int, n_terms: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, least, n_columns = sent.value
        search = Search(tree, least.copy(), k)
        for batch in batches:
            ends = batch.column("terms").offsets.to_numpy()
            start = 0
            while start < len(batch):
                # as many documents as the matrix has room for
                columns = np.minimum(ends[start + 1:start + 1025] - ends[start], n_columns)
                end = start + max(1, int(np.searchsorted(np.arange(1, len(columns) + 1) * columns, CELLS, side="right")))
                search.batch(Documents(batch.slice(start, end - start), n_docs, n_terms))
                start = end
        yield search.rows()
    return run


# ---------------------------------------------------------------- the whole
def _blocks(queries: DataFrame, block_bytes: int) -> Iterator[tuple[list, Block]]:
    """Distinct texts in blocks: as many by hash as make the largest one hold ``block_bytes`` at most (or a single text)."""
    size = F.octet_length("body") + F.lit(64)
    count = max(1, math.ceil((queries.agg(F.sum(size)).first()[0] or 0) / block_bytes))
    while True:
        block = F.pmod(F.conv(F.substring("key", 1, 12), 16, 10).cast("long"), F.lit(count))
        largest = queries.groupBy(block.alias("block")).agg(F.sum(size).alias("bytes"), F.count("*").alias("rows")).where("rows > 1").agg(F.max("bytes")).first()[0]
        if (largest or 0) <= block_bytes:
            break
        count *= 2
    for k in range(count):
        rows = queries.where(block == k).orderBy("key").collect()
        if rows:
            yield [r["key"] for r in rows], Block([bytes(r["body"]) for r in rows])


def _best(rows: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _found(docs: DataFrame, block: Block, scratch: Scratch, name: str, k: int) -> DataFrame | None:
    """``query, score, doc_id, rank`` for a block's queries."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(block)  # at most ``block_bytes`` of text
    body = F.coalesce(docs["text"].cast("string"), F.lit(""))
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(docs["doc_id"], body).alias("hash"), body.cast("binary").alias("body"))
    vectors = scratch.table(rows.mapInArrow(_vectors(sent), "doc_id long, hash long, n_terms long, terms array<int>, times array<int>"), f"vectors-{name}")
    n_docs, n_terms = vectors.where("n_terms > 0").agg(F.count("*"), F.sum("n_terms")).first()
    # as many rows as the block has terms
    df = {r["term"]: r["df"] for r in vectors.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).collect()}
    if not df:
        return None
    tree = ItemTree(block.weighted(df, n_docs))
    held = vectors.where(F.size("terms") > 0)

    def searched(part: DataFrame, least: np.ndarray) -> DataFrame:
        limits = spark.sparkContext.broadcast((tree, least, len(block.terms)))
        return part.mapInArrow(_search(limits, n_docs, n_terms, k), BEST)
    first = F.pmod("hash", F.lit(16)) == 0
    least = np.zeros(len(block.queries), np.int64)
    seeds = scratch.table(_best(searched(held.where(first), least), k), f"seeds-{name}")
    for r in seeds.where(F.col("rank") == k).select("query", "score").collect():  # a row for each query of the block at most
        least[r["query"]] = r["score"]
    rest = searched(held.where(~first), least).unionByName(seeds.drop("rank"))
    return _best(rest, k)


def ranked(docs: DataFrame, items: DataFrame, scratch: Scratch, k: int = 50, block_bytes: int = 2 << 20) -> DataFrame:
    """``item_id, rank, doc_id, score``: for every row of ``items`` its ``k`` best documents of ``docs``."""
    spark = docs.sparkSession
    ship(spark)
    text = F.coalesce(items["text"].cast("string"), F.lit(""))
    named = items.select(items["item_id"].cast("long").alias("item_id"), F.sha2(text.cast("binary"), 256).alias("key"), text.cast("binary").alias("body"))
    queries = named.groupBy("key").agg(F.first("body").alias("body"))
    parts = []
    for number, (keys, block) in enumerate(_blocks(queries, block_bytes)):
        best = _found(docs, block, scratch, str(number), k)
        if best is not None:
            names = spark.createDataFrame(list(enumerate(keys)), "query int, key string")
            parts.append(scratch.table(best.join(names, "query").select("key", "rank", "doc_id", "score"), f"found-{number}"))
        scratch.drop(f"vectors-{number}", f"seeds-{number}")
    if not parts:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    found = functools.reduce(DataFrame.unionByName, parts)
    return named.select("item_id", "key").join(found, "key").select("item_id", "rank", "doc_id", "score")
