"""Language-model scores by deleted interpolation of n-gram estimates.

Order j's estimate of a token is the count of its j-gram divided by the count of the
j-1 tokens before it (maximum likelihood); order 0 is uniform over the V known tokens
and one unknown. The estimates of all orders are mixed, and the weights depend on how
often the context was seen: a bucket is the longest context that was seen at all and
the power of two of its count. Weights are learned by expectation-maximisation on
training documents that are deleted from the counts for that (one tenth of them by
``doc_id``); afterwards the deleted counts are added again. The model is a
probability over the V + 1 tokens in every context.

Counting is done by blocks of whole documents. A block's distinct j-grams, with their
counts in kept and in deleted training documents, go to parts of the hash range in
one packet a part; the part sums equal hashes and replies to each block for the grams
that other blocks hold too. Orders 1 and 2 are counted together, higher ones one after
another: a j-gram can be in another block only if both (j-1)-grams in it are, so others
are not sent, and their counts are the block's own. A frequent gram is one entry a
block, so no part is hot. Each step's blocks are a table in the shared folder.

Grams are known by 64-bit hashes. Defined results: a null text is empty and is its end
token only; a null ``doc_id`` counts as the empty text in ``crc32`` and so is held out;
equal rows are scored each; without training documents every token has probability 1;
without deleted ones the weights of a bucket are equal; an empty table gives an empty
result; other columns are never read.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from ordersight.llm.common import Scratch, mix, partitions, ship, slices

KEPT, DELETED, HELD_OUT = 0, 1, 2
END, START = 11, 13  # hashes of the tokens that are no words
BLOCK_BYTES = 3 << 20
BLOCK_ROWS = 4  # rows of the size of a block sent to Python at a time
BODY = "block long, part int, body binary"
STATS = ["tokens", "deleted_tokens", "docs", "deleted_docs"]


def held_out(doc_id: Column) -> Column:
    """Documents that are never learned from: crc32 of the id as text is divisible by 10."""
    return _remainder(doc_id) == 0


def _remainder(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 10


def _role(doc_id: Column) -> Column:
    r = _remainder(doc_id)
    return F.when(r == 0, HELD_OUT).when(r == 1, DELETED).otherwise(KEPT).cast("int")


def pack(x: dict) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(x, protocol=5))


def unpack(body: bytes) -> dict:
    return pickle.loads(zstandard.ZstdDecompressor().decompress(body))


def narrow(x: np.ndarray) -> np.ndarray:
    """The same non-negative numbers in the narrowest type that holds them."""
    return x.astype(np.min_scalar_type(int(x.max()) if len(x) else 0))


def planes(x: np.ndarray) -> list[bytes]:
    """Byte planes of non-negative numbers, as many as the largest needs; equal bytes side by side compress better."""
    width = max(1, -(-int(x.max(initial=0)).bit_length() // 8))
    raw = np.ascontiguousarray(x.astype("<u8")).view(np.uint8).reshape(-1, 8)
    return [raw[:, k].tobytes() for k in range(width)]


def unplaned(x: list[bytes]) -> np.ndarray:
    out = np.zeros((len(x[0]), 8), np.uint8)
    for k, plane in enumerate(x):
        out[:, k] = np.frombuffer(plane, np.uint8)
    return out.view("<i8").ravel()


# ---------------------------------------------------------------- blocks
def make_block(ids: pa.Array, roles: np.ndarray, bodies: list[bytes], n: int) -> dict:
    """Token numbers of whole documents, each with n - 1 start tokens before it and an end token behind it."""
    hashes, lengths = [], []
    for body in bodies:
        words = body.lower().split()
        h = np.empty(len(words) + n, np.uint64)
        h[:n - 1], h[-1] = START, END
        h[n - 1:-1] = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
        hashes.append(h)
        lengths.append(len(h))
    tokens, distinct = pd.factorize(np.concatenate(hashes))
    # frequent words get small numbers, by powers of two of their counts, and words of one power are in order of their hashes: both sides compress
    order = np.lexsort((distinct, -np.log2(np.bincount(tokens)).astype(np.int64)))
    number = np.empty_like(order)
    number[order] = np.arange(len(order))
    return {"ids": ids.to_pylist(), "roles": roles.astype(np.int8), "lengths": np.array(lengths, np.int64),
            "tokens": planes(number[tokens]), "hashes": packed_hashes(distinct[order]), "counts": []}


def _make_blocks(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, k = TaskContext.get().partitionId() << 32, 0
        for batch in slices(batches, nbytes=BLOCK_BYTES):
            block = make_block(batch.column("doc_id"), batch.column("role").to_numpy(), batch.column("body").to_pylist(), n)
            real = block["lengths"] - (n - 1)
            some = block["roles"] == DELETED
            train = block["roles"] != HELD_OUT
            yield pa.RecordBatch.from_arrays(
                [pa.array([first + k], pa.int64()), pa.array([-1], pa.int32()), pa.array([pack(block)], pa.binary()),
                 *[pa.array([int(x)], pa.int64()) for x in (real[train].sum(), real[some].sum(), train.sum(), some.sum())]],
                ["block", "part", "body", *STATS])
            k += 1
    return run


class Grams:
    """Gram numbers of a block's tokens, order after order."""

    def __init__(self, block: dict, n: int):
        self.block = block
        self.numbers, self.hashes = unplaned(block["tokens"]), unpacked_hashes(block["hashes"])
        self.words = self.hashes[self.numbers]  # by token: the word's hash
        lengths = block["lengths"]
        begin = np.cumsum(lengths) - lengths
        self.real = np.ones(len(self.words), bool)
        for k in range(n - 1):
            self.real[begin + k] = False
        self.role = np.repeat(block["roles"].astype(np.int64), lengths)
        self.order, self.at = 0, np.zeros(len(self.words), np.int64)
        self.run = np.zeros(len(self.words), np.uint64)  # by token: the hash of the gram that ends there

    def longer(self) -> None:
        """Goes on to the next order: ``at`` has the number of the gram that ends at each token, ``hashes`` each gram's hash."""
        self.order += 1
        short = self.at
        if self.order == 1:
            self.run, self.at = self.words, self.numbers
        else:
            with np.errstate(over="ignore"):
                self.run = mix(np.concatenate([self.run[:1], self.run[:-1]]) * np.uint64(0x9E3779B97F4A7C15) + self.words + np.uint64(self.order))
            self.at, self.hashes = pd.factorize(self.run)
        self.size = len(self.hashes)
        # by gram: the grams of the order below without its last and without its first token, and its real tokens by role
        self.before, self.after = np.zeros(self.size, np.int64), np.zeros(self.size, np.int64)
        self.before[self.at[1:]], self.after[self.at] = short[:-1], short
        self.own = np.bincount((self.at * 3 + self.role)[self.real], minlength=self.size * 3).reshape(-1, 3)

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        """By gram of the order: whether other blocks hold it (start tokens count as held), and its tokens by role in all blocks."""
        c = self.block["counts"][self.order - 1]
        shared, out = np.unpackbits(c["shared"], count=self.size).astype(bool), self.own.copy()
        out[shared, KEPT], out[shared, DELETED] = unplaned(c["kept"]), unplaned(c["deleted"])
        return shared | ~self.own.any(axis=1), out

    def sent(self, shared: np.ndarray | None) -> np.ndarray:
        """Grams that other blocks may hold. shared: those of the order below that they do hold."""
        used = self.own.any(axis=1)
        if shared is not None:
            used &= shared[self.before] & shared[self.after]
        return np.flatnonzero(used)


class Round:
    """The orders of one round of counting, and their grams that are sent, in order of their hashes."""

    def __init__(self, block: dict, n: int, orders: list[int]):
        self.grams = Grams(block, n)
        self.of: list[tuple[np.ndarray, np.ndarray]] = []  # by order of the round: own counts, grams sent
        self.at: list[np.ndarray] = []  # by order: each token's gram
        self.known: list[np.ndarray] = []  # by order of the rounds before: counts
        hashes, own, first, shared = [], [], [], None
        for order in range(1, orders[-1] + 1):
            self.grams.longer()
            self.at.append(self.grams.at)
            if order < orders[0]:
                shared, counts = self.grams.counts()
                self.known.append(counts)
            if order in orders:
                some = self.grams.sent(shared)
                self.of.append((self.grams.own, some))
                hashes.append(self.grams.hashes[some])
                own.append(self.grams.own[some])
                first.append(np.full(len(some), order == 1))
        self.hashes, self.own, self.first = np.concatenate(hashes), np.concatenate(own), np.concatenate(first)
        self.order = np.argsort(self.hashes)
        self.hashes, self.own, self.first = self.hashes[self.order], self.own[self.order], self.first[self.order]


# ---------------------------------------------------------------- counting
def packed_hashes(hashes: np.ndarray) -> list[bytes]:
    """Byte planes of the steps between hashes, sorted ones or a few sorted runs (steps are modulo 2^64)."""
    return planes(np.diff(hashes, prepend=np.uint64(0)))


def unpacked_hashes(x: list[bytes]) -> np.ndarray:
    return np.cumsum(unplaned(x).view(np.uint64), dtype=np.uint64)


def _packets(n: int, orders: list[int], bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, body in zip(batch.column("block").to_pylist(), batch.column("body")):
                grams = Round(unpack(body.as_py()), n, orders)
                edges = np.searchsorted(grams.hashes >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))
                parts = [p for p in range(1 << bits) if edges[p + 1] > edges[p]]
                out = []
                for p in parts:
                    cut = slice(edges[p], edges[p + 1])
                    out.append(pack({"hashes": packed_hashes(grams.hashes[cut] - (np.uint64(p) << np.uint64(64 - bits))), "first": np.packbits(grams.first[cut]),
                                     "kept": narrow(grams.own[cut, KEPT]), "deleted": narrow(grams.own[cut, DELETED])}))
                yield pa.RecordBatch.from_arrays([pa.array([number] * len(parts), pa.int64()), pa.array(parts, pa.int32()), pa.array(out, pa.binary())],
                                                 ["block", "part", "body"])
    return run


def _runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[list[dict]]:
    """Rows of equal key, of sorted rows."""
    now: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if now and now[0][key] != row[key]:
                yield now
                now = []
            now.append(row)
    if now:
        yield now


def _replies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For every packet of a part: which of its grams other blocks hold, and their sums; and the part's distinct trained words."""
    for rows in _runs(batches, "part"):
        packets = [unpack(r["body"]) for r in rows]
        hashes = [unpacked_hashes(p["hashes"]) for p in packets]
        first = np.concatenate([np.unpackbits(p["first"], count=len(h)) for p, h in zip(packets, hashes)])
        at, distinct = pd.factorize(np.concatenate(hashes))
        times = np.bincount(at)
        sums = {k: np.bincount(at, np.concatenate([p[k] for p in packets])).astype(np.int64) for k in ("kept", "deleted")}
        out, place = [], 0
        for h in hashes:
            mine = at[place:place + len(h)]
            place += len(h)
            shared = times[mine] > 1
            out.append(pack({"shared": np.packbits(shared), "size": len(h), **{k: planes(v[mine[shared]]) for k, v in sums.items()}}))
        words = np.zeros(len(distinct), bool)
        words[at[first == 1]] = True
        trained = np.zeros(len(rows), np.int64)
        trained[0] = np.count_nonzero(words & (sums["kept"] + sums["deleted"] > 0))
        yield pa.RecordBatch.from_arrays([pa.array([r["block"] for r in rows], pa.int64()), pa.array([r["part"] for r in rows], pa.int32()),
                                          pa.array(out, pa.binary()), pa.array(trained)], ["block", "part", "body", "trained"])


def _resolved(n: int, orders: list[int], totals: Totals):
    """Blocks with the counts of a round's orders; a block comes before its replies, which come in order of their parts.

    The last round also passes on the samples for the weights (``part`` -2).
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs(batches, "block"):
            block, replies = unpack(rows[0]["body"]), [unpack(r["body"]) for r in rows[1:]]
            grams = Round(block, n, orders)
            held, sums = np.zeros(len(grams.hashes), bool), grams.own.copy()
            if replies:
                held[grams.order] = by_hash = np.concatenate([np.unpackbits(r["shared"], count=r["size"]) for r in replies]).astype(bool)
                for name, role in (("kept", KEPT), ("deleted", DELETED)):
                    sums[by_hash, role] = np.concatenate([unplaned(r[name]) for r in replies])
            place = 0
            unsorted = np.empty_like(sums)
            unsorted[grams.order] = sums
            for own, some in grams.of:
                end = place + len(some)
                if orders[-1] == n:
                    whole = own.copy()
                    whole[some] = unsorted[place:end]
                    grams.known.append(whole)
                else:
                    shared = np.zeros(len(own), bool)
                    shared[some] = held[place:end]
                    mine = unsorted[place:end][held[place:end]]
                    block["counts"].append({"shared": np.packbits(shared), "kept": planes(mine[:, KEPT]), "deleted": planes(mine[:, DELETED])})
                place = end
            out = [pack(block)] if orders[-1] < n else _counted_tokens(block, grams, totals)
            yield pa.RecordBatch.from_arrays([pa.array([rows[0]["block"]] * len(out), pa.int64()), pa.array([-1] + [-2] * (len(out) - 1), pa.int32()),
                                              pa.array(out, pa.binary())], ["block", "part", "body"])
    return run


def _counted_tokens(block: dict, grams: Round, totals: Totals) -> list[bytes]:
    """What scoring needs of a block: by order, the training counts of the gram that ends at each token; and its sample for the weights."""
    by_token = {}
    for name, roles in (("whole", [KEPT, DELETED]), ("kept", [KEPT])):
        by_token[name] = [np.where(grams.grams.real, counts[:, roles].sum(axis=1)[at], -1) for counts, at in zip(grams.known, grams.at)]
    done = {k: block[k] for k in ("ids", "roles", "lengths")} | {"counts": [planes(c + 1) for c in by_token["whole"]]}
    some = np.flatnonzero(grams.grams.real & (grams.grams.role == DELETED))
    if not len(some):
        return [pack(done)]
    p, bucket = estimates(by_token["kept"], totals, True)
    return [pack(done), pack({"p": p[some, 1:].astype(np.float32), "bucket": bucket[some].astype(np.int16)})]


@dataclass
class Totals:
    """Of the training documents: tokens, those in deleted documents, documents, deleted ones, distinct tokens."""

    tokens: int
    deleted_tokens: int
    docs: int
    deleted_docs: int
    types: int = 0


def counted(docs: DataFrame, scratch: Scratch, n: int = 3) -> tuple[DataFrame, DataFrame, Totals]:
    """Blocks of all documents with, by token, the counts of its grams of orders 1 to ``n``; samples for the weights; and the totals."""
    spark = docs.sparkSession
    body = F.coalesce(docs["text"].cast("string"), F.lit("")).cast("binary")
    doc_id = docs["doc_id"].cast("long")
    rows = docs.select(doc_id.alias("doc_id"), _role(doc_id).alias("role"), body.alias("body"))
    made = scratch.table(rows.mapInArrow(_make_blocks(n), BODY + "".join(f", {s} long" for s in STATS)), "blocks-0")
    totals = Totals(*[x or 0 for x in made.agg(*[F.sum(s) for s in STATS]).first()])
    blocks, before = made.select("block", "part", "body"), "blocks-0"
    for orders in [list(range(1, min(n, 2) + 1)), *[[order] for order in range(3, n + 1)]]:
        # a part's packets hold some millions of grams at most
        bits = min(24, max(4, (2 * partitions(spark)).bit_length(), (totals.tokens // 2_000_000).bit_length()))
        packets = blocks.mapInArrow(_packets(n, orders, bits), BODY)
        name = f"replies-{orders[-1]}"
        replies = scratch.table(packets.repartition("part").sortWithinPartitions("part").mapInArrow(_replies, BODY + ", trained long"), name, BLOCK_ROWS)
        if orders[0] == 1:
            totals.types = replies.agg(F.sum("trained")).first()[0] or 0
        both = blocks.unionByName(replies.drop("trained")).repartition("block").sortWithinPartitions("block", "part")
        found = scratch.table(both.mapInArrow(_resolved(n, orders, totals), BODY), f"blocks-{orders[-1]}", 32 * BLOCK_ROWS)
        blocks = found.where("part = -1")
        scratch.drop(before, name)
        before = f"blocks-{orders[-1]}"
    return blocks, found.where("part = -2"), totals


# ---------------------------------------------------------------- the model
def estimates(counts: list[np.ndarray], totals: Totals, kept_only: bool) -> tuple[np.ndarray, np.ndarray]:
    """Estimates of orders 0 to n for every token (one row each), and its bucket. counts: by order, of the gram that ends at a token; -1 at start tokens.

    A bucket is 64 * order + the power of two of the context's count, of the highest
    order whose context was seen; higher orders' estimates are 0.
    """
    docs = totals.docs - totals.deleted_docs if kept_only else totals.docs
    tokens = totals.tokens - totals.deleted_tokens if kept_only else totals.tokens
    p = np.zeros((len(counts[0]), len(counts) + 1))
    p[:, 0] = 1 / (totals.types + 1)
    bucket = np.zeros(len(p), np.int64)
    context = np.full(len(p), tokens, np.int64)
    for order, count in enumerate(counts, 1):
        count = np.where(count < 0, docs, count)
        seen = context > 0
        p[seen, order] = count[seen] / context[seen]
        bucket[seen] = 64 * order + np.log2(context[seen]).astype(np.int64)
        context = np.concatenate([np.zeros(1, np.int64), count[:-1]])
    return p, bucket


@dataclass
class Weights:
    """Mixture weights of orders 0 to n by bucket."""

    n: int
    of: np.ndarray

    @staticmethod
    def equal(n: int) -> Weights:
        of = np.zeros((64 * (n + 1), n + 1))
        for order in range(n + 1):
            of[64 * order:64 * (order + 1), :order + 1] = 1 / (order + 1)
        return Weights(n, of)

    def mixed(self, p: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        return (self.of[bucket] * p).sum(axis=1)


def _expected(weights: Weights, uniform: float):
    """Per batch and bucket: expected tokens of each order, tokens, and their log probability."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(weights.of), weights.n + 3))
        for batch in batches:
            for body in batch.column("body").to_pylist():
                x = unpack(body)
                bucket = x["bucket"].astype(np.int64)
                part = weights.of[bucket] * np.concatenate([np.full((len(bucket), 1), uniform), x["p"].astype(np.float64)], axis=1)
                whole = part.sum(axis=1)
                for k in range(weights.n + 1):
                    sums[:, k] += np.bincount(bucket, part[:, k] / whole, minlength=len(sums))
                sums[:, -2] += np.bincount(bucket, minlength=len(sums))
                sums[:, -1] += np.bincount(bucket, np.log(whole), minlength=len(sums))
        some = np.flatnonzero(sums[:, -2])
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), *[pa.array(sums[some, k]) for k in range(sums.shape[1])]],
                                         ["bucket", *[f"s{k}" for k in range(sums.shape[1])]])
    return run


def learned(samples: DataFrame, totals: Totals, n: int = 3, rounds: int = 12, least_gain: float = 1e-4) -> Weights:
    """Weights by expectation-maximisation; each round is one narrow pass and a sum per bucket.

    A bucket's weights start equal, and one token spread evenly over its orders is
    added to its expected tokens, so that no weight becomes zero. Ends when a token's
    mean log probability gains less than ``least_gain``.
    """
    weights, before = Weights.equal(n), -np.inf
    names = [f"s{k}" for k in range(n + 3)]
    for _ in range(rounds):
        sums = samples.select("body").mapInArrow(_expected(weights, 1 / (totals.types + 1)), "bucket int, " + ", ".join(f"{s} double" for s in names))
        rows = sums.groupBy("bucket").agg(*[F.sum(s).alias(s) for s in names]).collect()  # at most 64 * (n + 1) buckets
        now = sum(r[names[-1]] for r in rows) / max(1, sum(r[names[-2]] for r in rows))
        prior = Weights.equal(n).of
        for r in rows:
            found = np.array([r[s] for s in names[:n + 1]]) + prior[r["bucket"]]
            weights.of[r["bucket"]] = found / found.sum()
        if now - before < least_gain:
            break
        before = now
    return weights


# ---------------------------------------------------------------- scores
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def block_scores(block: dict, n: int, totals: Totals, weights: Weights) -> pa.RecordBatch:
    counts = [unplaned(c) - 1 for c in block["counts"]]
    p, bucket = estimates(counts, totals, False)
    real = counts[0] >= 0
    lengths = block["lengths"] - (n - 1)
    begin = np.cumsum(lengths) - lengths
    whole = np.log10(weights.mixed(p[real], bucket[real]))
    count = counts[0][real]
    base = np.log10((count + 0.1) / (totals.tokens + 0.1 * (totals.types + 1)))
    return pa.RecordBatch.from_arrays(
        [pa.array(block["ids"], pa.int64()), pa.array(block["roles"] == HELD_OUT), pa.array(lengths), pa.array(np.add.reduceat((count > 0).astype(np.int64), begin)),
         pa.array(np.full(len(lengths), totals.tokens)), pa.array(np.add.reduceat(base, begin)), pa.array(np.add.reduceat(whole, begin))],
        [c.split()[0] for c in SCORES.split(", ")])


def scores(docs: DataFrame, scratch: Scratch, n: int = 3) -> DataFrame:
    """One row per document: tokens, known tokens, add-0.1 unigram score and the model's score, as log10 probabilities."""
    ship(docs.sparkSession)
    blocks, samples, totals = counted(docs, scratch, n)
    weights = learned(samples, totals, n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for body in batch.column("body").to_pylist():
                yield block_scores(unpack(body), n, totals, weights)
    return blocks.mapInArrow(run, SCORES)
