"""Benchmark decontamination by size-partitioned min-wise containment search.

Test items are short and documents long, so Jaccard similarity says little; what
counts is containment: the share of an item's distinct word shingles that the
document holds. Items are partitioned by size (their number of shingles q, and the
words in a shingle). An item's min-wise sketch is its s smallest shingle hashes,
s = q - ceil(t * q) + 1: a document that holds at least t * q of the q shingles must
hold one of any s of them, so looking a document's shingles up in the sketches loses
no pair. Pairs found are verified by exact containment of the shingle strings.

Neither side goes to the driver. Items are cut into shingles by tasks, a row for each,
equal texts once. Of all item shingles a bit map of fixed size (``filter_bits``) is
made by an aggregate and sent to the tasks; one narrow pass over the documents leaves
the shingles that the map lets through, as a table. Sketches and that table are joined
by hash, the candidates are joined with both sides' shingles again and counted. A
larger benchmark fills the map, which then lets more through, but never changes the
result. Documents are not shuffled.

Words: ASCII punctuation deleted, A-Z lower-cased, split at ASCII white space.
Defined results: a null or empty text holds no shingle; an item without words
matches nothing; an item with fewer words than a shingle is one shingle, its
whole word sequence; equal rows each get their own result rows; an empty table
on either side gives no rows; other columns are never read by name.
"""

from __future__ import annotations

import math
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ordersight.llm.common import Scratch, as_long, gram_hashes, keyed_text, slices, word_hashes

LOWER = bytes.maketrans(string.ascii_uppercase.encode(), string.ascii_lowercase.encode())
PUNCTUATION = string.punctuation.encode()
SHINGLES = "key string, gram int, h long, shingle binary, sketch boolean, q int, need int"
HITS = "row long, doc_id long, text_key long, gram int, h long, shingle binary, size int"


def norm_words(body: bytes) -> list[bytes]:
    return body.translate(LOWER, PUNCTUATION).split()


def shingle_set(words: list[bytes], n: int) -> set[bytes]:
    """Distinct shingles of ``n`` words (fewer words: the whole sequence; none: empty)."""
    if not words:
        return set()
    return {b" ".join(words[i:i + n]) for i in range(max(1, len(words) - n + 1))}


def needed(q: int, least: float) -> int:
    """Shingles of q that make a containment of ``least``."""
    return max(1, math.ceil(least * q - 1e-9))


def _hash(shingle: bytes) -> int:
    words = word_hashes(shingle.split(b" "))
    return int(as_long(gram_hashes(words, len(words)))[0])


def _item_shingles(n: int, least: float):
    """A row for each distinct shingle of an item, with whether it is in the item's sketch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            for key, body in zip(batch.column("key").to_pylist(), batch.column("body").to_pylist()):
                words = norm_words(body)
                if not words:
                    continue
                gram = min(n, len(words))
                shingles = sorted((_hash(s) % 2**64, s) for s in shingle_set(words, gram))
                q, need = len(shingles), needed(len(shingles), least)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([key] * q), pa.array([gram] * q, pa.int32()), pa.array(as_long(np.array([h for h, _ in shingles], np.uint64))),
                     pa.array([s for _, s in shingles], pa.binary()), pa.array(np.arange(q) < q - need + 1),
                     pa.array([q] * q, pa.int32()), pa.array([need] * q, pa.int32())], [c.split()[0] for c in SHINGLES.split(", ")])
    return run


def _bit_map(shingles: DataFrame, bits: int) -> np.ndarray:
    """Which leading parts of hashes some item shingle has: 2^bits bits, made as 2^(bits - 6) longs at most."""
    place = F.shiftrightunsigned("h", 64 - bits)
    rows = shingles.groupBy(F.shiftright(place, 6).alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(h, {64 - bits}) & 63 as int))")).alias("set"))
    out = np.zeros(1 << bits - 6, np.int64)
    for r in rows.collect():
        out[r["word"]] = r["set"]
    return out.view(np.uint64)


def _hits(sent, grams: list[int], bits: int):
    """The distinct shingles of each document that the bit map lets through."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        allowed = sent.value
        row = TaskContext.get().partitionId() << 40
        for batch in slices(batches):
            ids, keys = batch.column("doc_id"), batch.column("text_key")
            docs = [norm_words(b) for b in batch.column("body").to_pylist()]
            lengths = np.array([len(w) for w in docs])
            ends = np.cumsum(lengths)
            words = [w for doc in docs for w in doc]
            hashes = word_hashes(words)
            out: dict[tuple[int, bytes], tuple[int, int]] = {}
            for gram in grams:
                found = gram_hashes(hashes, gram)
                place = found >> np.uint64(64 - bits)
                at = np.flatnonzero(allowed[place >> np.uint64(6)] >> (place & np.uint64(63)) & np.uint64(1))
                doc = np.searchsorted(ends, at, side="right")
                inside = at + gram <= ends[doc]
                for d, i, h in zip(doc[inside].tolist(), at[inside].tolist(), as_long(found[at[inside]]).tolist()):
                    out[d, b" ".join(words[i:i + gram])] = gram, h
            where = np.array([d for d, _ in out], np.int64)
            of = np.array(list(out.values()), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [pa.array(row + where), ids.take(pa.array(where)), keys.take(pa.array(where)), pa.array(of[:, 0].astype(np.int32)), pa.array(of[:, 1]),
                 pa.array([s for _, s in out], pa.binary()), pa.array((lengths[where] - of[:, 0] + 1).astype(np.int32))], [c.split()[0] for c in HITS.split(", ")])
            row += len(batch)
    return run


def _contained(docs: DataFrame, items: DataFrame, scratch: Scratch, n: int, least: float, bits: int) -> tuple[DataFrame, DataFrame]:
    """``row, doc_id, text_key, key, q, shared`` of the pairs that reach ``least``, and ``item_id, key`` of the items."""
    spark = docs.sparkSession
    text = F.coalesce(items["text"].cast("string"), F.lit("")).cast("binary")
    named = items.select(items["item_id"].cast("long").alias("item_id"), F.sha2(text, 256).alias("key"), text.alias("body"))
    texts = named.groupBy("key").agg(F.first("body").alias("body"))
    shingles = scratch.table(texts.mapInArrow(_item_shingles(n, least), SHINGLES), "shingles")
    grams = sorted(r["gram"] for r in shingles.select("gram").distinct().collect())  # n at most
    sent = spark.sparkContext.broadcast(_bit_map(shingles, bits))  # 2^bits bits
    hits = scratch.table(keyed_text(docs).mapInArrow(_hits(sent, grams, bits), HITS), "hits")
    found = (hits.join(shingles.where("sketch").drop("shingle", "sketch"), ["gram", "h"]).where("size >= need")
                 .select("row", "key").distinct())
    # of a candidate's item all shingles, and of those the document's
    wanted = found.join(shingles.drop("sketch", "h"), "key")
    pairs = (wanted.join(hits.drop("h", "size"), ["row", "gram", "shingle"])
                   .groupBy("row", "doc_id", "text_key", "key", "q", "need").agg(F.count("*").alias("shared")).where("shared >= need"))
    return scratch.table(pairs, "pairs"), named.drop("body")


def contaminated_pairs(docs: DataFrame, items: DataFrame, scratch: Scratch | None = None, n: int = 5, least: float = 0.8, filter_bits: int = 24) -> DataFrame:
    """One row per (document, item) whose containment is ``least`` or more."""
    pairs, named = _contained(docs, items, scratch or Scratch(docs.sparkSession, "decontaminate"), n, least, filter_bits)
    return pairs.join(named, "key").select("doc_id", "item_id", F.col("q").alias("item_shingles"), F.col("shared").cast("int").alias("shared_shingles"),
                                           (F.col("shared") / F.col("q")).alias("containment"))


def decontaminate(docs: DataFrame, items: DataFrame, scratch: Scratch | None = None, n: int = 5, least: float = 0.8, filter_bits: int = 24) -> DataFrame:
    """``docs`` without the rows that hold an item."""
    scratch = scratch or Scratch(docs.sparkSession, "decontaminate")
    pairs, _ = _contained(docs, items, scratch, n, least, filter_bits)
    held = scratch.table(pairs.select(F.col("doc_id").alias("_held_id"), F.col("text_key").alias("_held_key")).distinct(), "held")
    key = F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit("")))
    return docs.join(held, docs["doc_id"].cast("long").eqNullSafe(held["_held_id"]) & (key == held["_held_key"]), "left_anti")
