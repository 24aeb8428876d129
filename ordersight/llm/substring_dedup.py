"""Removal of repeated word windows by level-wise doubling.

A window of w words that occurs in two documents has halves that do. So repeated
windows are found level by level: short ones first, and only windows repeated at
one length are extended to twice that length (the last step before ``window`` is
cut to it), until no candidate survives or ``longest`` is reached.

First level: runs of ceil(window / 2) words. Of the short runs inside each
``window``-word window only the one with the smallest hash is looked at, the same
one wherever the window stands; this keeps about a quarter of the positions and
loses no window. Next level: windows whose short run is repeated. Levels above
(``longest`` > ``window``) extend windows both halves of which are repeated.

Each level writes its candidates (hash of 64 bits for short runs, 96 for windows;
document; position) and finds those in several documents in one range-partitioned,
sorted pass (``occurrences``), which cuts a window that very many documents share
into many partitions. Positions return to their document as one packed list.

Removal is judged on the input: a word goes if a window that covers it also starts
in a document with a smaller ``doc_id``.

Defined results: null and empty texts have no words; texts shorter than a window
lose nothing; a null ``doc_id`` is a document after all others; rows with one
``doc_id`` are one document; equal rows get equal results; an empty table gives
an empty result; other columns are never read by name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ordersight.llm.common import Scratch, as_long, gram_hashes, keyed_text, slices, word_hashes
from ordersight.llm.occurrences import ROWS as CANDIDATES, repeated_rows


def _window_min(x: np.ndarray, n: int) -> np.ndarray:
    """Smallest of each ``n`` consecutive values."""
    have = 1
    while have * 2 <= n:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[:len(x) - (n - have)], x[n - have:]) if n > have else x


class Block:
    """Words of a block of texts on one line, with hashes of runs that stay inside a text."""

    def __init__(self, bodies: list[bytes]):
        words = [b.split() for b in bodies]
        self.lengths = np.array([len(w) for w in words], np.int64)
        self.ends = np.cumsum(self.lengths)
        self.begins = self.ends - self.lengths
        self.hashes = word_hashes([w for doc in words for w in doc])
        self.doc = np.repeat(np.arange(len(words)), self.lengths)

    def runs(self, n: int, which: int = 0) -> np.ndarray:
        return gram_hashes(self.hashes, n, which)

    def inside(self, n: int) -> np.ndarray:
        """Whether a run of n words that begins at each place stays inside its text."""
        k = max(0, len(self.hashes) - n + 1)
        return np.arange(k) + n <= self.ends[self.doc[:k]] if k else np.zeros(0, bool)

    def window_minima(self, n: int, window: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of runs of n words, and for each window's first place the smallest hash in it."""
        runs = self.runs(n)
        return runs, _window_min(runs, window - n + 1) if len(self.hashes) >= window else np.zeros(0, np.uint64)

    def marked(self, starts: list[bytes | None]) -> np.ndarray:
        """Places on the line of each text's packed list of positions."""
        on = np.zeros(len(self.hashes) + 1, bool)
        for begin, packed in zip(self.begins.tolist(), starts):
            if packed:
                on[begin + np.frombuffer(packed, np.int32)] = True
        return on


def short_length(window: int) -> int:
    return (window + 1) // 2


def _batch(batch: pa.RecordBatch, block: Block, at: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> pa.RecordBatch:
    doc = block.doc[at]
    take = pa.array(doc)
    return pa.RecordBatch.from_arrays(
        [pa.array(as_long(h1)), pa.array((h2 & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32)), batch.column("doc_id").take(take), batch.column("text_key").take(take),
         pa.array((at - block.begins[doc]).astype(np.int32))], ["h1", "h2", "doc_id", "text_key", "at"])


def _short_runs(window: int):
    """First level: in each window the short run with the smallest hash."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = short_length(window)
        for batch in slices(batches):
            block = Block(batch.column("body").to_pylist())
            runs, least = block.window_minima(n, window)
            if not len(least):
                continue
            least = np.where(block.inside(window), least, np.uint64(0))
            # a run is the smallest of some window around it if the largest of these windows' minima equals its hash
            span = window - n + 1
            padded = np.concatenate([np.zeros(span - 1, np.uint64), least, np.zeros(span - 1, np.uint64)])
            most = ~_window_min(~padded, span)
            at = np.flatnonzero(most[:len(runs)] == runs)
            yield _batch(batch, block, at, runs[at], np.zeros(len(at), np.uint64))
    return run


def _windows(window: int, length: int):
    """Windows of ``length`` words whose parts are repeated: the short run of the first level, or both halves."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = short_length(window)
        for batch in slices(batches):
            block = Block(batch.column("body").to_pylist())
            inside = np.flatnonzero(block.inside(length))
            on = block.marked(batch.column("starts").to_pylist())
            if length == window:
                runs, least = block.window_minima(n, window)
                if not len(least):
                    continue
                # a window is a candidate if a marked run in it has the window's smallest hash
                held = np.where(on[:len(runs)], runs, ~np.uint64(0))
                at = inside[_window_min(held, window - n + 1)[inside] == least[inside]]
            else:
                at = inside[on[inside] & on[inside + length // 2]]
            yield _batch(batch, block, at, block.runs(length)[at], block.runs(length, 1)[at])
    return run


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("text_key"),
             *[pa.array([np.sort(np.array(x, np.int32)).tobytes() for x in batch.column(c).to_pylist()], pa.binary()) for c in ("starts", "late")]],
            ["doc_id", "text_key", "starts", "late"])


def _repeated(candidates: DataFrame, scratch: Scratch, name: str, late_only: bool = False) -> DataFrame:
    """Per document the positions of its repeated windows (``starts``), and of those that a smaller ``doc_id`` holds too (``late``)."""
    rows = repeated_rows(candidates, scratch, name, late_only)
    return (rows.groupBy("doc_id", "text_key").agg(F.collect_set("at").alias("starts"), F.collect_set(F.when(F.col("late"), F.col("at"))).alias("late"))
                .mapInArrow(_pack, "doc_id long, text_key long, starts binary, late binary"))


def with_positions(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``doc_id, text_key, body`` of each row with its document's ``starts`` and ``late`` (null: none)."""
    right = found.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), "starts", "late")
    left = keyed_text(docs)
    return left.join(right, left["doc_id"].eqNullSafe(right["_id"]) & (left["text_key"] == right["_key"]), "left").drop("_id", "_key")


def repeated_windows(docs: DataFrame, scratch: Scratch, window: int = 13, longest: int | None = None,
                     late_only: bool = False) -> dict[int, DataFrame]:
    """Repeated windows by length: {length: (doc_id, text_key, starts, late)}.

    Lengths are ``window`` and, up to ``longest`` (None: until none survives), its
    doublings. A longer window's words are all covered by windows of ``window``
    words, so removal needs no level above the first. ``late_only``: with
    ``longest`` = ``window``, the last level's ``starts`` need not be whole.
    """
    level = scratch.table(keyed_text(docs).mapInArrow(_short_runs(window), CANDIDATES), "short")
    found = scratch.table(_repeated(level, scratch, "flags-short"), "found-short")
    scratch.drop("short", "flags-short")
    out: dict[int, DataFrame] = {}
    length = window
    while True:
        able = with_positions(docs, found).where("starts is not null")
        level = scratch.table(able.mapInArrow(_windows(window, length), CANDIDATES), f"windows-{length}")
        found = out[length] = scratch.table(_repeated(level, scratch, f"flags-{length}", late_only and length == longest), f"found-{length}")
        scratch.drop(f"windows-{length}", f"flags-{length}")
        length *= 2
        if (longest is not None and length > longest) or found.isEmpty():
            return out


def kept_words(body: bytes, late: bytes | None, window: int) -> tuple[list[bytes], int]:
    """Words that no late window covers, and the number of words before."""
    words = body.split()
    if not late:
        return words, len(words)
    change = np.zeros(len(words) + 1, np.int64)
    at = np.frombuffer(late, np.int32)
    np.add.at(change, at, 1)
    np.add.at(change, at + window, -1)
    cover = np.cumsum(change[:-1])
    return [w for w, c in zip(words, cover.tolist()) if not c], len(words)


def removal(docs: DataFrame, scratch: Scratch, window: int = 13) -> DataFrame:
    """Each row's ``doc_id``, ``n_words``, ``n_removed`` and the ``kept`` words joined by one space."""
    found = repeated_windows(docs, scratch, window, longest=window, late_only=True)[window]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            done = [kept_words(b, late, window) for b, late in zip(batch.column("body").to_pylist(), batch.column("late").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([n for _, n in done], pa.int64()), pa.array([n - len(k) for k, n in done], pa.int64()),
                 pa.array([b" ".join(k).decode("utf-8", "replace") for k, _ in done], pa.string())],
                ["doc_id", "n_words", "n_removed", "kept"])
    return with_positions(docs, found).mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string")
