"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints within d bits have a value half-way: one that differs from each
in at most d/2 bits. Every distinct fingerprint emits all variants within d/2
bits; variants are shuffled, and fingerprints that meet at one variant are linked
after their distance is verified.

With 64 bits and d = 4 a fingerprint has 2,081 variants. They are not written out
before the shuffle. The shuffle key is the variant's leading ``bits`` bits: a
fingerprint is sent once to every leading part that one of its variants has, and
the variants that begin so are spelled out by the task that receives it, in
blocks of bounded size. For 8 leading bits that is 37 rows in place of 2,081 and
the number grows with the square of ``bits``, not with the number of variants.

Only distinct fingerprints take part, so exact copies cost one row. A part with
more than ``most`` fingerprints (one large group of near copies) is sent on with
8 more leading bits, again and again; one full variant has 2,081 fingerprints
around it at most, so this ends. Links leave a task as a spanning forest, fewer
than its fingerprints, never as all pairs of a group.

Defined results: a null text is empty; texts without words have fingerprint zero,
which links like any other; equal rows and ties have equal results; null
``doc_id`` rows take part, and a component's id is its smallest non-null
``doc_id``; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from ordersight.llm.common import Scratch, as_long, keyed_text, slices
from ordersight.llm.components import components

WIDTH = 64
BLOCK = 1 << 21  # variants spelled out at a time
PARTS = "part long, prints binary"


# ---------------------------------------------------------------- fingerprints
def fingerprint(body: bytes, n: int = 4, seed: int = 42) -> int:
    """64-bit SimHash of the word shingles of a text, repeats included: a bit is set if it is in over half the hashes."""
    words = body.lower().split()
    if not words:
        return 0
    if len(words) <= n:
        hashes = np.array([xxhash.xxh64_intdigest(b" ".join(words), seed)], np.uint64)
    else:
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = np.concatenate([[0], ends[:-n]]).tolist()
        digest = xxhash.xxh64_intdigest
        hashes = np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts, (ends[n - 1:] - 1).tolist())), np.uint64, len(starts))
    ones = np.zeros(WIDTH, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        some = hashes[i:i + (1 << 16)]
        ones += np.unpackbits(some.view(np.uint8), bitorder="little").reshape(-1, WIDTH).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, n: int = 4, seed: int = 42) -> DataFrame:
    """``doc_id, text_key, print`` (the fingerprint as a signed long) for each row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            prints = np.array([fingerprint(b, n, seed) for b in batch.column("body").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), pa.array(as_long(prints))],
                                             ["doc_id", "text_key", "print"])
    return keyed_text(docs).mapInArrow(run, "doc_id long, text_key long, print long")


# ---------------------------------------------------------------- balls
@lru_cache(maxsize=None)
def masks(bits: int, radius: int) -> np.ndarray:
    """All ``bits``-bit values with at most ``radius`` ones."""
    return np.array([sum(1 << i for i in c) for r in range(min(bits, radius) + 1) for c in combinations(range(bits), r)], np.uint64)


def ones(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).astype(np.int64)


def _spread(prints: np.ndarray, part: int, have: int, more: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Leading parts of ``have + more`` bits below ``part`` that variants of the prints have, and the place of the print of each."""
    used = ones((prints >> np.uint64(WIDTH - have)) ^ np.uint64(part)) if have else np.zeros(len(prints), np.int64)
    own = (prints >> np.uint64(WIDTH - have - more)) & np.uint64((1 << more) - 1)
    flips = masks(more, radius)
    parts = own[:, None] ^ flips[None, :]
    fits = used[:, None] + ones(flips)[None, :] <= radius
    place = np.broadcast_to(np.arange(len(prints))[:, None], parts.shape)[fits]
    return (np.uint64(part << more) if part else np.uint64(0)) | parts[fits], place


def _grouped(parts: np.ndarray, place: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(parts, kind="stable")
    parts, place = parts[order], place[order]
    for k in np.split(np.arange(len(parts)), np.flatnonzero(parts[1:] != parts[:-1]) + 1) if len(parts) else ():
        yield int(parts[k[0]]), place[k]


def _meetings(prints: np.ndarray, place: np.ndarray, part: int, have: int, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (first, other) that meet at a variant that begins with ``part``."""
    low = WIDTH - have
    if len(place) < 2:
        return
    if low > 6 and len(place) * len(masks(low, radius)) > BLOCK:
        parts, inner = _spread(prints[place], part, have, 6, radius)
        for below, k in _grouped(parts, inner):
            yield from _meetings(prints, place[k], below, have + 6, radius)
        return
    mine = prints[place]
    used = ones((mine >> np.uint64(low)) ^ np.uint64(part)) if have else np.zeros(len(mine), np.int64)
    rest = mine & np.uint64((1 << low) - 1) if low < 64 else mine
    variants, owner = [], []
    for r in range(radius + 1):
        k = np.flatnonzero(used == r)
        ball = rest[k][:, None] ^ masks(low, radius - r)[None, :]
        variants.append(ball.ravel())
        owner.append(np.repeat(place[k], ball.shape[1]))
    variants, owner = np.concatenate(variants), np.concatenate(owner)
    values = np.sort(variants)
    met = values[1:][values[1:] == values[:-1]]
    if not len(met):
        return
    met = np.unique(met)
    at = np.minimum(np.searchsorted(met, variants), len(met) - 1)
    hit = met[at] == variants
    at, owner = at[hit], owner[hit]
    order = np.lexsort((owner, at))
    at, owner = at[order], owner[order]
    start = np.concatenate([[True], at[1:] != at[:-1]])
    first = owner[np.maximum.accumulate(np.where(start, np.arange(len(at)), 0))]
    yield first[~start], owner[~start]


def _forest(n: int, first: np.ndarray, other: np.ndarray, root: np.ndarray) -> np.ndarray:
    """Join the given pairs to the forest ``root`` (smallest place of each tree)."""
    while True:
        a, b = root[first], root[other]
        apart = a != b
        if not apart.any():
            return root
        low, high = np.minimum(a, b)[apart], np.maximum(a, b)[apart]
        np.minimum.at(root, high, low)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up


def links(prints: np.ndarray, part: int, have: int, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of the fingerprints that meet at variants beginning with ``part``.

    Fingerprints at one variant are within ``distance`` of each other; the bits are
    counted all the same.
    """
    prints = np.unique(prints)
    root = np.arange(len(prints))
    for first, other in _meetings(prints, np.arange(len(prints)), part, have, distance // 2):
        near = ones(prints[first] ^ prints[other]) <= distance
        root = _forest(len(prints), first[near], other[near], root)
    k = np.flatnonzero(root != np.arange(len(prints)))
    return prints[k], prints[root[k]]


def _send(have: int, more: int, distance: int):
    """Rows (leading part, fingerprints) of a block of fingerprints or of parts that are sent on."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if have:
                blocks = [(p % (1 << WIDTH), np.frombuffer(b, np.uint64)) for p, b in zip(batch.column("part").to_pylist(), batch.column("prints").to_pylist())]
            else:
                blocks = [(0, batch.column("print").to_numpy().view(np.uint64))]
            for part, prints in blocks:
                for k in range(0, len(prints), 1 << 15):
                    some = prints[k:k + (1 << 15)]
                    rows = list(_grouped(*_spread(some, part, have, more, distance // 2)))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(as_long(np.array([p for p, _ in rows], np.uint64))), pa.array([some[x].tobytes() for _, x in rows], pa.binary())],
                        ["part", "prints"])
    return run


def _meet(have: int, distance: int):
    def run(key, table):
        prints = np.concatenate([np.frombuffer(b, np.uint64) for b in table.column("prints").to_pylist()])
        a, b = links(prints, key[0].as_py() % (1 << WIDTH), have, distance)
        return pa.table({"a": as_long(a), "b": as_long(b)})
    return run


def near_links(prints: DataFrame, scratch: Scratch, distance: int = 4, bits: int | None = None, most: int = 400_000) -> DataFrame:
    """``a, b``: links between distinct fingerprints (column ``print``), a spanning forest of each shuffled part.

    ``bits``: leading bits of the first shuffle, by default so many that a part
    holds the own fingerprints of about a thousand, and 8 at least. A part with
    more than ``most`` fingerprints is sent on with 8 more.
    """
    out, have, level = None, 0, 0
    total = prints.count()
    bits = max(8, (total // 1024).bit_length()) if bits is None else bits
    rows, more = prints, min(bits, WIDTH)
    while True:
        source = rows.mapInArrow(_send(have, more, distance), PARTS)
        have += more
        sent = scratch.table(source, f"parts-{level}")
        size = sent.groupBy(F.col("part").alias("_part")).agg(F.sum(F.length("prints") / 8).alias("n"))
        large = size.where(F.col("n") > (most if have < WIDTH else 1 << 62)).select("_part")
        n = min(1 << have, max(64, total // 4096))
        few = sent.join(large, F.col("part") == F.col("_part"), "left_anti") if have < WIDTH else sent
        found = scratch.table(few.repartition(n, "part").groupBy("part").applyInArrow(_meet(have, distance), "a long, b long"), f"links-{level}")
        out = found if out is None else out.unionByName(found)
        if have >= WIDTH or large.isEmpty():
            scratch.drop(f"parts-{level}")
            return out
        rows = scratch.table(sent.join(large, F.col("part") == F.col("_part"), "left_semi"), f"large-{level}")
        more, level = min(8, WIDTH - have), level + 1


def near_duplicates(docs: DataFrame, scratch: Scratch, n: int = 4, seed: int = 42, distance: int = 4) -> DataFrame:
    """``doc_id, text_key, print, component_id, root`` for each row of ``docs``.

    ``component_id``: the smallest ``doc_id`` reachable over links, the row's own included;
    ``root``: the component's smallest fingerprint.
    """
    rows = scratch.table(fingerprints(docs, n, seed), "prints")
    distinct = scratch.table(rows.groupBy("print").agg(F.min("doc_id").alias("least_id")), "distinct")
    roots = components(near_links(distinct.select("print"), scratch, distance), scratch)
    member = distinct.join(roots, distinct["print"] == roots["node"], "left").select(
        "print", "least_id", F.coalesce("root", "print").alias("root"))
    least = member.groupBy(F.col("root").alias("_root")).agg(F.min("least_id").alias("component_id"))
    of_print = scratch.table(member.join(least, F.col("root") == F.col("_root"))
                             .select(F.col("print").alias("_print"), "component_id", "root"), "of-print")
    return rows.join(of_print, F.col("print") == F.col("_print")).drop("_print")


def dedup_near(docs: DataFrame, scratch: Scratch, n: int = 4, seed: int = 42, distance: int = 4) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates: the one with the smallest ``doc_id`` (null last; ties: smallest text hash)."""
    found = near_duplicates(docs, scratch, n, seed, distance)
    # map-side combined counts and minima, not a window over the group
    each = found.groupBy("root", "doc_id", "text_key").agg(F.count("*").alias("rows"))
    best = each.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key", "rows")).alias("best"))
    keep = scratch.table(best.select(F.col("best.doc_id").alias("_id"), F.col("best.text_key").alias("_key"), F.col("best.rows").alias("_rows")), "keep")
    text = F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit("")))
    kept = docs.join(keep, docs["doc_id"].eqNullSafe(keep["_id"]) & (text == keep["_key"]), "left_semi")
    return kept if keep.where("_rows > 1").isEmpty() else kept.dropDuplicates(["doc_id", "text"])
