"""Quality classifier: multiple-instance learning with gated attention.

A document is a bag of passages (each ``PASSAGE`` bytes of its text; the whole text
is covered). Every passage is encoded to a vector h = tanh(W x + b) of features
computed from its bytes alone. Gated attention, a = softmax over the document's
passages of w . (tanh(V h) * sigmoid(U h)), is learned from document labels only;
the document's representation is the weighted sum of its passages' vectors, and its
score the logistic of a linear function of that.

Features of a passage: shares of 14 byte classes and of the class pairs of
neighbouring bytes; word statistics (words, repeats of the word before, distinct
words); and shares of hashed whole words and of hashed runs of three bytes, A-Z
lower-cased, in 1,024 buckets each. Ids, languages, sources and labels are no features.
Nothing is computed across a passage's end, so a score doesn't depend on the texts that
are scored with it (but for rounding, below 1e-9).

Fitting takes at most ``sample`` labelled rows (the smallest hashes of ``doc_id``) with
all their passages; only their features, without zeros, reach the driver. Scoring takes
every passage of every text and runs in one narrow pass.

Defined results: a null or empty text is one passage without bytes and has a score;
equal texts have equal scores; null labels or ids are not learned from, of a repeated
label the smallest counts; without two classes of labels every score is their share
of ones (0.5 without any); an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ordersight.llm.common import mix, ship, slices

PASSAGE = 512
CLASSES = 14
WORDS, RUNS = 1024, 1024  # buckets of hashed words, and of hashed runs of three bytes
HIDDEN, GATE = 24, 16
EXACT = CLASSES + CLASSES * CLASSES + 4
WIDTH = EXACT + WORDS + RUNS
PRIME = 0x100000001B3  # odd, so it has an inverse modulo 2^64
INVERSE = pow(PRIME, -1, 2**64)


def _byte_classes() -> np.ndarray:
    of = np.full(256, 13, np.uint8)  # control bytes
    of[0x21:0x7F] = 10  # other punctuation
    for members, k in ((range(0x61, 0x7B), 0), (range(0x41, 0x5B), 1), (range(0x30, 0x3A), 2), (b" ", 3), (b"\t\n\r\x0b\x0c", 4),
                       (b".", 5), (b",", 6), (b"|", 7), (b"#$%&*", 8), (b"!?", 9), (range(0xC0, 0x100), 11), (range(0x80, 0xC0), 12)):
        of[list(members)] = k
    return of


CLASS_OF = _byte_classes()
LOWER = np.array([c + 32 if 0x41 <= c <= 0x5A else c for c in range(256)], np.uint64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def _shares(where: np.ndarray, bucket: np.ndarray, buckets: int, total: int) -> np.ndarray:
    """Square roots of each bucket's share in a passage."""
    out = np.bincount(where * buckets + bucket, minlength=total * buckets).reshape(total, buckets).astype(np.float32)
    out /= np.maximum(out.sum(axis=1, keepdims=True), 1)
    return np.sqrt(out, out=out)


def features(bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Feature rows of all passages, and each text's number of passages. No feature crosses a passage's end, so none depends on other texts."""
    sizes = np.array([len(b) for b in bodies], np.int64)
    count = np.maximum(1, -(-sizes // PASSAGE))
    first = np.cumsum(count) - count
    total = int(count.sum())
    raw = np.frombuffer(b"".join(bodies), np.uint8)
    begin = np.cumsum(sizes) - sizes
    passage = np.repeat(first, sizes) + (np.arange(len(raw)) - np.repeat(begin, sizes)) // PASSAGE
    kind = CLASS_OF[raw].astype(np.int64)
    singles = np.bincount(passage * CLASSES + kind, minlength=total * CLASSES).reshape(total, CLASSES).astype(np.float32)
    inside = passage[1:] == passage[:-1]
    pairs = np.bincount((passage[:-1] * CLASSES * CLASSES + kind[:-1] * CLASSES + kind[1:])[inside],
                        minlength=total * CLASSES * CLASSES).reshape(total, CLASSES * CLASSES).astype(np.float32)
    # words: bytes from one blank or passage end to the next, by a polynomial hash of all their bytes, taken from sums up to each byte
    lower = LOWER[raw]
    ends = np.concatenate([~inside, [True]])[:len(raw)]  # last bytes of passages
    starts = np.concatenate([[True], ends[:-1]])[:len(raw)]
    blank = (kind == 3) | (kind == 4)
    opens, closes = ~blank, ~blank
    opens[1:] &= blank[:-1] | starts[1:]
    closes[:-1] &= blank[1:] | ends[:-1]
    at, last = np.flatnonzero(opens), np.flatnonzero(closes)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((lower + np.uint64(1)) * _powers(PRIME, len(raw)), dtype=np.uint64)])
    word = mix((sums[last + 1] - sums[at]) * _powers(INVERSE, len(raw))[at] + (last - at).astype(np.uint64))
    where = passage[at]
    words = np.bincount(where, minlength=total)
    again = np.bincount(where[1:][(word[1:] == word[:-1]) & (where[1:] == where[:-1])], minlength=total)
    order = np.lexsort((word, where))
    w, p = word[order], where[order]
    fresh = np.ones(len(w), bool)
    fresh[1:] = (w[1:] != w[:-1]) | (p[1:] != p[:-1])
    distinct = np.bincount(p[fresh], minlength=total)
    runs = mix(lower[:-2] * np.uint64(65536) + lower[1:-1] * np.uint64(256) + lower[2:])
    whole = passage[2:] == passage[:-2]
    length = singles.sum(axis=1, keepdims=True)
    n, some = np.maximum(length, 1), np.maximum(words, 1)
    out = np.concatenate([np.sqrt(singles / n), np.sqrt(pairs / n),
                          np.stack([words / n[:, 0] * 4, again / some, distinct / some, length[:, 0] / PASSAGE], axis=1),
                          _shares(where, (word % np.uint64(WORDS)).astype(np.int64), WORDS, total),
                          _shares(passage[:-2][whole], (runs[whole] % np.uint64(RUNS)).astype(np.int64), RUNS, total)], axis=1)
    return out.astype(np.float32), count


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Model:
    """Weights of the encoder, the gated attention and the output."""

    mean: np.ndarray
    scale: np.ndarray
    p: dict[str, np.ndarray]
    constant: float | None = None

    def forward(self, x: np.ndarray, count: np.ndarray) -> dict[str, np.ndarray]:
        p = self.p
        first = np.cumsum(count) - count
        x = (x - self.mean) * self.scale  # in doubles, so that a score hardly depends on what else is multiplied with it
        h = np.tanh(x @ p["W"] + p["b"])
        t, g = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        e = (t * g) @ p["w"]
        a = np.exp(e - np.repeat(np.maximum.reduceat(e, first), count))
        a /= np.repeat(np.add.reduceat(a, first), count)
        z = np.add.reduceat(a[:, None] * h, first, axis=0)
        return {"x": x, "h": h, "t": t, "g": g, "a": a, "z": z, "y": _sigmoid(z @ p["c"] + p["d"])}

    def score(self, x: np.ndarray, count: np.ndarray) -> np.ndarray:
        return np.full(len(count), self.constant) if self.constant is not None else self.forward(x, count)["y"].astype(np.float64)

    def gradients(self, x: np.ndarray, count: np.ndarray, y: np.ndarray, decay: float) -> dict[str, np.ndarray]:
        p, f = self.p, self.forward(x, count)
        first = np.cumsum(count) - count
        dl = (f["y"] - y) / len(y)
        dz = np.repeat(dl[:, None] * p["c"], count, axis=0)
        da = (dz * f["h"]).sum(axis=1)
        de = f["a"] * (da - np.repeat(np.add.reduceat(f["a"] * da, first), count))
        dtg = de[:, None] * p["w"]
        dt, dg = dtg * f["g"] * (1 - f["t"] ** 2), dtg * f["t"] * f["g"] * (1 - f["g"])
        dh = (f["a"][:, None] * dz + dt @ p["V"].T + dg @ p["U"].T) * (1 - f["h"] ** 2)
        out = {"W": f["x"].T @ dh, "b": dh.sum(axis=0), "V": f["h"].T @ dt, "U": f["h"].T @ dg, "w": (f["t"] * f["g"]).T @ de,
               "c": f["z"].T @ dl, "d": dl.sum(keepdims=True)}
        return {k: v + decay * p[k] for k, v in out.items()}


class Bags:
    """Passages' features with the zeros left out: per document, the places and values of the others and each passage's number of them."""

    def __init__(self, rows: list[tuple[bytes, bytes, bytes]]):
        self.rows = [(np.frombuffer(n, np.int32), np.frombuffer(at, np.uint16), np.frombuffer(x, np.float32)) for n, at, x in rows]

    @staticmethod
    def packed(x: np.ndarray) -> tuple[bytes, bytes, bytes]:
        row, at = np.nonzero(x)
        return np.bincount(row, minlength=len(x)).astype(np.int32).tobytes(), at.astype(np.uint16).tobytes(), x[row, at].tobytes()

    def __len__(self) -> int:
        return len(self.rows)

    def some(self, which) -> tuple[np.ndarray, np.ndarray]:
        """Feature rows of some documents, and their numbers of passages."""
        chosen = [self.rows[k] for k in which]
        each = np.concatenate([n for n, _, _ in chosen])
        out = np.zeros((len(each), WIDTH), np.float32)
        out[np.repeat(np.arange(len(each)), each), np.concatenate([at for _, at, _ in chosen])] = np.concatenate([x for _, _, x in chosen])
        return out, np.array([len(n) for n, _, _ in chosen])

    def moments(self) -> tuple[np.ndarray, np.ndarray]:
        """Mean and standard deviation of each feature."""
        n, total, squares = 0, np.zeros(WIDTH), np.zeros(WIDTH)
        for each, at, x in self.rows:
            n += len(each)
            total += np.bincount(at, x, minlength=WIDTH)
            squares += np.bincount(at, x.astype(np.float64) ** 2, minlength=WIDTH)
        return total / n, np.sqrt(np.maximum(squares / n - (total / n) ** 2, 0))


def fit(bags: Bags, labels: np.ndarray, epochs: int = 16, batch: int = 128, rate: float = 5e-3, decay: float = 1e-4) -> Model:
    """Fit by Adam on the cross-entropy of the document labels; the same bags in the same order give the same model."""
    if len(set(labels.tolist())) < 2:
        one = np.zeros(WIDTH, np.float32)
        return Model(one, one, {}, float(labels.mean()) if len(labels) else 0.5)
    mean, spread = bags.moments()
    # a hashed word or run that few passages hold isn't blown up
    scale = 1 / (spread + np.where(np.arange(WIDTH) < EXACT, 0.02, 0.2))
    mean, scale = mean.astype(np.float32), scale.astype(np.float32)
    rng = np.random.default_rng(7)
    init = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
    model = Model(mean, scale, {"W": init(WIDTH, HIDDEN), "b": np.zeros(HIDDEN, np.float32), "V": init(HIDDEN, GATE), "U": init(HIDDEN, GATE),
                                "w": init(GATE), "c": init(HIDDEN), "d": np.zeros(1, np.float32)})
    first = {k: np.zeros_like(v) for k, v in model.p.items()}
    second = {k: np.zeros_like(v) for k, v in model.p.items()}
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(bags))
        for i in range(0, len(order), batch):
            some = order[i:i + batch]
            grads = model.gradients(*bags.some(some), labels[some].astype(np.float32), decay)
            step += 1
            for k, g in grads.items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                model.p[k] = model.p[k] - rate * (1 - epoch / epochs) * (first[k] / (1 - 0.9 ** step)) / (np.sqrt(second[k] / (1 - 0.999 ** step)) + 1e-8)
    return Model(mean.astype(np.float64), scale.astype(np.float64), {k: v.astype(np.float64) for k, v in model.p.items()})


def held_out(doc_id) -> Column:
    """Rows that are never learned from: crc32 of the id as text leaves 1 when divided by 3."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def _sample_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, nbytes=1 << 19):
        x, count = features(batch.column("body").to_pylist())
        ends = np.cumsum(count)
        bags = [Bags.packed(x[end - n:end]) for n, end in zip(count.tolist(), ends.tolist())]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality"), *[pa.array([b[k] for b in bags], pa.binary()) for k in range(3)]],
                                         ["doc_id", "quality", "each", "places", "numbers"])


def train(docs: DataFrame, labels: DataFrame, sample: int = 3000) -> Model:
    """Learn from at most ``sample`` labelled rows that are not held out."""
    ship(docs.sparkSession)
    known = (labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out(F.col("doc_id")))
                   .groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.min("quality").cast("int").alias("quality")))
    body = F.coalesce(docs["text"].cast("string"), F.lit("")).cast("binary")
    ids = docs.select(docs["doc_id"].cast("long").alias("_id"))
    chosen = (known.join(ids, "_id", "left_semi").orderBy(F.xxhash64("_id"), "_id").limit(sample))
    # at most ``sample`` ids: a bounded side
    rows = (docs.select(docs["doc_id"].cast("long").alias("doc_id"), body.alias("body"))
                .join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).select("doc_id", "quality", "body"))
    found = rows.mapInArrow(_sample_features, "doc_id long, quality int, each binary, places binary, numbers binary").collect()
    # of several texts under one id, the least row
    least = {}
    for r in found:
        least[r["doc_id"]] = min(least.get(r["doc_id"], tuple(r)), tuple(r))
    chosen_rows = [least[k] for k in sorted(least)]
    return fit(Bags([r[2:] for r in chosen_rows]), np.array([min(1, max(0, r[1])) for r in chosen_rows], np.int64))


def score_texts(model: Model, bodies: list[bytes]) -> np.ndarray:
    return model.score(*features(bodies)) if bodies else np.zeros(0)


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score`` of every row."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, nbytes=1 << 19):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score_texts(model, batch.column("body").to_pylist()), pa.float64())],
                                             ["doc_id", "score"])
    body = F.coalesce(docs["text"].cast("string"), F.lit("")).cast("binary")
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), body.alias("body")).mapInArrow(run, "doc_id long, score double")


def keep_good(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score ``least`` or more, in one narrow pass."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 19):
            bodies = [b or b"" for b in batch.column("text").cast(pa.binary()).to_pylist()]
            yield batch.filter(pa.array(score_texts(model, bodies) >= least))
    return docs.mapInArrow(run, docs.schema)
