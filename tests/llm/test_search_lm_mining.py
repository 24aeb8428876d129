"""Ranked search, language-model scores and hard negatives against plain Python."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import brute
from ordersight.llm import hard_negatives, lm, queries, ranked_search
from ordersight.llm.common import Scratch, read_table

SF = "/root/testdata/sf0.001"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
NULLS_LAST = lambda x: (x is None, x or 0)


def frame(spark, rows, schema, clash=()):
    df = spark.createDataFrame(rows, schema)
    for c in clash:
        df = df.withColumn(c, F.lit("x"))
    return df


def sentences(rng, n, of=60):
    return " ".join(rng.choice(["", "é", "X"]) + f"w{min(rng.randrange(of), rng.randrange(of))}" + rng.choice(["", ".", ","]) for _ in range(n))


# ---------------------------------------------------------------- ranked search
def best_documents(docs, items, k=50):
    found = [(d, Counter(TERM.findall((t or "").translate(brute.LOW)))) for d, t in docs]
    found = [(d, c, c.total()) for d, c in found if c]
    n, length = len(found), sum(x for *_, x in found)
    df = Counter(t for _, c, _ in found for t in c)
    out = []
    for item, text in items:
        weights = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) for t in set(TERM.findall((text or "").translate(brute.LOW))) if t in df}
        scored = []
        for d, c, size in found:
            m = 100 - 50 + (50 * size * n) // length
            s = sum(w * ((1000000000 * c[t]) // (1000 * c[t] + 20 * m)) for t, w in weights.items() if t in c)
            if s > 0:
                scored.append((-s, NULLS_LAST(d), d))
        out += [(item, r, d, -s) for r, (s, _, d) in enumerate(sorted(scored)[:k], 1)]
    return out


def searched(spark, docs, items, **how):
    got = ranked_search.ranked(frame(spark, docs, "doc_id long, text string", ("body", "hash", "terms", "score", "query", "key", "rank")),
                               frame(spark, items, "item_id long, text string", ("body", "key", "score", "rank")), Scratch(spark, "test"), **how).collect()
    return sorted(map(tuple, got), key=lambda r: (NULLS_LAST(r[0]), r[1], NULLS_LAST(r[2])))


def wanted(rows):
    return sorted(rows, key=lambda r: (NULLS_LAST(r[0]), r[1], NULLS_LAST(r[2])))


ODD_DOCS = [(1, None), (2, ""), (3, " ,;\t\n"), (4, "one W1 two"), (None, "w1 w2 w3"), (None, "w1 w2 w3"), (5, "w1 w2 w3"), (5, "w1 w2 w3"), (6, "w1 w2 w3"),
            (7, "z" * 50_000), (8, "w7 " * 9000), (9, "\x00W1\x7fw2\x01é w3"), (10, "日本語 w1"), (-3, "w1 w2 w3")]
ODD_ITEMS = [(1, "w1 W1 w2"), (1, "w1 W1 w2"), (2, "w1 W1 w2"), (None, "w3"), (3, None), (4, ""), (5, "no such term"), (6, "é w3 日本語"), (7, "w7 " * 500)]


@pytest.mark.parametrize("k,block_bytes", [(3, 2 << 20), (50, 100)])
def test_search_odd_rows(spark, k, block_bytes):
    rng = random.Random(1)
    docs = ODD_DOCS + [(100 + i, sentences(rng, rng.randrange(1, 40))) for i in range(300)]
    assert searched(spark, docs, ODD_ITEMS, k=k, block_bytes=block_bytes) == wanted(best_documents(docs, ODD_ITEMS, k))
    assert searched(spark, [], ODD_ITEMS, k=k) == [] == searched(spark, docs, [], k=k) == searched(spark, ODD_DOCS[:3], ODD_ITEMS, k=k)


def test_search_whole_table(spark):
    docs = [tuple(r) for r in read_table(spark, SF, "documents").select("doc_id", "text").collect()]
    items = [tuple(r) for r in read_table(spark, SF, "benchmark").select("item_id", "text").collect()]
    got = sorted((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in queries.op11_ranked_search(spark, SF).collect())
    assert got == sorted(best_documents(docs, items))


def test_whole_batches_are_pruned(spark):
    """Documents that can't reach the k-th score are dropped by their node's bound."""
    rng = random.Random(2)
    block = ranked_search.Block([b"a1 a2 a3 a4", b"a2 a3 a5", *[sentences(rng, 9).encode() for _ in range(30)]])
    tree = ranked_search.ItemTree(block.weighted({t: 5 for t in block.terms.values()}, 1000))
    search, seen = ranked_search.Search(tree, np.zeros(len(block.queries), np.int64), 5), []
    search._take = lambda q, scores, ids, nodes, take=search._take: (seen.append(len(nodes)), take(q, scores, ids, nodes))
    import pyarrow as pa
    names = ["doc_id", "hash", "n_terms", "terms", "times"]

    def batch(first, held):
        n = len(held)
        return pa.RecordBatch.from_arrays([pa.array(range(first, first + n), pa.int64()), pa.array(range(n), pa.int64()), pa.array([20] * n, pa.int64()),
                                           pa.array(held, pa.list_(pa.int32())), pa.array([[1] * len(h) for h in held], pa.list_(pa.int32()))], names)
    every = sorted(block.terms.values())
    search.batch(ranked_search.Documents(batch(0, [every] * 8), 1000, 20_000))
    search.batch(ranked_search.Documents(batch(8, [[rng.choice(every)] for _ in range(512)]), 1000, 20_000))
    assert sum(seen[len(block.queries):]) < 512 * len(block.queries) / 4
    assert all(d < 8 for best in search.found.values() for _, _, d in best)


# ---------------------------------------------------------------- language model
def model_scores(rows, n=3, rounds=12, least_gain=1e-4):
    """(held_out, n_tokens, n_known, train_tokens, base_score, score) of each row."""
    docs = []
    for d, t in rows:
        r = brute.crc("" if d is None else str(d)) % 10
        docs.append((r, brute.WORD.findall((t or "").translate(brute.LOW)) + [None]))

    def counts(some):
        c = [Counter() for _ in range(n + 1)]
        for words in some:
            seq = ["^"] * (n - 1) + words
            c[0][()] += len(words)
            for i in range(n - 1, len(seq)):
                for j in range(1, n + 1):
                    c[j][tuple(seq[i - j + 1:i + 1])] += 1
            for j in range(1, n):
                c[j][("^",) * j] += 1
        return c
    full, kept = counts(w for r, w in docs if r), counts(w for r, w in docs if r > 1)
    tokens = full[0][()]
    types = len([g for g in full[1] if g != ("^",)])

    def parts(c, words):
        seq = ["^"] * (n - 1) + words
        for i in range(n - 1, len(seq)):
            p, bucket = [1 / (types + 1)] + [0.0] * n, (0, 0)
            for j in range(1, n + 1):
                if before := c[j - 1][tuple(seq[i - j + 1:i])]:
                    p[j], bucket = c[j][tuple(seq[i - j + 1:i + 1])] / before, (j, before.bit_length() - 1)
            yield p, bucket
    weights = defaultdict(lambda: None)
    even = lambda b: [1 / (b[0] + 1)] * (b[0] + 1) + [0.0] * (n - b[0])
    sample, before = [x for r, w in docs if r == 1 for x in parts(kept, w)], -math.inf
    for _ in range(rounds):
        sums, total = defaultdict(lambda: [0.0] * (n + 1)), 0.0
        for p, b in sample:
            mix = [x * y for x, y in zip(p, weights[b] or even(b))]
            total += math.log(sum(mix))
            sums[b] = [x + y / sum(mix) for x, y in zip(sums[b], mix)]
        for b, s in sums.items():
            s = [x + y for x, y in zip(s, even(b))]
            weights[b] = [x / sum(s) for x in s]
        if total / max(1, len(sample)) - before < least_gain:
            break
        before = total / max(1, len(sample))
    out = []
    for r, words in docs:
        c = [full[1][(w,)] for w in words]
        base = sum(math.log10((x + 0.1) / (tokens + 0.1 * (types + 1))) for x in c)
        score = sum(math.log10(sum(x * y for x, y in zip(p, weights[b] or even(b)))) for p, b in parts(full, words))
        out.append((r == 0, len(words), sum(x > 0 for x in c), tokens, base, score))
    return out


def same_scores(spark, rows, n):
    got = lm.scores(frame(spark, rows, "doc_id long, text string", ("body", "role", "block", "part", "tokens")), Scratch(spark, "test"), n).collect()
    got = sorted(map(tuple, got), key=lambda r: (NULLS_LAST(r[0]), r[2:]))
    want = sorted(((d, *x) for (d, _), x in zip(rows, model_scores(rows, n))), key=lambda r: (NULLS_LAST(r[0]), r[2:]))
    assert [r[:5] for r in got] == [r[:5] for r in want]
    np.testing.assert_allclose([r[5:] for r in got], [r[5:] for r in want], rtol=1e-5, atol=1e-9)


@pytest.mark.parametrize("n", [1, 2, 3])
def test_lm_odd_rows(spark, n):
    rng = random.Random(3)
    odd = [(0, None), (1, ""), (2, " \n "), (None, "w1 w2"), (None, None), (3, "w1 w2 w3"), (3, "w1 w2 w3"), (4, "W1 w2 w3"), (5, "x" * 70_000), (6, "w1 " * 6000)]
    same_scores(spark, odd + [(10 + i, sentences(rng, rng.randrange(1, 60))) for i in range(200)], n)
    if n == 2:
        same_scores(spark, odd[:5], n)
        assert lm.scores(frame(spark, [], "doc_id long, text string"), Scratch(spark, "test"), n).collect() == []


def test_lm_counts_over_many_blocks(spark):
    """Rows dealt to many tasks make many blocks; the scores don't depend on it."""
    rng = random.Random(4)
    rows = [(i, sentences(rng, 30)) for i in range(150)]
    df = frame(spark, rows, "doc_id long, text string")
    one, many = (sorted(map(tuple, lm.scores(df.repartition(k), Scratch(spark, "test")).collect())) for k in (1, 24))
    assert [r[:5] for r in one] == [r[:5] for r in many]
    np.testing.assert_allclose([r[5:] for r in one], [r[5:] for r in many], rtol=1e-6)


def test_lm_is_a_probability_and_beats_the_base(spark):
    docs = read_table(spark, "/root/testdata/sf0.01", "documents")
    held = [r for r in queries.op12_lm_scores(spark, "/root/testdata/sf0.01").collect() if r["held_out"]]
    assert len(held) > 50 and sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    blocks, samples, totals = lm.counted(docs, Scratch(spark, "test"), 3)
    weights = lm.learned(samples, totals, 3)
    assert np.allclose(weights.of.sum(axis=1), 1) and (weights.of[:, 0] > 0).all()
    # after one context, the known words' estimates of each order sum to 1 at most
    block = lm.unpack(blocks.first()["body"])
    counts = [lm.unplaned(c) - 1 for c in block["counts"]]
    p, bucket = lm.estimates(counts, totals, False)
    real = counts[0] >= 0
    assert (weights.mixed(p[real], bucket[real]) <= 1 + 1e-9).all() and (p[real, 1:] <= 1 + 1e-9).all()


# ---------------------------------------------------------------- hard negatives
def mined(rows):
    took = []
    for i, v, label in rows:
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        took.append((i, (label + 1) % 10 if i is not None and i % 7 == 0 else label, [math.floor(256 * x) for x in v]))
    out = []
    for i, label, q in took:
        if i is None or i % 100:
            continue
        scored = sorted({(-sum(a * b for a, b in zip(q, w)), j is None, j or 0, other == label) for j, other, w in took if j != i})
        named = lambda none, j: None if none else j
        for s, none, j, _ in [x for x in scored if x[3]][:5]:
            fit = [x for x in scored if not x[3] and 80 * -s <= 100 * -x[0] <= 100 * -s][:5]
            out += [(i, named(none, j), r, named(n2, k), -s, -x) for r, (x, n2, k, _) in enumerate(fit, 1)]
    return sorted(out, key=lambda r: [NULLS_LAST(x) for x in r])


def vectors(spark, tmp_path, rows):
    frame(spark, rows, "vec_id long, embedding array<float>, label int", ("id", "q", "slot", "score", "row_id", "rank")).write.parquet(str(tmp_path / "embeddings.parquet"))
    return str(tmp_path)


def rounded(x):
    return float(np.float32(x))


def odd_vectors(n=400, seed=5):
    rng = random.Random(seed)
    rows = [(i, [rounded(rng.gauss(0.3, 0.4)) for _ in range(6)], rng.randrange(3)) for i in range(n)]
    same = [rounded(x) for x in (0.5, 0.25, -0.5, 0.75, 0.1, 0.0)]
    rows += [(1000 + i, same, i % 2) for i in range(150)]  # ties, one at an anchor
    rows += [(2000, None, 1), (2100, [0.5, None, 0.5], 1), (2200, [0.5, float("nan")], 1), (2300, [float("inf")], 1), (2400, same, None), (2500, [], 1),
             (2600, same[:2], 1), (None, same, 0), (None, same, 1), (2700, [0.0] * 6, 0), (1001, same, 1), (1001, same, 1), (-100, [-x for x in same], 1),
             (2800, [1e30] * 6, 1)]
    rng.shuffle(rows)
    return rows


def test_mining_odd_rows(spark, tmp_path):
    rows = odd_vectors()
    rows = [r for r in rows if r[0] != 2800]
    got = queries.op13_hard_negatives(spark, vectors(spark, tmp_path, rows)).collect()
    assert sorted((tuple(r) for r in got), key=lambda r: [NULLS_LAST(x) for x in r]) == mined(rows) != []


def test_mining_empty_and_huge(spark, tmp_path):
    assert queries.op13_hard_negatives(spark, vectors(spark, tmp_path / "a", [])).collect() == []
    rows = odd_vectors(60)
    assert queries.op13_hard_negatives(spark, vectors(spark, tmp_path / "b", rows)).count() > 0


def test_mining_by_blocks_of_anchors(spark):
    rows = odd_vectors(300, 6)
    df = hard_negatives.quantised(frame(spark, rows, "vec_id long, embedding array<float>, label int"))
    few, many = (sorted(map(str, hard_negatives.hard_negatives(df, F.col("id") % 10 == 0, Scratch(spark, "test"), block=b).collect())) for b in (7, 2048))
    assert few == many != []


def test_products_are_exact():
    rng = np.random.default_rng(1)
    a, b = rng.integers(-hard_negatives.LIMIT, hard_negatives.LIMIT, (2, 40, 64))
    assert (hard_negatives.products(a, b) == [[sum(int(x) * int(y) for x, y in zip(u, v)) for v in b] for u in a]).all()
