"""Line dedup, substring dedup, SimHash, decontamination, BPE, classifier and pipeline against plain Python."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import brute
import corpus_pipeline
from ordersight.llm import bpe, decontaminate, line_dedup, quality, queries, simhash, substring_dedup
from ordersight.llm.common import Scratch, read_table
from ordersight.llm.components import components

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
KEY = lambda x: (x[0] is None, x[0] or 0, *x[1:])


def frame(spark, rows, extra=False):
    df = spark.createDataFrame([(d, t, "en", "s", None if t is None else len(t)) for d, t in rows], SCHEMA)
    if extra:
        for c in ("body", "text_key", "keep", "n_dropped", "h1", "at", "starts", "late", "print", "part", "root", "_id", "_key", "ids", "quality", "k1"):
            df = df.withColumn(c, F.lit("x"))
    return df


def folder(spark, tmp_path, rows, items=(), labels=(), extra=False):
    frame(spark, rows, extra).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(list(items), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    return str(tmp_path)


def words(rng, n, of=400):
    return " ".join(f"w{rng.randrange(of)}" for _ in range(n))


def odd(seed=5):
    rng = random.Random(seed)
    shared, line = words(rng, 60), "  A License line, all of it "
    base = words(rng, 120)
    rows = [(1, None), (2, ""), (3, " \n\t\x0b "), (4, shared), (5, base + " " + shared), (6, shared + " " + base), (7, shared), (7, shared), (None, shared),
            (None, line + "\nother words"), (8, line + "\n" + line + "\nshort\nshort"), (9, line.upper() + "\n\n\n" + words(rng, 5)),
            (10, "x" * 40_000), (11, words(rng, 9_000, 10_000)), (12, "é" * 9 + "\n" + "é" * 10), (13, "é" * 9 + "\n" + "é" * 10),
            (14, "same words here"), (15, "same words here"), (16, "SAME words HERE"), (17, "<|endoftext|> don't \U0001F600  \n\n x"), (-5, shared)]
    rows += [(100 + i, line + "\n" + shared + f" w{i}") for i in range(30)]
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return [(r["doc_id"], r["text"]) for r in read_table(spark, SF, "documents").collect()]


@pytest.mark.parametrize("rows", [odd(), []])
def test_odd_rows(spark, tmp_path, rows):
    rng = random.Random(1)
    items = [(1, words(rng, 60)), (2, None), (3, ""), (4, "same words here"), (5, odd()[0][1])] if rows else []
    labels = [(d, d % 2, 0) for d, _ in rows if d] + [(None, 1, 0), (4, None, 0)] if rows else []
    sf = folder(spark, tmp_path, rows, items, labels, extra=True)
    got = queries.op9_line_dedup(spark, sf).collect()
    assert sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in got), key=KEY) == sorted(brute.lines(rows), key=KEY)
    got = queries.op4_substring_dedup(spark, sf).collect()
    assert sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got), key=KEY) == sorted(brute.substring(rows), key=KEY)
    got = queries.op2_simhash(spark, sf).collect()
    prints = [(d, brute.fingerprint(t)) for d, t in rows]
    want = [(d, f"{p:016x}", c) for (d, p), c in zip(prints, brute.components(prints))]
    assert sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got), key=KEY) == sorted(want, key=KEY)
    got = queries.op7_decontaminate(spark, sf).collect()
    assert sorted(((r["doc_id"], r["item_id"], r["item_shingles"], r["shared_shingles"]) for r in got), key=KEY) == sorted(brute.contained(rows, items), key=KEY)
    got = queries.op10_bpe(spark, sf).collect()
    t = Tokenizer.from_file(queries.VOCABULARY)
    want = []
    for d, text in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids
        want.append((d, len(ids), brute.sha(",".join(map(str, ids))), brute.sha(t.decode(ids, skip_special_tokens=False))))
    assert sorted(((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got), key=KEY) == sorted(want, key=KEY)
    got = queries.op3_quality(spark, sf).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got if r["doc_id"] is not None)
    out = corpus_pipeline.run(spark, sf).collect()
    assert len(out) <= len(rows)


def test_whole_table(spark, docs):
    assert sorted((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in queries.op9_line_dedup(spark, SF).collect()) == sorted(brute.lines(docs))
    prints = [(d, brute.fingerprint(t)) for d, t in docs]
    want = {d: (f"{p:016x}", c) for (d, p), c in zip(prints, brute.components(prints))}
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.op2_simhash(spark, SF).collect()} == want
    t = Tokenizer.from_file(queries.VOCABULARY)
    text = dict(docs)
    for r in queries.op10_bpe(spark, SF).collect():
        ids = t.encode(text[r["doc_id"]], add_special_tokens=False).ids
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), brute.sha(",".join(map(str, ids))))
        assert r["decoded_sha256"] == brute.sha(t.decode(ids, skip_special_tokens=False))


@pytest.mark.parametrize("key", sorted(queries.ORACLES))
def test_oracle(spark, key):
    import duckdb
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    rel = con.sql(queries.ORACLES[key])
    want = sorted(rel.fetchall())
    assert sorted(tuple(r[c] for c in rel.columns) for r in queries.QUERIES[key](spark, SF).collect()) == want


def test_line_bitmaps_over_many_small_partitions(spark):
    """A line in every document spans many range partitions; only its first document keeps it."""
    rows = [(i, "the one common line\n" + (f"line number {i % 50} of some" if i % 3 else "")) for i in range(400)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        out = line_dedup.dedup_lines(frame(spark, rows), Scratch(spark, "t")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    want = {d: (n - m, s) for d, n, m, s in brute.lines(rows)}
    assert all(brute.sha(r["text"]) == want[r["doc_id"]][1] and r["n_chars"] == len(r["text"]) for r in out) and len(out) == 400


def test_substring_levels_double_until_none_survives(spark):
    rng = random.Random(2)
    long_ = words(rng, 120, 5000)
    rows = [(1, long_), (2, words(rng, 40, 5000) + " " + long_[:400]), (3, words(rng, 50, 5000))]
    levels = substring_dedup.repeated_windows(frame(spark, rows), Scratch(spark, "t"), window=13)
    length = {n: {r["doc_id"]: len(r["starts"]) // 4 for r in df.collect()} for n, df in levels.items()}
    shared = len(long_[:400].split()) - 1
    assert set(length[13]) == {1, 2} and length[26][1] == shared - 25 or length[26][1] == shared - 24
    assert list(length)[-1] > shared and not length[list(length)[-1]]


@pytest.mark.parametrize("bits,most", [(8, 400_000), (2, 40), (3, 5)])
def test_near_links_with_sent_on_parts(spark, bits, most):
    """A tight group larger than a part may be, chains, and lone fingerprints: the links join what brute force joins."""
    rng = np.random.default_rng(4)
    centre = int(rng.integers(0, 2**63))
    prints = {centre} | {centre ^ (1 << a) ^ (1 << b) for a in range(20) for b in range(a, 20)}
    chain = int(rng.integers(0, 2**63))
    for i in range(0, 60, 4):
        chain ^= 0b1111 << i
        prints.add(chain)
    prints |= {int(x) for x in rng.integers(0, 2**63, 100)} | {0, 2**64 - 1, 2**64 - 16}
    prints = sorted(prints)
    df = spark.createDataFrame([(p - 2**64 if p >= 2**63 else p,) for p in prints], "print long")
    scratch = Scratch(spark, "t")
    links = scratch.table(simhash.near_links(df, scratch, 4, bits, most), "l")
    root = {r["node"]: r["root"] for r in components(links, scratch).collect()}
    signed = [p - 2**64 if p >= 2**63 else p for p in prints]
    want = brute.components(list(zip(signed, prints)))
    assert [root.get(s, s) for s in signed] == want


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100)] + [(500, 500 + i) for i in range(1, 200)] + [(9000, 9001), (9000, 9000)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t")).collect()}
    assert got == {i: 0 for i in range(1, 101)} | {500 + i: 500 for i in range(1, 200)} | {9001: 9000}


def test_any_bit_map_gives_the_same_pairs(spark, docs):
    d = frame(spark, docs)
    items = read_table(spark, SF, "benchmark")
    one = decontaminate.contaminated_pairs(d, items).collect()
    full = decontaminate.contaminated_pairs(d, items, filter_bits=7).collect()  # 128 bits: lets nearly all shingles through
    assert one and sorted(map(tuple, one)) == sorted(map(tuple, full))
    hit = {r["doc_id"] for r in one}
    left = {r["doc_id"] for r in decontaminate.decontaminate(d, items, filter_bits=7).collect()}
    assert left == {x for x, _ in docs} - hit


def test_a_benchmark_repeated_gives_each_row_its_pairs(spark, docs):
    d = frame(spark, docs)
    items = [(r["item_id"], r["text"]) for r in read_table(spark, SF, "benchmark").collect()]
    one = sorted((r["doc_id"], r["item_id"]) for r in decontaminate.contaminated_pairs(d, spark.createDataFrame(items, "item_id long, text string")).collect())
    many = spark.createDataFrame([(i + 1000 * k, t) for i, t in items for k in range(1000)], "item_id long, text string")
    got = decontaminate.contaminated_pairs(d, many).select("doc_id", (F.col("item_id") % 1000).alias("item_id")).groupBy("doc_id", "item_id").count().collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in got) == one and {r["count"] for r in got} == {1000}


def test_containment_threshold_is_exact(spark):
    rng = random.Random(9)
    item = words(rng, 24, 10**6).split()  # 20 shingles
    rows = [(k, " ".join(words(rng, 300, 10**6).split() + item[:k + 4] + words(rng, 300, 10**6).split())) for k in range(14, 21)]
    got = decontaminate.contaminated_pairs(frame(spark, rows), spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")).collect()
    assert {(r["doc_id"], r["shared_shingles"]) for r in got} == {(k, k) for k in range(16, 21)}


def test_bpe_cuts_small_blocks():
    batch = pa.RecordBatch.from_pydict({"text": [None, "", *["word " * 20_000] * 60]})
    blocks = list(bpe._texts(iter([batch])))
    assert [t for _, texts in blocks for t in texts] == ["", "", *["word " * 20_000] * 60]
    assert max(sum(map(len, texts)) for _, texts in blocks) <= 2 << 20  # a block of 8 MB made a worker hold some 100 MB of words


def test_bpe_round_trip_and_small_store(spark, docs):
    d = frame(spark, docs[:40] + [(9999, None), (9998, "")])
    coded = bpe.encode(d, queries.VOCABULARY)
    back = {r["doc_id"]: r["text"] for r in bpe.decode(coded, queries.VOCABULARY).collect()}
    assert back == {k: t or "" for k, t in docs[:40] + [(9999, None), (9998, "")]}
    import json
    v = bpe.Vocabulary(json.loads(bpe.vocabulary_text(queries.VOCABULARY)))
    small, large = bpe.Codec(v, 1000), bpe.Codec(v)
    texts = [t for _, t in docs[:60]]
    assert [small.encode_block([t])[0] for t in texts] == large.encode_block(texts)


def test_quality_on_held_out_rows(spark, tmp_path):
    sf = "/root/testdata/sf0.01"
    docs, labels = read_table(spark, sf, "documents"), read_table(spark, sf, "labels")
    rows = queries.op3_quality(spark, sf).join(labels, "doc_id").where("held_out").collect()
    assert sum(r["predicted"] == r["quality"] for r in rows) / len(rows) > 0.95
    # labels of held-out rows, ids, languages and sources change nothing
    model = quality.train(docs, labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality"))))
    again = {r["doc_id"]: r["score"] for r in quality.scores(docs.withColumn("lang", F.lit("zz")).withColumn("source", F.lit(None)), model).collect()}
    assert all(abs(again[r["doc_id"]] - r["score"]) < 1e-6 for r in rows)


def passage_features(passage):
    """Features of one passage of bytes, by dictionaries and loops."""
    blank, bit = b" \t\n\r\x0b\x0c", 2**64
    low = passage.lower()

    def mixed(x):
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 % bit
        x = (x ^ x >> 27) * 0x94D049BB133111EB % bit
        return x ^ x >> 31
    classes = [int(quality.CLASS_OF[b]) for b in passage]
    n = max(1, len(passage))
    out = [0.0] * quality.WIDTH
    for c in set(classes):
        out[c] = (classes.count(c) / n) ** 0.5
    for a, b in set(zip(classes, classes[1:])):
        out[14 + 14 * a + b] = (sum(x == (a, b) for x in zip(classes, classes[1:])) / n) ** 0.5
    words = []
    for i, b in enumerate(low):
        if b not in blank:
            words = words + [[b]] if i == 0 or low[i - 1] in blank else [*words[:-1], [*words[-1], b]]
    hashes = [mixed((sum((b + 1) * pow(quality.PRIME, j, bit) for j, b in enumerate(w)) + len(w) - 1) % bit) for w in words]
    some = max(1, len(words))
    out[210:214] = [len(words) / n * 4, sum(a == b for a, b in zip(hashes, hashes[1:])) / some, len(set(hashes)) / some, len(passage) / quality.PASSAGE]
    runs = [mixed((low[i] << 16) + (low[i + 1] << 8) + low[i + 2]) for i in range(len(low) - 2)]
    for start, found, buckets in ((214, hashes, quality.WORDS), (214 + quality.WORDS, runs, quality.RUNS)):
        for h in found:
            out[start + h % buckets] += 1 / len(found)
    return out[:214] + [x ** 0.5 for x in out[214:]]


def brute_score(model, body):
    """The forward pass for one text: encoder, gated attention over its passages, logistic output."""
    p = model.p
    h, e = [], []
    for i in range(0, max(1, len(body)), quality.PASSAGE):
        x = (np.array(passage_features(body[i:i + quality.PASSAGE])) - model.mean) * model.scale
        h.append(np.tanh(x @ p["W"] + p["b"]))
        e.append(sum(p["w"][k] * np.tanh(h[-1] @ p["V"][:, k]) / (1 + np.exp(-h[-1] @ p["U"][:, k])) for k in range(len(p["w"]))))
    weights = np.exp(np.array(e) - max(e)) / np.exp(np.array(e) - max(e)).sum()
    return 1 / (1 + np.exp(-(sum(w * x for w, x in zip(weights, h)) @ p["c"] + p["d"][0])))


BODIES = [b"", b" ", b"word word word word", b"zebra", b" zebra", b"internationalisation internationally internationals", b"a", b"ab", b"abc", b"x" * 511, b"x" * 512, b"y " * 700,
          "\u00e9t\u00e9 \u4e2d\u6587 end".encode(), b"Word\nWORD\tword.", b"#$% | 123"]


def test_quality_scores_alone_and_in_any_batch(spark):
    docs, labels = read_table(spark, SF, "documents"), read_table(spark, SF, "labels")
    model = quality.train(docs, labels)
    texts = BODIES + [(r["text"] or "").encode() for r in docs.orderBy("doc_id").limit(30).collect()]
    alone = [quality.score_texts(model, [b])[0] for b in texts]
    for order in (list(range(len(texts))), list(reversed(range(len(texts)))), random.Random(2).sample(range(len(texts)), len(texts))):
        np.testing.assert_allclose(quality.score_texts(model, [texts[k] for k in order]), [alone[k] for k in order], atol=1e-9)
    np.testing.assert_allclose(alone, [brute_score(model, b) for b in texts], atol=1e-5)
    df = spark.createDataFrame([(i, b.decode()) for i, b in enumerate(texts)], "doc_id long, text string")
    for parts in (1, 7):
        got = {r["doc_id"]: r["score"] for r in quality.scores(df.repartition(parts), model).collect()}
        np.testing.assert_allclose([got[i] for i in range(len(texts))], alone, atol=1e-9)


def test_quality_learns_from_every_passage():
    """A text longer than any former bound: its last passage alone tells the classes apart."""
    rng = random.Random(9)
    long_text = lambda end: (" ".join(rng.choice(["alpha", "beta", "gamma"]) for _ in range(9000)) + f" {end} " * 40).encode()
    texts, y = [long_text(e) for e in ("zulu", "kilo") * 12], np.array([0, 1] * 12)
    assert len(quality.features(texts[:1])[0]) > 64
    packed = [quality.Bags.packed(quality.features([t])[0]) for t in texts]
    model = quality.fit(quality.Bags(packed), y, epochs=60, batch=8)
    assert ((quality.score_texts(model, texts) >= 0.5) == y).mean() > 0.9


def test_quality_gradients_and_attention():
    rng = np.random.default_rng(0)
    bags = [rng.standard_normal((n, quality.WIDTH)).astype(np.float32) for n in (1, 3, 5, 2)]
    y = np.array([0, 1, 1, 0])
    m = quality.fit(quality.Bags([quality.Bags.packed(b) for b in bags]), y, epochs=1)
    m.p = {k: v.astype(np.float64) for k, v in m.p.items()}
    x, count = np.concatenate(bags).astype(np.float64), np.array([1, 3, 5, 2])
    loss = lambda: -np.mean(np.where(y == 1, np.log(m.forward(x, count)["y"]), np.log(1 - m.forward(x, count)["y"])))
    g = m.gradients(x, count, y, 0.0)
    for k in m.p:
        at = tuple(0 for _ in m.p[k].shape)
        old, eps = m.p[k][at], 1e-6
        m.p[k][at] = old + eps
        up = loss()
        m.p[k][at] = old - eps
        down = loss()
        m.p[k][at] = old
        assert abs((up - down) / (2 * eps) - g[k][at]) < 1e-5
    assert np.allclose(np.add.reduceat(m.forward(x, count)["a"], [0, 1, 4, 9]), 1)


def test_pipeline_stages(spark, docs):
    sf = "/root/testdata/sf0.01"
    d = read_table(spark, sf, "documents")
    names, text = d.columns, {r["doc_id"]: r["text"] for r in d.collect()}
    scratch = Scratch(spark, "t")
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r["text"] for r in d.collect()}
        d = scratch.table(stage(spark, d, sf), name)
        if name == "bpe":
            break
        assert d.columns == names
        after = {r["doc_id"]: r["text"] for r in d.collect()}
        if name == "quality":
            labels = {r["doc_id"]: r["quality"] for r in read_table(spark, sf, "labels").collect()}
            known = [k for k in before if k in labels]
            assert sum((k in after) == bool(labels[k]) for k in known) / len(known) > 0.95
        elif name == "line_dedup":
            assert {k: brute.sha(t) for k, t in after.items()} == {k: s for k, _, _, s in brute.lines(list(before.items()))}
        elif name == "near_duplicates":
            prints = [(k, brute.fingerprint(t)) for k, t in before.items()]
            assert set(after) == set(brute.components(prints))
        elif name == "decontamination":
            items = [(r["item_id"], r["text"]) for r in read_table(spark, sf, "benchmark").collect()]
            assert set(before) - set(after) == {k for k, *_ in brute.contained(list(before.items()), items)}
    t = Tokenizer.from_file(queries.VOCABULARY)
    rows = d.collect()
    assert {r["doc_id"] for r in rows} == set(before)
    for r in rows:
        assert r["ids"] == t.encode(before[r["doc_id"]], add_special_tokens=False).ids
    assert len(text) > len(rows) > 0


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_repeated_rows_over_partition_edges(spark, parts):
    from ordersight.llm.occurrences import ROWS, repeated_rows
    rng = random.Random(parts)
    rows = [(rng.randrange(6), rng.randrange(2), rng.choice([None, *range(1, 40)]), 0, i) for i in range(500)]
    rows += [(100, 0, d, 0, 1000 + d) for d in range(300)] + [(101, 0, 7, 0, 2000 + i) for i in range(200)] + [(102, 0, 7, 0, 9000), (103, 0, None, 0, 9001)]
    key = lambda d: float("inf") if d is None else d
    docs = {}
    for h1, h2, d, _, _ in rows:
        docs.setdefault((h1, h2), set()).add(key(d))
    want = sorted((at, key(d) > min(docs[h1, h2])) for h1, h2, d, _, at in rows if len(docs[h1, h2]) > 1)
    scratch = Scratch(spark, "t")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
    try:
        got = repeated_rows(scratch.table(spark.createDataFrame(rows, ROWS), "r"), scratch, "f").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted((r["at"], r["late"]) for r in got) == want
