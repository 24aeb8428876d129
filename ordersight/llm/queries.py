"""Registered queries: each applies one operator with production parameters to its whole table.

``QUERIES`` maps names to ``(spark, sf_dir) -> DataFrame``, ``ORACLES`` the names
that SQL can express to DuckDB SQL.
"""

from __future__ import annotations

from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ordersight.llm import bpe, decontaminate, hard_negatives, line_dedup, lm, pii, quality, ranked_search, secret_scan, sharding, simhash, substring_dedup, winnowing
from ordersight.llm.columns import listed
from ordersight.llm.common import Scratch, read_table, slices

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def op1_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """40 shards along a Hilbert curve over lang, source, n_chars and doc_id; law: row counts at most one apart."""
    put = sharding.shards(read_table(spark, sf_dir, "documents"), count=40)
    return put.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"), "curve")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash near-duplicates: 4-word shingles, 4 bits; component by smallest reachable doc_id."""
    found = simhash.near_duplicates(read_table(spark, sf_dir, "documents"), Scratch(spark, "op2"), n=4, seed=42, distance=4)
    return found.select("doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every whole text by gated attention over its passages; learned from at most 3,000 labelled rows."""
    docs = read_table(spark, sf_dir, "documents")
    model = quality.train(docs, read_table(spark, sf_dir, "labels"), sample=3000)
    return quality.scores(docs, model).select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score",
                                              (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words covered by 13-word windows that a smaller doc_id also holds are removed."""
    cut = substring_dedup.removal(read_table(spark, sf_dir, "documents"), Scratch(spark, "op4"), window=13)
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every whole text: base kinds exactly, further kinds by checksum and context score."""
    found = pii.find(read_table(spark, sf_dir, "documents"))
    base, more = [k.name for k in pii.KINDS if k.base], [k.name for k in pii.KINDS if not k.base]
    own = F.concat(*[listed(k, F.col(k)) for k in base])
    rest = F.concat(*[listed(k, F.col(k)) for k in more])
    return found.select("doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in base],
                        F.sha2(F.array_join(own, ","), 256).alias("base_sha256"), F.array_join(F.concat(own, rest), ",").alias("spans"),
                        F.array_join(F.transform(F.concat(*[F.col(f"{k}.score") for k in base + more]), lambda x: F.format_number(x, 2)), ",").alias("scores"))


def op6_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Winnowing fingerprints (hashes of 8 code points, windows of 8) of every whole text and of its edited text, with likenesses."""
    both = winnowing.edited_fingerprints(read_table(spark, sf_dir, "documents"), k=8, w=8)
    sets = both.select("doc_id", F.length("body").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
                       "selected", "edited_selected", winnowing.hashes(F.col("selected")).alias("own"),
                       winnowing.hashes(F.col("edited_selected")).alias("after"), winnowing.hashes(F.col("next_selected")).alias("following"))
    return sets.select("doc_id", "n_chars", "edited_sha256", winnowing.shown(F.col("selected")).alias("fingerprint"),
                       winnowing.shown(F.col("edited_selected")).alias("edited_fingerprint"),
                       winnowing.likeness(F.col("own"), F.col("after")).alias("near_edited"),
                       winnowing.likeness(F.col("own"), F.col("following")).alias("near_next"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold 0.8 or more of a benchmark item's five-word shingles."""
    return decontaminate.contaminated_pairs(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), Scratch(spark, "op7"), n=5, least=0.8)


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every whole text by trigram index and verification; base kinds and further ones."""
    found = secret_scan.find(read_table(spark, sf_dir, "documents"))
    names = [r.name for r in secret_scan.RULES]

    def in_order(kinds: list[str]) -> Column:
        def ranked(kind: str) -> Column:
            return F.transform(F.col(kind), lambda s: F.struct(s["start"].alias("start"), F.lit(names.index(kind)).alias("rank"), s["end"].alias("end")))
        every = F.concat(*map(ranked, kinds))
        called = F.array(*[F.lit(n) for n in names])
        return F.array_join(F.transform(F.array_sort(every), lambda s: F.concat(
            F.element_at(called, s["rank"] + 1), F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), ",")
    return found.select("doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in secret_scan.BASE],
                        F.sha2(in_order(list(secret_scan.BASE)), 256).alias("base_sha256"), in_order(names).alias("spans"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines whose key a smaller doc_id holds are dropped; digest of what stays, from the keep bitmaps."""
    docs, scratch = read_table(spark, sf_dir, "documents"), Scratch(spark, "op9")
    both = line_dedup.with_bitmaps(docs, scratch.table(line_dedup.keep_bitmaps(docs, scratch, min_chars=10), "bitmaps"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            done = [line_dedup.kept_lines(b, k) for b, k in zip(batch.column("body").to_pylist(), batch.column("keep").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([n for _, n in done], pa.int64()), pa.array([n - len(k) for k, n in done], pa.int64()),
                 pa.array([b"\n".join(k) for k, _ in done], pa.binary())], ["doc_id", "n_lines", "n_dropped", "kept"])
    return (both.select(F.col("row.doc_id").cast("long").alias("doc_id"),
                        F.coalesce(F.col("row.text").cast("string"), F.lit("")).cast("binary").alias("body"), "keep")
                .mapInArrow(cut, "doc_id long, n_lines long, n_dropped long, kept binary")
                .select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256")))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole text under the 50k byte-level vocabulary, and the text decoded from them."""
    return bpe.digests(read_table(spark, sf_dir, "documents"), VOCABULARY)


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best documents of every benchmark item."""
    return ranked_search.ranked(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), Scratch(spark, "op11"), k=50)


def op12_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trigram scores by deleted interpolation of every whole text, beside the add-0.1 unigram score."""
    return lm.scores(read_table(spark, sf_dir, "documents"), Scratch(spark, "op12"), n=3)


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to 5 negatives at 80 to 100 % of the score of each of an anchor's 5 positives; anchors: vec_id divisible by 100."""
    vectors = read_table(spark, sf_dir, "embeddings")
    label = F.when(F.col("id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(hard_negatives.quantised(vectors, label), F.col("id") % 100 == 0, Scratch(spark, "op13"), positives=5, k=5, low=80, high=100)


QUERIES = {f.__name__: f for f in (op1_hilbert_shards, op2_simhash, op3_quality, op4_substring_dedup, op5_pii, op6_winnowing,
                                   op7_decontaminate, op8_secret_scan, op9_line_dedup, op10_bpe,
                                   op11_ranked_search, op12_lm_scores, op13_hard_negatives)}

# ---------------------------------------------------------------- DuckDB SQL
_WORDS = r"list_filter(string_split_regex(coalesce({0}, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

_OP4 = f"""
WITH d AS (SELECT doc_id, {_WORDS.format('text')} AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS g FROM d, unnest(range(1, len(w) - 11)) AS t(i)),
lo AS (SELECT g, min(doc_id) AS first_id FROM win GROUP BY g HAVING min(doc_id) < max(doc_id)),
late AS (SELECT doc_id, i FROM win JOIN lo USING (g) WHERE doc_id > first_id),
gone AS (SELECT DISTINCT doc_id, i + j AS i FROM late, unnest(range(0, 13)) AS t(j)),
word AS (SELECT doc_id, i, w[i] AS x FROM d, unnest(range(1, len(w) + 1)) AS t(i)),
cut AS (SELECT doc_id, count(*) AS n, count(gone.i) AS m,
               string_agg(x, ' ' ORDER BY word.i) FILTER (WHERE gone.i IS NULL) AS kept
        FROM word LEFT JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_words, coalesce(m, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN cut USING (doc_id)"""

_NORM = (r"list_filter(string_split_regex(translate(regexp_replace(coalesce(text, ''), '[!-/:-@\[-`{-~]', '', 'g'), "
         r"'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '')")

_OP7 = f"""
WITH d AS (SELECT doc_id, {_NORM} AS w FROM documents),
b AS (SELECT item_id, {_NORM} AS w FROM benchmark),
bs AS (SELECT DISTINCT item_id, least(len(w), 5) AS k, array_to_string(w[i:i + 4], ' ') AS g
       FROM b, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS t(i) WHERE len(w) > 0),
q AS (SELECT item_id, count(*) AS q FROM bs GROUP BY item_id),
ds AS (SELECT DISTINCT doc_id, k, array_to_string(w[i:i + k - 1], ' ') AS g
       FROM d, (SELECT DISTINCT k FROM bs), unnest(range(1, len(w) - k + 2)) AS t(i)),
m AS (SELECT doc_id, item_id, count(*) AS s FROM ds JOIN bs USING (k, g) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, CAST(q AS INTEGER) AS item_shingles, CAST(s AS INTEGER) AS shared_shingles, s / q AS containment
FROM m JOIN q USING (item_id) WHERE s >= ceil(0.8 * q - 1e-9)"""

_SPACE = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_OP9 = f"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
line AS (SELECT doc_id, i, l[i] AS x, translate(trim(l[i], {_SPACE}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
         FROM d, unnest(range(1, len(l) + 1)) AS t(i)),
held AS (SELECT k, min(doc_id) AS first_id FROM line WHERE length(k) >= 10 GROUP BY k),
keep AS (SELECT doc_id, i, x, coalesce(doc_id > first_id, false) AS gone FROM line LEFT JOIN held USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(x, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM keep GROUP BY doc_id"""

_TERMS = (r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
          r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')")
_OP11 = f"""
WITH d AS (SELECT doc_id, {_TERMS} AS t FROM documents),
c AS (SELECT count(*) FILTER (WHERE len(t) > 0) AS n_docs, CAST(sum(len(t)) AS BIGINT) AS n_terms FROM d),
tf AS (SELECT doc_id, term, count(*) AS tf FROM d, unnest(t) AS u(term) GROUP BY doc_id, term),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) AS w
      FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), c),
q AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, {_TERMS} AS t FROM benchmark), unnest(t) AS u(term)),
s AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * len(t) * n_docs) // n_terms)))) AS BIGINT) AS score
      FROM q JOIN w USING (term) JOIN tf USING (term) JOIN d USING (doc_id), c GROUP BY item_id, doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM s WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 50"""

_OP13 = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
           FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label AS own, v.vec_id, v.label, CAST(list_dot_product(a.q, v.q) AS BIGINT) AS score
      FROM v AS a JOIN v ON a.vec_id <> v.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE label = own
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (SELECT anchor_id, positive_id, positive_score, vec_id AS negative_id, score AS negative_score,
             row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS rank
      FROM p JOIN s USING (anchor_id)
      WHERE label <> own AND 80 * positive_score <= 100 * score AND score <= positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5"""

ORACLES = {"op4_substring_dedup": _OP4, "op7_decontaminate": _OP7, "op9_line_dedup": _OP9, "op11_ranked_search": _OP11,
           "op13_hard_negatives": _OP13}
