"""Corpus pipeline: quality, line dedup, near-duplicates, decontamination, tokens.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns
a DataFrame, written as Parquet and read again as the next one's ``docs``. All but
the last return the columns of ``documents``. ``run`` applies them to ``documents``.
No stage is expressible in DuckDB SQL as a whole (a fitted model, XXH64
fingerprints, a tokenizer), so ``ORACLE_SQL`` is None and the tests compare the
stages with plain Python.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ordersight.llm import bpe, decontaminate, line_dedup, quality, simhash
from ordersight.llm.common import Scratch, read_table
from ordersight.llm.queries import VOCABULARY


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores 0.5 or more; fitted on at most 3,000 labelled rows of ``docs``."""
    return quality.keep_good(docs, quality.train(docs, read_table(spark, sf_dir, "labels"), sample=3000), least=0.5)


def fresh_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that a smaller ``doc_id`` holds; ``n_chars`` counted anew."""
    return line_dedup.dedup_lines(docs, Scratch(spark, "pipeline-lines"), min_chars=10)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (4-word shingles, 4 bits): the smallest ``doc_id``."""
    return simhash.dedup_near(docs, Scratch(spark, "pipeline-near"), n=4, seed=42, distance=4)


def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold less than 0.8 of every benchmark item's five-word shingles."""
    return decontaminate.decontaminate(docs, read_table(spark, sf_dir, "benchmark"), n=5, least=0.8)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids`` of every document left."""
    return bpe.encode(docs, VOCABULARY).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [("quality", good_documents), ("line_dedup", fresh_lines), ("near_duplicates", one_of_each),
          ("decontamination", clean_of_benchmark), ("bpe", tokens)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; the stages before are written to the shared folder, each deleted once the next is there."""
    scratch = Scratch(spark, "pipeline")
    docs = read_table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES[:-1]:
        docs = scratch.table(stage(spark, docs, sf_dir), name)
        if before:
            scratch.drop(before)
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)
