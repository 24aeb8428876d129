"""Secret scan by a trigram inverted index.

From the parse tree of every rule's regular expression a Boolean trigram query is
derived: an AND of clauses, each an OR of alternatives, each an AND of trigrams that
a match must hold (all lower-cased, so case-insensitive rules share the index). The
index holds postings (trigram, document) of the trigrams that some query names.
Postings are intersected by counting, per document and alternative, the trigrams
found; candidates are verified by the rule itself on the whole text. A rule without
mandatory trigrams scans all texts.

DataFrame functions only. Postings of one common trigram are never gathered: the
counting is keyed by (document, alternative) and combined map-side.

Defined results: a null or empty text holds nothing; equal texts have equal spans;
null ids and repeated rows each give their row; an empty table gives an empty result;
other columns are never read by name.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ordersight.llm.columns import SPANS, spans

_parser = re._parser
FEW = 64  # strings that one run of a pattern may stand for


@dataclass(frozen=True)
class Rule:
    """A kind of secret. ``pattern`` in the syntax that Python and Java share; ``least``: characters that ``part`` (a pattern that
    the match must hold at its end, or the whole match) needs."""

    name: str
    pattern: str
    least: int = 0
    tail: str = ""


#: Base rules as the task fixes them, then the rules this scan adds.
RULES = [
    Rule("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""", 6,
         r"""^(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""),
    Rule("access", r"AKIA[A-Z0-9]+", 20),
    Rule("hex", r"[0-9a-f]{24,}"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("cloud", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
]
BASE = ("assign", "access", "hex")


def _strings(items) -> set[str] | None:
    """The strings a piece of a pattern stands for, lower-cased, or None if these aren't few."""
    out = {""}
    for op, arg in items:
        name = str(op)
        if name == "LITERAL":
            some = {chr(arg).lower()}
        elif name == "IN" and all(str(o) == "LITERAL" for o, _ in arg):
            some = {chr(a).lower() for _, a in arg}
        elif name == "SUBPATTERN":
            some = _strings(arg[-1])
        elif name == "BRANCH":
            each = [_strings(branch) for branch in arg[1]]
            some = None if None in each else set().union(*each)
        elif name in ("MAX_REPEAT", "MIN_REPEAT") and arg[1] != _parser.MAXREPEAT and arg[1] <= 4:
            one = _strings(arg[2])
            some = None if one is None else {"".join(x) for n in range(arg[0], arg[1] + 1) for x in product(one, repeat=n)}
        else:
            some = None
        if some is None or len(some) * len(out) > FEW:
            return None
        out = {a + b for a in out for b in some}
    return out


def trigram_query(pattern: str) -> list[list[frozenset[str]]]:
    """AND of clauses; a clause is an OR of sets of trigrams, all of which a match holds. Empty: nothing is mandatory."""
    clauses: list[list[frozenset[str]]] = []
    run: set[str] = {""}

    def close() -> None:
        sets = {frozenset(s[i:i + 3] for i in range(len(s) - 2)) for s in run}
        if frozenset() not in sets:
            clauses.append(sorted((s for s in sets if not any(t < s for t in sets)), key=sorted))

    for item in _parser.parse(pattern):
        some = _strings([item])
        if some is None:
            close()
            run = {""}
        elif len(run) * len(some) > FEW:
            close()
            run = some
        else:
            run = {a + b for a in run for b in some}
    close()
    return clauses


def index(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """Postings ``trigram, doc_id, text_key`` of the trigrams that the rules' queries name."""
    terms = sorted({t for r in rules for clause in trigram_query(r.pattern) for s in clause for t in s})
    body = F.lower(F.coalesce(docs["text"].cast("string"), F.lit("")))
    keyed = docs.select(docs["doc_id"].cast("long").alias("doc_id"),
                        F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit(""))).alias("text_key"), body.alias("low"))
    held = F.filter(F.array(*[F.when(F.contains(F.col("low"), F.lit(t)), F.lit(t)) for t in terms]), lambda t: t.isNotNull())
    return keyed.select(F.explode(held).alias("trigram"), "doc_id", "text_key")


def candidates(postings: DataFrame, rules: list[Rule]) -> DataFrame:
    """``doc_id, text_key, rules``: names of the rules whose trigram query the document meets."""
    spark = postings.sparkSession
    rows = [(r.name, c, a, t, len(s), len(query)) for r in rules for query in [trigram_query(r.pattern)]
            for c, clause in enumerate(query) for a, s in enumerate(clause) for t in sorted(s)]
    named = spark.createDataFrame(rows, "rule string, clause int, alternative int, term string, terms int, clauses int")
    met = (postings.join(F.broadcast(named), F.col("trigram") == F.col("term"))  # a few dozen rows, from the rules alone
                   .groupBy("doc_id", "text_key", "rule", "clause", "alternative")
                   .agg(F.count_distinct("trigram").alias("n"), F.max("terms").alias("terms"), F.max("clauses").alias("clauses"))
                   .where("n = terms"))
    whole = (met.groupBy("doc_id", "text_key", "rule").agg(F.count_distinct("clause").alias("n"), F.max("clauses").alias("clauses"))
                .where("n = clauses"))
    return whole.groupBy("doc_id", "text_key").agg(F.collect_set("rule").alias("rules"))


def _verified(text: Column, rule: Rule) -> Column:
    found = spans(text, rule.pattern)
    if rule.least:
        part = (lambda hit: F.regexp_replace(hit, rule.tail, "")) if rule.tail else (lambda hit: hit)
        found = F.filter(found, lambda s: F.length(part(s["hit"])) >= rule.least)
    return found


def find(docs: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """``doc_id`` and one array column of spans (start, end, hit) for each rule."""
    found = candidates(index(docs, rules), rules).select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), "rules")
    body = F.coalesce(docs["text"].cast("string"), F.lit(""))
    left = docs.select(docs["doc_id"].cast("long").alias("doc_id"), body.alias("body"), F.xxhash64(body).alias("text_key"))
    both = left.join(found, left["doc_id"].eqNullSafe(found["_id"]) & (left["text_key"] == found["_key"]), "left")
    none = F.array().cast(SPANS)
    return both.select("doc_id", *[
        (F.when(F.array_contains("rules", r.name), _verified(F.col("body"), r)).otherwise(none) if trigram_query(r.pattern)
         else _verified(F.col("body"), r)).alias(r.name) for r in rules])
