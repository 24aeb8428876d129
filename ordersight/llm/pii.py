"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust the score.

DataFrame functions only, one narrow pass over whole texts. Base kinds (email, ip,
card, phone) are exact: every match that meets its rule stays. Further kinds start
from a prior and stay if their score reaches ``least``: an account number (iban) is
what of a run of groups passes mod-97 (``accounts``); a bare national number (ssn) or local telephone number (local) needs a
word of its kind nearby. Every span carries its score.

The patterns use possessive groups and look-behind where these don't change the
matches, so a long run of word characters or digits takes linear time. The pattern
of an account number takes its first four characters only and looks ahead over a
bounded run, as the number's end is not known before mod-97 is.

Defined results: a null or empty text has no spans; equal texts have equal spans;
null ids and repeated rows each give their row; an empty table gives an empty result;
other columns are never read by name.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ordersight.llm.columns import SPANS, digits, let, luhn, mod97, spans

OCTET = "0*(?:[0-9]|[1-9][0-9]|1[0-9][0-9]|2[0-4][0-9]|25[0-5])"


@dataclass(frozen=True)
class Kind:
    """One kind of span: what must be in a text at all, the pattern, prior, and words that raise the score."""

    name: str
    needs: str
    pattern: str
    prior: float
    words: str
    base: bool


KINDS = [
    Kind("email", "@", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", 0.8, "mail|contact|write", True),
    Kind("ip", ".", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", 0.6, "ip|host|server|address", True),
    Kind("card", "", r"[0-9](?:[ -]?[0-9]){12,}+", 0.3, "card|visa|credit|debit|payment", True),
    Kind("phone", "+", r"\+[0-9][ ().0-9-]+[0-9]", 0.6, "phone|tel|call|mobile|fax", True),
    Kind("iban", "", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=((?: ?[A-Z0-9]){11,30}[A-Za-z0-9]?))", 0.3, "iban|account|bank|konto|compte|cuenta", False),
    Kind("ssn", "-", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", 0.4, "ssn|social|security|tax", False),
    Kind("local", "", r"(?<![0-9+(.-])\(?[0-9]{3}\)?[ .-][0-9]{3}[.-][0-9]{4}(?![0-9])", 0.4, "phone|tel|call|mobile|fax", False),
]
CHECKED, NEAR, REACH = 0.5, 0.3, 40
#: Characters of an account number by country (ISO 13616).
LENGTHS = {n: names.split() for n, names in {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA",
    30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU"}.items()}


def _holds(kind: str, hit: Column) -> Column:
    """Rules of a kind beyond its pattern."""
    if kind == "ip":
        return hit.rlike(f"^{OCTET}(?:[.]{OCTET}){{3}}$")
    if kind == "card":
        return let(digits(hit), lambda d: F.when(F.length(d).between(13, 19), luhn(d)).otherwise(F.lit(False)))
    if kind == "phone":
        return F.length(digits(hit)).between(9, 15)
    return F.lit(True)


def _account_end(run: Column) -> Column:
    """Length of the account number that a run of groups (with a letter or digit behind it, if one is there) begins with, or null.

    Prefixes that end at the country's length or at a group's end are tested by
    mod-97; of those that pass, the one of the country's length, else the longest.
    """
    country, due = F.substring(run, 1, 2), F.lit(None).cast("int")
    for n, names in LENGTHS.items():
        due = F.when(country.isin(names), F.lit(n)).otherwise(due)

    def tested(at: Column) -> Column:
        code = F.replace(F.substring(run, F.lit(1), at), F.lit(" "), F.lit(""))
        here, behind = F.substring(run, at, F.lit(1)), F.substring(run, at + 1, F.lit(1))

        def passes(c: Column) -> Column:
            whole = F.coalesce(F.length(c) == due, F.lit(False))
            ends = here.rlike("[A-Z0-9]") & (whole | ~behind.rlike("[A-Za-z0-9]"))
            good = F.when(ends & F.length(c).between(15, 34), mod97(c)).otherwise(F.lit(False))
            return F.when(good, F.struct(whole.alias("whole"), at.alias("at")))
        return let(code, passes)
    return F.array_max(F.transform(F.sequence(F.lit(15), F.length(run)), tested))["at"]


def accounts(text: Column, pattern: str) -> Column:
    """Spans of account numbers: each begins at a match of the pattern, whose group is what follows the match; leftmost first, without overlaps."""
    def resolved(head: Column, tail: Column) -> Column:
        return let(F.concat(head["hit"], tail), lambda run: let(_account_end(run), lambda n: F.when(n.isNotNull(), F.struct(
            head["start"].alias("start"), (head["start"] + n).alias("end"), F.substring(run, F.lit(1), n).alias("hit")))))

    def apart(acc: Column, s: Column) -> Column:
        return F.when((F.size(acc) == 0) | (s["start"] >= F.element_at(acc, -1)["end"]), F.concat(acc, F.array(s))).otherwise(acc)

    def of_tails(tails: Column) -> Column:
        found = F.filter(F.zip_with(spans(text, pattern), tails, resolved), lambda s: s.isNotNull())
        return F.when(F.size(tails) > 0, F.aggregate(found, F.array().cast(SPANS), apart)).otherwise(F.array().cast(SPANS))
    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), of_tails)


def scored_spans(text: Column, kind: Kind, least: float = 0.6) -> Column:
    """Spans of one kind: start, end, hit, score."""
    found = accounts(text, kind.pattern) if kind.name == "iban" else F.filter(spans(text, kind.pattern), lambda s: _holds(kind.name, s["hit"]))
    checked = CHECKED if kind.name in ("card", "iban") else 0.0

    def score(s: Column) -> Column:
        begin = F.greatest(s["start"] - REACH, F.lit(0))
        around = F.concat_ws(" ", F.substring(text, begin + 1, s["start"] - begin), F.substring(text, s["end"] + 1, F.lit(REACH)))
        near = F.lower(around).rlike(rf"\b(?:{kind.words})")
        return F.least(F.lit(1.0), F.lit(kind.prior + checked) + F.when(near, F.lit(NEAR)).otherwise(F.lit(0.0)))
    out = F.transform(found, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["hit"].alias("hit"), score(s).alias("score")))
    if not kind.base:
        out = F.filter(out, lambda s: s["score"] >= least)
    return F.when(F.contains(text, F.lit(kind.needs)), out).otherwise(F.array().cast(
        "array<struct<start:int,end:int,hit:string,score:double>>")) if kind.needs else out


def find(docs: DataFrame, least: float = 0.6) -> DataFrame:
    """``doc_id`` and one array column of scored spans for each kind."""
    body = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("body"))
    return body.select("doc_id", *[scored_spans(F.col("body"), k, least).alias(k.name) for k in KINDS])
