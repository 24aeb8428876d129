"""Column helpers of the native text operators (DataFrame functions only)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

SPANS = "array<struct<start:int,end:int,hit:string>>"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def spans(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches of a pattern without empty matches: code point start, end (exclusive) and the match.

    The pieces between matches give the offsets; a text without a match is not split.
    """
    def located(hits: Column) -> Column:
        def walk(pieces: Column) -> Column:
            def step(acc: Column, i: Column) -> Column:
                start = acc["at"] + F.length(F.get(pieces, i))
                end = start + F.length(F.get(hits, i))
                return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(
                    start.alias("start"), end.alias("end"), F.get(hits, i).alias("hit")))).alias("out"))
            zero = F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("out"))
            return F.aggregate(F.sequence(F.lit(0), F.size(hits) - 1), zero, step, lambda acc: acc["out"])
        return F.when(F.size(hits) > 0, let(F.split(text, pattern, -1), walk)).otherwise(F.array().cast(SPANS))
    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), located)


def digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    def total(chars: Column) -> Column:
        def add(acc: Column, i: Column) -> Column:
            d = F.get(chars, i).cast("int")
            twice = d * 2
            return acc + F.when(i % 2 == 0, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))
        return F.aggregate(F.sequence(F.lit(0), F.size(chars) - 1), F.lit(0), add)
    return let(F.split(F.reverse(number), "(?!^)(?!$)"), total) % 10 == 0


def mod97(code: Column) -> Column:
    """Whether an account code (two letters, two check digits, the rest) leaves 1 when divided by 97, first four characters last."""
    def add(acc: Column, c: Column) -> Column:
        letter = F.ascii(c) - F.lit(55)
        return F.when(c.between("0", "9"), (acc * 10 + F.ascii(c) - F.lit(48)) % 97).otherwise((acc * 100 + letter) % 97)
    moved = F.concat(F.substring(code, 5, 64), F.substring(code, 1, 4))
    return F.aggregate(F.split(moved, "(?!^)(?!$)"), F.lit(0), add) == 1


def listed(kind: str, found: Column) -> Column:
    """``kind:start:end`` of each span."""
    return F.transform(found, lambda s: F.concat(F.lit(f"{kind}:"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string")))
