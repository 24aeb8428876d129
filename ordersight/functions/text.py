"""String cleaning with the semantics of Python's ``str.strip``/``upper``.

``F.trim`` removes only blanks; Python's ``strip()`` removes every character for
which ``str.isspace()`` is true. The character class below is derived from that
rule, so the regular expression removes exactly the same characters. The
``\\x{..}`` escapes are understood by both Java regex and RE2.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _whitespace_ranges() -> list[tuple[int, int]]:
    points = [cp for cp in range(0x3001) if chr(cp).isspace()]
    ranges: list[tuple[int, int]] = []
    for cp in points:
        if ranges and ranges[-1][1] == cp - 1:
            ranges[-1] = (ranges[-1][0], cp)
        else:
            ranges.append((cp, cp))
    return ranges


def _char_class() -> str:
    parts = []
    for lo, hi in _whitespace_ranges():
        parts.append(f"\\x{{{lo:x}}}" if lo == hi else f"\\x{{{lo:x}}}-\\x{{{hi:x}}}")
    return "[" + "".join(parts) + "]"


WS_CLASS = _char_class()
STRIP_PATTERN = f"^{WS_CLASS}+|{WS_CLASS}+$"
# The same set as a plain string of characters (for TRIM(BOTH chars FROM s)).
WS_CHARS = "".join(chr(cp) for lo, hi in _whitespace_ranges() for cp in range(lo, hi + 1))


def py_strip(col) -> Column:
    """``str.strip()`` on a string column (null stays null).

    Spark's native character-set trim; no regular expression per row.
    """
    c = F.col(col) if isinstance(col, str) else col
    return F.trim(c, F.lit(WS_CHARS))


def upper_strip(col) -> Column:
    """``str.upper().str.strip()``."""
    return F.upper(py_strip(col))


def sql_strip(expr: str) -> str:
    """The same strip as DuckDB SQL text (used by the oracle)."""
    chars = " || ".join(f"chr({ord(c)})" for c in WS_CHARS)
    return f"trim({expr}, {chars})"


def header_norm(col) -> Column:
    """Header normalisation of the matcher: lower, strip, '-'/'_' -> blank."""
    c = F.col(col) if isinstance(col, str) else col
    return F.translate(py_strip(F.lower(c)), "-_", "  ")
