"""Number rendering for insight / finding text, identical in Spark and SQL.

Values are first fixed to 6 decimals, then rounded half-to-even to the shown
number of places, so the text is the same for every engine that computes the
same double.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x):
    if isinstance(x, (int, float)):
        return F.lit(x)
    return F.col(x) if isinstance(x, str) else x


def fixed(x, places: int) -> Column:
    """Like format(x, '.{places}f') without thousands separators."""
    return F.bround(_c(x).cast("decimal(38,6)"), places).cast("string")


def grouped0(x) -> Column:
    """Like format(x, ',.0f'): integer with thousands separators."""
    return F.format_number(F.bround(_c(x).cast("decimal(38,6)"), 0), 0)


def sql_fixed(x: str, places: int) -> str:
    return f"CAST(round_even(CAST({x} AS DECIMAL(38,6)), {places}) AS VARCHAR)"


def sql_grouped0(x: str) -> str:
    return f"format('{{:,}}', CAST(round_even(CAST({x} AS DECIMAL(38,6)), 0) AS HUGEINT))"


def _split(template: str):
    """'a {x} b' -> ['a ', ('x',), ' b']"""
    import re
    out, pos = [], 0
    for m in re.finditer(r"\{(\w+)\}", template):
        if m.start() > pos:
            out.append(template[pos:m.start()])
        out.append((m.group(1),))
        pos = m.end()
    if pos < len(template):
        out.append(template[pos:])
    return out


def fill(template: str, **parts) -> Column:
    """Render a text template whose ``{name}`` placeholders are string Columns."""
    cols = [F.lit(p) if isinstance(p, str) else parts[p[0]] for p in _split(template)]
    return F.concat(*cols) if len(cols) > 1 else cols[0]


def sql_fill(template: str, **parts) -> str:
    """The same template as a SQL string expression (``||`` concatenation)."""
    out = []
    for p in _split(template):
        out.append("'" + p.replace("'", "''") + "'" if isinstance(p, str) else f"({parts[p[0]]})")
    return " || ".join(out)
