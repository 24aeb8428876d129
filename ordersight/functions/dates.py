"""Date parsing with the month-day-two-digit-year conventions of the exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ordersight.schema import ANY_DATE_FORMATS, STRICT_DATE_FORMATS, TWO_DIGIT_YEAR_PIVOT


def _pivot_two_digit_year(d: Column, fmt: str) -> Column:
    """Spark maps ``yy`` to 2000-2099; C/Python map 69-99 to 1969-1999."""
    if "yy" in fmt and "yyyy" not in fmt:
        return F.when(F.year(d) >= 2000 + TWO_DIGIT_YEAR_PIVOT,
                      F.add_months(d, -1200)).otherwise(d)
    return d


def parse_date(col, formats=STRICT_DATE_FORMATS) -> Column:
    """Text -> date; the first format that parses wins; unparsable -> null."""
    c = F.col(col) if isinstance(col, str) else col
    attempts = [_pivot_two_digit_year(F.try_to_date(c, f), f) for f in formats]
    return F.coalesce(*attempts) if len(attempts) > 1 else attempts[0]


def parse_date_any(col) -> Column:
    """Lenient parse: a list of formats, first that parses wins."""
    return parse_date(col, ANY_DATE_FORMATS)


#: Formats whose day comes first, tried besides the month-first ones.
DAY_FIRST_FORMATS = ("dd-MM-yy", "dd-MM-yyyy", "dd/MM/yy", "dd/MM/yyyy", "dd.MM.yyyy", "dd.MM.yy")


def date_format_evidence(df: DataFrame, col: str, formats: tuple[str, ...] = ANY_DATE_FORMATS + DAY_FIRST_FORMATS) -> DataFrame:
    """Which one format a text column of dates has: ``format, place, parsed, total, chosen, ambiguous``.

    One map-side combined aggregate counts the values each format parses; a day above
    12 is evidence by not parsing as a month. The format that parses most is chosen,
    the first listed among equals; ``ambiguous`` tells that one which reads some value
    as another day parses as many (no value decides between day and month).
    """
    c = F.trim(F.col(col).cast("string"))
    distinct = df.select(c.alias("t")).filter(F.length("t") > 0).groupBy("t").agg(F.count(F.lit(1)).alias("n"))
    dates = F.array(*[_pivot_two_digit_year(F.try_to_date("t", f), f) for f in formats])
    each = distinct.select("t", "n", F.posexplode(dates).alias("place", "d"))
    # per format: values parsed, and a fingerprint of how they are read
    sums = each.groupBy("place").agg(F.sum(F.when(F.col("d").isNotNull(), F.col("n")).otherwise(0)).alias("parsed"), F.sum("n").alias("total"),
                                     F.sum(F.when(F.col("d").isNotNull(), F.xxhash64("t", "d") % 1_000_003)).alias("reading"))
    best = Window.partitionBy()  # a row per format
    most = sums.withColumn("most", F.max("parsed").over(best))
    first = F.min(F.when((F.col("parsed") == F.col("most")) & (F.col("parsed") > 0), F.col("place"))).over(best)
    chosen = most.withColumn("first", first).withColumn("chosen", F.col("place") == F.col("first"))
    own = F.max(F.when(F.col("chosen"), F.col("reading"))).over(best)
    other = F.max(((F.col("parsed") == F.col("most")) & (F.col("reading") != own)).cast("int")).over(best) == 1
    named = F.element_at(F.array(*[F.lit(f) for f in formats]), F.col("place") + 1)
    return chosen.select(named.alias("format"), "place", "parsed", "total", F.coalesce("chosen", F.lit(False)).alias("chosen"),
                         F.coalesce(F.col("chosen") & other, F.lit(False)).alias("ambiguous"))


def parse_date_column(df: DataFrame, col: str, formats: tuple[str, ...] = ANY_DATE_FORMATS + DAY_FIRST_FORMATS) -> tuple[Column, bool]:
    """The column as dates, all read by the one format that its values show, and whether that is ambiguous."""
    row = date_format_evidence(df, col, formats).filter("chosen").first()
    if row is None:
        return F.lit(None).cast("date"), False
    return parse_date(F.trim(F.col(col).cast("string")), (row["format"],)), row["ambiguous"]


def as_date(df, col: str, formats=STRICT_DATE_FORMATS) -> Column:
    """Typed dispatch: date stays, timestamp is truncated, text is parsed."""
    dtype = dict(df.dtypes)[col]
    if dtype == "date":
        return F.col(col)
    if dtype.startswith("timestamp"):
        return F.to_date(F.col(col))
    return parse_date(F.col(col).cast("string"), formats)


def year_month(d) -> Column:
    """Month label ``yyyy-MM`` (null date -> null)."""
    c = F.col(d) if isinstance(d, str) else d
    return F.date_format(c, "yyyy-MM")
