"""The KPI tables one analysis run needs, computed together.

Rules and checks compare groups with scalars of the same tables (means,
medians, totals). Written as nested scalar subqueries over the fact table,
every subquery would re-scan and re-aggregate the order lines. Instead all
per-dimension tables (each bounded by a dimension's cardinality) come from one
cube (additive measures in a grouping-sets aggregate, distinct orders from
narrow rows clustered by order), written once to the shared checkpoint folder
(``spark.checkpoint.dir``) together with the expansion targets; the rules then
run over these small tables. Writing also cuts the lineage, so a lost
executor does not force the fact-table aggregation to be recomputed.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordersight.operators import kpis as K
from ordersight.operators import market as MK
from ordersight.session import drop_path, scratch_path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once under the shared checkpoint folder and read it back."""
    return written(df, name)[0]


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = scratch_path(spark, f"{name}-{uuid.uuid4().hex[:12]}")
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


@dataclass
class KpiBundle:
    scalars: DataFrame
    states: DataFrame          # revenue_by_state
    state_agg: DataFrame       # per-state base measures
    targets: DataFrame         # expansion targets
    categories: DataFrame      # revenue_by_category
    months: DataFrame          # monthly_trend
    methods: DataFrame         # by_fulfillment_method
    totals: DataFrame          # one row of base measures over all lines (lines = row count)
    fulfillment: DataFrame     # fulfillment_by_state
    model: DataFrame           # expansion model
    segments: DataFrame | None  # b2b_vs_b2c
    channels: DataFrame | None  # by_channel
    paths: list[str]           # written tables behind the others

    def close(self) -> None:
        """Delete the written tables, once all results are stored."""
        for path in self.paths:
            drop_path(self.totals.sparkSession, path)

    def record(self) -> dict[str, DataFrame]:
        """The run's whole KPI record: the scalars and the nine tables."""
        tables = {"scalar_kpis": self.scalars, "revenue_by_state": self.states, "revenue_by_category": self.categories,
                  "monthly_trend": self.months, "fulfillment_by_state": self.fulfillment, "expansion_model": self.model,
                  "expansion_targets": self.targets, "b2b_vs_b2c": self.segments, "by_channel": self.channels,
                  "by_fulfillment_method": self.methods}
        return {name: t for name, t in tables.items() if t is not None}


DIMS = ["ship_state", "category", "year_month", "fulfillment", "sales_channel", "is_b2b"]
BASES = ["revenue", "orders", "lines", "quantity", "fulfilled", "amount_n", "b2b_revenue"]

ADDITIVE = [b for b in BASES if b != "orders"]


def _dims(valid: DataFrame) -> list[str]:
    return [d for d in DIMS if d in valid.columns]


def order_values(valid: DataFrame) -> DataFrame:
    """One row per order: ``order_id`` and ``keys``, its distinct dimension values and one key for the total.

    A key is text, ``gid:`` and the value behind a ``v`` (nothing for a null value), so
    that sets of keys are told apart by hash. The sets are built map-side before the one
    shuffle, a row for each order: an order that holds a large share of all lines
    shrinks to its distinct values. Lines without an order id don't count (COUNT
    DISTINCT ignores nulls).
    """
    dims = _dims(valid)
    key = lambda d: F.concat(F.lit(f"{_gid(d, dims)}:"), F.coalesce(F.concat(F.lit("v"), F.col(d).cast("string")), F.lit("")))
    per = valid.filter(F.col("order_id").isNotNull()).groupBy("order_id").agg(*[F.collect_set(key(d)).alias(d) for d in dims])
    return per.select("order_id", F.concat(*dims, F.array(F.lit(f"{_gid(None, dims)}:"))).alias("keys"))


def count_keys(keys: DataFrame, n=None, out: str = "orders") -> DataFrame:
    """Rows (or the sum of ``n``) of each ``each``, a key of ``order_values``: ``gid, key`` and ``out``."""
    per = keys.groupBy("each").agg((F.count(F.lit(1)) if n is None else F.sum(n)).alias(out))
    begin = F.locate(":", F.col("each"))
    gid = F.substring_index("each", ":", 1).cast("int")
    return per.select(gid.alias("gid"), F.when(F.length("each") > begin, F.substr("each", begin + 2)).alias("key"), out)


def order_counts(valid: DataFrame) -> DataFrame:
    """Distinct orders per dimension value and in all: ``gid, key, orders``."""
    return count_keys(order_values(valid).select(F.explode("keys").alias("each")))


def measured(valid: DataFrame) -> DataFrame:
    """The columns that the cube reads."""
    return valid.select(*dict.fromkeys(["order_id", *_dims(valid), "amount", "quantity", "is_fulfilled", "is_b2b"]))


def additive_cube(valid: DataFrame) -> DataFrame:
    """The additive measures per dimension value and in all: ``gid, key`` and the measures.

    They are summed per combination of all dimensions (map-side combined), and the
    GROUPING SETS run over that small result. ``gid`` tells the sets apart (a NULL
    key inside a set is a real group, e.g. undated lines).
    """
    dims = _dims(valid)
    cells = valid.groupBy(*dims).agg(*[K.BASE[b]().alias(b) for b in ADDITIVE])
    sums = cells.groupingSets([[d] for d in dims] + [[]], *dims).agg(*[F.sum(b).alias(b) for b in ADDITIVE], F.grouping_id().alias("gid"))
    key = F.lit(None).cast("string")
    for d in dims:
        key = F.when(F.col("gid") == _gid(d, dims), F.col(d).cast("string")).otherwise(key)
    return sums.select(F.col("gid").cast("int").alias("gid"), key.alias("key"), *ADDITIVE)


def with_orders(sums: DataFrame, counts: DataFrame) -> DataFrame:
    """The cube: additive measures and ``orders`` of each (gid, key)."""
    counts = counts.select(F.col("gid").alias("_gid"), F.col("key").alias("_key"), "orders")
    both = sums.join(counts, (F.col("gid") == F.col("_gid")) & F.col("key").eqNullSafe(F.col("_key")), "left")
    return both.select("gid", "key", *[F.coalesce("orders", F.lit(0)).alias("orders") if b == "orders" else F.col(b) for b in BASES])


def kpi_cube(valid: DataFrame) -> DataFrame:
    """Every per-dimension base measure plus the grand total: rows (gid, key, measures)."""
    return with_orders(additive_cube(valid), order_counts(valid))


def approximate_orders(valid: DataFrame, log_k: int = 14) -> DataFrame:
    """``gid, key, orders``: distinct orders per dimension value and in all, by sketches.

    One narrow pass: each combination of all dimensions gets a sketch of its order ids
    (map-side combined), and the sketches are merged per dimension value, so no order id
    is shuffled. The relative standard error is about 1.04 / 2^(log_k / 2), 0.8 % at 14;
    counts far below 2^log_k are nearly exact. Opt-in; the rules use exact counts.
    """
    dims = _dims(valid)
    cells = valid.filter(F.col("order_id").isNotNull()).groupBy(*dims).agg(F.hll_sketch_agg("order_id", F.lit(log_k)).alias("sketch"))
    sets = cells.groupingSets([[d] for d in dims] + [[]], *dims).agg(F.hll_union_agg("sketch").alias("sketch"), F.grouping_id().alias("gid"))
    key = F.lit(None).cast("string")
    for d in dims:
        key = F.when(F.col("gid") == _gid(d, dims), F.col(d).cast("string")).otherwise(key)
    return sets.select(F.col("gid").cast("int").alias("gid"), key.alias("key"), F.hll_sketch_estimate("sketch").alias("orders"))


def _gid(dim: str | None, dims: list[str]) -> int:
    """grouping_id bit pattern of a single-dimension set (1 = rolled up)."""
    bits = [0 if d == dim else 1 for d in dims]
    return int("".join(map(str, bits)), 2)


def _slice(cube: DataFrame, dim: str | None, dims: list[str], types: dict[str, str]) -> DataFrame:
    part = cube.filter(F.col("gid") == _gid(dim, dims))
    return part.select(*([F.col("key").cast(types[dim]).alias(dim)] if dim else []), *BASES)


def kpi_bundle(valid: DataFrame, pillars: int = 2, persist: bool = True, stored: bool = False) -> KpiBundle:
    """Compute the run's KPI tables from valid order lines. The sums and the distinct orders
    are two passes; unless the lines are a ``stored`` table, what these passes read is
    written first, so that the lines are joined or parsed once."""
    if not persist or stored:
        return bundle_of(kpi_cube(valid), _dims(valid), dict(valid.dtypes), pillars, persist)
    lines, path = written(measured(valid), "kpi-lines")
    bundle = bundle_of(kpi_cube(lines), _dims(valid), dict(valid.dtypes), pillars)  # the cube is written by now
    drop_path(valid.sparkSession, path)
    return bundle


def bundle_of(cube: DataFrame, dims: list[str], types: dict[str, str], pillars: int = 2, persist: bool = True) -> KpiBundle:
    """The KPI tables of a cube over ``dims`` with their column ``types``."""
    paths: list[str] = []

    def keep(df: DataFrame, name: str) -> DataFrame:
        if not persist:
            return df
        table, path = written(df, name)
        paths.append(path)
        return table
    cube = keep(cube, "kpi-cube")
    part = lambda dim: _slice(cube, dim, dims, types)
    state_agg = part("ship_state")
    states = K.revenue_by_state(state_agg, aggregated=True)
    targets = keep(MK.expansion_targets(state_agg, pillars, aggregated=True), "targets")
    return KpiBundle(
        scalars=K.scalar_kpis(part(None), aggregated=True),
        states=states,
        state_agg=state_agg,
        targets=targets,
        categories=K.revenue_by_category(part("category"), aggregated=True),
        months=K.monthly_trend(part("year_month"), aggregated=True),
        methods=K.by_fulfillment_method(part("fulfillment"), aggregated=True),
        totals=part(None),
        fulfillment=K.fulfillment_by_state(state_agg, aggregated=True),
        model=MK.expansion_model(state_agg, pillars, aggregated=True),
        segments=K.b2b_vs_b2c(part("is_b2b"), aggregated=True) if "is_b2b" in dims else None,
        channels=K.by_channel(part("sales_channel"), aggregated=True) if "sales_channel" in dims else None,
        paths=paths,
    )
