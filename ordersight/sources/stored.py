"""UPDATE ... SET ... WHERE on a stored table by copy-on-write.

A stored table is a set of Parquet files that a manifest lists (published as
``sources.jobs`` does, by an atomic rename). An update first finds the files that hold a
row to change: the scan for them prunes row groups by their minima and maxima, so on a
table written in order of the condition's column few files are opened. Only those files
are written anew, under new names, and the next manifest lists them in the old ones'
place. Untouched files keep their names. A failing update publishes nothing.
"""

from __future__ import annotations

import json
import uuid
from urllib.parse import unquote, urlparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ordersight.sources.jobs import JobStore

NAME = "table"


class StoredTable:
    """One table under ``root``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.log = spark, root.rstrip("/"), JobStore(spark, root)

    def _add(self, df: DataFrame) -> list[str]:
        """Write rows as new files; their paths below the root."""
        folder = f"data/{uuid.uuid4().hex}"
        df.write.mode("error").parquet(f"{self.root}/{folder}")
        return [f"{folder}/{name}" for name in self.log._list(f"{self.root}/{folder}") if name.startswith("part-")]

    def _publish(self, files: list[str], schema: str) -> None:
        self.log._publish(NAME, {"job_id": NAME, "version": uuid.uuid4().hex, "files": files, "schema": schema})

    def write(self, df: DataFrame, order_by: str | None = None, files: int | None = None, most: int = 1_000_000) -> None:
        """Replace the table; ``order_by``: in ranges of that column, so that updates on it touch few files.

        There are ``files`` ranges, or more: one for every ``most`` rows, so that a range's task doesn't grow with the
        table. Rows of one value are told apart by their hash, so that a value which very many rows have is cut as well.
        The rows are written as they come first, which counts them and saves the range sample from computing them again.
        """
        if not (order_by and files):
            return self._publish(self._add(df), df.schema.json())
        staged = f"{self.root}/staged/{uuid.uuid4().hex}"
        try:
            df.write.mode("error").parquet(staged)
            rows = self.spark.read.schema(df.schema).parquet(staged)
            ranges = max(files, -(-rows.count() // most))
            tie = F.xxhash64(*[F.col(f"`{c}`") for c, kind in df.dtypes if "map<" not in kind and kind != "variant"])
            added = self._add(rows.repartitionByRange(ranges, F.col(f"`{order_by}`"), tie).sortWithinPartitions(F.col(f"`{order_by}`")))
        finally:
            self.log.fs.delete(self.log._path(staged), True)
        self._publish(added, df.schema.json())

    def files(self) -> list[str]:
        return self.log.manifest(NAME)["files"]

    def read(self, files: list[str] | None = None) -> DataFrame:
        manifest = self.log.manifest(NAME)
        chosen = manifest["files"] if files is None else files
        reader = self.spark.read.schema(StructType.fromJson(json.loads(manifest["schema"])))
        return reader.parquet(*[f"{self.root}/{f}" for f in chosen])

    def update(self, where: Column, assignments: dict[str, Column]) -> list[str]:
        """Set columns of the rows that meet ``where`` (null: not met); returns the files written anew."""
        rows = self.read()
        found = rows.where(where).select(F.col("_metadata.file_path").alias("p")).distinct().collect()
        base = self.log._path(self.root).toUri().getPath().rstrip("/") + "/"
        touched = sorted(unquote(urlparse(r["p"]).path).removeprefix(base) for r in found)
        if not touched:
            return []
        hit = F.coalesce(where, F.lit(False))
        types = dict(rows.dtypes)
        changed = self.read(touched).select(*[F.when(hit, assignments[c].cast(types[c])).otherwise(F.col(f"`{c}`")).alias(c) if c in assignments else F.col(f"`{c}`")
                                              for c in rows.columns])
        new = self._add(changed)
        self._publish([f for f in self.files() if f not in touched] + new, rows.schema.json())
        return touched

    def vacuum(self) -> list[str]:
        """Delete the files that the current manifest doesn't list; returns them."""
        named, gone = set(self.files()), []
        for folder in self.log._list(f"{self.root}/data"):
            for name in self.log._list(f"{self.root}/data/{folder}"):
                path = f"data/{folder}/{name}"
                if name.startswith("part-") and path not in named:
                    self.log.fs.delete(self.log._path(f"{self.root}/{path}"), False)
                    gone.append(path)
        return gone
