"""Shared pieces of the text operators: tables, row keys, shared-folder tables,
word hashing.

Row identity. ``doc_id`` may be null or repeated, so operators that send
something back to a text key it by ``(doc_id, text_key)``, where ``text_key`` is
a 64-bit hash of the text. Rows equal in both have equal texts and share what is
sent back.
"""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from ordersight.session import checkpoint_dir

#: Setting under which Spark removes the shuffle files of a query as it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
DOC_COLS = ["doc_id", "text", "lang", "source", "n_chars"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keyed_text(docs: DataFrame, *extra: str) -> DataFrame:
    """``doc_id``, ``text_key`` and the whole text as UTF-8 ``body`` (null: empty)."""
    body = F.coalesce(docs["text"].cast("string"), F.lit(""))
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(body).alias("text_key"),
                       body.cast("binary").alias("body"), *[docs[c] for c in extra])


def ship(spark: SparkSession) -> None:
    """Make this package importable in the Python workers, wherever they start (once per application)."""
    sc = spark.sparkContext
    if _SHIPPED.get("application") != sc.applicationId:
        package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        path = os.path.join(tempfile.mkdtemp(prefix="ordersight-code-"), "ordersight_code.zip")
        with zipfile.ZipFile(path, "w") as z:
            for folder, _, names in os.walk(package):
                for name in names:
                    if name.endswith(".py"):
                        file = os.path.join(folder, name)
                        z.write(file, os.path.relpath(file, os.path.dirname(package)))
        sc.addPyFile(path)
        _SHIPPED["application"] = sc.applicationId


_SHIPPED: dict[str, str] = {}


class Scratch:
    """Intermediate tables in the shared folder (``spark.checkpoint.dir``).

    Writing a table cuts the lineage: a lost executor re-runs at most the tasks
    of the current step. ``drop`` deletes a table that no later step reads; what
    remains is deleted when the session's JVM ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        ship(spark)
        self.spark = spark
        self.root = os.path.join(checkpoint_dir(spark), "llm", f"{name}-{uuid.uuid4().hex[:12]}")
        path = self._path(self.root)
        self.fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        self.fs.deleteOnExit(path)

    def _path(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    @contextlib.contextmanager
    def _set(self, settings: dict[str, str]):
        before = {k: self.spark.conf.get(k, None) for k in settings}
        for k, v in settings.items():
            self.spark.conf.set(k, v)
        try:
            yield
        finally:
            for k, v in before.items():
                if v is None:
                    self.spark.conf.unset(k)
                else:
                    self.spark.conf.set(k, v)

    def table(self, df: DataFrame, name: str, batch_rows: int | None = None) -> DataFrame:
        """The rows, written and read again. Shuffle files of the write go as soon as the table is there. batch_rows: rows sent to Python at a time, for large rows."""
        path = f"{self.root}/{name}"
        with self._set({CLEANUP: "true"} | ({BATCH_ROWS: str(batch_rows)} if batch_rows else {})):
            df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            self.fs.delete(self._path(f"{self.root}/{name}"), True)


def partitions(spark: SparkSession, least: int = 1) -> int:
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


# ---------------------------------------------------------------- word hashes
_RNG = np.random.default_rng(20240229)
#: Odd multipliers of the multilinear n-gram hashes, one row per hash function.
MULT = _RNG.integers(0, 2**63, (2, 4096), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of the public splitmix64 generator."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def gram_hashes(hashes: np.ndarray, n: int, which: int = 0) -> np.ndarray:
    """One 64-bit hash per run of ``n`` consecutive word hashes."""
    k = len(hashes) - n + 1
    if k <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(k, MULT[which, -1] + np.uint64(n), np.uint64)
    for j in range(n):
        out += hashes[j:j + k] * MULT[which, j % 4095]
    return mix(out)


def as_long(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64)


def slices(batches: Iterator[pa.RecordBatch], column: str = "body", nbytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Batches cut so that each holds about ``nbytes`` of ``column`` (one row at least)."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
        start = 0
        while start < len(batch):
            before = ends[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(ends, before + nbytes)))
            yield batch.slice(start, end - start)
            start = end
