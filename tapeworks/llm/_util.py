"""Shared plumbing of the training-data operators: written intermediates and small helpers."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeworks.sources.shared import delete_path, shared_path

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = "abcdefghijklmnopqrstuvwxyz"


#: Small intermediate tables are written to so many files at least, larger ones with so many rows a file.
LEAST_FILES, ROWS_PER_FILE = 6, 200_000


#: Rows cross to Python workers in Arrow batches of at most so many bytes (one row at least).
BATCH_BYTES = 12 << 20


def bound_batches(spark: SparkSession) -> None:
    """Bounds the session's Arrow batches by bytes, so that long texts don't add up to large ones. A smaller bound stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch() <= BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def give_back() -> None:
    """Returns memory that is free to the system. Python workers live on between tasks, and what one operator's batches
    took would else count beside what the next one needs."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not this C library
        pass


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same over batches, with free memory given back after each."""

    def each(batches):
        for batch in batches:
            yield batch
            del batch
            give_back()

    return lambda batches: run(each(batches))


class Stash:
    """Intermediate tables written to the shared folder; lineage ends at each of them.

    A written table survives the loss of executors, is compressed, and is read again with its
    schema given. `drop` removes one that no pending plan needs any more.
    """

    def __init__(self, spark: SparkSession, tag: str):
        self.spark, self.tag = spark, tag
        bound_batches(spark)

    def write(self, df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
        """Writes a table and reads it again. `rows`, a bound on its rows of a few numbers each, keeps a small one
        in few files; the shuffle before it stays as wide as it is."""
        path = shared_path(self.spark, f"{self.tag}-{name}")
        if rows is not None and (files := max(LEAST_FILES, rows // ROWS_PER_FILE)) < partitions(self.spark):
            df = df.coalesce(files)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.stash_path = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            if path := getattr(df, "stash_path", None):
                delete_path(self.spark, path)


def text_bytes(df: DataFrame, text_col: str) -> int:
    """How many bytes of text a frame holds, by one aggregate over the column. The optimizer's estimate is the size on
    disk for a scan and a product for a join, so it is no measure of work."""
    return int(df.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0)


def ascii_lower(col):
    """Lower-cases A-Z and nothing else."""
    return F.translate(col, ASCII_UPPER, ASCII_LOWER)


def partitions(spark: SparkSession, at_least: int = 1) -> int:
    return max(at_least, int(spark.conf.get("spark.sql.shuffle.partitions")))
