"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import functools
import gc
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from airgrid.session import scratch_path


BATCH_BYTES = 4 << 20        # of an Arrow batch that travels to a Python task


def bound_batches(spark: SparkSession) -> SparkSession:
    """Batches end by bytes as well as by rows, so that long texts do not pile up in a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def give_back() -> None:
    """Return memory that this process has freed to the system; its allocators would keep it."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):                    # another C library
        pass


def giving_back(fn):
    """Wrap a task function over batches: what it held goes back to the system when the task ends.

    Workers serve one task after another, and their allocators keep freed memory.
    """
    @functools.wraps(fn)
    def run(batches):
        try:
            yield from fn(batches)
        finally:
            give_back()
    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back.

    Cuts the lineage with a table that every executor can reach, so that a lost
    executor costs a reread and never a different result.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored_by(df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
    """As ``stored``, dealt by a hash of ``key``: a later grouping by ``key`` reads its groups in place.

    The table's files lie in the scratch folder; its catalog entry is only needed to
    open it and is removed again, which leaves the files alone.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    table_name = f"airgrid_{uuid.uuid4().hex}"
    df.write.bucketBy(buckets, key).option("path", path).saveAsTable(table_name)
    try:
        return spark.table(table_name)
    finally:
        spark.sql(f"DROP TABLE {table_name}")


def held_out(doc_id: Column, folds: int = 3, fold: int = 1) -> Column:
    """True where crc32 of the id written as text falls in the held-out fold."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds)) == fold, F.lit(False))


def widest(df: DataFrame, minimum: int = 8) -> int:
    """Partition count for an explicit repartition: what the session plans for shuffles."""
    return max(minimum, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
