"""Pieces that several training-data operators need: shared storage, cut lineage, salted joins."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What separates words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = r"[\x20\x09-\x0D]"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: `spark.checkpoint.dir` of the session.

    A local master without that setting (as in tests) gets a temporary folder, once a session;
    a cluster without it is an error, since no local folder would be shared.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="axisflow-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/axisflow/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """The rows as a table in the shared folder: cuts the lineage and outlives any executor."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def give_back() -> None:
    """Returns freed memory to the system: a Python worker that waits for its next task would hold it, beside a full heap."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """`run` for mapInArrow, giving freed memory back at the end of each task."""

    def out(batches: Iterator) -> Iterator:
        yield from run(batches)
        give_back()

    return out


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000, size: str = "4m"):
    """Arrow batches of few rows for what is written meanwhile; the session's own settings hold again afterwards."""
    wanted = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows), "spark.sql.execution.arrow.maxBytesPerBatch": size}
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def renamed(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Only the named expressions, whatever else and however often `df` has under those names."""
    return df.select(*(c.alias(k) for k, c in columns.items()))


def salted_left_join(left: DataFrame, right: DataFrame, keys: list[str], spread: Column, salts: int = 64) -> DataFrame:
    """A left join whose hot keys are dealt over `salts` tasks.

    `right` has one narrow row a key and is repeated for each salt; `spread` is a column of `left`
    that differs between rows of one key.
    """
    left = left.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)))
    right = right.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return left.join(right, [*keys, "_salt"], "left").drop("_salt")
