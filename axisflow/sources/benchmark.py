"""Chunked CSV tables with a JSON manifest: {"datasets": {family: {"chunks": [{"path", "rows"}, ...]}}}."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from axisflow.operators.labels import families


def read_manifest(spark: SparkSession, root: str) -> dict:
    return json.loads("\n".join(r["value"] for r in spark.read.text(f"{root}/manifest.json", wholetext=True).collect()))


def read_benchmark(spark: SparkSession, root: str, columns: Sequence[str], family: str | Sequence[str] = "both") -> DataFrame:
    """All-string rows of the chosen families, with the chunk's number and family; only their files are listed and read."""
    manifest = read_manifest(spark, root)
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    chunks = [(name, i, c["path"]) for name in families(family) for i, c in enumerate(manifest["datasets"][name]["chunks"])]
    if not chunks:
        raise ValueError("the manifest has no chunk of these families")
    df = spark.read.schema(schema).option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True).csv([f"{root}/{p}" for *_, p in chunks])
    # a chunk is one multi-line file, so one task reads it in order; the row numbers of a task count on over its files
    df = df.withColumn("_file", F.url_decode(F.col("_metadata.file_path"))).withColumn("_row", F.monotonically_increasing_id())
    known = spark.createDataFrame([(*c[:2], "/" + c[2].lstrip("/")) for c in chunks], "chunk_family string, chunk int, _path string")
    first = df.groupBy("_file").agg(F.min("_row").alias("_first"))
    places = first.join(known, F.col("_file").endswith(F.concat(F.lit("/" + root.rstrip("/").rsplit("/", 1)[-1]), F.col("_path"))))
    return df.join(F.broadcast(places.drop("_path")), "_file").withColumn("chunk_row", F.col("_row") - F.col("_first")).drop("_file", "_row", "_first")


def row_at(rows: DataFrame, ordinal: int) -> DataFrame:
    """The row of an ordinal over the chunks in order of the manifest; negative ones count from the end.

    Only row counts of chunks come to the driver: their running sum tells the chunk and the row in it.
    """
    sizes = rows.groupBy("chunk_family", "chunk").agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.orderBy(F.col("chunk_family"), "chunk").collect()
    total = sum(r["n"] for r in sizes)
    at = ordinal + total if ordinal < 0 else ordinal
    if not 0 <= at < total:
        raise IndexError(f"{ordinal} is not among {total} rows")
    for r in sizes:
        if at < r["n"]:
            return rows.filter((F.col("chunk_family") == r["chunk_family"]) & (F.col("chunk") == r["chunk"]) & (F.col("chunk_row") == at))
        at -= r["n"]
    raise AssertionError


def export(release: DataFrame, routes: dict[str, str], path: str) -> DataFrame:
    """Writes one JSONL folder a route (a SQL condition); returns counts by split and label. A partly filled group column is an error."""
    row = release.agg(F.count_if(F.coalesce(F.trim("calibration_group"), F.lit("")) == "").alias("without"), F.count(F.lit(1)).alias("n")).first()
    if row["without"] not in (0, row["n"]):
        raise ValueError(f"{row['without']} of {row['n']} rows have no calibration group")
    for name, condition in routes.items():
        release.filter(condition).write.json(f"{path}/{name}")
    return release.groupBy("split", "label").agg(F.count(F.lit(1)).alias("rows"))
