"""Cone sketches: the nearest of many unit axes to a vector, with softmax weights.

Two plans for one result: `sketch_sql` joins vectors and axes and ranks them, `sketch` multiplies Arrow
batches with the broadcast axes. The axes are a model parameter of fixed size; its size is checked.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from axisflow.functions.vectors import dot
from axisflow.operators.storage import cut

AXES_BOUND = 256 << 20


def random_axes(spark: SparkSession, cones: int, dim: int, seed: int = 13) -> DataFrame:
    """cone, axis: unit vectors from a seeded normal distribution."""
    a = np.random.default_rng(seed).standard_normal((cones, dim)).astype(np.float32)
    a /= np.maximum(np.linalg.norm(a, axis=1, keepdims=True), 1e-12)
    return spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(a)], "cone int, axis array<float>")


def size_of(axes: DataFrame) -> tuple[int, int]:
    """How many axes, and of how many elements."""
    n, dim = axes.agg(F.count(F.lit(1)), F.max(F.size("axis"))).first()
    return n, dim or 0


def similarities(vectors: DataFrame, axes: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """Every vector with every axis, a product that is the definition of exact search; axes within `AXES_BOUND` are broadcast."""
    n, dim = size_of(axes)
    if 8 * n * dim > AXES_BOUND:
        raise ValueError(f"{n} axes of {dim} elements are over {AXES_BOUND} bytes; search them with nearest_exact or nearest_with_lsh")
    return vectors.join(F.broadcast(axes)).select(id_col, "cone", dot(F.col(vector_col), F.col("axis")).alias("sim"))


def best_axes(pairs: DataFrame, r: int, id_col: str) -> DataFrame:
    ranked = Window.partitionBy(id_col).orderBy(F.desc("sim"), "cone")
    return pairs.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= r)


def nearest_exact(vectors: DataFrame, axes: DataFrame, r: int = 8, id_col: str = "vec_id", vector_col: str = "embedding", bound: int | None = None) -> DataFrame:
    """id, cone, sim, rank of the r nearest among all axes, however many: in blocks within the bound, of each of which the r nearest go on."""
    n, dim = size_of(axes)
    blocks = max(1, -(-8 * n * dim // (bound or AXES_BOUND)))
    out = None
    for k in range(blocks):
        block = axes.filter(F.pmod(F.xxhash64("cone"), F.lit(blocks)) == k) if blocks > 1 else axes
        pairs = vectors.join(F.broadcast(block)).select(id_col, "cone", dot(F.col(vector_col), F.col("axis")).alias("sim"))
        pairs = best_axes(pairs, r, id_col).drop("rank") if blocks > 1 else pairs
        out = pairs if out is None else out.unionByName(pairs)
    return best_axes(out, r, id_col)


def sketch_sql(vectors: DataFrame, axes: DataFrame, r: int = 8, temperature: float = 10.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id, cone, sim, weight of the r nearest axes of every vector; of equally near ones the smaller cone."""
    top = best_axes(similarities(vectors, axes, id_col, vector_col), r, id_col)
    of_id = Window.partitionBy(id_col)
    e = F.exp(temperature * (F.col("sim") - F.max("sim").over(of_id)))
    return top.withColumn("_e", e).withColumn("weight", F.col("_e") / F.sum("_e").over(of_id)).drop("_e")


def sketch(vectors: DataFrame, axes: DataFrame, r: int = 8, temperature: float = 10.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The same as `sketch_sql`, as one row a vector: id, sketch (cone, sim, weight), by matrix products."""
    n, dim = size_of(axes)
    if 8 * n * dim > AXES_BOUND:
        raise ValueError(f"{n} axes of {dim} elements are over {AXES_BOUND} bytes; use nearest_exact or nearest_with_lsh")
    table = axes.orderBy("cone").toArrow()
    matrix = np.array(table.column("axis").to_pylist(), np.float64)
    cones = table.column("cone").to_numpy().astype(np.int32)
    shared = vectors.sparkSession.sparkContext.broadcast(matrix)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sims = matrix_of(batch.column(1)) @ shared.value.T
            order = np.argsort(-sims, axis=1, kind="stable")[:, :r]
            near = np.take_along_axis(sims, order, axis=1)
            e = np.exp(temperature * (near - near[:, :1]))
            w = e / e.sum(axis=1, keepdims=True)
            parts = pa.StructArray.from_arrays([pa.array(x.ravel()) for x in (cones[order], near, w)], names=["cone", "sim", "weight"])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(order) + 1, dtype=np.int32) * order.shape[1]), parts)
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=[id_col, "sketch"])

    kind = vectors.schema[id_col].dataType.simpleString()
    return vectors.select(id_col, F.col(vector_col).alias("_v")).mapInArrow(run, f"{id_col} {kind}, sketch array<struct<cone:int,sim:double,weight:double>>")


def matrix_of(lists: pa.Array) -> np.ndarray:
    """A row for each list; they are of one length and without nulls."""
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.float64).reshape(len(lists), -1) if len(lists) else np.zeros((0, 1))


def exploded(sketches: DataFrame, id_col: str = "vec_id") -> DataFrame:
    return sketches.select(id_col, F.explode("sketch").alias("s")).select(id_col, "s.cone", "s.sim", "s.weight")


def lsh_candidates(vectors: DataFrame, axes: DataFrame, tables: int = 8, bits: int = 12, radius: int = 1, seed: int = 13, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id, cone: axes in a bucket of the vector or within `radius` bits of it, by sign hashes of random planes, as equi joins."""
    dim = size_of(axes)[1]
    planes = vectors.sparkSession.sparkContext.broadcast(np.random.default_rng(seed).standard_normal((tables * bits, dim)))

    @F.pandas_udf("array<int>")
    def codes(v: pd.Series) -> pd.Series:
        if not len(v):
            return pd.Series([], dtype=object)
        side = (np.stack(v.to_numpy()).astype(np.float64) @ planes.value.T >= 0).reshape(len(v), tables, bits)
        return pd.Series(list((side << np.arange(bits)).sum(axis=2).astype(np.int32)))

    hashed = lambda df, key, vector: df.select(key, F.posexplode(codes(F.col(vector))).alias("table", "code"))
    masks = [sum(1 << i for i in some) for n in range(radius + 1) for some in combinations(range(bits), n)]
    probes = hashed(vectors, id_col, vector_col).withColumn("mask", F.explode(F.lit(masks)))
    probes = probes.select(id_col, "table", F.col("code").bitwiseXOR(F.col("mask")).alias("code"))
    return probes.join(hashed(axes, "cone", "axis"), ["table", "code"]).select(id_col, "cone").distinct()


def nearest_with_lsh(vectors: DataFrame, axes: DataFrame, r: int = 8, id_col: str = "vec_id", vector_col: str = "embedding", bound: int | None = None, **lsh) -> DataFrame:
    """The r nearest among the candidates; vectors with fewer than r candidates are compared with all axes, in blocks within the bound."""
    found = lsh_candidates(vectors, axes, id_col=id_col, vector_col=vector_col, **lsh)
    enough = cut(found.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(id_col))).filter(F.col("n") >= r).select(id_col, "cone"), "candidates")
    near = enough.join(vectors, id_col).join(axes, "cone").select(id_col, "cone", dot(F.col(vector_col), F.col("axis")).alias("sim"))
    rest = nearest_exact(vectors.join(enough.select(id_col).distinct(), id_col, "left_anti"), axes, r, id_col, vector_col, bound).drop("rank")
    return best_axes(near.unionByName(rest), r, id_col)
