"""Priors over cones and likelihood-ratio scores of sketches against them.

Long forms throughout: a sketch is (id, cone, weight), a prior (family, cone, p, log_p); the benign prior
has the family null.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from axisflow.functions.vectors import stable_log
from axisflow.operators.sketch import AXES_BOUND, matrix_of, size_of


def priors(sketches: DataFrame, cones: DataFrame, by: str | None = None, smoothing: float = 1e-6) -> DataFrame:
    """Smoothed share of sketch weight on every cone, overall or for each value of `by`."""
    keys = [by] if by else []
    mass = sketches.groupBy(*keys, "cone").agg(F.sum("weight").alias("mass"))
    total = sketches.groupBy(*keys).agg(F.sum("weight").alias("total"))
    m = cones.select(F.count(F.lit(1)).alias("m"))
    spine = cones.select("cone").join(F.broadcast(m)).join(total)  # one row; then cones x families, the size of the prior itself
    p = (F.coalesce("mass", F.lit(0.0)) + smoothing) / (F.col("total") + smoothing * F.col("m"))
    out = spine.join(mass, [*keys, "cone"], "left").withColumn("p", p)
    return out.select(*keys, "cone", "p", stable_log(F.col("p")).alias("log_p"))


def mixture_weights(families: DataFrame, weights: Mapping[str, float] | None = None) -> DataFrame:
    """family, log_weight: uniform, or the given weights, which must name exactly the families and are made to sum to 1."""
    if weights is None:
        return families.select("family", (-F.ln(F.count(F.lit(1)).over(Window.partitionBy()))).alias("log_weight"))
    known = families.select("family").distinct()
    lacking = [r["family"] for r in known.filter(~F.col("family").isin(*weights)).limit(20).collect()]
    unknown = set(weights) - {r["family"] for r in known.filter(F.col("family").isin(*weights)).collect()}  # no more than weights
    if lacking or unknown:
        raise ValueError(f"weights lack {sorted(lacking)} and have unknown {sorted(unknown)}")
    if any(w <= 0 for w in weights.values()):
        raise ValueError("weights must be positive")
    total = sum(weights.values())
    given = families.sparkSession.createDataFrame([(k, float(w) / total) for k, w in weights.items()], "family string, w double")
    return given.select("family", F.ln("w").alias("log_weight"))



def cross_entropies(sketches: DataFrame, prior: DataFrame, id_col: str = "vec_id", by: str | None = None) -> DataFrame:
    """-sum(weight * log p) of each sketch, overall or for each family."""
    keys = [id_col, by] if by else [id_col]
    return sketches.join(prior, "cone").groupBy(*keys).agg((-F.sum(F.col("weight") * F.col("log_p"))).alias("h"))


def scores(sketches: DataFrame, benign: DataFrame, malicious: DataFrame, mixture: DataFrame, effective_count: float = 1.0, id_col: str = "vec_id") -> DataFrame:
    """id, score: log-sum-exp over families of log weight + effective_count * (H_benign - H_family).

    The difference of the cross entropies is one weighted sum of log ratios, so priors meet once, at their
    own size, and sketches are joined and summed once.
    """
    ratios = malicious.join(benign.select("cone", F.col("log_p").alias("_benign")), "cone").select("cone", "family", (F.col("log_p") - F.col("_benign")).alias("_ratio"))
    sums = sketches.join(ratios, "cone").groupBy(id_col, "family").agg(F.sum(F.col("weight") * F.col("_ratio")).alias("_sum"))
    terms = sums.join(mixture, "family").groupBy(id_col).agg(F.collect_list(F.col("log_weight") + effective_count * F.col("_sum")).alias("_x"))
    top = F.array_max("_x")
    return terms.select(id_col, (top + F.ln(F.aggregate("_x", F.lit(0.0), lambda a, x: a + F.exp(x - top)))).alias("score"))


RATIOS_BOUND = 256 << 20


def batch_scores(vectors: DataFrame, axes: DataFrame, benign: DataFrame, malicious: DataFrame, mixture: DataFrame, r: int = 8, temperature: float = 10.0, effective_count: float = 1.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id, score straight from vectors: sketch and mixture in one Arrow pass over each batch, nothing is shuffled.

    Axes and the log ratios of all cones and families are broadcast; `fits_in_batches` says whether their checked sizes allow it.
    """
    if not fits_in_batches(axes, malicious):
        raise ValueError("axes or priors are too large to broadcast; use sketch and scores")
    ratios = malicious.join(benign.select("cone", F.col("log_p").alias("_benign")), "cone").join(mixture, "family")
    found = ratios.select("family", "cone", (F.col("log_p") - F.col("_benign")).alias("ratio"), "log_weight").orderBy("family", "cone").toArrow()
    table = axes.orderBy("cone").toArrow()
    cones, n = table.column("cone").to_numpy(), len(table)
    ratio, weight = (found.column(c).to_numpy().reshape(-1, n) for c in ("ratio", "log_weight"))
    if n and len(found) and (found.column("cone").to_numpy().reshape(-1, n) != cones).any():
        raise ValueError("priors and axes have different cones")
    shared = vectors.sparkSession.sparkContext.broadcast((np.array(table.column("axis").to_pylist(), np.float64), np.ascontiguousarray(ratio.T), weight[:, 0]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix, ratio, weight = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                sims = matrix_of(part.column(1)) @ matrix.T
                order = np.argsort(-sims, axis=1, kind="stable")[:, :r]
                near = np.take_along_axis(sims, order, axis=1)
                e = np.exp(temperature * (near - near[:, :1]))
                x = weight + effective_count * np.einsum("nr,nrf->nf", e / e.sum(axis=1, keepdims=True), ratio[order])
                top = x.max(axis=1)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(top + np.log(np.exp(x - top[:, None]).sum(axis=1)))], names=[id_col, "score"])

    kind = vectors.schema[id_col].dataType.simpleString()
    return vectors.select(id_col, F.col(vector_col).alias("_v")).mapInArrow(run, f"{id_col} {kind}, score double")


def fits_in_batches(axes: DataFrame, malicious: DataFrame) -> bool:
    n, dim = size_of(axes)
    return 8 * n * dim <= AXES_BOUND and 16 * malicious.count() <= RATIOS_BOUND


def cone_scores(benign: DataFrame, malicious: DataFrame, mixture: DataFrame, effective_count: float = 1.0) -> DataFrame:
    """cone, score of a sketch that lies on that cone alone: the table of the fast path."""
    term = malicious.select("family", "cone", F.col("log_p").alias("lf")).join(benign.select("cone", F.col("log_p").alias("lb")), "cone").join(mixture, "family")
    term = term.withColumn("x", F.col("log_weight") + effective_count * (F.col("lf") - F.col("lb")))
    top = F.max("x").over(Window.partitionBy("cone"))
    return term.withColumn("top", top).groupBy("cone").agg((F.max("top") + F.ln(F.sum(F.exp(F.col("x") - F.col("top"))))).alias("score"))


def fast_scores(sketches: DataFrame, table: DataFrame, id_col: str = "vec_id") -> DataFrame:
    """Scores by the nearest cone alone."""
    best = sketches.groupBy(id_col).agg(F.min_by("cone", F.struct(-F.col("sim"), F.col("cone"))).alias("cone"))
    return best.join(table, "cone").select(id_col, "score")


def l1_delta(a: DataFrame, b: DataFrame) -> DataFrame:
    x, y = a.select("cone", F.col("p").alias("pa")), b.select("cone", F.col("p").alias("pb"))
    return x.join(y, "cone").agg(F.sum(F.abs(F.col("pa") - F.col("pb"))).alias("l1_delta"))


def log_ratio_envelope(benign: DataFrame, malicious: DataFrame) -> DataFrame:
    """The largest absolute log ratio of any family's prior to the benign one."""
    b = benign.select("cone", F.col("log_p").alias("lb"))
    return malicious.join(b, "cone").agg(F.max(F.abs(F.col("log_p") - F.col("lb"))).alias("envelope"))


def explanations(sketches: DataFrame, benign: DataFrame, malicious: DataFrame, top: int = 3, id_col: str = "vec_id") -> DataFrame:
    """The heaviest cones of each sketch with benign and best and worst family logs."""
    ranked = sketches.withColumn("rank", F.row_number().over(Window.partitionBy(id_col).orderBy(F.desc("weight"), "cone"))).filter(F.col("rank") <= top)
    by_cone = malicious.groupBy("cone").agg(
        F.max_by("family", F.struct("log_p", F.col("family"))).alias("best_family"), F.max("log_p").alias("best_log_p"), F.min_by("family", F.struct("log_p", F.col("family"))).alias("least_family"), F.min("log_p").alias("least_log_p"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("family", "log_p")))).alias("family_log_p"),
    )
    joined = ranked.join(benign.select("cone", F.col("log_p").alias("benign_log_p")), "cone").join(by_cone, "cone")
    return joined.select(id_col, "rank", "cone", "sim", "weight", "benign_log_p", "best_family", (F.col("best_log_p") - F.col("benign_log_p")).alias("best_log_ratio"), "least_family", (F.col("least_log_p") - F.col("benign_log_p")).alias("least_log_ratio"), "family_log_p")


def margins(similarity: DataFrame, id_col: str = "vec_id", edit_bound: float = 0.05) -> DataFrame:
    """Distance between the two nearest prototypes, and how many edits of at most `edit_bound` it withstands."""
    ranked = similarity.withColumn("r", F.row_number().over(Window.partitionBy(id_col).orderBy(F.desc("sim"), "cone"))).filter("r <= 2")
    both = ranked.groupBy(id_col).agg((F.max(F.when(F.col("r") == 1, F.col("sim"))) - F.max(F.when(F.col("r") == 2, F.col("sim")))).alias("margin"))
    return both.withColumn("radius", F.floor(F.col("margin") / (2 * edit_bound)))
