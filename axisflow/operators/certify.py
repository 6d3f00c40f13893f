"""Stability certificates: margin bounds, enumeration of an edit ball, randomized smoothing."""

from __future__ import annotations

import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from axisflow.operators.edits import edit_ball


def margin_certified(score: Column, threshold: Column, delta: Column) -> Column:
    """A positive decision needs a margin above delta, a negative one a margin of at least delta."""
    return F.when(score > threshold, score - threshold > delta).otherwise(threshold - score >= delta)


def margin_delta(effective_count: float, envelope: Column, lipschitz: float, bound: float) -> Column:
    return F.lit(effective_count) * envelope * F.lit(lipschitz) * F.lit(bound)


def with_margin_certificate(df: DataFrame, delta: Column, radius: int) -> DataFrame:
    """score, threshold -> prediction, margin, certified, for `radius` edits of at most delta each."""
    total = delta * radius
    margin = F.abs(F.col("score") - F.col("threshold"))
    return df.withColumn("prediction", F.col("score") > F.col("threshold")).withColumn("margin", margin).withColumn("certified", margin_certified(F.col("score"), F.col("threshold"), total))


def certify_by_enumeration(hosts: DataFrame, score: Callable[[DataFrame], DataFrame], threshold: float, radius: int = 1, max_nodes: int = 10_000, edits=None) -> DataFrame:
    """For each host: whether all its neighbours keep its decision, how many were checked until the first that
    does not (in order), and the largest score movement until then. `score` maps (host) rows to (host, score)."""
    ball = edit_ball(hosts.select("host").distinct(), radius, max_nodes, edits)
    scored = score(ball.select(F.col("neighbor").alias("host")).distinct()).select(F.col("host").alias("neighbor"), "score")
    joined = ball.join(scored, "neighbor")
    own = joined.filter("neighbor = host").select("host", F.col("score").alias("own"))
    rest = joined.join(own, "host").filter("neighbor <> host").withColumn("flip", (F.col("score") > threshold) != (F.col("own") > threshold))
    ordered = Window.partitionBy("host").orderBy("neighbor")
    rest = rest.withColumn("at", F.row_number().over(ordered)).withColumn("movement", F.max(F.abs(F.col("score") - F.col("own"))).over(ordered))
    ends = rest.groupBy("host").agg(F.min(F.when(F.col("flip"), F.col("at"))).alias("first"), F.max("at").alias("last"))
    stop = F.coalesce("first", "last")
    at_end = rest.join(ends, "host").filter(F.col("at") == stop).select("host", "movement", F.col("at").alias("checked"), F.when(F.col("flip"), F.col("neighbor")).alias("counterexample"))
    out = own.join(at_end, "host", "left")
    return out.select("host", F.col("own").alias("score"), (F.col("own") > threshold).alias("prediction"), F.col("counterexample").isNull().alias("certified"), F.coalesce("checked", F.lit(0)).alias("checked"), F.coalesce("movement", F.lit(0.0)).alias("max_movement"), "counterexample")


def combined(hosts: DataFrame, score: Callable[[DataFrame], DataFrame], threshold: float, delta: float, radius: int = 1, **more) -> DataFrame:
    """Margins first; only rows they leave open are enumerated."""
    scored = score(hosts.select("host").distinct()).withColumn("threshold", F.lit(threshold))
    by_margin = with_margin_certificate(scored, F.lit(delta), radius)
    sure = by_margin.filter("certified").select("host", "score", "prediction", "certified", F.lit("margin").alias("method"))
    rest = certify_by_enumeration(by_margin.filter("not certified").select("host"), score, threshold, radius, **more)
    return sure.unionByName(rest.select("host", "score", "prediction", "certified", F.lit("enumeration").alias("method")))


def wilson(k: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    p, z2 = k / n, z * z
    mid = (p + z2 / (2 * n)) / (1 + z2 / n)
    half = z / (1 + z2 / n) * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n))
    return F.greatest(mid - half, F.lit(0.0)), F.least(mid + half, F.lit(1.0))


def _beta_cdf(x: float, a: float, b: float) -> float:
    """Regularized incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_cdf(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), 1e-300)
    f = d
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + num * d or 1e-300)
            c = 1 + num / c or 1e-300
            f *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * f


def clopper_pearson(k: int, n: int, alpha: float = 0.05) -> tuple[float, float]:
    """The exact binomial interval, by bisection of the beta distribution."""
    def quantile(q: float, a: float, b: float) -> float:
        lo, hi = 0.0, 1.0
        for _ in range(100):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if _beta_cdf(mid, a, b) < q else (lo, mid)
        return (lo + hi) / 2

    return (0.0 if k == 0 else quantile(alpha / 2, k, n - k + 1)), (1.0 if k == n else quantile(1 - alpha / 2, k + 1, n - k))


def smoothed(samples: DataFrame, id_col: str, prediction: str, alpha: float = 0.05) -> DataFrame:
    """Majority vote of the predictions on random edits of each row, with exact bounds on its share."""
    @F.pandas_udf("struct<low:double,high:double>")
    def bounds(k: pd.Series, n: pd.Series) -> pd.DataFrame:
        known = {pair: clopper_pearson(*pair, alpha) for pair in set(zip(k.tolist(), n.tolist()))}  # once for each pair of a batch
        return pd.DataFrame([known[pair] for pair in zip(k.tolist(), n.tolist())], columns=["low", "high"])

    votes = samples.groupBy(id_col, prediction).agg(F.count(F.lit(1)).alias("votes"))
    ranked = votes.withColumn("r", F.row_number().over(Window.partitionBy(id_col).orderBy(F.desc("votes"), prediction)))
    out = ranked.groupBy(id_col).agg(F.sum("votes").alias("n"), F.max_by(prediction, -F.col("r")).alias("prediction"), F.max("votes").alias("top"), F.coalesce(F.max(F.when(F.col("r") == 2, F.col("votes"))), F.lit(0)).alias("second"))
    return out.withColumn("b", bounds("top", "n")).select("*", F.col("b.low").alias("low"), F.col("b.high").alias("high"), (F.col("b.low") > 0.5).alias("certified")).drop("b")
