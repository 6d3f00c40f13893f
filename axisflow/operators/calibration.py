"""Split-conformal thresholds: exact order statistics, overall and by group, and decisions by them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from axisflow.operators.storage import cut


def rank_of(n: Column, alpha: float) -> Column:
    """ceil((1 - alpha)(n + 1)), between 1 and n, in double."""
    r = F.ceil(F.lit(1.0 - alpha) * (n.cast("double") + F.lit(1.0)))
    return F.greatest(F.lit(1).cast("long"), F.least(r, n))


def finite(score: str) -> Column:
    """The score as a double; null, NaN and infinite ones are an error."""
    x = F.col(score).cast("double")
    wrong = x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.when(wrong, F.raise_error(F.lit("scores must be finite")).cast("double")).otherwise(x)


QUANTILES = 1000  # the sketch's rank error of 1 in 10,000 is well below a step


def thresholds(scores: DataFrame, alpha: float, group: str | None = None, score: str = "score", small: int = 1_000_000) -> DataFrame:
    """threshold, num_samples and rank, overall or of every group; without scores there is no row.

    The order statistic is found without sorting a group in one task: mergeable quantile sketches narrow
    the range that holds the rank, about a thousandfold a round and whatever the distribution, until it
    has at most `small` rows or one value; exact counts say where in it the rank lies. Scores that are
    null, NaN or infinite are an error.
    """
    keys = [group] if group else []
    data = scores.select(*keys, finite(score).alias("_s"))
    state = data.groupBy(*keys).agg(F.count(F.lit(1)).alias("num_samples"), F.min("_s").alias("_lo"), F.max("_s").alias("_hi")).filter("num_samples > 0")
    state = state.withColumn("rank", rank_of(F.col("num_samples"), alpha)).withColumn("_at", F.col("rank")).withColumn("_n", F.col("num_samples"))
    state = cut(state, "threshold-state")
    is_open = (F.col("_n") > small) & (F.col("_lo") < F.col("_hi"))
    while not state.filter(is_open).isEmpty():
        inside = _joined(data, state.filter(is_open), keys).filter("_s between _lo and _hi")
        steps = F.percentile_approx("_s", [k / QUANTILES for k in range(QUANTILES + 1)], 10_000)
        sketched = inside.groupBy(*keys).agg(steps.alias("_q"), F.first("_at").alias("_due"), F.count(F.lit(1)).alias("_all"))
        step = lambda shift: F.element_at("_q", F.greatest(F.lit(1), F.least(F.lit(QUANTILES + 1), F.floor(F.col("_due") / F.col("_all") * QUANTILES).cast("int") + shift)))
        narrow = cut(sketched.select(*keys, step(0).alias("_a"), step(3).alias("_b")), "threshold-range")
        found = _joined(inside, narrow, keys).groupBy(*keys, "num_samples", "rank", "_at", "_n", "_lo", "_hi", "_a", "_b").agg(F.count_if(F.col("_s") < F.col("_a")).alias("_below"), F.count_if(F.col("_s").between(F.col("_a"), F.col("_b"))).alias("_within"))
        hit = (F.col("_at") > F.col("_below")) & (F.col("_at") <= F.col("_below") + F.col("_within"))
        checked = F.when(hit, F.col("_at") - F.col("_below")).otherwise(F.raise_error(F.lit("a quantile sketch missed its bounds")).cast("long"))
        closer = found.select(*keys, "num_samples", F.col("_a").alias("_lo"), F.col("_b").alias("_hi"), "rank", checked.alias("_at"), F.col("_within").alias("_n"))
        state = cut(state.filter(~is_open).unionByName(closer), "threshold-state")
    same = state.filter("_lo = _hi").select(*keys, F.col("_lo").alias("threshold"), "num_samples", "rank")
    some = _joined(data, state.filter("_lo < _hi"), keys).filter("_s between _lo and _hi")
    ranked = some.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy("_s"))).filter("_r = _at")
    return same.unionByName(ranked.select(*keys, F.col("_s").alias("threshold"), "num_samples", "rank"))


def _joined(big: DataFrame, small: DataFrame, keys: list[str]) -> DataFrame:
    """An inner join on keys that may be null; `small` has a row or a few for each group."""
    named = small.withColumnsRenamed({k: f"_k{i}" for i, k in enumerate(keys)})
    test = F.lit(True)
    for i, k in enumerate(keys):
        test = test & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return big.join(named, test).drop(*(f"_k{i}" for i in range(len(keys))))


def metadata(thresholds_: DataFrame, alpha: float) -> DataFrame:
    return thresholds_.withColumn("alpha", F.lit(alpha)).withColumn("rule", F.lit("ceil((1-alpha)*(n+1)) clipped to [1,n]"))


def p_values(scores: DataFrame, benign: DataFrame, score: str = "score") -> DataFrame:
    """(1 + benign scores at least as high) / (n + 1) for each row; 1 without benign scores. Non-finite scores are an error.

    Counts are kept by distinct score, which combines equal ones before they move. These are sorted by
    range partitions, once, into a table with the number of the partition; what lies above a score is then
    the sum of whole partitions and a running sum within one, and no task sees all rows.
    """
    each = benign.select(finite(score).alias("_s"), F.lit(1).alias("_b")).unionByName(scores.select(finite(score).alias("_s"), F.lit(0).alias("_b")))
    counts = each.groupBy("_s").agg(F.sum("_b").alias("_b"))
    ranged = cut(counts.repartitionByRange(F.desc("_s")).withColumn("_part", F.spark_partition_id()), "ranged")
    parts = ranged.groupBy("_part").agg(F.sum("_b").alias("_n"))
    total = parts.agg(F.sum("_n")).first()[0] or 0
    before = parts.withColumn("_before", F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).select("_part", "_before")  # a row a partition
    above = F.sum("_b").over(Window.partitionBy("_part").orderBy(F.desc("_s")).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    known = ranged.withColumn("_above", above).join(before, "_part").select("_s", ((1 + F.col("_above") + F.col("_before")) / F.lit(total + 1.0)).alias("p_value"))
    return scores.withColumn("_s", finite(score)).join(known, "_s").select(*scores.columns, "p_value")


def decided(scores: DataFrame, grouped: DataFrame | None, default: float | None, group: str = "calibration_group", score: str = "score") -> DataFrame:
    """Adds threshold and prediction (score above it). Rows of groups without threshold take the default; without one they are an error."""
    if grouped is None:
        out = scores.withColumn("threshold", F.lit(default).cast("double"))
    else:
        out = scores.join(grouped.select(group, "threshold"), group, "left")
        missing = F.raise_error(F.concat(F.lit("no threshold for group "), F.coalesce(F.col(group), F.lit("null")))).cast("double") if default is None else F.lit(float(default))
        out = out.withColumn("threshold", F.coalesce("threshold", missing))
    return out.withColumn("prediction", (F.col(score) > F.col("threshold")).cast("int"))
