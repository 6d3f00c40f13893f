"""Replay of release metrics: label accounting, fixed-FPR thresholds, confusion counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from axisflow.operators.calibration import thresholds

POSITIVE, NEGATIVE, UNRESOLVED = "verified_executable_semantics", "resolved_benign", "unresolved"
SCORE_KEYS = ("ccd_score_public", "ccd_score", "score")
GROUP_KEYS = ("public_calibration_group", "calibration_group")


def from_json(lines: DataFrame, column: str = "value", score_keys=SCORE_KEYS, group_keys=GROUP_KEYS) -> DataFrame:
    """Rows of a release from JSON text, with score, group and flag by precedence of keys.

    A JSON boolean is no score and a JSON number is no flag, as VARIANT types tell.
    """
    v = lines.select(F.parse_json(column).alias("v"))
    kind = lambda path: F.schema_of_variant(F.try_variant_get("v", path, "variant"))
    text = lambda path: F.try_variant_get("v", path, "string")
    paths = lambda keys: [p for k in keys for p in (f"$.ccd_outputs.{k}", f"$.{k}")]

    def number(path: str) -> Column:
        x = F.try_variant_get("v", path, "double")
        return F.when((kind(path) != "BOOLEAN") & ~F.isnan(x) & (F.abs(x) != float("inf")), x)

    flag_text = F.lower(F.trim(text("$.ccd_outputs.ccd_flag")))
    flag = F.when(kind("$.ccd_outputs.ccd_flag").isin("BOOLEAN", "STRING"), F.when(flag_text.isin("true", "1", "yes"), True).when(flag_text.isin("false", "0", "no"), False))
    return v.select(
        *(text(f"$.{k}").alias(k) for k in ("split", "label", "source_family", "evidence_tier", "sink_family")), text("$.ccd_outputs.ccd_score_bin").alias("score_bin"),
        F.coalesce(*(number(p) for p in paths(score_keys))).alias("score"), F.coalesce(*(F.nullif(F.trim(text(p)), F.lit("")) for p in paths(group_keys))).alias("calibration_group"), flag.alias("flag"),
    )


def with_score_flag(rows: DataFrame, alpha: float = 1e-4) -> DataFrame:
    """Adds threshold, score_flag, and the effective flag with its source. Groups without threshold take the global one."""
    benign = rows.filter((F.col("split") == "calibration") & (F.col("label") == NEGATIVE) & F.col("score").isNotNull())
    overall = thresholds(benign, alpha).select(F.col("threshold").alias("_global"))
    grouped = thresholds(benign.filter("calibration_group is not null"), alpha, "calibration_group").select("calibration_group", F.col("threshold").alias("_own"))
    out = rows.join(grouped, "calibration_group", "left").join(F.broadcast(overall), how="left")  # one row at most
    out = out.withColumn("threshold", F.coalesce("_own", "_global")).drop("_own", "_global").withColumn("score_flag", F.col("score") > F.col("threshold"))
    source = F.when(F.col("flag").isNotNull(), "released").when(F.col("score_flag").isNotNull(), "score").otherwise("none")
    return out.withColumn("effective_flag", F.coalesce("flag", "score_flag")).withColumn("effective_source", source)


def confusion(rows: DataFrame, flag: str) -> DataFrame:
    """TP, FN, FP, TN, TPR and FPR over resolved rows outside the calibration split that have a flag."""
    used = rows.filter((F.col("split") != "calibration") & F.col(flag).isNotNull())
    pos, neg, hit = F.col("label") == POSITIVE, F.col("label") == NEGATIVE, F.col(flag)
    out = used.agg(F.count_if(pos & hit).alias("tp"), F.count_if(pos & ~hit).alias("fn"), F.count_if(neg & hit).alias("fp"), F.count_if(neg & ~hit).alias("tn"))
    return out.withColumn("tpr", F.try_divide("tp", F.col("tp") + F.col("fn"))).withColumn("fpr", F.try_divide("fp", F.col("fp") + F.col("tn")))


def accounting(rows: DataFrame) -> DataFrame:
    pos, neg, cal = F.col("label") == POSITIVE, F.col("label") == NEGATIVE, F.col("split") == "calibration"
    return rows.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("label") == UNRESOLVED).alias("unresolved_rows"), F.count_if(F.col("label") != UNRESOLVED).alias("resolved_rows"), F.count_if(pos).alias("positive_rows"), F.count_if(neg).alias("negative_rows"),
        F.count_if((pos | neg) & ~cal).alias("metric_rows"), F.count_if(neg & cal).alias("benign_calibration_rows"), F.count_if(neg & cal & F.col("score").isNotNull()).alias("scored_benign_calibration_rows"),
    )


def breakdown(rows: DataFrame, columns=("split", "source_family", "label", "evidence_tier", "sink_family")) -> DataFrame:
    """Counts by each column, all in one aggregation over grouping sets."""
    which = F.coalesce(*(F.when(F.grouping(c) == 0, F.lit(c)) for c in columns)).alias("dimension")
    cols = [F.col(c) for c in columns]
    grouped = rows.groupingSets([[c] for c in cols], *cols).agg(which, F.count(F.lit(1)).alias("rows"))
    return grouped.select("dimension", F.coalesce(*columns).alias("value"), "rows")
