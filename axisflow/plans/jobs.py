"""Release jobs: private CSV files to a public release, its verification, its metrics, and inputs for the model.

    python -m axisflow.plans.jobs anonymize --private FOLDER --out FOLDER --config FILE
    python -m axisflow.plans.jobs verify --private FOLDER --release FOLDER --out FILE --config FILE
    python -m axisflow.plans.jobs metrics --release FOLDER --out FILE
    python -m axisflow.plans.jobs export --release FOLDER --out FOLDER
    python -m axisflow.plans.jobs repair --release FOLDER --out FOLDER

Releases are folders of JSON lines. Only counts and one-row results come to the driver.
"""

from __future__ import annotations

import argparse
import json
from collections.abc import Mapping
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from axisflow.functions import host as H
from axisflow.functions import release as R
from axisflow.operators import audit, calibration, metrics
from axisflow.operators.release import Secrets, public_rows, repaired, require_public_schema, shuffled
from axisflow.operators.storage import cut
from axisflow.plans.reports import histogram, stage_manifests
from axisflow.sources.text import numbered

SECRET_KEYS = {"row_id_secret": "row_id", "artifact_secret": "artifact", "shuffle_secret": "order"}
OUTPUTS = T.StructType([T.StructField("ccd_score_bin", T.StringType()), T.StructField("ccd_flag", T.BooleanType()), T.StructField("ccd_score_public", T.DoubleType()), T.StructField("public_calibration_group", T.StringType())])
RELEASE = T.StructType([T.StructField(c, OUTPUTS if c == "ccd_outputs" else T.StringType()) for c in R.PUBLIC_FIELDS])


def load_secrets(path: str | None = None, **given: str | None) -> Secrets:
    """Keys from arguments, else from a file: JSON, or lines of `key: value` with # comments. All three keys are needed."""
    found: dict[str, str] = {}
    if path:
        text = Path(path).read_text(encoding="utf-8")
        try:
            found = {str(k): str(v) for k, v in json.loads(text).items()}
        except json.JSONDecodeError:
            pairs = (line.split(":", 1) for line in text.splitlines() if ":" in line and not line.lstrip().startswith("#"))
            found = {k.strip(): v.strip().strip("'\"") for k, v in pairs}
    found |= {k: v for k, v in given.items() if v}
    if missing := [k for k in SECRET_KEYS if not found.get(k)]:
        raise ValueError(f"secrets are missing: {', '.join(missing)}")
    return Secrets(**{field: found[k] for k, field in SECRET_KEYS.items()}, version=found.get("release_version", "v1"))


def read_private(spark: SparkSession, path: str) -> DataFrame:
    """All-string rows of a CSV file or of all .csv files of a folder, with `ord`, their number in order of files and lines.

    Each file has a header of its own; columns that a file lacks are null. Bytes that are no UTF-8 become U+FFFD.
    """
    quoted = {"header": True, "quote": '"', "escape": '"', "multiLine": True, "pathGlobFilter": "*.csv"}
    first = spark.read.option("pathGlobFilter", "*.csv").text(path).select(F.col("_metadata.file_path").alias("file"), "value", F.struct("_metadata.file_block_start", F.monotonically_increasing_id()).alias("at"))
    headers = first.groupBy("file").agg(F.min_by("value", "at").alias("header")).groupBy("header").agg(F.collect_list("file").alias("files")).collect()
    if not headers:
        raise ValueError(f"{path} has no CSV file with a header")
    parts = []
    for row in sorted(headers, key=lambda r: min(r["files"])):  # a few kinds of header, each with any number of files
        part = spark.read.options(**quoted).csv(row["files"])
        part = part.withColumn("ord", F.struct(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at")))
        parts.append(part.select(*(c if c == "ord" else F.col(f"`{c}`").cast("string") for c in part.columns)))
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part, allowMissingColumns=True)
    return numbered(whole).drop("ord").withColumnRenamed("n", "ord")


def write_release(rows: DataFrame, path: str) -> None:
    """JSON lines with sorted keys; outputs that are null are left out."""
    inner = rows.withColumn("ccd_outputs", F.struct(*(F.col(f"ccd_outputs.{c}").alias(c) for c in sorted(OUTPUTS.names))))
    inner.select(F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "true"}).alias("value")).write.text(path)


def read_release(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RELEASE).option("mode", "FAILFAST").json(path)


def anonymize(spark: SparkSession, private: str, out: str, secrets: Secrets, audit_dir: str | None = None, buckets: int = 512) -> dict[str, Any]:
    """The public release of private CSV files in keyed order; returns its manifest. With `audit_dir`, stage manifests and the schema go there."""
    rows = cut(public_rows(read_private(spark, private), secrets), "public")
    require_public_schema(rows)
    write_release(shuffled(rows, secrets, buckets=buckets), out)
    manifest = {"release_version": secrets.version, "n_public_rows": rows.count(), "fields": R.PUBLIC_FIELDS, "by_label": histogram(rows, "label"), "by_source_family": histogram(rows, "source_family"), "private_input_hash": "withheld", "approvals": {k: "pending" for k in ("security", "privacy", "legal_or_data_owner")}}
    if audit_dir:
        folder = Path(audit_dir)
        stage_manifests(rows, folder, secrets.version)
        (folder / "release_manifest.json").write_text(json.dumps(manifest, indent=2, sort_keys=True))
    return manifest


def zero(value: int | None) -> str:
    return "pass" if not value else "fail"


def verification(spark: SparkSession, private: str, release: str, secrets: Secrets, min_k: int = 50) -> dict[str, Any]:
    """All checks of a release against the private rows it is of, as one document with a status for each section and in all."""
    source = read_private(spark, private)
    public, expected = read_release(spark, release).persist(), cut(public_rows(source, secrets), "expected")
    col = lambda n: F.col(n) if n in source.columns else F.lit(None).cast("string")
    hashed = R.hmac_udf(spark, secrets.row_id)
    raw = source.select(R.private_row_id(col("ROW_ID"), col("private_row_id"), F.col("ord")).alias("row_id"), R.first_nonempty(col("CONTENT"), col("HOSTNAME"), col("USERNAME")).alias("raw"))
    raw = raw.select(F.concat(F.lit("row_"), R.base32_prefix(hashed(F.concat(F.lit(f"{secrets.version}|"), "row_id")), 20)).alias("public_row_id"), "raw", H.canonical(F.col("raw")).alias("raw_canonical"))
    joined = cut(public.join(raw, "public_row_id"), "joined")
    one = lambda df: df.first().asDict(recursive=True)
    rows, scans, linkage = one(audit.verified(public, expected)), one(audit.scanner_coverage(public)), one(audit.linkable_groups(joined, min_k=min_k))
    kept = one(audit.preservation(joined, "raw", "released_artifact"))
    repeats = {c: one(audit.excess_duplicates(public, c))["excess"] for c in ("released_artifact", "released_canonical_artifact")}
    raw_matches = {k: one(audit.intersection_count(public, raw, p, r))["matches"] for k, p, r in (("artifact", "released_artifact", "raw"), ("canonical", "released_canonical_artifact", "raw_canonical"))}
    combinations = one(public.groupBy(*audit.COMBINATION).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.min("n"), F.lit(0)).alias("min_k"), F.count_if(F.col("n") < min_k).alias("sparse")))
    shortcut = one(audit.shortcut(public, ("released_length_bucket", "character_class_mask", "obfuscation_family")))
    forbidden = sorted(set(spark.read.json(release).columns) & set(R.FORBIDDEN_FIELDS))
    public.unpersist()
    sections = {
        "rows": {**rows, "status": zero(sum(rows[k] or 0 for k in ("missing_rows", "unmatched_rows", "duplicate_ids", "label_mismatches", "artifact_mismatches", "canonical_mismatches", "integrity_failures")))},
        "privacy": {"forbidden_fields": forbidden, "raw_matches": raw_matches, "scanners": scans, "status": zero(len(forbidden) + sum(raw_matches.values()) + sum(v["status"] == "fail" for v in scans.values() if isinstance(v, dict)))},
        "uniqueness": {"excess_values": repeats, "status": zero(sum(repeats.values()))},
        "access_patterns": {**combinations, "status": zero(combinations["sparse"])},
        "structural_fingerprints": {**linkage, "status": zero(linkage["artifact_groups"] + linkage["canonical_groups"] + linkage["rare_groups"])},
        "utility": {"preservation": kept, "status": "pass"},
        "shortcut": shortcut,
    }
    needed = ("rows", "privacy", "uniqueness", "access_patterns", "structural_fingerprints")
    return {"release_version": secrets.version, "sections": sections, "status": "pass" if all(sections[k]["status"] == "pass" for k in needed) else "fail"}


def metrics_document(spark: SparkSession, release: str, alpha: float = 1e-4, score_keys=metrics.SCORE_KEYS, group_keys=metrics.GROUP_KEYS) -> dict[str, Any]:
    """Counts, calibration, fixed-FPR replay by recomputed scores and by released flags, and sources of the effective flag."""
    rows = metrics.from_json(spark.read.text(release).filter(F.trim("value") != ""), "value", score_keys, group_keys)
    rows = cut(metrics.with_score_flag(rows, alpha), "metrics")
    benign = rows.filter((F.col("split") == "calibration") & (F.col("label") == metrics.NEGATIVE) & F.col("score").isNotNull())
    overall = calibration.thresholds(benign, alpha).first()
    few = calibration.thresholds(benign.filter("calibration_group is not null"), alpha, "calibration_group").orderBy("calibration_group").limit(10_001).collect()
    if len(few) > 10_000:
        raise ValueError("over 10,000 calibration groups are no document")
    grouped = {r["calibration_group"]: {"threshold": r["threshold"], "order_statistic_rank": r["rank"], "order_statistic_sample_count": r["num_samples"]} for r in few}
    counts: dict[str, dict[str, int]] = {}
    for r in metrics.breakdown(rows, ("split", "source_family", "label", "evidence_tier", "sink_family", "score_bin", "effective_source")).limit(10_001).collect():
        counts.setdefault(r["dimension"], {})[str(r["value"])] = r["rows"]
    told = {k: metrics.confusion(rows, k).first().asDict() for k in ("score_flag", "flag")}
    source = "grouped_scores" if grouped else "scores" if overall else "none"
    calibrated = {"alpha": alpha, "threshold": overall["threshold"] if overall else None, "order_statistic_rank": overall["rank"] if overall else None, "order_statistic_sample_count": overall["num_samples"] if overall else 0, "grouped_thresholds": grouped, "threshold_source": source, "score_fields_considered": list(score_keys), "calibration_group_fields_considered": list(group_keys)}
    return {
        "counts": counts, "label_accounting": metrics.accounting(rows).first().asDict(), "calibration": calibrated,
        "fixed_fpr_replay": {"status": "available" if overall or grouped else "not_available", "requested_fpr": alpha, "threshold": None if grouped or not overall else overall["threshold"], **told["score_flag"]}, "released_flag_replay": told["flag"],
    }


def routes() -> dict[str, tuple[Column, list[Column], bool]]:
    """For each output of the export: which rows, what of them, and whether the release must have such rows."""
    split, label, group = F.col("split"), F.col("label"), F.coalesce(F.trim("ccd_outputs.public_calibration_group"), F.lit(""))
    benign, bad = label == metrics.NEGATIVE, label == metrics.POSITIVE
    artifact, query = F.col("released_artifact").alias("hostname"), split.isin("test", "validation") & (label != metrics.UNRESOLVED)
    family = F.coalesce(F.nullif(R.slug(F.col("sink_family")), F.lit("")), F.lit("positive")).alias("family")
    calibrated, recent = (split == "calibration") & benign, (split == "validation") & benign
    return {
        "benign": ((split == "train") & benign, [artifact], True), "malicious": ((split == "train") & bad, [artifact, family], True),
        "benign_calibration": (calibrated, [artifact], True), "benign_calibration_groups": (calibrated & (group != ""), [group.alias("group")], False),
        "queries": (query, [artifact], True), "query_groups": (query & (group != ""), [group.alias("group")], False), "query_labels": (query, [F.col("public_row_id"), split, label, F.col("source_family"), artifact], True),
        "recent_benign_window": (recent, [artifact], False), "recent_benign_window_groups": (recent & (group != ""), [group.alias("group")], False),
    }


def export(spark: SparkSession, release: str, out: str) -> dict[str, Any]:
    """Nine routed outputs for training, calibration, queries and refreshes, and their manifest; all counts come from one pass.

    Missing rows of a required output, or groups that only some rows of an output have, are an error before anything
    is written. Hosts and groups of an output lie in the same order, over part files of the same numbers.
    """
    rows, plan = cut(read_release(spark, release), "release"), routes()
    made = rows.agg(F.count(F.lit(1)).alias("rows"), *(F.count_if(test).alias(k) for k, (test, *_) in plan.items()), F.count_if(plan["queries"][0] & (F.col("label") == metrics.POSITIVE)).alias("_bad"), F.count_if(plan["queries"][0] & (F.col("label") == metrics.NEGATIVE)).alias("_good")).first().asDict()
    if empty := [k for k, (*_, needed) in plan.items() if needed and not made[k]] + [k for k, n in (("malicious queries", "_bad"), ("benign queries", "_good")) if not made[n]]:
        raise ValueError(f"the release has no rows for {', '.join(empty)}")
    for k in ("benign_calibration", "queries", "recent_benign_window"):
        groups = made["query_groups" if k == "queries" else f"{k}_groups"]
        if groups not in (0, made[k]):
            raise ValueError(f"{groups} of {made[k]} rows of {k} have a calibration group")
    for k, (test, columns, _) in plan.items():
        if made[k]:
            some = rows.filter(test).select(*columns)
            some.write.text(f"{out}/{k}") if len(columns) == 1 else some.write.option("header", True).csv(f"{out}/{k}")
    summary = {
        "counts": {"rows": made["rows"], "by_split": histogram(rows, "split"), "by_label": histogram(rows, "label"), "query_labels_by_label": {metrics.POSITIVE: made["_bad"], metrics.NEGATIVE: made["_good"]}}, "files": {k: made[k] for k in plan if made[k]},
        "policy": {"released_artifact_used": True, "row_multiplicity_preserved": True, "unresolved_rows_excluded_from_training_and_queries": True, "malicious_family_source": "sink_family"},
    }
    spark.createDataFrame([(json.dumps(summary, indent=2, sort_keys=True),)], "value string").coalesce(1).write.text(f"{out}/manifest")
    return summary


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="axisflow-release")
    sub = p.add_subparsers(dest="command", required=True)
    for name, needs in {"anonymize": ("private", "out"), "verify": ("private", "release", "out"), "metrics": ("release", "out"), "export": ("release", "out"), "repair": ("release", "out")}.items():
        s = sub.add_parser(name)
        for x in needs:
            s.add_argument(f"--{x}", required=True)
        if "private" in needs:
            s.add_argument("--config")
            s.add_argument("--audit-dir")
            s.add_argument("--min-k", type=int, default=50)
            for k in SECRET_KEYS:
                s.add_argument(f"--{k.replace('_', '-')}")
        s.add_argument("--alpha", type=float, default=1e-4)
    a = p.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    secrets = load_secrets(a.config, **{k: getattr(a, k) for k in SECRET_KEYS}) if "config" in a else None
    told: Mapping[str, Any] | None = None
    if a.command == "anonymize":
        print(json.dumps(anonymize(spark, a.private, a.out, secrets, a.audit_dir), sort_keys=True))
    elif a.command == "verify":
        told = verification(spark, a.private, a.release, secrets, a.min_k)
    elif a.command == "metrics":
        told = metrics_document(spark, a.release, a.alpha)
    elif a.command == "export":
        print(json.dumps(export(spark, a.release, a.out), sort_keys=True))
    else:
        write_release(repaired(read_release(spark, a.release)), a.out)
    if told is not None:
        Path(a.out).write_text(json.dumps(told, indent=2, sort_keys=True, default=str) + "\n", encoding="utf-8")
        if told.get("status") == "fail":
            raise SystemExit(1)


if __name__ == "__main__":
    main()
