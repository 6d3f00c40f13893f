"""Privacy and utility audits of a public release: scanners, linkability, sparseness, preservation, shortcuts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from axisflow.functions import host as H
from axisflow.functions import release as R

# What the scanners look for.
EMAIL = r"(?U)[\w.+-]+@[\w.-]+\.[A-Za-z]{2,}"
SECRET = r"(?i)(bearer\s+[A-Za-z0-9._-]{12,}|\beyJ[A-Za-z0-9_-]{20,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\b|(?:secret|token)[_-][A-Za-z0-9]{24,})"
INTERNAL = r"(?i)\.(corp|internal|local|lan|svc|cluster)(?:\.|$)"
CALLBACK = r"(?i)(oast\.(?:fun|online|me)|bxss\.me|interact\.sh|burpcollaborator\.net)"
UNSAFE = r"(?i)(oast\.(?:fun|online|me)|bxss\.me|burpcollaborator|/bin/sh\s+-c|powershell\s+-enc)"
INTENT = r"(?i)(hack|hacker|hacked|malicious|evil|attack|attacker|exploit|pwn|pwned|phish|phishing|malware|virus|ransom|trojan|botnet|backdoor|rootkit)"
GUID = r"(?i)\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\b"
IPV4 = r"\b(?:\d{1,3}\.){3}\d{1,3}\b"
DOMAIN = r"\b[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?)+\b"
DELIMITERS = ".-_$`;&|<>(){}[]'\"/%"
ROW_SCANNERS = {"email_like": EMAIL, "secret_like": SECRET, "internal_suffix": INTERNAL, "live_callback": CALLBACK, "unsafe_payload": UNSAFE, "intent_signal": INTENT, "guid_like": GUID}
FINGERPRINT = ("released_length_bucket", "character_class_mask", "source_family", "label", "sink_family", "obfuscation_family")
COMBINATION = ("time_bucket", "source_family", "label", "evidence_tier", "sink_family")


def found(value: Column, pattern: str) -> Column:
    return F.regexp_extract_all(value, F.lit(pattern), F.lit(0))


def foreign_ips(value: Column) -> Column:
    """IPv4 addresses outside the documentation ranges."""
    ok = lambda x: F.substring_index(x, ".", 3).isin(*(p.rstrip(".") for p in R.DOCUMENTATION_PREFIXES))
    return F.size(F.filter(found(value, IPV4), lambda x: ~ok(x)))


def domains(value: Column) -> Column:
    return F.filter(found(value, DOMAIN), lambda x: ~H.is_ipv4_like(x))


def reserved_domains(value: Column) -> Column:
    return F.filter(domains(value), lambda x: F.lower(F.substring_index(x, ".", -1)).isin(*R.RESERVED_SUFFIXES))


def scans(rows: DataFrame, artifact: str = "released_artifact", canonical: str | None = "released_canonical_artifact") -> DataFrame:
    """One row of scanner counts, in one pass."""
    a = F.col(artifact)
    ips = foreign_ips(a) + (foreign_ips(F.col(canonical)) if canonical else F.lit(0))
    return rows.agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum(ips).alias("foreign_ips"), *(F.count_if(a.rlike(p)).alias(k) for k, p in ROW_SCANNERS.items()),
        F.sum(F.size(domains(a))).alias("domain_like"), F.sum(F.size(reserved_domains(a))).alias("reserved_domain_like"),
    )


def scanner_coverage(rows: DataFrame) -> DataFrame:
    """Status of each scanner, by its count."""
    s = scans(rows)
    status = lambda c: F.struct(F.when(c == 0, "pass").otherwise("fail").alias("status"), c.alias("n_findings"))
    live = F.col("domain_like") - F.col("reserved_domain_like")
    return s.select("n_rows", *(status(F.col(k)).alias(k) for k in ("foreign_ips", *ROW_SCANNERS)), F.struct(F.when(live == 0, "pass").otherwise("fail").alias("status"), live.alias("n_findings")).alias("public_dns_policy"))


def excess_duplicates(rows: DataFrame, column: str) -> DataFrame:
    return rows.select(F.coalesce(F.col(column), F.lit("")).alias("v")).groupBy("v").count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("excess"))


def intersection_count(public: DataFrame, private: DataFrame, public_col: str, private_col: str) -> DataFrame:
    """Public rows whose value is a private one, with multiplicity."""
    return public.select(F.col(public_col).alias("v")).join(private.select(F.col(private_col).alias("v")).distinct(), "v", "left_semi").agg(F.count(F.lit(1)).alias("matches"))


def sparse(rows: DataFrame, columns: tuple[str, ...] = COMBINATION, min_k: int = 50) -> DataFrame:
    """Combinations that fewer than `min_k` rows have."""
    return rows.groupBy(*columns).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") < min_k)


def linkable_groups(joined: DataFrame, raw: str = "raw_canonical", artifact: str = "released_artifact", canonical: str = "released_canonical_artifact", fingerprint: tuple[str, ...] = FINGERPRINT, min_k: int = 50) -> DataFrame:
    """Groups of rows of one private artifact: how many repeat a public value inside, and how many have a rare fingerprint."""
    counts = joined.groupBy(*fingerprint).agg(F.count(F.lit(1)).alias("_fp"))
    counts = counts.withColumnsRenamed({c: f"_k{i}" for i, c in enumerate(fingerprint)})
    same = joined.join(counts, [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(fingerprint)])
    groups = same.filter(F.col(raw) != "").groupBy(raw).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(artifact).alias("a"), F.count_distinct(canonical).alias("c"), F.min("_fp").alias("fp")).filter("n > 1")
    return groups.agg(F.count(F.lit(1)).alias("duplicate_groups"), F.count_if(F.col("a") < F.col("n")).alias("artifact_groups"), F.count_if(F.col("c") < F.col("n")).alias("canonical_groups"), F.count_if(F.col("fp") < min_k).alias("rare_groups"))


def occurrences(value: Column, c: str) -> Column:
    return F.char_length(value) - F.char_length(F.replace(value, F.lit(c), F.lit("")))


def preservation(joined: DataFrame, raw: str, released: str) -> DataFrame:
    """Shares of rows of which label count, delimiters, encodings and length bucket stayed."""
    a, b = F.col(raw), F.col(released)
    same = sum((F.when(occurrences(a, d) == occurrences(b, d), 1).otherwise(0) for d in DELIMITERS), F.lit(0))
    encoded = (a.contains("%") == b.contains("%")) & (F.lower(a).contains("xn--") == F.lower(b).contains("xn--"))
    share = lambda c: F.coalesce(F.avg(c.cast("int")), F.lit(0.0))
    return joined.agg(
        share(H.label_count(a) == H.label_count(b)).alias("dns_labels"), F.coalesce(F.sum(same) / F.count(F.lit(1)) / len(DELIMITERS), F.lit(0.0)).alias("delimiters"),
        share(encoded).alias("encoding"), share(H.length_bucket(a) == H.length_bucket(b)).alias("shape"),
    )


def shortcut(rows: DataFrame, features: tuple[str, ...], label: str = "label", allowed: float = 0.05) -> DataFrame:
    """Whether fields that the rewriting made give the label away: the purest group against the majority."""
    by_label = rows.groupBy(label).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("top"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("labels"))
    pure = rows.groupBy(*features, label).agg(F.count(F.lit(1)).alias("n")).groupBy(*features).agg((F.max("n") / F.sum("n")).alias("p")).agg(F.max("p").alias("max_purity"))
    out = by_label.crossJoin(pure).withColumn("majority_rate", F.col("top") / F.col("n"))  # one row each
    delta = F.greatest(F.col("max_purity") - F.col("majority_rate"), F.lit(0.0))
    one = F.col("labels") < 2
    return out.select(F.col("n").alias("n_rows"), F.when(~one, F.col("max_purity")).alias("max_purity"), "majority_rate", F.when(~one, 0.5 + F.least(delta, F.lit(0.5))).alias("auroc_estimate"), F.when(one | (delta <= allowed), "pass").otherwise("review").alias("status"))


def verified(public: DataFrame, expected: DataFrame) -> DataFrame:
    """One row of what public rows lack or change against the expected ones, with duplicate ids reduced first."""
    once = lambda df: df.groupBy("public_row_id").agg(*(F.max(c).alias(c) for c in ("label", "released_artifact", "released_canonical_artifact", "row_integrity_hash")))
    e, p = once(expected), once(public).withColumnsRenamed({c: f"p_{c}" for c in ("label", "released_artifact", "released_canonical_artifact", "row_integrity_hash")}).withColumn("there", F.lit(True))
    j = e.join(p, "public_row_id", "left")
    differs = lambda c: F.count_if(F.col("there") & ~F.col(c).eqNullSafe(F.col(f"p_{c}")))
    dup = public.groupBy("public_row_id").count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("duplicate_ids"), F.coalesce(F.sum("count"), F.lit(0)).alias("n_public"))
    return j.agg(F.count(F.lit(1)).alias("n_expected"), F.count_if("there").alias("n_matched"), F.count_if(F.col("there").isNull()).alias("missing_rows"), differs("label").alias("label_mismatches"), differs("released_artifact").alias("artifact_mismatches"), differs("released_canonical_artifact").alias("canonical_mismatches"), differs("row_integrity_hash").alias("integrity_failures")).crossJoin(dup).withColumn("unmatched_rows", F.greatest(F.col("n_public") - F.col("n_matched"), F.lit(0)))
