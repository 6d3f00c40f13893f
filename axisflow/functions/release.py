"""Expressions for public release fields: coarse families, splits, keyed digests, integrity hashes."""

from __future__ import annotations

import hashlib
import hmac

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from axisflow.functions.host import ustrip

# Fixed values of the public release.
PUBLIC_FIELDS = "public_row_id released_artifact released_canonical_artifact source_family time_bucket split label evidence_tier sink_family obfuscation_family released_length_bucket character_class_mask ccd_outputs row_integrity_hash".split()
FORBIDDEN_FIELDS = "CDB CREATED_TIME ORIGINAL_CREATED_TIME SOURCE_FILE SOURCE_ROW_NUMBER dedup_hostname_id exact_timestamp private_mapping_key raw_canonical_hostname raw_hostname raw_tenant_id stable_hostname_hash stable_tenant_time_series_id tenant_surrogate unique_host_hash".split()
RESERVED_SUFFIXES = ("test", "invalid", "example", "localhost")
DOCUMENTATION_PREFIXES = ("192.0.2.", "198.51.100.", "203.0.113.")
WITHHELD = "withheld"
QUERY_SYNTAX = r"\b(select|union|pg_sleep|waitfor|benchmark|dbms_pipe)\b|--|/\*"
SHELL_SYNTAX = r"[`;&|]|\$\("
SHELL_WORDS = r"\b(curl|wget|nslookup|ping|bash|sh|cmd|powershell)\b"


def source_family(family: Column, content_type: Column) -> Column:
    f, t = F.lower(ustrip(F.coalesce(family, F.lit("")))), F.upper(ustrip(F.coalesce(content_type, F.lit(""))))
    return F.when((f == "user_logins") | (t == "USERNAME"), "login_host").when((f == "dns_hostnames") | (t == "HOSTNAME"), "dns_host").otherwise("other_coarse_source")


def label(resolved: Column) -> Column:
    c = F.upper(ustrip(F.coalesce(resolved, F.lit(""))))
    return F.when(c == "M", "verified_executable_semantics").when(c == "B", "resolved_benign").otherwise("unresolved")


def sink_family(value: Column) -> Column:
    """The first that fits of template, query, shell and url_fetch."""
    low = F.lower(value)
    return (
        F.when(low.contains("${jndi") | low.contains("${#") | value.contains("{{"), "template")
        .when(low.rlike(QUERY_SYNTAX), "query")
        .when(value.rlike(SHELL_SYNTAX) | low.rlike(SHELL_WORDS), "shell")
        .when(low.rlike("https?://"), "url_fetch")
        .otherwise("none")
    )


def evidence_tier(label_: Column, sink: Column) -> Column:
    return (
        F.when(label_ == "resolved_benign", "none").when(sink.isin("shell", "template", "query"), "sink_evaluated")
        .when(sink == "url_fetch", "artifact_supported").when(label_ != "unresolved", "syntax_only").otherwise("none")
    )


def obfuscation_family(value: Column) -> Column:
    """The one detector that fires, 'mixed' for several, 'none' for none."""
    fired = F.array_compact(
        F.array(
            F.when(value.contains("%"), F.lit("percent")),
            F.when(value.rlike(r"[^\x00-\x7F]"), F.lit("unicode")),
            F.when(value.rlike("[\"'`;|&]"), F.lit("delimiter")),
            F.when(value.rlike("[A-Za-z0-9+/]{16,}={0,2}"), F.lit("base64")),
            F.when(value.contains("--") | value.contains("/*"), F.lit("quote_comment")),
        )
    )
    return F.when(F.size(fired) > 1, "mixed").when(F.size(fired) == 1, fired[0]).otherwise("none")


def public_obfuscation(value: Column) -> Column:
    return F.when(obfuscation_family(value) == "none", "none").otherwise("present")


def public_sink(label_: Column, sink: Column, evidence: Column) -> Column:
    return F.when(_hidden(label_, sink, evidence), "none").otherwise(sink)


def public_evidence(label_: Column, sink: Column, evidence: Column) -> Column:
    return F.when(_hidden(label_, sink, evidence), "syntax_only").otherwise(evidence)


def _hidden(label_: Column, sink: Column, evidence: Column) -> Column:
    return (label_ == "verified_executable_semantics") & (sink == "url_fetch") & (evidence == "artifact_supported")


def bucket(value: Column, n: int) -> Column:
    """A stable bucket by the first 32 bits of SHA-256."""
    return (F.conv(F.substring(F.sha2(value, 256), 1, 8), 16, 10).cast("long") % n).cast("int")


def hash_split(public_id: Column) -> Column:
    """train, validation, calibration, test: 70, 10, 10 and 10 percent."""
    u = F.conv(F.substring(F.sha2(public_id, 256), 1, 8), 16, 10).cast("double") / F.lit(4294967295.0)
    return F.when(u < 0.70, "train").when(u < 0.80, "validation").when(u < 0.90, "calibration").otherwise("test")


def hmac_hex(secret: str, message: Column) -> Column:
    """HMAC-SHA256 as an expression. The pads stand in the plan as literals: for test keys; production jobs use `hmac_udf`."""
    key = secret.encode()
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = bytes(b ^ 0x36 for b in key), bytes(b ^ 0x5C for b in key)
    first = F.unhex(F.sha2(F.concat(F.lit(inner), F.encode(message, "UTF-8")), 256))
    return F.sha2(F.concat(F.lit(outer), first), 256)


def hmac_udf(spark, secret: str):
    """HMAC-SHA256 with the secret in a broadcast, so that it never shows in a plan."""
    shared = spark.sparkContext.broadcast(secret.encode())

    @F.pandas_udf("string")
    def digest(messages: pd.Series) -> pd.Series:
        return messages.map(lambda m: None if m is None else hmac.new(shared.value, m.encode(), "sha256").hexdigest())

    return digest


def base32_prefix(hex_digest: Column, length: int) -> Column:
    """The first `length` characters (a multiple of 4) of the base32 form: 5 hex digits are 4 characters."""
    parts = []
    for at in range(0, length, 4):
        n = F.conv(F.substring(hex_digest, at // 4 * 5 + 1, 5), 16, 10).cast("long")
        parts += [F.substring(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"), (F.shiftright(n, shift).bitwiseAND(31) + 1).cast("int"), F.lit(1)) for shift in (15, 10, 5, 0)]
    return F.concat(*parts)


def public_row_id(row_id: Column, secret: str, version: str) -> Column:
    return F.concat(F.lit("row_"), base32_prefix(hmac_hex(secret, F.concat(F.lit(f"{version}|"), row_id)), 20))


def unique_tag(row_id: Column, secret: str, version: str, length: int = 8) -> Column:
    digest = hmac_hex(secret, F.concat(F.lit(f"{version}|"), row_id, F.lit("|unique")))
    byte = lambda i: F.conv(F.substring(digest, 2 * i + 1, 2), 16, 10).cast("int")
    return F.concat(*(F.substring(F.lit("abcdefghijklmnopqrstuvwxyz"), byte(i) % 26 + 1, F.lit(1)) for i in range(length)))


def integrity_hash(columns: list[str]) -> Column:
    """SHA-256 of the row as JSON with sorted keys and nulls kept."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


def private_row_id(row_id: Column, other: Column, ordinal: Column) -> Column:
    return F.coalesce(F.nullif(row_id, F.lit("")), F.nullif(other, F.lit("")), F.format_string("row-%012d", ordinal))


def first_nonempty(*columns: Column) -> Column:
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in columns), F.lit(""))


def optional_double(*columns: Column) -> Column:
    """The first that is a finite number."""
    def one(c: Column) -> Column:
        x = F.nullif(ustrip(c), F.lit("")).try_cast("double")
        return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)

    return F.coalesce(*(one(c) for c in columns))


def optional_bool(*columns: Column) -> Column:
    def one(c: Column) -> Column:
        x = F.lower(ustrip(c))
        return F.when(x.isin("true", "1", "yes", "y"), True).when(x.isin("false", "0", "no", "n"), False)

    return F.coalesce(*(one(c) for c in columns))


def calibration_group(*columns: Column) -> Column:
    """The first that is set; an unsafe or identifying one is an error."""
    value = F.coalesce(*(F.nullif(ustrip(c), F.lit("")) for c in columns))
    unsafe = ~value.rlike(r"^[A-Za-z0-9_.:-]{1,64}$") | value.rlike("(?i)(tenant|customer|corp|internal|private|cdb)")
    return F.when(unsafe, F.raise_error(F.concat(F.lit("unsafe public calibration group: "), value))).otherwise(value)


def nearest_suffix(label_: Column) -> Column:
    """The reserved suffix of the most similar length; of equals, the shortest, then the first."""
    options = [F.struct(F.abs(F.char_length(label_) - len(s)).alias("d"), F.lit(len(s)).alias("n"), F.lit(i).alias("i"), F.lit(s).alias("s")) for i, s in enumerate(RESERVED_SUFFIXES)]
    return F.array_min(F.array(*options))["s"]


def slug(value: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(ustrip(value)), "[^a-z0-9_.:-]+", "_"), r"^[_.:-]+|[_.:-]+$", "")
