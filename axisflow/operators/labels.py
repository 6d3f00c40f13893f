"""Resolution of annotated benchmark rows: labels, families, splits, selection, statistics.

The names of the annotator columns are parameters; a policy names which of them decides.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from axisflow.functions.host import ustrip
from axisflow.functions.release import slug

POLICIES = ("resolved", "resolved-or-disagree-malicious", "first-only", "second-only", "any-malicious-else-benign", "both-disagree-malicious", "both-disagree-benign", "both-disagree-unknown")
#: Names of policies after the annotators, in the order of the columns.
ALIASES = {"gpt-5.5-only": "first-only", "opus-4.8-only": "second-only", "sonnet-only": "first-only", "opus-only": "second-only"}
FAMILY_GROUPS = {"both": ("user_logins", "dns_hostnames")}


def letter(value: Column) -> Column:
    """B or M by the first letter, else U."""
    v = F.upper(ustrip(F.coalesce(value, F.lit(""))))
    return F.when(v.startswith("B"), "B").when(v.startswith("M"), "M").otherwise("U")


def as_int(label: Column, unknown: int = -1) -> Column:
    v = letter(label)
    return F.when(v == "B", 0).when(v == "M", 1).otherwise(unknown)


def _agreed(a: Column, b: Column, fallback: str) -> Column:
    other = F.lit("U") if fallback == "U" else F.when((a == fallback) | (b == fallback), fallback).otherwise("U")
    return F.when(a == b, a).otherwise(other)


def resolved_label(policy: str, resolved: Column, first: Column, second: Column) -> Column:
    r, a, b = letter(resolved), letter(first), letter(second)
    policy = ALIASES.get(policy, policy)
    if policy == "resolved":
        return r
    if policy == "resolved-or-disagree-malicious":
        return F.when(ustrip(F.coalesce(resolved, F.lit(""))) != "", r).otherwise(_agreed(a, b, "M"))
    if policy == "first-only":
        return a
    if policy == "second-only":
        return b
    if policy == "any-malicious-else-benign":
        return F.when((a == "M") | (b == "M"), "M").otherwise("B")
    if policy.startswith("both-disagree-"):
        return _agreed(a, b, {"malicious": "M", "benign": "B", "unknown": "U"}[policy.removeprefix("both-disagree-")])
    raise ValueError(f"unknown policy {policy!r}; one of {', '.join(POLICIES)}")


def positive_family(columns: Sequence[Column], default: str = "positive", stops: Sequence[str] = ("", "none", "unknown", "nan", "null")) -> Column:
    """The first usable slug among the columns."""
    usable = lambda c: F.when(~slug(c).isin(*stops), slug(c))
    return F.coalesce(*(usable(c) for c in columns), F.lit(default))


def row_split(columns: Sequence[Column]) -> Column:
    return F.coalesce(*(F.nullif(F.lower(ustrip(c)), F.lit("")) for c in columns), F.lit(""))


def text_field(family: Column, username: Column, hostname: Column) -> Column:
    return F.when(family == "user_logins", username).otherwise(hostname)


def families(name: str | Sequence[str]) -> list[str]:
    names = [name] if isinstance(name, str) else list(name)
    return list(dict.fromkeys(x for n in names for x in FAMILY_GROUPS.get(n, (n,))))


def select_rows(df: DataFrame, label: Column, split: Column | None = None, splits: Sequence[str] | None = None, drop_unknown: bool = True, max_rows: int | None = None, order: Sequence[str] = ()) -> DataFrame:
    """Labelled rows of the allowed splits; `max_rows` of them in the given order."""
    if splits is not None:
        if not splits:
            raise ValueError("no split is allowed")
        df = df.filter(split.isin(*(s.strip().lower() for s in splits)))
    df = df.withColumn("label", label)
    df = df.filter("label <> 'U'") if drop_unknown else df
    return df.orderBy(*order).limit(max_rows) if max_rows is not None else df


def items(df: DataFrame, family: Column, username: Column, hostname: Column, label: Column, metadata: Sequence[str] = (), transform: Callable[[Column], Column] | None = None, target_transform: Callable[[Column], Column] | None = None) -> DataFrame:
    """text, label, target and, where named, metadata of each row: the dataset's items. The hooks change text and target."""
    text, target = text_field(family, username, hostname), as_int(label)
    return df.select((transform(text) if transform else text).alias("text"), letter(label).alias("label"), (target_transform(target) if target_transform else target).alias("target"), *([F.struct(*metadata).alias("metadata")] if metadata else []))


def label_counts(df: DataFrame, label: str = "label") -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("rows"))


def require_both_classes(df: DataFrame, label: str = "label") -> None:
    """An error unless benign and malicious rows are there."""
    row = df.agg(F.count_if(F.col(label) == "B").alias("b"), F.count_if(F.col(label) == "M").alias("m")).first()
    if not row["b"] or not row["m"]:
        raise ValueError(f"both classes are needed: {row['b']} benign and {row['m']} malicious rows")


def orbits(df: DataFrame, batch: Sequence[str], family: str, order: str, malicious: str) -> DataFrame:
    """Adds `orbit`: a dense number of each malicious family of a batch by first appearance; benign rows get own negative ones."""
    from pyspark.sql import Window

    whole = Window.partitionBy(*batch, malicious, family)
    first = df.withColumn("_first", F.min(order).over(whole))
    by_batch = Window.partitionBy(*batch, malicious)
    dense = F.dense_rank().over(by_batch.orderBy("_first")) - 1
    benign = -F.row_number().over(by_batch.orderBy(order))
    return first.withColumn("orbit", F.when(F.col(malicious), dense).otherwise(benign)).drop("_first")
