"""Commands over the model: python -m axisflow.plans.cli COMMAND ..."""

from __future__ import annotations

import argparse
import json
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from axisflow.functions.encode import with_hash_embedding
from axisflow.functions.host import normalized
from axisflow.operators.certify import certify_by_enumeration
from axisflow.operators.storage import cut
from axisflow.plans.model import Config, Model
from axisflow.sources.text import read_labelled_csv, read_lines, read_parallel, write_scores


def embedded(df: DataFrame, dim: int, host: str = "hostname", **switches) -> DataFrame:
    """vec_id and embedding of each row's normalized host; `switches` are those of `normalized`, and `normalize`."""
    wanted = switches.pop("normalize", True)
    text = normalized(F.col(host), **switches) if wanted else F.coalesce(F.col(host), F.lit(""))
    return with_hash_embedding(df.withColumn("host", text), "host", dim).withColumn("vec_id", F.monotonically_increasing_id())


COMMANDS = {"train-priors": ("benign", "malicious"), "calibrate": ("hosts",), "score": ("hosts", "out"), "explain": ("hosts", "out"), "refresh-benign": ("hosts",), "certify": ("hosts", "out"), "embed": ("hosts", "out")}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="axisflow")
    sub = p.add_subparsers(dest="command", required=True)
    for name, needs in COMMANDS.items():
        s = sub.add_parser(name)
        s.add_argument("--model", required=name != "embed")
        for x in needs:
            s.add_argument(f"--{x}", required=True)
        s.add_argument("--groups", help="a file with the calibration group of each host, line by line")
        s.add_argument("--approximate", type=int, help="score by so many nearest cones")
        s.add_argument("--missing-group", choices=("default", "error"), default="default")
        s.add_argument("--top", type=int, default=3)
        s.add_argument("--format", choices=("csv", "parquet"), default="csv")
        s.add_argument("--alpha", type=float)
        s.add_argument("--cones", type=int, default=4096)
        s.add_argument("--dim", type=int, default=384)
        s.add_argument("--radius", type=int, default=1)
        s.add_argument("--drop-groups", action="store_true")
        s.add_argument("--no-normalize", action="store_true")
        s.add_argument("--no-percent-decode", action="store_true")
        s.add_argument("--no-idna", action="store_true")
        s.add_argument("--unicode-form", choices=("NFC", "NFD", "NFKC", "NFKD"), default="NFKC")
    return p


def write_embeddings(rows: DataFrame, dim: int, path: str, kind: str = "csv") -> None:
    """hostname, e0, e1, ... with six decimals as CSV, or hostname and the whole vector as Parquet."""
    if kind == "parquet":
        rows.select("hostname", "embedding").write.parquet(path)
        return
    six = [F.format_string("%.6f", F.col("embedding")[i].cast("double")).alias(f"e{i}") for i in range(dim)]
    rows.select("hostname", *six).write.option("header", True).csv(path)


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    how = {"normalize": not a.no_normalize, "unicode_form": a.unicode_form, "decode_percent": not a.no_percent_decode, "idna_roundtrip": not a.no_idna}
    named = lambda df: df.select(F.col("value").alias("hostname"))
    if a.command == "train-priors":
        benign = embedded(named(read_lines(spark, a.benign)), a.dim, **how)
        config = Config(dim=a.dim, cones=a.cones, **({"alpha": a.alpha} if a.alpha is not None else {}))
        Model.fit(benign, embedded(read_labelled_csv(spark, a.malicious), a.dim, **how), config).save(a.model)
        return
    hosts = read_parallel(spark, a.hosts, a.groups).withColumnRenamed("value", "hostname") if a.groups else named(read_lines(spark, a.hosts))
    if a.command == "embed":
        write_embeddings(embedded(hosts, a.dim, **how), a.dim, a.out, a.format)
        return
    model, group = Model.load(spark, a.model), "calibration_group" if a.groups else None
    if a.alpha is not None:
        model = replace(model, config=replace(model.config, alpha=a.alpha))
    rows = cut(embedded(hosts, model.config.dim, **how), "hosts")
    about = rows.select("vec_id", "hostname", *([group] if group else []))
    scored = lambda: model.score(rows, a.approximate).join(about, "vec_id")
    if a.command == "calibrate":
        model.calibrate(scored(), group).save(a.model)
    elif a.command == "refresh-benign":
        new, report = model.refresh(rows, group=group, drop_groups=a.drop_groups, approximate=a.approximate)
        new.save(a.model)
        print(json.dumps(report, sort_keys=True))
    elif a.command == "explain":
        model.explain(rows, a.top).join(about, "vec_id").write.json(a.out)
    elif a.command == "score":
        if model.groups is not None and not group:
            raise SystemExit("the model has group thresholds: give the groups of the hosts with --groups")
        decided = replace(model, groups=model.groups if group else None).predict(scored(), a.missing_group == "default")
        write_scores(decided, a.out, threshold=True, group=group)
    else:
        def score(df: DataFrame) -> DataFrame:
            e = embedded(df.withColumn("hostname", F.col("host")), model.config.dim, "host", **how)
            return model.score(e, a.approximate).join(e.select("vec_id", F.col("hostname").alias("host")), "vec_id").select("host", "score")

        if model.threshold is None:
            raise SystemExit("the model is not calibrated")
        certify_by_enumeration(hosts.select(F.col("hostname").alias("host")), score, model.threshold, a.radius).write.json(a.out)


if __name__ == "__main__":
    main()
