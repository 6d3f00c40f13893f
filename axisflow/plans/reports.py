"""Reports of a release: an audit in Markdown, a data card, stage manifests. Small results, written by the driver."""

from __future__ import annotations

import json
from collections.abc import Mapping
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from axisflow.functions.release import PUBLIC_FIELDS

STAGES = ("ingest", "row_ids", "rewrite", "coarsen", "shuffle", "integrity", "audit", "metrics", "bundle")


def audit_document(*parts: DataFrame) -> dict[str, Any]:
    """The fields of one-row audits as one JSON-ready document."""
    out: dict[str, Any] = {}
    for p in parts:
        row = p.first()
        out |= row.asDict(recursive=True) if row else {}
    return out


def audit_markdown(audit: Mapping[str, Any], title: str = "Release audit") -> str:
    lines = [f"# {title}", "", "| check | result |", "|-|-|"]
    for k in sorted(audit):
        v = audit[k]
        lines.append(f"| {k} | {v['status'] + ' (' + str(v.get('n_findings', '-')) + ')' if isinstance(v, Mapping) and 'status' in v else v} |")
    return "\n".join(lines) + "\n"


def histogram(df: DataFrame, column: str, most: int = 1000) -> dict[str, int]:
    """Rows by value; more than `most` values, which public columns never have, are an error."""
    rows = df.groupBy(column).count().orderBy(column).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"{column} has over {most} values")
    return {str(r[column]): r["count"] for r in rows}


def data_card(release: DataFrame, version: str) -> str:
    counts = {c: histogram(release, c) for c in ("label", "split", "source_family")}
    body = [f"# Data card, {version}", "", f"Fields: {', '.join(PUBLIC_FIELDS)}.", "", "Artifacts are rewritten row by row under a key; they are no live names and equal inputs do not link."]
    for c, values in counts.items():
        body += ["", f"## {c}", "", *(f"- {k}: {n}" for k, n in values.items())]
    return "\n".join(body) + "\n"


def stage_manifests(release: DataFrame, path: Path, version: str) -> list[Path]:
    """One JSON file a stage, with row counts and histograms of the public columns."""
    histograms = {c: histogram(release, c) for c in ("time_bucket", "source_family", "label")}
    n = sum(histograms["label"].values())
    path.mkdir(parents=True, exist_ok=True)
    out = []
    for i, stage in enumerate(STAGES):
        target = path / f"{i:02d}_{stage}.json"
        target.write_text(json.dumps({"stage": stage, "version": version, "rows": n, "histograms": histograms if stage in ("coarsen", "audit") else {}}, indent=1, sort_keys=True))
        out.append(target)
    return out


def row_at(df: DataFrame, ordinal: int, column: str = "n") -> DataFrame:
    """The row of an ordinal; negative ones count from the end."""
    if ordinal < 0:
        ordinal += df.agg(F.max(column)).first()[0] + 1
    return df.filter(F.col(column) == ordinal)
