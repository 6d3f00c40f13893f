"""Release gates and bundles. Driver-side checks of small JSON documents and of one archive; they fail closed."""

from __future__ import annotations

import hashlib
import json
import tarfile
from collections.abc import Iterator, Mapping
from pathlib import Path, PurePosixPath
from typing import Any

from pyspark.sql import SparkSession

from axisflow.functions.release import FORBIDDEN_FIELDS

#: Audit counts that must be there and zero.
ZERO_KEYS = ("foreign_ips", "email_like", "secret_like", "internal_suffix", "live_callback", "unsafe_payload", "intent_signal", "guid_like", "missing_rows", "label_mismatches", "integrity_failures")


class GateError(ValueError):
    """A release that must not go out."""


def sha256_of(path: Path) -> str:
    digest = hashlib.sha256()
    with path.open("rb") as f:
        while block := f.read(1 << 20):
            digest.update(block)
    return digest.hexdigest()


def write_sidecar(path: Path) -> Path:
    side = path.with_name(path.name + ".sha256")
    side.write_text(f"{sha256_of(path)}  {path.name}\n")
    return side


def check_sidecar(path: Path, side: Path) -> None:
    digest, _, name = side.read_text().strip().partition("  ")
    if name != path.name or digest != sha256_of(path):
        raise GateError(f"{side.name} does not fit {path.name}")


def safe_member(name: str) -> str:
    parts = PurePosixPath(name).parts
    if not name or name.startswith("/") or "\\" in name or ".." in parts or ":" in name.split("/")[0]:
        raise GateError(f"unsafe member {name!r}")
    return name


def build_bundle(bundle: Path, files: list[Path], base: Path) -> dict[str, Any]:
    """A tar of regular files with fixed times and owners, its manifest and its sidecar."""
    listed = []
    with tarfile.open(bundle, "w") as tar:
        for path in sorted(files):
            info = tarfile.TarInfo(safe_member(path.relative_to(base).as_posix()))
            info.size = path.stat().st_size
            with path.open("rb") as f:
                tar.addfile(info, f)
            listed.append({"path": info.name, "bytes": info.size, "sha256": sha256_of(path)})
    manifest = {"bundle": bundle.name, "sha256": sha256_of(bundle), "files": listed}
    bundle.with_name(bundle.name + ".manifest.json").write_text(json.dumps(manifest, indent=1, sort_keys=True))
    write_sidecar(bundle)
    return manifest


def regular_members(tar: tarfile.TarFile) -> Iterator[tarfile.TarInfo]:
    for m in tar:
        safe_member(m.name)
        if not m.isreg():
            raise GateError(f"{m.name!r} is no regular file")
        yield m


def check_bundle(bundle: Path) -> None:
    """Sidecar, manifest, set of members and digest of each."""
    check_sidecar(bundle, bundle.with_name(bundle.name + ".sha256"))
    manifest = json.loads(bundle.with_name(bundle.name + ".manifest.json").read_text())
    if manifest["sha256"] != sha256_of(bundle):
        raise GateError("the manifest is of another bundle")
    due = {f["path"]: f["sha256"] for f in manifest["files"]}
    with tarfile.open(bundle) as tar:
        there = {m.name: hashlib.sha256(tar.extractfile(m).read()).hexdigest() for m in regular_members(tar)}
    if there != due:
        raise GateError(f"members differ: {sorted(set(due) ^ set(there)) or sorted(k for k in due if due[k] != there[k])}")


def extract_bundle(bundle: Path, to: Path) -> None:
    check_bundle(bundle)
    with tarfile.open(bundle) as tar:
        for m in list(regular_members(tar)):
            target = to / m.name
            target.parent.mkdir(parents=True, exist_ok=True)
            target.write_bytes(tar.extractfile(m).read())


def leaks(value: Any, at: str = "$", forbidden: frozenset[str] = frozenset(FORBIDDEN_FIELDS)) -> Iterator[str]:
    """Paths of forbidden keys anywhere in a JSON document."""
    if isinstance(value, Mapping):
        for k, v in value.items():
            if k in forbidden:
                yield f"{at}.{k}"
            yield from leaks(v, f"{at}.{k}", forbidden)
    elif isinstance(value, list):
        for i, v in enumerate(value):
            yield from leaks(v, f"{at}[{i}]", forbidden)


def check_audit(audit: Mapping[str, Any], rows: int) -> None:
    """Every scanner's count is there and zero, the number of rows is right, statuses pass, no private key is named."""
    problems = [f"{k} is {audit.get(k)!r}" for k in ZERO_KEYS if audit.get(k) != 0 or isinstance(audit.get(k), bool)]
    problems += [f"n_rows is {audit.get('n_rows')!r}, {rows} are due"] if audit.get("n_rows") != rows else []
    problems += [f"status of {k} is {v['status']!r}" for k, v in audit.items() if isinstance(v, Mapping) and "status" in v and v["status"] not in ("pass", "available")]
    problems += [f"{p} names a private field" for p in leaks(audit)]
    if problems:
        raise GateError("; ".join(problems))


def check_release(spark: SparkSession, release: str, audit: Mapping[str, Any], bundle: Path | None = None) -> int:
    rows = spark.read.text(release).count()
    check_audit(audit, rows)
    if bundle is not None:
        check_bundle(bundle)
    return rows
