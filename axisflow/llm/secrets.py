"""Secret scans: declared secrets by format, and random-looking strings by sliding-window entropy."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from axisflow.llm.shared import lean

KINDS = ("assign", "access", "hex", "entropy")

# The base formats.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ASSIGN_WORDS = ("passw", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")

#: Classes of characters, their sizes, and the bits a character that a window must reach.
CLASSES = (
    ("hex", re.compile(r"[0-9A-Fa-f]{20,}"), 3.0),
    ("base32", re.compile(r"[A-Z2-7]{20,}"), 3.6),
    ("base64", re.compile(r"[A-Za-z0-9+/_=-]{20,}"), 3.9),
)
#: Strings that look random and are no secrets: identifiers, paths, words, and published examples.
ALLOWED = (
    re.compile(r"[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}"),
    re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+|[A-Z]?[a-z]+(?:[-_/][A-Za-z]+)+"),
    re.compile(r".*(?:EXAMPLE|example|Example|xxxx|XXXX|0123456789|abcdefghij|ABCDEFGHIJ).*"),
    re.compile(r"[-_=+/]*"),
)
#: Parts of a candidate that are judged by themselves: behind a name and its sign, and between the signs of a path.
PARTS = (re.compile(r"[A-Za-z0-9+/_-]{20,}=*"), re.compile(r"[A-Za-z0-9]{20,}"))


def max_window_entropy(s: str, width: int) -> float:
    """The highest Shannon entropy in bits of any window of `width` characters.

    Counts change by one character in and one out, so a step costs the same for any width; a string
    shorter than the window is one window.
    """
    log = [0.0, *(n * math.log2(n) for n in range(1, width + 1))]
    counts: dict[str, int] = {}
    total, best, size = 0.0, 0.0, 0
    for i, c in enumerate(s):
        if size == width:
            out = s[i - width]
            n = counts[out]
            counts[out] = n - 1
            total += log[n - 1] - log[n]
            size -= 1
        n = counts.get(c, 0)
        counts[c] = n + 1
        total += log[n + 1] - log[n]
        size += 1
        if size == width or i == len(s) - 1:
            best = max(best, math.log2(size) - total / size)
    return best


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Leftmost non-overlapping matches of each base format, the failing ones dropped."""
    out = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text)]
    out += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return out


def is_mixed(s: str) -> bool:
    """Letters and digits, or letters alone of which, as in random keys and unlike in names, cases are about even and alternate often.

    Digits alone are numbers, whatever their entropy, and never taken for a key.
    """
    if any(c.isdigit() for c in s):
        return any(c.isalpha() for c in s)
    letters = [c.isupper() for c in s if c.isalpha()]
    changes = sum(a != b for a, b in zip(letters, letters[1:]))
    return len(letters) >= 20 and 0.3 <= sum(letters) / len(letters) <= 0.7 and changes >= 0.3 * len(letters)


def is_random(s: str, least: float, width: int) -> bool:
    return is_mixed(s) and not any(a.fullmatch(s) for a in ALLOWED) and max_window_entropy(s, width) >= least


def entropy_spans(text: str, width: int = 20) -> list[tuple[str, int, int]]:
    """Candidate strings of which a window is random enough, or else their runs that are, each by its own class.

    A run is the longest stretch of a class's characters, or a part of a candidate as base64; the allow
    list is held against the run alone. Runs that overlap are one span.
    """
    out = []
    for m in CANDIDATE.finditer(text):
        s, at = m[0], m.start()
        if is_random(s, CLASSES[-1][2], width):
            out.append(("entropy", at, m.end()))
            continue
        runs = {(r.start(), r.end()): bits for shape, bits in [*((x, CLASSES[-1][2]) for x in PARTS), *((x, bits) for _, x, bits in CLASSES[-2::-1])] for r in shape.finditer(s)}
        last = len(out)
        for (a, b), bits in sorted(runs.items()):
            if len(out) > last and b + at <= out[-1][2] or not is_random(s[a:b], bits, width):
                continue
            if len(out) > last and a + at < out[-1][2]:
                out[-1] = ("entropy", out[-1][1], b + at)
            else:
                out.append(("entropy", a + at, b + at))
    return out


def all_spans(text: str, width: int = 20) -> list[tuple[str, int, int]]:
    """Base spans, and entropy spans that no base span overlaps, by start and kind."""
    base = base_spans(text)
    more = entropy_spans(text, width)
    if base and more:
        more = [x for x in more if not any(a < x[2] and x[1] < b for _, a, b in base)]
    return sorted(base + more, key=lambda x: (x[1], KINDS.index(x[0])))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


SPANS = "n_assign long, n_access long, n_hex long, n_entropy long, base_sha256 string, spans string"


def scan_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 20, redacted: str | None = None) -> DataFrame:
    """Secrets of each row: counts by kind, digest of the base spans, all spans as kind:start:end.

    Offsets are code points. Null and empty texts have no spans; texts are scanned whole; repeated rows
    give repeated results; other columns of `df` are ignored. With `redacted`, that column has the text
    with each span replaced by <kind>.
    """
    schema = StructType(df.select(F.col(id_col)).schema.fields)
    for field in StructType.fromDDL(SPANS + (f", {redacted} string" if redacted else "")):
        schema = schema.add(field)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for value in batch.column(1):
                text = value.as_py() or ""
                spans = all_spans(text, width)
                base = [x for x in spans if x[0] != "entropy"]
                counts = [sum(k == kind for k, _, _ in spans) for kind in KINDS]
                row = (*counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans))
                if redacted:
                    row += (redact(text, spans) if value.is_valid else None,)
                rows.append(row)
            cols = list(zip(*rows)) or [()] * (len(schema) - 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64() if i < 4 else pa.string()) for i, c in enumerate(cols))], names=schema.names)

    return df.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(lean(scan), schema)


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    out, at = [], 0
    for kind, a, b in spans:
        if b > at:
            out += [text[at : max(a, at)], f"<{kind}>"]
            at = b
    return "".join(out) + text[at:]
