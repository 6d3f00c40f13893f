"""The finite edit manifest: all single edits of a host, edit balls, and seeded random edits.

A rule maps a host to the hosts one edit away. Rules that Spark can express are also given as array
expressions (`NATIVE`), which the oracle queries use; the full manifest runs in an Arrow function.
"""

from __future__ import annotations

import base64
import random
import re
import unicodedata
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from axisflow.functions.host import labels as label_array
from axisflow.operators.storage import cut

VERSION = "manifest-1"

# Confusable letters, confusable final labels, inserted fragments.
HOMOGLYPHS = {"a": "аɑ", "e": "е", "i": "іı", "o": "оօ", "c": "с", "p": "р", "y": "у", "A": "Α", "B": "Β", "E": "Ε", "H": "Н", "K": "Κ", "M": "Μ", "O": "Ο", "P": "Ρ", "T": "Τ", "X": "Χ"}
FINAL_LABELS = {"com": ["co"], "net": ["ne"], "org": ["or"], "io": ["lo", "ia"]}
FRAGMENTS = ["'", '"', "`", "${", "}", "--", "/*", "*/", "#"]

ESCAPE = re.compile("%[0-9A-Fa-f]{2}")
ESCAPES = re.compile("(?:%[0-9A-Fa-f]{2})+")


def spliced(host: str, options: Iterable[tuple[int, int, str]]) -> Iterator[str]:
    """The host with each span replaced in turn."""
    for a, b, new in options:
        yield f"{host[:a]}{new}{host[b:]}"


def each_label(host: str, change: Callable[[str], Iterable[str]]) -> Iterator[str]:
    at = 0
    for part in host.split("."):
        yield from spliced(host, ((at, at + len(part), new) for new in change(part)))
        at += len(part) + 1


def percent(host: str) -> Iterator[str]:
    yield from spliced(host, ((m.start(), m.end(), chr(int(m[0][1:], 16))) for m in ESCAPE.finditer(host)))
    yield from spliced(host, ((i, i + 1, f"%{ord(c):02X}") for i, c in enumerate(host) if c.isascii()))


def homoglyph(host: str) -> Iterator[str]:
    yield from spliced(host, ((i, i + 1, new) for i, c in enumerate(host) for new in HOMOGLYPHS.get(c, "")))


def delimiter(host: str) -> Iterator[str]:
    yield from spliced(host, ((i, i + 1, "-" if c == "." else ".") for i, c in enumerate(host) if c in ".-"))
    yield from spliced(host, ((i, i, new) for i in range(1, len(host)) for new in ".-"))


def merge_or_split(host: str) -> Iterator[str]:
    yield from spliced(host, ((i, i + 1, "") for i, c in enumerate(host) if c == "."))
    yield from spliced(host, ((i, i, ".") for i in range(1, len(host)) if "." not in host[i - 1 : i + 1]))


def case(host: str) -> Iterator[str]:
    yield from spliced(host, ((i, i + 1, c.upper() if c.islower() else c.lower()) for i, c in enumerate(host) if c.isalpha()))


def zero_pad(host: str) -> Iterator[str]:
    yield from each_label(host, lambda x: [(x.lstrip("0") or "0") if x[0] == "0" and len(x) > 1 else f"0{x}"] if x.isdigit() else [])


def utf8_percent(host: str) -> Iterator[str]:
    def runs() -> Iterator[tuple[int, int, str]]:
        for m in ESCAPES.finditer(host):
            try:
                yield m.start(), m.end(), bytes.fromhex(m[0].replace("%", "")).decode()
            except UnicodeDecodeError:
                pass

    yield from spliced(host, runs())
    yield from spliced(host, ((m.start(), m.end(), chr(int(m[0][1:], 16))) for m in ESCAPE.finditer(host)))
    yield from spliced(host, ((i, i + 1, "".join(f"%{b:02X}" for b in c.encode())) for i, c in enumerate(host) if not c.isascii()))


def normal_forms(host: str) -> Iterator[str]:
    yield from (unicodedata.normalize(form, host) for form in ("NFC", "NFKC"))


def punycode(host: str) -> Iterator[str]:
    def change(x: str) -> list[str]:
        try:
            import idna

            convert = (lambda s: idna.decode(s, uts46=True), lambda s: idna.encode(s, uts46=True).decode())
        except ImportError:
            convert = (lambda s: s.encode("ascii").decode("idna"), lambda s: s.encode("idna").decode())
        try:
            return [convert[0](x)] if x.startswith("xn--") else [] if x.isascii() else [convert[1](x)]
        except (UnicodeError, ValueError):
            return []

    yield from each_label(host, change)


def transpose(host: str) -> Iterator[str]:
    parts = host.split(".")
    for i in range(len(parts) - 2):
        yield ".".join([*parts[:i], parts[i + 1], parts[i], *parts[i + 2 :]])


def final_label(host: str) -> Iterator[str]:
    head, dot, last = host.rpartition(".")
    yield from (head + dot + new for new in FINAL_LABELS.get(last, ()) if dot)


def fragment(host: str) -> Iterator[str]:
    yield from spliced(host, ((i, i, new) for i in range(len(host) + 1) for new in FRAGMENTS))


def hex_or_base64(host: str) -> Iterator[str]:
    def plain(raw: bytes) -> list[str]:
        try:
            text = raw.decode()
        except UnicodeDecodeError:
            return []
        return [text] if text and "." not in text and text.isprintable() else []

    def change(x: str) -> Iterator[str]:
        if x:
            yield x.encode().hex()
            yield base64.urlsafe_b64encode(x.encode()).decode().rstrip("=")
        if re.fullmatch("(?:[0-9A-Fa-f]{2})+", x):
            yield from plain(bytes.fromhex(x))
        if re.fullmatch("[A-Za-z0-9_-]{2,}", x) and len(x) % 4 != 1:
            try:
                yield from plain(base64.b64decode(x + "=" * (-len(x) % 4), altchars=b"-_", validate=True))
            except ValueError:
                pass

    yield from each_label(host, change)


RULES: dict[str, Callable[[str], Iterator[str]]] = {
    "E1_percent": percent, "E2_homoglyph": homoglyph, "E3_delimiter": delimiter, "E4_label_split": merge_or_split, "E5_case": case, "E5_zero_pad": zero_pad, "E6_utf8_percent": utf8_percent,
    "E7_unicode_norm": normal_forms, "E8_punycode": punycode, "E9_label_transpose": transpose, "E10_tld_swap": final_label, "E11_quote_comment": fragment, "E12_hex_base": hex_or_base64,
}


def neighbors(host: str, rules: Iterable[str] | None = None) -> list[str]:
    """All hosts one edit away, in code point order."""
    return sorted({x for r in (RULES if rules is None else rules) for x in RULES[r](host)} - {host})


def with_neighbors(df: DataFrame, host: str = "host", rules: Iterable[str] | None = None) -> DataFrame:
    """A row for each host and neighbour."""
    chosen = None if rules is None else list(rules)

    @F.pandas_udf("array<string>")
    def near(hosts: pd.Series) -> pd.Series:
        return hosts.map(lambda h: [] if h is None else neighbors(h, chosen))

    return df.withColumn("neighbor", F.explode(near(F.col(host))))


def edit_ball(hosts: DataFrame, radius: int, max_nodes: int = 10_000, rules: Iterable[str] | None = None) -> DataFrame:
    """host, neighbor, depth of everything within `radius` edits, the host itself included; a ball of over `max_nodes` is an error."""
    if radius < 0 or max_nodes <= 0:
        raise ValueError("radius must not be negative and max_nodes must be positive")
    seen = hosts.select("host", F.col("host").alias("neighbor"), F.lit(0).alias("depth"))
    frontier = seen
    for depth in range(1, radius + 1):
        step = with_neighbors(frontier.select("host", F.col("neighbor").alias("from")), "from", rules).select("host", "neighbor").distinct()
        frontier = cut(step.join(seen.select("host", "neighbor"), ["host", "neighbor"], "left_anti").withColumn("depth", F.lit(depth)), "ball")
        seen = seen.unionByName(frontier)
        if not seen.groupBy("host").count().filter(F.col("count") > max_nodes).isEmpty():
            raise ValueError("an edit ball exceeds max_nodes")
    return seen


# --- the same as array expressions ------------------------------------------------------------


def _positions(host: Column, first: int, last: Column, make: Callable[[Column], Column]) -> Column:
    return F.when(last >= first, F.transform(F.sequence(F.lit(first), last), make)).otherwise(F.array().cast("array<string>"))


def native_fragments(host: Column) -> Column:
    n = F.char_length(host)
    put = lambda i, f: F.concat(F.substring(host, F.lit(1), i), f, F.substring(host, i + 1, n))
    many = F.transform(F.sequence(F.lit(0), n), lambda i: F.transform(F.array(*(F.lit(f) for f in FRAGMENTS)), lambda f: put(i, f)))
    return F.array_sort(F.array_distinct(F.flatten(many)))


def native_delimiters(host: Column) -> Column:
    n = F.char_length(host)
    char = lambda i: F.substring(host, i, F.lit(1))
    around = lambda i, new, skip: F.concat(F.substring(host, F.lit(1), i - 1), new, F.substring(host, i + skip, n))
    flip = F.filter(_positions(host, 1, n, lambda i: F.when(char(i) == ".", around(i, F.lit("-"), 1)).when(char(i) == "-", around(i, F.lit("."), 1))), lambda x: x.isNotNull())
    inserted = lambda new: lambda i: around(i, F.lit(new), 0)
    put = [_positions(host, 2, n, inserted(new)) for new in ".-"]
    return F.array_sort(F.array_except(F.array_distinct(F.concat(flip, *put)), F.array(host)))


def native_transposed(host: Column) -> Column:
    parts = label_array(host)
    n = F.size(parts)
    swap = lambda i: F.array_join(F.concat(F.slice(parts, F.lit(1), i), F.array(parts[i + 1], parts[i]), F.slice(parts, i + 3, n)), ".")
    return F.array_sort(F.array_except(F.array_distinct(F.when(n >= 3, F.transform(F.sequence(F.lit(0), F.greatest(n - 3, F.lit(0))), swap)).otherwise(F.array().cast("array<string>"))), F.array(host)))


NATIVE = {"E3_delimiter": native_delimiters, "E9_label_transpose": native_transposed, "E11_quote_comment": native_fragments}


# --- seeded random edits ----------------------------------------------------------------------


def random_edits(df: DataFrame, key: str, host: str = "host", samples: int = 1, k: int = 1, seed: int = 0, rules: Iterable[str] | None = None) -> DataFrame:
    """`samples` rows a host, each after k random edits of the manifest; the same seed and key give the same edits."""
    names = list(RULES if rules is None else rules)

    @F.pandas_udf("string")
    def draw(hosts: pd.Series, keys: pd.Series, turns: pd.Series) -> pd.Series:
        out = []
        for h, i, t in zip(hosts, keys, turns):
            r = random.Random(f"{seed}|{i}|{t}")
            for _ in range(k if h is not None else 0):
                options = list(RULES[r.choice(names)](h))
                h = r.choice(options) if options else h
            out.append(h)
        return pd.Series(out)

    turns = df.withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))
    return turns.withColumn("edited", draw(F.col(host), F.col(key).cast("string"), F.col("sample")))
