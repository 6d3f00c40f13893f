"""Seeded augmentation of hosts for training views: class-aware weighted edits and encoding layers."""

from __future__ import annotations

import base64
import math
import random
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from axisflow.functions.host import normalized
from axisflow.operators.edits import FRAGMENTS, RULES

# Words that may stand for others, look-alikes, weights of the changes.
SYNONYMS = {
    "application": ["app"], "administrator": ["admin"], "mobile": ["m"], "dashboard": ["dash"], "server": ["srv"], "portal": ["dashboard", "hub", "console", "interface"], "auth": ["login", "signin", "access", "authenticate"],
    "mail": ["email", "inbox", "webmail", "msg"], "cdn": ["assets", "static", "resources", "media"], "user": ["account", "member", "profile", "client"], "verify": ["confirm", "check", "validate", "review"], "support": ["help", "desk", "service", "assistance"],
}
LOOKALIKES = {"a": "@4àáâä", "b": "8", "e": "3€ë", "g": "9q", "i": "1!|íï", "l": "1|!£", "o": "0øóö", "s": "5$z", "t": "7+", "z": "2"}
WEIGHTS = {"random_case_variation": 0.1, "shuffle_subdomains": 0.1, "truncate_subdomain": 0.2, "dropout_random_char": 0.3, "synonym_swap": 0.2, "typo_swap": 0.2, "punctuation_replace": 0.25, "letter_swap_typo": 0.3}
POSITIVE_WEIGHTS = WEIGHTS | {"toggle_protocol": 0.3, "base64_encode_parts": 0.3, "hex_encode_parts": 0.3, "url_encode_parts": 0.3, "random_homoglyph_substitution": 0.15, "quote_comment_fragment": 0.2}
BENIGN_RULES = ("E3_delimiter", "E4_label_split", "E5_case", "E5_zero_pad", "E7_unicode_norm", "E8_punycode")

Change = Callable[[str, random.Random], str]


def swapped(host: str, spots: list[int], r: random.Random) -> str:
    if not spots:
        return host
    i = r.choice(spots)
    return host[:i] + host[i + 1] + host[i] + host[i + 2 :]


def shuffled(host: str, r: random.Random) -> str:
    *sub, a, b = ["", *host.split(".")]
    sub = sub[1:]
    r.shuffle(sub)
    return ".".join([*sub, a, b]) if sub else host


def synonym(host: str, r: random.Random) -> str:
    def one(label: str) -> str:
        low = label.lower()
        if len(label) <= 4 or any(c.isdigit() for c in label):
            return label
        key = next((k for k in SYNONYMS if k in low), None)
        if key is None:
            return label
        at, new = low.index(key), r.choice(SYNONYMS[key])
        new = new.upper() if label.isupper() else new.title() if label.istitle() else new
        return label[:at] + new + label[at + len(key) :]

    return ".".join(map(one, host.split(".")))


def protocol(host: str, r: random.Random) -> str:
    for prefix in ("https://", "http://", "www."):
        if host.startswith(prefix):
            return host[len(prefix) :]
    return r.choice(["http://", "https://", "www."]) + host


def punctuation(host: str) -> str:
    return next((host.replace(c, new, 1) for c, new in (("-", ""), ("_", "-"), (".", "-")) if c in host), host)


def encoded(host: str, r: random.Random, how: Callable[[bytes], str], ratio: float = 0.5) -> str:
    return ".".join(how(x.encode()) if x and r.random() < ratio else x for x in host.split("."))


CHANGES: dict[str, Change] = {
    "random_case_variation": lambda h, r: "".join(r.choice((c.lower(), c.upper())) for c in h),
    "shuffle_subdomains": shuffled,
    "truncate_subdomain": lambda h, r: h.split(".", 1)[1] if h.count(".") > 1 else h,
    "dropout_random_char": lambda h, r: "".join(c for c in h if c == "." or r.random() > 0.1),
    "synonym_swap": synonym,
    "typo_swap": lambda h, r: swapped(h, [i for i in range(len(h) - 1) if "." not in h[i : i + 2]], r),
    "punctuation_replace": lambda h, r: punctuation(h),
    "letter_swap_typo": lambda h, r: swapped(h, [i for i in range(len(h) - 1) if h[i : i + 2].isalpha()], r),
    "toggle_protocol": protocol,
    "base64_encode_parts": lambda h, r: encoded(h, r, lambda b: base64.urlsafe_b64encode(b).decode().rstrip("=")),
    "hex_encode_parts": lambda h, r: encoded(h, r, bytes.hex),
    "url_encode_parts": lambda h, r: encoded(h, r, lambda b: "".join(f"%{x:x}" for x in b)),
    "random_homoglyph_substitution": lambda h, r: "".join(r.choice(LOOKALIKES[c]) if c in LOOKALIKES and r.random() < 0.3 else c for c in h),
    "quote_comment_fragment": lambda h, r: h[: (i := r.randint(0, len(h)))] + r.choice(FRAGMENTS) + h[i:],
}

UNRESERVED = frozenset("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz-._~")

#: Layers around edited positive hosts and their chances; `functions.host` has them as column expressions.
LAYERS: dict[str, tuple[float, Callable[[str], str]]] = {
    "url": (0.5, lambda h: "".join(c if c in UNRESERVED else f"%{ord(c):02X}" for c in h)),
    "base64": (0.3, lambda h: base64.urlsafe_b64encode(h.encode()).decode().rstrip("=")),
    "base32": (0.2, lambda h: base64.b32encode(h.encode()).decode().rstrip("=")),
    "nested": (0.2, lambda h: h.replace("\\", "\\\\").replace("%", "%25")),
}


@dataclass(frozen=True)
class WeightedConfig:
    """Weighted changes: how many, the weights by class, and how often a draw that changes nothing is repeated."""

    num_augs: int = 2
    benign_weights: Mapping[str, float] = field(default_factory=lambda: dict(WEIGHTS))
    malicious_weights: Mapping[str, float] = field(default_factory=lambda: dict(POSITIVE_WEIGHTS))
    retry_on_no_change: bool = True
    max_attempts: int = 3

    def __post_init__(self):
        if self.num_augs < 0 or self.max_attempts < 1:
            raise ValueError("num_augs must not be negative, max_attempts must be positive")
        for weights in (self.benign_weights, self.malicious_weights):
            if any(not math.isfinite(w) or w < 0 for w in weights.values()):
                raise ValueError("weights must be finite and not negative")
            if unknown := set(weights) - set(CHANGES):
                raise ValueError(f"unknown changes: {sorted(unknown)}")


@dataclass(frozen=True)
class AugmentConfig:
    """Edits of the manifest, by class as many as the bounds say, with layers for positives; and weighted changes."""

    benign_min_edits: int = 0
    benign_max_edits: int = 1
    malicious_min_edits: int = 1
    malicious_max_edits: int = 3
    include_nested_encoding: bool = True
    normalize_input: bool = True
    use_edit_model: bool = True
    use_weighted_augs: bool = False
    weighted: WeightedConfig = field(default_factory=WeightedConfig)
    benign_rules: tuple[str, ...] = BENIGN_RULES
    malicious_rules: tuple[str, ...] = tuple(RULES)

    def __post_init__(self):
        if not 0 <= self.benign_min_edits <= self.benign_max_edits or not 0 <= self.malicious_min_edits <= self.malicious_max_edits:
            raise ValueError("numbers of edits must not be negative, the least at most the most")


def config_of(mode: str, normalize_text: bool = True, **weighted) -> AugmentConfig:
    """The configuration of a mode: edit, weighted or hybrid, which is both. Only pure edits normalize their input."""
    if mode not in ("edit", "weighted", "hybrid"):
        raise ValueError(f"unknown mode {mode!r}")
    return AugmentConfig(normalize_input=normalize_text and mode == "edit", use_edit_model=mode != "weighted", use_weighted_augs=mode != "edit", weighted=WeightedConfig(**weighted))


def reweighted(host: str, weights: Mapping[str, float], how: WeightedConfig, r: random.Random) -> str:
    """As many changes as configured, drawn by weight with replacement; another draw while nothing has changed."""
    names = [k for k, w in weights.items() if w > 0]
    if not names or not how.num_augs:
        return host
    out = host
    for _ in range(how.max_attempts):
        out = host
        for name in r.choices(names, [weights[k] for k in names], k=how.num_augs):
            out = CHANGES[name](out, r)
        if out != host or not how.retry_on_no_change:
            break
    return out


def augmented(host: str, positive: bool, r: random.Random, config: AugmentConfig = AugmentConfig()) -> str:
    """One random view of a host by its class."""
    out = host
    if config.use_edit_model:
        rules = config.malicious_rules if positive else config.benign_rules
        bounds = (config.malicious_min_edits, config.malicious_max_edits) if positive else (config.benign_min_edits, config.benign_max_edits)
        for _ in range(r.randint(*bounds)):
            options = list(RULES[r.choice(rules)](out))
            out = r.choice(options) if options else out
        if positive:
            for name, (chance, layer) in LAYERS.items():
                if (name != "nested" or config.include_nested_encoding) and r.random() < chance:
                    out = layer(out)
    if config.use_weighted_augs:
        out = reweighted(out, config.weighted.malicious_weights if positive else config.weighted.benign_weights, config.weighted, r)
    return out


def two_views(df: DataFrame, key: str, host: str = "hostname", positive: str = "is_malicious", epoch: int = 0, seed: int = 0, mode: str = "hybrid", config: AugmentConfig | None = None) -> DataFrame:
    """Adds view1 and view2; they depend on seed, epoch, key and view alone. `config` goes before `mode`."""
    chosen = config or config_of(mode)

    @F.pandas_udf("string")
    def view(hosts: pd.Series, positives: pd.Series, keys: pd.Series, turn: pd.Series) -> pd.Series:
        return pd.Series([None if h is None else augmented(h, bool(p), random.Random(f"{seed}|{epoch}|{k}|{t}"), chosen) for h, p, k, t in zip(hosts, positives, keys, turn)], dtype=object)

    k = F.col(key).cast("string")
    text = F.when(F.col(host).isNotNull(), normalized(F.col(host))) if chosen.normalize_input else F.col(host)
    return df.withColumn("view1", view(text, F.col(positive), k, F.lit(1))).withColumn("view2", view(text, F.col(positive), k, F.lit(2)))


def chunk_shuffled(df: DataFrame, chunk: str, row: str, epoch: int, seed: int = 0) -> DataFrame:
    """Chunks in a keyed order, and rows in a keyed order within each."""
    return df.orderBy(F.xxhash64(F.lit(seed), F.lit(epoch), F.col(chunk)), chunk, F.xxhash64(F.lit(seed), F.lit(epoch), F.col(chunk), F.col(row)), row)
