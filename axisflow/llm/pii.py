"""Personal data: exact base formats, and further spans by boosted trees over candidates.

DataFrame functions only. Generators of high recall propose spans that may overlap; gradient-boosted
trees become conditional expressions over format and context features. They are trained on all candidates
of the corpus that valid base spans label, counted by their features, and on synthetic ones of formats that
have no base; thresholds, one a kind, are calibrated on candidates of other documents. Of overlapping
candidates the best stays, and none that a base span overlaps.
"""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from axisflow.llm.shared import give_back

BASE = ("email", "ip", "card", "phone")
MORE = ("local_phone", "national_id", "iban", "spelled_email")
KINDS = BASE + MORE

# The base formats. Look-behinds and possessive loops keep the search linear and change no match.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    # generators of candidates
    "local_phone": r"(?<![0-9A-Za-z.,/+-])[0-9(][0-9()./\x20-]{5,24}[0-9](?![0-9A-Za-z/-])",
    "national_id": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "iban": r"(?<![A-Z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}+(?:\x20?[A-Z0-9]{1,3})?+(?![A-Z0-9])",
    "spelled_email": r"(?i)(?<![a-z0-9._-])[a-z0-9][a-z0-9._-]{0,63}\x20?(?:\(at\)|\[at\]|\{at\}|\x20at\x20)\x20?[a-z0-9-]{1,63}\x20?(?:\(dot\)|\[dot\]|\{dot\}|\x20dot\x20)\x20?[a-z]{2,24}(?![a-z])",
}
GATES = {"email": "@", "phone": "+", "card": None, "ip": None, "local_phone": None, "national_id": "-", "iban": None, "spelled_email": None}
SPAN = "array<struct<start:int,rank:int,end:int,kind:string>>"
BLOCK = 256


def matches(text: Column, kind: str) -> tuple[Column, Column]:
    pattern = PATTERNS[kind]
    test = text.contains(GATES[kind]) if GATES[kind] else text.rlike("(?i)(?:at[)\\]}]|\x20at\x20)" if kind == "spelled_email" else "[0-9]")
    found = F.when(test, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>"))
    return found, F.lit(pattern)


def with_matches(df: DataFrame, kind: str, text_col: str = "_text") -> DataFrame:
    """Adds `_m_<kind>`: start, end (code points, end exclusive), value, and the text before and after each match.

    The text is split at the matches; starts are sums of lengths, taken by blocks so that a text with
    very many matches stays near linear.
    """
    m = f"_m_{kind}"
    found, pattern = matches(F.col(text_col), kind)
    df = df.withColumn(f"{m}_f", found)
    hit = F.size(f"{m}_f") > 0
    df = df.withColumn(f"{m}_p", F.when(hit, F.split(F.col(text_col), PATTERNS[kind], -1)).otherwise(F.array().cast("array<string>")))
    f, p = F.col(f"{m}_f"), F.col(f"{m}_p")
    df = df.withColumn(f"{m}_l", F.transform(f, lambda v, i: F.char_length(v) + F.char_length(p[i])))
    lengths = F.col(f"{m}_l")
    total = lambda a: F.aggregate(a, F.lit(0), lambda x, y: x + y)
    blocks = F.when(F.size(lengths) > 0, F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / BLOCK).cast("int"))).otherwise(F.array().cast("array<int>"))
    df = df.withColumn(f"{m}_b", F.transform(blocks, lambda b: total(F.slice(lengths, b * BLOCK + 1, F.lit(BLOCK)))))
    sums = F.col(f"{m}_b")
    df = df.withColumn(f"{m}_s", F.transform(sums, lambda _, b: total(F.slice(sums, F.lit(1), b))))

    def span(v: Column, i: Column) -> Column:
        block = F.floor(i / BLOCK).cast("int")
        start = F.col(f"{m}_s")[block] + total(F.slice(lengths, block * BLOCK + 1, i - block * BLOCK)) + F.char_length(p[i])
        return F.struct(start.alias("start"), (start + F.char_length(v)).alias("end"), v.alias("value"), F.right(p[i], F.lit(28)).alias("before"), F.left(p[i + 1], F.lit(12)).alias("after"))

    return df.withColumn(m, F.transform(f, span)).drop(*(f"{m}_{x}" for x in "fplbs"))


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


VALID = {
    "email": None,
    "ip": lambda m: m["value"].rlike(r"^0*+(?:[0-9]{0,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.0*+(?:[0-9]{0,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])){3}$"),
    "card": lambda m: F.call_function("luhn_check", digits(m["value"])),
    "phone": lambda m: F.char_length(digits(m["value"])).between(10, 15),
}


def as_spans(kind: str, found: Column) -> Column:
    rank = KINDS.index(kind)
    return F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(rank).alias("rank"), m["end"].alias("end"), F.lit(kind).alias("kind")))


WORDS = {
    "says_phone": r"(?i)(?:phone|tel|tél|telefon|tel[eé]fono|mobile|cell|call|fax|handy|whatsapp|dial)[^0-9]{0,12}$",
    "says_id": r"(?i)(?:ssn|social|sozial|dni|nif|s[eé]cu|national|identity|passport|\bid)[^0-9]{0,16}$",
    "says_account": r"(?i)(?:iban|account|konto|compte|cuenta|bank)[^0-9]{0,12}$",
    "says_mail": r"(?i)(?:mail|contact|write|schreib|[eé]cri|correo)[^@]{0,16}$",
    "says_other": r"(?i)(?:isbn|issn|doi|version|\bv|page|pages|pp|p\.|no\.|order|invoice|score|since|until|year|from|between|\$|€|£|usd|eur|fig|table|section|chapter|§|#)\W{0,3}$",
}


def features(kind: str, m: Column) -> dict[str, Column]:
    v, d = m["value"], digits(m["value"])
    flag = lambda c: c.cast("double")
    out = {
        "generator": F.lit(float(KINDS.index(kind))),
        "digits": F.char_length(d).cast("double"),
        "length": F.char_length(v).cast("double"),
        "groups": F.regexp_count(v, F.lit("[0-9]+")).cast("double"),
        "bracket": flag(v.rlike(r"^\([0-9]{2,5}\)[\x20-]?[0-9]")),
        "slash": flag(v.contains("/")),
        "dots": F.regexp_count(v, F.lit(r"\.")).cast("double"),
        "zero": flag(d.startswith("0")),
        "date": flag(v.rlike(r"^(?:[0-9]{4}[-./\x20](?:0?[1-9]|1[0-2])[-./\x20](?:0?[1-9]|[12][0-9]|3[01])|(?:0?[1-9]|[12][0-9]|3[01])[-./\x20](?:0?[1-9]|1[0-2])[-./\x20](?:[0-9]{2}|[0-9]{4}))(?![0-9])")),
        "years": flag(v.rlike(r"^(?:1[5-9]|20)[0-9]{2}\x20?-\x20?(?:1[5-9]|20)[0-9]{2}$")),
        "phone_shape": flag(v.rlike(r"^(?:\([0-9]{2,5}\)|[0-9]{2,5})(?:[\x20.-][0-9]{2,4}){2,4}$")),
        "id_shape": flag(v.rlike(r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$")),
        "mod97": flag(iban_remainder(v) == 1),
        "currency": flag(m["after"].rlike(r"^\x20?(?:[€$£%]|usd|eur|km|kg|mm|ms|px)")),
        "more": flag(m["after"].rlike(r"^\x20?[,.]?[0-9]")),
    }
    return {k: F.coalesce(c, F.lit(0.0)) for k, c in (out | {k: flag(m["before"].rlike(p)) for k, p in WORDS.items()}).items()}


FEATURES = ("generator", "digits", "length", "groups", "bracket", "slash", "dots", "zero", "date", "years", "phone_shape", "id_shape", "mod97", "currency", "more", *WORDS)


def iban_remainder(value: Column) -> Column:
    """The number that the rearranged letters and digits make, modulo 97; -1 where that has no sense."""
    compact = F.replace(value, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(compact, 5, 64), F.left(compact, F.lit(4)))
    chars = F.when(compact.rlike("^[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}$"), F.split(turned, "")).otherwise(F.array().cast("array<string>"))
    code = lambda c: F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    rest = F.aggregate(F.filter(chars, lambda c: c != ""), F.lit(0), lambda a, c: F.pmod(a * F.when(c.rlike("[0-9]"), 10).otherwise(100) + code(c), F.lit(97)))
    return F.when(F.size(chars) > 0, rest).otherwise(-1)


# --- boosting -----------------------------------------------------------------------------------

RATE = 0.4  # of each tree

Tree = float | tuple[int, float, "Tree", "Tree"]


def grow_tree(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, least: float = 1.0, penalty: float = 1.0) -> Tree:
    """A regression tree on gradients and curvatures; splits are features at thresholds, the best of all cut points."""
    value = float(g.sum() / (h.sum() + penalty))
    if not depth:
        return value
    best = (1e-6, None, None)
    base = g.sum() ** 2 / (h.sum() + penalty)
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        v, gl, hl = x[order, f], np.cumsum(g[order])[:-1], np.cumsum(h[order])[:-1]
        gr, hr = g.sum() - gl, h.sum() - hl
        gain = gl**2 / (hl + penalty) + gr**2 / (hr + penalty) - base
        gain[(v[1:] == v[:-1]) | (np.minimum(hl, hr) < least)] = 0
        if len(gain) and gain[at := int(np.argmax(gain))] > best[0]:
            best = float(gain[at]), f, float((v[at] + v[at + 1]) / 2)
    if best[1] is None:
        return value
    left = x[:, best[1]] <= best[2]
    return best[1], best[2], grow_tree(x[left], g[left], h[left], depth - 1), grow_tree(x[~left], g[~left], h[~left], depth - 1)


def tree_values(tree: Tree, x: np.ndarray) -> np.ndarray:
    if not isinstance(tree, tuple):
        return np.full(len(x), tree)
    left, out = x[:, tree[0]] <= tree[1], np.empty(len(x))
    out[left], out[~left] = tree_values(tree[2], x[left]), tree_values(tree[3], x[~left])
    return out


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 20, depth: int = 3, rate: float = RATE, weight: np.ndarray | float = 1.0) -> list[Tree]:
    """Trees for rows that count `weight` times each."""
    z, trees = np.zeros(len(y)), []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-z))
        tree = grow_tree(x, weight * (y - p), weight * p * (1 - p), depth)
        trees.append(tree)
        z += rate * tree_values(tree, x)
    return trees


def tree_column(tree: Tree, values: list[Column]) -> Column:
    if not isinstance(tree, tuple):
        return F.lit(tree)
    return F.when(values[tree[0]] <= tree[1], tree_column(tree[2], values)).otherwise(tree_column(tree[3], values))


def synthetic(seed: int, n: int) -> list[tuple[str, str, str, str]]:
    """Labelled candidates with their surroundings: (before, candidate, after, kind, which is empty if it is none)."""
    r = random.Random(seed)
    num = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    filler = ["the ", "in ", "and ", "of the ", "with ", "see ", "a total of ", "que ", "und ", "les "]

    def iban(good: bool) -> str:
        country, body = r.choice(["DE", "FR", "ES", "NL", "GB"]), num(r.choice([14, 18, 20]))
        whole = int("".join(str(int(c, 36)) for c in body + country + "00"))
        check = 98 - whole % 97 if good else (98 - whole % 97 + r.randint(1, 90)) % 97 + 1
        s = f"{country}{check:02d}{body}"
        return " ".join(s[i : i + 4] for i in range(0, len(s), 4)) if r.random() < 0.5 else s

    out = []
    for _ in range(n):
        kind = r.randrange(14)
        before, after = r.choice(filler), r.choice([" ", ".", ", ", " and "])
        if kind == 0:
            out.append((r.choice(["phone: ", "call ", "Tel. ", "mobile ", "fax: ", "Telefon ", "tél. "]), r.choice([f"({num(3)}) {num(3)}-{num(4)}", f"{num(3)}-{num(3)}-{num(4)}", f"0{num(2)} {num(4)} {num(4)}", f"0{num(1)} {num(2)} {num(2)} {num(2)} {num(2)}", f"0{num(9)}"]), after, "local_phone"))
        elif kind == 1:
            out.append((before, r.choice([f"({num(3)}) {num(3)}-{num(4)}", f"({num(3)}) {num(3)} {num(4)}"]), after, "local_phone"))
        elif kind == 2:
            out.append((r.choice(["SSN ", "social security: ", "ID: "]), f"{r.randint(101, 665)}-{r.randint(11, 99)}-{r.randint(1000, 9999)}", after, "national_id"))
        elif kind == 3:
            out.append((r.choice(["IBAN ", "account: ", before]), iban(True), after, "iban"))
        elif kind == 4:
            out.append((r.choice(["mail ", "contact: ", "write to ", before]), r.choice(["{}(at){}(dot)com", "{} [at] {} [dot] org", "{} at {} dot net"]).format("".join(r.choice("abcdefgh") for _ in range(6)), "".join(r.choice("klmnop") for _ in range(6))), after, "spelled_email"))
        elif kind == 5:
            out.append((before, r.choice([f"{r.randint(1800, 2030)}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d}", f"{r.randint(1, 28)}.{r.randint(1, 12)}.{r.randint(1900, 2030)}", f"{r.randint(1, 12):02d}/{r.randint(1, 28):02d}/{r.randint(1900, 2030)}"]), after, ""))
        elif kind == 6:
            out.append((r.choice([before, "from ", "between "]), f"{r.randint(1600, 2020)}-{r.randint(1600, 2030)}", after, ""))
        elif kind == 7:
            out.append((r.choice(["version ", "v", "section ", before]), ".".join(num(r.randint(1, 3)) for _ in range(r.randint(3, 5))) + num(2), after, ""))
        elif kind == 8:
            out.append((r.choice(["$", "€", "order ", "invoice #", "ISBN ", "pages ", before]), r.choice([num(7), num(9), f"{num(3)}-{num(1)}-{num(4)}-{num(3)}-1", f"{num(3)} {num(3)} {num(3)}", f"{num(4)}-{num(4)}"]), after, ""))
        elif kind == 9:
            out.append((before, f"{num(3)} {num(3)}", r.choice([" €", " km", "%", " kg"]), ""))
        elif kind == 10:
            out.append((before, iban(False), after, ""))
        elif kind == 11:
            out.append((r.choice([before, "part no. "]), f"{r.choice(['000', '666', '9' + num(2)])}-{num(2)}-{num(4)}", after, ""))
        elif kind == 12:
            out.append((before, " ".join(num(r.randint(1, 4)) for _ in range(r.randint(3, 6))), after, ""))
        else:
            out.append((before, num(r.randint(7, 13)), after, ""))
    return out


def candidates(df: DataFrame) -> DataFrame:
    """Adds `_candidates`: the spans of all generators with their features, from `_text`."""
    for kind in MORE:
        df = with_matches(df, kind)
    made = lambda kind: F.transform(
        F.col(f"_m_{kind}"), lambda m: F.struct(m["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), m["end"].alias("end"), F.lit(kind).alias("kind"), *(c.alias(k) for k, c in features(kind, m).items()))
    )
    return df.withColumn("_candidates", F.concat(*(made(k) for k in MORE))).drop(*(f"_m_{k}" for k in MORE))


#: Base kinds whose valid spans show what a candidate of another kind looks like.
SHOWN_BY = {"local_phone": "phone", "spelled_email": "email"}


Labelled = tuple[np.ndarray, np.ndarray, np.ndarray]  # whether to fit (or calibrate) with it, features, whether it is personal data


def as_arrays(rows: DataFrame) -> Labelled:
    """Of rows h, y, x."""
    table = rows.toArrow()
    x = table.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
    return table.column("h").to_numpy() % 2 == 0, x, table.column("y").to_numpy().astype(float)


_SYNTHETIC: dict[tuple[int, int], Labelled] = {}


def synthetic_candidates(spark: SparkSession, seed: int, n: int) -> Labelled:
    """Candidates in synthetic surroundings; they depend on seed and number alone and are kept."""
    if (seed, n) in _SYNTHETIC:
        return _SYNTHETIC[seed, n]
    rows = [(i, b + c + a, len(b), len(b) + len(c), y) for i, (b, c, a, y) in enumerate(synthetic(seed, n))]
    df = spark.createDataFrame(rows, "i int, _text string, a int, b int, y string").repartition(4)
    found = candidates(df).select("i", "a", "b", "y", F.explode("_candidates").alias("c")).filter("c.start < b and c.end > a").orderBy("i", "c.start", "c.rank")
    found = found.select(F.col("i").cast("long").alias("h"), (F.col("y") == F.col("c.kind")).alias("y"), F.array(*(F.col(f"c.{f}") for f in FEATURES)).alias("x"))
    return _SYNTHETIC.setdefault((seed, n), as_arrays(found))


def with_shown(docs: DataFrame, text_col: str) -> DataFrame:
    """`_text` and `_shown`, all candidates of the text with a label and their features: within a valid base span of the kind
    that shows theirs they are personal data, over spans of other kinds only they are none; the rest tells nothing."""

    def labelled(c: Column) -> Column:
        shows = F.coalesce(*(F.when(c["kind"] == k, F.lit(v)) for k, v in SHOWN_BY.items()), F.lit(""))
        others = F.filter("_base", lambda b: overlap(b, c))
        inside = F.exists(others, lambda b: (b["kind"] == shows) & (b["start"] <= c["start"]) & (c["end"] <= b["end"]))
        label = F.when(inside, True).when((F.size(others) > 0) & ~F.exists(others, lambda b: b["kind"] == shows), False)
        return F.struct(label.alias("y"), F.array(*(c[f] for f in FEATURES)).alias("x"))

    df = candidates(with_base(docs, text_col)).select("_text", F.transform("_candidates", labelled).alias("_shown"))
    return df.select("_text", F.filter("_shown", lambda c: c["y"].isNotNull()).alias("_shown"))


def shown_candidates(docs: DataFrame, sample: int, text_col: str, each: int = 8) -> Labelled:
    """Examples to look at, one entry a candidate: the first `each` of at most `sample` texts, those of the smallest hashes.
    Nothing is fitted to these; `counted_candidates` has those of every text."""
    df = with_shown(docs, text_col).select("_text", F.slice("_shown", 1, each).alias("_shown"))
    # sorted rather than filtered, so that the candidates are worked out once
    found = df.select(F.when(F.size("_shown") > 0, F.xxhash64("_text")).alias("h"), "_shown").orderBy(F.asc_nulls_last("h")).limit(sample)
    return as_arrays(found.select("h", F.explode("_shown").alias("c")).select("h", "c.y", "c.x"))


def counted_candidates(docs: DataFrame, text_col: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All labelled candidates of all texts, counted where half, features and label agree: whether to fit with them, features,
    label, and how many they are, in a fixed order.

    Features are small whole numbers that the patterns bound (lengths below 200, the others counts within them or 0 and 1), so
    these are few beside the candidates.
    """
    whole = F.transform("c.x", lambda v: v.cast("smallint"))
    # explode_outer, since for explode Spark would test the candidates before, and work them out twice
    found = with_shown(docs, text_col).select((F.pmod(F.xxhash64("_text"), F.lit(2)) == 0).alias("fit"), F.explode_outer("_shown").alias("c")).filter("c is not null")
    table = found.select("fit", F.col("c.y").alias("y"), whole.alias("x")).groupBy("fit", "y", "x").agg(F.count("*").alias("n")).toArrow()
    x = table.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
    fit, y, n = (table.column(c).to_numpy() for c in ("fit", "y", "n"))
    order = np.lexsort((fit, y, *x.T))
    return fit[order].astype(bool), x[order], y[order].astype(float), n[order]


def fit_candidates(spark: SparkSession, docs: DataFrame | None = None, seed: int = 4, n: int = 3000, precision: float = 0.97, rarity: float = 5.0, text_col: str = "text") -> tuple[tuple, dict[str, float]]:
    """Trees, and a threshold for each kind: the lowest at which calibration candidates are right as often as `precision`.

    Wrong ones count `rarity` times there: in a corpus they are more frequent than among these. At most n synthetic candidates and
    all labelled ones of the corpus; half of the texts of either are held back for the thresholds. Where the corpus has more than
    the synthetic ones, each weighs as much less as makes both parts equal: otherwise formats without a base would count for nothing
    in a large one. A kind of which none is right has no threshold, and adds nothing.
    """
    fit, x, y = synthetic_candidates(spark, seed, n)
    x, weight = x.astype(np.int16), np.ones(len(y))
    if docs is not None:
        *shown, count = counted_candidates(docs, text_col)
        share = min(1.0, len(y) / max(int(count.sum()), 1))
        fit, x, y, weight = (np.concatenate(p) for p in zip((fit, x, y, weight), (*shown, count * share)))
    trees = boost(x[fit], y[fit], weight=weight[fit])
    z = RATE * sum(tree_values(t, x) for t in trees)
    thresholds = {}
    for k in MORE:
        own = np.flatnonzero(~fit & (x[:, 0] == KINDS.index(k)))
        order = own[np.argsort(-z[own], kind="stable")]
        hits, misses = np.cumsum((weight * y)[order]), np.cumsum((weight * (1 - y))[order])
        right = hits / (hits + rarity * misses)
        # at equal scores all of them count
        last = np.append(z[order][1:] < z[order][:-1], True)[: len(order)]
        good = np.flatnonzero((right >= precision) & last)
        if len(good) and y[order[: good[-1] + 1]].any():
            thresholds[k] = float(z[order[good[-1]]])
    give_back()
    return tuple(trees), thresholds


def overlap(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def with_base(docs: DataFrame, text_col: str) -> DataFrame:
    """Adds `_text`, a null one as empty, and `_base`, the base spans by start and kind."""
    df = docs.withColumn("_text", F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    for kind in BASE:
        df = with_matches(df, kind)
    base = [as_spans(k, F.filter(F.col(f"_m_{k}"), VALID[k]) if VALID[k] else F.col(f"_m_{k}")) for k in BASE]
    return df.withColumn("_base", F.sort_array(F.concat(*base))).drop(*(f"_m_{k}" for k in BASE))


def with_spans(docs: DataFrame, model: tuple[tuple, dict[str, float]], text_col: str = "text") -> DataFrame:
    """Adds `_base` and `_spans`: base spans, and these with the selected candidates, by start and kind.

    A null text is empty; texts of any length are searched whole; rows do not influence each other.
    """
    df = candidates(with_base(docs, text_col))
    trees, thresholds = model
    due = lambda c: F.coalesce(*(F.when(c["kind"] == k, F.lit(t)) for k, t in thresholds.items()), F.lit(float("inf")))

    def scored(c: Column) -> Column:
        values = [c[f] for f in FEATURES]
        total = F.lit(0.0)
        for t in trees:
            total = total + tree_column(t, values)
        return F.struct(c["start"].alias("start"), c["rank"].alias("rank"), c["end"].alias("end"), c["kind"].alias("kind"), (total * RATE).alias("z"))

    df = df.withColumn("_scored", F.transform(F.filter("_candidates", lambda c: ~F.exists("_base", lambda b: overlap(b, c))), scored))
    df = df.withColumn("_scored", F.filter("_scored", lambda c: c["z"] >= due(c) - 1e-9))
    better = lambda d, c: (d["z"] > c["z"]) | (d["z"] == c["z"]) & ((d["start"] < c["start"]) | (d["start"] == c["start"]) & (d["rank"] < c["rank"]))
    best = F.filter("_scored", lambda c: ~F.exists("_scored", lambda d: overlap(d, c) & better(d, c)))
    plain = F.transform(best, lambda c: F.struct(c["start"].alias("start"), c["rank"].alias("rank"), c["end"].alias("end"), c["kind"].alias("kind")))
    return df.withColumn("_spans", F.sort_array(F.concat("_base", plain))).drop("_candidates", "_scored")


def joined(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_pii(docs: DataFrame, model: tuple[tuple, dict[str, float]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts by kind, digest of the base spans and all spans of every row.

    Null and empty texts have no spans; repeated rows give repeated results; an empty table stays empty;
    other columns are ignored.
    """
    df = with_spans(docs.select(id_col, text_col), model, text_col)
    count = lambda k: F.size(F.filter("_spans", lambda s: s["kind"] == k)).cast("long")
    return df.select(id_col, *(count(k).alias(f"n_{k}") for k in BASE), F.sha2(joined("_base"), 256).alias("base_sha256"), joined("_spans").alias("spans"), (F.size("_spans") - F.size("_base")).cast("long").alias("n_added"))


def redact_pii(docs: DataFrame, model: tuple[tuple, dict[str, float]], text_col: str = "text") -> DataFrame:
    """The rows with every span of the text replaced by its kind; a null text stays null, other columns stay, whatever their names."""
    names = docs.columns
    df = with_spans(docs.select(F.struct(*(F.col(c) for c in names)).alias("_whole"), F.col(text_col).alias("_raw")), model, "_raw")
    done = F.aggregate(
        "_spans",
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda a, s: F.when(s["end"] <= a["at"], a).otherwise(
            F.struct(s["end"].alias("at"), F.concat(a["out"], F.substring(F.col("_text"), a["at"] + 1, F.greatest(s["start"] - a["at"], F.lit(0))), F.lit("<"), F.upper(s["kind"]), F.lit(">")).alias("out"))
        ),
        lambda a: F.concat(a["out"], F.substring(F.col("_text"), a["at"] + 1, F.lit(2**31 - 1))),
    )
    text = F.when(F.col("_raw").isNull() | (F.size("_spans") == 0), F.col("_raw")).otherwise(done)
    return df.select(*(text.alias(c) if c == text_col else F.col("_whole")[c].alias(c) for c in names))
