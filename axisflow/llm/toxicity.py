"""Toxicity by a weighted finite-state grammar over clauses.

Words and phrases become symbols by a weighted lexicon. Five sequential transducers, composed into one
machine, read a clause: insults that a copula predicates, threats that an intention announces, negation,
reported speech, and targets that come first; a second machine from the right finds targets that follow.
What a clause then scores is the sum of the weights it accepts, and a logistic curve over the clause
scores gives the document's. The lexicon starts from fixed words and learns further words and word
beginnings from labelled rows, each as an insult or a threat by the company it keeps.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from axisflow.llm.shared import give_back, lean

# The words that the grammar knows without labels.
INSULTS = "asshole bastard bitch clown cretin cunt degenerate dickhead disgusting dumb dumbass fool freak idiot imbecile jerk loser moron parasite pathetic pig retard scum scumbag slut stupid subhuman trash vermin whore worthless".split()
THREATS = "burn choke crush destroy hurt kill murder punish shoot slaughter smash stab strangle suffer".split()
TARGETS = "du ihr du's du're eres euch he her him she them they these those tu usted ustedes vos votre vous you your you're yourself youre".split()
NEGATIONS = "ain't aren't cannot don't isn't jamais kein keine ne never nicht no not nunca pas wasn't without".split()
REPORTS = "accused alleged called claimed diciendo dijo dit quoted reported sagte said says tweeted wrote".split()

INTENTIONS = "going gonna hope let's lets must shall should vais voy wait want will wirst werde wünsche".split()
COPULAS = "am are be bist eres es estás is like looks seid sind suis sois was were you're youre du's".split()
PHRASES = {"I": ["drop dead", "go to hell", "piece of trash", "piece of garbage", "shut up", "waste of space"], "T": ["burn in hell", "cut your throat", "end your life", "make you pay", "watch your back"]}

REACH = {"negation": 3, "target": 4, "copula": 4, "intention": 4}
#: Symbols: insult, threat verb, target, negation, report, intention, copula; then rewritten: predicated (P) and aimed (J) insult,
#: announced (H), aimed (U) and both (K) threat, negated (i, t), reported (q).
FACTORS = {"I": 1.0, "P": 1.2, "J": 1.4, "i": 0.15, "q": 0.35, "T": 0.25, "H": 0.6, "U": 0.6, "K": 1.2, "t": 0.05}
CLAUSE_END = (".", "!", "?", ";", ":", "…")
STRIP = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "«»“”‘’…¡¿–—"


class Transducer:
    """A sequential transducer: a start state and a step (state, symbol) -> (state, symbol)."""

    def __init__(self, start, step):
        self.start, self.step = start, step

    def then(self, other: Transducer) -> Transducer:
        """The composition: what this one writes, the other reads."""

        def step(state, symbol):
            a, symbol = self.step(state[0], symbol)
            b, symbol = other.step(state[1], symbol)
            return (a, b), symbol

        return Transducer((self.start, other.start), step)

    def table(self, symbols: Iterable[str]) -> dict:
        """All transitions that can be reached, worked out once."""
        symbols, out, todo = list(symbols), {}, [self.start]
        seen = {self.start}
        while todo:
            state = todo.pop()
            for s in symbols:
                out[state, s] = to = self.step(state, s)
                if to[0] not in seen:
                    seen.add(to[0])
                    todo.append(to[0])
        return out


def within(opener: str, reach: int, rewrite: dict[str, str]) -> Transducer:
    """Rewrites symbols that follow the opener at most `reach` words later."""

    def step(left: int, symbol: str) -> tuple[int, str]:
        if symbol == opener:
            return reach, symbol
        return max(0, left - 1), rewrite.get(symbol, symbol) if left else symbol

    return Transducer(0, step)


def since(opener: str, rewrite: dict[str, str]) -> Transducer:
    """Rewrites symbols that follow the opener anywhere in the clause."""
    return Transducer(0, lambda on, symbol: (1 if symbol == opener else on, rewrite.get(symbol, symbol) if on else symbol))


INPUT = ".ITYNRMC"
INSULT = within("C", REACH["copula"], {"I": "P"})
THREAT = within("M", REACH["intention"], {"T": "H"})
NEGATION = within("N", REACH["negation"], {"I": "i", "P": "i", "T": "t", "H": "t"})
REPORTED = since("R", {"I": "q", "P": "q", "T": "t", "H": "q"})
AIMED = within("Y", REACH["target"], {"I": "J", "P": "J", "T": "U", "H": "K"})
FORWARD = INSULT.then(THREAT).then(NEGATION).then(REPORTED).then(AIMED)
BACKWARD = AIMED
FORWARD_TABLE = FORWARD.table(INPUT)
BACKWARD_TABLE = BACKWARD.table(INPUT + "".join(FACTORS))


def run(start, table: dict, symbols: Iterable[str]) -> list[str]:
    out = []
    for s in symbols:
        start, s = table[start, s]
        out.append(s)
    return out


def clause_score(symbols: list[str], weights: list[float]) -> float:
    forward = run(FORWARD.start, FORWARD_TABLE, symbols)
    both = run(BACKWARD.start, BACKWARD_TABLE, reversed(forward))[::-1]
    return sum(FACTORS.get(s, 0.0) * w for s, w in zip(both, weights))


class Lexicon:
    """Symbol and weight of a word, by whole words and by beginnings of words; the answers for raw words are kept, at most `bound`."""

    def __init__(self, words: dict[str, float], beginnings: dict[str, float], threats: frozenset[str] = frozenset(), bound: int = 100_000):
        self.words: dict[str, tuple[str, float]] = {}
        for symbol, known in (("C", COPULAS), ("M", INTENTIONS), ("R", REPORTS), ("N", NEGATIONS), ("Y", TARGETS), ("T", THREATS), ("I", INSULTS)):
            self.words |= {w: (symbol, 4.0) for w in known}
        kind = lambda w: "T" if w in threats else "I"
        self.words |= {w: (kind(w), x) for w, x in words.items()}
        self.beginnings = {w: (kind(w), x) for w, x in beginnings.items()}
        self.phrases: dict[str, list[tuple[list[str], str]]] = {}
        for symbol, known in PHRASES.items():
            for first, *rest in map(str.split, known):
                self.phrases.setdefault(first, []).append((rest, symbol))
        self.lengths = sorted({len(w) for w in beginnings}, reverse=True)
        self.bound, self.known = bound, {}

    def __getstate__(self):
        return self.__dict__ | {"known": {}}

    def look(self, raw: str) -> tuple[str, float] | None:
        word = raw.lower().strip(STRIP)
        found = ("F", 0.0) if word in self.phrases else self.words.get(word)
        if not found:
            found = next((x for n in self.lengths if len(word) >= n and (x := self.beginnings.get(word[:n]))), None)
        if len(self.known) >= self.bound:
            self.known.clear()
        self.known[raw] = found
        return found

    def symbols(self, words: list[str]) -> list[tuple[str, float] | None]:
        """Symbol and weight of each word; the first word of a phrase stands for the whole of it."""
        get, missing = self.known.get, self.look
        out = [missing(w) if (x := get(w, 0)) == 0 else x for w in words]
        for i in [i for i, x in enumerate(out) if x and x[0] == "F"]:
            first, *_ = plain = [w.lower().strip(STRIP) for w in words[i : i + 6]]
            symbol = next((s for rest, s in self.phrases[first] if plain[1 : len(rest) + 1] == rest), None)
            out[i] = (symbol, 4.0) if symbol else self.words.get(first)
        return out


def features(text: str, lexicon: Lexicon) -> list[float]:
    """Of the clauses: sum and maximum of the scores (as logarithms), accepted clauses, and their share of the words."""
    words = text.split()
    found = lexicon.symbols(words)
    hits = [i for i, x in enumerate(found) if x and x[0] in "IT"]
    if not hits:
        return [0.0, 0.0, 0.0, 0.0]
    scores, done = [], -1
    for i in hits:
        if i <= done:
            continue
        a = i
        while a > 0 and not words[a - 1].endswith(CLAUSE_END):
            a -= 1
        b = i
        while b < len(words) - 1 and not words[b].endswith(CLAUSE_END):
            b += 1
        done = b
        part = found[a : b + 1]
        scores.append(clause_score([x[0] if x else "." for x in part], [x[1] if x else 0.0 for x in part]))
    return [math.log1p(sum(scores)), math.log1p(max(scores)), math.log1p(len(scores)), math.log1p(100 * sum(scores) / len(words))]


def word_features(text: str) -> tuple[set[str], set[str]]:
    words = {w for raw in text.lower().split() if (w := raw.strip(STRIP)) and w.isalpha()}
    return words, {w[:n] for w in words for n in range(3, min(8, len(w)))}


def learned(rows: list[tuple[str, int]], most: int = 500) -> tuple[dict[str, float], dict[str, float]]:
    """Words and beginnings that toxic rows have far more often than chance allows among all that were tried.

    Copies of a text would make all its words look telling, so those with one smallest shingle digest count once.
    """
    toxic, clean, total, seen = Counter(), Counter(), [0, 0], set()
    for text, label in rows:
        parts = text.split()
        key = min((xxhash.xxh3_64_intdigest(" ".join(parts[i : i + 3])) for i in range(max(1, len(parts) - 2))), default=0)
        if key in seen:
            continue
        seen.add(key)
        words, beginnings = word_features(text)
        (toxic if label else clean).update([f"w{w}" for w in words])
        (toxic if label else clean).update([f"b{w}" for w in beginnings])
        total[label] += 1
    n, p = total
    if not n or not p:
        return {}, {}
    least = 2 * math.log(max(10, len(toxic))) + 4
    kept = []
    for f, a in toxic.items():
        c = clean[f]
        if a < 3 or a * n < 8 * c * p:
            continue
        rate = (a + c) / (n + p)
        gain = 2 * (a * math.log(a / p / rate) + (c * math.log(c / n / rate) if c else 0.0))
        if gain >= least:
            weight = math.log((a + 0.5) / (p + 1)) - math.log((c + 0.5) / (n + 1))
            kept.append((gain, min(6.0, weight), f))
    kept.sort(key=lambda x: (-round(x[0], 6), x[2][0] == "b", -len(x[2]), x[2]))
    words, beginnings, longer = {}, {}, set()
    for _, weight, named in kept:
        kind, f = named[0], named[1:]
        if len(words) + len(beginnings) >= most:
            break
        # a shorter beginning says as much, or a longer one says more
        if f not in words and not any(f[:k] in beginnings for k in range(3, len(f) + 1)) and (kind == "w" or f not in longer):
            (words if kind == "w" else beginnings)[f] = weight
            longer.update(f[:k] for k in range(1, len(f)))
    return words, beginnings


def threats_among(found: Iterable[str], rows: list[tuple[str, int]]) -> frozenset[str]:
    """The learned words and beginnings that follow intentions more often than copulas in toxic rows."""
    found, first, seen = set(found), Lexicon({}, {}), Counter()
    lengths = {len(w) for w in found}
    for text, label in rows:
        if not label or not found:
            continue
        words = text.split()
        for i, raw in enumerate(words):
            word = raw.lower().strip(STRIP)
            for w in {word[:n] for n in lengths} & found:
                before = {x[0] for x in first.symbols(words[max(0, i - REACH["intention"]) : i]) if x}
                seen[w] += ("M" in before) - ("C" in before)
    return frozenset(w for w, n in seen.items() if n > 0)


#: Without labels: one plain insult is enough to be toxic, a negated or reported one is not.
DEFAULT_CURVE = (-3.0, 0.9, 1.6, 0.2, 0.4)


def fitted(xs: list[list[float]], ys: list[int], penalty: float = 1.0, rounds: int = 30, rates: tuple[float, float] | None = None) -> tuple[float, ...]:
    """Logistic regression by Newton's method, drawn towards the default curve.

    `rates` are how often clean and toxic rows occur where the sample is from; its rows weigh accordingly,
    1 on average.
    """
    if len(set(ys)) < 2:
        return DEFAULT_CURVE
    x, y = np.column_stack([np.ones(len(xs)), np.array(xs)]), np.array(ys, float)
    prior, w = np.array(DEFAULT_CURVE), np.array(DEFAULT_CURVE)
    weight = np.ones(len(y))
    if rates:
        weight = np.where(y == 1, rates[1] / y.mean(), rates[0] / (1 - y.mean())) / sum(rates)

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float((weight * (np.logaddexp(0, z) - y * z)).sum() + penalty / 2 * ((w - prior) ** 2).sum())

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (weight * (p - y)) + penalty * (w - prior)
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + penalty * np.eye(x.shape[1]), gradient)
        size = 1.0
        while size > 1e-6 and loss(w - size * step) > loss(w):
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-6:
            break
    return tuple(w.tolist())


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = 3000) -> tuple[Lexicon, tuple[float, ...]]:
    """Learns lexicon and curve from at most `sample` labelled rows of either label, those of the smallest id hashes.

    The curve is fitted to the rates of all labelled rows, so that a score of 0.5 means the same whether
    or not a label has more rows than `sample`. Null labels and ids are left out; without any labels the fixed words and the default curve hold.
    """
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y")).filter("_id is not null and _y in (0, 1)").distinct()
    counts = {r["_y"]: r["count"] for r in known.groupBy("_y").count().collect()}
    some = [known.filter(F.col("_y") == y).orderBy(F.xxhash64("_id"), "_id").limit(sample) for y in (0, 1)]
    picked = [(r["_id"], r["_y"]) for part in some for r in part.collect()]
    if not picked:
        return Lexicon({}, {}), DEFAULT_CURVE
    chosen = F.broadcast(docs.sparkSession.createDataFrame(picked, known.schema))  # at most twice `sample` numbers
    texts = docs.select(F.col(id_col).alias("_doc"), F.col(text_col).cast("string").alias("text"))
    table = texts.join(chosen, texts["_doc"] == chosen["_id"]).groupBy("_doc", "_y").agg(F.min("text").alias("text")).select("text", "_y").toArrow()  # one row for an id, however often it comes
    rows = [(t or "", y) for t, y in zip(table.column(0).to_pylist(), table.column(1).to_pylist())]
    words, beginnings = learned(rows)
    lexicon = Lexicon(words, beginnings, threats_among([*words, *beginnings], rows))
    # the labelled rows with a text, a sample of each label: its rows stand for as many as the label has to each that was picked
    picks, here = Counter(y for _, y in picked), Counter(y for _, y in rows)
    rates = tuple(here[y] * counts[y] / picks[y] if picks[y] else 0.0 for y in (0, 1))
    curve = fitted([features(t, lexicon) for t, _ in rows], [y for _, y in rows], rates=rates)
    lexicon.known.clear()
    del rows, table
    give_back()
    return lexicon, curve


def score_toxicity(docs: DataFrame, model: tuple[Lexicon, tuple[float, ...]], text_col: str = "text", score_col: str = "score", keep: list[str] | None = None) -> DataFrame:
    """`keep` (default: all columns but one of the score's name) and the score, 0 to 1, of every whole text.

    A null or empty text scores as one without any match. Texts count, nothing else does; repeated rows
    score alike.
    """
    lexicon, curve = model
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)
    keep = [c for c in docs.columns if c != score_col] if keep is None else keep

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for value in batch.column(batch.num_columns - 1):
                z = curve[0] + sum(a * b for a, b in zip(curve[1:], features(value.as_py() or "", shared.value)))
                out.append(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, pa.float64())], names=[*batch.schema.names[:-1], "_score"])

    plain = docs.select(*(F.col(c).alias(f"_{i}") for i, c in enumerate(keep)), F.col(text_col).cast("string").alias("_text"))  # no name clashes
    schema = StructType([*plain.schema.fields[:-1], StructField("_score", DoubleType())])
    return plain.mapInArrow(lean(score), schema).toDF(*keep, score_col)


def held_out(id_col: str = "doc_id"):
    """Rows that no label is learned from."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0
