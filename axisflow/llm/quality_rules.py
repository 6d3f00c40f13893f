"""Quality rules as a learned decision list, in DataFrame functions only.

Statistics of each text are Spark expressions. From those of labelled rows, sequential covering grows
conjunctions of thresholds that pick out bad rows, prunes each on rows it was not grown from, and removes
what it covers; the ordered rules become one conditional expression.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from axisflow.llm.shared import SPACE

SYMBOLS = r"[#*$%&|<>]"  # fixed value
WINDOW = 5

FEATURES = ("n_words", "word_length", "symbol_share", "repeat_share", "dup_line_share", "distinct_share", "upper_share", "digit_share", "mark_share", "line_words")


def with_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds the base counts n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the ratios in `FEATURES`.

    A null text has no words. Repeated windows are found by comparing digests of words in one pass; only
    texts that have any are sorted to count the words they cover, so long texts cost little more than
    their length.
    """
    w = WINDOW
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    df = docs.withColumn("_text", text).withColumn("_words", F.array_remove(F.split("_text", f"{SPACE}+", -1), ""))
    df = df.withColumn("_h", F.transform("_words", lambda x: F.xxhash64(x)))
    df = df.withColumn("n_words", F.size("_words").cast("long")).withColumn("word_chars", F.char_length(F.array_join("_words", "")).cast("long"))
    df = df.withColumn("n_symbols", F.regexp_count("_text", F.lit(SYMBOLS)).cast("long"))
    df = df.withColumn("_lines", F.filter(F.split("_text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    df = df.withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long")).withColumn("_n_lines", F.size("_lines"))
    h = F.col("_h")
    windows = F.transform(F.slice("_h", F.lit(1), F.greatest(F.col("n_words") - (w - 1), F.lit(0)).cast("int")), lambda x, i: F.xxhash64(x, *(h[i + j] for j in range(1, w))))
    df = df.withColumn("_w", windows)
    placed = F.sort_array(F.transform("_w", lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
    none = F.array().cast("array<struct<h:bigint,p:int>>")
    df = df.withColumn("_s", F.when(F.size(F.array_distinct("_w")) < F.size("_w"), placed).otherwise(none))
    s = F.col("_s")
    last = F.size("_s") - 1
    again = F.transform("_s", lambda x, i: F.when((F.when(i > 0, s[i - 1]["h"]) == x["h"]) | (F.when(i < last, s[i + 1]["h"]) == x["h"]), x["p"]))
    starts = F.sort_array(F.filter(again, lambda x: x.isNotNull()))
    covered = F.aggregate(
        starts,
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda a, p: F.struct((p + w).alias("end"), (a["n"] + p + w - F.greatest(p, a["end"])).alias("n")),
        lambda a: a["n"],
    )
    df = df.withColumn("n_repeat_words", covered.cast("long"))
    n, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    count = lambda p: F.regexp_count("_text", F.lit(p))
    return df.select(
        "*",
        (F.col("word_chars") / n).alias("word_length"),
        (F.col("n_symbols") / n).alias("symbol_share"),
        (F.col("n_repeat_words") / n).alias("repeat_share"),
        (F.col("n_dup_lines") / F.greatest("_n_lines", F.lit(1))).alias("dup_line_share"),
        (F.size(F.array_distinct("_h")) / n).alias("distinct_share"),
        (count("[A-Z]") / chars).alias("upper_share"),
        (count("[0-9]") / chars).alias("digit_share"),
        (count("[!?]") / n).alias("mark_share"),
        (F.col("n_words") / F.greatest("_n_lines", F.lit(1))).alias("line_words"),
    ).drop("_text", "_words", "_h", "_lines", "_n_lines", "_w", "_s")


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


@dataclass(frozen=True)
class Test:
    feature: str
    above: bool
    threshold: float

    def __call__(self, row: dict) -> bool:
        return row[self.feature] > self.threshold if self.above else row[self.feature] <= self.threshold

    def column(self) -> Column:
        c = F.col(self.feature)
        return c > F.lit(self.threshold) if self.above else c <= F.lit(self.threshold)


Rule = tuple[Test, ...]


def covers(rule: Rule, row: dict) -> bool:
    return all(t(row) for t in rule)


def grow(rows: list[tuple[dict, bool]], cuts: int, most: int) -> Rule:
    """Adds the test of the highest information gain until no good row is covered."""
    rule: list[Test] = []
    while len(rule) < most and any(not bad for _, bad in rows):
        p = sum(bad for _, bad in rows)
        n = len(rows) - p
        if not p:
            break
        before, best = math.log2(p / (p + n)), (0.0, None)
        for f in FEATURES:
            values = sorted({r[f] for r, _ in rows})
            middles = [(a + b) / 2 for a, b in zip(values, values[1:])]
            for t in middles[:: max(1, len(middles) // cuts)]:
                up = sum(bad for r, bad in rows if r[f] > t), sum(not bad for r, bad in rows if r[f] > t)
                for above, (pp, nn) in ((True, up), (False, (p - up[0], n - up[1]))):
                    if pp and (gain := pp * (math.log2(pp / (pp + nn)) - before)) > best[0] + 1e-9:
                        best = gain, Test(f, above, t)
        if not best[1]:
            break
        rule.append(best[1])
        rows = [x for x in rows if best[1](x[0])]
    return tuple(rule)


def prune(rule: Rule, rows: list[tuple[dict, bool]]) -> Rule:
    """The shortest beginning of the rule of the best worth (p - n) / (p + n) on rows held back."""

    def worth(r: Rule) -> float:
        hit = [bad for x, bad in rows if covers(r, x)]
        return (2 * sum(hit) - len(hit)) / len(hit) if hit else -1.0

    return max((rule[:k] for k in range(1, len(rule) + 1)), key=lambda r: (worth(r), -len(r)), default=())


def decision_list(rows: list[tuple[dict, bool]], most_rules: int = 8, most_tests: int = 4, cuts: int = 24, precision: float = 0.9, least: int = 4) -> list[Rule]:
    """Rules for bad rows, in order; a rule stays if `precision` of the rows it newly covers are bad, at least `least`."""
    rules: list[Rule] = []
    for k in range(most_rules):
        growing, held = [x for i, x in enumerate(rows) if (i + k) % 3], [x for i, x in enumerate(rows) if not (i + k) % 3]
        if sum(bad for _, bad in growing) < least:
            break
        rule = prune(grow(growing, cuts, most_tests), held)
        hit = [bad for x, bad in rows if covers(rule, x)] if rule else []
        if len(hit) < least or sum(hit) < precision * len(hit):
            break
        rules.append(rule)
        rows = [x for x in rows if not covers(rule, x[0])]
    return rules


def as_column(rules: list[Rule]) -> Column:
    """The ordered conditional expression: true for rows that no rule rejects."""
    out: Column | None = None
    for rule in rules:
        test = rule[0].column()
        for t in rule[1:]:
            test = test & t.column()
        out = F.when(test, False) if out is None else out.when(test, False)
    return F.lit(True) if out is None else out.otherwise(True)


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = 3000) -> list[Rule]:
    """Learns the rules from at most `sample` labelled rows, those of the smallest id hashes (0: bad, 1: good).

    Null ids and labels are left out; an id that comes several times counts once; without rows of both labels there are no rules.
    """
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y")).filter("_id is not null and _y in (0, 1)").distinct()
    picked = [(r["_id"], r["_y"]) for r in known.orderBy(F.xxhash64("_id"), "_id").limit(sample).collect()]
    if len({y for _, y in picked}) < 2:
        return []
    chosen = F.broadcast(docs.sparkSession.createDataFrame(picked, known.schema))  # at most `sample` numbers
    texts = docs.select(F.col(id_col).alias("_doc"), F.col(text_col).alias("text"))
    joined = texts.join(chosen, texts["_doc"] == chosen["_id"]).groupBy("_id", "_y").agg(F.min("text").alias("text"))  # one row for an id, however often it comes
    rows = with_statistics(joined).select("_id", "_y", base_failed().alias("_failed"), *FEATURES).collect()
    rows.sort(key=lambda r: (zlib.crc32(str(r["_id"]).encode()), r["_y"], tuple(r[f] for f in FEATURES)))
    return decision_list([({f: float(r[f]) for f in FEATURES}, r["_y"] == 0) for r in rows if not r["_failed"]])


def judge_quality(docs: DataFrame, rules: list[Rule], text_col: str = "text") -> DataFrame:
    """Adds the counts, base_failed and kept (the list's verdict on rows that pass the base).

    A null or empty text has no words and fails the base; repeated rows are judged alike; an empty table
    stays empty; columns of `docs` that have the name of an added one are replaced.
    """
    return with_statistics(docs, text_col).withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & as_column(rules))
