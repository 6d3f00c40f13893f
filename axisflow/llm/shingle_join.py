"""Exact Jaccard similarity join of documents on word n-grams, by token-combination prefixes.

Tokens are the distinct n-grams of a document. In one global order, rare tokens before frequent ones,
two documents that are similar enough must share, within short prefixes, either one rare token or a
combination of k frequent ones of one group: a prefix is extended until deleting all tokens that the
partner may lack leaves one such signature. So frequent tokens never make a bucket of their own.
Documents of one bucket are first held against the bucket's leader only; then just those pairs of a
bucket that are still in different classes are made. Every link is verified on the whole token sets.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from axisflow.llm.components import components
from axisflow.llm.shared import lean, salted_left_join, small_batches, written

M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
S32 = np.uint64(32)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> S32)) * M2
    h = (h ^ (h >> S32)) * M2
    return h ^ (h >> S32)


def token_set(data: bytes | None, words: int) -> np.ndarray:
    """Sorted 64-bit digests of the distinct n-grams; with fewer words, of the whole sequence; without any, none."""
    parts = data.lower().split() if data else []
    n = len(parts)
    if not n:
        return np.empty(0, np.uint64)
    if n < words:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(parts), seed=n)], np.uint64)
    h = mixed(np.fromiter(map(xxhash.xxh3_64_intdigest, parts), np.uint64, n))
    out = h[: n - words + 1]
    for j in range(1, words):
        out = (out ^ (out >> S32)) * M1 + h[j : n - words + 1 + j]
    return np.unique(mixed(out))


def slack(n: int, percent: int) -> int:
    """How many of its n tokens a document may have beside a partner of sufficient similarity."""
    return n - -(-percent * n // 100)


def groups_of(n: int, percent: int) -> list[int]:
    """Numbers of groups of frequent tokens under which a document of n tokens is indexed: one for its
    own size class, and one for that of its largest possible partner."""
    return sorted({max(1, (100 - percent) * (1 << (size.bit_length() - 1)) // 400) for size in (n, max(n, 100 * n // percent))})


def signatures(tokens: np.ndarray, percent: int, frequent: list[tuple[int, np.ndarray]]) -> np.ndarray:
    """Rare tokens as they are, and combinations of k frequent ones; `frequent` has k and sorted tokens by class."""
    n = len(tokens)
    need = slack(n, percent) + 1
    if n < 2:  # above 50 % its only partners have the same set
        return tokens[:0]
    rest, classes = tokens, []
    for k, known in reversed(frequent):
        if len(known):
            at = np.minimum(np.searchsorted(known, rest), len(known) - 1)
            hit = known[at] == rest
            classes.insert(0, (k, rest[hit]))
            rest = rest[~hit]
    if len(rest) >= need:
        return rest[:need]
    found = set()
    for m in groups_of(n, percent):
        have = len(rest)
        held: dict[tuple[int, int], list[int]] = defaultdict(list)
        for k, some in classes:
            for t in some.tolist():
                if have >= need:
                    break
                group = held[k, (t >> 24) % m]
                group.append(t)
                have += len(group) >= k
        if have < need:  # too few tokens for combinations: every token for itself
            found.update(tokens.tolist())
        for (k, _), group in held.items():
            found.update(xxhash.xxh3_64_intdigest(b"".join(t.to_bytes(8, "little") for t in c), seed=m * 8 + k) for c in combinations(group, k))
    return np.concatenate([rest, np.fromiter(found, np.uint64, len(found))])


def parity(tokens: np.ndarray) -> bytes:
    """A bitmap of which each bit is the parity of the tokens that fall on it, for a bound on differences."""
    bits = min(max(256, 1 << (2 * len(tokens) - 1).bit_length()), 1 << 14)
    return np.packbits((np.bincount(((tokens >> np.uint64(40)) % np.uint64(bits)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)).tobytes()


def may_link(na: int, nb: int, a: bytes, b: bytes, percent: int) -> bool:
    """False only if the bitmaps prove too many differences."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    while len(x) != len(y):
        big = x if len(x) > len(y) else y
        big = big[: len(big) // 2] ^ big[len(big) // 2 :]
        x, y = (big, y) if len(x) > len(y) else (x, big)
    common = (na + nb - int(np.bitwise_count(x ^ y).sum())) // 2
    return 100 * common >= percent * (na + nb - common)


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    common = len(np.intersect1d(x, y, assume_unique=True))
    return common > 0 and 100 * common >= percent * (len(x) + len(y) - common)


def long_array(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def profiles(docs: DataFrame, words: int, frequent: int, total: int, block: int = 2_000_000) -> DataFrame:
    """A row of each document (doc, n, digest of its set), and rows of tokens (doc is null) that a
    block of documents repeats often enough to make them candidates for the frequent classes."""

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def repeated(sets: list[np.ndarray], rows: int) -> pa.RecordBatch:
            every = np.concatenate(sets)
            sets.clear()
            every.sort()
            first = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
            counts = np.diff(first, append=len(every))
            tokens = every[first]
            keep = counts >= max(4, frequent * rows // (2 * max(total, 1)))
            tokens, counts = tokens[keep], counts[keep]
            none = pa.nulls(len(tokens), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(long_array(tokens)), pa.array(counts.astype(np.int64)), none, pa.array(np.ones(len(tokens), bool))], names=["doc", "n", "digest", "token"])

        sets, held, rows = [], 0, 0
        for batch in batches:
            sizes, digests = [], []
            for text in batch.column(1):
                tokens = token_set(text.as_py(), words)
                sizes.append(len(tokens))
                digests.append(xxhash.xxh3_128_digest(tokens.tobytes()) if len(tokens) else None)
                sets.append(tokens)
                held += len(tokens)
                rows += 1
                if held >= block:
                    yield repeated(sets, rows)
                    held, rows = 0, 0
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(np.zeros(len(sizes), bool))], names=["doc", "n", "digest", "token"])
        if held:
            yield repeated(sets, rows)

    return docs.mapInArrow(lean(profile), "doc long, n long, digest binary, token boolean")


def frequent_tokens(counts: DataFrame, least: int, bound: int) -> np.ndarray:
    """At most `bound` of the most frequent tokens: all whose count reaches the smallest power-of-two multiple of `least` at which they fit."""
    level = F.floor(F.log2(F.col("n") / least))
    sizes = {r["level"]: r["count"] for r in counts.filter(F.col("n") >= least).groupBy(level.alias("level")).count().collect()}
    at, total = 64, 0
    while at > 0 and total + sizes.get(at - 1, 0) <= bound:
        at -= 1
        total += sizes.get(at, 0)
    found = counts.filter(F.col("n") >= least * 2.0**at).select("token").toArrow().column("token").to_numpy()
    return np.sort(found.view(np.uint64))


def similarity_classes(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80, frequent: int = 64, very_frequent: int = 2048, token_bound: int = 250_000, small: int = 32
) -> DataFrame:
    """doc_id, n_shingles and component_id of every row; documents link at a Jaccard similarity of `percent` hundredths or more.

    A-Z count as a-z; words are separated by ASCII white space. A null, empty or wordless text has an
    empty set and no links; a text of fewer words than `words` is one shingle. component_id is the
    smallest id reachable over links. Rows that share an id are one document; rows with a null id get
    the class of equal texts, else null. Extra columns are ignored. `token_bound` limits the tokens that
    are broadcast as frequent; like `small`, the size of a bucket whose pairs are made as rows, it bears
    on speed only, any choice gives the same links. `percent` is above 50, at most 100.
    """
    if not 50 < percent <= 100:
        raise ValueError("percent must be above 50 and at most 100")
    spark = docs.sparkSession
    with small_batches(spark):
        return _classes(docs, id_col, text_col, words, percent, frequent, very_frequent, token_bound, small)


def _classes(docs: DataFrame, id_col: str, text_col: str, words: int, percent: int, frequent: int, very_frequent: int, token_bound: int, small: int) -> DataFrame:
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").cast("binary").alias("text"))
    seen = written(profiles(rows, words, frequent, rows.count()), "profiles")
    own = seen.filter("not token").select("doc", "n", "digest")
    counts = seen.filter("token").groupBy(F.col("doc").alias("token")).agg(F.sum("n").alias("n")).filter(F.col("n") >= frequent)
    counts = written(counts, "tokens")
    often, rest = frequent_tokens(counts.filter(F.col("n") < very_frequent), frequent, token_bound), frequent_tokens(counts, very_frequent, token_bound)
    classes = spark.sparkContext.broadcast([(2, often), (3, rest)])

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                out = []
                for doc, text in zip(batch.column(0)[at : at + 1000].to_pylist(), batch.column(1)[at : at + 1000]):
                    tokens = token_set(text.as_py(), words)
                    if len(tokens):
                        out.append((xxhash.xxh3_128_digest(tokens.tobytes()), doc, len(tokens), parity(tokens), long_array(signatures(tokens, percent, classes.value))))
                cols = list(zip(*out)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64())))], names=["digest", "doc", "n", "bits", "keys"])

    indexed = rows.filter("doc is not null and text is not null").mapInArrow(lean(index), "digest binary, doc long, n long, bits binary, keys array<long>")
    reps = written(indexed.groupBy("digest").agg(F.min(F.struct("doc", "n", "bits", "keys")).alias("r")).select("r.*"), "representatives")
    keyed = reps.select(F.explode("keys").alias("key"), "doc", "n")
    leaders = written(keyed.groupBy("key").agg(F.min(F.struct("doc", "n")).alias("l"), F.count(F.lit(1)).alias("size")).filter("size > 1").select("key", F.col("l.doc").alias("leader"), F.col("l.n").alias("leader_n"), "size"), "leaders")
    buckets = written(keyed.join(leaders, "key").select("key", "doc", "n", "leader", "leader_n", "size"), "buckets")

    # each document against one leader, the smallest; much of a large group is of one class then
    stars = buckets.filter("doc <> leader").filter(near("n", "leader_n", percent)).groupBy("doc").agg(F.min("leader").alias("leader"))
    links = verified(stars.select(F.col("leader").alias("a"), F.col("doc").alias("b")), reps, rows, words, percent)
    class_of = components(links)

    # then all pairs of a bucket that are of different classes
    classed = buckets.select("key", "doc", "n", "size").join(class_of, "doc", "left").withColumn("comp", F.coalesce("comp", "doc"))
    open_keys = classed.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).filter("x <> y").select("key")
    many = written(classed.join(written(open_keys, "keys"), "key"), "open")
    if not many.isEmpty():
        x, y = (many.filter(F.col("size") <= small).select("key", *(F.col(c).alias(f"{c}_{s}") for c in ("doc", "n", "comp"))) for s in "ab")
        cross = x.join(y, "key").filter("doc_a < doc_b and comp_a <> comp_b").filter(near("n_a", "n_b", percent)).select(F.col("doc_a").alias("a"), F.col("doc_b").alias("b"))
        more = verified(cross.unionByName(close_pairs(many.filter(F.col("size") > small), reps, percent)).distinct(), reps, rows, words, percent)
        if not more.isEmpty():
            class_of = components(links.unionByName(more))

    copies = own.filter("digest is not null").groupBy("digest").agg(F.min("doc").alias("doc"), F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    copies = copies.join(class_of, "doc", "left").select("digest", F.coalesce("comp", "doc").alias("shared"))
    out = salted_left_join(own, written(copies, "copies"), ["digest"], F.monotonically_increasing_id(), 32)
    return out.join(class_of, "doc", "left").select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("shared", "comp", "doc").alias("component_id"))


def near(x: str, y: str, percent: int):
    """Whether sets of these sizes can be similar enough."""
    return F.expr(f"100 * least({x}, {y}) >= {percent} * greatest({x}, {y})")


def close_pairs(members: DataFrame, reps: DataFrame, percent: int, chunk: int = 2048) -> DataFrame:
    """Pairs (a, b) of large buckets that are of different classes and that bitmaps do not prove apart.

    A bucket is cut into chunks of about `chunk` members; a task compares two of these, in memory, and
    lets only the survivors out, so that no bucket is ever in one task or written as pairs.
    """

    def compare(table: pa.Table) -> pa.Table:
        n = table.column("n").to_numpy()
        order = np.argsort(n, kind="stable")
        n, doc, comp, part = n[order], table.column("doc").to_numpy()[order], table.column("comp").to_numpy()[order], table.column("part").to_numpy()[order]
        bits = table.column("bits").take(pa.array(order)).to_pylist()
        size = np.array([len(b) for b in bits])
        same = len(np.unique(part)) == 1
        out_a, out_b = [], []
        for width in np.unique(size).tolist():
            rows = np.flatnonzero(size == width)
            own = np.frombuffer(b"".join(bits[i] for i in rows), np.uint64).reshape(len(rows), -1)
            wide = np.flatnonzero(size == 2 * width)
            halves = np.frombuffer(b"".join(bits[i] for i in wide), np.uint64).reshape(len(wide), 2, -1) if len(wide) else np.empty((0, 2, width // 8), np.uint64)
            others, them = np.concatenate([own, halves[:, 0] ^ halves[:, 1]]), np.concatenate([rows, wide])
            for k, i in enumerate(rows.tolist()):
                last = np.searchsorted(n, 100 * n[i] // percent, side="right")
                some = np.flatnonzero((them > i) & (them < last) & (comp[them] != comp[i]) & (same | (part[them] != part[i])))
                if len(some):
                    apart = np.bitwise_count(others[some] ^ own[k]).sum(axis=1).astype(np.int64)
                    common = (n[i] + n[them[some]] - apart) // 2
                    hit = them[some[100 * common >= percent * (n[i] + n[them[some]] - common)]]
                    out_a.append(np.minimum(doc[i], doc[hit]))
                    out_b.append(np.maximum(doc[i], doc[hit]))
        empty = [np.empty(0, np.int64)]
        return pa.table({"a": pa.array(np.concatenate(out_a or empty)), "b": pa.array(np.concatenate(out_b or empty))})

    parts = F.ceil(F.col("size") / chunk).cast("int")
    part = F.pmod(F.xxhash64("doc"), parts).cast("int")
    cells = members.join(reps.select("doc", "bits"), "doc").withColumn("part", part).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    cells = cells.select("key", F.least("part", "other").alias("u"), F.greatest("part", "other").alias("v"), "doc", "n", "comp", "part", "bits")
    return cells.groupBy("key", "u", "v").applyInArrow(compare, "a long, b long")


def verified(pairs: DataFrame, reps: DataFrame, rows: DataFrame, words: int, percent: int, share: int = 1024) -> DataFrame:
    """The pairs (a, b) that really link: first a proof by bitmaps that most do not, then the whole sets."""

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = batch.column("n_a").to_pylist(), batch.column("n_b").to_pylist()
            keep = [may_link(p, q, x.as_py(), y.as_py(), percent) for p, q, x, y in zip(na, nb, batch.column("bits_a"), batch.column("bits_b"))]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                found = [token_set(t.as_py(), words).tobytes() for t in part.column("text")]
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in part.schema.names if k != "text"), pa.array(found, pa.binary())], names=[*(k for k in part.schema.names if k != "text"), "tokens"])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [linked(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64), percent) for x, y in zip(batch.column("tokens_a"), batch.column("tokens_b"))]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    side = lambda s: reps.select(F.col("doc").alias(s), F.col("n").alias(f"n_{s}"), F.col("bits").alias(f"bits_{s}"))
    pairs = pairs.join(side("b"), "b").join(side("a"), "a").mapInArrow(lean(prune), "a long, b long")
    pairs = written(pairs, "pairs")
    # a document with very many partners stands once for each `share` of them, so that no task gets them all
    text = rows.select(F.col("doc"), "text")
    parts = written(pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / share).alias("parts")), "parts")
    lefts = text.join(parts.withColumnRenamed("a", "doc"), "doc").select(F.col("doc").alias("a"), "parts", "text").mapInArrow(lean(sets), "a long, parts long, tokens binary")
    lefts = lefts.select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.col("tokens").alias("tokens_a"))
    dealt = pairs.join(parts.filter("parts > 1"), "a", "left").select("a", "b", F.pmod(F.xxhash64("b"), F.coalesce("parts", F.lit(1).cast("long"))).alias("part"))
    rights = text.withColumnRenamed("doc", "b").join(dealt, "b").select("a", "b", "part", "text").mapInArrow(lean(sets), "a long, b long, part long, tokens binary").withColumnRenamed("tokens", "tokens_b")
    return written(rights.join(lefts, ["a", "part"]).mapInArrow(lean(check), "a long, b long"), "links")
