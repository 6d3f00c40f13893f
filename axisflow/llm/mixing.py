"""Mixing sources to target weights.

The words of a source are one stream, packed into blocks of fixed length. Every source gets a quota of
block slots. Output shards have a fixed number of slots; a multinomial draw by the quotas says how many of
them each source has in a shard, and what draws miss of a quota goes into last shards. The slots of a
source, numbered through, map by pseudorandom permutations of its block indexes, one a pass, to blocks, so
that no block comes up again before all others did. Slots and blocks meet in a join by index.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from axisflow.llm.shared import lean, written

WEIGHTS = (1, 2, 3)


def n_words(text: Column) -> Column:
    """Number of runs without ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def weighted(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """Adds `rank`, the place of a source by code point (null last), and the weight due to it.

    Ranks come from the sizes of range partitions, so that no task sees more than its own.
    """
    ranged = written(sizes.repartitionByRange(F.col("source").isNull(), F.col("source")).sortWithinPartitions(F.col("source").isNull(), "source").withColumn("_row", F.monotonically_increasing_id()), "ranged")
    part = F.shiftright("_row", 33)
    counts = sorted((r["part"], r["count"]) for r in ranged.groupBy(part.alias("part")).count().collect())
    before, total = {}, 0
    for p, n in counts:
        before[p] = total
        total += n
    if not before:
        return ranged.select("*", F.lit(0).cast("long").alias("rank"), F.lit(1.0).alias("weight")).drop("_row")
    base = F.element_at(F.create_map(*(F.lit(x) for kv in before.items() for x in kv)), part)
    rank = base + F.col("_row") - F.shiftleft(part, 33)
    cycle = F.array(*(F.lit(float(w)) for w in weights))
    return ranged.withColumn("rank", rank).withColumn("weight", F.element_at(cycle, (F.pmod("rank", F.lit(len(weights))) + 1).cast("int"))).drop("_row")


def targets(sizes: DataFrame, share: float, cap: float) -> DataFrame:
    """Adds `target`: `share` of all words by weight, none above `cap` times its source's, the excess dealt anew by weight."""
    capped = F.lit(False)
    total = sizes.agg(F.sum("source_size")).first()[0] or 0
    n = -1
    while True:
        row = sizes.select(capped.alias("c"), "source_size", "weight").agg(
            F.sum(F.when(F.col("c"), F.col("source_size") * F.lit(cap))).alias("held"), F.sum(F.when(~F.col("c"), F.col("weight"))).alias("weight"), F.sum(F.col("c").cast("long")).alias("n")
        ).first()
        level = (total * share - (row["held"] or 0.0)) / row["weight"] if row["weight"] else 0.0
        if row["n"] == n or row["n"] is None:
            break
        n = row["n"]
        capped = capped | (F.col("weight") * F.lit(level) > F.col("source_size") * F.lit(cap))
    return sizes.withColumn("target", F.when(capped, F.col("source_size") * F.lit(cap)).otherwise(F.col("weight") * F.lit(level)).cast("double"))


def permuted(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """A pseudorandom permutation of 0..n-1 at the given indexes: a Feistel network over the next even power of two, walked until it is below n."""
    half = np.uint64(max(1, -(-max(n - 1, 1).bit_length() // 2)))
    mask = (np.uint64(1) << half) - np.uint64(1)
    keys = [np.uint64(xxhash.xxh3_64_intdigest(r.to_bytes(1, "little"), seed=key)) for r in range(4)]

    def step(x: np.ndarray) -> np.ndarray:
        left, right = x >> half, x & mask
        for k in keys:
            f = (right ^ k) * np.uint64(0x9E3779B97F4A7C15)
            f = (f ^ (f >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((f >> np.uint64(32)) & mask)
        return (left << half) | right

    out = step(index.astype(np.uint64))
    while (far := out >= np.uint64(n)).any():
        out[far] = step(out[far])
    return out.astype(np.int64)


def dealt(docs: DataFrame, id_col: str, text_col: str, source_col: str, block_words: int, shard_slots: int, share: float, cap: int, seed: int, parts: int, part_rows: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows placed in their streams, the slots, and each row's words of each block that has slots: from `first` to before `last`, `times` over."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), n_words(F.col(text_col).cast("string")).alias("size"), F.xxhash64(F.lit(seed), id_col, text_col).alias("order"))
    rows = written(rows, "sizes")
    parts = max(parts, rows.count() // part_rows)
    rows = rows.withColumn("part", F.pmod("order", F.lit(parts)))
    shares = rows.groupBy("source", "part").agg(F.sum("size").alias("words"))
    shares = written(shares, "shares")
    sizes = shares.groupBy("source").agg(F.sum("words").alias("source_size"))
    sources = written(targets(weighted(sizes), share, cap), "targets")

    # where each part of a source's stream begins: as many rows a source as it has parts
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    begins = shares.withColumn("begin", F.coalesce(F.sum("words").over(before), F.lit(0)))
    known = begins.join(sources, begins.source.eqNullSafe(sources.source)).select(sources.source, "rank", "source_size", "target", "part", "begin")
    known = written(known, "parts")

    stream = rows.join(known, rows.source.eqNullSafe(known.source) & (rows.part == known.part)).select("doc_id", rows.source, "rank", rows.part, "size", "order", "source_size", "target", "begin")
    so_far = Window.partitionBy("rank", "part").orderBy("order", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = stream.withColumn("end", F.col("begin") + F.sum("size").over(so_far)).withColumn("start", F.col("end") - F.col("size")).withColumn("row", F.xxhash64("rank", "start", "doc_id", "order"))
    placed = written(placed, "stream")

    slots = slots_of(sources, block_words, shard_slots, cap, seed)
    times = slots.groupBy(F.col("source_rank").alias("rank"), F.col("block").alias("at")).agg(F.count(F.lit(1)).alias("times"))

    first, last = F.floor(F.col("start") / block_words), F.floor((F.col("end") - 1) / block_words)
    spans = placed.filter("size > 0").select("rank", "doc_id", "start", "end", "row", F.explode(F.sequence(first, last)).alias("at"))
    begin = F.col("at") * block_words
    words = (F.greatest(F.col("start"), begin) - F.col("start")).alias("first"), (F.least(F.col("end"), begin + block_words) - F.col("start")).alias("last")
    # Spark takes rows that a few counts expand to for few: both sides are large
    return placed, slots, spans.join(times.hint("merge"), ["rank", "at"]).select("rank", "doc_id", "start", "row", *words, "times")


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block_words: int = 64, shard_slots: int = 1 << 14, share: float = 1.0, cap: int = 3, seed: int = 20, parts: int = 64, part_rows: int = 1_000_000) -> tuple[DataFrame, DataFrame]:
    """Documents with what the mix takes of them, and the mix itself.

    First: doc_id, source, size, source_size, target and taken (words, repeats counted) of every row.
    Second: shard, slot, source_rank, block of every slot. A null or empty text has no words and is taken
    0 times; a null source is a source of its own; repeated rows count each, and rows with null ids are
    placed by their text; extra columns are ignored. The same table gives the same mix: the order of a
    stream is by hash and id, and draws and permutations depend on seed and source only. `cap` is an
    integer, so that a block is in at most `cap` passes.
    """
    placed, slots, pieces = dealt(docs, id_col, text_col, source_col, block_words, shard_slots, share, cap, seed, parts, part_rows)
    taken = pieces.groupBy("rank", "start", "row").agg(F.sum((F.col("last") - F.col("first")) * F.col("times")).alias("taken"))
    taken = taken.withColumn("some", F.lit(True))
    out = placed.withColumn("some", F.col("size") > 0).join(taken, ["rank", "start", "row", "some"], "left")
    return out.select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken")), slots


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def cut_text(text: str, pieces: list[tuple[int, int, int]]) -> list[str]:
    """The text of each pass: the words of the pieces (first, last, times) that are taken as often; where words are left out, a line ends."""
    words = [m.span() for m in WORD.finditer(text)]
    out = []
    for turn in range(1, max(p[2] for p in pieces) + 1):
        runs: list[list[int]] = []
        for a, b, n in pieces:
            if n < turn:
                continue
            if runs and runs[-1][1] == a:
                runs[-1][1] = b
            else:
                runs.append([a, b])
        out.append(text if runs == [[0, len(words)]] else "\n".join(text[words[a][0] : words[b - 1][1]] for a, b in runs))
    return out


def mix_texts(docs: DataFrame, id_col: str, text_col: str = "text", source_col: str = "source", block_words: int = 64, shard_slots: int = 1 << 14, share: float = 1.0, cap: int = 3, seed: int = 20, parts: int = 64, part_rows: int = 1_000_000) -> DataFrame:
    """The words of the mix's blocks, as rows of `docs`: one for each document and pass, with those words of its text that the pass takes.

    So the words of a source sum to those of its slots. `id_col` is not null and tells different rows
    apart; equal rows may share it and are taken each. Columns are those of `docs`; documents of which
    nothing is taken have no row.
    """
    _, _, pieces = dealt(docs, id_col, text_col, source_col, block_words, shard_slots, share, cap, seed, parts, part_rows)
    taken = pieces.groupBy("rank", "start", "row", "doc_id").agg(F.sort_array(F.collect_list(F.struct("first", "last", "times"))).alias("_axisflow_pieces")).select(F.col("doc_id").alias(id_col), "_axisflow_pieces")
    at = docs.columns.index(text_col)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                part = batch.slice(begin, 256)
                rows, texts = [], []
                for i, (text, pieces) in enumerate(zip(part.column(at).to_pylist(), part.column(part.num_columns - 1).to_pylist())):
                    found = cut_text(text, [(p["first"], p["last"], p["times"]) for p in pieces])
                    rows += [i] * len(found)
                    texts += found
                columns = [c.take(pa.array(rows, pa.int64())) for c in part.columns[:-1]]
                columns[at] = pa.array(texts, pa.string())
                yield pa.RecordBatch.from_arrays(columns, names=part.schema.names[:-1])

    plain = docs.withColumn(text_col, F.col(text_col).cast("string"))
    return plain.dropDuplicates([id_col]).join(taken, id_col).select(*docs.columns, "_axisflow_pieces").mapInArrow(lean(cut), plain.schema)


def slots_of(sources: DataFrame, block_words: int, shard_slots: int, cap: int, seed: int, max_sources: int = 1_000_000) -> DataFrame:
    """shard, slot (its number among the source's), source_rank and block of each slot. Two numbers a source come to the driver, for at most `max_sources`."""
    spark = sources.sparkSession
    blocks = F.ceil(F.col("source_size") / block_words)
    passes = F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(cap))
    part = F.col("target") - passes * F.col("source_size")
    quota = F.least(passes * blocks + F.round(part * blocks / F.col("source_size")), blocks * cap).cast("long")
    due = sources.filter("source_size > 0").select("rank", blocks.cast("long").alias("blocks"), quota.alias("quota"))
    due = written(due, "quotas")
    n = due.count()
    if n > max_sources:
        raise ValueError(f"{n} sources are more than {max_sources}")
    table = due.select("rank", "quota").orderBy("rank").toArrow()
    ranks, quotas = (table.column(i).to_numpy() for i in range(2))
    total = int(quotas.sum())
    shards, chances = -(-total // shard_slots), spark.sparkContext.broadcast((ranks, np.cumsum(quotas) / max(total, 1)))

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, upto = chances.value
        for batch in batches:
            for shard in batch.column(0).to_pylist():
                size = min(shard_slots, total - shard * shard_slots)
                at, counts = np.unique(np.searchsorted(upto, np.random.default_rng([seed, shard]).random(size), side="right"), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(names[at]), pa.array(np.full(len(at), shard)), pa.array(counts.astype(np.int64))], names=["rank", "shard", "n"])

    drawn = written(spark.range(0, shards, 1, max(1, shards // 64)).mapInArrow(lean(draw), "rank long, shard long, n long"), "draws")
    got = {r["rank"]: r["n"] for r in drawn.groupBy("rank").agg(F.sum("n").alias("n")).collect()}  # a row a source
    missed, held = [], 0
    for rank, quota in zip(ranks.tolist(), quotas.tolist()):
        lack = quota - got.get(rank, 0)
        while lack > 0:
            n = min(lack, shard_slots - held % shard_slots)
            missed.append((rank, shards + held // shard_slots, n))
            held, lack = held + n, lack - n
    before = Window.partitionBy("rank").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    every = drawn.unionByName(spark.createDataFrame(missed, drawn.schema)).withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0).cast("long")))
    drawn = every.join(due, "rank").withColumn("n", F.least("n", F.col("quota") - F.col("first"))).filter("n > 0").select("rank", "blocks", "shard", "first", "n")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rank, blocks, shard, first, n in zip(*(c.to_pylist() for c in batch.columns)):
                for at in range(first, first + n, 1 << 16):
                    slot = np.arange(at, min(at + (1 << 16), first + n))
                    block = np.empty(len(slot), np.int64)
                    for turn in np.unique(slot // blocks).tolist():
                        here = slot // blocks == turn
                        block[here] = permuted(slot[here] % blocks, blocks, xxhash.xxh3_64_intdigest(f"{seed}:{rank}:{turn}"))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(slot), shard)), pa.array(slot), pa.array(np.full(len(slot), rank)), pa.array(block)], names=["shard", "slot", "source_rank", "block"])

    return drawn.repartition(1 + total // (16 * shard_slots), "rank", "shard").mapInArrow(lean(place), "shard long, slot long, source_rank long, block long")
