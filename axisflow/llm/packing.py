"""Retrieval packing: related documents share a window.

Documents are tokenized, and counted: idf and mean length are those of the whole table. A content key
that favours rare terms brings documents that share them next to each other; runs in that order are the
shards, each with a BM25 inverted index of its documents. In a shard a seed document opens a window, the
index returns its unused neighbours, and they fill the window greedily, the last one cut to fit. What no
longer fills a window goes into sequences of powers of two, so that nothing is padded.
"""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from axisflow.llm.shared import lean, small_batches, written

END = 1  # fixed value: the id that ends a document
MARK, STOP = "\x01", "\x02"
#: Letters from U+00C0 to U+024F whose lower-case form is one letter there.
LATIN = "".join(c for c in map(chr, range(0xC0, 0x250)) if c.isalpha() and len(c.lower()) == 1 and c.lower() < "\u0250")
#: Words with anything but printable ASCII characters and these letters.
OTHER = f"[^!-~{LATIN}]"
#: Fixed value: what the tokenizer takes as one word each, among these characters.
RUNS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[a-z{LATIN}]+|[0-9]|[^a-z0-9\n{LATIN}]+")


def byte_characters() -> str:
    """The character by which a byte-level vocabulary writes each byte: itself if it prints, else one from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    more = iter(range(256, 512))
    return "".join(chr(b if b in own else next(more)) for b in range(256))


@lru_cache(2)
def vocabulary_of(path: str) -> dict[bytes, int]:
    """Ids by bytes, those that end a word with STOP behind; the file is that of a BPE with word ends."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    if model.get("end_of_word_suffix") != "</w>":
        raise ValueError("the vocabulary has no word ends")
    bytes_of = {c: bytes([i]) for i, c in enumerate(byte_characters())}
    out = {}
    for name, i in model["vocab"].items():
        end = name.endswith("</w>") and name != "</w>"
        out[b"".join(map(bytes_of.__getitem__, name[:-4] if end else name)) + STOP.encode() * end] = i
    return {k: i for k, i in out.items() if STOP.encode() not in k[:-1]}


class WordIds:
    """Ids of texts, by words: a word's ids do not depend on its neighbours, so those of a batch are looked up once each.

    The tokenizer lower-cases, drops white space and starts anew behind it; words are cut at ASCII white
    space only. Words of ASCII characters and Latin letters are merged by one call to a byte-pair encoder
    with the same vocabulary: a word end is a byte of its own that joins its neighbour first, and merges
    rank as their ids. Other words are encoded by the tokenizer in one call, divided by a mark of one id;
    texts with that mark or with special strings are encoded whole.
    """

    def __init__(self, path: str):
        from tiktoken import Encoding
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        (self.mark,) = self.tokenizer.encode(MARK, add_special_tokens=False).ids
        known = vocabulary_of(path)
        # ends of one byte first, single bytes last; of the rest an earlier id is an earlier merge
        order = sorted(known, key=lambda b: (not (len(b) == 2 and b.endswith(STOP.encode())), len(b) == 1, known[b]))
        self.ids = np.array([known[b] for b in order], np.uint32)
        self.pairs = Encoding("words", pat_str=rf"\n|[^{STOP}\n]+{STOP}", mergeable_ranks={b: i for i, b in enumerate(order)}, special_tokens={})
        self.line = order.index(b"\n")

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def plain(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of ASCII characters and Latin letters, and how many each has."""
        found = self.pairs.encode_to_numpy(RUNS.sub(rf"\g<0>{STOP}", "\n".join([*words, ""])), disallowed_special=())
        lines = np.flatnonzero(found == self.line)
        return self.ids[np.delete(found, lines)], np.diff(lines, prepend=-1) - 1

    def other(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = self.whole("".join(f" {w} {MARK}" for w in words))
        marks = np.flatnonzero(found == self.mark)
        if len(marks) != len(words):
            raise ValueError("the mark was not kept apart")
        return np.delete(found, marks), np.diff(marks, prepend=-1) - 1

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """The ids of each text, as unsigned 32-bit numbers."""
        odd = {i: self.whole(t.decode()) for i, t in enumerate(texts) if b"\x01" in t or b"<|" in t}
        lines = pc.ascii_split_whitespace(pc.ascii_lower(pa.array([b"" if i in odd else t for i, t in enumerate(texts)], pa.binary()).view(pa.string())))
        found = lines.flatten().dictionary_encode()
        code, words = found.indices.to_numpy(), found.dictionary
        if not len(words):
            return [odd.get(i, np.zeros(0, np.uint32)) for i in range(len(texts))]
        strange = pc.match_substring_regex(words, OTHER).to_numpy(zero_copy_only=False)
        sizes, parts = np.zeros(len(words), np.int32), []
        for which, encode in ((~strange, self.plain), (strange, self.other)):
            if which.any():
                some = words.filter(pa.array(which))
                ids, sizes[which] = encode((pc.utf8_lower(some) if encode == self.plain else some).to_pylist())
                parts.append(ids)
        starts, at = np.zeros(len(words), np.int32), 0
        for which in (~strange, strange):
            n = sizes[which]
            starts[which] = at + np.cumsum(n, dtype=np.int64) - n
            at += int(n.sum(dtype=np.int64))
        ids, n = np.concatenate(parts), sizes[code]
        ends = np.cumsum(n, dtype=np.int64)
        at = np.arange(ends[-1], dtype=np.int32 if ends[-1] < 1 << 30 else np.int64)
        at += np.repeat((starts[code] + n - ends).astype(at.dtype), n)
        ids = ids[at]
        cuts = np.concatenate([[0], ends])[lines.offsets.to_numpy() - lines.offsets[0].as_py()]
        return [odd[i] if i in odd else ids[a:b] for i, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist()))]


@lru_cache(2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def idf_of(df: np.ndarray, n: int) -> np.ndarray:
    return np.maximum(0.0, np.log((n - df + 0.5) / (df + 0.5)))


class Index:
    """BM25 postings of the documents of a shard; terms that over half of all documents hold weigh 0 and are left out.

    `known` has the idf of each term and the mean length; without it, the documents are the whole table.
    """

    def __init__(self, docs: list[np.ndarray], k1: float = 1.2, b: float = 0.75, known: tuple[np.ndarray, float] | None = None):
        self.n = n = len(docs)
        terms, counts = zip(*(np.unique(d, return_counts=True) for d in docs))
        length = np.array([len(d) for d in docs], np.float64)
        term, doc = np.concatenate(terms).astype(np.int64), np.repeat(np.arange(n), [len(t) for t in terms])
        tf = np.concatenate(counts).astype(np.float64)
        if known is None:
            names, df = np.unique(term, return_counts=True)
            idf = np.zeros(int(names[-1]) + 1)
            idf[names] = idf_of(df, n)
            known = idf, length.mean()
        idf, mean = known
        self.terms = [t[idf[t] > 0].astype(np.int64) for t in terms]
        some = np.flatnonzero(idf[term] > 0)
        some = some[np.argsort(term[some], kind="stable")]
        term, self.doc, tf = term[some], doc[some], tf[some]
        self.weight = tf * (k1 + 1) / (tf + k1 * (1 - b + b * length[self.doc] / mean)) * idf[term]
        self.ends = np.cumsum(np.bincount(term, minlength=len(idf)))

    def scores(self, seed: int) -> np.ndarray:
        ends, sizes = self.ends[self.terms[seed]], self.ends[self.terms[seed]] - np.where(self.terms[seed] > 0, self.ends[self.terms[seed] - 1], 0)
        after = np.cumsum(sizes)
        if not len(after):
            return np.zeros(self.n)
        at = np.repeat(ends - after, sizes) + np.arange(after[-1])
        return np.bincount(self.doc[at], self.weight[at], self.n)


def pack_shard(docs: list[np.ndarray], window: int, known: tuple[np.ndarray, float] | None = None, best: int = 16) -> Iterator[list[tuple[int, int, int]]]:
    """Sequences of pieces (document, start, length); each token is in one piece.

    Of the `best` unused neighbours, the nearest that fits whole comes next, or else the nearest, cut; of
    equally near ones the earlier. When these are used up, the next ones are taken.
    """
    length = np.array([len(d) for d in docs], np.int64)
    left = length % window
    for doc, n in enumerate((length // window).tolist()):
        for turn in range(n):
            yield [(doc, turn * window, window)]

    def take(doc: int, space: int) -> tuple[int, int, int]:
        size = min(space, int(left[doc]))
        piece = doc, int(length[doc] - left[doc]), size
        left[doc] -= size
        return piece

    index, pieces = None, []
    for seed in range(len(docs)):
        if not left[seed]:
            continue
        pieces = [take(seed, window)]
        space = window - pieces[0][2]
        scores = None
        while space and left.any():
            if scores is None:
                index = index or Index(docs, known=known)
                scores = index.scores(seed)
            unused = np.flatnonzero(left)
            s = scores[unused]
            if len(unused) > 4 * best:
                least = np.partition(s, len(s) - best)[len(s) - best]
                unused, s = unused[s >= least], s[s >= least]
            near = unused[np.argsort(-s, kind="stable")][:best].tolist()
            while space and near:
                at = next((i for i, d in enumerate(near) if left[d] <= space), 0)
                pieces.append(take(near.pop(at), space))
                space -= pieces[-1][2]
        if not space:
            yield pieces
            pieces = []
    # fewer tokens than a window are left: sequences of powers of two
    pieces = pieces[::-1]
    rest = sum(size for *_, size in pieces)
    while rest:
        room = 1 << (rest.bit_length() - 1)
        rest -= room
        out = []
        while room:
            doc, at, size = pieces.pop()
            n = min(size, room)
            out.append((doc, at, n))
            room -= n
            if n < size:
                pieces.append((doc, at + n, size - n))
        yield out


def content_ranks(idf: np.ndarray, keys: int = 3) -> np.ndarray:
    """For each key and term, its rank among all terms: the rarer, the likelier to be low.

    A document's key is the lowest rank among its terms. Two documents then agree with the probability
    of their Jaccard similarity, terms weighted by their squared idf (exponential ranks).
    """
    weight = np.where(idf > 0, idf, np.nan) ** 2
    draws = np.random.default_rng(9).exponential(size=(keys, len(idf)))
    return np.argsort(np.argsort(np.nan_to_num(draws / weight, nan=np.inf), axis=1, kind="stable"), axis=1).astype(np.int32)


PIECES = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def portions(batch: pa.RecordBatch, rows: int, size: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices of at most so many rows and, but for single rows, about so many bytes."""
    each = max(1, min(rows, size * batch.num_rows // max(1, batch.nbytes)))
    for at in range(0, batch.num_rows, each):
        yield batch.slice(at, each)


def tokenized(docs: DataFrame, vocabulary: str, id_col: str, text_col: str) -> DataFrame:
    """row, _id, tokens and ids of every document; and, where ids is null, terms (row) and how many documents of a task hold them (tokens)."""

    def tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, df, kind = TaskContext.get().partitionId() << 40, np.zeros(1, np.int64), None
        names = ["row", "_id", "tokens", "ids"]
        for batch in batches:
            kind = batch.column(0).type
            for part in portions(batch, 4000, 6 << 20):
                encoded = [np.append(x, np.uint32(END)) for x in word_ids(vocabulary).encode([x or b"" for x in part.column(1).to_pylist()])]
                seen = np.bincount(np.concatenate([np.unique(x) for x in encoded]), minlength=len(df))
                seen[: len(df)] += df
                df = seen
                data = pa.array([x.astype("<u4" if len(df) > 1 << 16 else "<u2").tobytes() + bytes([len(df) > 1 << 16]) for x in encoded], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(range(row, row + len(encoded)), pa.int64()), part.column(0), pa.array(map(len, encoded), pa.int64()), data], names=names)
                row += len(encoded)
        some = np.flatnonzero(df)
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.nulls(len(some), kind), pa.array(df[some]), pa.nulls(len(some), pa.binary())], names=names)

    source = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").cast("binary").alias("_text"))
    return source.mapInArrow(lean(tokenize), f"row long, _id {source.schema[0].dataType.simpleString()}, tokens long, ids binary")


def stored(data: bytes) -> np.ndarray:
    """Ids as `tokenized` stores them: 16 bits each, or 32 where the last byte says so."""
    return np.frombuffer(data, "<u4" if data[-1] else "<u2", (len(data) - 1) // (4 if data[-1] else 2))


def pack_by_retrieval(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", window: int = 2048, shard_docs: int = 512, shard_tokens: int = 2_000_000, part_tokens: int = 64_000_000, sample: int = 1_000_000) -> DataFrame:
    """A row of each piece: the document, where in it and in which sequence the piece is, and its digest.

    `vocabulary` is the tokenizer's file. Documents are dealt by content over ranges of about
    `part_tokens` tokens; a shard is a run of at most `shard_docs` documents of a range, or of about
    `shard_tokens` tokens: memory and work a document are bounded, however alike documents are. Full
    windows of a document are sequences of their own. A null or empty text is its end id alone; equal
    documents are packed each; null and repeated ids are carried as they are; extra columns are ignored.
    The order of equal documents goes by that of the rows.
    """
    spark = docs.sparkSession
    fields = [x.split()[0] for x in PIECES.split(", ")]
    with small_batches(spark, 4000, "6m"):
        tokens = written(tokenized(docs, vocabulary, id_col, text_col), "tokens")
    rows = tokens.filter("ids is not null")
    n, total = rows.agg(F.count(F.lit(1)), F.sum("tokens")).first()
    counted = tokens.filter("ids is null").groupBy("row").agg(F.sum("tokens").alias("n")).toArrow()  # no more than the vocabulary
    idf = np.zeros(max(counted.column(0).to_pylist(), default=0) + 1)
    idf[counted.column(0).to_numpy()] = idf_of(counted.column(1).to_numpy(), n)
    known = spark.sparkContext.broadcast((idf, (total or 0) / max(n, 1), content_ranks(idf)))

    def keys_of(batch: pa.RecordBatch) -> list[tuple[int, ...]]:
        """The place of each document in the order by content; equal ones go by row."""
        *_, ranks = known.value
        return [(*ranks[:, stored(x.as_py())].min(axis=1).tolist(), row) for x, row in zip(batch.column("ids"), batch.column("row").to_pylist())]

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = list(zip(*keys_of(batch))) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=places)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = keys_of(batch)
            cols = list(zip(*keys)) or [()] * 4
            part = pa.array([bisect_right(bounds.value, k) for k in keys], pa.int32())
            yield pa.RecordBatch.from_arrays([part, *(pa.array(c, pa.int64()) for c in cols), batch.column("_id"), batch.column("ids")], names=["part", *places, "_id", "ids"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence, kind = TaskContext.get().partitionId() << 40, None
        ids, docs, held = [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal sequence
            data, out = [x.astype("<u4").tobytes() for x in docs], []
            for pieces in pack_shard(docs, window, known.value[:2]):
                offset = 0
                for doc, start, size in pieces:
                    out.append((ids[doc], start, size, zlib.crc32(data[doc][4 * start : 4 * (start + size)]), len(docs[doc]), sequence, offset))
                    offset += size
                sequence += 1
            first, *others = zip(*out)
            return pa.RecordBatch.from_arrays([pa.array(first, kind), *(pa.array(c, pa.int64()) for c in others)], names=[id_col, *fields])

        for batch in batches:
            kind = batch.column(0).type
            for key, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids.append(key)
                docs.append(stored(data.as_py()))
                held += len(docs[-1])
                if len(docs) >= shard_docs or held >= shard_tokens:
                    yield flush()
                    ids, docs, held = [], [], 0
        if docs:
            yield flush()

    # ranges of about equal numbers of documents, from a sample of no more than `sample` of them
    places, kind = ["k0", "k1", "k2", "row"], rows.schema["_id"].dataType.simpleString()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(total or 0) // part_tokens))
    some = rows.filter(F.pmod(F.xxhash64("row"), F.lit(max(1, n // min(20 * parts, sample)))) == 0).select("row", "ids")
    with small_batches(spark, 4000, "6m"):
        found = sorted(zip(*(c.to_pylist() for c in some.mapInArrow(lean(sampled), ", ".join(f"{c} long" for c in places)).toArrow().columns)))
        bounds = spark.sparkContext.broadcast([found[len(found) * k // parts] for k in range(1, parts)] if found else [])
        dealt = rows.select("row", "_id", "ids").mapInArrow(lean(placed), f"part int, {', '.join(f'{c} long' for c in places)}, _id {kind}, ids binary")
        dealt = dealt.repartitionById(parts, F.col("part")).sortWithinPartitions(*places)
        schema = docs.select(id_col).schema
        for name in fields:
            schema = schema.add(name, "long")
        return written(dealt.select("_id", "ids").mapInArrow(lean(pack), schema), "pieces")
