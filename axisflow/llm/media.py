"""Media columns: what a blob really is, whatever its declared type says.

An Aho-Corasick automaton finds every magic byte string in one pass; a validator for each format
then walks its structure and gives the exact length, or refuses. The structure at offset 0 corrects
the declared type; those further in are embedded media and can be carved out.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import cached_property, lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Magic bytes, their offset from the start of the medium, and the format they announce.
MAGIC = [
    (b"\x89PNG\r\n\x1a\n", 0, "image/png"),
    (b"GIF87a", 0, "image/gif"),
    (b"GIF89a", 0, "image/gif"),
    (b"\xff\xd8\xff", 0, "image/jpeg"),
    (b"RIFF", 0, "riff"),
    (b"BM", 0, "image/bmp"),
    (b"%PDF-", 0, "application/pdf"),
    (b"PK\x03\x04", 0, "application/zip"),
    (b"OggS", 0, "audio/ogg"),
    (b"\x1f\x8b\x08", 0, "application/gzip"),
]
RIFF_FORMS = {b"WAVE": "audio/wav", b"WEBP": "image/webp", b"AVI ": "video/avi"}

REPORT = "detected string, declared_ok boolean, length long, embedded array<struct<type:string,offset:long,length:long>>"


def _png(d: bytes, at: int) -> int:
    p = at + 8
    first = True
    while p + 12 <= len(d):
        n, kind = struct.unpack_from(">I4s", d, p)
        if p + 12 + n > len(d) or first and kind != b"IHDR" or zlib.crc32(d[p + 4 : p + 8 + n]) != struct.unpack_from(">I", d, p + 8 + n)[0]:
            return 0
        first, p = False, p + 12 + n
        if kind == b"IEND":
            return p - at
    return 0


def _gif(d: bytes, at: int) -> int:
    if at + 13 > len(d):
        return 0
    flags, p = d[at + 10], at + 13
    p += 3 << ((flags & 7) + 1) if flags & 0x80 else 0

    def blocks(p: int) -> int:
        while p < len(d):
            if not d[p]:
                return p + 1
            p += d[p] + 1
        return 0

    while p and p < len(d):
        if d[p] == 0x3B:
            return p + 1 - at
        if d[p] == 0x21:
            p = blocks(p + 2)
        elif d[p] == 0x2C and p + 10 < len(d):
            local = d[p + 9]
            p = blocks(p + 11 + (3 << ((local & 7) + 1) if local & 0x80 else 0))
        else:
            return 0
    return 0


def _jpeg(d: bytes, at: int) -> int:
    p = at + 2
    while p + 4 <= len(d) and d[p] == 0xFF:
        kind, n = d[p + 1], struct.unpack_from(">H", d, p + 2)[0]
        if kind == 0xD9:
            return p + 2 - at
        if n < 2 or kind < 0xC0:
            return 0
        p += 2 + n
        if kind == 0xDA:
            while (p := d.find(b"\xff", p)) >= 0:
                if p + 1 < len(d) and d[p + 1] == 0xD9:
                    return p + 2 - at
                if p + 1 < len(d) and (d[p + 1] == 0 or 0xD0 <= d[p + 1] <= 0xD7):
                    p += 2
                else:
                    break
            if p < 0:
                return 0
    return 0


def _riff(d: bytes, at: int) -> int:
    if at + 12 > len(d):
        return 0
    end = at + 8 + struct.unpack_from("<I", d, at + 4)[0]
    if end > len(d) or d[at + 8 : at + 12] not in RIFF_FORMS:
        return 0
    p = at + 12
    while p + 8 <= end:
        p += 8 + (n := struct.unpack_from("<I", d, p + 4)[0]) + (n & 1)
    return end - at if p == end else 0


def _bmp(d: bytes, at: int) -> int:
    if at + 26 > len(d):
        return 0
    size, zero, pixels, head = struct.unpack_from("<IIII", d, at + 2)
    return size if not zero and head in (12, 40, 52, 56, 108, 124) and 14 + head <= pixels <= size <= len(d) - at else 0


class Finder:
    """Next occurrences in one blob; asked from left to right, it searches each stretch once."""

    def __init__(self, data: bytes):
        self.data, self.known = data, {}

    @cached_property
    def zips(self) -> dict[int, int]:
        """Lengths of archives by their beginnings: each end record tells where its archive begins."""
        out, d = {}, self.data
        end = d.find(b"PK\x05\x06")
        while end >= 0 and end + 22 <= len(d):
            size, offset, comment = struct.unpack_from("<IIH", d, end + 12)
            start = end - size - offset
            if start >= 0 and end + 22 + comment <= len(d):
                out.setdefault(start, end + 22 + comment - start)
            end = d.find(b"PK\x05\x06", end + 4)
        return out

    def __call__(self, what: bytes, at: int) -> int:
        since, found = self.known.get(what, (0, -2))
        if found == -2 or since > at or -1 < found < at:
            found = self.data.find(what, at)
            self.known[what] = at, found
        return found


def _pdf(d: bytes, at: int, find: Finder | None = None) -> int:
    """Up to the last end mark: updates follow the first, each with a cross-reference and a link to the one before."""
    find = find or Finder(d)
    end, start = find(b"%%EOF", at), find(b"startxref", at)
    if not -1 < start < end:
        return 0
    other = find(b"%PDF-", at + 5)
    while True:
        following = d.find(b"%%EOF", end + 5, other if other > end else len(d))
        if following < 0 or d.find(b"startxref", end, following) < 0 or d.find(b"/Prev", end, following) < 0:
            return end + 5 - at
        end = following


def _zip(d: bytes, at: int, find: Finder | None = None) -> int:
    return (find or Finder(d)).zips.get(at, 0)


def _ogg(d: bytes, at: int) -> int:
    p = at
    while d[p : p + 4] == b"OggS" and p + 27 <= len(d) and d[p + 4] == 0:
        n = d[p + 26]
        q = p + 27 + n + sum(d[p + 27 : p + 27 + n])
        if q > len(d):
            return 0
        last, p = d[p + 5] & 4, q
        if last:
            return p - at
    return 0


def _gzip(d: bytes, at: int) -> int:
    z = zlib.decompressobj(31)
    try:
        p = at
        while p < len(d) and not z.eof:
            z.decompress(d[p : p + 65536], 1 << 20)
            while z.unconsumed_tail:
                z.decompress(z.unconsumed_tail, 1 << 20)
            p += 65536
    except zlib.error:
        return 0
    return min(p, len(d)) - len(z.unused_data) - at if z.eof else 0


VALIDATORS = {"image/png": _png, "image/gif": _gif, "image/jpeg": _jpeg, "riff": _riff, "image/bmp": _bmp, "application/pdf": _pdf, "application/zip": _zip, "audio/ogg": _ogg, "application/gzip": _gzip}


@lru_cache(1)
def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for magic, back, kind in MAGIC:
        a.add_word(magic.decode("latin-1"), (len(magic) - 1 + back, kind))
    a.make_automaton()
    return a


def sniff(data: bytes) -> tuple[str | None, int, list[tuple[str, int, int]]]:
    """Type and length of the medium at offset 0 (None, 0 if there is none), and media found elsewhere.

    Media inside a confirmed medium other than the outermost are its own parts and not reported again.
    """
    outer, length, inside, free, find = None, 0, [], 0, Finder(data)
    for end, (back, kind) in automaton().iter(data.decode("latin-1")):
        at = end - back
        if at < free or at < 0:
            continue
        if n := VALIDATORS[kind](data, at, find) if kind in ("application/pdf", "application/zip") else VALIDATORS[kind](data, at):
            kind = RIFF_FORMS[data[at + 8 : at + 12]] if kind == "riff" else kind
            if at == 0:
                outer, length = kind, n
            else:
                inside.append((kind, at, n))
                free = at + n
    return outer, length, inside


def wav(samples: bytes, rate: int = 8000) -> bytes:
    """The bytes as 8-bit mono samples."""
    pad = len(samples) & 1
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(samples) + pad, b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(samples)) + samples + b"\0" * pad


def wav_samples(media: bytes) -> bytes:
    """The samples of a WAV file, found by walking its chunks."""
    p = 12
    while p + 8 <= len(media):
        kind, n = struct.unpack_from("<4sI", media, p)
        if kind == b"data":
            return media[p + 8 : p + 8 + n]
        p += 8 + n + (n & 1)
    raise ValueError("no data chunk")


def store_samples(df: DataFrame, column: str, keep: list[str], unit: int = 64, out: str = "media") -> DataFrame:
    """`keep` and `out`: the column's bytes (null: none), filled with zeros to a positive multiple of `unit`, as a WAV file; `n_bytes` has their number before."""

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [x or b"" for x in batch.column("_data").to_pylist()]
            media = [wav(x + bytes(max(unit, -(-len(x) // unit) * unit) - len(x))) for x in data]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), pa.array(map(len, data), pa.int64()), pa.array(media, pa.binary())], names=[*keep, "n_bytes", out])

    rows = df.select(*keep, F.col(column).cast("string").cast("binary").alias("_data"))
    schema = rows.drop("_data").schema.add("n_bytes", "long").add(out, "binary")
    return rows.mapInArrow(store, schema)


def sniff_media(df: DataFrame, column: str, keep: list[str], declared: str | None = None) -> DataFrame:
    """`keep` and the report on a binary column.

    `detected`: the confirmed type at offset 0, null if none; `declared_ok`: whether the column
    `declared` says the same (null without one); `length`: of the confirmed medium; `embedded`: type,
    offset and length of media further in. Null and empty blobs have no type; bytes behind the end of
    the medium are searched as well; no blob is cut.
    """

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([("detected", pa.string()), ("declared_ok", pa.bool_()), ("length", pa.int64()), ("embedded", pa.list_(pa.struct([("type", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])))])
        for batch in batches:
            rows = []
            for data, said in zip(batch.column("_blob"), batch.column("_said").to_pylist()):
                kind, n, inside = sniff(data.as_py() or b"")
                rows.append({"detected": kind, "declared_ok": None if said is None else said == kind, "length": n, "embedded": [dict(zip(("type", "offset", "length"), x)) for x in inside]})
            report = pa.RecordBatch.from_pylist(rows, schema=kinds)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), *report.columns], names=[*keep, *kinds.names])

    rows = df.select(*keep, F.col(column).alias("_blob"), (F.col(declared) if declared else F.lit(None)).cast("string").alias("_said"))
    schema = rows.drop("_blob", "_said").schema
    for field in spark_fields(REPORT):
        schema = schema.add(field)
    return rows.mapInArrow(look, schema)


def spark_fields(ddl: str):
    from pyspark.sql.types import StructType

    return StructType.fromDDL(ddl).fields


def carve(data: bytes, inside: list[tuple[str, int, int]]) -> list[bytes]:
    """The embedded media themselves."""
    return [data[at : at + n] for _, at, n in inside]


def sample_report(df: DataFrame, column: str, keep: list[str], unit: int = 64, tail: int = 64, declared: str = "application/octet-stream") -> DataFrame:
    """`store_samples` and `sniff_media` over each row in one pass, without moving the files between them.

    The file is stored, its type is sniffed against the declared one, and the samples are read back by
    the confirmed structure; then come digests of samples and file, and a feature: the corrected type,
    the number of samples, how many distinct values they take, and the embedded media.
    """
    names = [("n_bytes", "long"), ("payload_bytes", "long"), ("payload_sha256", "string"), ("tail_crc32", "long"), ("media_bytes", "long"), ("media_sha256", "string"), ("feature", "string")]

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for value in batch.column("_data"):
                raw = value.as_py() or b""
                media = wav(raw + bytes(max(unit, -(-len(raw) // unit) * unit) - len(raw)))
                kind, length, inside = sniff(media)
                if kind != "audio/wav" or length != len(media):
                    raise ValueError("the stored file is damaged")
                data = wav_samples(media)
                found = ",".join(f"{k}@{at - 44}+{n}" for k, at, n in inside)
                feature = f"{declared}->{kind};samples={len(data)};levels={len(set(data))};embedded={found}"
                rows.append((len(raw), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-tail:]), len(media), hashlib.sha256(media).hexdigest(), feature))
            cols = list(zip(*rows)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), *(pa.array(c, pa.int64() if t == "long" else pa.string()) for c, (_, t) in zip(cols, names))], names=[*keep, *(n for n, _ in names)])

    rows = df.select(*keep, F.col(column).cast("string").cast("binary").alias("_data"))
    schema = rows.drop("_data").schema
    for name, kind in names:
        schema = schema.add(name, kind)
    return rows.mapInArrow(report, schema)
