"""WARC archives with Zstandard dictionaries.

Each archive file starts with a skippable frame that holds a dictionary trained on the very records
of that file; each record is a frame of its own, so one can be read without the others. Files are
bounded by `segment_bytes` of raw records, which also bounds a task's memory.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from axisflow.llm.shared import lean, written

# Fixed values of the formats.
SKIPPABLE_MAGIC = 0x184D2A5D
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

MANIFEST = "file string, records long, raw_bytes long, stored_bytes long"
RECORDS = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """One WARC/1.1 record; a revisit keeps the HTTP header and not the payload."""
    uri = quote(url, safe="!#$%&'()*+,/:;=?@[]~") if url else f"urn:x-page:{page_id}"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:x-page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {uri}",
        f"X-Has-Target: {int(url is not None)}",
        f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if revisit:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <urn:x-page:{refers_to}>"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def segment(records: list[bytes], dict_bytes: int, level: int) -> bytes:
    """An archive file: the dictionary in a skippable frame, then a frame for each record.

    The dictionary is trained on every record of the file; where they are too few or too small to
    train one, their concatenated heads serve as a raw dictionary.
    """
    raw = sum(map(len, records))
    size = min(dict_bytes, max(1024, raw // 16))
    try:
        dictionary = zstandard.train_dictionary(size, records, k=256, d=8, f=18, accel=8)
    except zstandard.ZstdError:
        dictionary = zstandard.ZstdCompressionDict(b"".join(r[:512] for r in records[:64]).ljust(64, b"\0"), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    dictionary.precompute_compress(level)
    data = dictionary.as_bytes()
    one = zstandard.ZstdCompressor(level=level, dict_data=dictionary, write_content_size=True, write_checksum=True)
    return struct.pack("<II", SKIPPABLE_MAGIC, len(data)) + data + b"".join(one.compress(r) for r in records)


def parse_segment(data: bytes) -> Iterator[dict]:
    """The records of an archive file, checked against their own digests."""
    magic, size = struct.unpack_from("<II", data)
    if magic != SKIPPABLE_MAGIC:
        raise ValueError("the archive does not start with a dictionary frame")
    dictionary = zstandard.ZstdCompressionDict(data[8 : 8 + size])
    frames = zstandard.ZstdDecompressor(dict_data=dictionary).stream_reader(io.BytesIO(data[8 + size :]), read_across_frames=True)
    lines = io.BufferedReader(frames, 1 << 16)
    while first := lines.readline():
        if first != b"WARC/1.1\r\n":
            raise ValueError("not a WARC record")
        head = {}
        while (line := lines.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode().partition(": ")
            head[name] = value.rstrip("\r\n")
        block = lines.read(int(head["Content-Length"]))
        lines.read(4)
        http, _, payload = block.partition(b"\r\n\r\n")
        revisit = head["WARC-Type"] == "revisit"
        digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
        length = int(re.search(rb"Content-Length: (\d+)", http)[1])
        if not revisit and (len(payload) != length or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
            raise ValueError(f"payload of {head['WARC-Record-ID']} is damaged")
        number = lambda k: int(x) if (x := head.get(k, "<urn:x-page:>")[12:-1]).lstrip("-").isdigit() else None
        yield {
            "page_id": number("WARC-Record-ID"),
            "url": head["WARC-Target-URI"] if head["X-Has-Target"] == "1" else None,
            "record_type": head["WARC-Type"],
            "payload_bytes": length,
            "payload_digest": digest,
            "refers_to": number("WARC-Refers-To"),
            "payload": None if revisit else payload,
        }


def put(uri: str, data: bytes) -> None:
    fs, path = pafs.FileSystem.from_uri(uri)
    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
    with fs.open_output_stream(path) as f:
        f.write(data)


def get(uri: str) -> bytes:
    fs, path = pafs.FileSystem.from_uri(uri)
    with fs.open_input_stream(path) as f:
        return f.read()


def typed(pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """Adds digest, record type and the page that a revisit refers to.

    Of equal payloads the largest page_id is the response. Digests are counted before anything
    moves; only those seen twice are joined back. Their table has a known size: Spark broadcasts a small one,
    and splits a digest that holds a third of all rows where it is not.
    """
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload")
    ).withColumn("sha1", F.unhex(F.sha1("payload")))
    last = rows.groupBy("sha1").agg(F.max("page_id").alias("last"), F.count(F.lit(1)).alias("copies")).filter("copies > 1").drop("copies")
    joined = rows.join(written(last, "copies"), "sha1", "left")
    revisit = F.col("last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last")) & (F.length("payload") >= min_revisit_bytes)
    return joined.withColumn("refers_to", F.when(revisit, F.col("last"))).drop("last")


def write_warc(pages: DataFrame, uri: str, segment_bytes: int = 24 << 20, dict_bytes: int = 64 << 10, level: int = 3, min_revisit_bytes: int = 0, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Writes `pages` (page_id, url, html; other columns are ignored) as archives below `uri`.

    Returns the manifest (file, records, raw_bytes, stored_bytes), itself written to `uri`/manifest,
    which names exactly the files of the successful attempts: a lost and repeated task writes new
    names, so no reader sees half a file. Characters that a header cannot hold are percent-encoded in the
    url. A null html is an empty payload; a null url and a null
    page_id are kept as such; repeated rows are all written, and rows that tie on the largest
    page_id are all responses. An empty table gives an empty manifest.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(records: list[bytes], raw: int) -> pa.RecordBatch:
            data = segment(records, dict_bytes, level)
            put(name := f"{uri}/{uuid.uuid4().hex}.warc.zst", data)
            return pa.RecordBatch.from_pylist([{"file": name, "records": len(records), "raw_bytes": raw, "stored_bytes": len(data)}])

        records, raw = [], 0
        for batch in batches:
            for page_id, url, payload, sha1, refers_to in zip(*(c for c in batch.columns)):
                payload = payload.as_py()
                records.append(record_bytes(page_id.as_py(), url.as_py(), payload, base64.b32encode(sha1.as_py()).decode(), refers_to.as_py(), refers_to.is_valid, date))
                raw += len(records[-1])
                if raw >= segment_bytes:
                    yield flush(records, raw)
                    records, raw = [], 0
        if records:
            yield flush(records, raw)

    rows = typed(pages, min_revisit_bytes).select("page_id", "url", "payload", "sha1", "refers_to")
    rows.mapInArrow(lean(write), MANIFEST).write.parquet(f"{uri}/manifest")
    return pages.sparkSession.read.schema(MANIFEST).parquet(f"{uri}/manifest")


def read_warc(spark: SparkSession, uri: str, payload: bool = True, task_bytes: int = 64 << 20) -> DataFrame:
    """The records of all archives that the manifest below `uri` names, about `task_bytes` of them a task; `payload=False` leaves the bodies out."""
    manifest = spark.read.schema(MANIFEST).parquet(f"{uri}/manifest")
    names = [c.split()[0] for c in RECORDS.split(", ") if payload or not c.startswith("payload ")]
    schema = pa.schema([(k, {"page_id": pa.int64(), "payload_bytes": pa.int64(), "refers_to": pa.int64(), "payload": pa.binary()}.get(k, pa.string())) for k in names])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows = [{k: r[k] for k in names} for r in parse_segment(get(name))]
                for at in range(0, len(rows), 2000):
                    yield pa.RecordBatch.from_pylist(rows[at : at + 2000], schema=schema)

    files, stored = manifest.agg(F.count(F.lit(1)), F.sum("stored_bytes")).first()
    tasks = max(1, min(files, max(-(-(stored or 0) // task_bytes), int(spark.conf.get("spark.sql.shuffle.partitions")))))
    return manifest.select("file").repartition(tasks).mapInArrow(lean(read), ", ".join(c for c in RECORDS.split(", ") if c.split()[0] in names))
