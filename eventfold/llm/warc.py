"""Deterministic sharded WARC writer and reader.

Pages are range-sorted by ``page_id`` into shards of similar size. Bounds come from a
sample picked by a hash of the id, so the same table always gives the same shards. One
task writes a shard: it streams sorted rows, rebuilds every header and digest, compresses
each record on its own, and starts a new file once the current one has FILE_BYTES bytes. A
file is written under a temporary name and then moved; its final name and bytes depend on
the data only, so a task that runs twice leaves the same file. The manifest, written last
by Spark, lists the files that count, and the reader takes no other.

Repeated payloads of at least ``min_bytes`` bytes are stored once, with the page of the
smallest id; the other records are revisits that refer to it. Which page that is comes
from a small table of digests. It reaches the writer as note rows among the page rows, so
page contents are shuffled once.

Defined cases: a null page is an empty payload, a null url an empty one; a null ``page_id``
sorts first and is referred to only where no other page has the payload. Rows with equal
id and payload are written one by one; the first is the response. All rows of one id go to
one shard. An empty table gives an empty manifest.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventfold.llm.base import register, table, written
from eventfold.session import work_dir

SHARD_BYTES = 16 << 20
FILE_BYTES = 8 << 20
#: Ids sampled for the shard bounds; there are at most an eighth as many shards.
SAMPLE = 1 << 16
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_NAMES = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page: int | None, digest: str, copy: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMES, f'{page}:{digest}:{copy}')}>"


def clean_uri(url: str) -> str:
    """A header value: controls, spaces and non-ASCII characters are percent-encoded."""
    return re.sub(r"[^\x21-\x7E]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url)


def record(kind: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    """One compressed record: a gzip member of its own, without a time stamp."""
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("WARC-Block-Digest", f"sha1:{base32_sha1(block)}"), ("Content-Length", str(len(block)))])
    data = f"WARC/1.1\r\nWARC-Type: {kind}\r\n{head}\r\n".encode() + block + b"\r\n\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def page_record(page: int | None, url: str, payload: bytes, digest: str, copy: int, refers_to: int | None, revisit: bool) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    fields = [("WARC-Record-ID", record_id(page, digest, copy)), ("WARC-Date", DATE), ("WARC-Target-URI", clean_uri(url))]
    fields += [("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response")]
    if page is not None:
        fields.append(("WARC-Page-Id", str(page)))
    if not revisit:
        return record("response", fields, http + payload)
    fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to, digest, 0))]
    if refers_to is not None:
        fields.append(("WARC-Refers-To-Page-Id", str(refers_to)))
    return record("revisit", fields, http)


class _Files:
    """The files of one task, rolled by compressed size."""

    def __init__(self, out: str, file_bytes: int):
        self.fs, self.root = pafs.FileSystem.from_uri(out)
        self.file_bytes, self.shard, self.no, self.sink = file_bytes, None, 0, None
        self.done: list[tuple] = []

    def add(self, shard: int, data: bytes) -> None:
        if self.sink and (shard != self.shard or self.size >= self.file_bytes):
            self.close()
        if self.sink is None:
            self.no = self.no + 1 if shard == self.shard else 0
            self.shard, self.name = shard, f"part-{shard:06d}-{self.no:05d}.warc.gz"
            self.temp = f"{self.root}/_temporary/{uuid.uuid4().hex}"
            self.sink, self.size, self.records, self.sum = self.fs.open_output_stream(self.temp), 0, 0, hashlib.sha256()
            info = f"software: eventfold\r\nformat: WARC File Format 1.1\r\nisPartOf: shard {shard}\r\n".encode()
            fields = [("WARC-Record-ID", record_id(shard, "warcinfo", self.no)), ("WARC-Date", DATE), ("WARC-Filename", self.name), ("Content-Type", "application/warc-fields")]
            self._put(record("warcinfo", fields, info))
        self._put(data)
        self.records += 1

    def _put(self, data: bytes) -> None:
        self.sink.write(data)
        self.sum.update(data)
        self.size += len(data)

    def close(self) -> None:
        self.sink.close()
        self.fs.move(self.temp, f"{self.root}/{self.name}")
        self.done.append((self.name, self.records, self.size, self.sum.hexdigest()))
        self.sink = None


#: Bytes of archives that a task reads back.
READ_BYTES = 64 << 20
_MANIFEST = pa.schema([("name", pa.string()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string())])
MANIFEST = "name string, records bigint, bytes bigint, sha256 string"


def _writer(out: str, file_bytes: int, min_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = _Files(out, file_bytes)
        at, notes, copies = (), {}, {}
        for batch in batches:
            for shard, page, kind, url, html, digest, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (shard, page) != at:
                    at, notes, copies = (shard, page), {}, {}
                if kind == 0:
                    notes[digest] = first
                    continue
                payload = (html or "").encode()
                own = base32_sha1(payload)
                copy = copies[own] = copies.get(own, -1) + 1
                known = hashlib.sha1(payload).digest() if notes else None
                revisit = len(payload) >= min_bytes and (known in notes or copy > 0)
                files.add(shard, page_record(page, url or "", payload, own, copy, notes.get(known, page), revisit))
        if files.sink:
            files.close()
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*files.done)) or [[]] * 4, _MANIFEST, strict=True)], schema=_MANIFEST)

    return run


def shard_bounds(facts: DataFrame, shard_bytes: int) -> np.ndarray:
    """First ids of all shards but the first, by cumulative bytes of a sample that the data fixes."""
    rows, total = facts.agg(F.count("page_id"), F.sum("room")).first()
    if not rows:
        return np.zeros(0, np.int64)
    one_in = -(-rows // SAMPLE)
    sample = facts.where(F.pmod(F.xxhash64("page_id"), F.lit(one_in)) == 0).groupBy("page_id").agg(F.sum("room").alias("room"))
    got = sample.orderBy("page_id").where("page_id is not null").toPandas()
    shards = max(1, min(-(-total // shard_bytes), max(1, len(got) // 8)))
    if shards == 1:
        return np.zeros(0, np.int64)
    upto = np.cumsum(got.room.to_numpy(np.float64))
    cut = np.searchsorted(upto, upto[-1] * np.arange(1, shards) / shards)
    return np.unique(got.page_id.to_numpy(np.int64)[np.minimum(cut, len(got) - 1)])


def write(pages: DataFrame, out: str, min_bytes: int = 0, shard_bytes: int = SHARD_BYTES, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write all pages below ``out`` and return the manifest."""
    spark = pages.sparkSession
    html = F.coalesce("html", F.lit(""))
    facts = written(
        pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.unhex(F.sha1(html)).alias("digest"), (F.octet_length(html) + 500).cast("bigint").alias("room"), F.octet_length(html).alias("n")),
        "warc-facts",
    )
    cuts = shard_bounds(facts, shard_bytes)
    bounds = spark.sparkContext.broadcast(cuts)

    @F.pandas_udf("bigint")
    def shard_of(ids):
        known = ids.notna()
        place = np.searchsorted(bounds.value, ids.fillna(0).to_numpy(np.int64), side="right")
        return ids.where(~known, place).where(known, 0).astype("int64")

    firsts = facts.where(F.col("n") >= min_bytes).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("copies"))
    notes = facts.select("page_id", "digest").join(firsts.where("copies > 1").select("digest", "first"), "digest")
    notes = notes.where(~F.col("page_id").eqNullSafe(F.col("first"))).distinct()
    none = F.lit(None)
    rows = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"), F.lit(1).alias("kind"), F.col("url").cast("string").alias("url"), "html",
        none.cast("binary").alias("digest"), none.cast("bigint").alias("first"),
    ).unionByName(notes.select("page_id", F.lit(0).alias("kind"), none.cast("string").alias("url"), none.cast("string").alias("html"), "digest", "first"))
    fs, root = pafs.FileSystem.from_uri(out)
    fs.create_dir(f"{root}/_temporary", recursive=True)
    order = ["shard", "page_id", "kind", "url", F.xxhash64("html")]
    sharded = rows.select(shard_of("page_id").alias("shard"), *rows.columns).repartitionById(len(cuts) + 1, F.col("shard").cast("int")).sortWithinPartitions(*order)
    sharded.mapInArrow(_writer(out, file_bytes, min_bytes), MANIFEST).write.parquet(f"{out}/_manifest")
    fs.delete_dir(f"{root}/_temporary")
    return spark.read.schema(MANIFEST).parquet(f"{out}/_manifest")


def members(stream) -> Iterator[bytes]:
    """The gzip members of a stream, one after the other."""
    unpack, data, parts = zlib.decompressobj(31), b"", []
    while data or (data := stream.read(1 << 20)):
        parts.append(unpack.decompress(data))
        data = unpack.unused_data
        if unpack.eof:
            yield b"".join(parts)
            unpack, parts = zlib.decompressobj(31), []
    if parts:
        raise ValueError("the archive ends within a record")


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and block of a record; the block must have its length and digest."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines[1:] if ": " in x)
    block = rest[: int(fields["Content-Length"])]
    if lines[0] != "WARC/1.1" or rest[len(block) :] != b"\r\n\r\n" or fields["WARC-Block-Digest"] != f"sha1:{base32_sha1(block)}":
        raise ValueError(f"damaged record {fields.get('WARC-Record-ID')}")
    return fields, block


_READ = pa.schema([
    ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()),
    ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()),
])
READ = "page_id bigint, url string, record_type string, payload_bytes bigint, payload_digest string, refers_to bigint, payload binary"


def _reader(out: str, payloads: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(out)

        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _READ, strict=True)], schema=_READ)

        rows, size = [], 0
        for name in (n for b in batches for n in b.column(0).to_pylist()):
            with fs.open_input_stream(f"{root}/{name}", compression=None) as stream:
                for data in members(stream):
                    fields, block = parse(data)
                    kind = fields["WARC-Type"]
                    if kind == "warcinfo":
                        continue
                    http, _, payload = block.partition(b"\r\n\r\n")
                    length = int(re.search(rb"Content-Length: (\d+)", http)[1])
                    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    if kind == "response" and (len(payload) != length or base32_sha1(payload) != digest):
                        raise ValueError(f"damaged payload in {name}")
                    page, first = fields.get("WARC-Page-Id"), fields.get("WARC-Refers-To-Page-Id")
                    rows.append((page and int(page), fields["WARC-Target-URI"], kind, length, digest, first and int(first), payload if payloads and kind == "response" else None))
                    size += len(data)
                    if size > 8 << 20:
                        yield batch(rows)
                        rows, size = [], 0
        if rows:
            yield batch(rows)

    return run


def read(spark: SparkSession, out: str, payloads: bool = True) -> DataFrame:
    """The records of all files in the manifest, checked against their digests.

    Files are dealt to tasks of about READ_BYTES, and to as many as there are cores where
    there are files enough; the manifest's own size says nothing about the work.
    """
    manifest = spark.read.schema(MANIFEST).parquet(f"{out}/_manifest")
    files, total = manifest.agg(F.count(F.lit(1)), F.sum("bytes")).first()
    tasks = max(1, min(files, max(spark.sparkContext.defaultParallelism, -(-(total or 0) // READ_BYTES))))
    return manifest.select("name").repartitionByRange(tasks, "name").mapInArrow(_reader(out, payloads), READ)


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, h, sha1(h) AS x, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((((
    (strpos('0123456789abcdef', substr(x, CAST(5 * i // 4 + 1 AS BIGINT), 1)) - 1) * 16
    + strpos('0123456789abcdef', substr(x, CAST(5 * i // 4 + 2 AS BIGINT), 1)) - 1) >> (3 - 5 * i % 4)) & 31) + 1 AS BIGINT), 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM d
"""


@register("op5_warc_writer", SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages, written as archives and read back."""
    out = work_dir(spark, "warc")
    write(table(spark, sf_dir, "pages").select("page_id", "url", "html"), out)
    return read(spark, out, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
