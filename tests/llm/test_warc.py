"""WARC files: exact round trip, repeated writing, damaged files, odd rows."""

import gzip
import hashlib
import os

import pytest
from pyspark.sql import functions as F

from eventfold.llm import warc

PAGES = [
    (1, "http://a/é x", "<p>one</p>"), (2, None, None), (3, "http://b\r\nX: y", "<p>one</p>"), (4, "u", "<p>ü</p>" * 3000), (None, "n", "<p>one</p>"),
    (None, "n", "only null"), (None, "n", "only null"), (5, "u", "same"), (5, "u", "same"), (6, "u", ""), (7, "u", "x\r\n\r\ny"),
]


@pytest.fixture
def pages(spark):
    def make(rows):
        return spark.createDataFrame([(*r, "d", "s") for r in rows], "page_id bigint, url string, html string, digest string, shard string").repartition(3)

    return make


def files(path):
    return {n: open(f"{path}/{n}", "rb").read() for n in sorted(os.listdir(path)) if n.endswith(".gz")}


def test_round_trip(spark, pages, tmp_path):
    out = f"{tmp_path}/w"
    manifest = warc.write(pages(PAGES), out, shard_bytes=6000, file_bytes=400).collect()
    got = warc.read(spark, out).collect()
    assert len(got) == len(PAGES)
    stored = {r.payload_digest: r.payload for r in got if r.record_type == "response"}
    assert sorted((r.page_id or -1, stored[r.payload_digest].decode()) for r in got) == sorted((p or -1, h or "") for p, _, h in PAGES)
    assert len(stored) == sum(r.record_type == "response" for r in got)
    by = {(r.page_id, r.payload_digest): r for r in got if r.record_type == "revisit"}
    one = warc.base32_sha1(b"<p>one</p>")
    assert by[3, one].refers_to == by[None, one].refers_to == 1 and by[6, warc.base32_sha1(b"")].refers_to == 2
    assert all(r.payload_bytes == len(stored[r.payload_digest]) for r in got)
    assert {m.name: (m.bytes, m.sha256) for m in manifest} == {n: (len(b), hashlib.sha256(b).hexdigest()) for n, b in files(out).items()}
    assert len(manifest) > 3 and not os.path.exists(f"{out}/_temporary")
    for data in files(out).values():
        assert gzip.decompress(data).startswith(b"WARC/1.1\r\nWARC-Type: warcinfo")


def test_same_bytes_again(spark, pages, tmp_path):
    warc.write(pages(PAGES), f"{tmp_path}/a", shard_bytes=6000, file_bytes=400)
    warc.write(pages(PAGES[::-1]), f"{tmp_path}/b", shard_bytes=6000, file_bytes=400)
    assert files(f"{tmp_path}/a") == files(f"{tmp_path}/b")


def test_smallest_size_for_revisits(spark, pages, tmp_path):
    warc.write(pages(PAGES), f"{tmp_path}/w", min_bytes=5)
    got = warc.read(spark, f"{tmp_path}/w").collect()
    assert all(r.record_type == "response" for r in got if r.payload_bytes < 5)
    assert sum(r.record_type == "revisit" for r in got) == 3


def test_damage_and_empty(spark, pages, tmp_path):
    out = f"{tmp_path}/w"
    manifest = warc.write(pages(PAGES), out).collect()
    path = f"{out}/{manifest[0].name}"
    data = bytearray(gzip.decompress(open(path, "rb").read()))
    data[data.index(b"only null")] ^= 1
    open(path, "wb").write(gzip.compress(bytes(data)))
    with pytest.raises(Exception, match="damaged|Content-Length"):
        warc.read(spark, out).collect()
    assert warc.write(pages(PAGES).where("false"), f"{tmp_path}/e").collect() == []
    assert warc.read(spark, f"{tmp_path}/e").collect() == []


def test_files_are_read_by_many_tasks(spark, tmp_path):
    rows = [(i, f"http://h/{i}", "x" * 300 + str(i)) for i in range(400)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(4)
    out = str(tmp_path / "many")
    files = warc.write(pages, out, file_bytes=2000).count()
    assert files > 8
    tasks = warc.read(spark, out).select(F.spark_partition_id().alias("p")).distinct().count()
    assert tasks >= 4
