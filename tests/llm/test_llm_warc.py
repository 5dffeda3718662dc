"""WARC files of other writers, pushed predicates, what is inflated, edge cases."""

import gzip
import os
import tempfile

import pyarrow.fs as pafs
import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import warc


def record(i, payload, kind="response"):
    block = warc.HTTP_OK + payload
    head = [f"WARC/1.1\r\nWARC-Type: {kind}", f"WARC-Record-ID: <urn:x:{i}>", f"X-Page-Id: {i}",
            "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


PAYLOADS = [b"first", b"", b"WARC/1.1\r\n\r\nnot a record", b"x" * 300_000, "é".encode() * 70]
RECORDS = [record(i, p) for i, p in enumerate(PAYLOADS)]
LAYOUTS = {
    "plain.warc": b"".join(RECORDS),
    "members.warc.gz": b"".join(map(gzip.compress, RECORDS)),
    "whole.warc.gz": gzip.compress(b"".join(RECORDS)),
    "sized.warc.gz": b"".join(map(warc.gzip_member, RECORDS)),
    "mixed.warc.gz": b"".join((gzip.compress if i % 2 else warc.gzip_member)(r) for i, r in enumerate(RECORDS)),
    "mixed2.warc.gz": gzip.compress(RECORDS[0] + RECORDS[1]) + b"".join(map(warc.gzip_member, RECORDS[2:])),
}


def folder(files):
    path = tempfile.mkdtemp(prefix="warc-test-")
    for name, data in files.items():
        with open(os.path.join(path, name), "wb") as f:
            f.write(data)
    return path


@pytest.mark.parametrize("name", LAYOUTS)
def test_every_layout_is_read(spark, name):
    path = folder({name: LAYOUTS[name]})
    got = sorted((r.page_id, bytes(r.payload)) for r in warc.read_warc(spark, path).collect())
    assert got == list(enumerate(PAYLOADS))
    # Without payloads, and one record alone.
    assert warc.read_warc(spark, path, payload=False).count() == len(PAYLOADS)
    one = warc.read_warc(spark, path).where("page_id = 3 AND record_type = 'response'").collect()
    assert [bytes(r.payload) for r in one] == [PAYLOADS[3]]


def test_predicates_are_pushed():
    from pyspark.sql.datasource import EqualTo, In

    reader = warc.WarcReader("/tmp", 1 << 20, True, False)
    kept = list(reader.pushFilters([
        EqualTo(("page_id",), 7), In(("record_type",), ("response", "revisit")), EqualTo(("payload_bytes",), 3)]))
    assert len(kept) == 1 and reader.wanted == [("x-page-id", ("7",)), ("warc-type", ("response", "revisit"))]


def test_refused_records_inflate_their_headers_only(monkeypatch):
    rng = bytes(os.urandom(1 << 20).hex(), "ascii")
    path = folder({"a.warc.gz": b"".join(warc.gzip_member(record(i, rng)) for i in range(4))})
    file, inflated = os.path.join(path, "a.warc.gz"), []
    inflate = warc.Member.inflate
    monkeypatch.setattr(warc.Member, "inflate", lambda self, most: inflated.append(inflate(self, most)) or inflated[-1])
    seen = 0
    for _, headers, block in warc.file_records(pafs.LocalFileSystem(), file, os.path.getsize(file)):
        if headers["x-page-id"] == "2":
            assert block().endswith(rng)
            inflated.pop()
            inflated.clear()
        else:
            seen += 1
            assert sum(map(len, inflated)) <= 2 * warc.STEP
            inflated.clear()
    assert seen == 3


def test_a_cut_file_is_an_error(spark):
    with pytest.raises(ValueError, match="cut short"):
        path = folder({"a.warc.gz": LAYOUTS["members.warc.gz"][:-30]})
        file = os.path.join(path, "a.warc.gz")
        list(h for _, h, _ in warc.file_records(pafs.LocalFileSystem(), file, os.path.getsize(file)))


def round_trip(spark, df, **options):
    path = tempfile.mkdtemp(prefix="warc-test-") + "/archive"
    warc.write_archive(df, path, **options)
    return warc.read_warc(spark, path, verify=True)


def test_edge_cases(spark):
    rows = [(3, "u", "same"), (1, None, "same"), (2, "a\r\nb\x00", "same"), (None, "n", "same"), (4, "e", None), (5, "e", ""),
            (6, "long", "wort " * 200_000), (7, "r", "twice"), (7, "r", "twice"), (8, "z", "WARC/1.1\r\n\r\n")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for name in ("payload", "sha1", "record_type", "refers_to", "__sha", "__run"):
        df = df.withColumn(name, F.lit("x"))
    got = sorted((r.page_id if r.page_id is not None else 99, r.record_type, r.refers_to, r.payload_bytes) for r in round_trip(spark, df).collect())
    one, four = "<urn:page:1>", "<urn:page:4>"
    assert got == [
        (1, "response", None, 4), (2, "revisit", one, 4), (3, "revisit", one, 4), (4, "response", None, 0), (5, "revisit", four, 0),
        (6, "response", None, 1_000_000), (7, "response", None, 5), (7, "response", None, 5), (8, "response", None, 12),
        (99, "revisit", one, 4)]
    assert round_trip(spark, df.limit(0)).count() == 0
    short = round_trip(spark, df, min_revisit_bytes=5)  # shorter payloads are all responses
    assert {r.record_type for r in short.collect()} == {"response"}
