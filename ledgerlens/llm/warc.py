"""WARC archives: a PySpark Python data source that writes and reads them.

Writing: each task writes gzip files of bounded size, one gzip member a
record, and reports the files it finished; the commit renames those from
the staging folder, so attempts that failed leave nothing behind.  Each
member carries its own length in the gzip header's extra field (``sl``).

Reading: the plan bins whole files into partitions of bounded size.  Per
record only the WARC headers are inflated first, in steps of ``STEP`` bytes;
equality predicates on record type, page id and header columns are pushed
into the reader and tested there, and the payload of a record that is not
wanted (predicate, or no payload column and no verification) is skipped by
the member length: no more than one step of it is inflated.  Foreign files
(plain, gzip members without that length, one member for a whole file, or a
mixture) are read too, with a seek or a read over the payload.

Defined cases: a null payload is empty; a null url gives no target header,
control characters in it are written percent-encoded; rows with equal
payloads and the same smallest id (repeated rows) are all responses; a null
id counts as larger than all others; extra columns are ignored; an empty
table gives an empty folder, which reads as no records.
"""

from __future__ import annotations

import base64
import hashlib
import io
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualNullSafe,
    EqualTo,
    In,
    InputPartition,
    WriterCommitMessage,
)

from ledgerlens.llm.common import scratch_path
from ledgerlens.llm.exact_dedup import LEAF_RUNS, leaf_runs, spread_down

DATE = "1970-01-01T00:00:00Z"  # pages carry no fetch time
HTTP_OK = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
END = b"\r\n\r\n"
RECORD_COLUMNS = (
    "file string, offset long, record_type string, record_id string, target_uri string, content_type string, "
    "payload_digest string, refers_to string, page_id long, payload_bytes long"
)
# Column -> WARC header whose value it holds; predicates on these are tested in the reader.
HEADER_OF = {
    "record_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri",
    "content_type": "content-type", "payload_digest": "warc-payload-digest", "refers_to": "warc-refers-to",
    "page_id": "x-page-id",
}
STEP = 2048  # plain bytes that are inflated at a time while looking for the end of headers
READ = 1 << 16  # packed bytes read at a time


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    uri = re.sub(r"^file:/+", "file:///", path)
    return pafs.FileSystem.from_uri(uri if "://" in uri else os.path.abspath(uri))


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# ---------------------------------------------------------------- writing


def gzip_member(data: bytes, level: int = 6) -> bytes:
    """One gzip member whose extra field holds its full and its plain length."""
    packer = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    total = 12 + 12 + len(body) + 8
    extra = b"sl" + struct.pack("<HII", 8, total, len(data) & 0xFFFFFFFF)
    head = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", len(extra))
    return head + extra + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def record_bytes(record_type: str, page_id, url, payload: bytes, digest: str, size: int, refers_to) -> bytes:
    """A response record (payload in an HTTP block) or a revisit (no payload)."""
    block = HTTP_OK + (payload if record_type == "response" else b"")
    lines = ["WARC/1.1", f"WARC-Type: {record_type}", f"WARC-Date: {DATE}"]
    lines.append(f"WARC-Record-ID: <urn:page:{page_id}>" if page_id is not None else f"WARC-Record-ID: <urn:payload:{digest}>")
    if page_id is not None:
        lines.append(f"X-Page-Id: {page_id}")
    if url is not None:
        clean = re.sub(r"[\x00-\x1f\x7f-\x9f]", lambda m: f"%{ord(m[0]):02X}", url)
        lines.append(f"WARC-Target-URI: {clean}")
    lines.append(f"WARC-Payload-Digest: sha1:{digest}")
    if refers_to is not None:
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        lines.append(f"WARC-Refers-To: <urn:page:{refers_to}>")
    lines += [f"X-Payload-Bytes: {size}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + END + block + END


@dataclass
class _Files(WriterCommitMessage):
    names: list[str]


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, path: str, file_bytes: int):
        self.path, self.file_bytes = path, file_bytes
        self.staging = f"{path.rstrip('/')}/_staging-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Files:
        fs, staging = _open(self.staging)
        names, out, held = [], None, 0
        for batch in iterator:
            for row in batch.to_pylist():
                if out is None:
                    fs.create_dir(staging, recursive=True)
                    names.append(f"part-{uuid.uuid4().hex}.warc.gz")
                    out, held = fs.open_output_stream(f"{staging}/{names[-1]}", compression=None), 0
                payload = row["payload"] or b""
                digest = base64.b32encode(bytes.fromhex(row["sha1"])).decode()
                member = gzip_member(record_bytes(
                    row["record_type"], row["page_id"], row["url"], payload, digest, row["payload_bytes"], row["refers_to"]))
                out.write(member)
                held += len(member)
                if held >= self.file_bytes:
                    out.close()
                    out = None
        if out is not None:
            out.close()
        return _Files(names)

    def commit(self, messages: list) -> None:
        fs, staging = _open(self.staging)
        _, target = _open(self.path)
        fs.create_dir(target, recursive=True)
        for message in messages:
            for name in message.names if message else []:
                fs.move(f"{staging}/{name}", f"{target}/{name}")
        self._clear(fs, staging)

    def abort(self, messages: list) -> None:
        self._clear(*_open(self.staging))

    @staticmethod
    def _clear(fs: pafs.FileSystem, staging: str) -> None:
        if fs.get_file_info(staging).type != pafs.FileType.NotFound:
            fs.delete_dir(staging)


# ---------------------------------------------------------------- reading


def parse_headers(raw: bytes) -> dict[str, str]:
    """WARC header fields by lower-case name."""
    fields = (line.partition(":") for line in raw.decode("utf-8", "replace").split("\r\n")[1:])
    return {name.strip().lower(): value.strip() for name, _, value in fields}


def _skip_lengths(head: bytes) -> int | None:
    """The member length in a gzip header, where it has one."""
    if len(head) >= 24 and head[:3] == b"\x1f\x8b\x08" and head[3] & 4 and head[12:14] == b"sl":
        return struct.unpack("<I", head[16:20])[0]
    return None


class Member:
    """The plain bytes of the gzip member that starts at ``at``, inflated as
    they are asked for."""

    def __init__(self, f, at: int, packed: int | None = None):
        self.f, self.next, self.left = f, at, packed  # left: packed bytes, where they are known
        self.unpack, self.held, self.data, self.end = zlib.decompressobj(31), b"", b"", None

    def inflate(self, most: int) -> bytes:
        """Up to ``most`` further bytes; empty at the end of the member."""
        while self.end is None:
            if not self.data:
                n = min(READ, max(STEP, most)) if self.left is None else min(READ, max(STEP, most), self.left)
                self.f.seek(self.next)
                self.data = self.f.read(n)
                if not self.data:
                    raise ValueError(f"gzip member is cut short at byte {self.next}")
                self.next += len(self.data)
                self.left = None if self.left is None else self.left - len(self.data)
            out = self.unpack.decompress(self.data, most)
            self.data = self.unpack.unconsumed_tail
            if self.unpack.eof:
                self.end = self.next - len(self.unpack.unused_data)
            if out:
                return out
        return b""

    def readline(self) -> bytes:
        while (at := self.held.find(b"\n")) < 0 and (more := self.inflate(STEP)):
            self.held += more
        cut = at + 1 if at >= 0 else len(self.held)
        line, self.held = self.held[:cut], self.held[cut:]
        return line

    def read(self, n: int) -> bytes:
        parts, have = [self.held], len(self.held)
        while have < n and (more := self.inflate(n - have)):
            parts.append(more)
            have += len(more)
        whole = b"".join(parts)
        self.held = whole[n:]
        return whole[:n]

    def skip(self, n: int) -> None:
        while n > 0 and (got := len(self.read(min(n, 1 << 20)))):
            n -= got


def streamed_records(f, skip):
    """(offset, headers, block reader) of each record of a byte stream;
    ``skip(n)`` passes over n bytes.  A block is read only when its reader is
    called."""
    at = 0
    while True:
        line = f.readline()
        while line in (b"\r\n", b"\n"):
            at += len(line)
            line = f.readline()
        if not line:
            return
        start, raw = at, line
        while line not in (b"\r\n", b"\n", b""):
            line = f.readline()
            raw += line
        headers = parse_headers(raw.rstrip(b"\r\n"))
        at += len(raw)
        left = [int(headers.get("content-length", "0"))]
        at += left[0]

        def block(left=left) -> bytes:
            n, left[0] = left[0], 0
            return f.read(n)

        yield start, headers, block
        skip(left[0])


def member_records(f, size: int):
    """The records of a file of gzip members; offsets are those of members,
    and where one member holds several records, of the plain bytes in it."""
    at = 0
    while at < size:
        f.seek(at)
        length = _skip_lengths(f.read(24))
        member = Member(f, at, length)
        if length is not None:
            for _, headers, block in streamed_records(member, lambda n: None):
                yield at, headers, block
                break  # one record a member; the rest is passed over unread
            at += length
        else:
            for offset, headers, block in streamed_records(member, member.skip):
                yield at + offset, headers, block
            at = member.end


def file_records(fs: pafs.FileSystem, path: str, size: int):
    with fs.open_input_file(path) as f:
        head = f.read(2)
        f.seek(0)
        if head == b"\x1f\x8b":
            yield from member_records(f, size)
        else:
            plain = io.BufferedReader(f, READ)
            yield from streamed_records(plain, lambda n: plain.seek(n, io.SEEK_CUR))


@dataclass
class _FileGroup(InputPartition):
    files: list[tuple[str, int]]


class WarcReader(DataSourceReader):
    def __init__(self, path: str, partition_bytes: int, payload: bool, verify: bool):
        self.path, self.partition_bytes, self.payload, self.verify = path, partition_bytes, payload, verify
        self.wanted: list[tuple[str, tuple]] = []  # (header, accepted values)

    def pushFilters(self, filters):
        for f in filters:
            column = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
            if column in HEADER_OF and isinstance(f, EqualTo | EqualNullSafe) and f.value is not None:
                self.wanted.append((HEADER_OF[column], (str(f.value),)))
            elif column in HEADER_OF and isinstance(f, In) and None not in f.value:
                self.wanted.append((HEADER_OF[column], tuple(map(str, f.value))))
            else:
                yield f

    def partitions(self):
        fs, root = _open(self.path)
        info = fs.get_file_info(root)
        found = [info] if info.is_file else fs.get_file_info(pafs.FileSelector(root))
        found = [f for f in found if f.is_file and re.search(r"\.warc(\.gz)?$", f.base_name)]
        groups, held = [], 0
        for f in sorted(found, key=lambda f: f.path):
            if not groups or held + f.size > self.partition_bytes:
                groups.append(_FileGroup([]))
                held = 0
            groups[-1].files.append((f.path, f.size))
            held += f.size
        return groups or [_FileGroup([])]

    def read(self, partition):
        fs, _ = _open(self.path)
        rows, held = [], 0
        for path, size in partition.files:
            for offset, headers, block in file_records(fs, path, size):
                if any(headers.get(name) not in values for name, values in self.wanted):
                    continue
                row = self.row(path, offset, headers, block)
                rows.append(row)
                held += len(row[-1] or b"") if self.payload else 1
                if len(rows) >= 4096 or held >= 16 << 20:
                    yield self.batch(rows)
                    rows, held = [], 0
        if rows:
            yield self.batch(rows)

    def row(self, path, offset, headers, block) -> tuple:
        kind, payload, size = headers.get("warc-type"), None, headers.get("x-payload-bytes")
        if kind != "revisit" and (self.payload or self.verify):
            body = block()
            if headers.get("content-type", "").startswith("application/http"):
                body = body.partition(END)[2]
            if self.verify and headers.get("warc-payload-digest") not in (None, f"sha1:{base32_sha1(body)}"):
                raise ValueError(f"{path}, byte {offset}: the payload does not have the digest of its header")
            payload, size = body, len(body)
        page = headers.get("x-page-id")  # written without leading zeros
        return (
            path, offset, kind, headers.get("warc-record-id"), headers.get("warc-target-uri"), headers.get("content-type"),
            headers.get("warc-payload-digest"), headers.get("warc-refers-to"),
            None if page is None else int(page), None if size is None else int(size), *((payload,) if self.payload else ()),
        )

    def batch(self, rows: list[tuple]) -> pa.RecordBatch:
        text, number = pa.string(), pa.int64()
        kinds = [text, number, text, text, text, text, text, text, number, number, pa.binary()]
        names = [c.split()[0] for c in RECORD_COLUMNS.split(", ")] + ["payload"]
        columns = [pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=False)]
        return pa.RecordBatch.from_arrays(columns, names[: len(columns)])


class WarcDataSource(DataSource):
    """Options: ``path``; reading: ``payload`` (a payload column), ``verify``
    (digests of payloads that are read), ``partition_bytes``; writing:
    ``file_bytes``."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def _flag(self, name: str, default: str) -> bool:
        return self.options.get(name, default).lower() == "true"

    def schema(self) -> str:
        return RECORD_COLUMNS + (", payload binary" if self._flag("payload", "true") else "")

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options["path"], int(self.options.get("partition_bytes", 128 << 20)),
                          "payload" in schema.fieldNames(), self._flag("verify", "false"))

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"], int(self.options.get("file_bytes", 64 << 20)))


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


def read_warc(spark: SparkSession, path: str, *, payload: bool = True, verify: bool = False) -> DataFrame:
    register(spark)
    return (spark.read.format("warc").option("payload", str(payload).lower())
            .option("verify", str(verify).lower()).load(path))


# ------------------------------------------------- archive of a page table


def record_plan(pages: DataFrame, id_col: str, url_col: str, payload_col: str, min_revisit_bytes: int = 0) -> DataFrame:
    """One row per page with its record type: of pages with equal payloads
    the smallest id is the response, the others revisit it; payloads shorter
    than ``min_revisit_bytes`` are all responses.

    The smallest id per digest comes from the merge rounds of the exact
    duplicates (runs of a digest are merged before the last shuffle), and the
    pages meet it by (digest, run), so copies of one payload are spread over
    ``LEAF_RUNS`` keys."""
    body = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    keyed = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), body.alias("payload"),
    ).withColumns({"__sha": F.unhex(F.sha1("payload")), "__len": F.octet_length("payload"),
                   "__run": F.pmod(F.xxhash64("page_id"), F.lit(LEAF_RUNS)).cast("int")})
    order = F.struct(F.col("page_id").isNull().alias("n"), F.col("page_id").alias("id"))
    first = spread_down(leaf_runs(keyed, order))
    own: Column = (F.col("__len") < min_revisit_bytes) | F.col("page_id").eqNullSafe(F.col("__best.id"))
    return keyed.join(first, ["__sha", "__len", "__run"]).select(
        "page_id", "url", F.when(own, F.col("payload")).alias("payload"),
        F.hex("__sha").alias("sha1"), F.col("__len").cast("long").alias("payload_bytes"),
        F.when(own, "response").otherwise("revisit").alias("record_type"),
        F.when(~own, F.col("__best.id")).alias("refers_to"),
    )


def write_archive(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url",
                  payload_col: str = "html", min_revisit_bytes: int = 0) -> None:
    register(pages.sparkSession)
    plan = record_plan(pages, id_col, url_col, payload_col, min_revisit_bytes)
    plan.write.format("warc").mode("append").save(path)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    write_archive(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return read_warc(spark, path, payload=False, verify=True).select(
        "page_id", "payload_bytes",
        F.regexp_replace("payload_digest", "^sha1:", "").alias("payload_digest"),
        "record_type",
        F.regexp_extract("refers_to", r"<urn:page:(-?\d+)>", 1).try_cast("long").alias("refers_to"),
    )


SQL = """
WITH body AS (
  SELECT page_id, sha1(coalesce(html, '')) AS hex, octet_length(encode(coalesce(html, ''))) AS payload_bytes FROM pages),
least AS (SELECT *, min(page_id) OVER (PARTITION BY hex, payload_bytes) AS first FROM body)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(8), lambda i: array_to_string(list_transform([15, 10, 5, 0], lambda k:
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                1 + CAST((CAST('0x' || substr(hex, 5 * i::INT + 1, 5) AS BIGINT) >> k) & 31 AS INT), 1)), '')), '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM least
"""
