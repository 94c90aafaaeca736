"""WARC archives and their two-level capture index.

*Archives.* Every page is one record, compressed on its own. Payloads are the HTML in UTF-8, in an HTTP
response. Of records with equal payloads of ``REVISIT_BYTES`` or more, that with the largest id is the
response and the others revisit it: they hold the HTTP header, the digest and the reference only.

Archives are written by Spark's text writer, so they can go to any file system Spark writes to, and lost
tasks leave nothing behind. A record is one row, raw bytes read as text; the line separator is an empty
gzip member, which readers of gzip skip. Files hold at most ``RECORDS`` records, and fewer where the largest page is so
large that they could exceed ``FILE_BYTES``: they are read back whole, which ends at 2 GB a file.

*Index.* Captures (key, id, file, offset, length) are range-sorted by reversed-host key and packed in
blocks of ``BLOCK`` lines, each a gzip member, ``PART`` captures a file on average; the list of the first keys of all
files, the upper level, is one row for a quarter of a million captures and is sent to all tasks. The lower level
is a sparse directory: the first key, offset and length of each block of a file. A look-up searches both
levels by halving, reads the range of one block, searches that, and reads the range of each record.

Queries are sorted like the index and read as a stream: a task holds one file's directory and one block
at a time. Queries are (key, id), so a key with very many captures is spread over tasks as well.

Ranges are read with ``pyarrow.fs`` (local, HDFS, S3, GCS), as Spark itself reads no ranges of binary files.

Defined results: a null HTML is an empty payload, a null address the key ``-``. Pages with a null id are
written and found, but nothing revisits them. Pages equal in id and payload share their record type and are
found once a row. Other columns are ignored. An empty table gives empty archives and no result.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.llm import common
from leadloom.llm.common import cut, shared_path

REVISIT_BYTES = 1000
BLOCK = 1000
PART = 1 << 18         # captures of an index file
RECORDS = 2000         # records of an archive
FILE_BYTES = 1 << 30   # of an archive, before compression
EMPTY = gzip.compress(b"", mtime=0)  # 20 bytes: the separator of records
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"


# ------------------------------------------------------------------ keys
def url_key(url: str | None) -> str:
    """Sort key of an address: host labels in reverse, then port, path and query; without scheme, ``www.`` and fragment."""
    if not url:
        return "-"
    rest = re.sub(r"^[a-z][a-z0-9+.-]*://", "", re.sub(r"[\r\n]", " ", url).strip(), flags=re.I).split("#")[0]
    host, slash, path = rest.partition("/")
    host, query_at, query = host.partition("?")
    host = host.rpartition("@")[2].lower()
    host, colon, port = host.partition(":")
    host = re.sub(r"^www\d*\.", "", host)
    out = ",".join(reversed(host.split("."))) + (f":{port}" if port not in ("", "80", "443") else "") + ")/" + path + (f"?{query}" if query_at else "")
    return re.sub(r"[\x00-\x20]", lambda m: f"%{ord(m[0]):02X}", out)


def _capture(key: str, page_id: int | None) -> str:
    """A capture's place in the order of the index; null ids first."""
    return f"{key} {'-' if page_id is None else f'{page_id + (1 << 63):020d}'}"


# ------------------------------------------------------------------ records
def _record(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if refers_to is not None else http + payload
    name = "null" if page_id is None else str(page_id)
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{name}>", f"WARC-Date: {DATE}",
            f"WARC-Target-URI: {re.sub(r'[\r\n]', ' ', url or '')}", f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
            "Content-Type: application/http;msgtype=response"]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    return "\r\n".join([*head, f"Content-Length: {len(body)}", "", ""]).encode() + body + b"\r\n\r\n"


def read_record(data: bytes) -> dict:
    """Fields of an uncompressed record, read from its header and block alone."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    body = rest[:int(fields["Content-Length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    kind = fields["WARC-Type"]
    stored = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    if kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != stored):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    number = lambda uri: None if uri is None or uri == "<urn:page:null>" else int(uri[10:-1])
    return {"page_id": number(fields["WARC-Record-ID"]), "payload_bytes": size, "payload_digest": stored, "record_type": kind,
            "refers_to": number(fields.get("WARC-Refers-To")), "url": fields["WARC-Target-URI"]}


def _members(data: bytes) -> Iterator[tuple[int, int, bytes]]:
    """Offset, length and contents of each gzip member that is not empty."""
    at, view = 0, memoryview(data)
    while at < len(data):
        unzip, end, out = zlib.decompressobj(31), at, b""
        while not unzip.eof:
            if end >= len(data):
                raise ValueError("archive ends inside a record")
            out += unzip.decompress(view[end:end + 16384])
            end += 16384
        end = min(end, len(data)) - len(unzip.unused_data)
        if out:
            yield at, end - at, out
        at = end


def _zip(data: bytes) -> bytes:
    return gzip.compress(data, 6, mtime=0)


# ------------------------------------------------------------------ writing
def _decide(pages: DataFrame) -> DataFrame:
    """``page_id, digest, refers_to`` of the pages that revisit another one."""
    payload = F.coalesce("html", F.lit("")).cast("binary")
    slim = pages.select("page_id", F.sha1(payload).alias("digest"), F.octet_length(payload).alias("size")).where(F.col("size") >= REVISIT_BYTES)
    slim = cut(slim.select("page_id", "digest"))
    # written first, so that the join reads exchanges only and a digest with very many pages can be split
    last = cut(slim.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).drop("n"))
    return slim.join(last, "digest").where(F.col("page_id") < F.col("refers_to")).distinct()


def records_for(largest: int) -> int:
    """Records of a file whose largest page has so many bytes."""
    return max(1, min(RECORDS, FILE_BYTES // (largest + 4096)))


def write_archives(pages: DataFrame, path: str) -> None:
    """Archives of ``page_id, url, html`` under ``path``."""
    largest = pages.agg(F.coalesce(F.max(F.octet_length("html")), F.lit(0)).alias("n")).first()["n"]
    revisits = _decide(pages).select(F.col("page_id").alias("_id"), F.col("digest").alias("_digest"), "refers_to")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha1(F.col("html").cast("binary")))
    rows = rows.join(revisits, (rows["page_id"] == revisits["_id"]) & (rows["digest"] == revisits["_digest"]), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.chunks(batches, "html"):
            page, url, html, digest, refers = (batch.column(i).to_pylist() for i in range(5))
            yield pa.RecordBatch.from_arrays([pa.array([_zip(_record(p, u, h.encode(), d, r)) for p, u, h, d, r in zip(page, url, html, digest, refers)], pa.binary())], ["record"])

    records = rows.select("page_id", "url", "html", "digest", "refers_to").mapInArrow(run, "record binary")
    _write_members(records, "record", path, records_for(largest))


def _write_members(rows: DataFrame, column: str, path: str, per_file: int) -> None:
    """Gzip members, one a row, as files: Spark's text writer, with an empty member between rows."""
    as_text = rows.select(F.col(column).cast("string").alias("value"))
    as_text.write.option("encoding", "ISO-8859-1").option("lineSep", EMPTY.decode("latin-1")).option("maxRecordsPerFile", per_file).text(path)


def captures(spark: SparkSession, path: str) -> DataFrame:
    """``capture, file, offset, length`` of every record of the archives under ``path``, read back from them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows = []
                for at, length, out in _members(data.as_py()):
                    found = read_record(out)
                    rows.append((_capture(url_key(found["url"]), found["page_id"]), name, at, length))
                columns = list(zip(*rows)) if rows else [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.int64()))], ["capture", "file", "offset", "length"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("path", "content").mapInArrow(run, "capture string, file string, offset long, length long")


# ------------------------------------------------------------------ index
def write_index(spark: SparkSession, archives: str, path: str, block: int = BLOCK) -> None:
    """Index of the archives: ``path``/blocks (compressed lines) and ``path``/directory (file, first, offset, length)."""
    found = cut(captures(spark, archives))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-found.count() // PART))
    rows = found.repartitionByRange(parts, "capture", "file", "offset").sortWithinPartitions("capture", "file", "offset")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[str] = []
        for batch in batches:
            held += ["\t".join(map(str, row)) for row in zip(*(batch.column(i).to_pylist() for i in range(4)))]
            full = len(held) // block * block
            if full:
                yield pa.RecordBatch.from_arrays([pa.array([_zip("\n".join(held[i:i + block]).encode()) for i in range(0, full, block)], pa.binary())], ["lines"])
                held = held[full:]
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([_zip("\n".join(held).encode())], pa.binary())], ["lines"])

    _write_members(rows.mapInArrow(pack, "lines binary"), "lines", f"{path}/blocks", 0)

    def list_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                number = int(re.search(r"part-(\d+)", name)[1])
                found = [(number, name, out.split(b"\t", 1)[0].decode(), at, length) for at, length, out in _members(data.as_py())]
                columns = list(zip(*found)) if found else [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64()))], ["part", "file", "first", "offset", "length"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{path}/blocks")
    listed = files.select("path", "content").mapInArrow(list_blocks, "part int, file string, first string, offset long, length long")
    listed.write.partitionBy("part").parquet(f"{path}/directory")


def _uri(path: str) -> str:
    """A path of Spark's as an address that pyarrow takes."""
    return re.sub(r"^file:/+", "file:///", path) if ":" in path.split("/")[0] else f"file://{path}"


class Reader:
    """Ranges of files, with the last files kept open."""

    def __init__(self, keep: int = 16):
        self.keep, self.open = keep, {}

    def __call__(self, name: str, at: int, length: int) -> bytes:
        if name not in self.open:
            if len(self.open) >= self.keep:
                self.open.pop(next(iter(self.open))).close()
            where, path = pafs.FileSystem.from_uri(_uri(name))
            self.open[name] = where.open_input_file(path)
        return self.open[name].read_at(length, at)


def look_up(queries: DataFrame, index: str, read: bool = True) -> DataFrame:
    """Records of the index at ``queries`` (``capture``): ``page_id, payload_bytes, payload_digest, record_type,
    refers_to, url, file, offset, length``, one row for each record that has the capture asked for."""
    spark = queries.sparkSession
    directory = spark.read.schema("file string, first string, offset long, length long, part int").parquet(f"{index}/directory")
    upper = sorted((r["first"], r["part"], r["file"]) for r in directory.groupBy("part", "file").agg(F.min("first").alias("first")).collect())  # one row a file: one for PART captures
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))  # named, so that few bytes of queries are not put in one task
    wanted = queries.select("capture").distinct().repartitionByRange(tasks, "capture").sortWithinPartitions("capture")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranges = Reader()
        keys = [x[0] for x in upper]
        lower: dict[int, tuple[list, list]] = {}
        block_at, lines = None, []

        def load(part: int) -> tuple[list, list]:
            if part not in lower:
                lower.clear()
                lower[part] = _read_directory(f"{index}/directory/part={part}")
            return lower[part]

        def block(name: str, at: int, length: int) -> list[list[str]]:
            nonlocal block_at, lines
            if block_at != (name, at):
                text = zlib.decompress(ranges(name, at, length), 31).decode()
                block_at, lines = (name, at), [x.split("\t") for x in text.split("\n")]
            return lines

        def find(capture: str) -> Iterator[list[str]]:
            for i in range(max(0, bisect_left(keys, capture) - 1), bisect_right(keys, capture)):
                firsts_, places = load(upper[i][1])
                for j in range(max(0, bisect_left(firsts_, capture) - 1), bisect_right(firsts_, capture)):
                    rows = block(upper[i][2], *places[j])
                    k = bisect_left(rows, capture, key=lambda x: x[0])
                    while k < len(rows) and rows[k][0] == capture:
                        yield rows[k]
                        k += 1

        for batch in batches:
            out = []
            for capture in batch.column(0).to_pylist():
                for _, name, at, length in find(capture):
                    one = read_record(zlib.decompress(ranges(name, int(at), int(length)), 31)) if read else {}
                    out.append({**one, "file": name, "offset": int(at), "length": int(length)})
            yield pa.RecordBatch.from_pylist(out, schema=FOUND)

    return wanted.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, file string, offset long, length long")


FOUND = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()),
                   ("refers_to", pa.int64()), ("url", pa.string()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])


def _read_directory(path: str) -> tuple[list[str], list[tuple[int, int]]]:
    """First keys and ranges of the blocks of one index file, in order."""
    where, folder = pafs.FileSystem.from_uri(_uri(path))
    rows = []
    for info in where.get_file_info(pafs.FileSelector(folder)):
        if info.base_name.endswith(".parquet"):
            table = pq.read_table(where.open_input_file(info.path), columns=["first", "offset", "length"])
            rows += zip(*(table.column(i).to_pylist() for i in range(3)))
    rows.sort(key=lambda x: x[1])
    return [r[0] for r in rows], [r[1:] for r in rows]


def capture_of(url: str = "url", page_id: str = "page_id"):
    """Column of the capture key of a page."""
    @F.pandas_udf("string")
    def of(urls: pd.Series, ids: pd.Series) -> pd.Series:
        return pd.Series([_capture(url_key(u), None if i is None or i == "" else int(i)) for u, i in zip(urls, ids)])

    return of(F.col(url), F.coalesce(F.col(page_id).cast("string"), F.lit("")))


def archive_round_trip(pages: DataFrame, read: bool = True) -> DataFrame:
    """Write archives and index of ``pages`` to the shared folder and look every page up in them."""
    spark = pages.sparkSession
    path = shared_path(spark, "warc")
    write_archives(pages, f"{path}/archives")
    write_index(spark, f"{path}/archives", f"{path}/index")
    return look_up(pages.select(capture_of().alias("capture")), f"{path}/index", read)
