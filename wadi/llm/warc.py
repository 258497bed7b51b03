"""WARC archives with a two-level capture index.

Writing: every page becomes one WARC/1.1 record in a gzip member of its own; each
task streams its pages into archives of about ``ARCHIVE_BYTES`` in a folder below
the shared one and reports where each record went. A payload of at least
``REVISIT_BYTES`` that equals that of a smaller page id is written as a revisit
record without payload. Files carry a name of their attempt and only reported
ones count, so lost executors and repeated tasks leave stray files at most.

Index: reversed-host URL keys ("com,example,www)/path"), sorted by range
partitions into compressed blocks of ``BLOCK_LINES`` lines; the sparse directory
keeps the first key of each block with the block's file, offset and length; blocks
grow with the captures, so that it has at most about ``DIRECTORY_ROWS`` entries and can be
broadcast. A lookup binary-searches the directory for the blocks of its key,
range-reads those, then range-reads the records; ``captures`` does so for a table of
keys, each block being read once for all of them.

Digests are computed in the JVM and joined without the pages. Pages of which a bitmap of
bounded size tells that they repeat none are written where they are read; only the
others are moved to meet the page that they refer to.

Defined results: a null payload is empty, a null URL has the empty key; equal
payloads under one page id are each a record, the first in the order of the
folder's writing is the response; empty tables make an empty folder and index.
"""

from __future__ import annotations

import bisect
import gzip
import hashlib
import json
import os
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wadi.llm.ids import split_by_ids
from wadi.llm.storage import cut, drop, fetch, fresh_folder

REVISIT_BYTES, ARCHIVE_BYTES, BLOCK_LINES, DIRECTORY_ROWS = 100, 64 << 20, 1000, 500_000
DATE = "2024-01-01T00:00:00Z"


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a folder URI (file, hdfs, s3, gs; a plain path is one of this machine, for tests; queries pass ``qualified`` ones)."""
    return pafs.FileSystem.from_uri(uri if "://" in uri else f"file://{os.path.abspath(uri)}")


def qualified(spark: SparkSession, folder: str) -> str:
    """The folder with its scheme: one without is where the cluster's default file system has it, not on a task's own machine."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    uri = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toUri()
    return f"{uri.getScheme()}://{uri.getAuthority() or ''}{uri.getPath()}"


def url_key(url: str | None) -> str:
    """Reversed-host key of a URL, without scheme, credentials, port 80/443, fragment and letter case of the host."""
    m = re.match(r"(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)(:\d+)?([^#]*)", url or "")
    if not m:
        return url or ""
    port = "" if m[2] in (None, ":80", ":443") else m[2]
    host = m[1].lower().rstrip(".")
    return ",".join(reversed(host.split("."))) + port + ")" + (m[3] or "/")


def _headers(pairs: list[tuple[str, str]]) -> bytes:
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in pairs) + "\r\n").encode("utf-8")


def _line(value: str | None) -> str:
    """A header value on one line."""
    return re.sub(r"[\r\n]+", " ", value or "")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record as a gzip member."""
    body = b"" if refers_to is not None else payload
    head = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"), ("WARC-Date", DATE), ("WARC-Target-URI", _line(url)), ("WARC-Payload-Digest", f"sha256:{digest}"), ("WARC-Payload-Length", str(len(payload)))]
    if refers_to is not None:
        head += [("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    head += [("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(body)))]
    return gzip.compress(_headers(head) + body + b"\r\n\r\n", 6, mtime=0)


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names) and block of a record from its gzip member."""
    raw = zlib.decompress(member, 31)
    top, _, rest = raw.partition(b"\r\n\r\n")
    headers = {}
    for line in top.decode("utf-8").split("\r\n")[1:]:
        name, _, value = line.partition(": ")
        headers[name.lower()] = value
    return headers, rest[: int(headers["content-length"])]


WRITTEN = "page_id long, url string, url_key string, digest string, file string, offset long, length long"


def write_archives(pages: DataFrame, folder: str, revisit_bytes: int = REVISIT_BYTES, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes one record per page; (page_id, url, url_key, digest, file, offset, length) as it stands in the folder."""
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    base = base.withColumn("digest", F.sha2(F.col("html").cast("binary"), 256)).withColumn("big", F.octet_length("html") >= revisit_bytes)
    sums = cut(base.where("big").select("page_id", "digest"))
    firsts = sums.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").select("digest", "refers_to")
    repeats = cut(sums.join(firsts, "digest").where("refers_to < page_id").select("page_id", "digest", "refers_to").distinct())
    drop(sums)
    columns = ("page_id", "url", "html", "digest", "refers_to")
    own, moved = split_by_ids(base, repeats.select("page_id"), "page_id")
    marked = own.withColumn("refers_to", F.lit(None).cast("long")).select(*columns).unionByName(moved.join(repeats, ["page_id", "digest"], "left").select(*columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = open_fs(folder)
        fs.create_dir(path, recursive=True)
        out, name, stream, at = [], None, None, 0
        try:
            for batch in batches:
                for page_id, url, html, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if stream is None or at >= archive_bytes:
                        if stream is not None:
                            stream.close()
                        name, at = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz", 0
                        stream = fs.open_output_stream(f"{path}/{name}", compression=None)
                    member = record(page_id, url, html.encode("utf-8"), digest, refers_to)
                    stream.write(member)
                    out.append((page_id, url, url_key(url), digest, name, at, len(member)))
                    at += len(member)
                if len(out) >= 10_000:
                    yield _rows(out, WRITTEN)
                    out = []
        finally:
            if stream is not None:
                stream.close()
        if out:
            yield _rows(out, WRITTEN)

    # kept at once: a second run of the plan would write the archives again
    return cut(marked.mapInArrow(run, WRITTEN))


_KINDS = {"long": pa.int64(), "string": pa.string(), "int": pa.int32()}


def _rows(out: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, _KINDS[k]) for c, (_, k) in zip(zip(*out, strict=True), fields, strict=True)], names=[n for n, _ in fields])


DIRECTORY = "first_key string, last_key string, block_file string, block_offset long, block_length long, lines long"


def build_index(written: DataFrame, folder: str, block_lines: int = BLOCK_LINES) -> DataFrame:
    """Writes sorted, compressed index blocks; returns the sparse directory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = open_fs(folder)
        fs.create_dir(path, recursive=True)
        name = f"index-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.cdxj.gz"
        stream, at, lines, out = None, 0, [], []

        def flush() -> None:
            nonlocal at, lines, stream
            if not lines:
                return
            if stream is None:
                stream = fs.open_output_stream(f"{path}/{name}", compression=None)
            block = gzip.compress("".join(x for _, x in lines).encode("utf-8"), 6, mtime=0)
            stream.write(block)
            out.append((lines[0][0], lines[-1][0], name, at, len(block), len(lines)))
            at += len(block)
            lines = []

        for batch in batches:
            for key, page_id, digest, file, offset, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                lines.append((key, json.dumps([key, page_id, digest, file, offset, length]) + "\n"))
                if len(lines) == block_lines:
                    flush()
        flush()
        if stream is not None:
            stream.close()
        if out:
            yield _rows(out, DIRECTORY)

    block_lines = max(block_lines, written.count() // DIRECTORY_ROWS)
    rows = written.select("url_key", "page_id", "digest", "file", "offset", "length").repartitionByRange("url_key", "file", "offset").sortWithinPartitions("url_key", "file", "offset")
    return cut(rows.mapInArrow(run, DIRECTORY))


def read_block(fs: pafs.FileSystem, path: str, file: str, offset: int, length: int) -> list[list]:
    """Lines [key, page_id, digest, file, offset, length] of one index block, by a range read."""
    with fs.open_input_file(f"{path}/{file}") as f:
        return [json.loads(x) for x in zlib.decompress(f.read_at(length, offset), 31).decode("utf-8").splitlines()]


class Directory:
    """The sparse directory for lookups: one entry for each block, searched by key."""

    def __init__(self, folder: str, rows: list):
        self.folder = folder
        self.rows = sorted(tuple(r) for r in rows)
        self.first = [r[0] for r in self.rows]

    def blocks(self, key: str) -> Iterator[tuple[str, int, int]]:
        """(file, offset, length) of the blocks that may hold the key."""
        # a key may fill several blocks: begin with the last block that starts before it
        i = max(0, bisect.bisect_left(self.first, key) - 1)
        while i < len(self.rows) and self.first[i] <= key:
            _, last, file, offset, length, _ = self.rows[i]
            if last >= key:
                yield file, offset, length
            i += 1

    def lookup(self, url: str) -> list[tuple[dict[str, str], bytes]]:
        """All captures of a URL: headers and payload block."""
        key = url_key(url)
        fs, path = open_fs(self.folder)
        found = []
        for file, offset, length in self.blocks(key):
            for k, _, _, warc, at, size in read_block(fs, path, file, offset, length):
                if k == key:
                    with fs.open_input_file(f"{path}/{warc}") as f:
                        found.append(parse(f.read_at(size, at)))
        return found


RESULT = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


FOUND = "block_file string, block_offset long, block_length long, key string"


def _page(urn: str | None) -> int | None:
    got = re.fullmatch(r"<urn:page:(-?\d+)>", urn or "")
    return int(got[1]) if got else None


def captures(keys: DataFrame, directory: DataFrame, folder: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of all captures of the ``keys`` (one column).

    Every key is searched in the directory; blocks that hold any are dealt to
    tasks and read once, their records range-read file by file.
    """
    spark = keys.sparkSession
    rows = fetch(directory)
    held = spark.sparkContext.broadcast(Directory(folder, list(rows.itertuples(index=False, name=None))))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(*block, key) for key in batch.column(0).to_pylist() for block in held.value.blocks(key)]
            if out:
                yield _rows(out, FOUND)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = open_fs(folder)
        block, wanted = None, set()

        def read() -> pa.RecordBatch:
            out, at, f = [], None, None
            for key, _, digest, warc, start, size in sorted(read_block(fs, path, *block), key=lambda x: (x[3], x[4])):
                if key not in wanted:
                    continue
                if warc != at:
                    if f is not None:
                        f.close()
                    f, at = fs.open_input_file(f"{path}/{warc}"), warc
                headers, payload = parse(f.read_at(size, start))
                kind, said = headers["warc-type"], headers["warc-payload-digest"].removeprefix("sha256:")
                n = int(headers["warc-payload-length"])
                if kind == "response":
                    said, n = hashlib.sha256(payload).hexdigest(), len(payload)
                if said != digest:
                    raise ValueError(f"the record at {warc}:{start} does not hold what its index line says")
                out.append((_page(headers["warc-record-id"]), n, said, kind, _page(headers.get("warc-refers-to"))))
            if f is not None:
                f.close()
            return _rows(out, RESULT)

        for batch in batches:
            for *own, key in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own != block and block is not None:
                    yield read()
                    wanted = set()
                block = own
                wanted.add(key)
        if block is not None:
            yield read()

    # by number, so that small rows which stand for large reads are not put together
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    where = keys.distinct().mapInArrow(search, FOUND).repartition(n, "block_file", "block_offset")
    return where.sortWithinPartitions("block_file", "block_offset").mapInArrow(run, RESULT)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = qualified(spark, fresh_folder(spark, "warc"))
    written = write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    return captures(written.select("url_key"), build_index(written, folder), folder)


OP9_SQL = r"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha256(coalesce(html, '')) AS d, strlen(coalesce(html, '')) AS n FROM pages
), f AS (SELECT d, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, p.d AS payload_digest,
  CASE WHEN n >= 100 AND first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 100 AND first < page_id THEN first END AS refers_to
FROM p LEFT JOIN f ON p.d = f.d
"""
