"""Python data sources: corpora in sections behind a folder or an address, and growing PCM files as a stream.

``spark.dataSource.register(Sections)``, then ``spark.read.format("sections")``. Each
(edition, section) is a partition of its own, fetched by the task that reads it; a failed
fetch is tried again after a growing wait, a section that does not exist, or cannot be
had, is skipped. ``spark.readStream.format("pcm")`` reads what was appended to the files
of a folder; offsets are bytes by file, in whole samples, so a sample split between two
appends waits for its other byte, and a restart goes on where the checkpoint says.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition


def _filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def fetch(address: str) -> bytes | None:
    """The bytes behind an address or path; None if nothing is there or it is forbidden."""
    try:
        if address.startswith(("http://", "https://")):
            with urllib.request.urlopen(address, timeout=30) as answer:
                return answer.read()
        fs, path = _filesystem(address)
        with fs.open_input_stream(path) as f:
            return f.read()
    except FileNotFoundError:
        return None
    except urllib.error.HTTPError as e:
        if e.code in (403, 404):
            return None
        raise


def fetch_json(address: str, tries: int = 3, wait: float = 1.5, get=fetch) -> dict | None:
    """The JSON behind an address, tried ``tries`` times with a growing wait; None if it cannot be had."""
    for attempt in range(1, tries + 1):
        try:
            data = get(address)
            return None if data is None else json.loads(data)
        except (OSError, ValueError):
            if attempt < tries:
                time.sleep(wait * attempt)
    return None


@dataclass
class Section(InputPartition):
    edition: str
    number: int


class SectionReader(DataSourceReader):
    def __init__(self, options: dict, get):
        self.root, self.get = options["path"].rstrip("/"), get
        self.editions = [(name, int(n)) for name, n in (e.split(":") for e in options["editions"].split(","))]
        self.tries, self.wait = int(options.get("tries", 3)), float(options.get("wait", 1.5))

    def partitions(self) -> list[Section]:
        return [Section(name, n) for name, last in self.editions for n in range(1, last + 1)]

    def read(self, partition: Section) -> Iterator[tuple]:
        page = fetch_json(f"{self.root}/editions/{partition.edition}/sections/{partition.number}.json", self.tries, self.wait, self.get)
        if page is None:
            return
        title = (page.get("metadata") or {}).get("section") or {}
        name = title.get(str(partition.number)) if isinstance(title, dict) else str(title)
        for item in page.get("hadiths") or []:
            grades = [(g.get("name"), g.get("grade")) for g in item.get("grades") or []]
            yield partition.edition, partition.number, str(item.get("hadithnumber")), name, item.get("text"), grades


class Sections(DataSource):
    """Options: path (folder or address), editions ("name:sections,name:sections"), tries, wait (seconds)."""

    get = staticmethod(fetch)

    @classmethod
    def name(cls) -> str:
        return "sections"

    def schema(self) -> str:
        return "edition string, section int, number string, section_name string, text string, grades array<struct<name:string,grade:string>>"

    def reader(self, schema) -> DataSourceReader:
        return SectionReader(dict(self.options), type(self).get)


def paired(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """(book, section, number, text, other_text, section_name, grades) of the numbers that both editions of a pair (edition, other, book) have; sections that one lacks go."""
    left = rows.join(F.broadcast(pairs), "edition")  # a row for each book
    right = rows.select(F.col("edition").alias("other"), "section", "number", F.col("text").alias("other_text"))
    return left.join(right, ["other", "section", "number"]).select("book", "section", "number", "text", "other_text", "section_name", "grades")


@dataclass
class Bytes(InputPartition):
    path: str
    start: int
    end: int


class PcmReader(DataSourceStreamReader):
    #: Bytes that one task reads of a file.
    BLOCK = 1 << 20

    def __init__(self, options: dict):
        self.root, self.block = options["path"], int(options.get("block", self.BLOCK)) // 2 * 2

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        fs, root = _filesystem(self.root)
        files = fs.get_file_info(pafs.FileSelector(root))
        return {f.base_name: f.size // 2 * 2 for f in files if f.base_name.endswith(".pcm")}

    def partitions(self, start: dict, end: dict) -> list[Bytes]:
        root = self.root.rstrip("/")
        return [Bytes(f"{root}/{name}", at, min(at + self.block, upto)) for name, upto in sorted(end.items()) for at in range(start.get(name, 0), upto, self.block)]

    def read(self, partition: Bytes) -> Iterator[tuple]:
        fs, path = _filesystem(partition.path)
        with fs.open_input_file(path) as f:
            data = f.read_at(partition.end - partition.start, partition.start)
        samples = np.frombuffer(data, "<i2").astype(np.float32) / 32768
        yield path.rsplit("/", 1)[-1][:-4], partition.start // 2, samples.tolist()

    def commit(self, end: dict) -> None:
        pass


class Pcm(DataSource):
    """16-bit little-endian samples of the ``.pcm`` files below a path: (key, start, samples); options: path, block (bytes)."""

    @classmethod
    def name(cls) -> str:
        return "pcm"

    def schema(self) -> str:
        return "key string, start long, samples array<float>"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return PcmReader(dict(self.options))
