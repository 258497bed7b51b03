"""Sources and sinks: JSON corpora, vectors, WAV and PCM audio, dictionaries, resumable writes."""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHUNK = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("chunk_id", "source_type", "book_name", "chapter_id", "hadith_id", "arabic_text", "english_text", "english_translation", "arabic_tafsir")]
    + [T.StructField(n, T.IntegerType()) for n in ("surah_id", "ayah_id")]
    + [T.StructField("grades", T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("grade", T.StringType())])))]
)


def read_corpus(spark: SparkSession, path: str, schema: T.StructType = CHUNK) -> DataFrame:
    """A JSON array or lines of chunk records, in a fixed schema."""
    return spark.read.schema(schema).json(path, multiLine=True)


def explode_editions(df: DataFrame) -> DataFrame:
    """surahs[].ayahs[] to (surah, position, text), positions from 1."""
    s = df.select(F.posexplode("surahs").alias("s", "surah"))
    return s.select((F.col("s") + 1).alias("surah"), F.posexplode("surah.ayahs").alias("p", "ayah")).select("surah", (F.col("p") + 1).alias("position"), F.col("ayah.text").alias("text"))


def read_vectors(spark: SparkSession, path: str, dim: int, ids: DataFrame) -> DataFrame:
    """(vec_id, embedding), checked: every vector has ``dim`` parts, every id one vector."""
    v = spark.read.parquet(path)
    if v.where(F.size("embedding") != dim).limit(1).count():
        raise ValueError(f"a vector does not have {dim} parts")
    if ids.join(v, "vec_id", "left_anti").limit(1).count():
        raise ValueError("an id has no vector")
    return v


def by_ids(df: DataFrame, ids: list, key: str) -> DataFrame:
    """Rows of the ids in their order; ids without a row are skipped."""
    spark = df.sparkSession
    order = spark.createDataFrame([(x, i) for i, x in enumerate(ids)], T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField("_at", T.IntegerType())]))
    return df.join(F.broadcast(order), key).orderBy("_at").drop("_at")  # a list in the call


def invert_vocabulary(levels: Column) -> Column:
    """Map of token to id, turned to id to token."""
    return F.map_from_entries(F.transform(F.map_entries(levels), lambda e: F.struct(e["value"], e["key"])))


def decode_wav(data: bytes) -> np.ndarray:
    """Samples in [-1, 1] of the first channel of a 16-bit PCM RIFF file; empty if it is none."""
    if len(data) < 12 or data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        return np.zeros(0, np.float32)
    at, channels, bits = 12, 1, 16
    while at + 8 <= len(data):
        name, size = data[at : at + 4], struct.unpack("<I", data[at + 4 : at + 8])[0]
        body = data[at + 8 : at + 8 + size]
        if name == b"fmt " and len(body) >= 16:
            channels, bits = struct.unpack("<H", body[2:4])[0], struct.unpack("<H", body[14:16])[0]
        elif name == b"data":
            if bits != 16:
                return np.zeros(0, np.float32)
            pcm = np.frombuffer(body[: len(body) // 2 * 2], "<i2")
            return pcm[:: max(channels, 1)].astype(np.float32) / 32768
        at += 8 + size + size % 2
    return np.zeros(0, np.float32)


def read_wavs(spark: SparkSession, path: str) -> DataFrame:
    """(path, samples) of WAV files, decoded in Arrow batches."""

    @F.pandas_udf("array<float>")
    def samples(content: pd.Series) -> pd.Series:
        return content.map(lambda b: decode_wav(b).tolist())

    return spark.read.format("binaryFile").load(path).select("path", samples("content").alias("samples"))


class PcmDecoder:
    """16-bit little-endian PCM chunks to samples; a byte split over a chunk edge is carried."""

    def __init__(self) -> None:
        self.carry = b""

    def feed(self, chunk: bytes) -> np.ndarray:
        data = self.carry + chunk
        whole = len(data) // 2 * 2
        self.carry = data[whole:]
        return np.frombuffer(data[:whole], "<i2").astype(np.float32) / 32768


def interleave(frames: list[DataFrame], order: str, n: int) -> DataFrame:
    """Rows of several frames in turn, n in all; shorter ones run out."""
    from pyspark.sql import Window

    parts = [f.withColumn("_source", F.lit(i)) for i, f in enumerate(frames)]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    turn = F.row_number().over(Window.partitionBy("_source").orderBy(order))
    return both.withColumn("_turn", turn).orderBy("_turn", "_source").limit(n).drop("_turn", "_source")


def write_resumable(df: DataFrame, path: str, key: str, transform) -> DataFrame:
    """Writes ``transform`` of the rows whose key is not there yet, as one more part; returns the whole table.

    A part counts once it is whole, so a run that broke off is done again and
    never half there. Null keys are never found to be done.
    """
    spark = df.sparkSession
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def parts() -> list[str]:
        return sorted(s.getPath().getParent().toString() for s in fs.globStatus(hadoop(f"{path}/part=*/_SUCCESS")) or [])

    done = parts()
    if done:
        df = df.join(spark.read.parquet(*done).select(key).distinct(), key, "left_anti")
    transform(df).write.parquet(f"{path}/part={uuid.uuid4().hex}")
    return spark.read.parquet(*parts())


def audio_url(base: str, surah: Column, ayah: Column) -> Column:
    """Zero-padded reference audio address."""
    return F.concat(F.lit(base.rstrip("/") + "/"), F.lpad(surah.cast("string"), 3, "0"), F.lpad(ayah.cast("string"), 3, "0"), F.lit(".mp3"))


def batches(it: Iterator, size: int) -> Iterator[list]:
    """Lists of at most ``size`` items."""
    held = []
    for x in it:
        held.append(x)
        if len(held) == size:
            yield held
            held = []
    if held:
        yield held
