"""Document fingerprints by winnowing.

Every k-gram of code points gets a rolling hash; of each window of ``window``
consecutive k-gram hashes the minimum is chosen, the rightmost on ties, and its
position is kept. Any passage of ``window + k - 1`` code points that two texts
share puts at least one common hash into both fingerprints. A text shorter than
that has the minimum over what it has; shorter than k, the hash of the whole.

Defined results: a null text counts as empty, an empty text has an empty
fingerprint, two empty fingerprints have likeness 1, one empty fingerprint 0.
Equal texts have equal fingerprints. Repeated ids are neighbours in an order
that the id and the text give.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wadi.llm.textcore import _BASE, _power, chunks, mix

K, WINDOW = 16, 32
#: Parts that texts are dealt to at most (each is streamed, so a larger one needs no more memory).
MOST_PARTS = 20_000


def fingerprint(text: str, k: int = K, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Chosen 32-bit hashes and their code-point positions, in text order."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(points)
    if n == 0:
        return np.zeros(0, np.uint32), np.zeros(0, np.uint32)
    k = min(k, n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((points.astype(np.uint64) + np.uint64(1)) * _BASE * _power("up", n), out=sums[1:])
    grams = mix((sums[k:] - sums[:-k]) * _power("down", n - k + 1))
    m = len(grams)
    # hash in the high half, complement of the position in the low: the minimum is the rightmost least hash
    key = (grams & np.uint64(0xFFFFFFFF00000000)) | (np.uint64(0xFFFFFFFF) - np.arange(m, dtype=np.uint64))
    width = min(window, m)
    have = 1
    while have < width:
        step = min(have, width - have)
        key = np.minimum(key[:-step], key[step:])
        have += step
    if len(key) > 1:
        keep = np.empty(len(key), bool)
        keep[0] = True
        np.not_equal(key[1:], key[:-1], out=keep[1:])
        key = key[keep]
    return (key >> np.uint64(32)).astype(np.uint32), (np.uint64(0xFFFFFFFF) - (key & np.uint64(0xFFFFFFFF))).astype(np.uint32)


def encode(hashes: np.ndarray) -> str:
    """The hashes in text order as base64 of little-endian 32-bit numbers."""
    return base64.b64encode(hashes.astype("<u4").tobytes()).decode("ascii")


def decode(fp: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fp), "<u4")


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard likeness of two sets of distinct hashes."""
    if len(a) == 0 or len(b) == 0:
        return 1.0 if len(a) == len(b) else 0.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, window: int = WINDOW) -> DataFrame:
    """One row per document: id, hashes and positions (arrays of long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            found = [fingerprint(t or "", k, window) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([h.astype(np.int64) for h, _ in found], pa.list_(pa.int64())), pa.array([p.astype(np.int64) for _, p in found], pa.list_(pa.int64()))],
                names=["id", "hashes", "positions"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, hashes array<bigint>, positions array<bigint>").withColumnRenamed("id", id_col)


def edited(text: str, following: str) -> str:
    """``text`` with its last quarter replaced by as much of the start of ``following``."""
    quarter = len(text) // 4
    return text[: len(text) - quarter] + following[:quarter]


def in_order(docs: DataFrame, per_part: int = 4000) -> DataFrame:
    """(doc_id, text, part, ahead): documents by id in parts of about ``per_part`` rows.

    The first row of the next part (after the last part: of the first) comes
    along with ``ahead`` = 1 as the last row of its part, so that each task sees
    the successor of every document. Bounds come from the ids alone; the driver
    sees a few numbers for each part, the texts are shuffled once.
    """
    spark = docs.sparkSession
    n = docs.count()
    parts = min(max(1, -(-n // per_part)), MOST_PARTS)
    ids = docs.select("doc_id")
    cuts = ids.select(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)], 100 * parts).alias("c")).first()["c"] if parts > 1 else []
    cuts = sorted(set(cuts or []))
    bounds = np.array(cuts, np.int64)

    @F.pandas_udf("int")
    def part_of(ids: pd.Series) -> pd.Series:
        return pd.Series(np.where(ids.isna(), 0, np.searchsorted(bounds, ids.fillna(0).to_numpy(np.int64), "left"))).astype("int32")

    part = part_of(F.col("doc_id")) if cuts else F.lit(0)
    rows = docs.select("doc_id", "text").withColumn("part", part)
    heads = [(r["part"], r["first"], r["nulls"]) for r in rows.groupBy("part").agg(F.min("doc_id").alias("first"), F.count(F.when(F.col("doc_id").isNull(), 1)).alias("nulls")).orderBy("part").collect()]
    if not heads:
        return rows.withColumn("ahead", F.lit(0))
    moves = [(heads[i][0], heads[(i + 1) % len(heads)][1], heads[(i + 1) % len(heads)][2] > 0) for i in range(len(heads))]
    plan = spark.createDataFrame([(p, f if not has_null else None) for p, f, has_null in moves], "to_part int, head long")
    key = F.col("doc_id").eqNullSafe(F.col("head"))
    ahead = rows.drop("part").join(F.broadcast(plan), key).groupBy("to_part", "doc_id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    ahead = ahead.select("doc_id", "text", F.col("to_part").alias("part"), F.lit(1).alias("ahead"))
    both = rows.withColumn("ahead", F.lit(0)).unionByName(ahead)
    # a part for each task: hashed parts would meet in tasks
    return both.repartitionById(heads[-1][0] + 1, "part").sortWithinPartitions("part", "ahead", F.col("doc_id").asc_nulls_first(), F.coalesce("text", F.lit("")))


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_hashes long"


def neighbours_report(docs: DataFrame, k: int = K, window: int = WINDOW) -> DataFrame:
    """Fingerprints of every text and of its edited text, with their likeness."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(doc_id, text, fp, after, after_fp):
            changed = edited(text, after)
            other, _ = fingerprint(changed, k, window)
            a, b, c = np.unique(fp), np.unique(other), np.unique(after_fp)
            return doc_id, len(text), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), encode(fp), encode(other), likeness(a, b), likeness(a, c), len(fp)

        held, out, size = None, [], 0
        for some in chunks(batches, "text"):
            for doc_id, text, part, ahead in zip(*(some.column(i).to_pylist() for i in range(4)), strict=True):
                text = text or ""
                fp, _ = fingerprint(text, k, window)
                if held is not None and held[0] == part:
                    out.append(row(held[1], held[2], held[3], text, fp))
                    size += len(text)
                held = None if ahead else (part, doc_id, text, fp)
                if size > 4_000_000:
                    yield packed(out)
                    out, size = [], 0
        if out:
            yield packed(out)

    names = [c.split()[0] for c in RESULT.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64()]

    def packed(out):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return in_order(docs).select("doc_id", "text", "part", "ahead").mapInArrow(run, RESULT)


def op4_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours_report(spark.read.parquet(f"{sf_dir}/documents.parquet"))
