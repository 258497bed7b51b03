"""Filters by sets of ids through a bitmap of bounded size, so that texts of other rows are not shuffled."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wadi.llm.storage import cut, fetch
from wadi.llm.textcore import mix

#: Bits for each id, and the least and most bits of a bitmap (16 MB; beyond 10^8 ids it lets more rows pass to the exact join).
BITS_PER_ID, LEAST_BITS, MOST_BITS = 16, 1 << 16, 1 << 27


def places(ids: np.ndarray, bits: int) -> np.ndarray:
    return mix(ids.astype(np.int64).view(np.uint64)) % np.uint64(bits)


def bitmap(ids: DataFrame, bits: int | None = None) -> bytes:
    """A bitmap of hashed ids (the only column, long, no nulls), sized by their number; the driver gets at most ``MOST_BITS`` / 32 rows."""
    if bits is None:
        bits = 1 << min(max((BITS_PER_ID * ids.count()).bit_length(), LEAST_BITS.bit_length() - 1), MOST_BITS.bit_length() - 1)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = places(batch.column(0).to_numpy(zero_copy_only=False), bits)
            yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(5)).astype(np.int64)), pa.array((np.uint64(1) << (at & np.uint64(31))).astype(np.int64))], names=["word", "bit"])

    words = fetch(ids.mapInArrow(mark, "word long, bit long").groupBy("word").agg(F.bit_or("bit").alias("bits")))
    out = np.zeros(bits // 32, "<u4")
    out[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64).astype("<u4")
    return out.tobytes()


def maybe_in(ids: np.ndarray, bytes_: np.ndarray) -> np.ndarray:
    """Which ids may be in the bitmap (as an array of bytes)."""
    at = places(ids, len(bytes_) * 8)
    return (bytes_[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, text) of the rows of ``docs`` whose id may be among ``ids`` (one column, long, no nulls)."""
    held = docs.sparkSession.sparkContext.broadcast(bitmap(ids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(held.value, np.uint8)
        for batch in batches:
            yield batch.filter(pa.array(maybe_in(batch.column(0).to_numpy(zero_copy_only=False), bits)))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.col("doc_id").isNotNull())
    return rows.mapInArrow(run, "doc_id long, text string")


def split_by_ids(rows: DataFrame, ids: DataFrame, id_col: str, bits: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows whose id is surely not among ``ids`` (one column, long, no nulls; rows without an id count here), and the others."""
    held = rows.sparkSession.sparkContext.broadcast(bitmap(ids, bits))

    @F.pandas_udf("boolean")
    def maybe(own: pd.Series) -> pd.Series:
        known = own.notna().to_numpy()
        return pd.Series(known & maybe_in(own.fillna(0).to_numpy(np.int64), np.frombuffer(held.value, np.uint8)))

    flagged = maybe(F.col(id_col).cast("long"))
    return rows.where(~flagged), rows.where(flagged)


def without_ids(docs: DataFrame, gone: DataFrame, id_col: str = "doc_id", bits: int | None = None) -> DataFrame:
    """``docs`` but for the rows whose id is in ``gone`` (one column, long); rows without an id stay.

    Only rows that the bitmap cannot clear are joined, exactly.
    """
    gone = cut(gone.toDF("_gone").where("_gone IS NOT NULL").distinct())
    clear, others = split_by_ids(docs, gone, id_col, bits)
    return clear.unionByName(others.join(gone, F.col(id_col) == F.col("_gone"), "left_anti"))
