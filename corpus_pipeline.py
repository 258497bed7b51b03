"""The training-corpus pipeline: toxicity, near duplicates, decontamination, packing.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and
returns a DataFrame, which is written as Parquet and read again as the next
one's ``docs``. All but the last keep the columns of ``documents``.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wadi.llm.chosen_path import near_duplicates
from wadi.llm.decontaminate import leaks
from wadi.llm.ids import without_ids
from wadi.llm.packing import pack
from wadi.llm.storage import fresh_folder
from wadi.llm.toxicity import drop_toxic

#: Of near duplicates; a tree more than op2 has at 0.85, for as few lost links.
LIKENESS, TREES = Fraction(4, 5), 4


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not predict to be toxic."""
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the least id, of each group of near duplicates."""
    gone = near_duplicates(docs, likeness=LIKENESS, trees=TREES).where(~F.col("kept")).select("doc_id")
    return without_ids(docs, gone)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    gone = leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select("doc_id")
    return without_ids(docs, gone)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences."""
    return pack(docs)


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("decontamination", decontamination), ("packing", packing)]

#: The model, the tokenizer and the edit distance are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is kept in the shared folder."""
    folder = fresh_folder(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
