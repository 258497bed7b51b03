"""Tables between the steps of an operator, in the shared folder that the cluster names."""

from __future__ import annotations

import os
import tempfile
import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

_folders: dict[int, tuple[DataFrame, str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where that is unset, a folder of its own in local mode (tests), else an error."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        where = os.environ.setdefault("WADI_SHARED_DIR", "file://" + tempfile.mkdtemp(prefix="wadi-"))
    return where.rstrip("/")


def _path(spark: SparkSession, folder: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def fresh_folder(spark: SparkSession, kind: str) -> str:
    """A new folder name below the shared folder, for files of one run; it goes when the session ends."""
    folder = f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"
    fs, path = _path(spark, folder)
    fs.mkdirs(path)
    fs.deleteOnExit(path)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """``df``, computed once and kept as Parquet in the shared folder.

    Its plan is a plain scan, so joins of it are planned by the size of its
    files, and a lost executor loses none of it.
    """
    spark = df.sparkSession
    folder = f"{fresh_folder(spark, 'step')}/rows"
    df.write.parquet(folder)
    out = spark.read.schema(df.schema).parquet(folder)
    _folders[id(out)] = out, folder
    return out


def drop(*tables: DataFrame) -> None:
    """Removes the files of tables that ``cut`` made and no later plan reads."""
    for df in tables:
        held, folder = _folders.pop(id(df), (None, None))
        if held is not None:
            fs, path = _path(held.sparkSession, folder)
            fs.delete(path.getParent(), True)


def fetch(df: DataFrame) -> pd.DataFrame:
    """A frame of proven size bound on the driver, as Arrow columns and not as row objects."""
    return df.toArrow().to_pandas()
