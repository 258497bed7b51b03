"""The shared folder that the cluster names in ``spark.checkpoint.dir``."""

from __future__ import annotations

import hashlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The shared folder; in local mode, where none is set, a folder of its own."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        if not _own:
            _own.append("file://" + tempfile.mkdtemp(prefix="wadi-"))
        base = _own[0]
    return base.rstrip("/")


def fresh_folder(spark: SparkSession, kind: str) -> str:
    """A new folder name below the shared one."""
    return f"{shared_folder(spark)}/{kind}-{uuid.uuid4().hex}"


def folder_of(df: DataFrame, kind: str) -> str:
    """A folder name below the shared one that changes with the files that ``df`` reads: their paths, sizes and times."""
    spark, digest = df.sparkSession, hashlib.sha256()
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for name in sorted(df.inputFiles()):
        path = hadoop(name)
        status = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path)
        digest.update(f"{name} {status.getLen()} {status.getModificationTime()}\n".encode())
    return f"{shared_folder(spark)}/{kind}-{digest.hexdigest()[:32]}"
