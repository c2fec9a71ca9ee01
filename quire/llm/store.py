"""Shared storage for intermediate tables and output files.

Executors and driver share only the folder named by ``spark.checkpoint.dir``;
everything written between jobs goes there, through Spark's own writers.
"""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; where it is unset and the master local (tests), a temporary folder.

    On a cluster without the setting this raises: no other folder is known to be shared.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise RuntimeError(f"spark.checkpoint.dir must name a folder that driver and executors share (master {master})")
        folder = f"file://{tempfile.mkdtemp(prefix='quire-')}"
        atexit.register(shutil.rmtree, folder.removeprefix("file://"), ignore_errors=True)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """The same rows with their lineage cut by a reliable checkpoint."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again; the write frees its shuffles when it ends."""
    spark = df.sparkSession
    path = new_path(spark, name)
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(key, before)
    return spark.read.schema(df.schema).parquet(path)


def prepare(spark: SparkSession) -> None:
    """Bounds the memory of Arrow batches of long texts, unless the session sets a bound of its own."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    stated = spark.conf.get(key).rstrip("bB")
    if not stated.isdigit() or int(stated) > 16 << 20:
        spark.conf.set(key, str(16 << 20))
