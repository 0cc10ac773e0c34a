"""Intermediate tables in the folder that the whole cluster shares.

``spark.checkpoint.dir`` names that folder. Tables written there outlive a lost executor and cut the lineage, and,
unlike a raw checkpoint, they are compressed and keep column pruning.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The shared folder; a local one is chosen only where the session names none and all work is done in one process."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            named = current.get()
        elif re.fullmatch(r"local(\[[^,\]]*(,[^\]]*)?\])?", spark.sparkContext.master):
            named = tempfile.mkdtemp(prefix="skein-")
            spark.sparkContext.setCheckpointDir(named)
        else:
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return named.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is written there is removed when the application ends."""
    path = f"{shared_dir(spark)}/skein-{name}-{uuid.uuid4().hex}"
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop_path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, removed when the application ends."""
    path = shared_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of a few MB, so that a batch of very long texts fits a Python worker.

    A plan reads these settings when it runs, so they stay until ``usual_batches`` gives back what was set before.
    """
    if not hasattr(spark, "_skein_batches"):
        spark._skein_batches = {key: spark.conf.get(key) for key in _BATCHES}
    for key, value in _BATCHES.items():
        spark.conf.set(key, value)


def usual_batches(spark: SparkSession) -> None:
    for key, value in spark.__dict__.pop("_skein_batches", {}).items():
        spark.conf.set(key, value)
