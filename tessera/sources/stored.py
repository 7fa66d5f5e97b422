"""Intermediate tables in the folder that all executors share, and caches that outlive a run."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder below ``spark.checkpoint.dir`` (our own folder only where that is unset and all runs on this machine)."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/tessera/{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet in a shared folder and read back: lineage ends, lost executors cost nothing."""
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def complete(spark: SparkSession, path: str) -> bool:
    """Whether a writer has finished ``path``: a folder that a crash left behind has no ``_SUCCESS``."""
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/_SUCCESS")
    return bool(mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark))


def cached(spark: SparkSession, path: str, build: Callable[[], DataFrame], *by: str, refresh: bool = False) -> DataFrame:
    """The table at ``path``; built and written there, partitioned ``by``, if it is not there as a whole or to be refreshed."""
    if refresh or not complete(spark, path):
        build().write.mode("overwrite").option("compression", "zstd").partitionBy(*by).parquet(path)
    return spark.read.parquet(path)
