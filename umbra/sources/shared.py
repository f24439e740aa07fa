"""Cutting lineage in the folder that driver and executors share, and dealing rows to tasks."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; in one process and without that setting, a temporary folder that it is set to."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = f"file://{tempfile.mkdtemp(prefix='umbra-')}"
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """df from a checkpoint in the shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder(df.sparkSession))
    return df.checkpoint()


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """df in a few partitions for each core, whatever its files are cut into: for work that costs more than its bytes tell. By keys: in as many as a shuffle has, if these are more."""
    spark = df.sparkSession
    n = max(24, 3 * spark.sparkContext.defaultParallelism)
    return df.repartition(max(n, int(spark.conf.get("spark.sql.shuffle.partitions"))) if keys else n, *keys)
