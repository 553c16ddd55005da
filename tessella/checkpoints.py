"""Cutting the lineage of a plan in the shared folder of a cluster."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession


def need_checkpoints(spark: SparkSession) -> None:
    """Point the session's checkpoints to the cluster's shared folder; only a local session may go without one."""
    if spark.sparkContext.getCheckpointDir() is None:
        path = spark.conf.get("spark.checkpoint.dir", None)
        if not path and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(path or "spark-warehouse/checkpoints")


def cut(df: DataFrame) -> DataFrame:
    """``df`` as a checkpoint."""
    need_checkpoints(df.sparkSession)
    return df.checkpoint()


def shared_folder(spark: SparkSession) -> str:
    """A folder of this application in the shared one, for what is written on the way."""
    need_checkpoints(spark)
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root.startswith("file:/"):
        root = root.removeprefix("file:").replace("///", "/", 1)
    root = root if "://" in root else "file://" + os.path.abspath(root)
    return f"{root}/tessella-library/{spark.sparkContext.applicationId}"


def kept(df: DataFrame) -> DataFrame:
    """``df`` as files in the shared folder.

    What is planned on them starts from their size.  A checkpoint hands on the
    estimate of its plan instead, which joins multiply: over the attempts of a loop
    it grows to numbers whose digits alone take the planner minutes.
    """
    path = f"{shared_folder(df.sparkSession)}/kept/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
