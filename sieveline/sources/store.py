"""Intermediate results in the folder that the cluster shares."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, or of the context; on one machine, as in tests, a temporary one is made.

    Raises RuntimeError on a cluster without one, where each executor would write to a disk of its own."""
    sc = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not shared:
        if not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = tempfile.mkdtemp(prefix="sieveline-")
        sc.setCheckpointDir(shared)
    return shared.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the checkpoint folder: later jobs repeat neither its work nor its plan."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()
