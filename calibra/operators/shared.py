"""Tables between jobs, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; where none is named and all runs on one machine, a temporary folder."""
    sc = spark.sparkContext
    if named := sc.getConf().get("spark.checkpoint.dir", None):
        return named.rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="calibra-shared-"))
    return sc.getCheckpointDir().rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """The same rows, read back from the shared folder: a lost executor costs no recomputation."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
