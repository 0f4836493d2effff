"""Cutting the lineage of a DataFrame in the folder that the cluster shares."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def use_checkpoint_dir(spark: SparkSession) -> None:
    """Takes the folder that ``spark.checkpoint.dir`` names.  Where it is unset a local session
    gets a folder of its own; a cluster has to name one that all executors share."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if named is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="checkpoints-")
    sc.setCheckpointDir(named)


def checkpoint(df: DataFrame) -> DataFrame:
    use_checkpoint_dir(df.sparkSession)
    return df.checkpoint()
