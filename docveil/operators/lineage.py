"""Cutting lineage where one result is read several times."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``). Where the setting is absent, a folder of this machine is
    made if the whole session runs on it; on a cluster, whose executors could not read it, that is an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("Set spark.checkpoint.dir to a folder that all executors share.")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="docveil-"))
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read from there; the files survive the loss of executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
