"""Session helpers."""

from __future__ import annotations

import os
import re
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def ship(spark: SparkSession) -> SparkSession:
    """Lets Python workers on this machine import the package from where the driver did; elsewhere it comes by --py-files."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])
    return spark


#: A table of fewer stored bytes for each core than this is dealt out over all cores before costly work on its rows.
SPREAD = 16 << 20


def spread(df: DataFrame, least: int = SPREAD) -> DataFrame:
    """The rows of a small table over all cores, whatever the row groups of its files are; a large one is read as it is stored.

    A file is read by as many tasks as it has row groups, so a scan of a small file keeps one core busy. What is moved is
    bounded by ``least`` bytes a core, by the planner's estimate; a larger table has enough row groups and isn't shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(4 * cores) if size < least * cores else df


def saved(df: DataFrame) -> DataFrame:
    """The rows, computed once and read from the folder that all executors share (``spark.checkpoint.dir``).

    Where that setting is unset, a temporary folder is used on a local master; on a cluster it must be set.
    """
    spark = df.sparkSession
    at = spark.conf.get("spark.checkpoint.dir", None)
    if spark.sparkContext.getCheckpointDir() is None:
        if not at:
            if not re.match(r"local(\[|$)", spark.sparkContext.master):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            at = tempfile.mkdtemp(prefix="veilspark-")
        spark.sparkContext.setCheckpointDir(at)
    return df.checkpoint(eager=True)
