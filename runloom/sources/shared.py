"""Cutting lineage in the shared checkpoint folder, dealing rows."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; only on one machine (a local master) may it be unset, and a
    temporary folder is taken."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not re.match(r"local(\[[^-]*)?$", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return folder or tempfile.mkdtemp(prefix="spark-")


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder, its lineage cut there."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt by ``keys`` over all of the session's shuffle partitions.

    Spark joins small partitions by their compressed size, and sorted keys are many times larger in a task's memory.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def small(rules: DataFrame, limit: int = 10_000) -> DataFrame:
    """``rules`` marked for broadcast if it has up to ``limit`` rows, which are counted.

    A join on the few keys of such a table would deal all rows of the other side to as many tasks.
    """
    return F.broadcast(rules) if rules.limit(limit + 1).count() <= limit else rules
