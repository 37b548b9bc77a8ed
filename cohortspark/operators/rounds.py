"""Tables between the rounds of an iteration: lineage ends in the folder that all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; only a local session without one, as in tests, gets a temporary folder."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="cohortspark-"))
    return context.getCheckpointDir()


def settled(df: DataFrame) -> DataFrame:
    """``df`` stored in that folder."""
    folder(df.sparkSession)
    return df.checkpoint()


def dealt(df: DataFrame, column: str) -> DataFrame:
    """``df`` dealt by a column to all of the session's shuffle partitions, where its bytes do not tell what a task has to hold behind the shuffle."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), column)
