"""Intermediate tables in the folder that all executors share, and size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows below which an aggregated table may be broadcast; at most 200 bytes a row are expected.
BROADCAST_ROWS = 20_000
#: Shuffle files of a write are deleted when it ends, instead of when the driver collects garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_written: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Only a local session without one gets a temporary folder, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="cohortspark-"))
        named = spark.sparkContext.getCheckpointDir()
    return named


def written(df: DataFrame, name: str, owner: str = "") -> DataFrame:
    """``df`` as a Parquet table in the shared folder: lineage ends here and executors can be lost."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/cohortspark/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    _written.setdefault(owner, []).append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def forget(*tables: DataFrame) -> None:
    """Delete tables made by ``written`` that nothing will read any more."""
    for df in tables:
        _delete(df.sparkSession, df.scratch_path)


def clear(spark: SparkSession, owner: str) -> None:
    """Delete every table that ``written`` made for ``owner``; results that read them must be stored by then."""
    for path in _written.pop(owner, []):
        _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``rows`` rows, else as it is (Spark then shuffles)."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
