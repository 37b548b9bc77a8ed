"""Readings of a stream into a stored table: each once, whatever is replayed, with the counts of every batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEY = ["device_id", "metric", "time"]


class NewReadings:
    """A ``foreachBatch`` sink: adds the readings whose (device, metric, time) the table does not hold.

    A batch writes into the folder ``batch=<id>`` of ``path`` by dynamic partition overwrite and compares itself with
    all other folders, so a batch that runs again, after a lost driver or executor, leaves the same rows. Of equal keys
    in a batch the least ``ordinal`` is taken. ``counts`` are rows of their own: total, accepted, duplicates, rejected.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.path, self.counts_path = f"{path}/readings", f"{path}/counts"
        none = spark.createDataFrame([], schema).withColumn("batch", F.lit(0).cast("long"))
        none.write.partitionBy("batch").mode("append").parquet(self.path)
        self.schema = none.schema

    def stored(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(self.schema).parquet(self.path)

    def __call__(self, rows: DataFrame, batch_id: int) -> None:
        """Writes the new readings of one batch and its counts; ``reason`` names why a row was rejected before."""
        spark = rows.sparkSession
        fine = rows.where("reason is null").drop("reason")
        columns = [c for c in fine.columns if c not in (*KEY, "ordinal")]
        one = fine.groupBy(*KEY).agg(F.min(F.struct("ordinal", *columns)).alias("x")).select(*KEY, "x.*")
        others = self.stored(spark).where(F.col("batch") != batch_id).select(*KEY)
        new = one.join(others, KEY, "left_anti").withColumn("batch", F.lit(batch_id).cast("long"))
        self._replace(new.select(*[f.name for f in self.schema.fields]), self.path)
        accepted = self.stored(spark).where(F.col("batch") == batch_id).count()
        c = rows.agg(F.count("*").alias("total"), F.count("reason").alias("rejected"))
        c = c.select("total", F.lit(accepted).cast("long").alias("accepted"), (F.col("total") - F.col("rejected") - accepted).alias("duplicates"), "rejected", F.lit(batch_id).cast("long").alias("batch"))
        self._replace(c, self.counts_path)

    @staticmethod
    def _replace(df: DataFrame, path: str) -> None:
        df.write.partitionBy("batch").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
