"""Daily rollups that are kept: partial sums by cell, a log of what changed, and refreshes of those cells alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Accuracy of the sketch: a quantile's rank is off by less than about 1.33 % of the rows for k = 200 (99 % of the time).
SKETCH_K = 200
CELL = ["device_id", "day"]


def partials(readings: DataFrame) -> DataFrame:
    """(device_id, day, n, total, squares, low, high, sketch) of readings (device_id, time, value): all that a mean, a deviation,
    shares of bands and quantiles need, and all of it can be added up over days and devices.
    """
    r = readings.where("value is not null").select("device_id", F.to_date("time").alias("day"), F.col("value").cast("double").alias("v"))
    return r.groupBy(*CELL).agg(
        F.count("*").alias("n"), F.sum("v").alias("total"), F.sum(F.col("v") * F.col("v")).alias("squares"), F.count_if(F.col("v") < 70).alias("low"), F.count_if(F.col("v") > 180).alias("high"),
        F.expr(f"kll_sketch_agg_double(v, {SKETCH_K})").alias("sketch"),
    )


def summed(cells: DataFrame, by: list[str], quantiles: tuple[float, ...] = (0.1, 0.5, 0.9)) -> DataFrame:
    """Mean, deviation, shares below 70 and above 180 and approximate quantiles of stored cells, over any grouping of them.

    Quantiles come from merged sketches, so no reading is looked at again; the exact form is ``percentile``.
    """
    g = cells.groupBy(*by).agg(*[F.sum(c).alias(c) for c in ("n", "total", "squares", "low", "high")], F.expr("kll_merge_agg_double(sketch)").alias("sketch"))
    n = F.col("n")
    spread = F.when(n > 1, F.sqrt(F.greatest((F.col("squares") - F.col("total") * F.col("total") / n) / (n - 1), F.lit(0.0))))
    q: list[Column] = [F.expr(f"kll_sketch_get_quantile_double(sketch, {x}d)").alias(f"q{round(100 * x)}") for x in quantiles]
    return g.select(*by, "n", (F.col("total") / n).alias("mean"), spread.alias("sd"), (F.col("low") / n).alias("low"), (F.col("high") / n).alias("high"), *q)


class DailyRollup:
    """Stored cells, one folder a day. ``touched`` rows (device_id, day) say what to compute again.

    A refresh reads the readings of touched days only, adds the cells of these days that are untouched as they are, and
    replaces the days' folders by dynamic partition overwrite, so that running it twice changes nothing and a lost
    job leaves whole days. Cells whose readings are all gone go.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def cells(self) -> DataFrame:
        return self.spark.read.parquet(self.path).withColumn("day", F.to_date("day"))

    def build(self, readings: DataFrame) -> None:
        partials(readings).repartition("day").write.partitionBy("day").mode("overwrite").parquet(self.path)

    def refresh(self, readings: DataFrame, touched: DataFrame) -> int:
        """Computes the touched cells again; returns how many days were rewritten."""
        cells = touched.select("device_id", F.to_date("day").alias("day")).distinct()
        days = [r["day"] for r in cells.select("day").distinct().collect()]  # days of a log, not rows
        if not days:
            return 0
        fresh = readings.withColumn("day", F.to_date("time")).where(F.col("day").isin(days)).join(cells, CELL, "left_semi")
        kept = self.cells().where(F.col("day").isin(days)).join(cells, CELL, "left_anti")
        gone = F.lit(None).cast("long")
        none = self.spark.createDataFrame([(d,) for d in days], "day date").select(gone.alias("device_id"), "day")
        now = partials(fresh).unionByName(kept).unionByName(none, allowMissingColumns=True)  # a day left empty is still written
        now.repartition("day").write.partitionBy("day").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(self.path)
        return len(days)

    def read(self) -> DataFrame:
        return self.cells().where("device_id is not null")


def changed_cells(before: DataFrame, after: DataFrame) -> DataFrame:
    """(device_id, day) of the cells whose readings differ between two states of a table: inserts, late rows and deletes."""
    mark = lambda df: df.groupBy("device_id", F.to_date("time").alias("day")).agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(time, value))").alias("x"), F.sum(F.pmod(F.xxhash64("time", "value"), F.lit(1 << 40))).alias("y"))
    a, b = mark(before).withColumnsRenamed({"n": "n0", "x": "x0", "y": "y0"}), mark(after)
    return a.join(b, CELL, "full").where("not (n <=> n0 and x <=> x0 and y <=> y0)").select(*CELL)
