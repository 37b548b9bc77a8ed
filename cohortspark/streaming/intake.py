"""What comes in: events as JSON text to valid readings, rejected ones with a reason, and those that are new."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EVENT = "kind string, device_id long, time string, glucose_mg_dl double, metric string, value double, stage string, until string"
# Limits of a glucose event, stages, and the longest batch.
GLUCOSE = (20.0, 600.0)
STAGES = ("deep", "light", "rem", "awake")
BATCH = 5000


def _time(c: str) -> Column:
    """An instant; texts without an offset from UTC are none."""
    return F.when(F.col(c).rlike(r"(Z|[+-]\d\d:?\d\d)$"), F.try_to_timestamp(F.col(c)))


def validated(raw: DataFrame, text: str = "json") -> DataFrame:
    """(index, kind, device_id, time, metric, value, stage, until, reason) of (index, json); a null reason means valid."""
    e = raw.select("index", F.from_json(text, EVENT).alias("e")).select("index", "e.*")
    at, until = _time("time"), _time("until")
    reason = (
        F.when(~F.coalesce(F.col("kind").isin("glucose", "wearable", "sleep"), F.lit(False)), "unknown kind")
        .when(F.col("device_id").isNull(), "no device")
        .when(at.isNull(), "time without zone")
        .when((F.col("kind") == "glucose") & ~F.coalesce(F.col("glucose_mg_dl").between(*GLUCOSE), F.lit(False)), "glucose out of range")
        .when((F.col("kind") == "wearable") & (F.col("metric").isNull() | F.col("value").isNull()), "no metric or value")
        .when((F.col("kind") == "sleep") & ~F.coalesce(F.col("stage").isin(*STAGES), F.lit(False)), "unknown stage")
        .when((F.col("kind") == "sleep") & ~F.coalesce(until > at, F.lit(False)), "ends before it starts")
    )
    metric = F.when(F.col("kind") == "wearable", F.col("metric")).otherwise(F.col("kind"))
    value = F.when(F.col("kind") == "glucose", F.col("glucose_mg_dl")).otherwise(F.col("value"))
    return e.select("index", "kind", "device_id", at.alias("time"), metric.alias("metric"), value.alias("value"), "stage", until.alias("until"), reason.alias("reason"))


def checked(events: DataFrame, devices: DataFrame, metrics: DataFrame) -> DataFrame:
    """``events`` with a reason where the device is unknown, not live or of another kind, or the metric is unknown.

    Devices are (device_id, device_kind, is_live), metrics (metric); an earlier reason stays.
    """
    d = devices.select("device_id", "device_kind", "is_live")
    known = metrics.select("metric", F.lit(True).alias("known"))
    j = events.join(d, "device_id", "left").join(known, "metric", "left")
    needed = F.when(F.col("kind") == "glucose", "cgm").otherwise("wearable")
    why = (
        F.when(F.col("device_kind").isNull(), "unknown device").when(~F.col("is_live"), "not a live device").when(F.col("device_kind") != needed, "wrong kind of device")
        .when((F.col("kind") == "wearable") & F.col("known").isNull(), "unknown metric")
    )
    return j.withColumn("reason", F.coalesce("reason", why)).drop("device_kind", "is_live", "known")


def new_readings(events: DataFrame, stored: DataFrame) -> DataFrame:
    """Valid readings that are the first of their (device, metric, time) and not stored yet."""
    w = Window.partitionBy("device_id", "metric", "time").orderBy("index")
    first = events.where("reason is null").withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")
    return first.join(stored.select("device_id", "metric", "time"), ["device_id", "metric", "time"], "left_anti")


def counts(events: DataFrame, stored: DataFrame) -> DataFrame:
    """(total, accepted, duplicates, rejected), one row: what is neither rejected nor accepted is a duplicate."""
    total = events.agg(F.count("*").alias("total"), F.count("reason").alias("rejected"))
    accepted = new_readings(events, stored).agg(F.count("*").alias("accepted"))
    return total.crossJoin(accepted).select("total", "accepted", (F.col("total") - F.col("rejected") - F.col("accepted")).alias("duplicates"), "rejected")
