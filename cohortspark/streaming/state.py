"""The state of every patient: bands, trend, steps of the day, sleep and staleness.

``snapshot`` and ``transitions`` compute it from all readings at once, as a fold in time order would; ``live.follow``
keeps it over a stream. Readings are (patient_id, time, metric, value, stage, until), naive local
times; a late reading never replaces a newer one but counts for the trend and the steps of its day.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortspark.functions import clinical as C

# Upper limits of bands (exclusive unless marked), the trend's window and guards, staleness.
BANDS: dict[str, list[tuple[float, str]]] = {
    "spo2": [(90, "low"), (95, "borderline"), (float("inf"), "normal")],
    "mets": [(1.5, "sedentary"), (3, "light"), (6, "moderate"), (float("inf"), "vigorous")],
}
LEVELS = ("sedentary", "light", "moderate", "vigorous")
PLAIN = ("respiration_rate", "hrv_rmssd", "skin_temp", "stress", "eda", "active_kcal")
WINDOW_MIN, LEAST_POINTS, LEAST_SPAN_MIN = 15, 3, 10
STALE_MIN = {"glucose": 15, "heart_rate": 10}
OFFLINE_S, EVICT_S = 60, 600
_US = 60_000_000


def status(metric: Column, value: Column) -> Column:
    """The band of a value; null for metrics without bands."""
    level = F.element_at(F.array(*map(F.lit, LEVELS)), F.least(F.greatest(value.cast("int"), F.lit(0)), F.lit(3)) + 1)
    out = F.when(metric == "glucose", C.glucose_band(value)).when(metric == "heart_rate", F.when(value < 50, "low").when(value <= 100, "normal").otherwise("elevated"))
    for name, limits in BANDS.items():
        band = None
        for top, label in limits[:-1]:
            band = F.when(value < top, label) if band is None else band.when(value < top, label)
        out = out.when(metric == name, band.otherwise(limits[-1][1]))
    return out.when(metric == "activity_level", level)


def signal(metric: Column) -> Column:
    """The channel that a metric feeds: METs and activity levels are one."""
    return F.when(metric.isin("mets", "activity_level"), "activity").otherwise(metric)


def _us(c: str) -> Column:
    return F.unix_micros(F.col(c).cast("timestamp"))


def latest(readings: DataFrame) -> DataFrame:
    """(patient_id, signal, time, value, status) of the newest reading of each channel; of equally new ones the greatest value."""
    r = readings.where(F.col("metric").isin("glucose", "heart_rate", "mets", "activity_level", "spo2", *PLAIN))
    last = F.max(F.struct("time", "value", status(F.col("metric"), F.col("value")).alias("status")))
    return r.groupBy("patient_id", signal(F.col("metric")).alias("signal")).agg(last.alias("x")).select("patient_id", "signal", "x.time", "x.value", "x.status")


def trend(readings: DataFrame) -> DataFrame:
    """(patient_id, slope, trend) over the distinct glucose readings of the last 15 minutes before the newest one.

    The slope is a fraction of whole numbers (seconds, thousandths), so no order of the rows can move it over a limit.
    """
    g = readings.where("metric = 'glucose'").select("patient_id", "time", "value").distinct()
    end = g.groupBy("patient_id").agg(F.max("time").alias("end"))
    near = g.join(end, "patient_id").withColumn("x", F.timestamp_diff("SECOND", F.col("end"), F.col("time"))).where(F.col("x") >= -60 * WINDOW_MIN)
    x, y = F.col("x"), F.round(F.col("value") * 1000).cast("long")
    fit = near.groupBy("patient_id").agg(F.count("*").alias("n"), F.min("x").alias("first"), F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(x * y).alias("sxy"), F.sum(x * x).alias("sxx"))
    enough = (F.col("n") >= LEAST_POINTS) & (-F.col("first") >= 60 * LEAST_SPAN_MIN)
    rise = F.when(enough, F.expr("n * sxy - sx * sy"))
    return fit.select("patient_id", rise.alias("rise"), F.expr("n * sxx - sx * sx").alias("run")).select("patient_id", C.slope_of("rise", "run").alias("slope"), C.trend_of("rise", "run").alias("trend"))


def steps_today(readings: DataFrame) -> DataFrame:
    """(patient_id, day, steps): all steps of the newest local day with any."""
    d = readings.where("metric = 'steps'").groupBy("patient_id", F.to_date("time").alias("day")).agg(F.sum("value").alias("steps"))
    return d.groupBy("patient_id").agg(F.max(F.struct("day", "steps")).alias("x")).select("patient_id", "x.day", "x.steps")


def asleep(readings: DataFrame) -> DataFrame:
    """(patient_id, stage): the newest stage, or awake if a reading came after its end."""
    last = readings.where("metric = 'sleep'").groupBy("patient_id").agg(F.max(F.struct("time", "stage", "until")).alias("x"))
    any_ = readings.groupBy("patient_id").agg(F.max("time").alias("seen"))
    return last.join(any_, "patient_id").select("patient_id", F.when(F.coalesce(F.col("seen") > F.col("x.until"), F.lit(False)), "awake").otherwise(F.col("x.stage")).alias("stage"))


def stale(channels: DataFrame, now: Column) -> DataFrame:
    """Channels with the status stale where nothing came for longer than their limit before ``now``."""
    limit = None
    for name, minutes in STALE_MIN.items():
        cond = F.col("signal") == name
        limit = F.when(cond, minutes) if limit is None else limit.when(cond, minutes)
    old = F.coalesce((F.unix_micros(now.cast("timestamp")) - _us("time")) > limit * _US, F.lit(False))
    return channels.withColumn("status", F.when(old, "stale").otherwise(F.col("status")))


def snapshot(readings: DataFrame, now: Column) -> DataFrame:
    """One row a patient: value and status of each channel, trend, steps, sleep; a stale glucose has no trend."""
    s = stale(latest(readings), now)
    names = ("glucose", "heart_rate", "activity", "spo2")
    pick = [F.max(F.when(F.col("signal") == n, F.col(c))).alias(f"{n}_{c}") for n in names for c in ("value", "status")]
    out = s.groupBy("patient_id").agg(*pick).join(trend(readings), "patient_id", "left").join(steps_today(readings), "patient_id", "left").join(asleep(readings), "patient_id", "left")
    fresh = ~F.col("glucose_status").eqNullSafe("stale")
    return out.withColumn("trend", F.when(fresh, F.col("trend"))).withColumn("slope", F.when(fresh, F.col("slope")))


def transitions(readings: DataFrame) -> DataFrame:
    """(patient_id, signal, time, from_status, to_status, value): changes of the status in time order, the first from null."""
    r = readings.where(F.col("metric").isin("glucose", "heart_rate", "mets", "activity_level", "spo2")).select("patient_id", signal(F.col("metric")).alias("signal"), "time", "value", status(F.col("metric"), F.col("value")).alias("to_status"))
    w = Window.partitionBy("patient_id", "signal").orderBy("time", "value")
    r = r.withColumn("from_status", F.lag("to_status").over(w)).where("to_status is not null and not (from_status <=> to_status)")
    return r.select("patient_id", "signal", "time", "from_status", "to_status", "value")


def delta(old: DataFrame, new: DataFrame, key: str = "patient_id") -> DataFrame:
    """(key, field, value): fields of ``new`` that differ from ``old``, as text; patients that are new have all their fields."""
    names = [c for c in new.columns if c != key]
    long = lambda df, out: df.select(key, F.inline(F.array(*[F.struct(F.lit(n).alias("field"), F.col(n).cast("string").alias(out)) for n in names])))
    j = long(new, "value").join(long(old, "before"), [key, "field"], "left")
    return j.where("not (value <=> before)").select(key, "field", "value")


def activity_of_stream(last_seen: DataFrame, wall: Column) -> DataFrame:
    """(patient_id, streaming, evict) from (patient_id, seen): a minute without batches ends streaming, ten minutes the state."""
    idle = (F.unix_micros(wall.cast("timestamp")) - _us("seen")) / 1_000_000
    return last_seen.select("patient_id", (idle <= OFFLINE_S).alias("streaming"), (idle > EVICT_S).alias("evict"))


def cutover(recorded: DataFrame, live: DataFrame) -> DataFrame:
    """A chart's series: recorded points strictly before the patient's first live one, then the live ones."""
    first = live.groupBy("patient_id").agg(F.min("time").alias("first"))
    old = recorded.join(first, "patient_id", "left").where("first is null or time < first").drop("first")
    return old.withColumn("is_live", F.lit(False)).unionByName(live.withColumn("is_live", F.lit(True)))


def rebuilt(readings: DataFrame) -> DataFrame:
    """The readings that a state is loaded from: the newest of each metric, all glucose of its last 15 minutes, all steps of its last day."""
    last = readings.groupBy("patient_id", "metric").agg(F.max("time").alias("end"))
    j = readings.join(last, ["patient_id", "metric"])
    glucose = (F.col("metric") == "glucose") & ((_us("end") - _us("time")) <= WINDOW_MIN * _US)
    steps = (F.col("metric") == "steps") & (F.to_date("time") == F.to_date("end"))
    return j.where((F.col("time") == F.col("end")) | glucose | steps).drop("end")
