"""Feature, forecast and fusion operators as windows, joins and aggregates."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortspark.functions import clinical as C
from cohortspark.operators import report

Tables = Mapping[str, DataFrame]


def series_5min(t: Tables) -> DataFrame:
    """Fused glucose with what the wearables say of the same five minutes and the sleep stage then."""
    w = t["wearable"].where("metric <> 'ibi_ms'").join(t["device"].where("not is_live"), "device_id")
    at = F.to_timestamp_ntz(F.date_format(F.col("time"), "yyyy-MM-dd HH:mm:00")) - F.make_dt_interval(F.lit(0), F.lit(0), F.minute("time") % 5)
    m = lambda name, f: f(F.when(F.col("metric") == name, F.col("value"))).cast("double")
    wear = w.groupBy("patient_id", at.alias("time")).agg(m("steps", F.sum).alias("steps"), m("heart_rate", F.avg).alias("heart_rate"), m("mets", F.sum).alias("met_minutes"), m("spo2", F.avg).alias("spo2"))
    s = t["sleep"].join(t["device"].where("not is_live").select("device_id", "patient_id"), "device_id")
    f = t["grid"].select("patient_id", "time", "mg_dl", "censored")
    staged = f.alias("f").join(s.alias("s"), F.expr("f.patient_id = s.patient_id and f.time >= s.start_time and f.time < s.end_time")).groupBy("f.patient_id", "f.time").agg(F.min_by("s.stage", "s.start_time").alias("stage"))
    return f.join(wear, ["patient_id", "time"], "left").join(staged, ["patient_id", "time"], "left")


def labels(t: Tables) -> DataFrame:
    """Glucose 30 and 60 minutes on, by time and not by row: null across a gap."""
    f = t["fused"].select("patient_id", "time", "mg_dl")
    out = f
    for minutes in (30, 60):
        later = f.select("patient_id", (F.col("time") - F.expr(f"interval {minutes} minutes")).alias("time"), F.col("mg_dl").alias(f"glucose_t{minutes}"))
        out = out.join(later, ["patient_id", "time"], "left")
    return out


def split_chrono(t: Tables, train: float = 0.60, validation: float = 0.15, horizon_min: int = 60) -> DataFrame:
    """Chronological segments of each patient's span, purged by the horizon at their ends."""
    w = Window.partitionBy("patient_id")
    sec = F.unix_micros(F.col("time").cast("timestamp")) / 1000000
    f = t["fused"].select("patient_id", "time").withColumn("s", sec).withColumn("a", F.min("s").over(w)).withColumn("b", F.max("s").over(w))
    one, two = F.col("a") + train * (F.col("b") - F.col("a")), F.col("a") + (train + validation) * (F.col("b") - F.col("a"))
    end = F.col("s") + 60 * horizon_min
    part = F.when(end <= one, "train").when((F.col("s") > one) & (end <= two), "validation").when(F.col("s") > two, "test")
    return f.select("patient_id", "time", part.alias("segment")).where("segment is not null")


def persistence(t: Tables, horizon: int = 30) -> DataFrame:
    """Pairs of now and later, the persistence forecast's material."""
    return labels(t).where(f"glucose_t{horizon} is not null").select("patient_id", "time", F.col("mg_dl").alias("predicted"), F.col(f"glucose_t{horizon}").alias("actual"))


def metrics(pairs: DataFrame, by: list[str]) -> DataFrame:
    """RMSE, MAE, MARD, bias and R2 of (predicted, actual) pairs."""
    e, y = F.col("predicted") - F.col("actual"), F.col("actual")
    g = pairs.groupBy(*by).agg(F.count("*").alias("n"), F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"), F.avg(F.abs(e) / y).alias("mard"), F.avg(e).alias("bias"), F.var_pop("actual").alias("v"))
    return g.select(*by, "n", C.rounded(F.sqrt("mse"), 3).alias("rmse"), C.rounded(F.col("mae"), 3).alias("mae"), C.rounded(100 * F.col("mard"), 2).alias("mard_pct"), C.rounded(F.col("bias"), 3).alias("bias"), C.rounded(1 - F.col("mse") / F.nullif(F.col("v"), F.lit(0.0)), 3).alias("r2"))


def clarke(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy(C.clarke_zone(F.col("actual"), F.col("predicted")).alias("zone")).agg(F.count("*").alias("n"))


def conformal(pairs: DataFrame, by: list[str], low: float = 0.1, high: float = 0.9) -> DataFrame:
    """Residual quantiles (exact, linear) and the share of pairs inside the band."""
    r = pairs.withColumn("r", F.col("actual") - F.col("predicted"))
    q = r.groupBy(*by).agg(F.round(F.percentile("r", low), 9).alias("q_low"), F.round(F.percentile("r", high), 9).alias("q_high"))  # what interpolation leaves over decides nothing
    j = r.join(q, by)
    return j.groupBy(*by).agg(F.count("*").alias("n"), C.rounded(F.first("q_low"), 3).alias("low"), C.rounded(F.first("q_high"), 3).alias("high"), C.rounded(100 * F.avg(((F.col("r") >= F.col("q_low")) & (F.col("r") <= F.col("q_high"))).cast("int")), 1).alias("coverage"))


def warnings(points: DataFrame) -> DataFrame:
    """Warnings of each forecast (device_id, time, id, now, horizon, glucose, low, high): kind, severity, first horizon.

    Forecasts are told apart by device, time and ``id``, which need not be unique across devices.
    """
    w = Window.partitionBy("device_id", "time", "id").orderBy("horizon")
    p = points.withColumn("pv", F.coalesce(F.lag("glucose").over(w), F.col("now"))).withColumn("pt", F.coalesce(F.lag("horizon").over(w), F.lit(0)))
    band = C.glucose_band(F.col("glucose"))
    inside = band == "in_range"
    spike = (F.col("glucose") - F.col("now") >= 50) | ((F.col("glucose") - F.col("pv")) / (F.col("horizon") - F.col("pt")) >= 2.0)
    one = lambda cond, kind, severity: F.when(cond, F.struct(kind.alias("kind"), F.lit(severity).alias("severity")))
    kinds = F.array(
        one(band.isin("very_high", "very_low"), band, 0), one(band.isin("high", "low"), band, 1),
        one(inside & (F.col("high") > 180), F.lit("possible_high"), 2), one(inside & (F.col("low") < 70), F.lit("possible_low"), 2), one(spike, F.lit("spike"), 1),
    )
    found = p.select("device_id", "time", "id", "horizon", F.explode(F.array_compact(kinds)).alias("k")).select("device_id", "time", "id", "horizon", "k.kind", "k.severity")
    return found.groupBy("device_id", "time", "id", "kind").agg(F.min("severity").alias("severity"), F.min("horizon").cast("int").alias("horizon")).select("id", "kind", "severity", "horizon")


def forecast_points(t: Tables) -> DataFrame:
    """Forecasts made of the glucose table: each reading's next four are its horizons."""
    w = Window.partitionBy("device_id").orderBy("time")
    g = t["glucose"].select("device_id", "time", (F.col("device_id") * 100000 + F.row_number().over(w)).alias("id"), F.col("mg_dl").alias("now"), *[F.lead("mg_dl", k).over(w).alias(f"h{k}") for k in (1, 2, 3, 4)])
    v = F.explode(F.array(*[F.struct(F.lit(15 * k).alias("horizon"), F.col(f"h{k}").alias("glucose")) for k in (1, 2, 3, 4)])).alias("p")
    return g.where("h4 is not null").select("device_id", "time", "id", "now", v).select("device_id", "time", "id", "now", "p.horizon", "p.glucose", (F.col("p.glucose") - 15).alias("low"), (F.col("p.glucose") + 15).alias("high"))


def rolling(t: Tables, rows: int = 12, least: int = 6) -> DataFrame:
    """Rolling mean of the last ``rows`` readings where at least ``least`` are there."""
    w = Window.partitionBy("device_id").orderBy("time").rowsBetween(-rows + 1, 0)
    return t["glucose"].select("device_id", "time", F.when(F.count("mg_dl").over(w) >= least, C.rounded(F.avg("mg_dl").over(w), 3)).alias("mean"))


def runs(t: Tables, step_min: int = 5) -> DataFrame:
    """Gaps and islands: stretches of readings at most one step apart."""
    w = Window.partitionBy("device_id").orderBy("time")
    g = t["glucose"].withColumn("new", (F.col("time") > F.lag("time").over(w) + F.expr(f"interval {step_min} minutes")).cast("int"))
    g = g.withColumn("run", F.sum(F.coalesce("new", F.lit(0))).over(w))
    return g.groupBy("device_id", "run").agg(F.min("time").alias("first_at"), F.max("time").alias("last_at"), F.count("*").alias("n"))


def trend(t: Tables) -> DataFrame:
    """Least-squares slope over the trailing 15 minutes, from three readings and ten minutes on."""
    sec = F.unix_micros(F.col("time").cast("timestamp")) / 1000000
    g = t["glucose"].withColumn("m", (sec / 60).cast("double")).withColumn("s", sec.cast("long"))
    w = Window.partitionBy("device_id").orderBy("s").rangeBetween(-900, 0)
    n, x, y = F.count("*").over(w), F.sum(F.col("m") - 28_500_000).over(w), F.sum("mg_dl").over(w)
    xy, xx = F.sum((F.col("m") - 28_500_000) * F.col("mg_dl")).over(w), F.sum((F.col("m") - 28_500_000) * (F.col("m") - 28_500_000)).over(w)
    span = F.col("m") - F.min("m").over(w)
    slope = (n * xy - x * y) / F.nullif(n * xx - x * x, F.lit(0.0))
    rate = F.when((n >= 3) & (span >= 10), slope)
    level = F.when(rate < -2, "falling_fast").when(rate < -1, "falling").when(rate < 1, "steady").when(rate < 2, "rising").when(rate.isNotNull(), "rising_fast")
    return g.select("device_id", "time", level.alias("trend"))


def asof(t: Tables, minutes: int = 120) -> DataFrame:
    """For each heart rate the nearest glucose reading within ``minutes``; ties go to the earlier one.

    Both sides fall into buckets of the tolerance; one side also into its neighbours', so it is an equi-join.
    """
    size = 60 * minutes
    sec = lambda c: (F.unix_micros(F.col(c).cast("timestamp")) / 1000000).cast("double")
    left = t["wearable"].where("metric = 'heart_rate'").select("device_id", F.col("time").alias("at"), F.col("value").cast("double").alias("hr")).withColumn("s", sec("at")).withColumn("b", F.explode(F.array(*[F.floor(F.col("s") / size) + k for k in (-1, 0, 1)])))
    right = t["native"].select("device_id", "time", "mg_dl").withColumn("g", sec("time")).withColumn("b", F.floor(F.col("g") / size))
    j = left.join(right, ["device_id", "b"]).where(F.abs(F.col("s") - F.col("g")) <= size)
    return j.groupBy("device_id", "at", "hr").agg(F.min_by("mg_dl", F.struct(F.abs(F.col("s") - F.col("g")), F.col("time"))).alias("mg_dl"))


def page(t: Tables, size: int = 50, number: int = 2) -> DataFrame:
    """One page of the visits, newest first."""
    return report.visit(t).select("encounter_id", "started_at").orderBy(F.desc("started_at"), "encounter_id").offset(size * number).limit(size)


def patient_day(t: Tables) -> DataFrame:
    """Feature days: CGM days and activity days together, the night before, running regimens."""
    cgm = report.cgm_daily(t).select("patient_id", "day", F.col("mean").alias("glucose_mean"), "coverage")
    act = report.activity_daily(t).select("patient_id", "day", "steps", "hr_mean")
    days = cgm.select("patient_id", "day").union(act.select("patient_id", "day")).distinct()
    night = report.sleep_nightly(t).select("patient_id", F.date_add("night", 1).alias("day"), "asleep_min", "efficiency")
    r = t["regimen"].select(F.col("patient_id"), "medication_id", F.to_date("started_at").alias("a"), F.to_date("ended_at").alias("b"))
    span = days.groupBy("patient_id").agg(F.min("day").alias("lo"), F.max("day").alias("hi"))
    near = r.join(span, "patient_id").where("a <= hi and (b is null or b >= lo)")
    active = days.join(near, "patient_id").where("a <= day and (b is null or b >= day)").groupBy("patient_id", "day").agg(F.count_distinct("medication_id").alias("n_active"))
    out = days.join(cgm, ["patient_id", "day"], "left").join(act, ["patient_id", "day"], "left").join(night, ["patient_id", "day"], "left").join(active, ["patient_id", "day"], "left")
    return out.withColumn("n_active", F.coalesce("n_active", F.lit(0))).withColumn("split", C.split_of(F.col("patient_id")))


def patient_static(t: Tables) -> DataFrame:
    """Patient features: each source is aggregated by patient before it is joined."""
    base = report.patient_baseline(t).select("patient_id", "bmi", "hba1c", "ldl", "egfr", "cohort")
    meds = t["regimen"].groupBy("patient_id").agg(F.count_distinct(F.when(F.col("ended_at").isNull(), F.col("medication_id"))).alias("n_active"), F.min("started_at").alias("first_start"))
    visits = t["encounter"].groupBy("patient_id").agg(F.count("*").alias("n_visits"), F.max("started_at").alias("last_visit"))
    days = report.cgm_daily(t).groupBy("patient_id").agg(F.count(F.when(F.col("coverage") >= 10, 1)).alias("cgm_days"))
    p = t["patient"].select("patient_id", "sex", C.split_of(F.col("patient_id")).alias("split"))
    for x in (base, meds, visits, days):
        p = p.join(x, "patient_id", "left")
    return p.withColumn("n_active", F.coalesce("n_active", F.lit(0))).withColumn("n_visits", F.coalesce("n_visits", F.lit(0)))


def deming(pairs: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Errors-in-variables line y = intercept + slope x with equal error variances, in closed form."""
    g = pairs.groupBy(*by).agg(F.count("*").alias("n"), F.var_pop(x).alias("vx"), F.var_pop(y).alias("vy"), F.covar_pop(x, y).alias("c"), F.avg(x).alias("mx"), F.avg(y).alias("my"))
    d = F.col("vy") - F.col("vx")
    g = g.withColumn("slope", (d + F.sqrt(d * d + 4 * F.col("c") * F.col("c"))) / F.nullif(2 * F.col("c"), F.lit(0.0)))
    return g.select(*by, "n", "slope", (F.col("my") - F.col("slope") * F.col("mx")).alias("intercept"))


def lag_of(reference: DataFrame, secondary: DataFrame, by: list[str], reach: int = 120) -> DataFrame:
    """The shift in minutes of ``secondary`` (by, minute, value) that correlates best with ``reference``.

    Every candidate shift is an equi-join on the moved minute; the smallest of the best ones is taken.
    """
    moved = secondary.select(*by, F.explode(F.sequence(F.lit(-reach), F.lit(reach))).alias("lag"), "minute", F.col("value").alias("b")).withColumn("minute", F.col("minute") + F.col("lag"))
    r = reference.select(*by, "minute", F.col("value").alias("a")).join(moved, [*by, "minute"]).groupBy(*by, "lag").agg(F.corr("a", "b").alias("r"))
    return r.where("r is not null and not isnan(r)").groupBy(*by).agg(F.min(F.struct((-F.col("r")).alias("m"), "lag")).alias("x")).select(*by, F.col("x.lag").alias("lag"))


def distinct_readings(events: DataFrame, stored: DataFrame) -> DataFrame:
    """New readings of a batch by (device, time, metric): the first of each key, and none that is stored."""
    w = Window.partitionBy("device_id", "metric", "time").orderBy("ordinal")
    return events.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn").join(stored, ["device_id", "metric", "time"], "left_anti")


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows of ``new`` over those of ``old`` with the same key."""
    return old.join(new.select(*key), key, "left_anti").unionByName(new)
