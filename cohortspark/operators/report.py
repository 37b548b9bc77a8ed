"""Rollups and report views over the health tables; each takes the tables and returns a lazy DataFrame.

A partial aggregate before the shuffle comes with every ``groupBy``; small vocabularies join as Spark's own size
estimates decide. Times are naive local times.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortspark.functions import clinical as C

Tables = Mapping[str, DataFrame]


def _count(condition) -> F.Column:
    return F.count(F.when(condition, 1))


def glucose_daily(t: Tables) -> DataFrame:
    """Raw glucose by device and local day; bands have whole-number borders."""
    v = F.col("mg_dl")
    return t["glucose"].groupBy("device_id", F.to_date("time").alias("day")).agg(
        F.count("*").alias("n"),
        F.avg("mg_dl").alias("mean"),
        C.rounded(F.stddev_samp("mg_dl"), 3).alias("sd"),
        _count(v < 54).alias("n_very_low"),
        _count(v.between(54, 69)).alias("n_low"),
        _count(v.between(70, 180)).alias("n_target"),
        _count(v.between(181, 250)).alias("n_high"),
        _count(v > 250).alias("n_very_high"),
    )


def wearable_daily(t: Tables) -> DataFrame:
    return t["wearable"].groupBy("device_id", "metric", F.to_date("time").alias("day")).agg(
        F.count("*").alias("n"), F.sum("value").cast("double").alias("total"), F.avg("value").alias("mean"), F.min("value").cast("double").alias("low"), F.max("value").cast("double").alias("high")
    )


def glucose_fused_daily(t: Tables) -> DataFrame:
    """Fused glucose by patient and local day; bands are half-open."""
    v = F.col("mg_dl")
    return t["fused"].groupBy("patient_id", F.to_date("time").alias("day")).agg(
        F.count("*").alias("n"),
        F.avg("mg_dl").alias("mean_raw"),
        F.stddev_samp("mg_dl").alias("sd_raw"),
        _count(v < 54).alias("n_very_low"),
        _count((v >= 54) & (v < 70)).alias("n_low"),
        _count((v >= 70) & (v <= 180)).alias("n_target"),
        _count((v > 180) & (v <= 250)).alias("n_high"),
        _count(v > 250).alias("n_very_high"),
        _count(F.col("censored")).alias("n_censored"),
    )


def _shares(n: str = "n") -> list:
    return [C.rounded(100.0 * F.col(f"n_{b}") / F.col(n), 1).alias(f"pct_{b}") for b in ("very_low", "low", "target", "high", "very_high")]


def cgm_daily(t: Tables) -> DataFrame:
    """Fused day shares; a day has 288 points whatever the clock does, coverage ends at 100."""
    return glucose_fused_daily(t).select(
        "patient_id", "day", "n", C.rounded(F.col("mean_raw"), 1).alias("mean"),
        F.least(F.lit(100.0), C.rounded(100.0 * F.col("n") / 288, 1)).alias("coverage"),
        C.rounded(100 * F.col("sd_raw") / F.col("mean_raw"), 1).alias("cv"), *_shares(),
    )


def cgm_window(t: Tables) -> DataFrame:
    """Fused glucose over all of a patient's days."""
    v = F.col("mg_dl")
    g = t["fused"].groupBy("patient_id").agg(F.min("time").alias("first_at"), F.max("time").alias("last_at"), F.count("*").alias("n"), F.avg("mg_dl").alias("m"), F.stddev_samp("mg_dl").alias("s"), _count((v >= 70) & (v <= 180)).alias("hit"))
    return g.select("patient_id", "first_at", "last_at", "n", C.rounded(F.col("m"), 1).alias("mean"), C.rounded(C.gmi(F.col("m")), 2).alias("gmi"), C.rounded(100 * F.col("s") / F.col("m"), 1).alias("cv"), C.rounded(100.0 * F.col("hit") / F.col("n"), 1).alias("pct_target"))


def cgm_device_daily(t: Tables, interval_s: int = 300) -> DataFrame:
    """Device day with coverage from the device's nominal interval."""
    g = glucose_daily(t).join(t["device"].where("not is_live"), "device_id")
    return g.select(
        "device_id", "patient_id", "day", "n", C.rounded(F.col("mean"), 1).alias("mean"), C.rounded(C.gmi(F.col("mean")), 2).alias("gmi"),
        F.least(F.lit(100.0), C.rounded(100.0 * F.col("n") * interval_s / 86400, 1)).alias("coverage"), *_shares(), "is_synthetic",
    )


def cgm_device_window(t: Tables) -> DataFrame:
    g = t["glucose"].join(t["device"].where("not is_live"), "device_id").groupBy("device_id", "patient_id")
    return g.agg(F.count("*").alias("n"), F.count_distinct(F.to_date("time")).alias("days"), C.rounded(F.avg("mg_dl"), 1).alias("mean"), C.rounded(C.gmi(F.avg("mg_dl")), 2).alias("gmi"), F.min("mg_dl").alias("low"), F.max("mg_dl").alias("high"))


def observation_latest(t: Tables) -> DataFrame:
    """The observation of each patient and analyte: real before synthetic whatever the date, then the newest."""
    w = Window.partitionBy("patient_id", "analyte").orderBy("is_synthetic", F.desc("effective_at"), "l_orderkey", "l_linenumber", "value")
    return t["observation"].withColumn("rn", F.row_number().over(w)).where("rn = 1").select("patient_id", "analyte", "value", "effective_at", "is_synthetic")


ANALYTES = {"hba1c": "hba1c", "glucose_fasting": "fasting_glucose", "insulin": "insulin", "cholesterol_total": "total_cholesterol", "hdl": "hdl", "triglycerides": "triglycerides", "ldl": "ldl_measured", "creatinine": "creatinine", "weight": "weight_kg", "height": "height_cm"}


def patient_baseline(t: Tables) -> DataFrame:
    """One row a patient: the latest analytes side by side, and what follows from them.

    LDL is the real measured one, else Friedewald's of real inputs, else any measured one, else any of Friedewald; it
    counts as synthetic unless one of the first two is there. The kidneys' filtration is rounded half to even.
    """
    o = observation_latest(t)
    pivot = [F.max(F.when(F.col("analyte") == a, F.col("value"))).alias(c) for a, c in ANALYTES.items()]
    wide = o.groupBy("patient_id").agg(
        *pivot,
        F.max("effective_at").alias("effective_at"),
        F.max(F.when(F.col("analyte") == "creatinine", F.col("effective_at"))).alias("creatinine_at"),
        F.sort_array(F.collect_list(F.when(F.col("is_synthetic"), F.col("analyte")))).alias("made_up"),
    )
    p = wide.join(t["patient"].select("patient_id", "sex", "birth_date"), "patient_id")
    made = F.col("made_up")
    tc, hdl, tg, measured = F.col("total_cholesterol"), F.col("hdl"), F.col("triglycerides"), F.col("ldl_measured")
    overlap = lambda *a: F.arrays_overlap(made, F.array(*map(F.lit, a)))
    worked = C.rounded(C.friedewald(tc, hdl, tg))
    real = F.coalesce(F.when(~overlap("ldl"), measured), F.when(~overlap("cholesterol_total", "hdl", "triglycerides"), worked))
    years = C.age_at(F.col("birth_date"), F.to_date("creatinine_at"))
    return p.select(
        "patient_id", *ANALYTES.values(), "effective_at",
        C.rounded(F.col("weight_kg") / F.pow(F.col("height_cm") / 100, 2), 1).alias("bmi"), overlap("weight", "height").alias("bmi_is_synthetic"),
        (tc - hdl).alias("non_hdl"), C.rounded(tc / F.nullif(hdl, F.lit(0.0)), 2).alias("tc_hdl_ratio"), C.rounded(F.when(tg <= 400, tg / 5)).alias("vldl"),
        worked.alias("friedewald"), F.coalesce(real, measured, worked).alias("ldl"), real.isNull().alias("ldl_is_synthetic"),
        C.rounded(C.homa_ir(F.col("fasting_glucose"), F.col("insulin")), 2).alias("homa_ir"), overlap("glucose_fasting", "insulin").alias("homa_ir_is_synthetic"),
        F.rint(C.egfr(F.col("creatinine"), years, F.col("sex") == "female")).alias("egfr"), overlap("creatinine").alias("egfr_is_synthetic"),
        C.a1c_group(F.col("hba1c")).alias("cohort"), F.array_join(made, ",").alias("synthetic_analytes"),
    )


def patient_summary(t: Tables, as_of: str) -> DataFrame:
    return t["patient"].select("patient_id", F.coalesce("name", F.concat_ws(" ", F.col("source_id").cast("string"), F.col("patient_id").cast("string"))).alias("display_name"), "sex", C.age_at(F.col("birth_date"), F.lit(as_of).cast("date")).alias("age"), (F.col("source_id") == 0).alias("is_real"))


def drug_classes(t: Tables) -> DataFrame:
    """The least class whose prefix a concept's brand starts with: every start of a brand meets the prefixes by equality."""
    starts = F.transform(F.sequence(F.lit(1), F.length("brand")), lambda i: F.substring("brand", F.lit(1), i))
    c = t["concept"].where("brand <> ''").select("concept_id", F.explode(starts).alias("prefix"))
    return c.join(t["drug_class"], "prefix").groupBy("concept_id").agg(F.min("prefix").alias("drug_class"))


def medication_regimen(t: Tables) -> DataFrame:
    r = t["regimen"].join(t["concept"].select(F.col("concept_id").alias("medication_id"), "display"), "medication_id", "left")
    r = r.join(drug_classes(t).withColumnRenamed("concept_id", "medication_id"), "medication_id", "left")
    return r.select("patient_id", "l_orderkey", "l_linenumber", "medication_id", "display", "drug_class", "started_at", "ended_at", F.col("ended_at").isNull().alias("active"), "is_synthetic")


def condition_episode(t: Tables) -> DataFrame:
    """Episodes with their display's trailing tag taken off."""
    r = t["regimen"].join(t["concept"].withColumnRenamed("concept_id", "medication_id"), "medication_id", "left")
    return r.select("patient_id", "l_orderkey", "l_linenumber", F.regexp_replace("display", r"\s*\([^()]*\)$", "").alias("condition"), F.when(F.col("display").rlike("BRASS"), "finding").otherwise("diagnosis").alias("kind"), F.col("started_at").alias("onset_at"), F.col("ended_at").alias("abated_at"))


def patient_conditions(t: Tables) -> DataFrame:
    r = t["regimen"].join(t["concept"].withColumnRenamed("concept_id", "medication_id"), "medication_id")
    return r.groupBy("patient_id", "grp").agg(F.min("started_at").alias("first_onset"), F.bool_or(F.col("ended_at").isNull()).alias("active"), F.array_join(F.sort_array(F.collect_set("display")), "|").alias("displays"), F.bool_and("is_synthetic").alias("is_synthetic"))


def regimen_episodes(t: Tables) -> DataFrame:
    """Orders of one medication merged: from the first order to the last end, open if the last order is."""
    key = F.struct("started_at", "l_orderkey", "l_linenumber", "ended_at")
    g = t["regimen"].groupBy("patient_id", "medication_id").agg(F.min("started_at").alias("started_at"), F.max_by("ended_at", key).alias("ended_at"), F.count("*").alias("orders"))
    return g


def visit(t: Tables) -> DataFrame:
    e = t["encounter"]
    return e.select("encounter_id", "patient_id", "class", "started_at", "ended_at", ((F.unix_micros(F.col("ended_at").cast("timestamp")) - F.unix_micros(F.col("started_at").cast("timestamp"))) / 3600000000).alias("hours"))


def activity_daily(t: Tables) -> DataFrame:
    """Patient day with one column a metric; over several devices the larger value counts."""
    d = wearable_daily(t).join(t["device"].where("not is_live"), "device_id")
    m = lambda name, col, digits=1: C.rounded(F.max(F.when(F.col("metric") == name, F.col(col))), digits)
    return d.groupBy("patient_id", "day").agg(
        m("steps", "total", 0).alias("steps"), m("wear_minutes", "total", 0).alias("wear_minutes"), m("heart_rate", "mean").alias("hr_mean"), m("heart_rate", "low", 0).alias("hr_min"), m("heart_rate", "high", 0).alias("hr_max"),
        F.max(F.when(F.col("metric") == "heart_rate", F.col("n"))).alias("hr_minutes"), m("mets", "total").alias("met_minutes"), m("active_kcal", "total").alias("active_kcal"), m("activity_level", "mean", 2).alias("activity_level_mean"),
        m("spo2", "mean").alias("spo2_mean"), m("respiration_rate", "mean").alias("respiration_mean"), m("stress", "mean").alias("stress_mean"), m("skin_temp", "mean", 2).alias("skin_temp_mean"), m("eda", "mean", 3).alias("eda_mean"),
        F.array_join(F.sort_array(F.collect_set(F.when(F.col("is_synthetic"), F.col("metric")))), ",").alias("synthetic_metrics"),
    )


def _seconds(a: str, b: str):
    return (F.unix_micros(F.col(b).cast("timestamp")) - F.unix_micros(F.col(a).cast("timestamp"))) / 1000000


def sleep_nightly(t: Tables) -> DataFrame:
    s = t["sleep"].join(t["device"].where("not is_live"), "device_id").withColumn("night", C.night_of(F.col("start_time"))).withColumn("m", _seconds("start_time", "end_time") / 60)
    stage = lambda x: C.rounded(F.sum(F.when(F.col("stage") == x, F.col("m")))).alias(f"{x}_min")
    asleep = F.sum(F.when(F.col("stage") != "awake", F.col("m")))
    return s.groupBy("patient_id", "night").agg(F.min("start_time").alias("bed_at"), F.max("end_time").alias("wake_at"), C.rounded(asleep).alias("asleep_min"), stage("deep"), stage("light"), stage("rem"), stage("awake"), C.rounded(100 * asleep / F.nullif(F.sum("m"), F.lit(0.0)), 1).alias("efficiency"))


def spo2_nightly(t: Tables) -> DataFrame:
    """Saturation in sleep. A drop is three points below the greatest of the five samples before; drops in a row are one event.

    Samples and segments, half-open, meet by device and hour: a segment is dealt to each of its hours.
    """
    hour = lambda c: F.to_timestamp_ntz(F.date_format(c, "yyyy-MM-dd HH:00:00"))
    w = t["wearable"].where("metric = 'spo2'").select("device_id", "time", "value", hour("time").alias("hour"))
    s = t["sleep"].where("stage <> 'awake'").select("device_id", "start_time", "end_time", F.explode(F.sequence(hour("start_time"), hour("end_time"), F.expr("interval 1 hour"))).alias("hour"))
    j = w.join(s, ["device_id", "hour"]).where((F.col("time") >= F.col("start_time")) & (F.col("time") < F.col("end_time"))).select("device_id", "time", "value", C.night_of(F.col("start_time")).alias("night"))
    j = j.join(t["device"].where("not is_live"), "device_id")
    order = Window.partitionBy("patient_id", "night").orderBy("time", "value")
    j = j.withColumn("dropped", F.col("value") <= F.max("value").over(order.rowsBetween(-5, -1)) - 3)
    j = j.withColumn("begins", F.col("dropped") & ~F.coalesce(F.lag("dropped").over(order), F.lit(False)))
    n = F.count("*")
    return j.groupBy("patient_id", "night").agg(n.alias("samples"), C.rounded(F.avg("value"), 1).alias("spo2_mean"), F.min("value").cast("double").alias("spo2_min"), C.rounded(100 * F.avg((F.col("value") < 90).cast("int")), 1).alias("t90_pct"), C.rounded(_count(F.col("begins")) / (n / 60), 1).alias("odi_per_hour"), F.bool_or("is_synthetic").alias("is_synthetic"))


def hrv_nightly(t: Tables, max_gap_s: float = 2.5, min_beats: int = 300) -> DataFrame:
    """RMSSD of beat intervals before 05:00; the hour filter comes before the lag, which runs over the device."""
    b = t["wearable"].where("metric = 'ibi_ms'").where(F.hour("time") < 5).join(t["device"].where("not is_live"), "device_id")
    order = Window.partitionBy("device_id").orderBy("time", "value")
    b = b.withColumn("diff", F.col("value") - F.lag("value").over(order)).withColumn("before", F.lag("time").over(order))
    b = b.where((_seconds("before", "time") < max_gap_s) & (F.abs("diff") < 200))
    g = b.groupBy("patient_id", C.night_of(F.col("time")).alias("night")).agg(C.rounded(F.sqrt(F.avg(F.col("diff") * F.col("diff"))), 1).alias("rmssd_ms"), F.count("*").alias("beats"))
    return g.where(F.col("beats") >= min_beats)


def consistency(t: Tables) -> DataFrame:
    """How far the laboratory's HbA1c is from the sensors' GMI; a missing one is 'inconsistent', no window is no row."""
    gap = C.rounded(F.abs(F.col("hba1c") - F.col("gmi")), 2)
    j = cgm_window(t).select("patient_id", "gmi").join(patient_baseline(t).select("patient_id", "hba1c"), "patient_id", "left")
    return j.select("patient_id", "gmi", "hba1c", gap.alias("gap"), F.when(gap <= 0.5, "ok").when(gap <= 1.0, "warn").otherwise("inconsistent").alias("status"))


def sensor_window(t: Tables) -> DataFrame:
    real = t["device"].where("not is_live and not is_synthetic")
    both = t["glucose"].select("device_id", "time").unionByName(t["wearable"].select("device_id", "time"))
    return both.join(real, "device_id").groupBy("patient_id").agg(F.min("time").alias("first_at"), F.max("time").alias("last_at"), F.count("*").alias("n"))


def replay_stream(t: Tables) -> DataFrame:
    """All recorded readings in one stream of (patient, time, kind, payload)."""
    d = t["device"].where("not is_live").select("device_id", "patient_id")
    whole = lambda c: F.col(c).cast("long").cast("string")
    g = t["glucose"].join(d, "device_id").select("patient_id", "time", F.lit("glucose").alias("kind"), F.concat(F.lit("mg_dl="), whole("mg_dl")).alias("payload"))
    w = t["wearable"].join(d, "device_id").select("patient_id", "time", F.lit("activity").alias("kind"), F.concat(F.col("metric"), F.lit("="), whole("value")).alias("payload"))
    s = t["sleep"].join(d, "device_id").select("patient_id", F.col("start_time").alias("time"), F.lit("sleep").alias("kind"), F.concat(F.lit("stage="), F.col("stage")).alias("payload"))
    return g.unionByName(w).unionByName(s)


def latest_of_each(t: Tables, now: str) -> DataFrame:
    """The latest value of each patient and metric: live ones win, others count up to ``now``."""
    at = F.lit(now).cast("timestamp_ntz")
    live_cgm = t["glucose"].join(t["device"].where("is_live"), "device_id").select("patient_id", F.lit("glucose").alias("metric"), "time", F.col("mg_dl").cast("double").alias("value"), F.lit(True).alias("is_live"))
    fused = t["fused"].where(F.col("time") <= at).select("patient_id", F.lit("glucose").alias("metric"), "time", F.col("mg_dl").alias("value"), F.lit(False).alias("is_live"))
    worn = t["wearable"].where("metric <> 'ibi_ms'").join(t["device"], "device_id").where(F.col("is_live") | (F.col("time") <= at)).select("patient_id", "metric", "time", F.col("value").cast("double").alias("value"), "is_live")
    w = Window.partitionBy("patient_id", "metric").orderBy(F.desc("is_live"), F.desc("time"), F.desc("value"))
    return live_cgm.unionByName(fused).unionByName(worn).withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")
