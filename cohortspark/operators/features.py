"""The views that join several sources: summaries, regimens, episodes, results, visits, replay, live state, feature tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortspark.functions import clinical as C
from cohortspark.operators import record, report

Tables = Mapping[str, DataFrame]
GROUPS = ("hypertension", "dyslipidemia", "ckd", "retinopathy", "neuropathy", "cardiovascular", "sleep_apnea", "copd")
# The drug classes behind each flag.
DRUGS = {"metformin": ("biguanide",), "sulfonylurea": ("sulfonylurea",), "dpp4i": ("dpp4_inhibitor",), "sglt2i": ("sglt2_inhibitor",), "glp1ra": ("glp1_ra",), "tzd": ("thiazolidinedione",), "statin": ("statin",), "acei_arb": ("ace_inhibitor", "arb")}
YEAR_S = 31_557_600


def patient_summary(t: Tables, as_of: str) -> DataFrame:
    """Name (of its parts, else source and subject), age, source and sorted tags of every patient."""
    tags = t["patient_tag"].groupBy("patient_id").agg(F.array_join(F.sort_array(F.collect_set("tag")), ",").alias("tags"))
    p = t["person"].join(t["patient"].select("patient_id", "sex", "birth_date"), "patient_id").join(F.broadcast(t["source"]), "source_id").join(tags, "patient_id", "left")
    name = F.coalesce(F.nullif(F.concat_ws(" ", "given_name", "family_name"), F.lit("")), F.concat(F.col("code"), F.lit(" "), F.col("source_subject_id")))
    return p.select("patient_id", name.alias("display_name"), "given_name", "family_name", "sex", "birth_date", C.age_at(F.col("birth_date"), F.lit(as_of).cast("date")).alias("age"), "race", F.col("code").alias("source"), "source_subject_id", F.coalesce("tags", F.lit("")).alias("tags"))


def medication_regimen(t: Tables) -> DataFrame:
    """Regimens with ingredient, product and class; the class may be missing."""
    m = t["medicine"].join(t["drug"], "ingredient_id")
    product = t["concept"].select(F.col("concept_id").alias("product_id"), F.col("display").alias("product"))
    j = m.join(product, "product_id", "left")
    return j.select("patient_id", "regimen_id", "ingredient_id", F.col("drug_name").alias("medication"), "product_id", "product", F.col("class_code").alias("drug_class"), F.coalesce("class_lowers", F.lit(False)).alias("glucose_lowering"), "started_at", "ended_at", F.col("ended_at").isNull().alias("active"), "dose", "per_day", "encounter_id", "is_synthetic")


def stripped(display: Column) -> Column:
    return F.regexp_replace(display, r"\s*\([^()]*\)$", "")


def condition_episode(t: Tables, grouped: bool = True) -> DataFrame:
    """Episodes by concept: a diagnosis if its concept is in a group, tagged a disorder or not tagged at all, else a finding."""
    g = t["condition_group"].withColumn("grp", F.col("grp") if grouped else F.lit(None).cast("string"))
    d = t["diagnosis"].drop("kind").join(F.broadcast(g), "concept_id", "left")
    diagnosis = F.col("grp").isNotNull() | F.col("display").rlike(r"\(disorder\)$") | ~F.col("display").rlike(r"\)$")
    return d.select("patient_id", "episode_id", "concept_id", stripped(F.col("display")).alias("display"), F.when(diagnosis, "diagnosis").otherwise("finding").alias("kind"), F.col("grp").alias("condition_group"), "onset_at", "abated_at", F.col("abated_at").isNull().alias("active"), "encounter_id", "is_synthetic")


def observation_result(t: Tables) -> DataFrame:
    """All results with their measure and coded text."""
    return t["result"].select("patient_id", "ordinal", "analyte", record.measure(F.col("analyte")).alias("measure"), F.col("effective_at"), "value", F.when(F.col("value").isNull(), F.col("value_text")).alias("value_text"), "encounter_id", "is_synthetic")


def visit(t: Tables) -> DataFrame:
    """Visits with type and reason: one vocabulary joined twice."""
    g = t["condition_group"].select("concept_id", stripped(F.col("display")).alias("name"))
    e = t["encounter"].withColumn("type_id", F.col("encounter_id") % 45).withColumn("reason_id", F.col("patient_id") % 50)
    j = e.join(F.broadcast(g.withColumnsRenamed({"concept_id": "type_id", "name": "type"})), "type_id", "left").join(F.broadcast(g.withColumnsRenamed({"concept_id": "reason_id", "name": "reason"})), "reason_id", "left")
    return j.select("patient_id", "encounter_id", "class", "type", "reason", "started_at", "ended_at", C.rounded((F.unix_micros(F.col("ended_at").cast("timestamp")) - F.unix_micros(F.col("started_at").cast("timestamp"))) / 3600000000, 4).alias("hours"))


def hrv_nightly(t: Tables, max_gap_s: float, min_beats: int) -> DataFrame:
    """Real nights by beat differences, and the generator's nightly means; a night may have both."""
    real = report.hrv_nightly(t, max_gap_s, min_beats).withColumn("is_synthetic", F.lit(False))
    w = t["wearable"].where("metric = 'hrv_rmssd'").join(t["device"].where("not is_live").select("device_id", "patient_id"), "device_id")
    made = w.groupBy("patient_id", C.night_of(F.col("time")).alias("night")).agg(C.rounded(F.avg("value"), 1).alias("rmssd_ms"))
    return real.unionByName(made.select("patient_id", "night", "rmssd_ms", F.lit(None).cast("long").alias("beats"), F.lit(True).alias("is_synthetic")))


def cgm_window(t: Tables) -> DataFrame:
    """The whole window with the names of the sensors behind it: one, or two joined by a plus."""
    d = t["device"].select("patient_id", F.concat(F.lit("Maker model "), (F.col("device_id") % 3).cast("string"), F.when(F.col("device_id") % 2 == 0, F.concat(F.lit(" + Maker model "), (F.col("device_id") % 4).cast("string"))).otherwise("")).alias("glucose_source"))
    return report.cgm_window(t).join(d, "patient_id")


def _json(fields: Mapping[str, Column], strip: bool = False) -> Column:
    return F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()]), {"ignoreNullFields": str(strip).lower()})


def replay_stream(t: Tables) -> DataFrame:
    """All recordings in one stream of five kinds with JSON payloads."""
    d = t["device"].where("not is_live").select("device_id", "patient_id", "is_synthetic")
    whole = lambda c: F.col(c).cast("long")
    row = lambda df, time, kind, payload: df.select("patient_id", F.col(time).alias("time"), F.lit(kind).alias("kind"), payload.alias("payload"))
    pairs = F.array_sort(F.collect_list(F.struct("metric", whole("value").alias("v"))))
    worn = t["wearable"].join(d, "device_id").groupBy("patient_id", "time").agg(pairs.alias("pairs"))
    text = F.concat(F.lit("{"), F.array_join(F.transform("pairs", lambda p: F.concat(F.lit('"'), p["metric"], F.lit('":'), p["v"].cast("string"))), ","), F.lit("}"))
    return (
        row(t["glucose"].join(d, "device_id"), "time", "glucose", _json({"glucose_mg_dl": whole("mg_dl")}))
        .unionByName(row(worn, "time", "activity", text))
        .unionByName(row(t["sleep"].join(d, "device_id"), "start_time", "sleep", _json({"stage": F.col("stage"), "until": F.date_format("end_time", "yyyy-MM-dd HH:mm:ss"), "synthetic": F.col("is_synthetic")})))
        .unionByName(row(t["fused"], "time", "glucose_fused", _json({"glucose_mg_dl": whole("mg_dl"), "censored": F.col("censored")})))
        .unionByName(row(t["dose"], "time", "medication", _json({"drug_class": F.col("class_code"), "dose": whole("dose_value"), "unit": F.col("dose_unit")}, True)))
    )


def live_latest(t: Tables, now: str) -> DataFrame:
    """The latest value of each patient and metric from four sources: live ones win, others count up to ``now``.

    Every branch keeps one row a patient and metric by an aggregate before they are united.
    """
    at = F.lit(now).cast("timestamp_ntz")
    d = t["device"].select("device_id", "patient_id", "is_live")
    none = F.lit(None).cast("string")
    num = lambda df, metric, time, value, live: df.select("patient_id", metric.alias("metric"), F.col(time).alias("time"), value.cast("double").alias("value"), none.alias("text"), live.alias("is_live"))
    glucose = num(t["glucose"].join(d.where("is_live"), "device_id"), F.lit("glucose"), "time", F.col("mg_dl"), F.lit(True))
    fused = num(t["fused"].where(F.col("time") <= at), F.lit("glucose"), "time", F.col("mg_dl"), F.lit(False))
    worn = t["wearable"].where("metric not in ('ibi_ms', 'wear_minutes')").join(d, "device_id").where(F.col("is_live") | (F.col("time") <= at))
    worn = num(worn, F.col("metric"), "time", F.col("value"), F.col("is_live"))
    slept = t["sleep"].join(d, "device_id").where(F.col("is_live") | (F.col("start_time") <= at))
    slept = slept.select("patient_id", F.lit("sleep").alias("metric"), F.col("start_time").alias("time"), F.lit(None).cast("double").alias("value"), F.col("stage").alias("text"), "is_live")
    every = glucose.unionByName(fused).unionByName(worn).unionByName(slept)
    last = F.max(F.struct("is_live", "time", "value", "text"))
    return every.groupBy("patient_id", "metric").agg(last.alias("x")).select("patient_id", "metric", "x.time", "x.value", "x.text", "x.is_live")


def patient_static(t: Tables, as_of: str, coverage: float, wear: int, hr: int, gap_s: float, beats: int) -> DataFrame:
    """Patient features, 59 columns: each source is aggregated by patient before it is joined, all joins have one key."""
    c = condition_episode(t)
    has = [F.bool_or(F.col("condition_group") == g).alias(f"has_{g}") for g in GROUPS]
    per = c.groupBy("patient_id", "condition_group").agg(F.min("onset_at").alias("onset_at"), F.bool_and("is_synthetic").alias("all_synthetic")).where("condition_group is not null")
    cond = per.groupBy("patient_id").agg(*has, F.min(F.when(F.col("condition_group") == "t2d", F.col("onset_at"))).alias("t2d_onset"), F.bool_or("all_synthetic").alias("conditions_synthetic"))
    m = medication_regimen(t).where("active")
    on = [F.bool_or(F.coalesce(F.col("drug_class").isin(*classes), F.lit(False))).alias(f"on_{n}") for n, classes in DRUGS.items()]
    meds = m.groupBy("patient_id").agg(*on, F.bool_or(F.coalesce(F.col("drug_class").startswith("insulin"), F.lit(False))).alias("on_insulin"), F.count_distinct(F.when(F.col("glucose_lowering"), F.col("drug_class"))).alias("n_glucose_lowering_classes"), F.bool_or("is_synthetic").alias("medications_synthetic"))
    act = report.activity_daily(t)
    valid = F.col("wear_minutes") >= wear
    act = act.groupBy("patient_id").agg(F.count(F.when(valid, 1)).alias("valid_step_days"), C.rounded(F.avg(F.when(valid, F.col("steps")))).alias("steps_per_valid_day"), F.count(F.when(F.col("hr_minutes") >= hr, 1)).alias("hr_days"))
    cgm = report.cgm_daily(t).where(F.col("coverage") >= coverage).groupBy("patient_id").agg(F.count("*").alias("cgm_days"))
    night = t["sleep"].join(t["device"].where("not is_live"), "device_id").groupBy("patient_id", C.night_of(F.col("start_time")).alias("night")).agg(F.bool_and("is_synthetic").alias("made"))
    night = night.groupBy("patient_id").agg(F.count("*").alias("sleep_nights"), F.bool_and("made").alias("sleep_synthetic"))
    hrv = hrv_nightly(t, gap_s, beats).groupBy("patient_id").agg(F.count(F.when(~F.col("is_synthetic"), 1)).alias("real_hrv_nights"))
    s = patient_summary(t, as_of).select("patient_id", "source", "sex", "age", "race", "tags")
    for x in (report.patient_baseline(t), cond, meds, act, cgm, night, hrv):
        s = s.join(x, "patient_id", "left")
    zero = lambda n: F.coalesce(n, F.lit(0)).alias(n)
    no = lambda n: F.coalesce(n, F.lit(False)).alias(n)
    years = (F.unix_micros(F.col("effective_at").cast("timestamp")) - F.unix_micros(F.col("t2d_onset").cast("timestamp"))) / 1000000 / YEAR_S
    made = F.coalesce("conditions_synthetic", F.lit(False)) | F.coalesce("medications_synthetic", F.lit(False)) | (F.col("synthetic_analytes") != "")
    return s.select(
        "patient_id", F.col("source"), C.split_of(F.col("patient_id")).alias("split"), "sex", "age", "race", (~F.array_contains(F.split("tags", ","), "gmi-warn")).alias("diabetes_diagnosed"), C.rounded(years, 1).alias("diabetes_duration_years"),
        *[c for c in report.patient_baseline(t).columns if c not in ("patient_id", "effective_at", "synthetic_analytes", "friedewald")], *[no(f"has_{g}") for g in GROUPS], *[no(f"on_{n}") for n in (*DRUGS, "insulin")], zero("n_glucose_lowering_classes"),
        zero("cgm_days"), zero("valid_step_days"), "steps_per_valid_day", zero("hr_days"), zero("sleep_nights"), "sleep_synthetic", zero("real_hrv_nights"), made.alias("has_synthetic_values"),
    )


def running(spans: DataFrame, days: DataFrame) -> DataFrame:
    """(patient_id, day, what) of spans (patient_id, what, started_at, ended_at) that run on a day of ``days``.

    A span is cut to the first and last day that its patient has and dealt to years, days are dealt to theirs: an equi-join
    on patient and year. A year in which the patient has no day is left out, by
    the patient's list of years.
    """
    ends = days.groupBy("patient_id").agg(F.min("day").alias("lo"), F.max("day").alias("hi"), F.collect_set(F.year("day")).alias("years"))
    s = spans.select("patient_id", "what", F.to_date("started_at").alias("a"), F.to_date("ended_at").alias("b")).join(ends, "patient_id")
    s = s.withColumn("a", F.greatest("a", "lo")).withColumn("b", F.least(F.coalesce("b", "hi"), "hi")).where("a <= b")
    s = s.select("patient_id", "what", "a", "b", F.explode(F.filter("years", lambda y: (y >= F.year("a")) & (y <= F.year("b")))).alias("year"))
    return days.withColumn("year", F.year("day")).join(s, ["patient_id", "year"]).where((F.col("a") <= F.col("day")) & (F.col("b") >= F.col("day"))).select("patient_id", "day", "what")


def patient_day(t: Tables, gap_s: float, beats: int) -> DataFrame:
    """Feature days, 39 columns: sensors of the day, the night before, running drug classes and insulin.

    Classes are counted with 0 as default; insulin is summed without one. Real heart-rate variability comes before the
    generator's.
    """
    cgm = report.cgm_daily(t).select("patient_id", "day", F.col("coverage").alias("cgm_coverage_pct"), F.col("mean").alias("glucose_mean"), F.col("cv").alias("glucose_cv_pct"), C.rounded(C.gmi(F.col("mean")), 2).alias("gmi"), "pct_very_low", "pct_low", "pct_target", "pct_high", "pct_very_high")
    act = report.activity_daily(t)
    days = cgm.select("patient_id", "day").union(act.select("patient_id", "day")).distinct()
    slept = t["sleep"].join(t["device"].where("not is_live"), "device_id").groupBy("patient_id", C.night_of(F.col("start_time")).alias("night")).agg(F.bool_and("is_synthetic").alias("sleep_made"))
    sleep = report.sleep_nightly(t).join(slept, ["patient_id", "night"]).select("patient_id", "night", "asleep_min", "deep_min", "rem_min", "efficiency", "sleep_made")
    spo2 = report.spo2_nightly(t).select("patient_id", "night", F.col("spo2_mean").alias("spo2_sleep_mean"), F.col("spo2_min").alias("spo2_sleep_min"), "t90_pct", "odi_per_hour")
    night = sleep.join(spo2, ["patient_id", "night"], "left").withColumn("day", F.date_add("night", 1)).drop("night")
    hrv = hrv_nightly(t, gap_s, beats).groupBy("patient_id", F.date_add("night", 1).alias("day")).agg(F.min(F.struct("is_synthetic", "rmssd_ms")).alias("h")).select("patient_id", "day", F.col("h.rmssd_ms").alias("hrv_rmssd_prev_night"), F.col("h.is_synthetic").alias("hrv_is_synthetic"))
    spans = medication_regimen(t).where("glucose_lowering").select("patient_id", F.col("drug_class").alias("what"), "started_at", "ended_at")
    classes = running(spans, days).groupBy("patient_id", "day").agg(F.count_distinct("what").alias("n_glucose_lowering_classes"))
    insulin = t["dose"].where(F.col("class_code").startswith("insulin") & F.col("dose_unit").isin("U", "[iU]")).groupBy("patient_id", F.to_date("time").alias("day")).agg(F.sum("dose_value").cast("double").alias("insulin_units"))
    out = days.withColumn("split", C.split_of(F.col("patient_id")))
    for x in (cgm, act, night, hrv, classes, insulin):
        out = out.join(x, ["patient_id", "day"], "left")
    channels = F.array_join(F.concat(F.when(F.coalesce("synthetic_metrics", F.lit("")) != "", F.split("synthetic_metrics", ",")).otherwise(F.array()), F.when(F.col("sleep_made"), F.array(F.lit("sleep"))).otherwise(F.array())), ",")
    return out.withColumn("n_glucose_lowering_classes", F.coalesce("n_glucose_lowering_classes", F.lit(0))).withColumn("synthetic_channels", channels).drop("synthetic_metrics", "sleep_made")


def _bucket(time: str) -> Column:
    """The five minutes of a naive time; several of them stand in one plan, which ``window`` does not allow."""
    return F.to_timestamp_ntz(F.date_format(time, "yyyy-MM-dd HH:mm:00")) - F.make_dt_interval(F.lit(0), F.lit(0), F.minute(time) % 5)


def _hour(time: str) -> Column:
    return F.to_timestamp_ntz(F.date_format(time, "yyyy-MM-dd HH:00:00"))


def series_5min(t: Tables, gap_s: float, beats: int) -> DataFrame:
    """Fused glucose with the channels, sleep stage and doses of the same five minutes, 20 columns.

    Sleep segments and points meet by patient and hour: a segment is dealt to each of its hours.
    """
    d = t["device"].where("not is_live").select("device_id", "patient_id", "is_synthetic")
    w = t["wearable"].where("metric not in ('wear_minutes', 'ibi_ms', 'hrv_rmssd')").join(d, "device_id")
    m = lambda name, f, out=None: f(F.when(F.col("metric") == name, F.col("value"))).cast("double").alias(out or name)
    wear = w.groupBy("patient_id", _bucket("time").alias("time")).agg(
        m("steps", F.sum), m("heart_rate", F.avg), m("mets", F.sum, "met_minutes"), *[m(n, F.avg) for n in ("activity_level", "spo2", "respiration_rate", "stress", "skin_temp", "eda")],
        F.sort_array(F.collect_set(F.when(F.col("is_synthetic"), F.col("metric")))).alias("made"),
    )
    order = Window.partitionBy("device_id").orderBy("time", "value")
    b = t["wearable"].where("metric = 'ibi_ms'").join(d, "device_id").withColumn("diff", F.col("value") - F.lag("value").over(order)).withColumn("gap", (F.unix_micros(F.col("time").cast("timestamp")) - F.unix_micros(F.lag("time").over(order).cast("timestamp"))) / 1000000)
    hrv = b.where((F.col("gap") < gap_s) & (F.abs("diff") < 200)).groupBy("patient_id", _bucket("time").alias("time")).agg(C.rounded(F.sqrt(F.avg(F.col("diff") * F.col("diff"))), 4).alias("rmssd_5min"), F.count("*").alias("n")).where(F.col("n") >= beats).drop("n")
    s = t["sleep"].join(d, "device_id").select("patient_id", "start_time", "end_time", "stage", "is_synthetic")
    hours = F.sequence(_hour("start_time"), _hour("end_time"), F.expr("interval 1 hour"))
    f = t["grid"].select("patient_id", "time", "mg_dl", "censored")
    j = f.withColumn("hour", _hour("time")).join(s.withColumn("hour", F.explode(hours)), ["patient_id", "hour"]).where((F.col("time") >= F.col("start_time")) & (F.col("time") < F.col("end_time")))
    sleep = j.groupBy("patient_id", "time").agg(F.min_by("stage", F.struct("start_time", "end_time", "stage")).alias("sleep_stage"), F.bool_or("is_synthetic").alias("sleep_made"))
    kind = lambda *names: F.sum(F.when(F.col("class_code").isin(*names), F.col("dose_value"))).cast("double")
    oral = F.count(F.when(F.col("class_lowers") & ~F.coalesce(F.col("class_code").startswith("insulin"), F.lit(False)), 1))
    dose = t["dose"].select("patient_id", (F.col("time") - F.expr("interval 68 days")).alias("time"), "class_code", "class_lowers", "dose_value").groupBy("patient_id", _bucket("time").alias("time")).agg(kind("insulin_rapid", "insulin_premixed").alias("insulin_fast_units"), kind("insulin_long", "insulin_intermediate").alias("insulin_basal_units"), oral.alias("oral_doses"))
    out = f
    for x in (wear, hrv, sleep, dose):
        out = out.join(x, ["patient_id", "time"], "left")
    made = F.concat(F.coalesce("made", F.array().cast("array<string>")), F.when(F.coalesce("sleep_made", F.lit(False)), F.array(F.lit("sleep"))).otherwise(F.array().cast("array<string>")))
    zero = lambda n, v: F.coalesce(n, F.lit(v)).alias(n)
    return out.select(*f.columns, "steps", "heart_rate", "met_minutes", "activity_level", "spo2", "respiration_rate", "stress", "skin_temp", "eda", "rmssd_5min", "sleep_stage", F.array_join(made, ",").alias("synthetic_channels"), zero("insulin_fast_units", 0.0), zero("insulin_basal_units", 0.0), zero("oral_doses", 0))
