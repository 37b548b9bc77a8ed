"""Batch jobs around the views: summaries to long observations, tags, laboratory overrides, lists, and sinks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortspark.functions import clinical as C
from cohortspark.operators import report

Tables = Mapping[str, DataFrame]
# Codes of the summaries, the tags that follow from consistency, and categories of race and ethnicity.
GMI, MEAN, CV, HEART_RATE, STEPS, SLEEP, SPO2 = "97506-0", "97507-8", "104638-2", "8867-4", "55423-8", "93832-4", "59408-5"
GMI_TAGS = {"warn": "gmi-warn", "inconsistent": "gmi-inconsistent"}
RACES = {"Black or African American": ("2054-5", False), "White": ("2106-3", False), "Hispanic/Latino": (None, True)}


def _long(rows: DataFrame, key: Sequence[str], pairs: Mapping[str, str]) -> DataFrame:
    """(key, code, value): one row for each column of ``pairs`` that has a value."""
    each = F.array(*[F.struct(F.lit(code).alias("code"), F.col(c).cast("double").alias("value")) for c, code in pairs.items()])
    return rows.select(*key, F.inline(each)).where("value is not null")


def cgm_summaries(t: Tables, least_coverage: float) -> DataFrame:
    """(patient_id, day, code, value): mean and variation of days with enough coverage; the indicator once, without a day."""
    days = _long(report.cgm_daily(t).where(F.col("coverage") >= least_coverage), ["patient_id", "day"], {"mean": MEAN, "cv": CV})
    once = _long(report.cgm_window(t), ["patient_id"], {"gmi": GMI}).select("patient_id", F.lit(None).cast("date").alias("day"), "code", "value")
    return days.unionByName(once)


def activity_summaries(t: Tables, least_minutes: int) -> DataFrame:
    """Daily mean heart rate of days with enough minutes, and steps where there are any."""
    a = report.activity_daily(t)
    rate = F.when(F.coalesce(F.col("hr_minutes"), F.lit(0)) >= least_minutes, C.rounded(F.col("hr_mean")))
    return _long(a.withColumn("rate", rate), ["patient_id", "day"], {"rate": HEART_RATE, "steps": STEPS})


def night_summaries(t: Tables) -> DataFrame:
    """Sleep of every night, and saturation of those that have it."""
    n = report.sleep_nightly(t).join(report.spo2_nightly(t).select("patient_id", "night", "spo2_mean"), ["patient_id", "night"], "left")
    return _long(n, ["patient_id", "night"], {"asleep_min": SLEEP, "spo2_mean": SPO2})


def retagged(tags: DataFrame, consistency: DataFrame) -> DataFrame:
    """Tags with those of consistency dropped and made anew from its status."""
    name = F.element_at(F.create_map(*[F.lit(x) for kv in GMI_TAGS.items() for x in kv]), F.col("status"))
    fresh = consistency.where(F.col("status").isin(*GMI_TAGS)).select("patient_id", name.alias("tag"))
    return tags.where(~F.col("tag").isin(*GMI_TAGS.values())).select("patient_id", "tag").unionByName(fresh)


def real_labs(t: Tables) -> DataFrame:
    """The latest real value of each patient and analyte."""
    w = Window.partitionBy("patient_id", "analyte").orderBy(F.desc("effective_at"), "l_orderkey", "l_linenumber", "value")
    return t["observation"].where("not is_synthetic and value is not null").withColumn("rn", F.row_number().over(w)).where("rn = 1").select("patient_id", "analyte", "value", "effective_at")


def derived_labs(t: Tables) -> DataFrame:
    """Derived values of the baseline that rest on real inputs only."""
    b = report.patient_baseline(t)
    b = b.withColumn("bmi", F.when(~F.coalesce("bmi_is_synthetic", F.lit(False)), F.col("bmi"))).withColumn("ldl", F.when(~F.col("ldl_is_synthetic"), F.col("ldl")))
    return _long(b, ["patient_id"], {"bmi": "39156-5", "ldl": "13457-7"})


def race_codes(rows: DataFrame) -> DataFrame:
    """(key, race_code, ethnicity_code) of the texts that are known; others give no row."""
    race, hispanic = None, None
    for text, (code, latino) in RACES.items():
        cond = F.col("race") == text
        race = F.when(cond, F.lit(code)) if race is None else race.when(cond, F.lit(code))
        hispanic = F.when(cond, F.lit(latino)) if hispanic is None else hispanic.when(cond, F.lit(latino))
    return rows.where(F.col("race").isin(*RACES)).select("patient_id", race.alias("race_code"), F.when(hispanic, "2135-2").otherwise("2186-5").alias("ethnicity_code"))


def expanded(regimens: DataFrame, products: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(one row an ingredient of each regimen's product, numbers of products that no ingredient is known for)."""
    rows = regimens.join(products, "product_id")
    lost = regimens.join(products.select("product_id").distinct(), "product_id", "left_anti").groupBy("product_id").agg(F.count("*").alias("regimens"))
    return rows, lost


def day_offset(last_end: Column, first_day: Column) -> Column:
    """Days that move a study's first day onto the day after the last visit."""
    return F.datediff(F.date_add(F.to_date(last_end), 1), first_day)


def exam_rows(observations: DataFrame) -> DataFrame:
    """Survey values that can be values: zero never is one."""
    return observations.where("value > 0")


def wear_days(minutes: DataFrame, least: int) -> DataFrame:
    """(SEQN, PAXDAYM, wear_minutes, steps, valid) of days with any worn minute (SEQN, PAXDAYM, minute, steps)."""
    g = minutes.groupBy("SEQN", "PAXDAYM").agg(F.count("*").alias("wear_minutes"), F.sum(F.when(F.col("steps") > 0, F.col("steps"))).alias("steps"))
    return g.withColumn("valid", F.col("wear_minutes") >= least)


def regimen_starts(rx: DataFrame, known: DataFrame, exam: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(regimens from the exam back by the days taken, counts of unknown names)."""
    k = rx.join(known, "name").join(exam, "SEQN")
    regimens = k.select("SEQN", "name", F.date_sub("exam_date", F.coalesce("days", F.lit(0.0)).cast("int")).alias("started_on"))
    return regimens, rx.join(known.select("name"), "name", "left_anti").groupBy("name").agg(F.count("*").alias("n"))


def patients_list(t: Tables, tag: str | None, as_of: str) -> DataFrame:
    """Summary with the span of the patient's sensors, those with a tag only if one is named."""
    s = report.patient_summary(t, as_of).join(report.sensor_window(t).select("patient_id", "first_at", "last_at"), "patient_id", "left")
    if tag is not None:
        s = s.join(t["patient_tag"].where(F.col("tag") == tag).select("patient_id").distinct(), "patient_id", "left_semi")
    return s


def timeline(series: DataFrame, hours: int = 24) -> DataFrame:
    """The points of the last hours before each patient's newest one."""
    end = series.groupBy("patient_id").agg(F.max("time").alias("end"))
    return series.join(end, "patient_id").where(F.col("time") >= F.col("end") - F.make_dt_interval(F.lit(0), F.lit(hours))).drop("end")


def recorded(t: Tables, since: str, until: str) -> DataFrame:
    """Readings between two times for a replay: glucose and wearables within, sleep that overlaps."""
    a, b = (F.lit(x).cast("timestamp_ntz") for x in (since, until))
    d = t["device"].where("not is_live").select("device_id", "patient_id")
    g = t["fused"].where(F.col("time").between(a, b)).select("patient_id", "time", F.lit("glucose").alias("metric"), F.col("mg_dl").cast("double").alias("value"), F.lit(None).cast("string").alias("stage"))
    w = t["wearable"].where((F.col("metric") != "ibi_ms") & F.col("time").between(a, b)).join(d, "device_id").select("patient_id", "time", "metric", F.col("value").cast("double").alias("value"), F.lit(None).cast("string").alias("stage"))
    s = t["sleep"].where((F.col("end_time") > a) & (F.col("start_time") <= b)).join(d, "device_id").select("patient_id", F.col("start_time").alias("time"), F.lit("sleep").alias("metric"), F.lit(None).cast("double").alias("value"), "stage")
    return g.unionByName(w).unionByName(s)


def ingest_check(t: Tables) -> DataFrame:
    """Readings and span of every device, with the group of the patient's HbA1c."""
    g = t["native"].groupBy("device_id").agg(F.count("*").alias("readings"), F.min("time").alias("first_at"), F.max("time").alias("last_at"))
    b = report.patient_baseline(t).select("patient_id", "cohort")
    return g.join(t["device"].select("device_id", "patient_id"), "device_id").join(b, "patient_id", "left").groupBy("cohort").agg(F.count("*").alias("devices"), F.sum("readings").alias("readings"), F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at"))


def sensor_samples(wide: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """(device_id, time, metric, value): wearable columns to long rows of three decimals, nulls left out."""
    each = F.array(*[F.struct(F.lit(m).alias("metric"), C.rounded(F.col(m), 3).alias("value")) for m in metrics])
    return wide.select("device_id", "time", F.inline(each)).where("value is not null")


def without_live(rows: DataFrame, devices: DataFrame) -> DataFrame:
    """Rows of devices that are no live simulators: what a reset leaves."""
    return rows.join(devices.where("is_live").select("device_id"), "device_id", "left_anti")


# --- sinks ----------------------------------------------------------------------------------------------------------


def replaced(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``old`` with all rows of the keys that ``new`` has replaced by those of ``new``."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def kept(rows: DataFrame, keep: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows whose key is in the set to keep; the rest is stale."""
    return rows.join(keep.select(*key), list(key), "left_semi")


def write_replacing(new: DataFrame, path: str, key: str) -> None:
    """Overwrite the partitions of the keys that ``new`` has, and no others."""
    new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def write_features(df: DataFrame, path: str) -> None:
    """Parquet for training: decimals as doubles."""
    plain = [F.col(f"`{c}`").cast("double").alias(c) if kind.startswith("decimal") else F.col(f"`{c}`") for c, kind in df.dtypes]
    df.select(*plain).write.mode("overwrite").parquet(path)


def write_report(parts: Sequence[DataFrame], path: str) -> None:
    """One CSV with a header of all columns; a report is small by its nature."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    out.coalesce(1).write.mode("overwrite").csv(path, header=True)


def missing_shares(df: DataFrame, by: str) -> DataFrame:
    """(by, n, column, missing_pct): the dataset card's numbers, one pass."""
    names = [c for c in df.columns if c != by]
    g = df.groupBy(by).agg(F.count("*").alias("n"), *[F.avg(F.col(f"`{c}`").isNull().cast("int")).alias(c) for c in names])
    return g.select(by, "n", F.inline(F.array(*[F.struct(F.lit(c).alias("column"), C.rounded(100 * F.col(f"`{c}`"), 1).alias("missing_pct")) for c in names])))


def card(df: DataFrame, by: str) -> str:
    """The card as Markdown: as many lines as groups times columns."""
    lines = [f"| {by} | n | column | missing % |", "|---|---|---|---|"]
    lines += [f"| {r[0]} | {r['n']} | {r['column']} | {r['missing_pct']} |" for r in missing_shares(df, by).orderBy(by, "column").collect()]
    return "\n".join(lines)
