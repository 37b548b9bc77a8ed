"""Queries over the health views and operators, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspark.functions import clinical as C
from cohortspark.operators import analytic as A
from cohortspark.operators import report as R
from cohortspark.plans import blocks, fusion_queries, job_queries, learn_queries, live_queries, matching_queries, oracles, record_queries, source_queries, view_queries
from cohortspark.sources import proxy

AS_OF, NOW = "2026-01-01", "2024-03-09 04:00:00"


def _fused_daily(t):
    g = R.glucose_fused_daily(t)
    return g.withColumn("mean", C.rounded(F.col("mean_raw"), 3)).withColumn("sd", C.rounded(F.col("sd_raw"), 3)).drop("mean_raw", "sd_raw")


def _dedup(t):
    hour = F.to_timestamp_ntz(F.date_format("ts", "yyyy-MM-dd HH:00:00"))
    e = t["events"].select(F.col("user_id").alias("device_id"), F.col("event_type").alias("metric"), hour.alias("time"), "value", F.col("event_id").alias("ordinal"))
    return A.distinct_readings(e, e.where("ordinal % 11 = 0").select("device_id", "metric", "time"))


PLANS: dict[str, Callable] = {
    "v_glucose_daily": R.glucose_daily,
    "v_wearable_daily": R.wearable_daily,
    "v_glucose_fused_daily": _fused_daily,
    "v_cgm_daily": R.cgm_daily,
    "v_cgm_window": R.cgm_window,
    "v_cgm_device_daily": R.cgm_device_daily,
    "v_cgm_device_window": R.cgm_device_window,
    "v_observation_latest": R.observation_latest,
    "v_patient_baseline": R.patient_baseline,
    "v_patient_summary": lambda t: R.patient_summary(t, AS_OF),
    "v_medication_regimen": R.medication_regimen,
    "v_condition_episode": R.condition_episode,
    "v_patient_conditions": R.patient_conditions,
    "v_observation_result": lambda t: t["observation"].select("patient_id", "l_orderkey", "l_linenumber", "analyte", "value", "effective_at", "is_synthetic"),
    "v_visit": R.visit,
    "v_activity_daily": R.activity_daily,
    "v_sleep_nightly": R.sleep_nightly,
    "v_spo2_nightly": R.spo2_nightly,
    "v_hrv_nightly": lambda t: R.hrv_nightly(t, max_gap_s=86400, min_beats=1),
    "v_consistency": R.consistency,
    "v_sensor_window": R.sensor_window,
    "v_replay_stream": R.replay_stream,
    "v_twin_latest": lambda t: R.latest_of_each(t, NOW),
    "v_patient_split": lambda t: t["patient"].select("patient_id", C.split_of(F.col("patient_id")).alias("split")),
    "v_patient_static": A.patient_static,
    "v_patient_day": A.patient_day,
    "v_series_5min": A.series_5min,
    "a_labels": A.labels,
    "a_split_chrono": A.split_chrono,
    "a_metrics": lambda t: A.metrics(A.persistence(t), ["patient_id"]),
    "a_clarke": lambda t: A.clarke(A.persistence(t)),
    "a_conformal": lambda t: A.conformal(A.persistence(t), ["patient_id"]),
    "a_regimen_episodes": R.regimen_episodes,
    "a_warnings": lambda t: A.warnings(A.forecast_points(t)),
    "op_win_rolling": A.rolling,
    "op_win_runs": A.runs,
    "op_win_slope": A.trend,
    "op_join_prefix": R.drug_classes,
    "op_join_asof": A.asof,
    "op_page": A.page,
    "op_union_distinct": lambda t: t["glucose"].select("device_id", F.to_date("time").alias("day")).union(t["wearable"].select("device_id", F.to_date("time"))).distinct(),
    "s_dedup": _dedup,
}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.patient_baseline(proxy.views(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda spark, sf_dir, f=f: f(proxy.views(spark, sf_dir))) for name, f in (PLANS | blocks.PLANS | source_queries.PLANS | fusion_queries.PLANS | record_queries.PLANS | live_queries.PLANS | job_queries.PLANS | view_queries.PLANS | matching_queries.PLANS | learn_queries.PLANS).items()}


def oracle_sql() -> dict[str, str]:
    return {name: proxy.oracle_with(sql) for name, sql in (oracles.SQL | blocks.SQL | source_queries.SQL | fusion_queries.SQL | record_queries.SQL | live_queries.SQL | job_queries.SQL | view_queries.SQL | matching_queries.SQL | learn_queries.SQL).items()}
