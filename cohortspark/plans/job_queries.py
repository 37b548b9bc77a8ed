"""Queries of the forecast material and the batch jobs, each beside its SQL."""

from __future__ import annotations

from collections.abc import Callable

from cohortspark.operators import batch as B
from cohortspark.operators import forecast as P
from cohortspark.operators import relational
from cohortspark.plans import source_queries as X
from cohortspark.plans.fusion_queries import REF, _minute, _ref, _signed
from cohortspark.plans.oracles import ACTIVITY, BASELINE, CGM_DAILY, CGM_WINDOW, SLEEP, r
from cohortspark.sources import health_files as H
from pyspark.sql import functions as F

LAGS = (1, 3, 6, 12)


def _series(t):
    """Glucose and the wearable of the same five minutes; minute 0 is a midnight."""
    m = F.timestamp_diff("MINUTE", F.lit("2024-03-09").cast("timestamp_ntz"), F.col("time"))
    pick = lambda name: F.max(F.when(F.col("metric") == name, F.col("value")))
    g = t["reading"].where("metric in ('glucose', 'heart_rate', 'mets', 'steps')").groupBy("patient_id", m.alias("minute"))
    s = g.agg(pick("glucose").alias("glucose"), pick("heart_rate").alias("heart_rate"), pick("mets").alias("met_minutes"), pick("steps").alias("steps"))
    return s.withColumn("insulin_fast", F.when(F.col("minute") % 35 == 0, 2.0)).withColumn("oral_doses", F.when(F.col("minute") % 60 == 0, 1.0))


def _bench(t):
    """The frame of readings a minute or two beside their grid."""
    drift = _ref(t).select("patient_id", (F.col("minute") + F.col("patient_id") % 3 + (F.col("value") % 11 == 0).cast("int")).alias("minute"), "value")
    hr = t["reading"].where("metric = 'heart_rate'").select("patient_id", (_minute() + F.col("value").cast("int") % 5).alias("minute"), "value")
    kcal = t["reading"].where("metric = 'mets'").select("patient_id", (_minute() + 3).alias("minute"), "value")
    meals = _ref(t).where("value % 7 = 3").select("patient_id", "minute", F.col("value").alias("energy_kcal"), F.when(F.col("value") % 2 == 1, F.col("value") / 4).alias("carbs_g"))
    return P.bench_frame(drift, hr, kcal, meals, 2)


def _predictions(t):
    """Two models over the series: now, and now plus a quarter of an hour's change; the second is often missing."""
    f = P.features(_series(t)).where("glucose is not null").select("patient_id", "minute", F.col("glucose").alias("now"), "glucose_lag15", F.inline(F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"target_t{h}").alias("target")) for h in (30, 60)])))
    last = f.select(F.lit("last").alias("model"), "patient_id", "minute", "horizon", "now", "target", F.col("now").alias("pred"))
    return last.unionByName(f.select(F.lit("trend").alias("model"), "patient_id", "minute", "horizon", "now", "target", (F.col("now") * 1.5 - F.col("glucose_lag15") * 0.5).alias("pred")))


def _groups(t):
    return t["device"].select("patient_id", F.when(F.col("patient_id") % 2 == 0, "even").otherwise("odd").alias("group"))


def _static(t):
    c = t["customer"]
    k = F.col("c_custkey")
    return c.select(
        k.alias("patient_id"), F.when(k % 3 == 0, "nhanes").otherwise("other").alias("cohort"), F.when(k % 5 > 0, 5.0 + k % 40 / 10.0).cast("double").alias("hba1c"), F.when(k % 2 == 0, "female").otherwise("male").alias("sex"),
        F.element_at(F.array(F.lit("daily"), F.lit("never"), F.lit(None)), (k % 3 + 1).cast("int")).alias("smoking"), (k % 8).alias("valid_step_days"), (1000.0 + k % 9000).cast("double").alias("steps_per_valid_day"), (k % 4 == 0).alias("diagnosed"), (k % 20).cast("double").alias("duration"),
    )


def _products(t):
    p = t["part"].where("p_partkey % 5 > 0").select(F.col("p_partkey").alias("product_id"), F.explode(F.sequence(F.lit(1), (F.col("p_partkey") % 3 + 1).cast("int"))).alias("n"))
    return p.select("product_id", (F.col("product_id") * 10 + F.col("n")).alias("ingredient_id"))


def _rx(t):
    names = F.concat(F.lit("drug"), (F.col("l_partkey") % 12).cast("string"))
    return t["lineitem"].select(F.col("l_orderkey").alias("SEQN"), names.alias("name"), F.when(F.col("l_linenumber") % 2 == 0, F.col("l_quantity")).alias("days"))


def _known(t):
    return t["part"].where("p_partkey % 12 < 9").select(F.concat(F.lit("drug"), (F.col("p_partkey") % 12).cast("string")).alias("name")).distinct()


def _exam(t):
    return t["orders"].select(F.col("o_orderkey").alias("SEQN"), F.to_date("o_orderdate").alias("exam_date"))


def _wide(t):
    return t["events"].select(F.col("user_id").alias("device_id"), F.col("ts").alias("time"), (F.col("value") / 7).alias("heart_rate"), F.when(F.col("event_id") % 3 == 0, F.col("value") / 10).alias("mets"))


def _inputs(t):
    at = _ref(t).groupBy("patient_id").agg((F.max("minute") - 60).alias("at"))
    return P.forecast_inputs(_ref(t), at, 180, 65)


_NEW = lambda t: t["customer"].where("c_nationkey % 2 = 0").select("c_nationkey", (F.col("c_custkey") + 100000).alias("c_custkey"))

PLANS: dict[str, Callable] = {
    "a_features_forecast": lambda t: P.features(_series(t)),
    "a_bench_frame": _bench,
    "a_origins": lambda t: P.origins(_bench(t), 6),
    "a_score": lambda t: P.score_table(_predictions(t), 2, _groups(t))[0],
    "a_score_patients": lambda t: P.score_table(_predictions(t), 2, _groups(t))[1].select("model", "horizon", "patient_id", "n", "rmse", "skill"),
    "a_score_groups": lambda t: P.score_table(_predictions(t), 2, _groups(t))[2].select("model", "horizon", "group", "n", "mae", "mard_pct"),
    "a_forecast_inputs": _inputs,
    "a_prepare_pop": lambda t: P.prepared(_static(t), "nhanes"),
    "a_ols_boot": lambda t: P.associations(P.prepared(_static(t), "nhanes"), ["male", "steps_k", "duration"], "hba1c", replicates=100),
    "a_day_offset": lambda t: t["orders"].select("o_orderkey", B.day_offset(F.col("o_orderdate"), F.lit("2020-01-01").cast("date")).alias("days")),
    "a_ingredient_expand": lambda t: B.expanded(t["regimen"].select("patient_id", "l_orderkey", "l_linenumber", F.col("medication_id").alias("product_id")), _products(t))[0],
    "a_ingredient_unmapped": lambda t: B.expanded(t["regimen"].select(F.col("medication_id").alias("product_id")), _products(t))[1],
    "a_real_age": lambda t: t["patient"].select("patient_id", P.real_age(F.col("birth_date"), F.when(F.col("patient_id") % 3 == 0, (F.col("patient_id") % 7).cast("int")), F.lit("2026-01-01").cast("date")).alias("age")),
    "p_summ_cgm": lambda t: B.cgm_summaries(t, 10.0),
    "p_summ_hr": lambda t: B.activity_summaries(t, 2),
    "p_summ_night": B.night_summaries,
    "p_retag": lambda t: B.retagged(t["patient_tag"], B.report.consistency(t)),
    "p_real_labs": B.real_labs,
    "p_derived_labs": B.derived_labs,
    "p_race": lambda t: B.race_codes(t["customer"].select(F.col("c_custkey").alias("patient_id"), F.element_at(F.array(*[F.lit(x) for x in ("White", "Hispanic/Latino", "Asian", "Black or African American", None)]), (F.col("c_custkey") % 5 + 1).cast("int")).alias("race"))),
    "p_nhanes": lambda t: B.exam_rows(H.survey_observations(X._people(t), X.LABS)),
    "p_nhanes_wear": lambda t: B.wear_days(X._steps(t), 2),
    "p_nhanes_regimens": lambda t: B.regimen_starts(_rx(t), _known(t), _exam(t))[0],
    "p_nhanes_unmapped": lambda t: B.regimen_starts(_rx(t), _known(t), _exam(t))[1],
    "p_patients_list": lambda t: B.patients_list(t, "rich", "2026-01-01"),
    "p_timeline": lambda t: B.timeline(t["native"].select(F.col("device_id").alias("patient_id"), "time", "mg_dl"), 48),
    "p_recorded": lambda t: B.recorded(t, "2024-01-05 00:00:00", "2024-03-09 02:00:00"),
    "p_ingest_check": B.ingest_check,
    "p_load_sensors": lambda t: B.sensor_samples(_wide(t), ["heart_rate", "mets"]),
    "p_stream_reset": lambda t: B.without_live(t["wearable"], t["device"]).groupBy("device_id").agg(F.count("*").alias("n")),
    "snk_replace": lambda t: B.replaced(t["customer"].select("c_nationkey", "c_custkey"), _NEW(t), "c_nationkey"),
    "snk_stale_delete": lambda t: B.kept(t["regimen"].select("patient_id", "l_orderkey", "l_linenumber"), t["patient"].where("patient_id % 4 = 0"), ["patient_id"]),
    "snk_card": lambda t: B.missing_shares(t["regimen"].select(F.col("is_synthetic").cast("string").alias("kind"), "ended_at", "medication_id"), "kind"),
    "snk_refresh": lambda t: B.report.wearable_daily(t).groupBy("metric").agg(F.sum("n").alias("n"), F.count("*").alias("days")),
    "op_sort": lambda t: t["encounter"].select("patient_id", "encounter_id", F.row_number().over(relational.Window.partitionBy("patient_id").orderBy(F.desc(F.col("class") == "emergency"), F.desc("started_at"), "encounter_id")).alias("place")),
}

_SERIES = "SELECT patient_id, CAST(date_diff('minute', TIMESTAMP '2024-03-09', time) AS BIGINT) AS minute, max(value) FILTER (metric = 'glucose') AS glucose, max(value) FILTER (metric = 'heart_rate') AS heart_rate, max(value) FILTER (metric = 'mets') AS met_minutes, max(value) FILTER (metric = 'steps') AS steps FROM reading WHERE metric IN ('glucose', 'heart_rate', 'mets', 'steps') GROUP BY 1, 2"
_GRID = f"SELECT g.patient_id, g.minute, s.glucose, heart_rate, met_minutes, steps, CASE WHEN s.patient_id IS NOT NULL AND g.minute % 35 = 0 THEN 2.0 END AS insulin_fast, CASE WHEN s.patient_id IS NOT NULL AND g.minute % 60 = 0 THEN 1.0 END AS oral_doses FROM (SELECT patient_id, unnest(range(min(minute), max(minute) + 1, 5)) AS minute FROM ({_SERIES}) GROUP BY 1) g LEFT JOIN ({_SERIES}) s ON s.patient_id = g.patient_id AND s.minute = g.minute"
_ROLL = "(PARTITION BY patient_id ORDER BY minute ROWS BETWEEN {} PRECEDING AND CURRENT ROW)"
FEATURES = f"""SELECT patient_id, minute, glucose, {', '.join(f'lag(glucose, {k}) OVER w AS glucose_lag{5 * k}' for k in LAGS)}, glucose - lag(glucose, 1) OVER w AS roc_5, {_signed('((glucose - lag(glucose, 3) OVER w) / 3)', 6)} AS roc_15, {_signed('((glucose - lag(glucose, 6) OVER w) / 6)', 6)} AS roc_30,
 CASE WHEN count(glucose) OVER h >= 6 THEN {r('avg(glucose) OVER h', 6)} END AS mean_60, CASE WHEN count(glucose) OVER h >= 6 THEN {r('stddev_samp(glucose) OVER h', 6)} END AS sd_60, {r(f'avg(heart_rate) OVER {_ROLL.format(5)}', 6)} AS heart_rate_30, sum(met_minutes) OVER {_ROLL.format(5)} AS met_minutes_30, sum(met_minutes) OVER h AS met_minutes_60, sum(steps) OVER h AS steps_60,
 CAST(sum(coalesce(insulin_fast, 0)) OVER {_ROLL.format(23)} AS DOUBLE) AS insulin_fast_2h, CAST(sum(coalesce(oral_doses, 0)) OVER {_ROLL.format(143)} AS DOUBLE) AS oral_doses_12h, {_signed('sin((minute % 1440) * (2 * 3.141592653589793 / 1440))', 6)} AS tod_sin, {_signed('cos((minute % 1440) * (2 * 3.141592653589793 / 1440))', 6)} AS tod_cos, lead(glucose, 6) OVER w AS target_t30, lead(glucose, 12) OVER w AS target_t60
 FROM ({_GRID}) WINDOW w AS (PARTITION BY patient_id ORDER BY minute), h AS {_ROLL.format(11)}"""
_DRIFT = f"SELECT patient_id, minute + patient_id % 3 + CASE WHEN CAST(value AS INTEGER) % 11 = 0 THEN 1 ELSE 0 END AS minute, value FROM ({REF})"
_PHASE = f"SELECT DISTINCT ON (patient_id) patient_id, phase FROM (SELECT patient_id, minute % 5 AS phase, count(*) AS n FROM ({_DRIFT}) GROUP BY 1, 2) ORDER BY patient_id, n DESC, phase"
_MIN = "CAST(date_diff('minute', TIMESTAMP '2024-03-09', time) AS BIGINT)"
_BIN = "phase + 5 * CAST(ceil((s.minute - phase) / 5) AS BIGINT)"
_GRAM = f"SELECT s.patient_id, phase + 5 * CAST(round_even((s.minute - phase) / 5, 0) AS BIGINT) AS minute, avg(value) AS glucose FROM ({_DRIFT}) s JOIN ({_PHASE}) USING (patient_id) GROUP BY 1, 2"
BENCH = f"""WITH ph AS ({_PHASE}), gl AS ({_GRAM}), gpts AS (SELECT patient_id, unnest(range(a, b + 6, 5)) AS minute FROM (SELECT s.patient_id, CAST(floor(min(minute) / 60) AS BIGINT) * 60 + any_value(phase) AS a, max(minute) AS b FROM ({_DRIFT}) s JOIN ph USING (patient_id) GROUP BY 1)),
 f AS (SELECT x.patient_id, x.minute, gl.glucose FROM gpts x LEFT JOIN gl ON gl.patient_id = x.patient_id AND gl.minute = x.minute),
 k AS (SELECT *, last_value(CASE WHEN glucose IS NOT NULL THEN minute END IGNORE NULLS) OVER w AS m0, last_value(glucose IGNORE NULLS) OVER w AS g0, first_value(CASE WHEN glucose IS NOT NULL THEN minute END IGNORE NULLS) OVER x AS m1, first_value(glucose IGNORE NULLS) OVER x AS g1 FROM f WINDOW w AS (PARTITION BY patient_id ORDER BY minute ROWS UNBOUNDED PRECEDING), x AS (PARTITION BY patient_id ORDER BY minute ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
 hr AS (SELECT s.patient_id, {_BIN} AS minute, avg(value) AS hr FROM (SELECT patient_id, {_MIN} + CAST(value AS INTEGER) % 5 AS minute, value FROM reading WHERE metric = 'heart_rate') s JOIN ph USING (patient_id) GROUP BY 1, 2), kc AS (SELECT s.patient_id, {_BIN} AS minute, sum(value) AS active_kcal FROM (SELECT patient_id, {_MIN} + 3 AS minute, value FROM reading WHERE metric = 'mets') s JOIN ph USING (patient_id) GROUP BY 1, 2),
 me AS (SELECT s.patient_id, {_BIN} AS minute, sum(value) AS energy_kcal, sum(CASE WHEN CAST(value AS INTEGER) % 2 = 1 THEN value / 4 ELSE 0 END) AS carbs_g, CAST(count(*) AS DOUBLE) AS meal FROM (SELECT * FROM ({REF}) WHERE CAST(value AS INTEGER) % 7 = 3) s JOIN ph USING (patient_id) GROUP BY 1, 2)
 SELECT k.patient_id, k.minute, {r('glucose', 6)} AS glucose, {r('CASE WHEN glucose IS NOT NULL THEN glucose WHEN (m1 - m0) / 5 - 1 <= 2 THEN g0 + (g1 - g0) * (k.minute - m0) / (m1 - m0) END', 6)} AS glucose_in, {r('hr', 6)} AS hr, active_kcal, coalesce(energy_kcal, 0) AS energy_kcal, coalesce(carbs_g, 0) AS carbs_g, coalesce(meal, 0) AS meal
 FROM k LEFT JOIN hr ON hr.patient_id = k.patient_id AND hr.minute = k.minute LEFT JOIN kc ON kc.patient_id = k.patient_id AND kc.minute = k.minute LEFT JOIN me ON me.patient_id = k.patient_id AND me.minute = k.minute"""
_PRED = f"WITH f AS ({FEATURES}), o AS (SELECT patient_id, minute, glucose AS now, glucose_lag15, unnest([30, 60]) AS horizon, unnest([target_t30, target_t60]) AS target FROM f WHERE glucose IS NOT NULL), c AS (SELECT *, now * 1.5 - glucose_lag15 * 0.5 AS trend FROM o WHERE target IS NOT NULL AND glucose_lag15 IS NOT NULL), p AS (SELECT 'last' AS model, patient_id, minute, horizon, now, target, now AS pred FROM c UNION ALL SELECT 'trend', patient_id, minute, horizon, now, target, trend FROM c)"
_RMSE, _BASE = "sqrt(avg((pred - target) * (pred - target)))", "sqrt(avg((now - target) * (now - target)))"
_MAE, _MARD, _SKILL = r("avg(abs(pred - target))", 4), r("100 * avg(abs(pred - target) / target)", 3), _signed(f"(1 - {_RMSE} / nullif({_BASE}, 0))", 4)
_CONS = f"SELECT w.patient_id, CASE WHEN {r('abs(hba1c - gmi)', 2)} <= 0.5 THEN 'ok' WHEN {r('abs(hba1c - gmi)', 2)} <= 1.0 THEN 'warn' ELSE 'inconsistent' END AS status FROM ({CGM_WINDOW}) w LEFT JOIN ({BASELINE}) b USING (patient_id)"
_SPO2 = f"SELECT patient_id, night, {r('avg(value)', 1)} AS spo2_mean FROM (SELECT d.patient_id, CAST(s.start_time - INTERVAL 12 HOUR AS DATE) AS night, w.value FROM wearable w JOIN sleep s ON w.device_id = s.device_id AND w.time >= s.start_time AND w.time < s.end_time AND s.stage <> 'awake' JOIN device d ON d.device_id = w.device_id AND NOT d.is_live WHERE w.metric = 'spo2') GROUP BY 1, 2"
_DRUG = "'drug' || (l_partkey % 12)"

SQL: dict[str, str] = {
    "a_features_forecast": FEATURES,
    "a_bench_frame": BENCH,
    "a_origins": f"SELECT patient_id, minute, glucose AS now, t15, t30, t60 FROM (SELECT *, count(glucose_in) OVER (PARTITION BY patient_id ORDER BY minute ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS n, lead(glucose, 3) OVER w AS t15, lead(glucose, 6) OVER w AS t30, lead(glucose, 12) OVER w AS t60 FROM ({BENCH}) WINDOW w AS (PARTITION BY patient_id ORDER BY minute)) WHERE n = 6 AND glucose IS NOT NULL AND coalesce(t15, t30, t60) IS NOT NULL",
    "a_score": f"{_PRED} SELECT model, horizon, count(*) AS n, {r(_RMSE, 4)} AS rmse, {_MAE} AS mae, {_MARD} AS mard_pct, {_signed('avg(pred - target)', 4)} AS bias, {_SKILL} AS skill FROM p GROUP BY 1, 2",
    "a_score_patients": f"{_PRED} SELECT model, horizon, patient_id, count(*) AS n, {r(_RMSE, 4)} AS rmse, {_SKILL} AS skill FROM p GROUP BY 1, 2, 3",
    "a_score_groups": f"{_PRED} SELECT model, horizon, CASE WHEN patient_id % 2 = 0 THEN 'even' ELSE 'odd' END AS \"group\", count(*) AS n, {_MAE} AS mae, {_MARD} AS mard_pct FROM p GROUP BY 1, 2, 3",
    "a_forecast_inputs": f"SELECT patient_id, CASE WHEN minute <= spot THEN 'history' ELSE 'after' END AS kind, minute, value FROM (SELECT *, max(minute) OVER (PARTITION BY patient_id) - 60 AS spot FROM ({REF})) WHERE minute > spot - 180 AND minute <= spot + 65",
    "a_prepare_pop": "SELECT c_custkey AS patient_id, CAST(5.0 + c_custkey % 40 / 10.0 AS DOUBLE) AS hba1c, CASE WHEN c_custkey % 2 = 1 THEN 1.0 ELSE 0.0 END::DOUBLE AS male, CASE WHEN c_custkey % 3 = 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS current_smoker, CASE WHEN c_custkey % 8 >= 4 THEN (1000.0 + c_custkey % 9000)::DOUBLE / 1000 END AS steps_k, CASE WHEN c_custkey % 4 = 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS diagnosed, CASE WHEN c_custkey % 4 = 0 THEN CAST(c_custkey % 20 AS DOUBLE) ELSE 0.0 END::DOUBLE AS duration FROM customer WHERE c_custkey % 3 = 0 AND c_custkey % 5 > 0",
    "a_day_offset": "SELECT o_orderkey, CAST(date_diff('day', DATE '2020-01-01', CAST(o_orderdate AS DATE) + 1) AS INTEGER) AS days FROM orders",
    "a_ingredient_expand": "SELECT patient_id, l_orderkey, l_linenumber, medication_id AS product_id, medication_id * 10 + n AS ingredient_id FROM (SELECT *, unnest(range(1, medication_id % 3 + 2)) AS n FROM regimen WHERE medication_id IN (SELECT p_partkey FROM part WHERE p_partkey % 5 > 0))",
    "a_ingredient_unmapped": "SELECT medication_id AS product_id, count(*) AS regimens FROM regimen WHERE medication_id NOT IN (SELECT p_partkey FROM part WHERE p_partkey % 5 > 0) GROUP BY 1",
    "a_real_age": "SELECT patient_id, CAST(2026 - year(birth_date) - CASE WHEN month(birth_date) * 100 + day(birth_date) > 101 THEN 1 ELSE 0 END - CASE WHEN patient_id % 3 = 0 THEN patient_id % 7 ELSE 0 END AS INTEGER) AS age FROM patient",
    "p_summ_cgm": f"WITH d AS ({CGM_DAILY}), w AS ({CGM_WINDOW}) SELECT patient_id, day, '97507-8' AS code, mean AS value FROM d WHERE coverage >= 10 AND mean IS NOT NULL UNION ALL SELECT patient_id, day, '104638-2', cv FROM d WHERE coverage >= 10 AND cv IS NOT NULL UNION ALL SELECT patient_id, NULL, '97506-0', gmi FROM w WHERE gmi IS NOT NULL",
    "p_summ_hr": f"WITH a AS ({ACTIVITY}) SELECT patient_id, day, '8867-4' AS code, {r('hr_mean')} AS value FROM a WHERE hr_minutes >= 2 AND hr_mean IS NOT NULL UNION ALL SELECT patient_id, day, '55423-8', steps FROM a WHERE steps IS NOT NULL",
    "p_summ_night": f"WITH s AS ({SLEEP}), o AS ({_SPO2}) SELECT patient_id, night, '93832-4' AS code, asleep_min AS value FROM s WHERE asleep_min IS NOT NULL UNION ALL SELECT s.patient_id, s.night, '59408-5', spo2_mean FROM s JOIN o ON o.patient_id = s.patient_id AND o.night = s.night",
    "p_retag": f"SELECT patient_id, tag FROM patient_tag WHERE tag NOT IN ('gmi-warn', 'gmi-inconsistent') UNION ALL SELECT patient_id, 'gmi-' || status FROM ({_CONS}) WHERE status <> 'ok'",
    "p_real_labs": "SELECT DISTINCT ON (patient_id, analyte) patient_id, analyte, value, effective_at FROM observation WHERE NOT is_synthetic AND value IS NOT NULL ORDER BY patient_id, analyte, effective_at DESC, l_orderkey, l_linenumber, value",
    "p_derived_labs": f"WITH b AS ({BASELINE}) SELECT patient_id, '39156-5' AS code, bmi AS value FROM b WHERE bmi IS NOT NULL AND NOT coalesce(bmi_is_synthetic, false) UNION ALL SELECT patient_id, '13457-7', ldl FROM b WHERE ldl IS NOT NULL AND NOT ldl_is_synthetic",
    "p_race": "SELECT c_custkey AS patient_id, CASE c_custkey % 5 WHEN 0 THEN '2106-3' WHEN 3 THEN '2054-5' END AS race_code, CASE WHEN c_custkey % 5 = 1 THEN '2135-2' ELSE '2186-5' END AS ethnicity_code FROM customer WHERE c_custkey % 5 IN (0, 1, 3)",
    "p_nhanes": f"SELECT * FROM ({X.SQL['src_nhanes_obs']}) WHERE value > 0",
    "p_nhanes_wear": f"SELECT SEQN, PAXDAYM, count(*) AS wear_minutes, sum(steps) FILTER (steps > 0) AS steps, count(*) >= 2 AS valid FROM ({X.SQL['src_nhanes_steps']}) GROUP BY 1, 2",
    "p_nhanes_regimens": f"SELECT l_orderkey AS SEQN, {_DRUG} AS name, CAST(o_orderdate AS DATE) - CASE WHEN l_linenumber % 2 = 0 THEN CAST(l_quantity AS INTEGER) ELSE 0 END AS started_on FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_partkey % 12 < 9",
    "p_nhanes_unmapped": f"SELECT {_DRUG} AS name, count(*) AS n FROM lineitem WHERE l_partkey % 12 >= 9 GROUP BY 1",
    "p_timeline": "SELECT device_id AS patient_id, time, mg_dl FROM native n WHERE time >= (SELECT max(time) FROM native x WHERE x.device_id = n.device_id) - INTERVAL 48 HOUR",
    "p_recorded": """SELECT patient_id, time, 'glucose' AS metric, CAST(mg_dl AS DOUBLE) AS value, NULL::VARCHAR AS stage FROM fused WHERE time BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-03-09 02:00:00' UNION ALL SELECT patient_id, time, metric, CAST(value AS DOUBLE), NULL FROM wearable JOIN device USING (device_id) WHERE NOT is_live AND metric <> 'ibi_ms' AND time BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-03-09 02:00:00'
 UNION ALL SELECT patient_id, start_time, 'sleep', NULL, stage FROM sleep JOIN device USING (device_id) WHERE NOT is_live AND end_time > TIMESTAMP '2024-01-05 00:00:00' AND start_time <= TIMESTAMP '2024-03-09 02:00:00'""",
    "p_ingest_check": f"SELECT cohort, count(*) AS devices, CAST(sum(n) AS BIGINT) AS readings, min(a) AS first_at, max(b) AS last_at FROM (SELECT device_id, count(*) AS n, min(time) AS a, max(time) AS b FROM native GROUP BY 1) JOIN device USING (device_id) LEFT JOIN (SELECT patient_id, cohort FROM ({BASELINE})) USING (patient_id) GROUP BY 1",
    "p_load_sensors": f"SELECT user_id AS device_id, ts AS time, 'heart_rate' AS metric, {r('value / 7', 3)} AS value FROM events UNION ALL SELECT user_id, ts, 'mets', {r('value / 10', 3)} FROM events WHERE event_id % 3 = 0",
    "p_stream_reset": "SELECT device_id, count(*) AS n FROM wearable WHERE device_id NOT IN (SELECT device_id FROM device WHERE is_live) GROUP BY 1",
    "snk_replace": "SELECT c_nationkey, c_custkey FROM customer WHERE c_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_nationkey % 2 = 0) UNION ALL SELECT c_nationkey, c_custkey + 100000 FROM customer WHERE c_nationkey % 2 = 0",
    "snk_stale_delete": "SELECT patient_id, l_orderkey, l_linenumber FROM regimen WHERE patient_id IN (SELECT c_custkey FROM customer WHERE c_custkey % 4 = 0)",
    "snk_card": f"SELECT CAST(is_synthetic AS VARCHAR) AS kind, count(*) AS n, 'ended_at' AS \"column\", {r('100.0 * count(*) FILTER (ended_at IS NULL) / count(*)', 1)} AS missing_pct FROM regimen GROUP BY 1 UNION ALL SELECT CAST(is_synthetic AS VARCHAR), count(*), 'medication_id', 0.0 FROM regimen GROUP BY 1",
    "snk_refresh": "SELECT metric, CAST(sum(n) AS BIGINT) AS n, count(*) AS days FROM (SELECT device_id, metric, CAST(time AS DATE) AS day, count(*) AS n FROM wearable GROUP BY 1, 2, 3) GROUP BY 1",
    "op_sort": "SELECT patient_id, encounter_id, CAST(row_number() OVER (PARTITION BY patient_id ORDER BY class = 'emergency' DESC, started_at DESC, encounter_id) AS INTEGER) AS place FROM encounter",
    "p_patients_list": """SELECT p.patient_id, name AS display_name, sex, CAST(2026 - year(birth_date) - CASE WHEN month(birth_date) * 100 + day(birth_date) > 101 THEN 1 ELSE 0 END AS INTEGER) AS age, source_id = 0 AS is_real, first_at, last_at FROM patient p LEFT JOIN (SELECT patient_id, min(time) AS first_at, max(time) AS last_at FROM (SELECT device_id, time FROM glucose UNION ALL SELECT device_id, time FROM wearable) JOIN device USING (device_id) WHERE NOT is_live AND NOT is_synthetic GROUP BY 1) w USING (patient_id)
 WHERE p.patient_id IN (SELECT patient_id FROM patient_tag WHERE tag = 'rich')""",
}
