"""DuckDB SQL of the registered queries, written apart from the Spark plans.

Fixed values: the same published constants and borders as in ``functions/clinical.py``.
"""

from __future__ import annotations


def r(x: str, digits: int = 0) -> str:
    return f"(floor(CAST({x} AS DOUBLE) * {10**digits}.0 + 0.5) / {10**digits}.0)"


def signed(x: str, digits: int = 0) -> str:
    return f"(sign({x}) * (floor(abs({x}) * {10**digits}.0 + 0.5) / {10**digits}.0) + 0.0)"


def age(birth: str, day: str) -> str:
    return f"(year({day}) - year({birth}) - CASE WHEN month({day}) * 100 + day({day}) < month({birth}) * 100 + day({birth}) THEN 1 ELSE 0 END)"


FUSED = """SELECT patient_id, CAST(time AS DATE) AS day, count(*) AS n, avg(mg_dl) AS m, stddev_samp(mg_dl) AS s,
 count(*) FILTER (mg_dl < 54) AS vl, count(*) FILTER (mg_dl >= 54 AND mg_dl < 70) AS lo, count(*) FILTER (mg_dl >= 70 AND mg_dl <= 180) AS ta,
 count(*) FILTER (mg_dl > 180 AND mg_dl <= 250) AS hi, count(*) FILTER (mg_dl > 250) AS vh, count(*) FILTER (censored) AS ce FROM fused GROUP BY 1, 2"""
RAW = """SELECT device_id, CAST(time AS DATE) AS day, count(*) AS n, avg(mg_dl) AS m, stddev_samp(mg_dl) AS s, count(*) FILTER (mg_dl < 54) AS vl, count(*) FILTER (mg_dl BETWEEN 54 AND 69) AS lo,
 count(*) FILTER (mg_dl BETWEEN 70 AND 180) AS ta, count(*) FILTER (mg_dl BETWEEN 181 AND 250) AS hi, count(*) FILTER (mg_dl > 250) AS vh FROM glucose GROUP BY 1, 2"""
BANDS = {"very_low": "vl", "low": "lo", "target": "ta", "high": "hi", "very_high": "vh"}
COUNTS = ", ".join(f"{v} AS n_{k}" for k, v in BANDS.items())
SHARES = ", ".join(f"{r(f'100.0 * {v} / n', 1)} AS pct_{k}" for k, v in BANDS.items())
CGM_DAILY = f"SELECT patient_id, day, n, {r('m', 1)} AS mean, least(100.0, {r('100.0 * n / 288', 1)}) AS coverage, {r('100 * s / m', 1)} AS cv, {SHARES} FROM ({FUSED})"
CGM_WINDOW = f"""SELECT patient_id, min(time) AS first_at, max(time) AS last_at, count(*) AS n, {r('avg(mg_dl)', 1)} AS mean, {r('3.31 + 0.02392 * avg(mg_dl)', 2)} AS gmi,
 {r('100 * stddev_samp(mg_dl) / avg(mg_dl)', 1)} AS cv, {r('100.0 * count(*) FILTER (mg_dl BETWEEN 70 AND 180) / count(*)', 1)} AS pct_target FROM fused GROUP BY 1"""
WEAR = "SELECT device_id, metric, CAST(time AS DATE) AS day, count(*) AS n, CAST(sum(value) AS DOUBLE) AS total, avg(value) AS mean, CAST(min(value) AS DOUBLE) AS low, CAST(max(value) AS DOUBLE) AS high FROM wearable GROUP BY 1, 2, 3"
LATEST = "SELECT DISTINCT ON (patient_id, analyte) patient_id, analyte, value, effective_at, is_synthetic FROM observation ORDER BY patient_id, analyte, is_synthetic, effective_at DESC, l_orderkey, l_linenumber, value"


def _pick(a: str, c: str) -> str:
    return f"max(value) FILTER (analyte = '{a}') AS {c}"


NAMES = {"hba1c": "hba1c", "glucose_fasting": "fasting_glucose", "insulin": "insulin", "cholesterol_total": "total_cholesterol", "hdl": "hdl", "triglycerides": "triglycerides", "ldl": "ldl_measured", "creatinine": "creatinine", "weight": "weight_kg", "height": "height_cm"}
_K, _A, _S = "CASE WHEN sex = 'female' THEN 0.7 ELSE 0.9 END", "CASE WHEN sex = 'female' THEN -0.241 ELSE -0.302 END", "CASE WHEN sex = 'female' THEN 1.012 ELSE 1.0 END"
_FRIED = r("CASE WHEN triglycerides <= 400 THEN total_cholesterol - hdl - triglycerides / 5 END")
_REAL = f"coalesce(CASE WHEN NOT list_contains(made, 'ldl') THEN ldl_measured END, CASE WHEN NOT list_has_any(made, ['cholesterol_total', 'hdl', 'triglycerides']) THEN {_FRIED} END)"
_EGFR = f"142 * pow(least(creatinine / ({_K}), 1.0), {_A}) * pow(greatest(creatinine / ({_K}), 1.0), -1.2) * pow(0.9938, {age('birth_date', 'CAST(cr_at AS DATE)')}) * {_S}"
BASELINE = f"""SELECT patient_id, {', '.join(NAMES.values())}, effective_at, {r('weight_kg / pow(height_cm / 100, 2)', 1)} AS bmi, list_has_any(made, ['weight', 'height']) AS bmi_is_synthetic,
 total_cholesterol - hdl AS non_hdl, {r('total_cholesterol / nullif(hdl, 0)', 2)} AS tc_hdl_ratio, {r('CASE WHEN triglycerides <= 400 THEN triglycerides / 5 END')} AS vldl, {_FRIED} AS friedewald, coalesce({_REAL}, ldl_measured, {_FRIED}) AS ldl, {_REAL} IS NULL AS ldl_is_synthetic,
 {r('fasting_glucose * insulin / 405', 2)} AS homa_ir, list_has_any(made, ['glucose_fasting', 'insulin']) AS homa_ir_is_synthetic, round_even({_EGFR}, 0) AS egfr, list_contains(made, 'creatinine') AS egfr_is_synthetic,
 CASE WHEN hba1c < 5.7 THEN 'normal' WHEN hba1c < 6.5 THEN 'prediabetes' WHEN hba1c IS NOT NULL THEN 't2d' END AS cohort, array_to_string(made, ',') AS synthetic_analytes
 FROM (SELECT patient_id, {', '.join(_pick(a, c) for a, c in NAMES.items())}, max(effective_at) AS effective_at, max(effective_at) FILTER (analyte = 'creatinine') AS cr_at, coalesce(list(analyte ORDER BY analyte) FILTER (is_synthetic), []) AS made FROM ({LATEST}) GROUP BY 1) JOIN patient USING (patient_id)"""


def _day(metric: str, column: str, digits: int, name: str) -> str:
    value = f"max({column}) FILTER (metric = '{metric}')"
    return f"{r(value, digits)} AS {name}"


_MORE = [("wear_minutes", "total", 0, "wear_minutes"), ("active_kcal", "total", 1, "active_kcal"), ("activity_level", "mean", 2, "activity_level_mean"), ("respiration_rate", "mean", 1, "respiration_mean"), ("stress", "mean", 1, "stress_mean"), ("skin_temp", "mean", 2, "skin_temp_mean"), ("eda", "mean", 3, "eda_mean")]
ACTIVITY = f"""SELECT patient_id, day, {r("max(total) FILTER (metric = 'steps')")} AS steps, {r("max(mean) FILTER (metric = 'heart_rate')", 1)} AS hr_mean, {r("max(low) FILTER (metric = 'heart_rate')")} AS hr_min,
 {r("max(high) FILTER (metric = 'heart_rate')")} AS hr_max, max(n) FILTER (metric = 'heart_rate') AS hr_minutes, {r("max(total) FILTER (metric = 'mets')", 1)} AS met_minutes, {r("max(mean) FILTER (metric = 'spo2')", 1)} AS spo2_mean, {', '.join(_day(*m) for m in _MORE)},
 coalesce(string_agg(DISTINCT metric, ',' ORDER BY metric) FILTER (is_synthetic), '') AS synthetic_metrics FROM ({WEAR}) JOIN device USING (device_id) WHERE NOT is_live GROUP BY 1, 2"""
_MIN = "(epoch_us(end_time) - epoch_us(start_time)) / 1000000 / 60"


def _stage(x: str) -> str:
    return f"{r(f'sum(m) FILTER (stage = {chr(39)}{x}{chr(39)})')} AS {x}_min"


SLEEP = f"""SELECT patient_id, night, min(start_time) AS bed_at, max(end_time) AS wake_at, {r("sum(m) FILTER (stage <> 'awake')")} AS asleep_min, {', '.join(_stage(x) for x in ('deep', 'light', 'rem', 'awake'))},
 {r("100 * sum(m) FILTER (stage <> 'awake') / nullif(sum(m), 0)", 1)} AS efficiency FROM (SELECT *, CAST(start_time - INTERVAL 12 HOUR AS DATE) AS night, {_MIN} AS m FROM sleep JOIN device USING (device_id) WHERE NOT is_live) GROUP BY 1, 2"""
CLASS = "SELECT concept_id, min(prefix) AS drug_class FROM concept JOIN drug_class ON brand LIKE prefix || '%' GROUP BY 1"
LABELS = "SELECT f.patient_id, f.time, f.mg_dl, a.mg_dl AS glucose_t30, b.mg_dl AS glucose_t60 FROM fused f LEFT JOIN fused a ON a.patient_id = f.patient_id AND a.time = f.time + INTERVAL 30 MINUTE LEFT JOIN fused b ON b.patient_id = f.patient_id AND b.time = f.time + INTERVAL 60 MINUTE"
PAIRS = f"SELECT patient_id, time, mg_dl AS predicted, glucose_t30 AS actual FROM ({LABELS}) WHERE glucose_t30 IS NOT NULL"
_SPLIT = "CASE WHEN CAST('0x' || substr(md5(CAST(patient_id AS VARCHAR)), 1, 8) AS BIGINT) % 100 < 70 THEN 'train' WHEN CAST('0x' || substr(md5(CAST(patient_id AS VARCHAR)), 1, 8) AS BIGINT) % 100 < 85 THEN 'validation' ELSE 'test' END"
_ZONE = """CASE WHEN (predicted >= 0.8 * actual AND predicted <= 1.2 * actual) OR (actual <= 70 AND predicted <= 70) THEN 'A' WHEN (actual >= 180 AND predicted <= 70) OR (actual <= 70 AND predicted >= 180) THEN 'E'
 WHEN (actual BETWEEN 70 AND 290 AND predicted >= actual + 110) OR (actual BETWEEN 130 AND 180 AND predicted <= 1.4 * actual - 182) THEN 'C'
 WHEN ((actual >= 240 OR actual <= 175.0 / 3) AND predicted BETWEEN 70 AND 180) OR (actual BETWEEN 175.0 / 3 AND 70 AND predicted >= 1.2 * actual) THEN 'D' ELSE 'B' END"""
POINTS = """SELECT id, now, 15 * k AS horizon, g AS glucose, g - 15 AS low, g + 15 AS high FROM (SELECT id, now, unnest([1, 2, 3, 4]) AS k, unnest([h1, h2, h3, h4]) AS g FROM
 (SELECT device_id * 100000 + row_number() OVER w AS id, mg_dl AS now, lead(mg_dl, 1) OVER w AS h1, lead(mg_dl, 2) OVER w AS h2, lead(mg_dl, 3) OVER w AS h3, lead(mg_dl, 4) OVER w AS h4 FROM glucose WINDOW w AS (PARTITION BY device_id ORDER BY time)) WHERE h4 IS NOT NULL)"""

SQL: dict[str, str] = {
    "v_glucose_daily": f"SELECT device_id, day, n, m AS mean, {r('s', 3)} AS sd, {COUNTS} FROM ({RAW})",
    "v_wearable_daily": WEAR,
    "v_glucose_fused_daily": f"SELECT patient_id, day, n, {r('m', 3)} AS mean, {r('s', 3)} AS sd, {COUNTS}, ce AS n_censored FROM ({FUSED})",
    "v_cgm_daily": CGM_DAILY,
    "v_cgm_window": CGM_WINDOW,
    "v_cgm_device_daily": f"SELECT device_id, patient_id, day, n, {r('m', 1)} AS mean, {r('3.31 + 0.02392 * m', 2)} AS gmi, least(100.0, {r('100.0 * n * 300 / 86400', 1)}) AS coverage, {SHARES}, is_synthetic FROM ({RAW}) JOIN device USING (device_id) WHERE NOT is_live",
    "v_cgm_device_window": f"SELECT device_id, patient_id, count(*) AS n, count(DISTINCT CAST(time AS DATE)) AS days, {r('avg(mg_dl)', 1)} AS mean, {r('3.31 + 0.02392 * avg(mg_dl)', 2)} AS gmi, min(mg_dl) AS low, max(mg_dl) AS high FROM glucose JOIN device USING (device_id) WHERE NOT is_live GROUP BY 1, 2",
    "v_observation_latest": LATEST,
    "v_patient_baseline": BASELINE,
    "v_patient_summary": f"SELECT patient_id, name AS display_name, sex, CAST({age('birth_date', 'DATE {0}2026-01-01{0}'.format(chr(39)))} AS INTEGER) AS age, source_id = 0 AS is_real FROM patient",
    "v_medication_regimen": f"SELECT patient_id, l_orderkey, l_linenumber, medication_id, display, drug_class, started_at, ended_at, ended_at IS NULL AS active, is_synthetic FROM regimen LEFT JOIN concept ON concept.concept_id = medication_id LEFT JOIN ({CLASS}) c ON c.concept_id = medication_id",
    "v_condition_episode": "SELECT patient_id, l_orderkey, l_linenumber, regexp_replace(display, '\\s*\\([^()]*\\)$', '') AS condition, CASE WHEN regexp_matches(display, 'BRASS') THEN 'finding' ELSE 'diagnosis' END AS kind, started_at AS onset_at, ended_at AS abated_at FROM regimen LEFT JOIN concept ON concept_id = medication_id",
    "v_patient_conditions": "SELECT patient_id, grp, min(started_at) AS first_onset, bool_or(ended_at IS NULL) AS active, string_agg(DISTINCT display, '|' ORDER BY display) AS displays, bool_and(is_synthetic) AS is_synthetic FROM regimen JOIN concept ON concept_id = medication_id GROUP BY 1, 2",
    "v_observation_result": "SELECT patient_id, l_orderkey, l_linenumber, analyte, value, effective_at, is_synthetic FROM observation",
    "v_visit": "SELECT encounter_id, patient_id, class, started_at, ended_at, (epoch_us(ended_at) - epoch_us(started_at)) / 3600000000 AS hours FROM encounter",
    "v_activity_daily": ACTIVITY,
    "v_sleep_nightly": SLEEP,
    "v_spo2_nightly": f"""WITH j AS (SELECT d.patient_id, CAST(s.start_time - INTERVAL 12 HOUR AS DATE) AS night, w.time, w.value, d.is_synthetic FROM wearable w JOIN sleep s ON s.device_id = w.device_id AND w.time >= s.start_time AND w.time < s.end_time AND s.stage <> 'awake' JOIN device d ON d.device_id = w.device_id WHERE w.metric = 'spo2' AND NOT d.is_live),
 f AS (SELECT *, value <= max(value) OVER (PARTITION BY patient_id, night ORDER BY time, value ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) - 3 AS dropped FROM j),
 e AS (SELECT *, dropped AND NOT coalesce(lag(dropped) OVER (PARTITION BY patient_id, night ORDER BY time, value), false) AS begins FROM f)
 SELECT patient_id, night, count(*) AS samples, {r('avg(value)', 1)} AS spo2_mean, CAST(min(value) AS DOUBLE) AS spo2_min, {r('100 * avg(CAST(value < 90 AS INT))', 1)} AS t90_pct, {r('count(*) FILTER (begins) / (count(*) / 60)', 1)} AS odi_per_hour, bool_or(is_synthetic) AS is_synthetic FROM e GROUP BY 1, 2""",
    "v_hrv_nightly": f"""WITH b AS (SELECT patient_id, device_id, time, value, value - lag(value) OVER (PARTITION BY device_id ORDER BY time, value) AS diff, lag(time) OVER (PARTITION BY device_id ORDER BY time, value) AS before FROM wearable JOIN device USING (device_id) WHERE metric = 'ibi_ms' AND hour(time) < 5 AND NOT is_live)
 SELECT patient_id, CAST(time - INTERVAL 12 HOUR AS DATE) AS night, {r('sqrt(avg(diff * diff))', 1)} AS rmssd_ms, count(*) AS beats FROM b WHERE epoch_us(time) - epoch_us(before) < 86400000000 AND abs(diff) < 200 GROUP BY 1, 2 HAVING count(*) >= 1""",
    "v_consistency": f"SELECT w.patient_id, gmi, hba1c, {r('abs(hba1c - gmi)', 2)} AS gap, CASE WHEN {r('abs(hba1c - gmi)', 2)} <= 0.5 THEN 'ok' WHEN {r('abs(hba1c - gmi)', 2)} <= 1.0 THEN 'warn' ELSE 'inconsistent' END AS status FROM ({CGM_WINDOW}) w LEFT JOIN ({BASELINE}) b ON b.patient_id = w.patient_id",
    "v_sensor_window": "SELECT patient_id, min(time) AS first_at, max(time) AS last_at, count(*) AS n FROM (SELECT device_id, time FROM glucose UNION ALL SELECT device_id, time FROM wearable) JOIN device USING (device_id) WHERE NOT is_live AND NOT is_synthetic GROUP BY 1",
    "v_replay_stream": "SELECT patient_id, time, 'glucose' AS kind, 'mg_dl=' || CAST(mg_dl AS BIGINT) AS payload FROM glucose JOIN device USING (device_id) WHERE NOT is_live UNION ALL SELECT patient_id, time, 'activity', metric || '=' || CAST(value AS BIGINT) FROM wearable JOIN device USING (device_id) WHERE NOT is_live UNION ALL SELECT patient_id, start_time, 'sleep', 'stage=' || stage FROM sleep JOIN device USING (device_id) WHERE NOT is_live",
    "v_twin_latest": """SELECT DISTINCT ON (patient_id, metric) patient_id, metric, time, value, is_live FROM (SELECT patient_id, 'glucose' AS metric, time, CAST(mg_dl AS DOUBLE) AS value, true AS is_live FROM glucose JOIN device USING (device_id) WHERE is_live
 UNION ALL SELECT patient_id, 'glucose', time, mg_dl, false FROM fused WHERE time <= TIMESTAMP '2024-03-09 04:00:00' UNION ALL SELECT patient_id, metric, time, CAST(value AS DOUBLE), is_live FROM wearable JOIN device USING (device_id) WHERE metric <> 'ibi_ms' AND (is_live OR time <= TIMESTAMP '2024-03-09 04:00:00')) ORDER BY patient_id, metric, is_live DESC, time DESC, value DESC""",
    "v_patient_split": f"SELECT patient_id, {_SPLIT} AS split FROM patient",
    "v_patient_static": f"""SELECT p.patient_id, p.sex, {_SPLIT.replace('patient_id', 'p.patient_id')} AS split, bmi, hba1c, ldl, egfr, cohort, coalesce(n_active, 0) AS n_active, first_start, coalesce(n_visits, 0) AS n_visits, last_visit, cgm_days FROM patient p
 LEFT JOIN ({BASELINE}) b ON b.patient_id = p.patient_id LEFT JOIN (SELECT patient_id, count(DISTINCT medication_id) FILTER (ended_at IS NULL) AS n_active, min(started_at) AS first_start FROM regimen GROUP BY 1) m ON m.patient_id = p.patient_id
 LEFT JOIN (SELECT patient_id, count(*) AS n_visits, max(started_at) AS last_visit FROM encounter GROUP BY 1) v ON v.patient_id = p.patient_id LEFT JOIN (SELECT patient_id, count(*) FILTER (coverage >= 10) AS cgm_days FROM ({CGM_DAILY}) GROUP BY 1) c ON c.patient_id = p.patient_id""",
    "v_patient_day": f"""WITH cg AS ({CGM_DAILY}), ac AS ({ACTIVITY}), sl AS ({SLEEP}), dd AS (SELECT patient_id, day FROM cg UNION SELECT patient_id, day FROM ac)
 SELECT dd.patient_id, dd.day, cg.mean AS glucose_mean, cg.coverage, ac.steps, ac.hr_mean, sl.asleep_min, sl.efficiency, (SELECT count(DISTINCT medication_id) FROM regimen g WHERE g.patient_id = dd.patient_id AND CAST(g.started_at AS DATE) <= dd.day AND (g.ended_at IS NULL OR CAST(g.ended_at AS DATE) >= dd.day)) AS n_active, {_SPLIT.replace('patient_id', 'dd.patient_id')} AS split
 FROM dd LEFT JOIN cg ON cg.patient_id = dd.patient_id AND cg.day = dd.day LEFT JOIN ac ON ac.patient_id = dd.patient_id AND ac.day = dd.day LEFT JOIN sl ON sl.patient_id = dd.patient_id AND sl.night + 1 = dd.day""",
    "v_series_5min": """WITH wb AS (SELECT patient_id, time_bucket(INTERVAL 5 MINUTE, time) AS time, CAST(sum(value) FILTER (metric = 'steps') AS DOUBLE) AS steps, avg(value) FILTER (metric = 'heart_rate') AS heart_rate, CAST(sum(value) FILTER (metric = 'mets') AS DOUBLE) AS met_minutes, avg(value) FILTER (metric = 'spo2') AS spo2 FROM wearable JOIN device USING (device_id) WHERE NOT is_live AND metric <> 'ibi_ms' GROUP BY 1, 2)
 SELECT f.patient_id, f.time, f.mg_dl, f.censored, steps, heart_rate, met_minutes, spo2, (SELECT arg_min(stage, start_time) FROM sleep s JOIN device d ON d.device_id = s.device_id WHERE d.patient_id = f.patient_id AND NOT d.is_live AND f.time >= s.start_time AND f.time < s.end_time) AS stage FROM grid f LEFT JOIN wb ON wb.patient_id = f.patient_id AND wb.time = f.time""",
    "a_labels": LABELS,
    "a_split_chrono": """SELECT patient_id, time, segment FROM (SELECT patient_id, time, CASE WHEN s + 3600 <= a + 0.60 * (b - a) THEN 'train' WHEN s > a + 0.60 * (b - a) AND s + 3600 <= a + 0.75 * (b - a) THEN 'validation' WHEN s > a + 0.75 * (b - a) THEN 'test' END AS segment
 FROM (SELECT patient_id, time, s, min(s) OVER (PARTITION BY patient_id) AS a, max(s) OVER (PARTITION BY patient_id) AS b FROM (SELECT patient_id, time, epoch_us(time) / 1000000 AS s FROM fused))) WHERE segment IS NOT NULL""",
    "a_metrics": f"SELECT patient_id, count(*) AS n, {r('sqrt(avg(pow(predicted - actual, 2)))', 3)} AS rmse, {r('avg(abs(predicted - actual))', 3)} AS mae, {r('100 * avg(abs(predicted - actual) / actual)', 2)} AS mard_pct, {signed('avg(predicted - actual)', 3)} AS bias, {signed('(1 - avg(pow(predicted - actual, 2)) / nullif(var_pop(actual), 0))', 3)} AS r2 FROM ({PAIRS}) GROUP BY 1",
    "a_clarke": f"SELECT {_ZONE} AS zone, count(*) AS n FROM ({PAIRS}) GROUP BY 1",
    "a_conformal": f"WITH p AS (SELECT patient_id, actual - predicted AS d FROM ({PAIRS})), q AS (SELECT patient_id, round(quantile_cont(d, 0.1), 9) AS lo, round(quantile_cont(d, 0.9), 9) AS hi FROM p GROUP BY 1) SELECT p.patient_id, count(*) AS n, {signed('any_value(lo)', 3)} AS low, {signed('any_value(hi)', 3)} AS high, {r('100 * avg(CAST(d >= lo AND d <= hi AS INT))', 1)} AS coverage FROM p JOIN q ON p.patient_id = q.patient_id GROUP BY 1",
    "a_regimen_episodes": "SELECT patient_id, medication_id, min(started_at) AS started_at, (list(struct_pack(e := ended_at) ORDER BY started_at DESC, l_orderkey DESC, l_linenumber DESC, ended_at DESC NULLS LAST))[1].e AS ended_at, count(*) AS orders FROM regimen GROUP BY 1, 2",
    "a_warnings": f"""WITH p AS ({POINTS}), q AS (SELECT *, coalesce(lag(glucose) OVER (PARTITION BY id ORDER BY horizon), now) AS pv, coalesce(lag(horizon) OVER (PARTITION BY id ORDER BY horizon), 0) AS pt FROM p),
 k AS (SELECT id, horizon, CASE WHEN glucose < 54 THEN 'very_low' ELSE 'very_high' END AS kind, 0 AS severity FROM q WHERE glucose < 54 OR glucose > 250 UNION ALL SELECT id, horizon, CASE WHEN glucose < 70 THEN 'low' ELSE 'high' END, 1 FROM q WHERE (glucose >= 54 AND glucose < 70) OR (glucose > 180 AND glucose <= 250)
 UNION ALL SELECT id, horizon, 'possible_high', 2 FROM q WHERE glucose BETWEEN 70 AND 180 AND high > 180 UNION ALL SELECT id, horizon, 'possible_low', 2 FROM q WHERE glucose BETWEEN 70 AND 180 AND low < 70 UNION ALL SELECT id, horizon, 'spike', 1 FROM q WHERE glucose - now >= 50 OR (glucose - pv) / (horizon - pt) >= 2.0)
 SELECT id, kind, CAST(min(severity) AS INTEGER) AS severity, CAST(min(horizon) AS INTEGER) AS horizon FROM k GROUP BY 1, 2""",
    "op_win_rolling": f"SELECT device_id, time, CASE WHEN count(mg_dl) OVER w >= 6 THEN {r('avg(mg_dl) OVER w', 3)} END AS mean FROM glucose WINDOW w AS (PARTITION BY device_id ORDER BY time ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)",
    "op_win_runs": "SELECT device_id, CAST(run AS BIGINT) AS run, min(time) AS first_at, max(time) AS last_at, count(*) AS n FROM (SELECT device_id, time, sum(fresh) OVER (PARTITION BY device_id ORDER BY time) AS run FROM (SELECT device_id, time, CASE WHEN time > lag(time) OVER (PARTITION BY device_id ORDER BY time) + INTERVAL 5 MINUTE THEN 1 ELSE 0 END AS fresh FROM glucose)) GROUP BY 1, 2",
    "op_win_slope": """SELECT device_id, time, CASE WHEN rate < -2 THEN 'falling_fast' WHEN rate < -1 THEN 'falling' WHEN rate < 1 THEN 'steady' WHEN rate < 2 THEN 'rising' WHEN rate IS NOT NULL THEN 'rising_fast' END AS trend FROM (SELECT device_id, time, CASE WHEN count(*) OVER w >= 3 AND m - min(m) OVER w >= 10 THEN (count(*) OVER w * sum(m * mg_dl) OVER w - sum(m) OVER w * sum(mg_dl) OVER w) / nullif(count(*) OVER w * sum(m * m) OVER w - sum(m) OVER w * sum(m) OVER w, 0) END AS rate
 FROM (SELECT device_id, time, mg_dl, epoch_us(time) / 60000000 - 28500000 AS m FROM glucose) WINDOW w AS (PARTITION BY device_id ORDER BY time RANGE BETWEEN INTERVAL 15 MINUTE PRECEDING AND CURRENT ROW))""",
    "op_join_prefix": CLASS,
    "op_join_asof": "SELECT w.device_id, w.time AS at, CAST(w.value AS DOUBLE) AS hr, arg_min(mg_dl, abs(epoch_us(w.time) - epoch_us(g.time)) * 10 + CASE WHEN g.time > w.time THEN 1 ELSE 0 END) AS mg_dl FROM wearable w JOIN native g ON g.device_id = w.device_id AND abs(epoch_us(w.time) - epoch_us(g.time)) <= 7200000000 WHERE metric = 'heart_rate' GROUP BY 1, 2, 3",
    "op_page": "SELECT encounter_id, started_at FROM encounter ORDER BY started_at DESC, encounter_id LIMIT 50 OFFSET 100",
    "op_union_distinct": "SELECT device_id, CAST(time AS DATE) AS day FROM glucose UNION SELECT device_id, CAST(time AS DATE) FROM wearable",
    "s_dedup": "SELECT DISTINCT ON (device_id, metric, time) device_id, metric, time, CAST(value AS DOUBLE) AS value, ordinal FROM (SELECT user_id AS device_id, event_type AS metric, date_trunc('hour', ts) AS time, value, event_id AS ordinal FROM events) e WHERE NOT EXISTS (SELECT 1 FROM events x WHERE x.event_id % 11 = 0 AND x.user_id = e.device_id AND x.event_type = e.metric AND date_trunc('hour', x.ts) = e.time) ORDER BY device_id, metric, time, ordinal",
}
