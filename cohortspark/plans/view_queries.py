"""Queries of the joined views in full, each beside its SQL; they stand for the shorter ones of the same name."""

from __future__ import annotations

from collections.abc import Callable

from cohortspark.operators import features as V
from cohortspark.operators import report
from cohortspark.plans.oracles import _SPLIT, ACTIVITY, BASELINE, CGM_DAILY, CGM_WINDOW, NAMES, SLEEP, SQL as BASE, age, r
from cohortspark.plans.oracles import signed as sg
from cohortspark.sources import proxy

AS_OF, NOW = "2026-01-01", "2024-03-09 04:00:00"
#: Beats of the event stream are hours apart, so the filters are set to where they decide rows: some gaps and differences pass, some nights have enough beats.
GAP_S, BEATS = 1_500_000.0, 2
FIVE_GAP_S, FIVE_BEATS = 400_000.0, 1

PLANS: dict[str, Callable] = {
    "v_patient_summary": lambda t: V.patient_summary(t, AS_OF),
    "v_medication_regimen": V.medication_regimen,
    "v_condition_episode": V.condition_episode,
    "v_condition_episode_ungrouped": lambda t: V.condition_episode(t, False),
    "v_observation_result": V.observation_result,
    "v_visit": V.visit,
    "v_hrv_nightly": lambda t: V.hrv_nightly(t, GAP_S, BEATS),
    "v_cgm_window": V.cgm_window,
    "v_replay_stream": V.replay_stream,
    "v_twin_latest": lambda t: V.live_latest(t, NOW),
    "v_patient_static": lambda t: V.patient_static(proxy.with_lines(t), AS_OF, 10.0, 5, 2, GAP_S, BEATS),
    "v_patient_day": lambda t: V.patient_day(t, GAP_S, BEATS),
    "v_series_5min": lambda t: V.series_5min(t, FIVE_GAP_S, FIVE_BEATS),
    "op_agg_array": lambda t: V.running(V.medication_regimen(t).select("patient_id", V.F.col("drug_class").alias("what"), "started_at", "ended_at"), t["encounter"].select("patient_id", V.F.to_date("started_at").alias("day")).distinct()).groupBy("patient_id", "day").agg(V.F.array_join(V.F.sort_array(V.F.collect_set("what")), ",").alias("classes")),
}

SUMMARY = f"""SELECT p.patient_id, coalesce(nullif(concat_ws(' ', given_name, family_name), ''), code || ' ' || source_subject_id) AS display_name, given_name, family_name, sex, birth_date, {age('birth_date', f"DATE '{AS_OF}'")} AS age, race, code AS source, source_subject_id, coalesce(tags, '') AS tags
 FROM person p JOIN patient q ON q.patient_id = p.patient_id JOIN source s ON s.source_id = p.source_id LEFT JOIN (SELECT patient_id, string_agg(DISTINCT tag, ',' ORDER BY tag) AS tags FROM patient_tag GROUP BY 1) g ON g.patient_id = p.patient_id"""
REGIMEN = "SELECT m.patient_id, regimen_id, m.ingredient_id, drug_name AS medication, product_id, c.display AS product, class_code AS drug_class, coalesce(class_lowers, false) AS glucose_lowering, started_at, ended_at, ended_at IS NULL AS active, dose, per_day, encounter_id, is_synthetic FROM medicine m JOIN drug d ON d.ingredient_id = m.ingredient_id LEFT JOIN concept c ON c.concept_id = m.product_id"
_STRIP = r"regexp_replace({}, '\s*\([^()]*\)$', '')"
EPISODE = f"SELECT patient_id, episode_id, d.concept_id, {_STRIP.format('g.display')} AS display, CASE WHEN grp IS NOT NULL OR suffix_disorder OR untagged THEN 'diagnosis' ELSE 'finding' END AS kind, grp AS condition_group, onset_at, abated_at, abated_at IS NULL AS active, encounter_id, is_synthetic FROM diagnosis d LEFT JOIN (SELECT *, display LIKE '%(disorder)' AS suffix_disorder, display NOT LIKE '%)' AS untagged FROM condition_group) g ON g.concept_id = d.concept_id"
_BEATS = "SELECT device_id, patient_id, time, value - lag(value) OVER w AS diff, (epoch_us(time) - epoch_us(lag(time) OVER w)) / 1000000 AS gap FROM wearable JOIN device USING (device_id) WHERE metric = 'ibi_ms' AND NOT is_live {} WINDOW w AS (PARTITION BY device_id ORDER BY time, value)"
_NIGHT = "CAST(time - INTERVAL 12 HOUR AS DATE)"
HRV = f"""SELECT patient_id, {_NIGHT} AS night, {r('sqrt(avg(diff * diff))', 1)} AS rmssd_ms, count(*) AS beats, false AS is_synthetic FROM ({_BEATS.format('AND hour(time) < 5')}) WHERE gap < {GAP_S} AND abs(diff) < 200 GROUP BY 1, 2 HAVING count(*) >= {BEATS}
 UNION ALL SELECT patient_id, {_NIGHT}, {r('avg(value)', 1)}, NULL, true FROM wearable JOIN device USING (device_id) WHERE metric = 'hrv_rmssd' AND NOT is_live GROUP BY 1, 2"""
_WORN = "SELECT patient_id, time, metric, CAST(CAST(value AS BIGINT) AS VARCHAR) AS v FROM wearable JOIN device USING (device_id) WHERE NOT is_live"
REPLAY = f"""SELECT patient_id, time, 'glucose' AS kind, '{{"glucose_mg_dl":' || mg_dl || '}}' AS payload FROM glucose JOIN device USING (device_id) WHERE NOT is_live
 UNION ALL SELECT patient_id, time, 'activity', '{{' || string_agg('"' || metric || '":' || v, ',' ORDER BY metric, CAST(v AS BIGINT)) || '}}' FROM ({_WORN}) GROUP BY 1, 2
 UNION ALL SELECT patient_id, start_time, 'sleep', '{{"stage":"' || stage || '","until":"' || strftime(end_time, '%Y-%m-%d %H:%M:%S') || '","synthetic":' || is_synthetic || '}}' FROM sleep JOIN device USING (device_id) WHERE NOT is_live
 UNION ALL SELECT patient_id, time, 'glucose_fused', '{{"glucose_mg_dl":' || CAST(trunc(mg_dl) AS BIGINT) || ',"censored":' || censored || '}}' FROM fused
 UNION ALL SELECT patient_id, time, 'medication', '{{' || coalesce('"drug_class":"' || class_code || '",', '') || '"dose":' || CAST(dose_value AS BIGINT) || ',"unit":"U"}}' FROM dose"""
LATEST = f"""SELECT DISTINCT ON (patient_id, metric) * FROM (SELECT patient_id, 'glucose' AS metric, time, CAST(mg_dl AS DOUBLE) AS value, NULL::VARCHAR AS text, true AS is_live FROM glucose JOIN device USING (device_id) WHERE is_live UNION ALL SELECT patient_id, 'glucose', time, mg_dl, NULL, false FROM fused WHERE time <= TIMESTAMP '{NOW}'
 UNION ALL SELECT patient_id, metric, time, CAST(value AS DOUBLE), NULL, is_live FROM wearable JOIN device USING (device_id) WHERE metric NOT IN ('ibi_ms', 'wear_minutes') AND (is_live OR time <= TIMESTAMP '{NOW}') UNION ALL SELECT patient_id, 'sleep', start_time, NULL, stage, is_live FROM sleep JOIN device USING (device_id) WHERE is_live OR start_time <= TIMESTAMP '{NOW}')
 ORDER BY patient_id, metric, is_live DESC, time DESC, value DESC NULLS LAST, text DESC NULLS LAST"""
_MADE = "SELECT patient_id, CAST(start_time - INTERVAL 12 HOUR AS DATE) AS night, bool_and(is_synthetic) AS sleep_made FROM sleep JOIN device USING (device_id) WHERE NOT is_live GROUP BY 1, 2"
_BASE_COLUMNS = ", ".join([*NAMES.values(), "bmi", "bmi_is_synthetic", "non_hdl", "tc_hdl_ratio", "vldl", "ldl", "ldl_is_synthetic", "homa_ir", "homa_ir_is_synthetic", "egfr", "egfr_is_synthetic", "b.cohort"])
_HAS = ", ".join(f"bool_or(condition_group = '{g}') AS has_{g}" for g in V.GROUPS)
_ON = ", ".join([f"bool_or(coalesce(drug_class IN ({', '.join(repr(x) for x in c)}), false)) AS on_{n}" for n, c in V.DRUGS.items()] + ["bool_or(coalesce(drug_class LIKE 'insulin%', false)) AS on_insulin"])
_FLAGS = ", ".join([f"coalesce(has_{g}, false) AS has_{g}" for g in V.GROUPS] + [f"coalesce(on_{n}, false) AS on_{n}" for n in (*V.DRUGS, "insulin")])
STATIC = f"""WITH ep AS ({EPISODE}), per AS (SELECT patient_id, condition_group, min(onset_at) AS onset_at, bool_and(is_synthetic) AS made FROM ep WHERE condition_group IS NOT NULL GROUP BY 1, 2), cond AS (SELECT patient_id, {_HAS}, min(onset_at) FILTER (condition_group = 't2d') AS t2d_onset, bool_or(made) AS c_made FROM per GROUP BY 1),
 meds AS (SELECT patient_id, {_ON}, count(DISTINCT drug_class) FILTER (glucose_lowering) AS n_classes, bool_or(is_synthetic) AS m_made FROM ({REGIMEN}) WHERE active GROUP BY 1), act AS (SELECT patient_id, count(*) FILTER (wear_minutes >= 5) AS valid_step_days, {r('avg(steps) FILTER (wear_minutes >= 5)')} AS steps_per_valid_day, count(*) FILTER (hr_minutes >= 2) AS hr_days FROM ({ACTIVITY}) GROUP BY 1),
 cgm AS (SELECT patient_id, count(*) AS cgm_days FROM ({CGM_DAILY}) WHERE coverage >= 10 GROUP BY 1), nights AS (SELECT patient_id, count(*) AS sleep_nights, bool_and(sleep_made) AS sleep_synthetic FROM ({_MADE}) GROUP BY 1), hrv AS (SELECT patient_id, count(*) FILTER (NOT is_synthetic) AS real_hrv_nights FROM ({HRV}) GROUP BY 1)
 SELECT s.patient_id, s.source, {_SPLIT.replace('patient_id', 's.patient_id')} AS split, s.sex, s.age, s.race, NOT list_contains(string_split(s.tags, ','), 'gmi-warn') AS diabetes_diagnosed, {sg('((epoch_us(b.effective_at) - epoch_us(t2d_onset)) / 1000000 / 31557600)', 1)} AS diabetes_duration_years, {_BASE_COLUMNS}, {_FLAGS}, coalesce(n_classes, 0) AS n_glucose_lowering_classes,
 coalesce(cgm_days, 0) AS cgm_days, coalesce(valid_step_days, 0) AS valid_step_days, steps_per_valid_day, coalesce(hr_days, 0) AS hr_days, coalesce(sleep_nights, 0) AS sleep_nights, sleep_synthetic, coalesce(real_hrv_nights, 0) AS real_hrv_nights, coalesce(c_made, false) OR coalesce(m_made, false) OR synthetic_analytes <> '' AS has_synthetic_values
 FROM ({SUMMARY}) s LEFT JOIN ({BASELINE}) b ON b.patient_id = s.patient_id LEFT JOIN cond ON cond.patient_id = s.patient_id LEFT JOIN meds ON meds.patient_id = s.patient_id LEFT JOIN act ON act.patient_id = s.patient_id LEFT JOIN cgm ON cgm.patient_id = s.patient_id LEFT JOIN nights ON nights.patient_id = s.patient_id LEFT JOIN hrv ON hrv.patient_id = s.patient_id"""
_CLASSES = "(SELECT count(DISTINCT drug_class) FROM reg r WHERE r.patient_id = d.patient_id AND r.glucose_lowering AND CAST(r.started_at AS DATE) <= d.day AND (r.ended_at IS NULL OR CAST(r.ended_at AS DATE) >= d.day))"
DAY = f"""WITH reg AS ({REGIMEN}), c AS ({CGM_DAILY}), a AS ({ACTIVITY}), sl AS (SELECT s.*, sleep_made FROM ({SLEEP}) s JOIN ({_MADE}) m ON m.patient_id = s.patient_id AND m.night = s.night), o AS ({BASE['v_spo2_nightly']}), h AS (SELECT DISTINCT ON (patient_id, night) * FROM ({HRV}) ORDER BY patient_id, night, is_synthetic),
 d AS (SELECT patient_id, day FROM c UNION SELECT patient_id, day FROM a) SELECT d.patient_id, d.day, {_SPLIT.replace('patient_id', 'd.patient_id')} AS split, c.coverage AS cgm_coverage_pct, c.mean AS glucose_mean, c.cv AS glucose_cv_pct, {r('3.31 + 0.02392 * c.mean', 2)} AS gmi, c.pct_very_low, c.pct_low, c.pct_target, c.pct_high, c.pct_very_high,
 a.steps, a.wear_minutes, a.hr_mean, a.hr_min, a.hr_max, a.hr_minutes, a.met_minutes, a.active_kcal, a.activity_level_mean, a.spo2_mean, a.respiration_mean, a.stress_mean, a.skin_temp_mean, a.eda_mean, sl.asleep_min, sl.deep_min, sl.rem_min, sl.efficiency, o.spo2_mean AS spo2_sleep_mean, o.spo2_min AS spo2_sleep_min, o.t90_pct, o.odi_per_hour,
 h.rmssd_ms AS hrv_rmssd_prev_night, h.is_synthetic AS hrv_is_synthetic, concat_ws(',', nullif(a.synthetic_metrics, ''), CASE WHEN sleep_made THEN 'sleep' END) AS synthetic_channels, {_CLASSES} AS n_glucose_lowering_classes, (SELECT CAST(sum(dose_value) AS DOUBLE) FROM dose x WHERE x.patient_id = d.patient_id AND x.class_code LIKE 'insulin%' AND x.time >= d.day AND x.time < d.day + INTERVAL 1 DAY) AS insulin_units
 FROM d LEFT JOIN c ON c.patient_id = d.patient_id AND c.day = d.day LEFT JOIN a ON a.patient_id = d.patient_id AND a.day = d.day LEFT JOIN sl ON sl.patient_id = d.patient_id AND sl.night = d.day - 1 LEFT JOIN o ON o.patient_id = d.patient_id AND o.night = sl.night LEFT JOIN h ON h.patient_id = d.patient_id AND h.night = d.day - 1"""


def _avg(n: str) -> str:
    return f"CAST(avg(value) FILTER (metric = '{n}') AS DOUBLE) AS {n}"


SERIES = f"""WITH w AS (SELECT patient_id, time_bucket(INTERVAL 5 MINUTE, time) AS time, CAST(sum(value) FILTER (metric = 'steps') AS DOUBLE) AS steps, {_avg('heart_rate')}, CAST(sum(value) FILTER (metric = 'mets') AS DOUBLE) AS met_minutes, {', '.join(_avg(n) for n in ('activity_level', 'spo2', 'respiration_rate', 'stress', 'skin_temp', 'eda'))}, string_agg(DISTINCT metric, ',' ORDER BY metric) FILTER (is_synthetic) AS made
 FROM wearable JOIN device USING (device_id) WHERE NOT is_live AND metric NOT IN ('wear_minutes', 'ibi_ms', 'hrv_rmssd') GROUP BY 1, 2), h AS (SELECT patient_id, time_bucket(INTERVAL 5 MINUTE, time) AS time, {r('sqrt(avg(diff * diff))', 4)} AS rmssd_5min FROM ({_BEATS.format('')}) WHERE gap < {FIVE_GAP_S} AND abs(diff) < 200 GROUP BY 1, 2 HAVING count(*) >= {FIVE_BEATS}),
 s AS (SELECT patient_id, start_time, end_time, stage, is_synthetic FROM sleep JOIN device USING (device_id) WHERE NOT is_live), x AS (SELECT patient_id, time_bucket(INTERVAL 5 MINUTE, time - to_days(68)) AS time, CAST(sum(dose_value) FILTER (class_code IN ('insulin_rapid', 'insulin_premixed')) AS DOUBLE) AS fast, CAST(sum(dose_value) FILTER (class_code IN ('insulin_long', 'insulin_intermediate')) AS DOUBLE) AS basal,
 count(*) FILTER (class_lowers AND NOT coalesce(class_code LIKE 'insulin%', false)) AS oral FROM dose GROUP BY 1, 2), z AS (SELECT g.patient_id, g.time, (list(stage ORDER BY start_time, end_time, stage))[1] AS stage, bool_or(s.is_synthetic) AS made FROM "grid" g JOIN s ON s.patient_id = g.patient_id AND g.time >= start_time AND g.time < end_time GROUP BY 1, 2)
 SELECT g.patient_id, g.time, g.mg_dl, g.censored, steps, heart_rate, met_minutes, activity_level, spo2, respiration_rate, stress, skin_temp, eda, rmssd_5min, z.stage AS sleep_stage, concat_ws(',', w.made, CASE WHEN z.made THEN 'sleep' END) AS synthetic_channels, coalesce(fast, 0) AS insulin_fast_units, coalesce(basal, 0) AS insulin_basal_units, coalesce(oral, 0) AS oral_doses
 FROM grid g LEFT JOIN w ON w.patient_id = g.patient_id AND w.time = g.time LEFT JOIN h ON h.patient_id = g.patient_id AND h.time = g.time LEFT JOIN z ON z.patient_id = g.patient_id AND z.time = g.time LEFT JOIN x ON x.patient_id = g.patient_id AND x.time = g.time""".replace('"grid"', "grid")

SQL: dict[str, str] = {
    "v_patient_summary": SUMMARY,
    "v_medication_regimen": REGIMEN,
    "v_condition_episode": EPISODE,
    "v_condition_episode_ungrouped": EPISODE.replace("grp IS NOT NULL OR ", "").replace("grp AS condition_group", "NULL::VARCHAR AS condition_group"),
    "v_observation_result": "SELECT patient_id, ordinal, analyte, CASE WHEN analyte IN ('weight', 'height') THEN 'body' ELSE analyte END AS measure, effective_at, value, CASE WHEN value IS NULL THEN value_text END AS value_text, encounter_id, is_synthetic FROM result",
    "v_visit": f"SELECT patient_id, encounter_id, class, {_STRIP.format('t.display')} AS type, {_STRIP.format('x.display')} AS reason, started_at, ended_at, {r('(epoch_us(ended_at) - epoch_us(started_at)) / 3600000000', 4)} AS hours FROM encounter e LEFT JOIN condition_group t ON t.concept_id = e.encounter_id % 45 LEFT JOIN condition_group x ON x.concept_id = e.patient_id % 50",
    "v_hrv_nightly": HRV,
    "v_cgm_window": f"SELECT w.*, 'Maker model ' || (device_id % 3) || CASE WHEN device_id % 2 = 0 THEN ' + Maker model ' || (device_id % 4) ELSE '' END AS glucose_source FROM ({CGM_WINDOW}) w JOIN device USING (patient_id)",
    "v_replay_stream": REPLAY,
    "v_twin_latest": LATEST,
    "v_patient_static": STATIC,
    "v_patient_day": DAY,
    "v_series_5min": SERIES,
    "op_agg_array": f"SELECT e.patient_id, e.day, coalesce(string_agg(DISTINCT drug_class, ',' ORDER BY drug_class), '') AS classes FROM (SELECT DISTINCT patient_id, CAST(started_at AS DATE) AS day FROM encounter) e JOIN ({REGIMEN}) g ON g.patient_id = e.patient_id AND CAST(g.started_at AS DATE) <= e.day AND (g.ended_at IS NULL OR CAST(g.ended_at AS DATE) >= e.day) GROUP BY 1, 2",
}
