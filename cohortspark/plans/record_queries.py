"""Queries of the patient record, each beside its SQL."""

from __future__ import annotations

from collections.abc import Callable

from cohortspark.functions import measures as M
from cohortspark.operators import record as R
from cohortspark.plans.oracles import r
from cohortspark.sources import proxy

PLANS: dict[str, Callable] = {
    "r_visits": R.visits,
    "r_visits_page": lambda t: R.visits_page(t, None, "ambulatory", 3, 3),
    "r_medications": lambda t: R.medication_order(R.medications(t["medicine"])),
    "r_medication_list": lambda t: R.medication_list(R.medications(t["medicine"]), lowering=True),
    "r_medication_detail": R.dose_changes,
    "r_conditions": lambda t: R.conditions(t["diagnosis"]),
    "r_condition_list": lambda t: R.condition_list(R.conditions(t["diagnosis"]), kind="diagnosis"),
    "r_condition_detail": R.condition_detail,
    "r_results": R.results,
    "r_measure_summary": R.measure_summary,
    "r_tests": lambda t: R.tests_by_panel(t, True),
    "r_measure_detail": R.measure_detail,
    "r_visit_detail": R.visit_detail,
    "r_overview": lambda t: R.overview(proxy.with_lines(t)),
    "r_measures_dim": lambda t: R.measures_dim(t["patient"].sparkSession),
}

_MEASURE = "CASE WHEN analyte IN ('weight', 'height') THEN 'body' ELSE analyte END"
VISITS = f"""SELECT *, tests + diagnoses + medications > 0 AS has_records FROM (SELECT encounter_id, patient_id, class, started_at, ended_at, {r('(epoch_us(ended_at) - epoch_us(started_at)) / 3600000000', 1)} AS duration_h,
 (SELECT count(DISTINCT {_MEASURE}) FROM result x WHERE x.encounter_id = e.encounter_id) AS tests, (SELECT count(*) FROM diagnosis x WHERE x.encounter_id = e.encounter_id) AS diagnoses, (SELECT count(*) FROM medicine x WHERE x.encounter_id = e.encounter_id) AS medications FROM encounter e)"""
MEDS = """SELECT patient_id, ingredient_id, c.product_id, lowering, active, c.started_at, c.ended_at, first_started_at, episodes, single_day, is_synthetic FROM (SELECT patient_id, ingredient_id, (list(struct_pack(product_id, started_at, ended_at) ORDER BY ended_at IS NULL DESC, started_at DESC, regimen_id DESC, product_id DESC, ended_at DESC NULLS LAST))[1] AS c,
 bool_or(ended_at IS NULL) AS active, bool_or(lowering) AS lowering, min(started_at) AS first_started_at, count(*) AS episodes, bool_and(ended_at IS NOT NULL AND epoch_us(ended_at) - epoch_us(started_at) < 86400000000) AS single_day, bool_and(is_synthetic) AS is_synthetic FROM medicine GROUP BY 1, 2)"""
CONDS = """SELECT *, greatest(onset_at, coalesce(abated_at, onset_at)) AS last_change FROM (SELECT DISTINCT ON (patient_id, concept_id) patient_id, concept_id, kind, bool_or(abated_at IS NULL) OVER w AS active, count(*) OVER w AS episodes, min(onset_at) OVER w AS first_onset, onset_at, abated_at, abated_at IS NULL AS latest_active,
 bool_and(is_synthetic) OVER w AS is_synthetic FROM diagnosis WINDOW w AS (PARTITION BY patient_id, concept_id) ORDER BY patient_id, concept_id, onset_at DESC, episode_id DESC, abated_at DESC NULLS LAST, kind DESC)"""
_RANGES = ", ".join("(" + ", ".join("NULL" if x is None else repr(x) for x in row) + ")" for row in M.RANGES)
RESULTS = f"""SELECT patient_id, measure, taken_at, n_values, value, text, encounter_id, is_synthetic, CASE WHEN bad LIKE '%high%' THEN 'high' WHEN bad LIKE '%low%' THEN 'low' WHEN bad LIKE '%normal%' THEN 'normal' END AS flag FROM (
 SELECT g.patient_id, measure, taken_at, count(g.value) AS n_values, arg_min(g.value, g.analyte) FILTER (g.value IS NOT NULL) AS value, (SELECT (list(value_text ORDER BY ordinal + CASE WHEN is_synthetic THEN 1e12 ELSE 0 END, value_text))[1] FROM result x WHERE x.patient_id = g.patient_id AND ({_MEASURE}) = measure AND x.effective_at = taken_at AND x.value_text IS NOT NULL) AS text,
 (list(struct_pack(e := first_e) ORDER BY first_o))[1].e AS encounter_id, min(first_o) >= 1e12 AS is_synthetic, string_agg(CASE WHEN low IS NULL AND high IS NULL OR g.value IS NULL THEN NULL WHEN g.value < low THEN 'low' WHEN g.value > high THEN 'high' ELSE 'normal' END, ',') AS bad
 FROM (SELECT patient_id, {_MEASURE} AS measure, effective_at AS taken_at, analyte, (list(value ORDER BY o, value) FILTER (value IS NOT NULL))[1] AS value, min(o) AS first_o, (list(struct_pack(e := encounter_id) ORDER BY o))[1].e AS first_e FROM (SELECT *, ordinal + CASE WHEN is_synthetic THEN 1e12 ELSE 0 END AS o FROM result) GROUP BY 1, 2, 3, 4) g
 JOIN patient p ON p.patient_id = g.patient_id LEFT JOIN (SELECT * FROM (VALUES {_RANGES}) v(a, s, low, high)) v ON v.a = g.analyte AND (v.s IS NULL OR v.s = p.sex) GROUP BY g.patient_id, measure, taken_at)"""
SUMMARY = f"""SELECT patient_id, measure, count(*) AS count, count(*) FILTER (flag IN ('high', 'low')) AS out_of_range, max(taken_at) AS latest_at, max(value) FILTER (rn = 1) AS latest, max(flag) FILTER (rn = 1) AS latest_flag, max(taken_at) FILTER (rn = 2) AS previous_at, max(value) FILTER (rn = 2) AS previous,
 coalesce(array_to_string(list_transform((list(value ORDER BY taken_at) FILTER (value IS NOT NULL))[-12:], lambda v: CAST(CAST(v AS DECIMAL(18, 2)) AS VARCHAR)), ','), '') AS spark, bool_and(is_synthetic) AS is_synthetic FROM (SELECT *, row_number() OVER (PARTITION BY patient_id, measure ORDER BY taken_at DESC) AS rn FROM ({RESULTS})) GROUP BY 1, 2"""
_PANEL = "CASE measure WHEN 'hba1c' THEN 'glycaemia' WHEN 'glucose_fasting' THEN 'glycaemia' WHEN 'insulin' THEN 'glycaemia' WHEN 'cholesterol_total' THEN 'lipids' WHEN 'hdl' THEN 'lipids' WHEN 'triglycerides' THEN 'lipids' WHEN 'creatinine' THEN 'kidney' WHEN 'body' THEN 'body' END"


def _ended(table: str, at: str) -> str:
    return f"(SELECT count(*) FROM {table} x WHERE x.patient_id = v.patient_id AND x.{at} BETWEEN v.started_at AND greatest(coalesce(v.ended_at, v.started_at), v.started_at + INTERVAL 1 MINUTE) AND x.encounter_id IS DISTINCT FROM v.encounter_id)"


SQL: dict[str, str] = {
    "r_visits": VISITS,
    "r_visits_page": f"SELECT patient_id, encounter_id, CAST(rn AS INTEGER) AS rn, total, CASE WHEN total > 6 THEN 6 END AS next_cursor FROM (SELECT *, row_number() OVER (PARTITION BY patient_id ORDER BY started_at DESC, encounter_id) AS rn, count(*) OVER (PARTITION BY patient_id) AS total FROM ({VISITS}) WHERE class = 'ambulatory') WHERE rn BETWEEN 4 AND 6",
    "r_medications": f"SELECT *, CAST(row_number() OVER (PARTITION BY patient_id ORDER BY active DESC, lowering DESC, started_at DESC, ingredient_id) AS INTEGER) AS place FROM ({MEDS})",
    "r_medication_list": f"SELECT patient_id, count(*) AS total, count(*) FILTER (active) AS active, count(*) FILTER (NOT single_day) AS items, count(*) FILTER (single_day) AS single_day FROM ({MEDS}) WHERE lowering GROUP BY 1",
    "r_medication_detail": """SELECT patient_id, ingredient_id, regimen_id, started_at AS at, p AS from_product, product_id AS to_product, d AS from_dose, dose AS to_dose FROM (SELECT *, lag(product_id) OVER w AS p, lag(dose) OVER w AS d, lag(per_day) OVER w AS q FROM medicine WINDOW w AS (PARTITION BY patient_id, ingredient_id ORDER BY started_at, regimen_id, product_id, dose, per_day))
 WHERE p IS NOT NULL AND (p <> product_id OR d <> dose OR q <> per_day)""",
    "r_conditions": CONDS,
    "r_condition_list": f"SELECT patient_id, count(*) AS total, count(*) FILTER (active) AS active FROM ({CONDS}) WHERE kind = 'diagnosis' GROUP BY 1",
    "r_condition_detail": "SELECT patient_id, concept_id, episode_id, onset_at, abated_at, CAST(floor((epoch_us(abated_at) - epoch_us(onset_at)) / 86400000000) AS BIGINT) AS duration_days, (SELECT count(DISTINCT ingredient_id) FROM medicine m WHERE m.encounter_id = d.encounter_id) AS related_medications FROM diagnosis d",
    "r_results": RESULTS,
    "r_measure_summary": SUMMARY,
    "r_tests": f"SELECT patient_id, {_PANEL} AS panel, count(*) AS measures, CAST(sum(count) AS BIGINT) AS results FROM ({SUMMARY}) WHERE latest_flag IN ('high', 'low') GROUP BY 1, 2",
    "r_measure_detail": f"SELECT patient_id, measure, count(*) AS n, min(value) AS low, max(value) AS high, {r('avg(value) + 1e-9', 2)} AS mean, min(taken_at) AS first_at, max(taken_at) AS latest_at FROM ({RESULTS}) WHERE value IS NOT NULL GROUP BY 1, 2",
    "r_visit_detail": f"""SELECT patient_id, encounter_id, tests, diagnoses, medications, {_ended('diagnosis', 'abated_at')} AS resolved, {_ended('medicine', 'ended_at')} AS stopped,
 last_value(CASE WHEN has_records THEN encounter_id END IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous, first_value(CASE WHEN has_records THEN encounter_id END IGNORE NULLS) OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next FROM ({VISITS}) v WINDOW w AS (PARTITION BY patient_id ORDER BY started_at, encounter_id DESC)""",
    "r_overview": f"""SELECT p.patient_id, coalesce(medications_active, 0) AS medications_active, coalesce(lowering_active, 0) AS lowering_active, coalesce(diagnoses_active, 0) AS diagnoses_active, coalesce(findings, 0) AS findings, coalesce(tests, 0) AS tests, coalesce(out_of_range, 0) AS out_of_range, coalesce(visits, 0) AS visits, coalesce(with_records, 0) AS with_records, hba1c, cholesterol_total, creatinine, last_visit
 FROM patient p LEFT JOIN (SELECT patient_id, count(*) FILTER (active) AS medications_active, count(*) FILTER (active AND lowering) AS lowering_active FROM ({MEDS}) WHERE NOT single_day GROUP BY 1) a USING (patient_id) LEFT JOIN (SELECT patient_id, count(*) FILTER (active AND kind = 'diagnosis') AS diagnoses_active, count(*) FILTER (kind = 'finding') AS findings FROM ({CONDS}) GROUP BY 1) b USING (patient_id)
 LEFT JOIN (SELECT patient_id, count(*) AS tests, count(*) FILTER (latest_flag IN ('high', 'low')) AS out_of_range, max(latest) FILTER (measure = 'hba1c') AS hba1c, max(latest) FILTER (measure = 'cholesterol_total') AS cholesterol_total, max(latest) FILTER (measure = 'creatinine') AS creatinine FROM ({SUMMARY}) GROUP BY 1) c USING (patient_id)
 LEFT JOIN (SELECT patient_id, count(*) AS visits, count(*) FILTER (has_records) AS with_records, max(started_at) AS last_visit FROM ({VISITS}) GROUP BY 1) d USING (patient_id)""",
    "r_measures_dim": "SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}', {c}, {d})" for a, b, c, d in R.panels()) + ") v(panel, measure, panel_place, place)",
}
