"""Queries of the greedy matching, each beside its SQL: a loop over seekers as a recursive table."""

from __future__ import annotations

from collections.abc import Callable

from cohortspark.operators import matching as M
from pyspark.sql import functions as F

_BMI = "CASE WHEN c_custkey % {} <> 0 THEN (180 + CAST(floor((c_acctbal + 1000) / 40) AS INT)) / 10.0 END"
_A1C = "(45 + CAST(floor((c_acctbal + 1000) / 200) AS INT)) / 10.0"


def _people(t):
    c = t["customer"].selectExpr("c_custkey", f"cast({_BMI.format(13)} as double) as bmi13", f"cast({_BMI.format(17)} as double) as bmi17", f"cast({_A1C} as double) as hba1c")
    return t["patient"].join(c, F.col("patient_id") == F.col("c_custkey"))


def _age(on):
    return F.floor(F.date_diff(on, F.col("birth_date")) / 365).cast("int")


def _seekers(t):
    """Subjects of a study: those of the first source."""
    p = _people(t).where("source_id = 0").withColumn("day_1", F.lit("2000-03-09").cast("date"))
    drawn = F.when(F.col("patient_id") % 4 > 0, (F.col("patient_id") % 600 + 400).cast("int"))
    return p.select(F.col("patient_id").alias("subject_id"), "sex", _age(F.col("day_1")).alias("age"), F.col("bmi13").alias("bmi"), "hba1c", "day_1", drawn.alias("drawn_min"))


def _partners(t):
    """Patients of the other sources with their last encounter."""
    last = t["encounter"].groupBy("patient_id").agg(F.to_date(F.max("ended_at")).alias("last_on"))
    p = _people(t).where("source_id <> 0").join(last, "patient_id")
    band = F.when(F.col("patient_id") % 3 == 0, "neither").otherwise("prediabetes")
    return p.select("patient_id", "sex", _age(F.col("last_on")).alias("age"), F.col("bmi17").alias("bmi"), F.when(F.col("patient_id") % 5 > 0, F.col("hba1c")).alias("hba1c"), band.alias("band"), (F.col("patient_id") % 11 == 0).alias("deceased"), "last_on")


def _nearest_supplier(t):
    s = t["supplier"].select("s_suppkey", F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("balance"))
    c = t["customer"].select("c_custkey", F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance"))
    return M.greedy_near(s, c, "s_suppkey", "c_custkey", ["nation"], "balance")


def _patients(t):
    diabetic = _seekers(t).where("hba1c >= 6.5")
    return M.composites(M.match_by_age(diabetic, _partners(t)), _partners(t), diabetic)


PLANS: dict[str, Callable] = {
    "op_match_greedy": _nearest_supplier,
    "a_match_cgm": lambda t: M.match_by_age(_seekers(t), _partners(t)),
    "a_match_bigideas": lambda t: M.match_by_sugar(_seekers(t), _partners(t)),
    "p_match": _patients,
}

_PEOPLE = f"people AS (SELECT p.*, CAST({_BMI.format(13)} AS DOUBLE) AS bmi13, CAST({_BMI.format(17)} AS DOUBLE) AS bmi17, CAST({_A1C} AS DOUBLE) AS hba1c FROM patient p JOIN customer ON c_custkey = patient_id)"
_SEEKERS = "seekers AS (SELECT patient_id AS subject_id, sex, CAST(floor((DATE '2000-03-09' - birth_date) / 365) AS INTEGER) AS age, bmi13 AS bmi, hba1c, CASE WHEN patient_id % 4 > 0 THEN CAST(patient_id % 600 + 400 AS INTEGER) END AS drawn_min FROM people WHERE source_id = 0{})"
_PARTNERS = "partners AS (SELECT p.patient_id, sex, CAST(floor((last_on - birth_date) / 365) AS INTEGER) AS age, bmi17 AS bmi, CASE WHEN p.patient_id % 5 > 0 THEN hba1c END AS hba1c, CASE WHEN p.patient_id % 3 = 0 THEN 'neither' ELSE 'prediabetes' END AS band, p.patient_id % 11 = 0 AS deceased, last_on FROM people p JOIN (SELECT patient_id, CAST(max(ended_at) AS DATE) AS last_on FROM encounter GROUP BY 1) USING (patient_id) WHERE source_id <> 0)"
# One step takes the next seeker's best partner that no earlier step has used.
_LOOP = """o AS MATERIALIZED (SELECT s, row_number() OVER (ORDER BY n, s) AS k FROM (SELECT s, count(*) AS n FROM e GROUP BY s)),
r AS (SELECT CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS used, CAST(NULL AS BIGINT) AS s, CAST(NULL AS BIGINT) AS p
 UNION ALL SELECT k, CASE WHEN b IS NULL THEN used ELSE list_append(used, b.p) END, s, b.p FROM (SELECT o.k, r.used, o.s, min({'a': e.a, 'b': e.b, 'p': e.p}) FILTER (WHERE NOT list_contains(r.used, e.p)) AS b FROM r JOIN o ON o.k = r.k + 1 JOIN e ON e.s = o.s GROUP BY o.k, r.used, o.s))"""
_CGM = "e AS MATERIALIZED (SELECT s.subject_id AS s, p.patient_id AS p, abs(p.bmi - s.bmi) AS a, abs(p.age - s.age) AS b FROM seekers s JOIN partners p ON p.sex = s.sex AND abs(p.age - s.age) <= 5 WHERE NOT deceased AND p.bmi IS NOT NULL AND s.bmi IS NOT NULL)"
_SIGNED = "CASE WHEN {0} < 0 THEN -1 ELSE 1 END * floor(abs({0}) * 10 + 0.5) / 10 + 0.0"
_BY_AGE = f"m AS (SELECT s.subject_id, p.patient_id, p.age - s.age AS age_diff, {_SIGNED.format('(p.bmi - s.bmi)')} AS bmi_diff, p.last_on, s.drawn_min, s.hba1c FROM seekers s LEFT JOIN (SELECT s, p FROM r WHERE p IS NOT NULL) r ON r.s = s.subject_id LEFT JOIN partners p ON p.patient_id = r.p)"


def _sql(*parts: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(parts[:-1]) + "\n" + parts[-1]


SQL: dict[str, str] = {
    "op_match_greedy": _sql("e AS MATERIALIZED (SELECT s_suppkey AS s, c_custkey AS p, abs(s_acctbal - c_acctbal) AS a, 0 AS b FROM supplier JOIN customer ON s_nationkey = c_nationkey)", _LOOP, "SELECT s AS s_suppkey, p AS c_custkey FROM r WHERE p IS NOT NULL"),
    "a_match_cgm": _sql(_PEOPLE, _SEEKERS.format(""), _PARTNERS, _CGM, _LOOP, _BY_AGE, "SELECT subject_id, patient_id, age_diff, bmi_diff FROM m"),
    "a_match_bigideas": _sql(
        _PEOPLE, _SEEKERS.format(""), _PARTNERS,
        "e AS MATERIALIZED (SELECT s.subject_id AS s, p.patient_id AS p, coalesce(abs(p.hba1c - s.hba1c), 99.0) AS a, CAST('0x' || substr(sha256(CAST(s.subject_id AS VARCHAR) || '/' || CAST(p.patient_id AS VARCHAR)), 1, 8) AS BIGINT) AS b FROM seekers s JOIN partners p ON p.sex = s.sex AND p.band = CASE WHEN s.hba1c >= 5.7 THEN 'prediabetes' ELSE 'neither' END)",
        _LOOP, "SELECT s AS subject_id, p AS patient_id FROM r WHERE p IS NOT NULL",
    ),
    "p_match": _sql(
        _PEOPLE, _SEEKERS.format(" AND hba1c >= 6.5"), _PARTNERS, _CGM, _LOOP, _BY_AGE,
        "SELECT patient_id, subject_id, CAST(last_on + 1 - DATE '2000-03-09' AS INTEGER) AS offset_days, age_diff, bmi_diff, hba1c, CAST(last_on + 1 AS TIMESTAMP) + to_minutes(coalesce(drawn_min, 0)) AS drawn_at FROM m WHERE patient_id IS NOT NULL",
    ),
}
