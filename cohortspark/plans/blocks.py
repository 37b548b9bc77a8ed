"""Queries of the scalar, join, aggregate, window and paging building blocks, each beside its SQL."""

from __future__ import annotations

from collections.abc import Callable

from cohortspark.functions import clinical as C
from cohortspark.functions import measures as M
from cohortspark.operators import analytic as A
from cohortspark.operators import relational as R
from cohortspark.operators import report
from cohortspark.plans.live_queries import _LEVEL, _SLOPE
from cohortspark.plans.oracles import LATEST, r
from cohortspark.sources import proxy
from pyspark.sql import functions as F

NAMESPACE = "6ba7b811-9dad-11d1-80b4-00c04fd430c8"  # fixed value: the public namespace of URLs
ZONE = "America/Chicago"
TAGGED = "SELECT c_custkey AS patient_id, c_acctbal, list_sort(list_distinct([c_mktsegment] || CASE WHEN c_nationkey % 3 = 0 THEN ['real'] ELSE [] END || CASE WHEN c_custkey % 7 = 0 THEN ['gmi-warn'] ELSE [] END || CASE WHEN c_acctbal > 5000 THEN ['rich'] ELSE [] END)) AS tags FROM customer"
_RANGES = ", ".join("(" + ", ".join("NULL" if x is None else repr(x) for x in row) + ")" for row in M.RANGES)
FLAGS = f"""SELECT o.patient_id, o.analyte, o.value, CASE WHEN low IS NULL AND high IS NULL THEN NULL WHEN o.value < low THEN 'low' WHEN o.value > high THEN 'high' ELSE 'normal' END AS flag
 FROM ({LATEST}) o JOIN patient p USING (patient_id) LEFT JOIN (SELECT * FROM (VALUES {_RANGES}) v(analyte, sex, low, high)) v ON v.analyte = o.analyte AND (v.sex IS NULL OR v.sex = p.sex)"""
_WEARABLE = "SELECT device_id, time, CAST(value AS DOUBLE) AS value FROM wearable WHERE metric = 'heart_rate'"


def _medicines(t):
    rows = t["lineitem"].select(
        "l_orderkey", "l_linenumber", (F.col("l_quantity") * 12.5).alias("strength"), F.when(F.col("l_linenumber") % 2 == 0, "MG/ML").otherwise("MG").alias("unit"),
        F.element_at(F.array(*[F.lit(x) for x in (1.0, 2.0, 1 / 7, 1 / 30, 0.5, 3.0, None)]), (F.col("l_partkey") % 7 + 1).cast("int")).alias("per_day"),
    )
    return rows


def _dosage(t):
    return _medicines(t).select("l_orderkey", "l_linenumber", M.dosage_text(F.col("strength"), F.col("unit"), F.col("per_day")).alias("dosage"))


def _dose(t):
    return _medicines(t).select("l_orderkey", "l_linenumber", M.dose(F.col("strength"), F.col("unit"), F.lit(2.0)).alias("dose"))


def _units(t):
    spark = t["observation"].sparkSession
    unit = F.when(F.col("l_linenumber") % 3 == 0, "mg/dl").when(F.col("l_linenumber") % 3 == 1, "mg/dL").otherwise("mmol/L")
    expected = spark.createDataFrame([("hdl", "mg/dL"), ("insulin", "mU/L"), ("triglycerides", "mg/dL")], "analyte string, expected_unit string")
    return R.checked_units(t["observation"].withColumn("unit", unit), expected)


def _tod(t):
    sin, cos = M.time_of_day(F.col("time"))
    return t["native"].select("device_id", "time", C.rounded(sin, 6).alias("tod_sin"), C.rounded(cos, 6).alias("tod_cos"))


def _index(t):
    key = [F.col("device_id"), F.col("time").alias("at")]
    return R.on_common_grid(t["native"].select(*key, F.col("mg_dl").alias("x")), t["wearable"].where("metric = 'steps'").select(*key, F.col("value").cast("double").alias("y")), "device_id")


def _corr(t):
    g = t["glucose"].alias("g").join(t["fused"].alias("f"), F.expr("g.device_id = f.patient_id and g.time = f.time"))
    return g.select("device_id", F.col("g.mg_dl").alias("x"), F.col("f.mg_dl").alias("y"))


def _clipped(t):
    return t["events"].select("event_id", M.clip(F.when(F.col("event_id") % 13 != 0, F.col("value")), 40.0, 400.0).alias("value"))


def _json(strip):
    return lambda t: R.payload(t["regimen"].select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("k"), "medication_id", F.when(F.col("medication_id") % 2 == 0, F.lit("x")).alias("note")), "k", ["medication_id", "note"], strip)


def _upsert(t):
    old = t["customer"].where("c_custkey % 2 = 0").select("c_custkey", F.col("c_acctbal").alias("v"))
    new = t["customer"].where("c_custkey % 3 = 0").select("c_custkey", (-F.col("c_acctbal")).alias("v"))
    return A.upsert(old, new, ["c_custkey"])


def _on_drug(t):
    days = t["encounter"].select("patient_id", F.to_date("started_at").alias("day")).distinct()
    return R.on_drug(t, days)


def _tail(t):
    """Rows that the order by time, order and line leaves open stay as the lines are stored."""
    return R.tail({**t, "observation": proxy.placed(t, "observation", "lineitem")}, at="place")


def _shifted(t):
    moved = C.shift_days(F.col("time"), (F.col("device_id") % 20).cast("int"), ZONE)
    return t["glucose"].select("device_id", "time", moved.alias("moved"))


_OK = f"timezone('{ZONE}', timezone('{ZONE}', m)) = m AND timezone('{ZONE}', timezone('{ZONE}', m) + INTERVAL 1 HOUR) <> m AND timezone('{ZONE}', timezone('{ZONE}', m) - INTERVAL 1 HOUR) <> m"

PLANS: dict[str, Callable] = {
    "op_array_any": lambda t: R.not_any(t, "rich"),
    "op_array_concat": lambda t: R.appended({**t, "patient": t["patient"]}, F.col("patient_id") % 5 == 0, "extra"),
    "op_array_card": R.cardinality,
    "op_array_contains_filter": lambda t: R.has_tag(t, "gmi-warn"),
    "op_json_build": _json(True),
    "op_json_keep_nulls": _json(False),
    "op_flag": R.flags,
    "op_flag_worst": R.patient_flag,
    "op_dosage_text": _dosage,
    "op_dose": _dose,
    "op_unit_check": lambda t: _units(t)[0].select("patient_id", "l_orderkey", "l_linenumber", "analyte"),
    "op_unit_mismatches": lambda t: _units(t)[1],
    "op_clip": _clipped,
    "op_tod": _tod,
    "op_uuid5": lambda t: t["customer"].select("c_custkey", M.uuid5(NAMESPACE, F.concat(F.lit("patient/"), F.col("c_custkey").cast("string"))).alias("id")),
    "op_tz_format": lambda t: t["glucose"].select("device_id", "time", M.iso_in_zone(F.col("time"), ZONE).alias("iso")),
    "op_at_tz": lambda t: t["glucose"].select("device_id", "time", C.local_time(F.col("time"), ZONE).alias("local")),
    "op_time_bucket_day": lambda t: t["glucose"].groupBy("device_id", F.to_date(C.local_time(F.col("time"), ZONE)).alias("day")).agg(F.count("*").alias("n")),
    "op_time_shift": _shifted,
    "op_round": lambda t: t["customer"].select("c_custkey", C.rounded(F.col("c_acctbal") / 7, 1).alias("away"), F.rint(F.col("c_custkey") / 2).alias("even")),
    "op_join_composite": R.with_product,
    "op_join_cross_filtered": lambda t: R.device_metrics(t, ["ibi_ms", "mets"]),
    "op_subq_exists": _on_drug,
    "op_subq_in": lambda t: R.readings_of(t, t["device"].where("is_live").select("device_id")),
    "op_subq_scalar_agg": lambda t: t["patient"].join(t["supplied"].groupBy("patient_id").agg(F.count_distinct("medication_id").alias("n"), F.sum(F.when(F.col("medication_id") % 50 == 0, F.col("supplier_id"))).alias("units")), "patient_id", "left").select("patient_id", F.coalesce("n", F.lit(0)).alias("n_medications"), "units"),
    "op_join_index": _index,
    "op_agg_json": R.values_by_code,
    "op_agg_median": lambda t: R.robust_spread(t["native"], "device_id", "mg_dl"),
    "op_agg_mode": R.phase,
    "op_agg_facets": lambda t: R.facets(t["encounter"].select(F.col("class"), F.year("started_at").alias("year")), {"class": "inpatient", "year": 1995}),
    "op_agg_corr": lambda t: _corr(t).groupBy("device_id").agg(C.rounded(F.corr("x", "y"), 6).alias("r")),
    "op_agg_deming": lambda t: A.deming(_corr(t), ["device_id"], "x", "y").select("device_id", "n", C.rounded(F.col("slope"), 6).alias("slope"), C.rounded(F.col("intercept"), 4).alias("intercept")),
    "op_win_ffill": lambda t: R.filled(t, 180),
    "op_win_pairwise": R.changes,
    "op_win_complete": lambda t: R.complete(t, 12),
    "op_win_trend": R.slope,
    "op_recent": lambda t: R.recent(t, 3),
    "op_tail12": _tail,
    "op_cursor": lambda t: R.page_with_cursor(t, 50, 2),
    "snk_upsert": _upsert,
}

_MED = "SELECT l_orderkey, l_linenumber, l_quantity * 12.5 AS strength, CASE WHEN l_linenumber % 2 = 0 THEN 'MG/ML' ELSE 'MG' END AS unit, l_partkey % 7 AS k FROM lineitem"
_WORDS = "CASE k WHEN 0 THEN 'once daily' WHEN 1 THEN 'twice daily' WHEN 2 THEN 'weekly' WHEN 3 THEN 'monthly' WHEN 4 THEN 'every 2 days' WHEN 5 THEN 'three times daily' END"
_PLAIN = "CASE WHEN strength = floor(strength) THEN CAST(CAST(strength AS BIGINT) AS VARCHAR) ELSE printf('%.1f', strength) END"
_UNIT = "CASE WHEN l_linenumber % 3 < 2 THEN 'mg/dL' ELSE 'mmol/L' END"
_WANT = "CASE analyte WHEN 'hdl' THEN 'mg/dL' WHEN 'insulin' THEN 'mU/L' WHEN 'triglycerides' THEN 'mg/dL' END"
_PAIR = "SELECT device_id, CAST(g.mg_dl AS DOUBLE) AS x, f.mg_dl AS y FROM glucose g JOIN fused f ON g.device_id = f.patient_id AND g.time = f.time"
_CHICAGO = f"timezone('{ZONE}', timezone('UTC', time))"

# op_uuid5 has none: DuckDB has no SHA-1 of bytes, so a test holds it against Python.
SQL: dict[str, str] = {
    "op_array_any": f"SELECT patient_id, NOT list_contains(tags, 'rich') AS without, list_contains(tags, 'rich') AS has FROM ({TAGGED})",
    "op_array_concat": f"SELECT patient_id, array_to_string(tags || CASE WHEN patient_id % 5 = 0 THEN ['extra'] ELSE [] END, ',') AS tags FROM ({TAGGED})",
    "op_array_card": f"SELECT patient_id, CAST(len(tags) AS INTEGER) AS n_tags FROM ({TAGGED})",
    "op_array_contains_filter": "SELECT c_custkey AS patient_id FROM customer WHERE c_custkey % 7 = 0",
    "op_json_build": """SELECT l_orderkey || '-' || l_linenumber AS k, '{"medication_id":' || l_partkey || CASE WHEN l_partkey % 2 = 0 THEN ',"note":"x"' ELSE '' END || '}' AS payload FROM lineitem""",
    "op_json_keep_nulls": """SELECT l_orderkey || '-' || l_linenumber AS k, '{"medication_id":' || l_partkey || ',"note":' || CASE WHEN l_partkey % 2 = 0 THEN '"x"' ELSE 'null' END || '}' AS payload FROM lineitem""",
    "op_flag": FLAGS,
    "op_flag_worst": f"SELECT patient_id, CASE WHEN bool_or(flag = 'high') THEN 'high' WHEN bool_or(flag = 'low') THEN 'low' WHEN bool_or(flag = 'normal') THEN 'normal' END AS flag FROM ({FLAGS}) GROUP BY 1",
    "op_dosage_text": f"SELECT l_orderkey, l_linenumber, concat_ws(' · ', {_PLAIN} || ' ' || unit, {_WORDS}) AS dosage FROM ({_MED})",
    "op_dose": f"SELECT l_orderkey, l_linenumber, CASE WHEN unit = 'MG' THEN strength * 2 END AS dose FROM ({_MED})",
    "op_unit_check": f"SELECT patient_id, l_orderkey, l_linenumber, analyte FROM observation WHERE {_UNIT} = {_WANT}",
    "op_unit_mismatches": f"SELECT analyte, count(*) FILTER (NOT coalesce({_UNIT} = {_WANT}, false)) AS mismatches FROM observation GROUP BY 1",
    "op_clip": "SELECT event_id, CASE WHEN event_id % 13 <> 0 THEN least(400.0, greatest(40.0, value)) END AS value FROM events",
    "op_tz_format": f"SELECT device_id, time, strftime({_CHICAGO}, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us({_CHICAGO}) - epoch_us(time) = -18000000000 THEN '-05:00' ELSE '-06:00' END AS iso FROM glucose",
    "op_at_tz": f"SELECT device_id, time, {_CHICAGO} AS local FROM glucose",
    "op_time_bucket_day": f"SELECT device_id, CAST({_CHICAGO} AS DATE) AS day, count(*) AS n FROM glucose GROUP BY 1, 2",
    "op_time_shift": f"SELECT device_id, time, CASE WHEN {_OK} THEN m END AS moved FROM (SELECT device_id, time, time + to_days(CAST(device_id % 20 AS INTEGER)) AS m FROM glucose)",
    "op_round": "SELECT c_custkey, sign(c_acctbal) * floor(abs(c_acctbal / 7) * 10.0 + 0.5) / 10.0 + 0.0 AS away, round_even(c_custkey / 2.0, 0) AS even FROM customer",
    "op_join_composite": "SELECT patient_id, s.l_orderkey, s.l_linenumber, s.medication_id, s.supplier_id, p.product FROM supplied s LEFT JOIN product p ON p.medication_id = s.medication_id AND p.supplier_id = s.supplier_id",
    "op_join_cross_filtered": "SELECT d.device_id, m.metric, (SELECT max(w.time) FROM wearable w WHERE w.device_id = d.device_id AND w.metric = m.metric) AS last_at FROM device d JOIN (SELECT DISTINCT metric FROM wearable) m ON m.metric NOT IN ('ibi_ms', 'mets')",
    "op_subq_exists": "SELECT DISTINCT patient_id, CAST(started_at AS DATE) AS day FROM encounter e WHERE EXISTS (SELECT 1 FROM regimen g WHERE g.patient_id = e.patient_id AND CAST(g.started_at AS DATE) <= CAST(e.started_at AS DATE) AND (g.ended_at IS NULL OR CAST(g.ended_at AS DATE) >= CAST(e.started_at AS DATE)))",
    "op_subq_in": "SELECT device_id, count(*) AS n FROM wearable WHERE device_id IN (SELECT device_id FROM device WHERE is_live) GROUP BY 1",
    "op_subq_scalar_agg": "SELECT patient_id, (SELECT count(DISTINCT medication_id) FROM supplied s WHERE s.patient_id = p.patient_id) AS n_medications, CAST((SELECT sum(supplier_id) FROM supplied s WHERE s.patient_id = p.patient_id AND medication_id % 50 = 0) AS BIGINT) AS units FROM patient p",
    "op_join_index": "SELECT coalesce(a.device_id, b.device_id) AS device_id, coalesce(a.time, b.time) AS at, a.mg_dl AS x, CAST(b.value AS DOUBLE) AS y FROM native a FULL JOIN (SELECT * FROM wearable WHERE metric = 'steps') b ON a.device_id = b.device_id AND a.time = b.time",
    "op_agg_json": """SELECT device_id, hour, '{' || string_agg('"' || metric || '":' || v, ',' ORDER BY metric) || '}' AS payload FROM (SELECT device_id, hour, metric, CAST(CAST(trunc(arg_max(value, ordinal)) AS BIGINT) AS VARCHAR) AS v FROM hourly GROUP BY 1, 2, 3) GROUP BY 1, 2""",
    "op_agg_median": f"SELECT device_id, median(mg_dl) AS median, {r('mad(mg_dl) * 1.4826', 4)} AS robust_sd FROM native GROUP BY 1",
    "op_agg_mode": "SELECT DISTINCT ON (device_id) device_id, CAST(phase AS INTEGER) AS phase FROM (SELECT device_id, minute(time) % 5 AS phase, count(*) AS n FROM native GROUP BY 1, 2) ORDER BY device_id, n DESC, phase",
    "op_agg_facets": "SELECT 'class' AS facet, class AS value, count(*) AS n FROM encounter WHERE year(started_at) = 1995 GROUP BY 2 UNION ALL SELECT 'year', CAST(year(started_at) AS VARCHAR), count(*) FROM encounter WHERE class = 'inpatient' GROUP BY 2",
    "op_agg_corr": f"SELECT device_id, sign(c) * floor(abs(c) * 1000000.0 + 0.5) / 1000000.0 + 0.0 AS r FROM (SELECT device_id, corr(x, y) AS c FROM ({_PAIR}) GROUP BY 1)",
    "op_agg_deming": f"""SELECT device_id, n, sign(b) * floor(abs(b) * 1000000.0 + 0.5) / 1000000.0 + 0.0 AS slope, sign(my - b * mx) * floor(abs(my - b * mx) * 10000.0 + 0.5) / 10000.0 + 0.0 AS intercept FROM (SELECT *, (vy - vx + sqrt((vy - vx) * (vy - vx) + 4 * c * c)) / nullif(2 * c, 0) AS b
 FROM (SELECT device_id, count(*) AS n, var_pop(x) AS vx, var_pop(y) AS vy, covar_pop(x, y) AS c, avg(x) AS mx, avg(y) AS my FROM ({_PAIR}) GROUP BY 1))""",
    "op_win_ffill": f"""SELECT h.device_id, h.time, CASE WHEN epoch_us(h.time) - epoch_us(b.time) <= 10800000000 THEN b.mg_dl END AS before, CASE WHEN epoch_us(a.time) - epoch_us(h.time) <= 10800000000 THEN a.mg_dl END AS after
 FROM ({_WEARABLE}) h ASOF LEFT JOIN native b ON b.device_id = h.device_id AND h.time >= b.time ASOF LEFT JOIN native a ON a.device_id = h.device_id AND h.time < a.time""",
    "op_win_pairwise": """SELECT patient_id, medication_id, l_orderkey, l_linenumber, CAST(date_diff('day', CAST(p AS DATE), CAST(started_at AS DATE)) AS INTEGER) AS days, coalesce(e >= started_at, true) AS overlaps
 FROM (SELECT *, lag(started_at) OVER w AS p, lag(ended_at) OVER w AS e FROM regimen WINDOW w AS (PARTITION BY patient_id, medication_id ORDER BY started_at, l_orderkey, l_linenumber)) WHERE p IS NOT NULL""",
    "op_win_complete": "SELECT device_id, time FROM (SELECT device_id, time, count(*) OVER (PARTITION BY device_id ORDER BY time RANGE BETWEEN INTERVAL 55 MINUTE PRECEDING AND CURRENT ROW) AS n FROM glucose) WHERE n = 12",
    "op_win_trend": f"""SELECT device_id, time, {_SLOPE} AS slope, {_LEVEL} AS trend
 FROM (SELECT device_id, time, CASE WHEN count(*) OVER w >= 3 AND x - min(x) OVER w >= 600 THEN count(*) OVER w * sum(x * y) OVER w - sum(x) OVER w * sum(y) OVER w END AS rise, count(*) OVER w * sum(x * x) OVER w - sum(x) OVER w * sum(x) OVER w AS run
 FROM (SELECT device_id, time, CAST(mg_dl AS BIGINT) * 1000 AS y, CAST(epoch(time) AS BIGINT) - 1710000000 AS x FROM glucose) WINDOW w AS (PARTITION BY device_id ORDER BY time RANGE BETWEEN INTERVAL 15 MINUTE PRECEDING AND CURRENT ROW))""",
    "op_recent": lambda t: R.recent(t, 3),
    "op_tail12": R.tail,
    "op_cursor": lambda t: R.page_with_cursor(t, 50, 2),
    "snk_upsert": _upsert,
}

_MED = "SELECT l_orderkey, l_linenumber, l_quantity * 12.5 AS strength, CASE WHEN l_linenumber % 2 = 0 THEN 'MG/ML' ELSE 'MG' END AS unit, l_partkey % 7 AS k FROM lineitem"
_WORDS = "CASE k WHEN 0 THEN 'once daily' WHEN 1 THEN 'twice daily' WHEN 2 THEN 'weekly' WHEN 3 THEN 'monthly' WHEN 4 THEN 'every 2 days' WHEN 5 THEN 'three times daily' END"
_PLAIN = "CASE WHEN strength = floor(strength) THEN CAST(CAST(strength AS BIGINT) AS VARCHAR) ELSE printf('%.1f', strength) END"
_UNIT = "CASE WHEN l_linenumber % 3 < 2 THEN 'mg/dL' ELSE 'mmol/L' END"
_WANT = "CASE analyte WHEN 'hdl' THEN 'mg/dL' WHEN 'insulin' THEN 'mU/L' WHEN 'triglycerides' THEN 'mg/dL' END"
_PAIR = "SELECT device_id, CAST(g.mg_dl AS DOUBLE) AS x, f.mg_dl AS y FROM glucose g JOIN fused f ON g.device_id = f.patient_id AND g.time = f.time"
_CHICAGO = f"timezone('{ZONE}', timezone('UTC', time))"

# op_uuid5 has none: DuckDB has no SHA-1 of bytes, so a test holds it against Python.
SQL: dict[str, str] = {
    "op_array_any": f"SELECT patient_id, NOT list_contains(tags, 'rich') AS without, list_contains(tags, 'rich') AS has FROM ({TAGGED})",
    "op_array_concat": f"SELECT patient_id, array_to_string(tags || CASE WHEN patient_id % 5 = 0 THEN ['extra'] ELSE [] END, ',') AS tags FROM ({TAGGED})",
    "op_array_card": f"SELECT patient_id, CAST(len(tags) AS INTEGER) AS n_tags FROM ({TAGGED})",
    "op_array_contains_filter": "SELECT c_custkey AS patient_id FROM customer WHERE c_custkey % 7 = 0",
    "op_json_build": """SELECT l_orderkey || '-' || l_linenumber AS k, '{"medication_id":' || l_partkey || CASE WHEN l_partkey % 2 = 0 THEN ',"note":"x"' ELSE '' END || '}' AS payload FROM lineitem""",
    "op_json_keep_nulls": """SELECT l_orderkey || '-' || l_linenumber AS k, '{"medication_id":' || l_partkey || ',"note":' || CASE WHEN l_partkey % 2 = 0 THEN '"x"' ELSE 'null' END || '}' AS payload FROM lineitem""",
    "op_flag": FLAGS,
    "op_flag_worst": f"SELECT patient_id, CASE WHEN bool_or(flag = 'high') THEN 'high' WHEN bool_or(flag = 'low') THEN 'low' WHEN bool_or(flag = 'normal') THEN 'normal' END AS flag FROM ({FLAGS}) GROUP BY 1",
    "op_dosage_text": f"SELECT l_orderkey, l_linenumber, concat_ws(' · ', {_PLAIN} || ' ' || unit, {_WORDS}) AS dosage FROM ({_MED})",
    "op_dose": f"SELECT l_orderkey, l_linenumber, CASE WHEN unit = 'MG' THEN strength * 2 END AS dose FROM ({_MED})",
    "op_unit_check": f"SELECT patient_id, l_orderkey, l_linenumber, analyte FROM observation WHERE {_UNIT} = {_WANT}",
    "op_unit_mismatches": f"SELECT analyte, count(*) FILTER (NOT coalesce({_UNIT} = {_WANT}, false)) AS mismatches FROM observation GROUP BY 1",
    "op_clip": "SELECT event_id, CASE WHEN event_id % 13 <> 0 THEN least(400.0, greatest(40.0, value)) END AS value FROM events",
    "op_tz_format": f"SELECT device_id, time, strftime({_CHICAGO}, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us({_CHICAGO}) - epoch_us(time) = -18000000000 THEN '-05:00' ELSE '-06:00' END AS iso FROM glucose",
    "op_at_tz": f"SELECT device_id, time, {_CHICAGO} AS local FROM glucose",
    "op_time_bucket_day": f"SELECT device_id, CAST({_CHICAGO} AS DATE) AS day, count(*) AS n FROM glucose GROUP BY 1, 2",
    "op_time_shift": f"SELECT device_id, time, CASE WHEN {_OK} THEN m END AS moved FROM (SELECT device_id, time, time + to_days(CAST(device_id % 20 AS INTEGER)) AS m FROM glucose)",
    "op_round": "SELECT c_custkey, sign(c_acctbal) * floor(abs(c_acctbal / 7) * 10.0 + 0.5) / 10.0 + 0.0 AS away, round_even(c_custkey / 2.0, 0) AS even FROM customer",
    "op_join_composite": "SELECT patient_id, s.l_orderkey, s.l_linenumber, s.medication_id, s.supplier_id, p.product FROM supplied s LEFT JOIN product p ON p.medication_id = s.medication_id AND p.supplier_id = s.supplier_id",
    "op_join_cross_filtered": "SELECT d.device_id, m.metric, (SELECT max(w.time) FROM wearable w WHERE w.device_id = d.device_id AND w.metric = m.metric) AS last_at FROM device d JOIN (SELECT DISTINCT metric FROM wearable) m ON m.metric NOT IN ('ibi_ms', 'mets')",
    "op_subq_exists": "SELECT DISTINCT patient_id, CAST(started_at AS DATE) AS day FROM encounter e WHERE EXISTS (SELECT 1 FROM regimen g WHERE g.patient_id = e.patient_id AND CAST(g.started_at AS DATE) <= CAST(e.started_at AS DATE) AND (g.ended_at IS NULL OR CAST(g.ended_at AS DATE) >= CAST(e.started_at AS DATE)))",
    "op_subq_in": "SELECT device_id, count(*) AS n FROM wearable WHERE device_id IN (SELECT device_id FROM device WHERE is_live) GROUP BY 1",
    "op_subq_scalar_agg": "SELECT patient_id, (SELECT count(DISTINCT medication_id) FROM supplied s WHERE s.patient_id = p.patient_id) AS n_medications, CAST((SELECT sum(supplier_id) FROM supplied s WHERE s.patient_id = p.patient_id AND medication_id % 50 = 0) AS BIGINT) AS units FROM patient p",
    "op_join_index": "SELECT coalesce(a.device_id, b.device_id) AS device_id, coalesce(a.time, b.time) AS at, a.mg_dl AS x, CAST(b.value AS DOUBLE) AS y FROM native a FULL JOIN (SELECT * FROM wearable WHERE metric = 'steps') b ON a.device_id = b.device_id AND a.time = b.time",
    "op_agg_json": """SELECT device_id, hour, '{' || string_agg('"' || metric || '":' || v, ',' ORDER BY metric) || '}' AS payload FROM (SELECT device_id, hour, metric, CAST(CAST(trunc(arg_max(value, ordinal)) AS BIGINT) AS VARCHAR) AS v FROM hourly GROUP BY 1, 2, 3) GROUP BY 1, 2""",
    "op_agg_median": f"SELECT device_id, median(mg_dl) AS median, {r('mad(mg_dl) * 1.4826', 4)} AS robust_sd FROM native GROUP BY 1",
    "op_agg_mode": "SELECT DISTINCT ON (device_id) device_id, CAST(phase AS INTEGER) AS phase FROM (SELECT device_id, minute(time) % 5 AS phase, count(*) AS n FROM native GROUP BY 1, 2) ORDER BY device_id, n DESC, phase",
    "op_agg_facets": "SELECT 'class' AS facet, class AS value, count(*) AS n FROM encounter WHERE year(started_at) = 1995 GROUP BY 2 UNION ALL SELECT 'year', CAST(year(started_at) AS VARCHAR), count(*) FROM encounter WHERE class = 'inpatient' GROUP BY 2",
    "op_agg_corr": f"SELECT device_id, sign(c) * floor(abs(c) * 1000000.0 + 0.5) / 1000000.0 + 0.0 AS r FROM (SELECT device_id, corr(x, y) AS c FROM ({_PAIR}) GROUP BY 1)",
    "op_agg_deming": f"""SELECT device_id, n, sign(b) * floor(abs(b) * 1000000.0 + 0.5) / 1000000.0 + 0.0 AS slope, sign(my - b * mx) * floor(abs(my - b * mx) * 10000.0 + 0.5) / 10000.0 + 0.0 AS intercept FROM (SELECT *, (vy - vx + sqrt((vy - vx) * (vy - vx) + 4 * c * c)) / nullif(2 * c, 0) AS b
 FROM (SELECT device_id, count(*) AS n, var_pop(x) AS vx, var_pop(y) AS vy, covar_pop(x, y) AS c, avg(x) AS mx, avg(y) AS my FROM ({_PAIR}) GROUP BY 1))""",
    "op_win_ffill": f"""SELECT h.device_id, h.time, CASE WHEN epoch_us(h.time) - epoch_us(b.time) <= 10800000000 THEN b.mg_dl END AS before, CASE WHEN epoch_us(a.time) - epoch_us(h.time) <= 10800000000 THEN a.mg_dl END AS after
 FROM ({_WEARABLE}) h ASOF LEFT JOIN native b ON b.device_id = h.device_id AND h.time >= b.time ASOF LEFT JOIN native a ON a.device_id = h.device_id AND h.time < a.time""",
    "op_win_pairwise": """SELECT patient_id, medication_id, l_orderkey, l_linenumber, CAST(date_diff('day', CAST(p AS DATE), CAST(started_at AS DATE)) AS INTEGER) AS days, coalesce(e >= started_at, true) AS overlaps
 FROM (SELECT *, lag(started_at) OVER w AS p, lag(ended_at) OVER w AS e FROM regimen WINDOW w AS (PARTITION BY patient_id, medication_id ORDER BY started_at, l_orderkey, l_linenumber)) WHERE p IS NOT NULL""",
    "op_win_complete": "SELECT device_id, time FROM (SELECT device_id, time, count(*) OVER (PARTITION BY device_id ORDER BY time RANGE BETWEEN INTERVAL 55 MINUTE PRECEDING AND CURRENT ROW) AS n FROM glucose) WHERE n = 12",
    "op_win_trend": """SELECT device_id, time, slope, CASE WHEN slope < -2 THEN 'falling_fast' WHEN slope < -1 THEN 'falling' WHEN slope < 1 THEN 'steady' WHEN slope < 2 THEN 'rising' WHEN slope IS NOT NULL THEN 'rising_fast' END AS trend
 FROM (SELECT device_id, time, CASE WHEN n >= 3 AND span >= 10 THEN sign(b) * floor(abs(b) * 100.0 + 0.5) / 100.0 + 0.0 END AS slope FROM (SELECT device_id, time, count(*) OVER w AS n, x - min(x) OVER w AS span,
 (count(*) OVER w * sum(x * mg_dl) OVER w - sum(x) OVER w * sum(mg_dl) OVER w) / nullif(count(*) OVER w * sum(x * x) OVER w - sum(x) OVER w * sum(x) OVER w, 0) AS b FROM (SELECT device_id, time, mg_dl, (epoch(time) - 1710000000) / 60 AS x FROM glucose) WINDOW w AS (PARTITION BY device_id ORDER BY time RANGE BETWEEN INTERVAL 15 MINUTE PRECEDING AND CURRENT ROW)))""",
    "op_recent": "SELECT patient_id, l_orderkey, l_linenumber, ended_at IS NULL AS active FROM regimen QUALIFY ended_at IS NULL OR row_number() OVER (PARTITION BY patient_id, ended_at IS NULL ORDER BY started_at DESC, l_orderkey, l_linenumber) <= 3",
    "op_tail12": "SELECT patient_id, analyte, array_to_string(list_transform((list(value ORDER BY effective_at, l_orderkey, l_linenumber))[-12:], lambda v: CAST(CAST(v AS DECIMAL(18, 2)) AS VARCHAR)), ',') AS spark FROM observation GROUP BY 1, 2",
    "op_cursor": "SELECT encounter_id, started_at, (SELECT count(*) FROM encounter) AS total, CASE WHEN (SELECT count(*) FROM encounter) > 150 THEN 150 END AS next_cursor FROM encounter ORDER BY started_at DESC, encounter_id LIMIT 50 OFFSET 100",
    "snk_upsert": "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN -c_acctbal ELSE c_acctbal END AS v FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 = 0",
}
SQL["op_tod"] = "SELECT device_id, time, sign(s) * floor(abs(s) * 1000000.0 + 0.5) / 1000000.0 + 0.0 AS tod_sin, sign(c) * floor(abs(c) * 1000000.0 + 0.5) / 1000000.0 + 0.0 AS tod_cos FROM (SELECT device_id, time, sin(a) AS s, cos(a) AS c FROM (SELECT *, (hour(time) * 60 + minute(time)) * (2 * 3.141592653589793 / 1440) AS a FROM native))"
