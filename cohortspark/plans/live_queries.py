"""Queries of the live readings, each beside its SQL; the streaming operator itself is tested on golden sequences."""

from __future__ import annotations

from collections.abc import Callable

from cohortspark.streaming import intake as I
from cohortspark.streaming import state as S
from pyspark.sql import functions as F

NOW = "2024-03-09 04:00:00"


def _at():
    return F.lit(NOW).cast("timestamp_ntz")


def _raw(t):
    """Events as JSON: some without a zone, some of an unknown kind, some out of range."""
    e = t["events"]
    stamp = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.when(F.col("event_id") % 13 == 0, "").otherwise("Z"))
    kind = F.when(F.col("event_type") == "view", "glucose").when(F.col("event_type") == "click", "sleep").when(F.col("event_id") % 7 == 0, "other").otherwise("wearable")
    text = F.to_json(F.struct(
        kind.alias("kind"), F.col("user_id").alias("device_id"), stamp.alias("time"), F.col("value").alias("glucose_mg_dl"), F.when(F.col("event_type") == "error", "heart_rate").when(F.col("event_type") == "purchase", "shoe_size").alias("metric"),
        F.col("value"), F.when(F.col("event_id") % 5 == 0, "dozing").otherwise("deep").alias("stage"), F.date_format(F.col("ts") + F.expr("interval 1 hour") * (F.col("event_id") % 3 - 1), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("until"),
    ))
    return e.select(F.col("event_id").alias("index"), text.alias("json"))


def _devices(t):
    return t["device"].select("device_id", F.when(F.col("device_id") % 2 == 0, "cgm").otherwise("wearable").alias("device_kind"), (F.col("device_id") % 9 != 0).alias("is_live"))


def _metrics(t):
    return t["device"].sparkSession.createDataFrame([("heart_rate",), ("steps",)], "metric string")


def _checked(t):
    return I.checked(I.validated(_raw(t)), _devices(t), _metrics(t))


def _hours(t):
    """Valid readings that often share device, metric and hour."""
    hour = F.to_timestamp_ntz(F.date_format("ts", "yyyy-MM-dd HH:00:00"))
    e = t["events"].select(F.col("event_id").alias("index"), F.col("user_id").alias("device_id"), F.col("event_type").alias("metric"), hour.alias("time"), "value", F.when(F.col("event_id") % 10 == 0, "bad").alias("reason"))
    return e, e.where("index % 11 = 0")


def _live(t):
    return t["reading"].where("metric = 'glucose'").select("patient_id", "time", "value", "ordinal").where("ordinal % 2 = 0").drop("ordinal")


PLANS: dict[str, Callable] = {
    "s_validate": lambda t: I.validated(_raw(t)).select("index", "reason"),
    "s_check": lambda t: _checked(t).select("index", "reason"),
    "s_counts": lambda t: I.counts(*_hours(t)),
    "s_batch_order": lambda t: t["reading"].select("patient_id", "ordinal", "metric", F.row_number().over(S.Window.partitionBy("patient_id").orderBy("time", F.col("metric") != "sleep", "metric")).alias("place")),
    "s_reduce": lambda t: S.snapshot(t["reading"], _at()),
    "s_late": lambda t: S.latest(t["reading"]),
    "s_trend": lambda t: S.trend(t["reading"]),
    "s_steps_today": lambda t: S.steps_today(t["reading"]),
    "s_sleep_until": lambda t: S.asleep(t["reading"]),
    "s_stale": lambda t: S.stale(S.latest(t["reading"]), _at()).select("patient_id", "signal", "status"),
    "s_delta": lambda t: S.delta(S.snapshot(t["reading"].where(F.col("time") < _at()), _at()).select("patient_id", "heart_rate_status", "stage"), S.snapshot(t["reading"], _at()).select("patient_id", "heart_rate_status", "stage")),
    "s_transitions": lambda t: S.transitions(t["reading"]),
    "s_tick": lambda t: S.activity_of_stream(t["reading"].groupBy("patient_id").agg((F.max("time") - F.expr("interval 150 minutes")).alias("seen")), _at()),
    "s_series_cutover": lambda t: S.cutover(t["grid"].select("patient_id", F.col("time") + F.expr("interval 68 days"), F.col("mg_dl").alias("value")).toDF("patient_id", "time", "value"), _live(t)),
    "p_ms_loader": lambda t: S.rebuilt(t["reading"]).select("patient_id", "metric", "time", "ordinal"),
}

_KIND = "CASE WHEN event_type = 'view' THEN 'glucose' WHEN event_type = 'click' THEN 'sleep' WHEN event_id % 7 = 0 THEN 'other' ELSE 'wearable' END"
_METRIC = "CASE event_type WHEN 'error' THEN 'heart_rate' WHEN 'purchase' THEN 'shoe_size' END"
VALID = f"""SELECT event_id, user_id, {_KIND} AS kind, {_METRIC} AS metric, CASE WHEN {_KIND} = 'other' THEN 'unknown kind' WHEN event_id % 13 = 0 THEN 'time without zone' WHEN {_KIND} = 'glucose' AND NOT value BETWEEN 20 AND 600 THEN 'glucose out of range' WHEN {_KIND} = 'wearable' AND {_METRIC} IS NULL THEN 'no metric or value'
 WHEN {_KIND} = 'sleep' AND event_id % 5 = 0 THEN 'unknown stage' WHEN {_KIND} = 'sleep' AND event_id % 3 < 2 THEN 'ends before it starts' END AS reason FROM events"""
_HOUR = "SELECT event_id, user_id, event_type, date_trunc('hour', ts) AS h FROM events"
_STATUS = """CASE WHEN metric = 'glucose' THEN CASE WHEN value < 54 THEN 'very_low' WHEN value < 70 THEN 'low' WHEN value <= 180 THEN 'in_range' WHEN value <= 250 THEN 'high' ELSE 'very_high' END WHEN metric = 'heart_rate' THEN CASE WHEN value < 50 THEN 'low' WHEN value <= 100 THEN 'normal' ELSE 'elevated' END
 WHEN metric = 'spo2' THEN CASE WHEN value < 90 THEN 'low' WHEN value < 95 THEN 'borderline' ELSE 'normal' END WHEN metric = 'mets' THEN CASE WHEN value < 1.5 THEN 'sedentary' WHEN value < 3 THEN 'light' WHEN value < 6 THEN 'moderate' ELSE 'vigorous' END END"""
LATEST = f"SELECT DISTINCT ON (patient_id, signal) patient_id, CASE metric WHEN 'mets' THEN 'activity' ELSE metric END AS signal, time, value, {_STATUS} AS status FROM reading WHERE metric IN ('glucose', 'heart_rate', 'spo2', 'mets') ORDER BY patient_id, signal, time DESC, value DESC"
STALE = f"SELECT patient_id, signal, value, CASE WHEN epoch_us(TIMESTAMP '{NOW}') - epoch_us(time) > CASE signal WHEN 'glucose' THEN 900000000 WHEN 'heart_rate' THEN 600000000 END THEN 'stale' ELSE status END AS status FROM ({LATEST})"
_LEVEL = "CASE WHEN run <= 0 THEN NULL WHEN 60 * rise < -2000 * run THEN 'falling_fast' WHEN 60 * rise < -1000 * run THEN 'falling' WHEN 60 * rise < 1000 * run THEN 'steady' WHEN 60 * rise < 2000 * run THEN 'rising' WHEN rise IS NOT NULL THEN 'rising_fast' END"
_SLOPE = "CASE WHEN run > 0 THEN sign(rise) * CAST((12 * abs(rise) + run) // (2 * run) AS DOUBLE) / 100 + 0.0 END"
TREND = f"""SELECT patient_id, {_SLOPE} AS slope, {_LEVEL} AS trend FROM (SELECT patient_id, CASE WHEN count(*) >= 3 AND -min(x) >= 600 THEN count(*) * sum(x * y) - sum(x) * sum(y) END AS rise, count(*) * sum(x * x) - sum(x) * sum(x) AS run
 FROM (SELECT DISTINCT patient_id, CAST(round(value * 1000) AS BIGINT) AS y, CAST(date_diff('second', max(time) OVER (PARTITION BY patient_id), time) AS BIGINT) AS x FROM reading WHERE metric = 'glucose') WHERE x >= -900 GROUP BY 1)"""
STEPS = "SELECT patient_id, day, steps FROM (SELECT patient_id, CAST(time AS DATE) AS day, sum(value) AS steps FROM reading WHERE metric = 'steps' GROUP BY 1, 2) QUALIFY day = max(day) OVER (PARTITION BY patient_id)"
SLEEP = "SELECT DISTINCT ON (patient_id) patient_id, CASE WHEN (SELECT max(time) FROM {0} x WHERE x.patient_id = r.patient_id) > until THEN 'awake' ELSE stage END AS stage FROM {0} r WHERE metric = 'sleep' ORDER BY patient_id, time DESC"
_HEART = "SELECT DISTINCT ON (patient_id) patient_id, CASE WHEN epoch_us(TIMESTAMP '" + NOW + "') - epoch_us(time) > 600000000 THEN 'stale' WHEN value < 50 THEN 'low' WHEN value <= 100 THEN 'normal' ELSE 'elevated' END AS s FROM {0} WHERE metric = 'heart_rate' ORDER BY patient_id, time DESC"
_OLD = f"(SELECT * FROM reading WHERE time < TIMESTAMP '{NOW}')"


def _fields(src: str) -> str:
    return f"SELECT p.patient_id, 'heart_rate_status' AS field, h.s AS value FROM (SELECT DISTINCT patient_id FROM {src}) p LEFT JOIN ({_HEART.format(src)}) h USING (patient_id) UNION ALL SELECT p.patient_id, 'stage', s.stage FROM (SELECT DISTINCT patient_id FROM {src}) p LEFT JOIN ({SLEEP.format(src)}) s USING (patient_id)"


SQL: dict[str, str] = {
    "s_validate": f'SELECT event_id AS "index", reason FROM ({VALID})',
    "s_check": f"""SELECT event_id AS "index", coalesce(reason, CASE WHEN user_id % 9 = 0 THEN 'not a live device' WHEN CASE WHEN user_id % 2 = 0 THEN 'cgm' ELSE 'wearable' END <> CASE WHEN kind = 'glucose' THEN 'cgm' ELSE 'wearable' END THEN 'wrong kind of device' WHEN kind = 'wearable' AND metric NOT IN ('heart_rate', 'steps') THEN 'unknown metric' END) AS reason FROM ({VALID})""",
    "s_counts": f"SELECT total, accepted, total - rejected - accepted AS duplicates, rejected FROM (SELECT count(*) AS total, count(*) FILTER (event_id % 10 = 0) AS rejected FROM events), (SELECT count(DISTINCT (user_id, event_type, h)) AS accepted FROM ({_HOUR}) e WHERE event_id % 10 <> 0 AND NOT EXISTS (SELECT 1 FROM ({_HOUR}) x WHERE x.event_id % 11 = 0 AND x.user_id = e.user_id AND x.event_type = e.event_type AND x.h = e.h))",
    "s_batch_order": "SELECT patient_id, ordinal, metric, CAST(row_number() OVER (PARTITION BY patient_id ORDER BY time, CASE WHEN metric = 'sleep' THEN 0 ELSE 1 END, metric) AS INTEGER) AS place FROM reading",
    "s_reduce": f"""SELECT p.patient_id, g.value AS glucose_value, g.status AS glucose_status, h.value AS heart_rate_value, h.status AS heart_rate_status, a.value AS activity_value, a.status AS activity_status, o.value AS spo2_value, o.status AS spo2_status, CASE WHEN g.status IS DISTINCT FROM 'stale' THEN slope END AS slope, CASE WHEN g.status IS DISTINCT FROM 'stale' THEN trend END AS trend, day, steps, stage
 FROM (SELECT DISTINCT patient_id FROM ({STALE})) p LEFT JOIN ({STALE}) g ON g.patient_id = p.patient_id AND g.signal = 'glucose' LEFT JOIN ({STALE}) h ON h.patient_id = p.patient_id AND h.signal = 'heart_rate' LEFT JOIN ({STALE}) a ON a.patient_id = p.patient_id AND a.signal = 'activity' LEFT JOIN ({STALE}) o ON o.patient_id = p.patient_id AND o.signal = 'spo2'
 LEFT JOIN ({TREND}) t ON t.patient_id = p.patient_id LEFT JOIN ({STEPS}) s ON s.patient_id = p.patient_id LEFT JOIN ({SLEEP.format('reading')}) z ON z.patient_id = p.patient_id""",
    "s_late": LATEST,
    "s_trend": TREND,
    "s_steps_today": STEPS,
    "s_sleep_until": SLEEP.format("reading"),
    "s_stale": f"SELECT patient_id, signal, status FROM ({STALE})",
    "s_delta": f"SELECT n.patient_id, n.field, n.value FROM ({_fields('reading')}) n LEFT JOIN ({_fields(_OLD)}) o ON o.patient_id = n.patient_id AND o.field = n.field WHERE n.value IS DISTINCT FROM o.value",
    "s_transitions": f"SELECT patient_id, signal, time, f AS from_status, s AS to_status, value FROM (SELECT *, lag(s) OVER (PARTITION BY patient_id, signal ORDER BY time, value) AS f FROM (SELECT patient_id, CASE metric WHEN 'mets' THEN 'activity' ELSE metric END AS signal, time, value, {_STATUS} AS s FROM reading WHERE metric IN ('glucose', 'heart_rate', 'spo2', 'mets'))) WHERE f IS DISTINCT FROM s",
    "s_tick": f"SELECT patient_id, idle <= 60 AS streaming, idle > 600 AS evict FROM (SELECT patient_id, (epoch_us(TIMESTAMP '{NOW}') - epoch_us(max(time) - INTERVAL 150 MINUTE)) / 1000000 AS idle FROM reading GROUP BY 1)",
    "s_series_cutover": "WITH live AS (SELECT patient_id, time, value FROM reading WHERE metric = 'glucose' AND ordinal % 2 = 0), old AS (SELECT patient_id, time + to_days(68) AS time, mg_dl AS value FROM grid) SELECT *, false AS is_live FROM old o WHERE NOT EXISTS (SELECT 1 FROM live l WHERE l.patient_id = o.patient_id AND l.time <= o.time) UNION ALL SELECT *, true FROM live",
    "p_ms_loader": "SELECT patient_id, metric, time, ordinal FROM (SELECT *, max(time) OVER (PARTITION BY patient_id, metric) AS e FROM reading) WHERE time = e OR (metric = 'glucose' AND e - time <= INTERVAL 15 MINUTE) OR (metric = 'steps' AND CAST(e AS DATE) = CAST(time AS DATE))",
}
