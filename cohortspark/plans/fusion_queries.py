"""Queries of the sensor fusion over two series made of the glucose table, each beside its SQL."""

from __future__ import annotations

from collections.abc import Callable

from cohortspark.operators import fusion as U
from cohortspark.plans.oracles import r
from pyspark.sql import functions as F

REACH, WARMUP, LEAST = 60, 60, 30


def _minute():
    return F.timestamp_diff("MINUTE", F.lit("2024-03-09").cast("timestamp_ntz"), F.col("time"))


def _ref(t):
    return t["glucose"].select(F.col("device_id").alias("patient_id"), _minute().alias("minute"), F.col("mg_dl").cast("double").alias("value"))


def _sec(t):
    """Every third reading, late by 0, 4 or 8 minutes (every fifth patient by 40), on another scale."""
    late = F.when(F.col("device_id") % 5 == 0, 40).otherwise(F.col("device_id") % 3 * 4)
    g = t["glucose"].withColumn("m", _minute()).where("m % 15 = 0")
    return g.select(F.col("device_id").alias("patient_id"), (F.col("m") + late).alias("minute"), (F.col("mg_dl") * 0.875 + 5 + F.col("m") % 4).cast("double").alias("value"))


def _meals(t):
    return t["glucose"].withColumn("minute", _minute()).where("mg_dl % 7 = 3").select(F.col("device_id").alias("patient_id"), "minute")


def _lab(t):
    return t["device"].select("patient_id", (5.0 + F.col("patient_id") % 30 / 10).alias("hba1c"))


def _sticks(t):
    return _ref(t).where("minute % 35 = 0").select("patient_id", (F.col("minute") + 2).alias("minute"), (F.col("value") + 9).alias("value"))


def _minutes(t):
    return U.minute_series(_ref(t), U.REFERENCE_GAP), U.minute_series(_sec(t), U.SECONDARY_GAP)


def _calibration(t):
    return U.calibrated(_ref(t), _sec(t), WARMUP, LEAST)


def _rounded(df):
    return df.select("patient_id", U.C.rounded(F.col("intercept"), 4).alias("intercept"), U.C.rounded(F.col("slope"), 6).alias("slope"), "settled", U.C.rounded(F.col("sd"), 4).alias("sd"), U.C.rounded(F.col("factor"), 3).alias("factor"))


def _peaks(t):
    a, b = _minutes(t)
    return U.meal_peaks(a, _meals(t), 15, 45).withColumnRenamed("peak", "reference_peak").join(U.meal_peaks(b, _meals(t), 15, 45).withColumnRenamed("peak", "secondary_peak"), "patient_id", "full")


def _fused(t):
    return U.fused(_ref(t), _sec(t), _calibration(t), WARMUP)


PLANS: dict[str, Callable] = {
    "a_minute_series": lambda t: _minutes(t)[0].withColumn("value", U.C.rounded(F.col("value"), 6)),
    "a_shift": lambda t: U.shifted(_ref(t), -F.col("patient_id") % 7),
    "a_lag": lambda t: U.lags(*_minutes(t)).select("patient_id", "lag", U.C.rounded(F.col("r"), 6).alias("r")),
    "a_meal_peak": lambda t: U.meal_peaks(_minutes(t)[0], _meals(t), 15, 45),
    "a_align": lambda t: U.alignment(U.lags(*_minutes(t), REACH), _peaks(t)),
    "a_deming": lambda t: _calibration(t).select("patient_id", U.C.rounded(F.col("slope"), 6).alias("slope"), "settled"),
    "a_calibrate": lambda t: _rounded(_calibration(t)),
    "a_fuse": _fused,
    "a_single": lambda t: U.single(_ref(t)),
    "a_fusion_run": lambda t: U.run(_ref(t), _sec(t), _meals(t), REACH, WARMUP, LEAST)[1],
    "a_fusion_validate": lambda t: U.validated(_ref(t), _sec(t), _fused(t), _lab(t), _sticks(t)),
}

_MIN = "CAST(date_diff('minute', TIMESTAMP '2024-03-09', time) AS BIGINT)"
REF = f"SELECT device_id AS patient_id, {_MIN} AS minute, CAST(mg_dl AS DOUBLE) AS value FROM glucose"
SEC = f"SELECT patient_id, minute + CASE WHEN patient_id % 5 = 0 THEN 40 ELSE patient_id % 3 * 4 END AS minute, value * 0.875 + 5 + minute % 4 AS value FROM ({REF}) WHERE minute % 15 = 0"
MEALS = f"SELECT DISTINCT patient_id, minute FROM ({REF}) WHERE CAST(value AS INTEGER) % 7 = 3"


def _series(src: str, gap: int) -> str:
    return f"SELECT patient_id, minute + i AS minute, CASE WHEN i = 0 THEN value ELSE value + (v2 - value) * i / (m2 - minute) END AS value FROM (SELECT *, unnest(range(0, CASE WHEN m2 - minute <= {gap} THEN m2 - minute ELSE 1 END)) AS i FROM (SELECT *, lead(minute) OVER w AS m2, lead(value) OVER w AS v2 FROM ({src}) WINDOW w AS (PARTITION BY patient_id ORDER BY minute)))"


def _signed(x: str, digits: int) -> str:
    return f"(sign({x}) * (floor(abs({x}) * {10**digits}.0 + 0.5) / {10**digits}.0) + 0.0)"


R1, S1 = _series(REF, 10), _series(SEC, 20)


def _lags(reach: int) -> str:
    return f"""SELECT DISTINCT ON (patient_id) patient_id, lag, r FROM (SELECT a.patient_id, CAST(b.minute - a.minute AS INTEGER) AS lag, {_signed('corr(a.value, b.value)', 9)} AS r, count(*) AS n FROM ({R1}) a JOIN ({S1}) b ON a.patient_id = b.patient_id AND b.minute BETWEEN a.minute - {reach} AND a.minute + {reach} GROUP BY 1, 2)
 WHERE n > 1 AND r IS NOT NULL AND NOT isnan(r) ORDER BY patient_id, r DESC, lag"""


LAGS = _lags(REACH)


def _peak(series: str) -> str:
    return f"""SELECT DISTINCT ON (patient_id) patient_id, CAST(off AS INTEGER) AS peak FROM (SELECT patient_id, off, {_signed('avg(value - base)', 9)} AS rise FROM (SELECT m.patient_id, m.minute AS meal, s.minute - m.minute AS off, s.value, count(*) OVER (PARTITION BY m.patient_id, m.minute) AS n, avg(s.value) FILTER (s.minute <= m.minute) OVER (PARTITION BY m.patient_id, m.minute) AS base
 FROM ({MEALS}) m JOIN ({series}) s ON s.patient_id = m.patient_id AND s.minute BETWEEN m.minute - 15 AND m.minute + 45) WHERE n > 0.9 * 61 GROUP BY 1, 2) WHERE rise IS NOT NULL ORDER BY patient_id, rise DESC, off"""


ALIGN = f"""WITH l AS ({LAGS}), p AS (SELECT patient_id, a.peak AS rp, b.peak AS sp FROM ({_peak(R1)}) a FULL JOIN ({_peak(S1)}) b USING (patient_id)), j AS (SELECT l.patient_id, lag, rp, sp FROM l LEFT JOIN p USING (patient_id)),
 c AS (SELECT median(x) AS cp FROM (SELECT rp AS x FROM j WHERE abs(lag) <= 20 UNION ALL SELECT sp FROM j WHERE abs(lag) <= 20) WHERE x IS NOT NULL)
 SELECT patient_id, lag, CASE WHEN abs(lag) <= 20 THEN 'sensor_lag' ELSE 'clock_offset' END AS kind, CASE WHEN abs(lag) <= 20 THEN least(lag, 0) WHEN coalesce(abs(sp - cp) < abs(rp - cp), false) THEN lag ELSE 0 END AS reference_shift,
 CASE WHEN abs(lag) <= 20 THEN -greatest(lag, 0) WHEN coalesce(abs(sp - cp) < abs(rp - cp), false) THEN 0 ELSE -lag END AS secondary_shift FROM j, c"""
_BOTH = f"""SELECT r.patient_id, r.minute, r.value AS r, s.value AS s, r.minute < r0 + {WARMUP} OR r.minute < s0 + {WARMUP} AS warm FROM ({R1}) r JOIN ({S1}) s ON r.patient_id = s.patient_id AND r.minute = s.minute JOIN (SELECT patient_id, min(minute) AS r0 FROM ({REF}) GROUP BY 1) x ON x.patient_id = r.patient_id
 JOIN (SELECT patient_id, min(minute) AS s0 FROM ({SEC}) GROUP BY 1) y ON y.patient_id = r.patient_id WHERE r.value > 40 AND r.value < 400 AND s.value > 40 AND s.value < 400"""
CALIBRATION = f"""SELECT f.patient_id, intercept, slope, settled, sd, CASE WHEN wn >= {LEAST} AND sd > 0 THEN least(25.0, greatest(1.0, 2 * (wsd / sd) * (wsd / sd) - 1)) ELSE 1.0 END AS factor FROM
 (SELECT patient_id, settled, slope, my - slope * mx AS intercept FROM (SELECT *, (vy - vx + sqrt((vy - vx) * (vy - vx) + 4 * c * c)) / nullif(2 * c, 0) AS slope FROM (SELECT patient_id, count(*) AS settled, var_pop(s) AS vx, var_pop(r) AS vy, covar_pop(s, r) AS c, avg(s) AS mx, avg(r) AS my FROM both_ WHERE NOT warm GROUP BY 1) WHERE settled >= {LEAST})) f
 JOIN (SELECT patient_id, 1.4826 * mad(o) FILTER (NOT warm) AS sd, 1.4826 * mad(o) FILTER (warm) AS wsd, count(*) FILTER (warm) AS wn FROM (SELECT b.patient_id, b.warm, b.r - (g.my - g.slope * g.mx + g.slope * b.s) AS o FROM both_ b JOIN (SELECT *, (vy - vx + sqrt((vy - vx) * (vy - vx) + 4 * c * c)) / nullif(2 * c, 0) AS slope FROM (SELECT patient_id, var_pop(s) AS vx, var_pop(r) AS vy, covar_pop(s, r) AS c, avg(s) AS mx, avg(r) AS my FROM both_ WHERE NOT warm GROUP BY 1)) g ON g.patient_id = b.patient_id) GROUP BY 1) d ON d.patient_id = f.patient_id"""
_WITH = f"WITH both_ AS ({_BOTH}), cal AS ({CALIBRATION})"
_W = "CASE WHEN minute < {0} + " + str(WARMUP) + " THEN 1 / factor ELSE 1.0 END"
FUSED = f"""SELECT patient_id, minute, {r('least(400.0, greatest(40.0, v))', 1)} AS glucose, source, censored FROM (SELECT *, NOT (rok OR sok) OR v <= 40 OR v >= 400 AS censored FROM (SELECT *, CASE WHEN rok AND sok THEN ({_W.format('r0')} * r + {_W.format('s0')} * s) / ({_W.format('r0')} + {_W.format('s0')}) WHEN rok THEN r WHEN sok THEN s ELSE coalesce(r, s) END AS v,
 CASE WHEN rok AND sok THEN 'both' WHEN rok THEN 'reference_only' WHEN sok THEN 'secondary_only' WHEN r IS NOT NULL AND s IS NOT NULL THEN 'both' WHEN r IS NOT NULL THEN 'reference_only' ELSE 'secondary_only' END AS source
 FROM (SELECT g.patient_id, g.minute, g.r, c.intercept + c.slope * g.raw AS s, coalesce(g.r > 40 AND g.r < 400, false) AS rok, coalesce(g.raw > 40 AND g.raw < 400, false) AS sok, factor, r0, s0 FROM (SELECT coalesce(a.patient_id, b.patient_id) AS patient_id, coalesce(a.minute, b.minute) AS minute, a.value AS r, b.value AS raw
 FROM (SELECT * FROM ({R1}) WHERE minute % 5 = 0) a FULL JOIN (SELECT * FROM ({S1}) WHERE minute % 5 = 0) b ON a.patient_id = b.patient_id AND a.minute = b.minute) g JOIN cal c ON c.patient_id = g.patient_id
 LEFT JOIN (SELECT patient_id, min(minute) AS r0 FROM ({REF}) GROUP BY 1) x ON x.patient_id = g.patient_id LEFT JOIN (SELECT patient_id, min(minute) AS s0 FROM ({SEC}) GROUP BY 1) y ON y.patient_id = g.patient_id))) WHERE v IS NOT NULL"""
_GMI = r("3.31 + 0.02392 * avg(value)", 2)


def _mard(series: str, name: str) -> str:
    return f"""SELECT patient_id, {r('100 * avg(abs(v - stick) / stick)', 1)} AS mard_{name}, count(*) AS n_{name} FROM (SELECT k.patient_id, k.at, arg_min(s.value, abs(s.minute - k.at) * 10 - CASE WHEN s.minute > k.at THEN 1 ELSE 0 END) AS v, any_value(k.stick) AS stick
 FROM (SELECT patient_id, minute + 2 AS at, value + 9 AS stick FROM ({REF}) WHERE minute % 35 = 0) k JOIN ({series}) s ON s.patient_id = k.patient_id AND s.minute BETWEEN k.at - 5 AND k.at + 5 GROUP BY 1, 2) GROUP BY 1"""


SQL: dict[str, str] = {
    "a_minute_series": f"SELECT patient_id, minute, {r('value', 6)} AS value FROM ({R1})",
    "a_shift": f"SELECT patient_id, minute + (-patient_id) % 7 AS minute, value FROM ({REF})",
    "a_lag": f"SELECT patient_id, lag, {_signed('r', 6)} AS r FROM ({_lags(U.LAG_REACH)})",
    "a_meal_peak": _peak(R1),
    "a_align": ALIGN,
    "a_deming": f"{_WITH} SELECT patient_id, {r('slope', 6)} AS slope, settled FROM cal",
    "a_calibrate": f"{_WITH} SELECT patient_id, {_signed('intercept', 4)} AS intercept, {_signed('slope', 6)} AS slope, settled, {r('sd', 4)} AS sd, {r('factor', 3)} AS factor FROM cal",
    "a_fuse": f"{_WITH} {FUSED}",
    "a_single": f"SELECT patient_id, minute, {r('least(400.0, greatest(40.0, value))', 1)} AS glucose, 'reference_only' AS source, value <= 40 OR value >= 400 AS censored FROM ({R1}) WHERE minute % 5 = 0",
    "a_fusion_validate": f"""{_WITH}, f AS ({FUSED}) SELECT d.patient_id, hba1c, gmi_reference, {r('abs(gmi_reference - hba1c)', 2)} AS off_reference, gmi_secondary_raw, {r('abs(gmi_secondary_raw - hba1c)', 2)} AS off_secondary_raw, gmi_fused, {r('abs(gmi_fused - hba1c)', 2)} AS off_fused,
 mard_reference, coalesce(n_reference, 0) AS n_reference, mard_fused, coalesce(n_fused, 0) AS n_fused, coverage_gain FROM (SELECT patient_id, 5.0 + patient_id % 30 / 10 AS hba1c FROM device) d LEFT JOIN (SELECT patient_id, {_GMI} AS gmi_reference FROM ({REF}) GROUP BY 1) USING (patient_id) LEFT JOIN (SELECT patient_id, {_GMI} AS gmi_secondary_raw FROM ({SEC}) GROUP BY 1) USING (patient_id)
 LEFT JOIN (SELECT patient_id, {_GMI.replace('value', 'glucose')} AS gmi_fused FROM f GROUP BY 1) USING (patient_id) LEFT JOIN ({_mard(R1, 'reference')}) USING (patient_id) LEFT JOIN ({_mard('SELECT patient_id, minute, glucose AS value FROM f', 'fused')}) USING (patient_id)
 LEFT JOIN (SELECT f.patient_id, {_signed('100 * (count(*) / nullif(count(s.minute), 0) - 1)', 1)} AS coverage_gain FROM f LEFT JOIN ({R1}) s ON s.patient_id = f.patient_id AND s.minute = f.minute GROUP BY 1) USING (patient_id)""",
}
