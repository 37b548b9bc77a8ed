"""Steps of the fusion over series that grow after their size was estimated: no broadcast, and no shuffle of minutes for lags."""

import re

import numpy as np
import pytest
from cohortspark.operators import beside
from cohortspark.operators import fusion as U
from cohortspark.plans import fusion_queries, registry
from pyspark.sql import functions as F


def _series(spark, late=0):
    rows = [(p, 5 * i + late, float(100 + (i * i + p) % 37)) for p in range(3) for i in range(60)]
    return spark.createDataFrame(rows, "patient_id long, minute long, value double")


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]


def test_lags_shuffle_readings_alone(spark):
    r, s = U.minute_series(_series(spark), 10), U.minute_series(_series(spark, 7), 20)
    found = U.lags(r, s, 60)
    assert "Join" not in _plan(found) and _plan(found).count("Exchange hashpartitioning") <= 3
    assert {(x.patient_id, x.lag) for x in found.collect()} == {(p, 7) for p in range(3)}


def test_lags_at_the_edge_of_the_reach(spark):
    r, s = U.minute_series(_series(spark), 10), U.minute_series(_series(spark, -60), 20)
    assert {(x.patient_id, x.lag) for x in U.lags(r, s, 60).collect()} == {(p, -60) for p in range(3)}


def test_minutes_are_not_broadcast(spark):
    r = U.minute_series(_series(spark), 10)
    assert "BroadcastHashJoin" not in _plan(U.meal_peaks(r, _series(spark).where("minute % 50 = 0").select("patient_id", "minute"), 15, 45))
    both = _plan(U.calibrated(_series(spark), _series(spark, 3), 60, 30)).splitlines()
    assert not [x for x in both if "BroadcastHashJoin" in x and "minute" in x]


def test_a_run_reads_its_alignment_from_a_stored_table(spark):
    moves, stream = U.run(_series(spark), _series(spark, 7), _series(spark).where("minute % 50 = 0").select("patient_id", "minute"), 60, 60, 30)
    assert not [x for x in _plan(moves).splitlines() + _plan(stream).splitlines() if "corr(" in x]
    assert {(r.patient_id, r.lag, r.kind) for r in moves.collect()} == {(p, 7, "sensor_lag") for p in range(3)} and stream.count()


def test_the_registered_lag_search_has_the_whole_reach(spark, monkeypatch):
    """A secondary series that is 100 minutes late is found; the SQL looks as far, that of the alignment is as it was."""
    rng = np.random.default_rng(3)
    rows = [(p, 5 * i, float(v)) for p in range(3) for i, v in enumerate(rng.integers(60, 300, 80))]
    early = spark.createDataFrame(rows, "patient_id long, minute long, value double")
    g = early.selectExpr("patient_id as device_id", "timestampadd(MINUTE, cast(minute as int), timestamp_ntz'2024-03-09') as time", "value as mg_dl")
    monkeypatch.setattr(fusion_queries, "_sec", lambda t: early.withColumn("minute", F.col("minute") + 100))
    assert {(x.patient_id, x.lag) for x in fusion_queries.PLANS["a_lag"]({"glucose": g}).collect()} == {(p, 100) for p in range(3)}
    assert "a.minute + 120" in registry.oracle_sql()["a_lag"] and "a.minute + 60" in registry.oracle_sql()["a_align"]


@pytest.mark.parametrize("seed", range(6))
def test_best_lag_is_that_of_all_pairs(seed, monkeypatch):
    """Against each lag's correlation by numpy: repeated minutes, pauses, flat and straight stretches, blocks shorter than the series."""
    monkeypatch.setattr(beside, "BLOCK", 40)
    rng = np.random.default_rng(seed)
    m = np.sort(rng.choice([*range(150), *range(900, 960)], 90, replace=bool(seed % 2)))
    u = np.sort(rng.choice([*range(20, 170), *range(880, 990)], 80, replace=bool(seed % 2)))
    x, y = rng.integers(40, 400, len(m)) / 8, rng.integers(40, 400, len(u)) / 8
    if seed >= 4:
        x, y = m * 0.5 + 7, np.where(u < 100, 50.0, u * (1.0 if seed == 4 else -1.0))
    want = []
    for lag in range(-30, 31):
        i, j = np.nonzero(u[None, :] - m[:, None] == lag)
        if len(i) > 1 and np.ptp(x[i]) and np.ptp(y[j]):
            want.append((-float(beside.rounded(np.corrcoef(x[i], y[j])[0, 1])), lag))
    r, lag = min(want)
    assert beside.best_lag((m, x), (u, y), 30) == (lag, -r)
    assert beside.best_lag((m[:1], x[:1]), (u, y), 30) is None or len(set(u)) < len(u)
    assert beside.best_lag((m, x * 0), (u, y), 30) is None and beside.best_lag((m[:0], x[:0]), (u, y), 30) is None


def test_a_run_shuffles_readings_alone(spark):
    """Calibration, blending and meal peaks make no join on patient and minute, and shuffle no minutes."""
    a, b, meals = _series(spark), _series(spark, 7), _series(spark).where("minute % 50 = 0").select("patient_id", "minute")
    fit = U.calibrated(a, b, 60, 30)
    for df in (fit, U.fused(a, b, fit, 60), U.meal_peaks(U.minute_series(a, 10), meals)):
        assert not re.findall(r"Join \[[^\]]*minute", _plan(df))
    assert _plan(fit).count("Exchange hashpartitioning") <= 5 and _plan(U.lag_and_peaks(a, b, meals)).count("Exchange") <= 3


def test_one_pass_tells_what_the_steps_tell(spark):
    a, b, meals = _series(spark), _series(spark, 7), _series(spark).where("minute % 50 = 0").select("patient_id", "minute")
    r, s = U.minute_series(a, 10), U.minute_series(b, 20)
    want = {x.patient_id: (x.lag, None, None) for x in U.lags(r, s, 60).collect()}
    for i, series in ((1, r), (2, s)):
        for x in U.meal_peaks(series, meals, 15, 45).collect():
            want[x.patient_id] = (*want[x.patient_id][:i], x.peak, *want[x.patient_id][i + 1 :])
    got = {x.patient_id: (x.lag, x.reference_peak, x.secondary_peak) for x in U.lag_and_peaks(a, b, meals, 60, 15, 45).collect()}
    assert got == want and all(None not in v for v in got.values())


def test_peak_without_a_full_meal():
    m = np.arange(100)
    assert beside.peak((m, m * 1.0), np.array([20, 95]), 5, 10) == 10
    assert beside.peak((m, m * 1.0), np.array([98]), 5, 10) is None and beside.peak((m[:0], m[:0] * 1.0), np.array([3]), 5, 10) is None
    assert beside.peak((m, m * 1.0), np.array([], dtype=int), 5, 10) is None
