"""The live state: by handlers, with a clock in hand, over a stream, and as a batch fold."""

import datetime as dt
import json
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortspark.streaming import live as L
from cohortspark.streaming import state as S

NOON = dt.datetime(2031, 3, 4, 12)
MIN = 60 * L.SECOND
SCHEMA = "patient_id long, time timestamp_ntz, metric string, value double, stage string, until timestamp_ntz"


def us(minute):
    return int((NOON - dt.datetime(1970, 1, 1)).total_seconds()) * L.SECOND + int(minute * MIN)


def after(*readings):
    live = L.Live()
    for minute, metric, value in readings:
        L.take(live, metric, us(minute), value)
    return live


@pytest.mark.parametrize("slope,name", [(-2.5, "falling_fast"), (-2, "falling"), (-1.5, "falling"), (-1, "steady"), (0, "steady"), (1, "rising"), (1.5, "rising"), (2, "rising_fast")])
def test_slopes_on_the_limits_in_any_order(spark, slope, name):
    points = [(m, 140.1 + slope * m) for m in (0, 3, 7, 11, 13)]
    rows = [(p, NOON + dt.timedelta(minutes=m), "glucose", v, None, None) for p in range(6) for m, v in random.Random(p).sample(points, len(points))]
    for r in S.trend(spark.createDataFrame(rows, SCHEMA)).collect():
        assert (r.slope, r.trend) == (slope, name)
    for seed in range(6):
        live = after(*[(m, "glucose", v) for m, v in random.Random(seed).sample(points, len(points))])
        assert (live.slope, live.trend) == (slope, name)


def test_too_few_points_or_too_short():
    assert after((0, "glucose", 90), (12, "glucose", 99)).trend is None
    assert after((0, "glucose", 90), (4, "glucose", 95), (9.9, "glucose", 99)).trend is None
    assert after((0, "glucose", 90), (4, "glucose", 95), (10, "glucose", 99)).trend == "steady"


def test_a_late_reading_bends_the_trend_only():
    live = after((0, "glucose", 110), (13, "glucose", 130), (6, "glucose", 260))
    assert live.channels["glucose"].value == 130 and live.channels["glucose"].status == "in_range" and len(live.points) == 3
    L.take(live, "glucose", us(40), 75)
    assert live.points == {(us(40), 75000)} and live.trend is None


def test_steps_belong_to_the_newest_day():
    live = after((0, "steps", 31), (7, "steps", 12), (-3, "steps", 5), (-26 * 60, "steps", 4000))
    assert live.steps == 48
    L.take(live, "steps", us(13 * 60), 9)
    assert live.steps == 9


def test_sleep_ends_with_a_reading_after_it():
    live = L.Live()
    L.take(live, "sleep", us(0), stage="rem", until=us(45))
    L.take(live, "spo2", us(45), 97)
    assert live.channels["sleep"].status == "rem"
    L.take(live, "unknown", us(46), 1)
    assert live.channels["sleep"].status == "awake"


def test_bands_at_their_limits():
    assert [L.band("glucose", v) for v in (53.9, 54, 70, 180, 180.1, 250, 250.1)] == ["very_low", "low", "in_range", "in_range", "high", "high", "very_high"]
    assert [L.band("heart_rate", v) for v in (49, 50, 100, 101)] == ["low", "normal", "normal", "elevated"]
    assert [L.band("activity_level", v) for v in (-1, 2.7, 9)] == ["sedentary", "moderate", "vigorous"] and L.band("eda", 3) is None


def test_clock():
    clock = L.Clock(us(0), 1000)
    clock.observe(us(2), 1000 + L.SECOND)
    assert clock.rate == (1 + 120) / 2
    clock.observe(us(3), 1000 + L.SECOND + 1000)  # too soon to tell
    assert clock.rate == 60.5 and clock.device == us(3)
    clock.observe(us(1), 1000 + 9 * L.SECOND)
    assert clock.device == us(3) and clock.wall == 1000 + 9 * L.SECOND and clock.now(clock.wall + L.SECOND) == us(3) + 60_500_000
    assert clock.now(clock.when(us(10))) >= us(10)


class _Value:
    def __init__(self):
        self.v = None

    exists = lambda self: self.v is not None
    get = lambda self: self.v

    def update(self, v):
        self.v = v

    def clear(self):
        self.v = None


class _Map(dict):
    iterator = lambda self: iter(list(self.items()))
    updateValue = dict.__setitem__
    removeKey = dict.__delitem__


class _Handle:
    """State and timers in memory; the test turns the clock."""

    def __init__(self):
        self.timers, self.wall = set(), 0

    getMapState = lambda self, *a: _Map()
    getValueState = lambda self, *a: _Value()
    listTimers = lambda self: iter(list(self.timers))

    def registerTimer(self, t):
        self.timers.add(t)

    def deleteTimer(self, t):
        self.timers.discard(t)

    def getCurrentProcessingTimeInMs(self):
        return self.wall

    def until(self, processor, wall):
        out = []
        while self.timers and min(self.timers) <= wall:
            self.wall = min(self.timers)
            self.timers.discard(self.wall)
            out += [(self.wall, r) for f in processor.handleExpiredTimer((1,), self, None) for r in f.to_dict("records")]
        self.wall = wall
        return out


def batch(*rows):
    return iter([pd.DataFrame([(NOON + dt.timedelta(minutes=m), k, v, None, None) for m, k, v in rows], columns=["time", "metric", "value", "stage", "until"])])


def test_timers_between_batches():
    handle, p = _Handle(), L.Follow()
    p.init(handle)
    first = [r for f in p.handleInputRows((1,), batch((0, "glucose", 120.0), (0, "heart_rate", 71.0)), handle) for r in f.to_dict("records")]
    assert {(r["signal"], r["to_status"]) for r in first} == {("glucose", "in_range"), ("heart_rate", "normal")}
    handle.until(p, 1000)
    list(p.handleInputRows((1,), batch((1, "glucose", 121.0)), handle))  # a minute of device time in a second: rate 30.5
    got = handle.until(p, 700_000)
    said = [(round(w / 1000), r["signal"], r["to_status"], r["streaming"]) for w, r in got]
    # heart rate is stale 9 device minutes later, at 1 + 540 / 30.5 s; glucose 15 minutes later, at 1 + 900 / 30.5 s; offline after 60 s
    assert said[:2] == [(19, "heart_rate", "stale", True), (31, "glucose", "stale", True)]
    assert said[2][:2] == (61, None) and said[2][3] is False and len(said) == 3
    assert not handle.timers and not p.channels and not p.clock.exists() and not p.status.exists()  # dropped after ten minutes
    again = [r for f in p.handleInputRows((1,), batch((90, "glucose", 60.0)), handle) for r in f.to_dict("records")]
    assert again[0]["version"] == 1 and again[0]["to_status"] == "low"


def test_stored_readings_come_first():
    handle, p = _Handle(), L.Follow()
    p.init(handle)
    p.handleInitialState((1,), next(batch((-10, "glucose", 100.0), (-5, "glucose", 112.0), (-1, "steps", 30.0))), handle)
    rows = [r for f in p.handleInputRows((1,), batch((0, "glucose", 126.0), (1, "steps", 4.0)), handle) for r in f.to_dict("records")]
    state = json.loads(rows[-1]["state"])
    assert state["glucose"]["trend"] == "rising_fast" and state["steps"]["value"] == 34


@pytest.fixture()
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_batch_fold_and_stream_agree(rocks, tmp_path):
    spark, rng, rows = rocks, random.Random(3), []
    for p in (1, 2, 3):
        for i in range(40):
            rows.append((p, NOON + dt.timedelta(minutes=4 * i), "glucose", float(rng.randrange(40, 300)), None, None))
            rows.append((p, NOON + dt.timedelta(minutes=4 * i + 1), rng.choice(["heart_rate", "steps", "spo2", "mets"]), float(rng.randrange(1, 120)), None, None))
    for k in range(3):  # three files, three batches; late rows are in the last
        part = [r for i, r in enumerate(rows) if (k == 2) == (i % 7 == 3) and (k == 2 or (i < len(rows) // 2) == (k == 0))]
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = L.follow(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(processingTime="0 seconds").start()
    ends = dt.datetime.now() + dt.timedelta(seconds=150)
    try:  # timers keep the query going; it is stopped once a batch after the last row is done
        while dt.datetime.now() < ends and not (sum(p.numInputRows for p in q.recentProgress) >= len(rows) and q.lastProgress.numInputRows == 0):
            q.awaitTermination(1)
    finally:
        q.stop()
    out = spark.read.parquet(str(tmp_path / "out")).collect()
    assert {r.patient_id for r in out} == {1, 2, 3}
    want = {r.patient_id: r for r in S.snapshot(spark.createDataFrame(rows, SCHEMA), F.lit(max(r[1] for r in rows))).collect()}
    for p in (1, 2, 3):
        last = json.loads(max((r for r in out if r.patient_id == p), key=lambda r: r.version).state)
        w = want[p]
        assert (last["glucose"]["value"], last["steps"]["value"], last["activity"]["value"]) == (w.glucose_value, w.steps, w.activity_value)
        assert w.trend is None or (last["glucose"]["trend"], last["glucose"]["slope"]) == (w.trend, w.slope)
    versions = sorted({r.version for r in out if r.patient_id == 1})
    assert versions == list(range(1, versions[-1] + 1))


def test_a_stream_says_stale_and_offline_without_new_rows(rocks, tmp_path):
    spark = rocks
    old = [(5, NOON - dt.timedelta(minutes=m), "glucose", 100.0 + m, None, None) for m in (10, 5)]
    spark.createDataFrame([(5, NOON, "glucose", 111.0, None, None)], SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    live = L.follow(stream, spark.createDataFrame(old, SCHEMA), offline_s=3, evict_s=900)
    q = live.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(processingTime="1 second").start()
    try:
        ends = dt.datetime.now() + dt.timedelta(seconds=90)
        rows = []
        while dt.datetime.now() < ends and not any(r.streaming is False for r in rows):
            q.awaitTermination(3)
            try:
                rows = spark.read.parquet(str(tmp_path / "out")).collect()
            except Exception:  # nothing written yet
                rows = []
    finally:
        q.stop()
    assert any(r.signal == "glucose_trend" for r in rows) and any(r.streaming is False and r.signal is None for r in rows)
