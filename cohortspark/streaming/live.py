"""The live state of every patient over a stream: state variables, a device clock, and timers between batches."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from cohortspark.streaming.state import EVICT_S, LEAST_POINTS, LEAST_SPAN_MIN, LEVELS, OFFLINE_S, PLAIN, STALE_MIN, WINDOW_MIN

SECOND = 1_000_000  # times are microseconds
DAY = 86_400 * SECOND
# Upper limits of the bands of a metric and whether the limit itself is still in the band.
LIMITS: dict[str, list[tuple[float, bool, str]]] = {
    "glucose": [(54, False, "very_low"), (70, False, "low"), (180, True, "in_range"), (250, True, "high"), (float("inf"), True, "very_high")],
    "heart_rate": [(50, False, "low"), (100, True, "normal"), (float("inf"), True, "elevated")],
    "spo2": [(90, False, "low"), (95, False, "borderline"), (float("inf"), True, "normal")],
    "mets": [(1.5, False, "sedentary"), (3, False, "light"), (6, False, "moderate"), (float("inf"), True, "vigorous")],
}
TRENDS = ((-2, "falling_fast"), (-1, "falling"), (1, "steady"), (2, "rising"))


@dataclass
class Channel:
    """The newest value of a signal, and what it says."""

    time: int
    value: float | None = None
    status: str | None = None
    until: int | None = None


@dataclass
class Live:
    """What is known of one patient. ``points`` are the glucose readings of the trend's window: (time, thousandths)."""

    channels: dict[str, Channel] = field(default_factory=dict)
    points: set[tuple[int, int]] = field(default_factory=set)
    day: int | None = None
    steps: float = 0.0

    @property
    def fit(self) -> tuple[int, int] | None:
        """Rise and run of the least-squares line, thousandths a second as whole numbers; None with too few points."""
        if len(self.points) < LEAST_POINTS:
            return None
        end = max(t for t, _ in self.points)
        x = [(t - end) // SECOND for t, _ in self.points]
        if -min(x) < 60 * LEAST_SPAN_MIN:
            return None
        y = [v for _, v in self.points]
        return len(x) * sum(a * b for a, b in zip(x, y)) - sum(x) * sum(y), len(x) * sum(a * a for a in x) - sum(x) ** 2

    @property
    def trend(self) -> str | None:
        glucose = self.channels.get("glucose")
        if glucose is None or glucose.status == "stale" or (fit := self.fit) is None:
            return None
        rise, run = fit
        return next((name for limit, name in TRENDS if 60 * rise < 1000 * limit * run), "rising_fast")

    @property
    def slope(self) -> float | None:
        if self.trend is None:
            return None
        rise, run = self.fit
        return (1 if rise >= 0 else -1) * ((12 * abs(rise) + run) // (2 * run)) / 100

    def seen(self) -> dict[str, str | None]:
        """The status of every signal that has one, and the trend."""
        out = {name: c.status for name, c in self.channels.items() if c.status is not None}
        return out | ({"glucose_trend": self.trend} if self.trend else {})

    def shown(self) -> str:
        """The state as sorted JSON, without the points of the trend."""
        out = {name: {"value": c.value, "status": c.status} for name, c in self.channels.items()}
        if "glucose" in out:
            out["glucose"] |= {"trend": self.trend, "slope": self.slope}
        if self.day is not None:
            out["steps"] = {"value": self.steps}
        return json.dumps(out, sort_keys=True)


@dataclass
class Clock:
    """Device time against wall time: where both were at the last batch, and how fast device time goes."""

    device: int
    wall: int
    rate: float = 1.0

    def observe(self, device: int, wall: int) -> None:
        """The rate moves half way to what was seen, within 0.01 and 100,000, if half a second passed and the device went on; device time never goes back."""
        passed = wall - self.wall
        if passed >= SECOND // 2 and device > self.device:
            self.rate = min(max((self.rate + (device - self.device) / passed) / 2, 0.01), 100_000.0)
        self.device, self.wall = max(device, self.device), wall

    def now(self, wall: int) -> int:
        return self.device + int(self.rate * (wall - self.wall))

    def when(self, device: int) -> int:
        """The wall time at which the device's clock passes ``device``."""
        return self.wall + int((device - self.device) / self.rate) + 1


def band(metric: str, value: float | None) -> str | None:
    if value is None:
        return None
    if metric == "activity_level":
        return LEVELS[min(max(int(value), 0), len(LEVELS) - 1)]
    return next((name for top, whole, name in LIMITS.get(metric, ()) if value < top or (whole and value == top)), None)


def _take(live: Live, name: str, metric: str, time: int, value: float | None) -> None:
    held = live.channels.get(name)
    if held is None or time >= held.time:
        live.channels[name] = Channel(time, value, band(metric, value))


def _glucose(live: Live, time: int, value: float, **_) -> None:
    _take(live, "glucose", "glucose", time, value)
    live.points.add((time, round(value * 1000)))
    first = max(t for t, _ in live.points) - 60 * WINDOW_MIN * SECOND
    live.points = {p for p in live.points if p[0] >= first}


def _steps(live: Live, time: int, value: float, **_) -> None:
    day = time // DAY
    if live.day is None or day > live.day:
        live.day, live.steps = day, 0.0
    if day == live.day:
        live.steps += value


def _sleep(live: Live, time: int, stage: str | None, until: int | None, **_) -> None:
    held = live.channels.get("sleep")
    if held is None or time >= held.time:
        live.channels["sleep"] = Channel(time, None, stage, until)


def _plain(name: str, metric: str) -> Callable:
    return lambda live, time, value, **_: _take(live, name, metric, time, value)


HANDLERS: dict[str, Callable] = {"glucose": _glucose, "steps": _steps, "sleep": _sleep, "mets": _plain("activity", "mets"), "activity_level": _plain("activity", "activity_level")}
HANDLERS |= {m: _plain(m, m) for m in ("heart_rate", "spo2", *PLAIN)}


def take(live: Live, metric: str, time: int, value: float | None = None, stage: str | None = None, until: int | None = None) -> None:
    """One reading into the state: by its metric, then the end of sleep if it came after that; others only move time."""
    if metric in HANDLERS and (value is not None or metric == "sleep"):
        HANDLERS[metric](live, time=time, value=value, stage=stage, until=until)
    sleep = live.channels.get("sleep")
    if sleep and sleep.until is not None and time > sleep.until:
        sleep.status, sleep.until = "awake", None


def deadlines(live: Live) -> dict[str, int]:
    """Device time until which each channel that can grow stale is fresh."""
    return {n: c.time + 60 * m * SECOND for n, m in STALE_MIN.items() if (c := live.channels.get(n)) and c.status != "stale"}


def grow_stale(live: Live, now: int) -> None:
    for name, end in deadlines(live).items():
        if now > end:
            live.channels[name].status = "stale"


def changes(before: dict, live: Live) -> list[tuple[str, str | None, str, float | None]]:
    """(signal, from, to, value) of each status and trend that is another than before."""
    value = lambda n: live.slope if n == "glucose_trend" else live.channels[n].value
    return [(n, before.get(n), s, value(n)) for n, s in live.seen().items() if before.get(n) != s]


OUTPUT = "patient_id long, version long, time timestamp_ntz, signal string, from_status string, to_status string, value double, streaming boolean, state string"
_COLUMNS = [c.split()[0] for c in OUTPUT.split(", ")]


def _us(x) -> int | None:
    return None if x is None or pd.isna(x) else pd.Timestamp(x).value // 1000


class Follow(StatefulProcessor):
    """One patient's state in variables of its own: channels, points of the trend, steps of the day, clock, and status.

    After a batch timers stand for the moment by the device's clock at which a channel grows stale, and for the wall
    times at which the stream counts as ended and at which the state is dropped; they go off without new readings.
    """

    def __init__(self, offline_s: float = OFFLINE_S, evict_s: float = EVICT_S):
        self.offline, self.evict = int(offline_s * 1000), int(evict_s * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.channels = handle.getMapState("channels", "signal string", "time long, value double, status string, until long")
        self.points = handle.getMapState("points", "time long, value long", "here boolean")
        self.day = handle.getValueState("day", "day long, steps double")
        self.clock = handle.getValueState("clock", "device long, wall long, rate double")
        self.status = handle.getValueState("status", "version long, streaming boolean")

    def _load(self) -> Live:
        live = Live({k[0]: Channel(*v) for k, v in self.channels.iterator()}, {(k[0], k[1]) for k in self.points.keys()})
        if self.day.exists():
            live.day, live.steps = self.day.get()
        return live

    def _store(self, live: Live) -> None:
        for name, c in live.channels.items():
            self.channels.updateValue((name,), (c.time, c.value, c.status, c.until))
        held = {(k[0], k[1]) for k in self.points.keys()}
        for p in held - live.points:
            self.points.removeKey(p)
        for p in live.points - held:
            self.points.updateValue(p, (True,))
        if live.day is not None:
            self.day.update((live.day, float(live.steps)))

    def _arm(self, live: Live, clock: Clock, idle_ms: int) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        last = clock.wall // 1000
        due = [clock.when(end) // 1000 + 1 for end in deadlines(live).values()]
        due += [last + self.offline + 1] if idle_ms <= self.offline else []
        self.handle.registerTimer(min([*due, last + self.evict + 1]))

    def _out(self, key, version: int, at: int, found: list, streaming: bool, live: Live) -> pd.DataFrame:
        rows = [(key[0], version, pd.Timestamp(at, unit="us"), *c, streaming, live.shown()) for c in found or [(None, None, None, None)]]
        return pd.DataFrame(rows, columns=_COLUMNS)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        live = self._load()
        for r in initialState.sort_values("time").to_dict("records"):
            take(live, r["metric"], _us(r["time"]), None if pd.isna(r["value"]) else r["value"], r["stage"], _us(r["until"]))
        self._store(live)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        live, wall = self._load(), timerValues.getCurrentProcessingTimeInMs() * 1000
        version, streaming = self.status.get() if self.status.exists() else (0, False)
        came = [(_us(r["time"]), r["metric"], None if pd.isna(r["value"]) else r["value"], r["stage"], _us(r["until"])) for b in rows for r in b.to_dict("records")]
        came.sort(key=lambda r: (r[0], r[1] != "sleep", r[1]))
        out = []
        for time, metric, value, stage, until in came:
            before = live.seen()
            take(live, metric, time, value, stage, until)
            out += [(time, c) for c in changes(before, live)]
        newest = max(r[0] for r in came)
        clock = Clock(*self.clock.get()) if self.clock.exists() else Clock(newest, wall)
        clock.observe(newest, wall)
        before = live.seen()
        grow_stale(live, clock.now(wall))
        out += [(clock.now(wall), c) for c in changes(before, live)]
        version += 1
        self._store(live)
        self.clock.update((clock.device, clock.wall, clock.rate))
        self.status.update((version, True))
        self._arm(live, clock, 0)
        for time, change in out:
            yield self._out(key, version, time, [change], True, live)
        if not out:
            yield self._out(key, version, newest, [], True, live)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.clock.exists():
            return
        live, clock = self._load(), Clock(*self.clock.get())
        wall = timerValues.getCurrentProcessingTimeInMs() * 1000
        version, was = self.status.get()
        idle = (wall - clock.wall) // 1000
        before, streaming = live.seen(), idle <= self.offline
        grow_stale(live, clock.now(wall))
        found = changes(before, live)
        if idle > self.evict:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            for variable in (self.channels, self.points, self.day, self.clock, self.status):
                variable.clear()
        else:
            self._store(live)
            self.status.update((version + 1, streaming))
            self._arm(live, clock, idle)
        if found or streaming != was:
            yield self._out(key, version + 1, clock.now(wall), found, streaming, live)


def follow(readings: DataFrame, known: DataFrame | None = None, offline_s: float = OFFLINE_S, evict_s: float = EVICT_S) -> DataFrame:
    """The stream of changes of every patient's state: one writer a patient, the version grows with every batch and timer that changes something.

    ``known`` are stored readings (``state.rebuilt``) from which a patient's state is made at first sight. There is no
    watermark, as late readings still count; the state holds a quarter of an hour of glucose. Needs the RocksDB state
    store (``spark.sql.streaming.stateStore.providerClass``).
    """

    def by_patient(df: DataFrame):
        return df.select(F.col("patient_id").cast("long").alias("patient_id"), "time", "metric", F.col("value").cast("double").alias("value"), "stage", "until").groupBy("patient_id")

    start = None if known is None else by_patient(known)
    return by_patient(readings).transformWithStateInPandas(Follow(offline_s, evict_s), OUTPUT, "append", "processingTime", initialState=start)
