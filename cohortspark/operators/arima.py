"""ARIMA forecasts of every series: exact Gaussian likelihood by a Kalman filter, the order by AIC, all series at once."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Points at the end of a series that a model is fitted on; a series of fewer than LEAST points has no forecast.
FIT_POINTS, LEAST = 288, 24
ORDERS = tuple((p, d, q) for p, d, q in product((0, 1, 2), (0, 1), (0, 1, 2)) if p + q)


@dataclass
class Model:
    """Coefficients of (1 - ar)(difference) x = (1 + ma) noise around ``mean`` (of the differences)."""

    d: int
    ar: np.ndarray
    ma: np.ndarray
    mean: float
    variance: float
    loglik: float = 0.0

    @property
    def aic(self) -> float:
        return 2 * (len(self.ar) + len(self.ma) + 2) - 2 * self.loglik


def stable(partial: np.ndarray) -> np.ndarray:
    """Coefficients of a stationary autoregression from any real numbers, as partial autocorrelations (Durbin, Levinson)."""
    out = np.zeros(0)
    for r in np.tanh(partial):
        out = np.append(out - r * out[::-1], r)
    return out


def _system(ar: np.ndarray, ma: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Transition, noise loading, and the stationary covariance of the state for a noise of variance 1."""
    r = max(len(ar), len(ma) + 1)
    t = np.eye(r, k=1)
    t[: len(ar), 0] = ar
    load = np.zeros(r)
    load[: len(ma) + 1] = np.append(1.0, ma)
    cov = np.linalg.solve(np.eye(r * r) - np.kron(t, t), np.outer(load, load).ravel()).reshape(r, r)
    return t, load, cov


def _filtered_small(x: list[float], t: np.ndarray, load: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``filtered`` for states of one or two numbers, on plain numbers: after a missing value the covariance moves for many steps."""
    r = len(t)
    f0, f1 = float(t[0, 0]), float(t[1, 0]) if r > 1 else 0.0
    n0, n1 = float(load[0]), float(load[1]) if r > 1 else 0.0
    n00, n01, n11 = n0 * n0, n0 * n1, n1 * n1
    p00, p01, p11 = float(p[0, 0]), float(p[0, 1]) if r > 1 else 0.0, float(p[1, 1]) if r > 1 else 0.0
    a0 = a1 = size = g1 = 0.0
    errors, sizes = [np.nan] * len(x), [np.nan] * len(x)
    steady = False
    for i, v in enumerate(x):
        known = v == v
        if not (steady and known):
            q00, q01, q11 = p00, p01, p11
            if known:
                size, g1 = p00, p01 / p00
                q00, q01, q11 = 0.0, 0.0, p11 - g1 * p01
            w00, w01, w11 = p00, p01, p11
            p00, p01, p11 = f0 * (f0 * q00 + 2 * q01) + q11 + n00, f1 * (f0 * q00 + q01) + n01, f1 * f1 * q00 + n11
            steady = known and max(abs(p00 - w00), abs(p01 - w01), abs(p11 - w11)) <= 1e-13 * size
        if known:
            e = errors[i] = v - a0
            sizes[i] = size
            a0, a1 = v, a1 + g1 * e
        a0, a1 = f0 * a0 + a1, f1 * a0
    return np.array(errors), np.array(sizes), np.array([a0, a1][:r]), np.array([[p00, p01], [p01, p11]])[:r, :r]


def filtered(x: np.ndarray, ar: np.ndarray, ma: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(errors, their variances, last state, its covariance) of one-step predictions of x with mean 0; NaN is missing.

    Once the covariance no longer changes, only the state moves on, until a value is missing.
    """
    t, load, p = _system(ar, ma)
    noise, r = np.outer(load, load), len(t)
    if r <= 2:
        return _filtered_small(np.asarray(x, float).tolist(), t, load, p)
    first = t[:, 0].tolist()
    a = [0.0] * r
    errors, sizes = [np.nan] * len(x), [np.nan] * len(x)
    steady = False
    gain: list[float] = []
    size = 0.0
    for i, v in enumerate(np.asarray(x, float).tolist()):
        known = v == v
        if not (steady and known):
            was = p
            if known:
                size = float(p[0, 0])
                g = p[:, 0] / size
                gain = g.tolist()
                p = p - np.outer(g, p[0])
            p = t @ p @ t.T + noise
            steady = known and bool(np.abs(p - was).max() <= 1e-13 * size)
        if known:
            e = errors[i] = v - a[0]
            sizes[i] = size
            a = [b + g * e for b, g in zip(a, gain)]
        a = [f * a[0] + (a[k + 1] if k + 1 < r else 0.0) for k, f in enumerate(first)]
    return np.array(errors), np.array(sizes), np.array(a), p


def loglik(x: np.ndarray, ar: np.ndarray, ma: np.ndarray, variance: float | None = None) -> tuple[float, float]:
    """(log likelihood, variance); without a variance the best one."""
    e, f, _, _ = filtered(x, ar, ma)
    here = ~np.isnan(e)
    n, total = here.sum(), float((e[here] ** 2 / f[here]).sum())
    s2 = variance if variance is not None else max(total / n, 1e-12)
    return -0.5 * (n * np.log(2 * np.pi * s2) + np.log(f[here]).sum() + total / s2), s2


def _simplex(cost, start: np.ndarray, steps: int = 120) -> np.ndarray:
    """Nelder and Mead's search from ``start``."""
    points = [start] + [start + 0.4 * row for row in np.eye(len(start))]
    values = [cost(p) for p in points]
    for _ in range(steps):
        order = np.argsort(values, kind="stable")
        points, values = [points[i] for i in order], [values[i] for i in order]
        if values[-1] - values[0] < 1e-6:
            break
        middle = np.mean(points[:-1], axis=0)
        tries = [middle + k * (middle - points[-1]) for k in (1.0, 2.0, -0.5)]
        got = [cost(tries[0])]
        if got[0] < values[0]:
            got.append(cost(tries[1]))
        elif got[0] >= values[-2]:
            got += [np.inf, cost(tries[2])]
        best = int(np.argmin(got))
        if got[best] < values[-1]:
            points[-1], values[-1] = tries[best], got[best]
        else:
            points = [points[0]] + [(points[0] + p) / 2 for p in points[1:]]
            values = [values[0]] + [cost(p) for p in points[1:]]
    return points[int(np.argmin(values))]


def fit(x: np.ndarray, order: tuple[int, int, int]) -> Model:
    """The model of an order with the greatest exact likelihood; differences of missing values are missing."""
    p, d, q = order
    y = np.diff(x, n=d) if d else np.asarray(x, float)
    mean = float(np.nanmean(y)) if not d else 0.0
    parts = lambda v: (stable(v[:p]), -stable(v[p:]))  # noqa: E731  an invertible moving average
    best = _simplex(lambda v: -loglik(y - mean, *parts(v))[0], np.zeros(p + q))
    ar, ma = parts(best)
    value, s2 = loglik(y - mean, ar, ma)
    return Model(d, ar, ma, mean, s2, value)


def choose(x: np.ndarray, orders=ORDERS) -> Model:
    """The order with the least AIC; likelihoods of one and no difference are of as many values."""
    most = max(d for _, d, _ in orders)
    return min((fit(x[most - o[1] :], o) for o in orders), key=lambda m: m.aic)


def forecast(x: np.ndarray, m: Model, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """(means, standard deviations) of the next values, without fitting again."""
    y = np.diff(x, n=m.d) if m.d else np.asarray(x, float)
    t, load, _ = _system(m.ar, m.ma)
    _, _, a, _ = filtered(y - m.mean, m.ar, m.ma)
    means, weights = [], [load]
    for _ in range(steps):
        means.append(a[0] + m.mean)
        a = t @ a
        weights.append(t @ weights[-1])
    means, psi = np.array(means), np.array([w[0] for w in weights[:steps]])
    for _ in range(m.d):  # sums of differences from the last value on
        means, psi = x[~np.isnan(x)][-1] + np.cumsum(means), np.cumsum(psi)
    return means, np.sqrt(m.variance * np.cumsum(psi**2))


def forecasts(series: DataFrame, steps: int = 12, points: int = FIT_POINTS, orders=ORDERS) -> DataFrame:
    """(patient_id, p, d, q, step, mean, sd) of series (patient_id, place, value): places are whole numbers of even steps.

    Only the last ``points`` places of a patient reach the task that fits them, however long the series; places without
    a row are missing values, several rows of a place count with their mean. A series with fewer than LEAST values, or
    without any change, has no rows; null ids are a series.
    """
    kind = dict(series.dtypes)["patient_id"]

    def each(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        place = rows["place"].to_numpy() - rows["place"].min()
        x = np.full(place.max() + 1, np.nan)
        x[place] = rows["value"].to_numpy(float)
        out = []
        if len(rows) >= LEAST and np.nanstd(x) > 0:
            m = choose(x, orders)
            out = [(key[0], len(m.ar), m.d, len(m.ma), i + 1, a, s) for i, (a, s) in enumerate(zip(*forecast(x, m, steps)))]
        return pd.DataFrame(out, columns=["patient_id", "p", "d", "q", "step", "mean", "sd"])

    rows = series.where("value is not null and place is not null").select("patient_id", F.col("place").cast("long").alias("place"), F.col("value").cast("double").alias("value"))
    ends = rows.groupBy(F.col("patient_id").alias("of")).agg(F.max("place").alias("end"))
    tasks = max(4 * series.sparkSession.sparkContext.defaultParallelism, int(series.sparkSession.conf.get("spark.sql.shuffle.partitions")))  # fits cost far more than their rows' bytes say
    few = rows.join(ends, F.col("patient_id").eqNullSafe(F.col("of"))).where(F.col("place") > F.col("end") - points)
    return few.groupBy("patient_id", "place").agg(F.avg("value").alias("value")).repartition(tasks, "patient_id").groupBy("patient_id").applyInPandas(each, f"patient_id {kind}, p int, d int, q int, step int, mean double, sd double")
