"""What one patient's two series, or series and meals, say of each other: plain arrays inside a task, in time linear in the series."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Minutes that are laid out densely at once, whatever pauses a series has.
BLOCK = 1440
#: Correlations this near to the greatest are worked out again, pair by pair.
NEAR = 1e-6

Series = tuple[np.ndarray, np.ndarray]


def rounded(x: np.ndarray, digits: int = 9) -> np.ndarray:
    return np.sign(x) * (np.floor(np.abs(x) * 10**digits + 0.5) / 10**digits) + 0.0


def minute_values(series: Series, max_gap: int) -> Series:
    """One value a minute between readings at most ``max_gap`` minutes apart, on the line between them."""
    m, x = series
    gap = np.append(np.diff(m), 1)[: len(m)]
    n = np.where(gap <= max_gap, gap, 1)
    i, of = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n), np.repeat(np.arange(len(m)), n)
    rise = np.append(np.diff(x), 0.0)[: len(m)]
    return m[of] + i, np.where(i == 0, x[of], x[of] + rise[of] * i / gap[of])


def _matches(at: np.ndarray, minutes: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) of all pairs in which the sorted ``minutes[j]`` is from ``at[i] + low`` to ``at[i] + high``."""
    first = np.searchsorted(minutes, at + low, "left")
    n = np.searchsorted(minutes, at + high, "right") - first
    return np.repeat(np.arange(len(at)), n), np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())


def _r(a: np.ndarray, b: np.ndarray) -> float:
    if len(a) < 2 or np.ptp(a) == 0 or np.ptp(b) == 0:
        return np.nan
    a, b = a - a.mean(), b - b.mean()
    return float((a * b).sum() / np.sqrt((a * a).sum() * (b * b).sum()))


def best_lag(a: Series, b: Series, reach: int) -> tuple[int, float] | None:
    """(lag, r) of the greatest correlation of a value with that ``lag`` minutes later, the first of equal ones to nine digits.

    Sums of all lags come from cross-correlations of blocks; lags near the greatest, or with hardly any spread, are
    then worked out from their pairs.
    """
    (m, x), (u, y) = a, b
    if not len(m) or not len(u):
        return None
    dx, dy = x - x.mean(), y - y.mean()
    total = np.zeros((6, 2 * reach + 1))
    for start in np.unique(m // BLOCK) * BLOCK:
        i = slice(*np.searchsorted(m, [start, start + BLOCK]))
        start, end = m[i][0], m[i][-1] + 1
        j = slice(*np.searchsorted(u, [start - reach, end + reach]))
        dense = lambda at, n, w: [np.bincount(at, w * 0 + 1, n), np.bincount(at, w, n), np.bincount(at, w * w, n)]
        one, p, pp = dense(m[i] - start, end - start, dx[i])
        uno, q, qq = dense(u[j] - (start - reach), end - start + 2 * reach, dy[j])
        total += [np.correlate(v, w, "valid") for v, w in ((uno, one), (uno, p), (q, one), (uno, pp), (qq, one), (q, p))]
    n, sx, sy, xx, yy, xy = total
    n = np.rint(n)
    with np.errstate(all="ignore"):
        vx, vy = xx - sx * sx / n, yy - sy * sy / n
        r = (xy - sx * sy / n) / np.sqrt(vx * vy)
    vague = (n > 1) & ~((vx > 1e-8 * xx) & (vy > 1e-8 * yy))
    sure = (n > 1) & ~vague
    again = np.flatnonzero(vague | (sure & (r >= np.max(r[sure], initial=-2.0) - NEAR)))
    exact = []
    for k in again:
        i, j = _matches(m, u, k - reach, k - reach)
        exact.append(_r(x[i], y[j]))
    exact = rounded(np.array(exact))
    if not np.isfinite(exact).any():
        return None
    k = int(np.nanargmax(exact))
    return int(again[k]) - reach, float(exact[k])


def peak(series: Series, meals: np.ndarray, before: int, after: int) -> int | None:
    """Minutes from a meal to the top of the mean rise over the meals of whose minutes more than nine tenths have a value."""
    minutes, values = series
    i, j = _matches(meals, minutes, -before, after)
    off, v = minutes[j] - meals[i], values[j]
    full = np.bincount(i, minlength=len(meals)) > 0.9 * (before + after + 1)
    with np.errstate(all="ignore"):
        base = np.bincount(i[off <= 0], v[off <= 0], len(meals)) / np.bincount(i[off <= 0], minlength=len(meals))
        use = full[i] & np.isfinite(base[i])
        at, width = off[use] + before, before + after + 1
        rise = np.bincount(at, v[use] - base[i[use]], width) / np.bincount(at, minlength=width)
    return int(np.nanargmax(rounded(rise))) - before if use.any() else None


def by_patient(parts: dict[str, DataFrame], key: str, tell: Callable[..., tuple | None], out: str) -> DataFrame:
    """(key, ``out``) that ``tell`` says of each key's (minutes, values), sorted by minute, of every part; none if it is None or the key is null.

    ``parts`` are (key, minute, value). Rows that are dealt by the key already are packed and put beside each other where they are.
    """
    packed = None
    for name, df in parts.items():
        points = F.collect_list(F.struct(F.col("minute").cast("long").alias("m"), F.col("value").cast("double").alias("x")))
        one = df.where(F.col(key).isNotNull() & F.col("minute").isNotNull() & F.col("value").isNotNull()).groupBy(key).agg(points.alias(name))
        packed = one if packed is None else packed.unionByName(one, allowMissingColumns=True)
    packed = packed.groupBy(key).agg(*[F.coalesce(F.first(n, True), F.array().cast("array<struct<m: bigint, x: double>>")).alias(n) for n in parts])
    schema = f"{key} {dict(packed.dtypes)[key]}, {out}"
    names = [f.split()[0] for f in out.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = []
            for n in parts_named:
                c = batch.column(n)
                columns.append((c.offsets.to_numpy(), c.values.field("m").to_numpy(zero_copy_only=False), c.values.field("x").to_numpy(zero_copy_only=False)))
            at, told = [], []
            for i in range(batch.num_rows):
                series = []
                for o, m, x in columns:
                    m, x = m[o[i] : o[i + 1]], x[o[i] : o[i + 1]]
                    order = np.argsort(m, kind="stable")
                    series.append((m[order], x[order]))
                if (got := tell(*series)) is not None:
                    at.append(i)
                    told.append(got)
            kept = batch.column(key).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([kept, *[pa.array([t[k] for t in told], types[k]) for k in range(len(names))]], [key, *names])

    parts_named = list(parts)
    types = [{"int": pa.int32(), "double": pa.float64()}[f.split()[1]] for f in out.split(", ")]
    return packed.mapInArrow(run, schema)
