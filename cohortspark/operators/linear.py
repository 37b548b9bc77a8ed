"""Ridge regression from sums of products: one pass over the rows, every penalty solved from one small matrix."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ALPHAS = (0.01, 0.1, 1.0, 10.0, 100.0, 1000.0)


@dataclass(frozen=True)
class Ridge:
    """Intercept and weights of ``features``; the penalty they were solved with, and the error of each that was tried."""

    features: tuple[str, ...]
    weights: tuple[float, ...]
    intercept: float
    alpha: float
    tried: tuple[tuple[float, float], ...]

    def predict(self) -> Column:
        """The prediction as a column over the features: null where one is null."""
        out = F.lit(self.intercept)
        for name, w in zip(self.features, self.weights):
            out = out + F.col(name) * w
        return out


def moments(rows: DataFrame, features: list[str], target: str, segment: str) -> DataFrame:
    """(segment, i, j, s): the sum of the product of columns i <= j in each segment; 0 stands for 1, then features, last the target.

    One aggregate over all rows; rows with a null in any column take no part. Values are summed in doubles.
    """
    names = [*features, target]
    whole = rows.where(F.col(segment).isNotNull()).dropna(subset=names)
    column = lambda i: F.lit(1.0) if i == 0 else F.col(names[i - 1]).cast("double")
    pairs = [(i, j) for i in range(len(names) + 1) for j in range(i, len(names) + 1)]
    sums = whole.groupBy(segment).agg(*[F.sum(column(i) * column(j)).alias(f"s{i}_{j}") for i, j in pairs])
    return sums.select(segment, F.inline(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"s{i}_{j}").alias("s")) for i, j in pairs])))


def solve(gram: np.ndarray, alpha: float) -> tuple[np.ndarray, float]:
    """Weights and intercept from the products of (1, features, target): features are scaled to variance 1 and penalised, the intercept is not."""
    n = gram[0, 0]
    mean = gram[0, 1:] / n
    cov = gram[1:, 1:] / n - np.outer(mean, mean)
    scale = np.sqrt(np.maximum(np.diag(cov)[:-1], 0))
    scale[scale < 1e-12 * (1 + np.abs(mean[:-1]))] = 0
    use = np.flatnonzero(scale)  # a constant column says nothing
    z = cov[np.ix_(use, use)] / np.outer(scale[use], scale[use])
    w = np.zeros(len(scale))
    w[use] = np.linalg.solve(z + np.eye(len(use)) * alpha / n, cov[use, -1] / scale[use]) / scale[use]
    return w, float(mean[-1] - mean[:-1] @ w)


def error(gram: np.ndarray, w: np.ndarray, b: float) -> float:
    """Root mean squared error on the rows whose products are ``gram``, without looking at them again."""
    v = np.concatenate([[b], w, [-1.0]])
    return float(np.sqrt(max(v @ gram @ v, 0.0) / gram[0, 0]))


def ridge(rows: DataFrame, features: list[str], target: str, segment: str, fit: str = "fit", choose: str = "validate", alphas: tuple[float, ...] = ALPHAS) -> tuple[Ridge, dict[str, float]]:
    """The ridge regression of the segment ``fit`` with the penalty that is best on ``choose``, and its error by segment.

    The driver gets one number a segment and pair of columns. Of equally good penalties the smallest is taken; without
    rows to choose on the first. No rows to fit on are an error.
    """
    size = len(features) + 2
    grams: dict[str, np.ndarray] = {}
    for r in moments(rows, features, target, segment).collect():
        g = grams.setdefault(r[segment], np.zeros((size, size)))
        g[r["i"], r["j"]] = g[r["j"], r["i"]] = r["s"]
    if fit not in grams:
        raise ValueError(f"no rows in the segment {fit}")
    found = [(a, *solve(grams[fit], a)) for a in alphas]
    tried = tuple((a, error(grams[choose], w, b)) if choose in grams else (a, 0.0) for a, w, b in found)
    best = min(range(len(alphas)), key=lambda i: (tried[i][1], alphas[i]) if choose in grams else (i, 0))
    alpha, w, b = found[best]
    return Ridge(tuple(features), tuple(map(float, w)), b, alpha, tried), {s: error(g, w, b) for s, g in grams.items()}


def by_time(rows: DataFrame, key: str, time: str, shares: tuple[float, float] = (0.7, 0.85)) -> DataFrame:
    """``rows`` with ``segment``: fit, validate and test by the place of their time between the first and last of their key."""
    ends = rows.groupBy(key).agg(F.min(time).alias("first"), F.max(time).alias("last"))
    place = (F.col(time) - F.col("first")) / F.greatest(F.col("last") - F.col("first"), F.lit(1))
    return rows.join(ends, key).withColumn("segment", F.when(place < shares[0], "fit").when(place < shares[1], "validate").otherwise("test")).drop("first", "last")
