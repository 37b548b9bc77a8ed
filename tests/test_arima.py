"""Kalman likelihoods against dense Gaussians, forecasts against closed forms."""

import numpy as np
import pytest

from cohortspark.operators import arima as A


def series(ar, ma, n, seed):
    rng = np.random.default_rng(seed)
    e = rng.normal(size=n + 100)
    x = np.zeros(n + 100)
    for t in range(2, n + 100):
        x[t] = sum(a * x[t - 1 - i] for i, a in enumerate(ar)) + e[t] + sum(b * e[t - 1 - i] for i, b in enumerate(ma))
    return x[100:]


def covariance(ar, ma, n):
    """From a long moving average."""
    psi = np.zeros(4000)
    for j in range(4000):
        psi[j] = (1.0 if j == 0 else ma[j - 1] if j <= len(ma) else 0.0) + sum(a * psi[j - 1 - i] for i, a in enumerate(ar) if j > i)
    gamma = np.array([psi[: 4000 - k] @ psi[k:] for k in range(n)])
    return gamma[np.abs(np.arange(n)[:, None] - np.arange(n)[None, :])]


@pytest.mark.parametrize("ar,ma", [([0.7], []), ([], [0.4]), ([0.5, -0.3], [0.6]), ([0.2], [0.5, -0.2])])
def test_likelihood_is_the_dense_gaussian(ar, ma):
    x = series(ar, ma, 12, 3)
    x[[4, 7]] = np.nan
    here = ~np.isnan(x)
    s = 1.7 * covariance(ar, ma, 12)[np.ix_(here, here)]
    want = -0.5 * (here.sum() * np.log(2 * np.pi) + np.linalg.slogdet(s)[1] + x[here] @ np.linalg.solve(s, x[here]))
    assert np.isclose(A.loglik(x, np.array(ar), np.array(ma), 1.7)[0], want, rtol=1e-7)


def test_forecast_of_a_known_first_order():
    x = 50 + series([0.8], [], 60, 1)
    means, sds = A.forecast(x, A.Model(0, np.array([0.8]), np.zeros(0), 50.0, 4.0), 5)
    h = np.arange(1, 6)
    assert np.allclose(means, 50 + 0.8**h * (x[-1] - 50)) and np.allclose(sds, 2 * np.sqrt((1 - 0.64**h) / 0.36))


def test_forecast_of_a_random_walk():
    x = np.cumsum(series([], [], 50, 2))
    means, sds = A.forecast(x, A.Model(1, np.zeros(0), np.zeros(0), 0.0, 9.0), 4)
    assert np.allclose(means, x[-1]) and np.allclose(sds, 3 * np.sqrt(np.arange(1, 5)))


def test_fit_finds_the_coefficients():
    m = A.fit(10 + series([0.8], [], 600, 4), (1, 0, 0))
    assert abs(m.ar[0] - 0.8) < 0.08 and abs(m.variance - 1) < 0.2 and abs(m.mean - 10) < 0.8
    assert abs(A.fit(series([], [0.6], 600, 5), (0, 0, 1)).ma[0] - 0.6) < 0.1
    assert A.choose(np.cumsum(series([], [0.5], 250, 6)), ((1, 0, 0), (0, 1, 1), (1, 1, 0))).d == 1


def test_series_of_all_patients(spark):
    rows = [(p, i, float(100 + v)) for p in (1, 2) for i, v in enumerate(series([0.7], [], 80, p))]
    rows += [(1, 85, None), (3, 0, 5.0)] + [(4, i, 7.0) for i in range(50)]
    rows = [r for r in rows if r[:2] != (2, 70)]  # a gap
    df = spark.createDataFrame(rows, "patient_id long, place long, value double")
    got = A.forecasts(df, steps=3, points=60, orders=((1, 0, 0), (0, 1, 1))).collect()
    assert sorted((r.patient_id, r.step) for r in got) == [(p, s) for p in (1, 2) for s in (1, 2, 3)]
    x = np.array([dict((i, v) for p, i, v in rows if p == 2).get(i, np.nan) for i in range(20, 80)])
    means, sds = A.forecast(x, A.choose(x, ((1, 0, 0), (0, 1, 1))), 3)
    assert np.allclose([r["mean"] for r in sorted(got, key=lambda r: r.step) if r.patient_id == 2], means)


@pytest.mark.parametrize("ar,ma", [([0.6], []), ([0.5, -0.3], []), ([], [0.4]), ([0.7], [-0.5])])
def test_small_states_are_filtered_as_others(ar, ma):
    rng = np.random.default_rng(7)
    x = rng.normal(size=120)
    x[::17] = np.nan
    x[40:44] = np.nan
    small = A.filtered(x, np.array(ar), np.array(ma))
    large = A.filtered(x, np.array([*ar, *[0.0] * (3 - len(ar))]), np.array(ma))  # the same model with a state of three
    for s, w in zip(small[:2], large[:2]):
        np.testing.assert_allclose(s, w, rtol=1e-9, atol=1e-9)
    np.testing.assert_allclose(small[2], large[2][: len(small[2])], rtol=1e-9, atol=1e-9)


def test_fits_are_dealt_to_many_tasks(spark):
    df = spark.createDataFrame([(p, i, float((i * 7 + p) % 13)) for p in range(40) for i in range(30)], "patient_id long, place long, value double")
    assert A.forecasts(df, 2, orders=((1, 0, 0),)).rdd.getNumPartitions() >= 16
