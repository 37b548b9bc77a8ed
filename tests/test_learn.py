"""Ridge from sums of products, and kept rollups."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortspark.operators import linear, rollup


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(0, [1, 10, 0.1], (400, 3))
    y = 3 + x @ [2.0, -0.5, 4.0] + rng.normal(0, 0.3, 400)
    names = np.array(["fit", "validate", "test"])[rng.choice(3, 400, p=[0.6, 0.2, 0.2])]
    data = [(n, *map(float, v), 7.0, float(t)) for n, v, t in zip(names, x, y)]
    return data, spark.createDataFrame(data + [(None, 1.0, 1.0, 1.0, 7.0, 1.0), ("fit", None, 1.0, 1.0, 7.0, 1.0), ("fit", 1.0, 1.0, 1.0, 7.0, None)], "segment string, a double, b double, c double, same double, target double")


@pytest.mark.parametrize("alpha", [0.01, 1.0, 50.0])
def test_ridge_is_the_normal_equations(rows, alpha):
    data, df = rows
    model, errors = linear.ridge(df, ["a", "b", "c", "same"], "target", "segment", alphas=(alpha,))
    part = np.array([r[1:] for r in data if r[0] == "fit"])
    x, y = part[:, :3], part[:, -1]
    z = (x - x.mean(0)) / x.std(0)
    w = np.linalg.solve(z.T @ z + alpha * np.eye(3), z.T @ (y - y.mean())) / x.std(0)
    assert np.allclose(model.weights[:3], w, rtol=1e-8) and model.weights[3] == 0
    assert np.isclose(model.intercept, y.mean() - x.mean(0) @ w)
    test = np.array([r[1:] for r in data if r[0] == "test"])
    want = np.sqrt(np.mean((test[:, :3] @ w + model.intercept - test[:, -1]) ** 2))
    assert np.isclose(errors["test"], want, rtol=1e-6)
    got = df.where("segment = 'test'").select(F.sqrt(F.avg(F.pow(model.predict() - F.col("target"), 2)))).first()[0]
    assert np.isclose(got, want, rtol=1e-6)


def test_the_penalty_is_chosen_without_another_pass(rows):
    data, df = rows
    model, _ = linear.ridge(df, ["a", "b", "c"], "target", "segment")
    assert model.alpha == min(model.tried, key=lambda t: (t[1], t[0]))[0] and len(model.tried) == len(linear.ALPHAS)
    plan = linear.moments(df, ["a", "b", "c"], "target", "segment")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan ") == 1
    with pytest.raises(ValueError):
        linear.ridge(df.where("false"), ["a"], "target", "segment")


READ = "device_id long, time timestamp_ntz, value double"
START = dt.datetime(2031, 5, 1)


def readings(seed, n=900):
    rng = random.Random(seed)
    return [(rng.randrange(4), START + dt.timedelta(minutes=rng.randrange(6 * 1440)), float(rng.randrange(40, 300))) for _ in range(n)]


def flat(df):
    cells = df.select("device_id", "day", "n", "total", "squares", "low", "high")
    return sorted(map(tuple, cells.collect()))


def test_a_refresh_is_a_full_computation(spark, tmp_path):
    old = readings(1)
    new = old[30:] + [(1, START + dt.timedelta(days=2, minutes=5), 77.0), (9, START + dt.timedelta(days=40), 100.0)]
    new = [r for r in new if not (r[0] == 3 and r[1].date() == START.date())]  # a cell goes
    before, after = spark.createDataFrame(old, READ), spark.createDataFrame(new, READ)
    kept = rollup.DailyRollup(spark, str(tmp_path / "cells"))
    kept.build(before)
    assert flat(kept.read()) == flat(rollup.partials(before))
    log = rollup.changed_cells(before, after)
    for _ in range(2):  # a job that runs again changes nothing
        kept.refresh(after, log)
        assert flat(kept.read()) == flat(rollup.partials(after))


def test_only_touched_days_are_rewritten(spark, tmp_path):
    old = readings(2)
    kept = rollup.DailyRollup(spark, str(tmp_path / "cells"))
    kept.build(spark.createDataFrame(old, READ))
    stamp = lambda: {p.name: sorted(f.name for f in p.iterdir()) for p in (tmp_path / "cells").iterdir() if p.is_dir()}
    was = stamp()
    more = spark.createDataFrame([*old, (2, START + dt.timedelta(days=3, hours=1), 50.0)], READ)
    assert kept.refresh(more, rollup.changed_cells(spark.createDataFrame(old, READ), more)) == 1
    now = stamp()
    assert [d for d in now if now[d] != was.get(d)] == ["day=2031-05-04"]
    assert kept.refresh(more, rollup.changed_cells(more, more)) == 0


def test_quantiles_of_merged_sketches(spark):
    rows = readings(3, 30000)
    cells = rollup.partials(spark.createDataFrame(rows, READ))
    for r in rollup.summed(cells, ["device_id"]).collect():
        values = np.sort([v for d, _, v in rows if d == r.device_id])
        assert r.n == len(values) and np.isclose(r["mean"], values.mean()) and np.isclose(r.sd, values.std(ddof=1))
        for q, got in ((0.1, r.q10), (0.5, r.q50), (0.9, r.q90)):
            low, high = np.searchsorted(values, got, "left") / r.n, np.searchsorted(values, got, "right") / r.n
            assert low - 0.03 <= q <= high + 0.03
