"""Boosted trees with folds by group."""

import numpy as np
import pytest
from oracle import same
from pyspark.sql import functions as F

from cohortspark.operators import boosting
from cohortspark.plans import learn_queries, registry
from cohortspark.sources import proxy

HOW = boosting.Trees(rounds=15, depth=3, rate=0.3)
SCHEMA = "who long, place long, now double, a double, gone double, holes double, target double"


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(5)
    data = []
    for i in range(900):
        who = int(rng.integers(0, 12)) if i % 3 else 99  # one group holds a third
        a, hole = float(rng.normal()), rng.random() < 0.4
        now = float(rng.normal(120, 20))
        target = now + (12.0 if a > 0 else -12.0) + (25.0 if hole else 0.0) + float(rng.normal(0, 1))
        data.append((who, i, now, a, None, None if hole else float(rng.normal()), target if i % 50 else None))
    return data, spark.createDataFrame(data, SCHEMA).cache()


def test_folds_keep_groups_whole(rows, spark):
    data, df = rows
    got = {r.who: r.fold for r in boosting.folds(df, "who", 4).collect()}
    assert set(got) == {r[0] for r in data} and set(got.values()) == {0, 1, 2, 3}
    three = spark.createDataFrame([(1,), (None,), (2,), (2,)], "who long")
    assert sorted(r.fold for r in boosting.folds(three, "who", 5).collect()) == [0, 1, 2]
    assert boosting.folds(three.where("false"), "who").count() == 0


def test_many_groups_are_dealt_in_parts(spark, monkeypatch):
    monkeypatch.setattr(boosting, "GROUPS_A_PART", 50)
    df = spark.range(1000).select((F.col("id") % 400).alias("who"))
    sizes = [r["count"] for r in boosting.folds(df, "who").groupBy("fold").count().collect()]
    assert len(sizes) == 5 and sum(sizes) == 400 and max(sizes) - min(sizes) <= 9  # each of nine parts is even to one


def test_every_row_is_told_by_others(rows):
    data, df = rows
    told, models = boosting.cross_fit(df, ["a", "gone", "holes"], "target", "who", base="now", n=4, how=HOW)
    got = told.collect()
    assert sorted(r.place for r in got) == [r[1] for r in data] and all(r.pred is not None for r in got)
    assert all(len({r.fold for r in got if r.who == w}) == 1 for w in {r.who for r in got})
    assert all(m.dropped == ("gone",) for m in models)
    full = [r for r in got if r.target is not None]
    error = np.sqrt(np.mean([(r.pred - r.target) ** 2 for r in full]))
    assert error < 0.35 * np.sqrt(np.mean([(r.now - r.target) ** 2 for r in full]))  # missing values speak too
    # the model of a fold is the same whatever the targets of that fold say
    fold = {r.place: r.fold for r in got}
    other = df.withColumn("target", F.when(F.col("place").isin([p for p, f in fold.items() if f == 0]), 1e6).otherwise(F.col("target")))
    again, _ = boosting.cross_fit(other, ["a", "gone", "holes"], "target", "who", base="now", n=4, how=HOW)
    was, now = ({r.place: round(r.pred, 6) for r in x if r.fold == 0} for x in (got, again.collect()))
    assert was == now


def test_a_model_of_all_rows(rows, spark):
    _, df = rows
    model = boosting.fit(df, ["a", "gone", "holes"], "target", base="now", how=HOW)
    assert model.features == ("a", "holes")
    one = spark.createDataFrame([(1, 0, None, 1.0, None, 0.0, None), (1, 1, 100.0, 1.0, None, float("nan"), None)], SCHEMA)
    none, high = model.predict(one).orderBy("place").collect()
    assert none.pred is None and 128 < high.pred < 146
    for bad in (df.where("false"), df.where("target is null")):
        with pytest.raises(ValueError):
            boosting.fit(bad, ["a"], "target")
    with pytest.raises(ValueError):
        boosting.cross_fit(df.where("who = 99"), ["a"], "target", "who")


def test_folds_match_sql(spark):
    sf = "/root/testdata/sf0.001"
    same(registry.queries()["a_gbm_folds"](spark, sf), registry.oracle_sql()["a_gbm_folds"], sf)


def test_features_are_worked_out_once(spark, monkeypatch):
    """Folds, both horizons and all trees read the stored features."""
    made, real = spark.sparkContext.accumulator(0), learn_queries.job_queries.PLANS["a_features_forecast"]

    def counted(t):
        f = real(t)

        def seen(parts):
            for part in parts:
                made.add(part.num_rows)
                yield part

        return f.mapInArrow(seen, f.schema)

    monkeypatch.setitem(learn_queries.job_queries.PLANS, "a_features_forecast", counted)
    monkeypatch.setattr(learn_queries, "TREES", boosting.Trees(rounds=1, depth=1))
    t = proxy.views(spark, "/root/testdata/sf0.001")
    rows = real(t).count()
    for make in (learn_queries._boosted, learn_queries._stored):
        made.value = 0
        make(t)
        assert made.value == rows


def test_a_mark_that_is_never_set_is_left_out(rows):
    """Features without a missing value in the rows fitted on are one column of the trees' input, others two; fills and predictions are as before."""
    _, df = rows
    model = boosting.fit(df, ["a", "gone", "holes"], "target", base="now", how=HOW)
    assert model.marked == ("holes",) and model.trees.numFeatures == 3
    every = boosting.fit(df.unionByName(df.limit(1).withColumn("a", F.lit(None).cast("double")).withColumn("target", F.lit(None).cast("double"))), ["a", "gone", "holes"], "target", base="now", how=HOW)
    assert every.marked == ("holes",)  # rows without a target are not fitted on
    x = boosting._assembled(df.limit(50), ["a", "holes"], [7.0, 8.0], None).select("a", "holes", "_x").collect()
    assert all(list(r._x) == [7.0 if r.a is None else r.a, float(r.a is None), 8.0 if r.holes is None else r.holes, float(r.holes is None)] for r in x)
    assert any(r.holes is None for r in x)
