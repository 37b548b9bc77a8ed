import datetime as dt

import pytest
from oracle import same

from cohortspark.functions import clinical as C
from cohortspark.operators import analytic as A
from cohortspark.operators import report as R
from cohortspark.plans import registry
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.PLANS))
def test_matches_sql(spark, name):
    same(registry.queries()[name](spark, SF), registry.oracle_sql()[name], SF)


def test_clarke_zones(spark):
    pairs = list(zip([100, 50, 60, 300, 250, 50, 150], [115, 60, 200, 40, 100, 100, 300]))
    got = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(pairs)], "i int, r double, p double").orderBy("i").select(C.clarke_zone(F.col("r"), F.col("p"))).collect()
    assert "".join(x[0] for x in got) == "AAEEDDC"


def _observations(spark, values, sex="female", birth=dt.date(1970, 1, 1), made=()):
    at = dt.datetime(2026, 1, 1)
    rows = [(1, a, float(v), at, a in made, i, 1) for i, (a, v) in enumerate(values.items())]
    o = spark.createDataFrame(rows, "patient_id long, analyte string, value double, effective_at timestamp_ntz, is_synthetic boolean, l_orderkey long, l_linenumber int")
    p = spark.createDataFrame([(1, sex, birth)], "patient_id long, sex string, birth_date date")
    return {"observation": o, "patient": p}


def test_baseline(spark):
    got = R.patient_baseline(_observations(spark, {"weight": 80, "height": 170, "cholesterol_total": 200, "hdl": 50, "triglycerides": 150, "hba1c": 7.1})).first()
    assert (got.bmi, got.ldl, got.vldl, got.non_hdl, got.cohort) == (27.7, 120, 30, 150, "t2d")


def test_high_triglycerides_leave_ldl_undefined(spark):
    got = R.patient_baseline(_observations(spark, {"cholesterol_total": 260, "hdl": 40, "triglycerides": 450, "hba1c": 6.0})).first()
    assert got.ldl is None and got.vldl is None and got.cohort == "prediabetes" and got.ldl_is_synthetic


def test_egfr_at_the_day_before_a_birthday(spark):
    got = R.patient_baseline(_observations(spark, {"creatinine": 1.0}, birth=dt.date(1975, 12, 31))).first()
    assert got.egfr == 69


def test_real_observations_win_whatever_their_date(spark):
    t = _observations(spark, {"weight": 80})
    newer = spark.createDataFrame([(1, "weight", 95.0, dt.datetime(2027, 1, 1), True, 9, 1)], t["observation"].schema)
    assert R.observation_latest({"observation": t["observation"].union(newer)}).first().value == 80


def test_clock_changes(spark):
    times = [dt.datetime(2026, 3, 8, 2, 30), dt.datetime(2026, 3, 8, 3), dt.datetime(2026, 11, 1, 1, 30)]
    d = spark.createDataFrame([(i, t - dt.timedelta(days=10)) for i, t in enumerate(times)], "i int, t timestamp_ntz")
    got = [r[0] for r in d.orderBy("i").select(C.shift_days(F.col("t"), F.lit(10), "America/Chicago")).collect()]
    assert got == [None, times[1], None]


def test_deming_and_lag(spark):
    d = spark.createDataFrame([("a", float(x), 12.5 + 1.25 * x) for x in range(50)], "k string, x double, y double")
    got = A.deming(d, ["k"], "x", "y").first()
    assert abs(got.slope - 1.25) < 1e-9 and abs(got.intercept - 12.5) < 1e-6
    wave = [(float((i * 37) % 101)) for i in range(400)]
    a = spark.createDataFrame([("a", i, v) for i, v in enumerate(wave)], "k string, minute int, value double")
    b = a.withColumn("minute", F.col("minute") + 8)
    assert A.lag_of(a, b, ["k"], 20).first().lag == -8


def test_upsert_and_empty(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert sorted(map(tuple, A.upsert(old, new, ["k"]).collect())) == [(1, "a"), (2, "c"), (3, "d")]
    assert R.glucose_daily({"glucose": spark.createDataFrame([], "device_id long, time timestamp_ntz, mg_dl int")}).count() == 0
