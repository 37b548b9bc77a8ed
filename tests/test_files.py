"""Readers on small files, and sinks."""

import json

import numpy as np
import pytest

from cohortspark.operators import batch as B
from cohortspark.operators import forecast as P
from cohortspark.operators import fusion as U
from cohortspark.sources import health_files as H
from pyspark.sql import functions as F


def test_bio(spark, tmp_path):
    head = ["subject", " Age", "Gender ", "Self-identify", "Collection time PDL (Lab)", *H.BIO_LABS, "#1 Contour Fingerstick GLU", "Time (t)", "#2 Contour Fingerstick GLU", "Time (t)"]
    row = ["7", "54.0", "f", "African American", "8:15 AM", "6.1", "101", "nan", "180", "50", "120", "200", "70", "110", "7:00 AM", "n/a", "9:00 AM"]
    (tmp_path / "bio.csv").write_text("﻿" + ",".join(head) + "\n" + ",".join(row) + "\n" + "," * (len(head) - 1) + "\n")
    got = H.read_bio(spark, str(tmp_path / "bio.csv")).collect()
    assert len(got) == 1
    r = got[0]
    labs = {x.code: x.value for x in r.labs}
    assert (r.subject_id, r.sex, r.age, r.race, r.lab_time) == ("007", "female", 54, "Black or African American", "08:15:00")
    assert labs["29463-7"] == 90.72 and labs["8302-2"] == 177.8 and "20448-7" not in labs
    assert [(x.clock, x.mg_dl) for x in r.fingersticks] == [("07:00:00", 110.0)]
    (tmp_path / "bad.csv").write_text("subject,Age\n1,2\n")
    with pytest.raises(ValueError):
        H.read_bio(spark, str(tmp_path / "bad.csv"))


def test_sensor_streams(spark, tmp_path):
    text = "Unnamed: 0,Timestamp ,Libre GL,Dexcom GL,HR,METs,Calories (Activity),Meal Type,Carbs,Amount Consumed,Image path\n"
    text += "0,2020-05-01 10:30:00,84,92.0,56.4,13,1.05,Breakfast,66,120,a.jpg\n1,2020-05-01 10:30:00,1,1,1,1,1,,,,\n2,2020-05-01 10:31:00,84.1,92.2,,,,snack 2,5,50,\n"
    (tmp_path / "s.csv").write_text(text)
    raw = H.read_text_table(spark, str(tmp_path / "s.csv"))
    rows = H.sensor_rows(raw)
    assert rows.count() == 2
    w = H.wearable_minutes(rows).collect()
    assert [(r.heart_rate, r.mets, r.activity_level, r.active_kcal) for r in w] == [(56.0, 1.3, None, 1.05)]
    m = {r.meal_type: (r.carbs_g, r.pct_consumed, r.fat_g) for r in H.meals(rows).collect()}
    assert m == {"breakfast": (66.0, 100.0, None), "snack": (5.0, 50.0, None)} and H.ignored_columns(raw) == []
    with pytest.raises(Exception, match="unknown meal type"):
        H.meals(rows.withColumn("Meal Type", F.lit("brunch"))).collect()


@pytest.mark.parametrize("native, step", [([142, 139, 139, 139, 151, 168, 168, 168, 77, 79, 79, 64, 60], 5), ([203, 188, 171, 171], 15)])
def test_native_readings_come_back(spark, native, step):
    points = [(i * step, float(v)) for i, v in enumerate(native)]
    rows = [("a", m, v + (w - v) * k / step) for (m0, v), (_, w) in zip(points, points[1:]) for k in range(step) for m in [m0 + k]] + [("a", *points[-1])]
    rows += [("a", 2000 + k, 96.0 + 15 * k / step) for k in range(step + 1)]  # another stretch
    got = sorted((r.minute, r.value) for r in H.native_samples(spark.createDataFrame(rows, "key string, minute long, value double"), step).collect())
    assert got == [(m, int(v)) for m, v in points] + [(2000, 96), (2000 + step, 111)]


def test_dexcom_and_demographics(spark):
    raw = spark.createDataFrame([("2020-01-01 00:00:00", "EGV", "Low"), ("2020-01-01 00:05:00", "EGV", "95"), ("2020-01-01 00:05:00", "EGV", "99"), ("2020-01-01 00:06:00", "Alert", "1"), ("2020-01-01 00:10:00", "EGV", "High")], "`Timestamp (x)` string, `Event Type` string, `Glucose Value (mg/dL)` string").coalesce(1)
    assert sorted(r.mg_dl for r in H.dexcom(raw).collect()) == [40.0, 95.0, 400.0]
    d = spark.createDataFrame([("3", " FEMALE", "5.5")], "ID string, Gender string, HbA1c string")
    assert [tuple(r) for r in H.demographics(d).collect()] == [("003", "female", 5.5)]


def test_bundle_index(spark, tmp_path):
    res = [
        {"fullUrl": "u", "resource": {"resourceType": "Patient", "id": "p", "name": [{"use": "maiden", "family": "X"}, {"use": "official", "family": "Doe", "given": ["Jo", "Al"]}], "identifier": [{"value": "M1", "type": {"coding": [{"code": "MR"}]}}]}},
        {"resource": {"resourceType": "Observation", "code": {"coding": [{"code": "39156-5"}]}, "effectiveDateTime": "2019-01-01T00:00:00Z", "valueQuantity": {"value": 30.0}}},
        {"resource": {"resourceType": "Observation", "code": {"coding": [{"code": "39156-5"}]}, "effectiveDateTime": "2020-01-01T00:00:00Z", "valueQuantity": {"value": 28.5}}},
        {"resource": {"resourceType": "Observation", "code": {"coding": [{"code": "72166-2"}]}, "effectiveDateTime": "2020-01-01T00:00:00Z", "valueCodeableConcept": {"coding": [{"code": "266919005", "display": "Never"}]}}},
        {"resource": {"resourceType": "Condition", "code": {"coding": [{"code": "1", "display": "One"}]}, "recordedDate": "2018-01-01T00:00:00Z"}},
        {"resource": {"resourceType": "Encounter", "id": "e", "class": {"code": "AMB"}, "period": {"start": "2020-02-01T00:00:00Z", "end": "2020-02-01T01:00:00Z"}}},
        {"resource": {"resourceType": "MedicationRequest", "id": "m", "authoredOn": "2020-01-01T00:00:00Z", "status": "active", "medicationCodeableConcept": {"coding": [{"system": H.RXNORM, "code": "860975"}]}, "dosageInstruction": [{"timing": {"repeat": {"frequency": 1.0, "period": 12.0, "periodUnit": "h"}}, "doseAndRate": [{"doseQuantity": {"value": 1.0}}, {"doseQuantity": {"value": 2.0}}]}]}},
    ]
    (tmp_path / "b.json").write_text(json.dumps({"entry": res}, indent=1))
    r = H.read_bundles(spark, str(tmp_path / "b.json"))
    i = H.bundle_index(r).first()
    assert (i.patient_id, i["name"], i.mrn, i.bmi, i.deceased) == ("p", "Jo Al Doe", "M1", 28.5, False)
    assert H.bundle_codes(r, ["72166-2"]).first().display == "Never" and H.bundle_conditions(r).first().code == "1"
    o = H.bundle_orders(r).first()
    assert (o.rxcui, o.dose, o.times_per_day) == ("860975", 2.0, 2.0) and H.bundle_encounters(r).first()["class"] == "ambulatory"


def test_vocabulary(spark, tmp_path):
    (tmp_path / "v.csv").write_text("code,n\na,1\nb,\n")
    assert [tuple(r) for r in H.read_vocabulary(spark, str(tmp_path / "v.csv"), "code string, n int").collect()] == [("a", 1), ("b", None)]


def test_sinks(spark, tmp_path):
    df = lambda rows: spark.createDataFrame(rows, "k int, v string")
    B.write_replacing(df([(1, "a"), (2, "b")]), str(tmp_path / "t"), "k")
    B.write_replacing(df([(2, "c"), (3, "d")]), str(tmp_path / "t"), "k")
    assert {(r.k, r.v) for r in spark.read.parquet(str(tmp_path / "t")).collect()} == {(1, "a"), (2, "c"), (3, "d")}
    B.write_features(df([(1, "a")]).withColumn("x", F.lit("1.50").cast("decimal(5,2)")), str(tmp_path / "f"))
    assert dict(spark.read.parquet(str(tmp_path / "f")).dtypes)["x"] == "double"
    B.write_report([df([(1, "a")]), spark.createDataFrame([(2, 5)], "k int, w int")], str(tmp_path / "r"))
    assert spark.read.csv(str(tmp_path / "r"), header=True).columns == ["k", "v", "w"]
    assert "| 1 | 2 | v | 50.0 |" in B.card(df([(1, "a"), (1, None)]), "k")


def test_associations_against_numpy(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 2))
    y = 1.5 + x @ [2.0, -0.5] + rng.normal(size=400) * 0.1
    rows = [(i, float(a), float(b), float(c)) for i, ((a, b), c) in enumerate(zip(x, y))] + [(900, None, 1.0, 1.0)]
    got = P.associations(spark.createDataFrame(rows, "patient_id long, a double, b double, y double"), ["a", "b"], "y", replicates=60).collect()
    want = np.linalg.lstsq(np.column_stack([np.ones(400), x]), y, rcond=None)[0]
    assert np.allclose([r.coef for r in got], want) and all(r.ci_low < r.coef < r.ci_high and r.ci_high - r.ci_low < 0.05 for r in got)


def test_two_sensors_of_one_truth(spark):
    rng = np.random.default_rng(21)
    n, late, gain, base = 5 * 1440, 6, 0.7, 9.0
    truth = 155 + 35 * np.sin(np.arange(n) / 83) + 25 * np.cos(np.arange(n) / 29)
    ref = [("p", int(m + late), float(truth[m])) for m in range(0, n - late, 5)]
    noise = np.where(np.arange(n) < 1440, 22.0, 1.2) * rng.normal(size=n)  # the first day is unsettled
    sec = [("p", int(m), float(gain * truth[m] + base + noise[m])) for m in range(0, n, 15)]
    frame = lambda rows: spark.createDataFrame(rows, "patient_id string, minute long, value double")
    a, b = U.minute_series(frame(ref), 10), U.minute_series(frame(sec), 20)
    lag = U.lags(a, b, 30).first().lag
    assert abs(lag + late) <= 2
    c = U.calibrated(U.shifted(frame(ref), F.lit(lag)), frame(sec)).first()
    assert abs(c.slope * gain - 1) < 0.04 and abs(c.intercept + base / gain) < 6 and c.factor > 2


def test_alignment_cases(spark):
    lags = spark.createDataFrame([("early", -5), ("late", 9), ("second", 45), ("first", 45)], "patient_id string, lag int")
    peaks = spark.createDataFrame([("early", 33, 33), ("late", 33, 33), ("second", 20, 65), ("first", 65, 20)], "patient_id string, reference_peak int, secondary_peak int")
    got = {r.patient_id: (r.reference_shift, r.secondary_shift) for r in U.alignment(lags, peaks).collect()}
    assert got == {"early": (-5, 0), "late": (0, -9), "second": (0, -45), "first": (45, 0)}
