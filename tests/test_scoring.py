"""Stored models, forecasts and what-if predictions of all patients."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortspark.operators import artefact, boosting, scoring

NAMES = ["glucose", "glucose_lag60", "met_minutes_30", "met_minutes_60", "heart_rate_30"]
CONTRACT = {"features": NAMES, "step_minutes": 5}


@pytest.fixture(scope="module")
def features(spark):
    rng = np.random.default_rng(3)
    rows = []
    for who in range(6):
        for k in range(60):
            g = float(rng.normal(140, 30))
            met = float(rng.integers(0, 2) * 20)
            rows.append((who, 5 * k, g, float(rng.normal(140, 30)) if k >= 12 else None, met, met, None, g + 10 - met))
    return spark.createDataFrame(rows, "patient_id long, minute long, glucose double, glucose_lag60 double, met_minutes_30 double, met_minutes_60 double, heart_rate_30 double, target double").cache()


@pytest.fixture(scope="module")
def model(features):
    return boosting.fit(features, NAMES, "target", base="glucose", how=boosting.Trees(rounds=10, depth=2, rate=0.5))


@pytest.fixture()
def stored(spark, tmp_path, model):
    root = str(tmp_path / "store")
    return root, artefact.publish(spark, root, {"30": model}, CONTRACT)


def told(model, rows):
    return {(r.patient_id, r.minute): r.pred for r in model.predict(rows).collect()}


def test_a_stored_model_tells_the_same(spark, stored, model, features):
    root, version = stored
    models, meta = artefact.load(spark, root, CONTRACT)
    assert meta["version"] == version and models["30"].dropped == ("heart_rate_30",)
    assert told(models["30"], features) == told(model, features)


def test_what_is_refused(spark, stored, tmp_path):
    root, version = stored
    for other in ({**CONTRACT, "step_minutes": 15}, {"features": NAMES}, {**CONTRACT, "more": 1}):
        with pytest.raises(artefact.Refused, match="step_minutes|more"):
            artefact.load(spark, root, other)
    with pytest.raises(artefact.Refused, match="no model"):
        artefact.load(spark, str(tmp_path / "nowhere"), CONTRACT)
    meta = tmp_path / "store" / version / "meta.json"
    text, crc = meta.read_text(), meta.with_name(".meta.json.crc")
    crc.unlink()
    meta.write_text(json.dumps({**json.loads(text), "format": 99}))
    with pytest.raises(artefact.Refused, match="format 99"):
        artefact.load(spark, root, CONTRACT)
    broken = json.loads(text)
    broken["checksums"][next(iter(broken["checksums"]))] = "0"
    meta.write_text(json.dumps(broken))
    with pytest.raises(artefact.Refused, match="not those"):
        artefact.load(spark, root, CONTRACT)
    meta.unlink()
    with pytest.raises(artefact.Refused, match="has no"):
        artefact.load(spark, root, CONTRACT)


def test_versions_and_writers(spark, stored, model):
    root, first = stored
    with pytest.raises(FileExistsError):
        artefact.publish(spark, root, {"30": model}, CONTRACT, version=first)
    artefact.publish(spark, root, {"30": model}, CONTRACT, version="beside", current=False)
    assert artefact.load(spark, root, CONTRACT)[1]["version"] == first
    for name in ("a", "b"):  # the pointer is of the writer that came last, both versions are whole
        artefact.publish(spark, root, {"30": model}, CONTRACT, version=name)
    assert artefact.load(spark, root, CONTRACT)[1]["version"] == "b"
    assert artefact.load(spark, root, CONTRACT, version="a")[1]["version"] == "a"
    artefact.use(spark, root, first)
    assert artefact.load(spark, root, CONTRACT)[1]["version"] == first


def test_forecasts_and_why_there_are_none(spark, features, model):
    at = spark.createDataFrame([(0, 300), (1, 310), (2, 311), (3, 99), (77, 50)], "patient_id long, at long")
    readings = features.select("patient_id", "minute", "glucose").union(spark.createDataFrame([(3, 99, 150.0)], "patient_id long, minute long, glucose double"))
    got = scoring.forecasts(readings, at, features, {30: model}, {30: (-5.0, 7.0)}).collect()
    by = {r.patient_id: r for r in got}
    assert len(got) == 5
    assert by[2].unavailable == "the last reading is 16 minutes old" and by[77].unavailable == "no readings" and by[3].unavailable == "no features at the last reading"
    assert by[2].glucose is None and by[2].band is None
    known = told(model, features)
    for who in (0, 1):
        r = by[who]
        assert r.origin == 295 and r.unavailable is None and abs(r.glucose - known[who, 295]) < 0.051
        assert abs(r.low - (known[who, 295] - 5)) < 0.051 and abs(r.high - (known[who, 295] + 7)) < 0.051 and abs(r.change - (r.glucose - r.now)) < 0.06


def test_bands_are_quantiles(spark):
    rows = spark.range(1001).select(F.lit(0.0).alias("pred"), F.col("id").cast("double").alias("target"))
    low, high = scoring.bands(rows)
    assert abs(low - 100) <= 1 and abs(high - 900) <= 1
    assert scoring.bands(rows.where("false")) == (0.0, 0.0)


def test_scenarios(spark, features, model):
    quiet = features.withColumns({"met_minutes_30": F.lit(None).cast("double"), "met_minutes_60": F.lit(0.0)})
    got = scoring.glucose_scenarios(quiet, {"30": model}, {"met_minutes": 20, "heart_rate": 0}).collect()
    assert sorted(r.patient_id for r in got) == list(range(6))
    for r in got:
        assert r.minute == 295 and r.horizon == 30 and sorted(r.inputs_changed) == ["met_minutes_30", "met_minutes_60"]
        assert -30 < r.difference < -10 and abs(r.scenario - r.baseline - r.difference) < 0.11
    early = spark.createDataFrame([(0, 100), (1, 20)], "patient_id long, at long")
    assert [(r.patient_id, r.minute) for r in scoring.glucose_scenarios(features, {"30": model}, {}, early).collect()] == [(0, 100)]
    with pytest.raises(ValueError):
        scoring.glucose_scenarios(features, {"30": model}, {"sleep": 1})


def test_replaced_inputs(spark, features, model):
    rows = features.withColumn("met_minutes_30", F.when(F.col("minute") % 10 == 0, 20.0)).limit(40)
    got = scoring.what_if(rows, {"m": model}, {"met_minutes_30": F.lit(20.0), "heart_rate_30": F.lit(70.0)}).collect()
    assert len(got) == 40
    for r in got:  # heart rate is no feature of the model, so its change is none
        same = r.minute % 10 == 0
        assert r.inputs_changed == ([] if same else ["met_minutes_30"]) and r.met_minutes_30 == (20.0 if same else None)
        assert not same or r.predicted.difference == 0
