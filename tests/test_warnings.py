import datetime as dt

from cohortspark.operators import analytic as A
from pyspark.sql import functions as F


def test_every_device_has_forecasts(spark):
    at = dt.datetime(2026, 1, 1)
    g = spark.createDataFrame([(d, at + dt.timedelta(minutes=15 * i), 250) for d in (3, 4, 15) for i in range(6)], "device_id long, time timestamp_ntz, mg_dl int")
    points = A.forecast_points({"glucose": g})
    assert {r.device_id: r["count"] for r in points.groupBy("device_id").count().collect()} == {3: 8, 4: 8, 15: 8}
    assert A.warnings(points).where("kind = 'high'").count() + A.warnings(points).where("kind = 'very_high'").count() == 6


def test_forecasts_of_two_devices_with_one_id_stay_apart(spark):
    at = dt.datetime(2026, 1, 1)
    rows = [(1, at, 200001, 100, 15 * k, 100 if k < 3 else 260, 85, 115) for k in (1, 2, 3, 4)]
    rows += [(2, at, 200001, 250, 15 * k, 260, 245, 275) for k in (1, 2, 3, 4)]
    p = spark.createDataFrame(rows, "device_id long, time timestamp_ntz, id long, now int, horizon int, glucose int, low int, high int")
    got = sorted((r.id, r.kind, r.horizon) for r in A.warnings(p).where(F.col("kind") != "spike").collect())
    assert got == [(200001, "very_high", 15), (200001, "very_high", 45)]
