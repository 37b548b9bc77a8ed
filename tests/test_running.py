"""Spans on days: a span is dealt to years in which its patient has a day, not to its months."""

from datetime import date

from cohortspark.operators import features as V


def test_running_deals_spans_to_years_with_days(spark):
    d = date
    spans = spark.createDataFrame([(1, "a", d(2000, 3, 1), None), (1, "b", d(2001, 1, 5), d(2003, 6, 1)), (1, "c", d(2009, 1, 1), d(2009, 1, 2)), (2, "a", d(2000, 1, 1), None), (1, None, d(2000, 1, 1), d(2000, 1, 1))], "patient_id long, what string, started_at date, ended_at date")
    days = spark.createDataFrame([(1, d(2000, 1, 1)), (1, d(2001, 1, 4)), (1, d(2001, 1, 5)), (1, d(2003, 6, 1)), (1, d(2008, 12, 31))], "patient_id long, day date")
    out = V.running(spans, days)
    want = [(1, d(2000, 1, 1), None)] + [(1, day, "a") for day in (d(2001, 1, 4), d(2001, 1, 5), d(2003, 6, 1), d(2008, 12, 31))] + [(1, day, "b") for day in (d(2001, 1, 5), d(2003, 6, 1))]
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, want))
    assert "month" not in out._jdf.queryExecution().optimizedPlan().toString()
