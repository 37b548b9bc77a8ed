"""Forecasts and what-if predictions of all patients by stored models."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortspark.functions import clinical as C
from cohortspark.operators.boosting import Boosted

KEY = "patient_id"
#: Minutes after which the last reading is too old to forecast from.
STALE = 15
#: Features that a change adds to.
CHANGES = {"met_minutes": ("met_minutes_30", "met_minutes_60"), "heart_rate": ("heart_rate_30",), "insulin_fast": ("insulin_fast_2h",)}


def last_usable(features: DataFrame, at: DataFrame | None = None) -> DataFrame:
    """The last row of each patient with glucose now and an hour ago, up to ``at`` (patient_id, at) where that is given.

    One aggregate: a patient's rows never meet in a task. Patients without such a row are left out.
    """
    rows = features.where("glucose is not null and glucose_lag60 is not null")
    if at is not None:
        rows = rows.join(at, KEY).where("minute <= at").drop("at")
    return rows.groupBy(KEY).agg(F.max_by(F.struct(*[c for c in rows.columns if c != KEY]), "minute").alias("r")).select(KEY, "r.*")


def bands(told: DataFrame, low: float = 0.1, high: float = 0.9) -> tuple[float, float]:
    """Quantiles of target - pred over rows that the model has not seen, by a mergeable sketch (rank off by at most 1/10000)."""
    r = told.where("pred is not null and target is not null").select((F.col("target") - F.col("pred")).alias("r"))
    got = r.agg(F.percentile_approx("r", [low, high], 10000).alias("q")).first()["q"]
    return (0.0, 0.0) if got is None else (float(got[0]), float(got[1]))


def forecasts(readings: DataFrame, at: DataFrame, features: DataFrame, models: Mapping[int, Boosted], band: Mapping[int, tuple[float, float]], stale: int = STALE) -> DataFrame:
    """(patient_id, at, origin, now, horizon, glucose, low, high, change, band, unavailable) of every patient of ``at``.

    ``readings`` is (patient_id, minute, glucose), ``at`` (patient_id, at), ``features`` has a row a patient and minute.
    One row for each horizon in minutes from the origin, the last reading up to ``at``; one row with a reason
    and no horizon where there is no reading, where it is more than ``stale`` minutes old, or where its minute has no features.
    """
    seen = readings.where("glucose is not null").join(at, KEY).where("minute <= at")
    last = seen.groupBy(KEY).agg(F.max(F.struct("minute", "glucose")).alias("l")).select(KEY, F.col("l.minute").alias("origin"), F.col("l.glucose").alias("now"))
    asked = at.select(KEY, "at").distinct().join(last, KEY, "left")
    used = dict.fromkeys(n for m in models.values() for n in (*m.features, *([m.base] if m.base else [])))
    rows = asked.join(features.select(KEY, F.col("minute").alias("origin"), *used, F.lit(True).alias("_has")), [KEY, "origin"], "left")
    for h, m in models.items():
        rows = m.predict(rows, f"_h{h}")
    age = F.col("at") - F.col("origin")
    why = F.when(F.col("origin").isNull(), "no readings").when(age > stale, F.concat(F.lit("the last reading is "), age.cast("string"), F.lit(" minutes old"))).when(F.col("_has").isNull(), "no features at the last reading")
    told = lambda h: F.struct(F.lit(h).alias("horizon"), C.rounded(F.col(f"_h{h}"), 1).alias("glucose"), C.rounded(F.col(f"_h{h}") + band[h][0], 1).alias("low"), C.rounded(F.col(f"_h{h}") + band[h][1], 1).alias("high"))
    none = F.struct(F.lit(None).cast("int").alias("horizon"), *[F.lit(None).cast("double").alias(c) for c in ("glucose", "low", "high")])
    points = F.when(why.isNull(), F.array(*[told(h) for h in sorted(models)])).otherwise(F.array(none))
    out = rows.select(KEY, "at", "origin", "now", why.alias("unavailable"), F.explode(points).alias("p"))
    return out.select(KEY, "at", "origin", "now", "p.horizon", "p.glucose", "p.low", "p.high", C.rounded(F.col("p.glucose") - F.col("now"), 1).alias("change"), F.when(F.col("p.glucose").isNotNull(), C.glucose_band(F.col("p.glucose"))).alias("band"), "unavailable")


def what_if(rows: DataFrame, models: Mapping[str, Boosted], changed: Mapping[str, Column]) -> DataFrame:
    """``rows`` with ``predicted`` and ``inputs_changed``: each model's baseline, scenario and difference, and the inputs that differ.

    ``changed`` gives features new values over the rows. Both predictions are columns of one row, so nothing is shuffled.
    """
    used = {f for m in models.values() for f in m.features}
    out = rows.withColumns({f"_new{i}": c.cast("double") for i, c in enumerate(changed.values())})
    differ = [F.when(~F.col(n).cast("double").eqNullSafe(F.col(f"_new{i}")), F.lit(n)) for i, n in enumerate(changed) if n in used]
    out = out.withColumn("inputs_changed", F.array_compact(F.array(*differ)) if differ else F.array().cast("array<string>"))
    for k, m in models.items():
        out = m.predict(out, f"_base_{k}")
    keep = [c for c in rows.columns if c not in changed]
    out = out.select(*keep, *[F.col(n).alias(f"_was{i}") for i, n in enumerate(changed)], *[F.col(f"_new{i}").alias(n) for i, n in enumerate(changed)], "inputs_changed", *[f"_base_{k}" for k in models])
    for k, m in models.items():
        out = m.predict(out, f"_other_{k}")
    two = [F.struct(F.lit(k).alias("model"), F.col(f"_base_{k}").alias("baseline"), F.col(f"_other_{k}").alias("scenario"), (F.col(f"_other_{k}") - F.col(f"_base_{k}")).alias("difference")) for k in models]
    return out.select(*keep, *[F.col(f"_was{i}").alias(n) for i, n in enumerate(changed)], "inputs_changed", F.explode(F.array(*two)).alias("predicted"))


def glucose_scenarios(features: DataFrame, models: Mapping[str, Boosted], change: Mapping[str, float], at: DataFrame | None = None) -> DataFrame:
    """(patient_id, minute, now, horizon, baseline, scenario, difference, inputs_changed) for every patient with an hour of glucose.

    ``change`` adds to the inputs in ``CHANGES``, an unknown one is an error; what is missing counts as 0 where it is added to.
    """
    if unknown := set(change) - set(CHANGES):
        raise ValueError(f"unknown changes {sorted(unknown)}; there are {sorted(CHANGES)}")
    new = {n: F.coalesce(F.col(n), F.lit(0.0)) + float(d) for c, d in change.items() if d for n in CHANGES[c]}
    told = what_if(last_usable(features, at), models, new)
    p = lambda n: C.rounded(F.col(f"predicted.{n}"), 1).alias(n)
    return told.select(KEY, "minute", F.col("glucose").alias("now"), F.col("predicted.model").cast("int").alias("horizon"), p("baseline"), p("scenario"), p("difference"), "inputs_changed")
