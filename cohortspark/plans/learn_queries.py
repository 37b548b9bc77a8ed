"""Queries of the linear forecaster and of kept rollups, each beside its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from cohortspark.functions import clinical as C
from cohortspark.operators import analytic, arima, artefact, boosting, forecast, linear, rollup, scoring
from cohortspark.operators.rounds import folder
from cohortspark.plans import job_queries
from cohortspark.plans.oracles import r
from pyspark.sql import functions as F

FEATURES = ["glucose", "glucose_lag5", "glucose_lag15", "glucose_lag30"]


def _rows(t):
    """Origins with their past and the value 30 minutes on; each patient's own first 70 % of time is fitted on."""
    f = job_queries.PLANS["a_features_forecast"](t).select("patient_id", "minute", *FEATURES, F.col("target_t30").alias("target"))
    return linear.by_time(f.dropna(), "patient_id", "minute")


def _linear(t):
    """Errors of the chosen model, and of saying that glucose stays as it is, by segment."""
    rows = _rows(t)
    model, _ = linear.ridge(rows, FEATURES, "target", "segment")
    err = lambda p: F.sqrt(F.avg((p - F.col("target")) * (p - F.col("target"))))
    return rows.groupBy("segment").agg(F.count("*").alias("n"), C.rounded(err(model.predict()), 4).alias("rmse"), C.rounded(err(F.col("glucose")), 4).alias("rmse_same"), F.lit(model.alpha).alias("alpha"))


def _kept(t):
    """A rollup built on four fifths of the readings, then refreshed for the cells that the rest touches."""
    all_ = t["glucose"].select("device_id", "time", F.col("mg_dl").cast("double").alias("value"))
    early = all_.where("value % 5 <> 0")
    kept = rollup.DailyRollup(all_.sparkSession, f"{folder(all_.sparkSession)}/rollup-{uuid4().hex}")
    kept.build(early)
    kept.refresh(all_, rollup.changed_cells(early, all_))
    s = rollup.summed(kept.read(), ["device_id"])
    return s.select("device_id", "n", *[C.rounded(F.col(c), 4).alias(c) for c in ("mean", "sd", "low", "high")])


#: Features of the boosted forecaster: all of the grid but the targets; those without any value are left out by the fit.
BOOSTED = [*FEATURES, "glucose_lag60", "roc_5", "roc_15", "roc_30", "mean_60", "sd_60", "heart_rate_30", "met_minutes_30", "met_minutes_60", "steps_60", "insulin_fast_2h", "oral_doses_12h", "tod_sin", "tod_cos"]
TREES = boosting.Trees(rounds=10, depth=4, rate=0.3)


def _features(t):
    """The features of all patients with both targets, stored once: folds and every tree read them."""
    return boosting.stored(job_queries.PLANS["a_features_forecast"](t).select("patient_id", "minute", *BOOSTED, "target_t30", "target_t60"), "features")


def _boosted(t):
    """Errors of trees with folds by patient, on rows of patients that the model has not seen, against glucose as it is."""
    out, f = None, _features(t)
    for h in (30, 60):
        rows = f.select("patient_id", "minute", *BOOSTED, F.col(f"target_t{h}").alias("target")).dropna(subset=["glucose", "target"])
        told, models = boosting.cross_fit(rows, BOOSTED, "target", "patient_id", base="glucose", how=TREES)
        s = forecast.scores(told.withColumn("now", F.col("glucose")).withColumn("horizon", F.lit(h)), ["horizon"])
        s = s.withColumn("dropped", F.lit(",".join(sorted({d for m in models for d in m.dropped}))))
        out = s if out is None else out.unionByName(s)
    return out


CONTRACT = {"features": BOOSTED, "base": "glucose", "step_minutes": 5}


def _stored(t):
    """(features of all patients, the models of 30 and 60 minutes, their bands): trained, published, and read back as a job of another day would.

    A fifth of the patients takes no part in the training; their residuals are the bands.
    """
    f = _features(t)
    spark, at = f.sparkSession, f"{folder(f.sparkSession)}/forecaster-{uuid4().hex}"
    dealt = boosting.folds(f.where("glucose is not null"), "patient_id")
    f = boosting.stored(f.join(dealt, "patient_id"), "dealt")
    made, band = {}, {}
    for h in (30, 60):
        m = boosting.fit(f.where("fold <> 0"), BOOSTED, f"target_t{h}", base="glucose", how=TREES)
        made[str(h)], band[h] = m, scoring.bands(m.predict(f.where("fold = 0")).withColumn("target", F.col(f"target_t{h}")))
    artefact.publish(spark, f"{at}/store", made, CONTRACT)
    models, _ = artefact.load(spark, f"{at}/store", CONTRACT)
    return f, models, band


def _asked(f):
    """Every patient is asked ten minutes after the last place of the grid."""
    return f.groupBy("patient_id").agg((F.max("minute") + 10).alias("at"))


def _forecast(t):
    """The forecasts of all patients, or why there is none."""
    f, models, band = _stored(t)
    return scoring.forecasts(f.select("patient_id", "minute", "glucose"), _asked(f), f, {int(h): m for h, m in models.items()}, band)


def _forecast_warnings(t):
    """Warnings of the forecasts of all patients, by kind."""
    points = _forecast(t).where("unavailable is null").select(F.col("patient_id").alias("device_id"), F.col("origin").alias("time"), F.col("patient_id").alias("id"), "now", "horizon", "glucose", "low", "high")
    return analytic.warnings(points).withColumnRenamed("id", "patient_id")


def _scenarios(t):
    """What half an hour of activity and two units of fast insulin change for each patient, by the model."""
    f, models, _ = _stored(t)
    told = scoring.glucose_scenarios(f.drop("fold", "target_t30", "target_t60"), models, {"met_minutes": 90, "insulin_fast": 2})
    return told.withColumn("inputs_changed", F.array_join("inputs_changed", ","))


def _population(t):
    """Errors of trees for HbA1c, every patient told by folds without it, against the mean of all."""
    rows = job_queries.PLANS["a_prepare_pop"](t)
    told, _ = boosting.cross_fit(rows, POPULATION, "hba1c", "patient_id", how=TREES)
    mean = rows.agg(F.avg("hba1c")).first()[0]
    return forecast.scores(told.withColumn("now", F.lit(mean)).withColumn("target", F.col("hba1c")).withColumn("cohort", F.lit("nhanes")), ["cohort"])


POPULATION = ["male", "current_smoker", "steps_k", "diagnosed", "duration"]


def _population_scenarios(t):
    """HbA1c of every patient by the population model as things are, and with 9000 steps a day and no smoking.

    The model learns from one cohort and is asked about all patients, those without a measured value too.
    """
    model = boosting.fit(job_queries.PLANS["a_prepare_pop"](t), POPULATION, "hba1c", how=TREES)
    static = job_queries._static(t).withColumn("cohort", F.lit("any")).withColumn("measured", F.col("hba1c"))
    every = forecast.prepared(static.withColumn("hba1c", F.coalesce("hba1c", F.lit(0.0))), "any").join(static.select("patient_id", "measured"), "patient_id")
    told = scoring.what_if(every, {"hba1c": model}, {"steps_k": F.lit(9.0), "current_smoker": F.lit(0.0)})
    p = lambda n: C.rounded(F.col(f"predicted.{n}"), 2).alias(n)
    return told.select("patient_id", "measured", p("baseline"), p("scenario"), p("difference"), F.array_join("inputs_changed", ",").alias("inputs_changed"))


PLANS: dict[str, Callable] = {
    "a_forecast": _forecast,
    "a_forecast_warnings": _forecast_warnings,
    "a_gbm_cv": _boosted,
    "a_gbm_folds": lambda t: boosting.folds(_rows(t), "patient_id"),
    "a_gbm_population": _population,
    "a_scenarios": _scenarios,
    "a_scenarios_hba1c": _population_scenarios,
    "a_arima": lambda t: arima.forecasts(t["fused"].select("patient_id", (F.unix_seconds(F.col("time").cast("timestamp")) / 300).cast("long").alias("place"), F.col("mg_dl").alias("value")), orders=((1, 0, 0), (2, 0, 0), (0, 1, 1), (1, 1, 1))),
    "a_linear": _linear,
    "a_linear_moments": lambda t: linear.moments(_rows(t), FEATURES, "target", "segment"),
    "snk_rollup": _kept,
}

_ROWS = f"SELECT f.*, CASE WHEN (minute - a) / greatest(b - a, 1) < 0.7 THEN 'fit' WHEN (minute - a) / greatest(b - a, 1) < 0.85 THEN 'validate' ELSE 'test' END AS segment FROM (SELECT *, min(minute) OVER (PARTITION BY patient_id) AS a, max(minute) OVER (PARTITION BY patient_id) AS b FROM (SELECT patient_id, minute, {', '.join(FEATURES)}, target_t30 AS target FROM ({job_queries.FEATURES})) WHERE {' AND '.join(f'{c} IS NOT NULL' for c in [*FEATURES, 'target'])}) f"
_COLS = ["1.0", *FEATURES, "target"]
_PAIRS = [(i, j) for i in range(len(_COLS)) for j in range(i, len(_COLS))]

SQL: dict[str, str] = {
    "a_gbm_folds": f"SELECT patient_id, CAST(CASE WHEN (p // n) % 2 = 1 THEN n - 1 - p % n ELSE p % n END AS INTEGER) AS fold FROM (SELECT patient_id, row_number() OVER (ORDER BY count(*) DESC, patient_id) - 1 AS p, least(5, count(*) OVER ()) AS n FROM ({_ROWS}) GROUP BY patient_id)",
    "a_linear_moments": f"WITH x AS ({_ROWS}) " + " UNION ALL ".join(f"SELECT segment, {i} AS i, {j} AS j, CAST(sum({_COLS[i]} * {_COLS[j]}) AS DOUBLE) AS s FROM x GROUP BY 1" for i, j in _PAIRS),
    "snk_rollup": f"SELECT device_id, count(*) AS n, {r('avg(mg_dl)', 4)} AS mean, {r('stddev_samp(mg_dl)', 4)} AS sd, {r('count(*) FILTER (mg_dl < 70) / count(*)', 4)} AS low, {r('count(*) FILTER (mg_dl > 180) / count(*)', 4)} AS high FROM glucose GROUP BY 1",
}
