"""Forecast material: feature grids, benchmark frames, origins, scores, and associations with bootstrap intervals."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortspark.functions import clinical as C
from cohortspark.functions import measures as M

KEY, STEP = "patient_id", 5
MACROS = ("energy_kcal", "carbs_g")


def _spread(points: DataFrame, step: int = STEP) -> DataFrame:
    """(patient_id, minute): every ``step`` minutes from the first to the last of each patient."""
    ends = points.groupBy(KEY).agg(F.min("minute").alias("a"), F.max("minute").alias("b"))
    return ends.select(KEY, F.explode(F.sequence("a", "b", F.lit(step).cast("long"))).alias("minute"))


def features(series: DataFrame, lags: Sequence[int] = (1, 3, 6, 12), horizons: Sequence[int] = (30, 60)) -> DataFrame:
    """Features on each patient's complete five-minute grid; gaps are rows without glucose, so rows are times.

    ``series`` is (patient_id, minute, glucose, heart_rate, met_minutes, steps, insulin_fast, oral_doses) with whole
    minutes since an epoch; minute 0 is a midnight of the patient's clock.
    """
    g = _spread(series).join(series, [KEY, "minute"], "left")
    w = Window.partitionBy(KEY).orderBy("minute")
    x = F.col("glucose")
    last = lambda n: w.rowsBetween(-n + 1, 0)
    over = lambda f, c, n, least=1: F.when(F.count(c).over(last(n)) >= least, f(c).over(last(n)))
    angle = (F.col("minute") % 1440) * (2 * 3.141592653589793 / 1440)
    sum0 = lambda c, n: F.sum(F.coalesce(F.col(c), F.lit(0.0))).over(last(n))
    return g.select(
        KEY, "minute", "glucose", *[F.lag("glucose", k).over(w).alias(f"glucose_lag{STEP * k}") for k in lags],
        (x - F.lag("glucose", 1).over(w)).alias("roc_5"), C.rounded((x - F.lag("glucose", 3).over(w)) / 3, 6).alias("roc_15"), C.rounded((x - F.lag("glucose", 6).over(w)) / 6, 6).alias("roc_30"),
        C.rounded(over(F.avg, "glucose", 12, 6), 6).alias("mean_60"), C.rounded(over(F.stddev_samp, "glucose", 12, 6), 6).alias("sd_60"), C.rounded(over(F.avg, "heart_rate", 6), 6).alias("heart_rate_30"),
        over(F.sum, "met_minutes", 6).alias("met_minutes_30"), over(F.sum, "met_minutes", 12).alias("met_minutes_60"), over(F.sum, "steps", 12).alias("steps_60"),
        sum0("insulin_fast", 24).alias("insulin_fast_2h"), sum0("oral_doses", 144).alias("oral_doses_12h"),
        C.rounded(F.sin(angle), 6).alias("tod_sin"), C.rounded(F.cos(angle), 6).alias("tod_cos"),
        *[F.lead("glucose", h // STEP).over(w).alias(f"target_t{h}") for h in horizons],
    )


def _phase(native: DataFrame) -> DataFrame:
    """(patient_id, phase): the commonest minute of five, of equally common ones the smallest."""
    g = native.groupBy(KEY, (F.col("minute") % STEP).alias("phase")).count()
    return g.groupBy(KEY).agg(F.min_by("phase", F.struct((-F.col("count")).alias("c"), "phase")).alias("phase"))


def bench_frame(native: DataFrame, heart_rate: DataFrame, kcal: DataFrame, meals: DataFrame, fill_steps: int = 6) -> DataFrame:
    """One row a patient and grid point: glucose snapped to it, bridged glucose, heart rate, energy and meals of (t - 5, t].

    The grid has the phase of the patient's sensor. Gaps of at most ``fill_steps`` points are bridged on a line; rows
    of other streams fall into the bin that ends at a grid point. Streams are (patient_id, minute, value), meals have macros.
    """
    phase = _phase(native)
    n = native.join(phase, KEY).withColumn("t", (F.col("phase") + STEP * F.rint((F.col("minute") - F.col("phase")) / STEP)).cast("long"))
    glucose = n.groupBy(KEY, F.col("t").alias("minute")).agg(F.avg("value").alias("glucose"))
    ends = n.groupBy(KEY).agg((F.floor(F.min("minute") / 60) * 60 + F.first("phase")).alias("a"), F.max("minute").alias("b"))
    grid = ends.select(KEY, F.explode(F.sequence("a", F.col("b") + STEP, F.lit(STEP).cast("long"))).alias("minute"))
    grid = grid.join(ends.select(KEY, "a", "b"), KEY).where(F.col("minute") <= F.col("b") + STEP).drop("a", "b")
    w = Window.partitionBy(KEY).orderBy("minute")
    f = grid.join(glucose, [KEY, "minute"], "left")
    at = F.when(F.col("glucose").isNotNull(), F.col("minute"))
    f = f.select("*", F.last(at, True).over(w).alias("m0"), F.last("glucose", True).over(w).alias("g0"))
    ahead = w.rowsBetween(0, Window.unboundedFollowing)
    f = f.select("*", F.first(at, True).over(ahead).alias("m1"), F.first("glucose", True).over(ahead).alias("g1"))
    gap = F.col("m1") - F.col("m0")
    line = F.col("g0") + (F.col("g1") - F.col("g0")) * (F.col("minute") - F.col("m0")) / gap
    f = f.withColumn("glucose_in", F.when(F.col("glucose").isNotNull(), F.col("glucose")).when(gap / STEP - 1 <= fill_steps, line)).drop("m0", "m1", "g0", "g1")
    bin_ = (F.col("phase") + STEP * F.ceil((F.col("minute") - F.col("phase")) / STEP)).cast("long")
    put = lambda df: df.join(phase, KEY).withColumn("minute", bin_).drop("phase")
    hr = put(heart_rate).groupBy(KEY, "minute").agg(F.avg("value").alias("hr"))
    energy = put(kcal).groupBy(KEY, "minute").agg(F.sum("value").alias("active_kcal"))
    eaten = put(meals).groupBy(KEY, "minute").agg(*[F.sum(F.coalesce(F.col(c), F.lit(0.0))).alias(c) for c in MACROS], F.count("*").cast("double").alias("meal"))
    for x in (hr, energy, eaten):
        f = f.join(x, [KEY, "minute"], "left")
    zero = [F.coalesce(c, F.lit(0.0)).alias(c) for c in (*MACROS, "meal")]
    return f.select(KEY, "minute", C.rounded(F.col("glucose"), 6).alias("glucose"), C.rounded(F.col("glucose_in"), 6).alias("glucose_in"), C.rounded(F.col("hr"), 6).alias("hr"), "active_kcal", *zero)


def origins(frame: DataFrame, lookback: int = 36, horizons: Sequence[int] = (15, 30, 60)) -> DataFrame:
    """(patient_id, minute, now, targets): grid points with a reading, a complete bridged lookback and some target.

    ``frame`` is a complete grid, so rows are times.
    """
    w = Window.partitionBy(KEY).orderBy("minute")
    f = frame.withColumn("n", F.count("glucose_in").over(w.rowsBetween(-lookback + 1, 0)))
    f = f.select(KEY, "minute", F.col("glucose").alias("now"), "n", *[F.lead("glucose", h // STEP).over(w).alias(f"t{h}") for h in horizons])
    return f.where((F.col("n") == lookback) & F.col("now").isNotNull() & F.coalesce(*[F.col(f"t{h}") for h in horizons]).isNotNull()).drop("n")


def scores(pairs: DataFrame, by: Sequence[str]) -> DataFrame:
    """RMSE, MAE, MARD, bias and skill against persistence of (now, target, pred)."""
    e, base = F.col("pred") - F.col("target"), F.col("now") - F.col("target")
    g = pairs.groupBy(*by).agg(F.count("*").alias("n"), F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"), F.avg(F.abs(e) / F.col("target")).alias("mard"), F.avg(e).alias("bias"), F.avg(base * base).alias("base"))
    skill = 1 - F.sqrt("mse") / F.nullif(F.sqrt("base"), F.lit(0.0))
    return g.select(*by, "n", C.rounded(F.sqrt("mse"), 4).alias("rmse"), C.rounded(F.col("mae"), 4).alias("mae"), C.rounded(100 * F.col("mard"), 3).alias("mard_pct"), C.rounded(F.col("bias"), 4).alias("bias"), C.rounded(skill, 4).alias("skill"))


def common(predictions: DataFrame, models: int) -> DataFrame:
    """(model, patient_id, minute, horizon, now, target, pred) of the origins that every model has a forecast and a target for."""
    full = predictions.where("pred is not null and target is not null")
    each = full.groupBy(KEY, "minute", "horizon").agg(F.count_distinct("model").alias("m")).where(F.col("m") == models).drop("m")
    return full.join(each, [KEY, "minute", "horizon"], "left_semi")


def score_table(predictions: DataFrame, models: int, groups: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(by model, by patient, by group) over common origins; groups are (patient_id, group)."""
    c = common(predictions, models)
    by = ["model", "horizon"]
    return scores(c, by), scores(c, [*by, KEY]), scores(c.join(groups, KEY), [*by, "group"])


def prepared(static: DataFrame, cohort: str) -> DataFrame:
    """Population covariates: steps only from people with four valid days or more, no duration without a diagnosis."""
    s = static.where((F.col("cohort") == cohort) & F.col("hba1c").isNotNull())
    return s.select(
        KEY, "hba1c", (F.col("sex") == "male").cast("double").alias("male"), F.coalesce(F.col("smoking").isin("daily", "occasional"), F.lit(False)).cast("double").alias("current_smoker"),
        (F.when(F.col("valid_step_days") >= 4, F.col("steps_per_valid_day")) / 1000).alias("steps_k"), F.col("diagnosed").cast("double").alias("diagnosed"), F.when(F.col("diagnosed"), F.col("duration")).otherwise(0.0).alias("duration"),
    )


def _moments(rows: DataFrame, terms: Sequence[str], y: str, weight: Column, by: Sequence[str]) -> list:
    x = [F.lit(1.0), *[F.col(t).cast("double") for t in terms]]
    sums = [F.sum(weight * a * b).alias(f"x{i}_{j}") for i, a in enumerate(x) for j, b in enumerate(x) if j >= i] + [F.sum(weight * a * F.col(y)).alias(f"y{i}") for i, a in enumerate(x)]
    return rows.groupBy(*by).agg(*sums).collect()  # one row a replicate


def _solve(row, k: int) -> np.ndarray:
    a = np.array([[row[f"x{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)], float)
    return np.linalg.lstsq(a, np.array([row[f"y{i}"] for i in range(k)], float), rcond=None)[0]


def associations(rows: DataFrame, terms: Sequence[str], y: str, key: str = KEY, replicates: int = 500, seed: int = 0) -> DataFrame:
    """(term, coef, ci_low, ci_high): least squares with a percentile interval of a Poisson bootstrap.

    A row's weight in a replicate is a Poisson(1) number made of a hash of its key, so one pass sums the moments of
    all replicates; what reaches the driver is ``replicates`` rows of moments. Rows with a missing term are left out.
    """
    full = rows.where(" and ".join(f"{c} is not null" for c in (*terms, y)))
    k = len(terms) + 1
    coef = _solve(_moments(full, terms, y, F.lit(1.0), [])[0], k)
    u = F.pmod(F.xxhash64(F.col(key), F.col("replicate"), F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    steps = np.cumsum([np.exp(-1.0) / np.prod(range(1, n + 1) or [1]) for n in range(8)])
    weight = sum(((u > float(s)).cast("double") for s in steps), F.lit(0.0))
    many = full.withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    boots = np.array([_solve(r, k) for r in _moments(many, terms, y, weight, ["replicate"])])
    low, high = np.percentile(boots, [2.5, 97.5], axis=0)
    out = [(t, float(c), float(a), float(b)) for t, c, a, b in zip(["intercept", *terms], coef, low, high)]
    return rows.sparkSession.createDataFrame(out, "term string, coef double, ci_low double, ci_high double")


def forecast_inputs(series: DataFrame, at: DataFrame, before: int, after: int) -> DataFrame:
    """(patient_id, kind, minute, value): what a forecast at (patient_id, at) sees: ``before`` minutes up to it and ``after`` minutes beyond."""
    j = series.join(at, KEY).where((F.col("minute") > F.col("at") - before) & (F.col("minute") <= F.col("at") + after))
    return j.select(KEY, F.when(F.col("minute") <= F.col("at"), "history").otherwise("after").alias("kind"), "minute", "value")


def real_age(birth: Column, match_difference: Column, day: Column) -> Column:
    """The age of the real participant behind a composite patient: the twin's less the difference they were matched with."""
    return C.age_at(birth, day) - F.coalesce(match_difference, F.lit(0))


def clipped_share(x: Column) -> Column:
    return M.clip(x, 0.0, 100.0)
