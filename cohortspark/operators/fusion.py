"""Fusion of two glucose sensors of every patient: minute series, lag, meal peaks, alignment, calibration, blending.

Series are (patient_id, minute, value) with whole minutes. Each step runs for all patients at once as joins, windows
and aggregates keyed by patient; nothing is collected.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortspark.functions import clinical as C
from cohortspark.functions import measures as M
from cohortspark.operators.beside import best_lag, by_patient, minute_values, peak
from cohortspark.operators.rounds import settled

# Limits of the sensors, longest gaps, the search range and the grid, in mg/dL and minutes.
LOW, HIGH = 40.0, 400.0
REFERENCE_GAP, SECONDARY_GAP = 10, 20
LAG_REACH, SENSOR_LAG = 120, 20
GRID, WARMUP, LEAST, MAX_FACTOR = 5, 1440, 60, 25.0
KEY = "patient_id"


def minute_series(native: DataFrame, max_gap: int) -> DataFrame:
    """One value a minute between readings at most ``max_gap`` minutes apart, on the line between them."""
    w = Window.partitionBy(KEY).orderBy("minute")
    n = native.where("value is not null").select(KEY, "minute", F.col("value").cast("double").alias("value"))
    n = n.withColumn("next", F.lead("minute").over(w)).withColumn("to", F.lead("value").over(w))
    gap = F.col("next") - F.col("minute")
    steps = F.when(gap <= max_gap, F.sequence(F.lit(0), gap.cast("int") - 1)).otherwise(F.array(F.lit(0)))
    n = n.withColumn("i", F.explode(steps))
    value = F.when(F.col("i") == 0, F.col("value")).otherwise(F.col("value") + (F.col("to") - F.col("value")) * F.col("i") / gap)
    return n.select(KEY, (F.col("minute") + F.col("i")).alias("minute"), value.alias("value"))


def shifted(series: DataFrame, minutes: Column) -> DataFrame:
    """A series moved by minutes, which may differ by patient."""
    return series.withColumn("minute", F.col("minute") + minutes)


def lags(reference: DataFrame, secondary: DataFrame, reach: int = LAG_REACH) -> DataFrame:
    """(patient_id, lag, r): minutes that the secondary minute series is late, by the greatest correlation; the first of equal ones.

    Both series are packed to arrays where their readings already are, so that nothing but the readings is shuffled, by patient.
    """
    return by_patient({"r": reference, "s": secondary}, KEY, lambda r, s: best_lag(r, s, reach), "lag int, r double")


def meal_peaks(minutes: DataFrame, meals: DataFrame, before: int = 15, after: int = 180) -> DataFrame:
    """(patient_id, peak): minutes from a meal to the top of the mean rise over meals (patient_id, minute).

    A meal counts if more than nine tenths of its minutes have a value; its rise starts at the mean of the minutes up
    to it.
    Series and meals are packed to arrays where they are.
    """
    eaten = meals.distinct().select(KEY, "minute", F.lit(0.0).alias("value"))

    def tell(series, eaten):
        top = peak(series, eaten[0], before, after)
        return None if top is None else (top,)

    return by_patient({"v": minutes, "e": eaten}, KEY, tell, "peak int")


def lag_and_peaks(reference: DataFrame, secondary: DataFrame, meals: DataFrame, reach: int = LAG_REACH, before: int = 15, after: int = 180) -> DataFrame:
    """(patient_id, lag, reference_peak, secondary_peak) of native readings: what ``lags`` and ``meal_peaks`` tell of their minute series, in one pass."""

    def tell(r, s, eaten):
        r, s, at = minute_values(r, REFERENCE_GAP), minute_values(s, SECONDARY_GAP), np.unique(eaten[0])
        found = best_lag(r, s, reach)
        return found and (found[0], peak(r, at, before, after), peak(s, at, before, after))

    return by_patient({"r": reference, "s": secondary, "e": meals.select(KEY, "minute", F.lit(0.0).alias("value"))}, KEY, tell, "lag int, reference_peak int, secondary_peak int")


def alignment(lag: DataFrame, peaks: DataFrame) -> DataFrame:
    """(patient_id, lag, kind, reference_shift, secondary_shift) from lags and (patient_id, reference_peak, secondary_peak).

    A short lag is the sensor's: the later one is moved onto the earlier. A long one is a clock's: the sensor whose
    peak is nearer to the cohort's median, over patients with short lags, stays. The median is one row.
    """
    j = lag.select(KEY, "lag").join(peaks, KEY, "left")
    short = F.abs("lag") <= SENSOR_LAG
    typical = j.where(short).select(F.explode(F.array_compact(F.array("reference_peak", "secondary_peak"))).alias("p")).agg(F.median("p").alias("cohort_peak"))
    j = j.crossJoin(F.broadcast(typical))
    off = lambda c: F.abs(F.col(c) - F.col("cohort_peak"))
    right = F.coalesce(off("secondary_peak") < off("reference_peak"), F.lit(False))
    none = F.lit(0)
    return j.select(
        KEY, "lag", F.when(short, "sensor_lag").otherwise("clock_offset").alias("kind"),
        F.when(short, F.least("lag", none)).when(right, F.col("lag")).otherwise(none).alias("reference_shift"),
        F.when(short, -F.greatest("lag", none)).when(right, none).otherwise(-F.col("lag")).alias("secondary_shift"),
    )


def valid(x: Column) -> Column:
    return (x > LOW) & (x < HIGH)


def _beside(reference: DataFrame, secondary: DataFrame, r: str, s: str) -> DataFrame:
    """(patient_id, minute, r, s) of the minutes of either series; where both are dealt by patient they stay so, which a join on both keys would undo."""
    none = F.lit(None).cast("double")
    rows = reference.select(KEY, "minute", F.col("value").alias(r), none.alias(s)).unionByName(secondary.select(KEY, "minute", none.alias(r), F.col("value").alias(s)))
    return rows.groupBy(KEY, "minute").agg(F.max(r).alias(r), F.max(s).alias(s))


def _starts(reference: DataFrame, secondary: DataFrame) -> DataFrame:
    first = lambda s, name: s.groupBy(KEY).agg(F.min("minute").alias(name))
    return first(reference, "r0").join(first(secondary, "s0"), KEY, "full")


def calibrated(reference: DataFrame, secondary: DataFrame, warmup: int = WARMUP, least: int = LEAST) -> DataFrame:
    """(patient_id, intercept, slope, settled, sd, factor) that put the aligned secondary on the reference's scale.

    A Deming line over the valid common minutes after both warm-ups; patients with fewer than ``least`` of them have
    none. The warm-up's variance factor compares robust spreads, which need the line and then the medians.
    """
    both = _beside(minute_series(reference, REFERENCE_GAP), minute_series(secondary, SECONDARY_GAP), "r", "s").where(valid(F.col("r")) & valid(F.col("s")))
    both = both.join(_starts(reference, secondary), KEY)
    both = both.withColumn("warm", (F.col("minute") < F.col("r0") + warmup) | (F.col("minute") < F.col("s0") + warmup))
    cool = lambda f, *c: f(*[F.when(~F.col("warm"), F.col(x)) for x in c]).over(Window.partitionBy(KEY))
    fit = both.select(KEY, "warm", "r", "s", cool(F.count, "r").alias("settled"), cool(F.var_pop, "s").alias("vx"), cool(F.var_pop, "r").alias("vy"), cool(F.covar_pop, "s", "r").alias("c"), cool(F.avg, "s").alias("mx"), cool(F.avg, "r").alias("my"))
    d = F.col("vy") - F.col("vx")
    fit = fit.where(F.col("settled") >= least).withColumn("slope", (d + F.sqrt(d * d + 4 * F.col("c") * F.col("c"))) / F.nullif(2 * F.col("c"), F.lit(0.0)))
    fit = fit.withColumn("intercept", F.col("my") - F.col("slope") * F.col("mx"))
    off = fit.withColumn("off", F.col("r") - (F.col("intercept") + F.col("slope") * F.col("s")))
    line = [F.first(c).alias(c) for c in ("intercept", "slope", "settled")]
    mid = off.groupBy(KEY, "warm").agg(*line, F.count("*").alias("n"), F.median("off").alias("mid"), F.collect_list("off").alias("offs"))
    apart = mid.select(KEY, "warm", "intercept", "slope", "settled", "n", F.explode_outer(F.transform("offs", lambda x: F.abs(x - F.col("mid")))).alias("apart"))
    spread = apart.groupBy(KEY, "warm").agg(*line, F.first("n").alias("n"), (1.4826 * F.median("apart")).alias("sd"))
    at = lambda warm, c: F.max(F.when(F.col("warm") == warm, F.col(c)))
    wide = spread.groupBy(KEY).agg(*line, at(False, "sd").alias("sd"), at(True, "sd").alias("warm_sd"), at(True, "n").alias("warm_n"))
    ratio = F.col("warm_sd") / F.nullif(F.col("sd"), F.lit(0.0))
    factor = F.when((F.col("warm_n") >= least) & (F.col("sd") > 0), M.clip(2 * ratio * ratio - 1, 1.0, MAX_FACTOR)).otherwise(1.0)
    return wide.select(KEY, "intercept", "slope", "settled", "sd", factor.alias("factor"))


def fused(reference: DataFrame, secondary: DataFrame, calibration: DataFrame, warmup: int = WARMUP) -> DataFrame:
    """(patient_id, minute, glucose, source, censored) every five minutes: weighted by the warm-up's variance where both are valid."""
    on_grid = lambda s, gap: minute_series(s, gap).where(F.col("minute") % GRID == 0)
    j = _beside(on_grid(reference, REFERENCE_GAP), on_grid(secondary, SECONDARY_GAP), "r", "raw").join(calibration, KEY).join(_starts(reference, secondary), KEY)
    j = j.withColumn("s", F.col("intercept") + F.col("slope") * F.col("raw"))
    r_ok, s_ok = F.coalesce(valid(F.col("r")), F.lit(False)), F.coalesce(valid(F.col("raw")), F.lit(False))
    weight = lambda start: F.when(F.col("minute") < F.col(start) + warmup, 1 / F.col("factor")).otherwise(1.0)
    wr, ws = weight("r0"), weight("s0")
    value = F.when(r_ok & s_ok, (wr * F.col("r") + ws * F.col("s")) / (wr + ws)).when(r_ok, F.col("r")).when(s_ok, F.col("s")).otherwise(F.coalesce("r", "s"))
    has_r, has_s = F.col("r").isNotNull(), F.col("s").isNotNull()
    source = F.when(r_ok & s_ok, "both").when(r_ok, "reference_only").when(s_ok, "secondary_only").when(has_r & has_s, "both").when(has_r, "reference_only").otherwise("secondary_only")
    out = j.withColumn("v", value).withColumn("source", source).withColumn("censored", ~(r_ok | s_ok) | (F.col("v") <= LOW) | (F.col("v") >= HIGH))
    return out.where("v is not null and not isnan(v)").select(KEY, "minute", C.rounded(M.clip(F.col("v"), LOW, HIGH), 1).alias("glucose"), "source", "censored")


def single(reference: DataFrame) -> DataFrame:
    """The same grid and rule for a patient with one sensor."""
    r = minute_series(reference, REFERENCE_GAP).where(F.col("minute") % GRID == 0)
    return r.select(KEY, "minute", C.rounded(M.clip(F.col("value"), LOW, HIGH), 1).alias("glucose"), F.lit("reference_only").alias("source"), ((F.col("value") <= LOW) | (F.col("value") >= HIGH)).alias("censored"))


def run(reference: DataFrame, secondary: DataFrame, meals: DataFrame, reach: int = LAG_REACH, warmup: int = WARMUP, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """(alignment with calibration, fused stream) of all patients: lags and peaks first, then their median, then the rest.

    What is found out of each patient, the alignment and the calibration, one row a patient, are stored in between: later steps
    read each of them several times. Readings alone are shuffled, by patient.
    """
    found = settled(lag_and_peaks(reference, secondary, meals, reach))
    moves = settled(alignment(found.select(KEY, "lag"), found.drop("lag")))
    moved = lambda series, c: shifted(series.join(moves.select(KEY, c), KEY), F.col(c)).drop(c)
    ref, sec = moved(reference, "reference_shift"), moved(secondary, "secondary_shift")
    calibration = settled(calibrated(ref, sec, warmup, least))
    return moves.join(calibration, KEY, "left"), fused(ref, sec, calibration, warmup)


def validated(reference: DataFrame, secondary: DataFrame, stream: DataFrame, hba1c: DataFrame, fingersticks: DataFrame, tolerance: int = 5) -> DataFrame:
    """How near each stream is to the laboratory and to fingersticks (patient_id, minute, value), and the coverage gained.

    The nearest value within ``tolerance`` minutes of a fingerstick counts, of equally near ones the later.
    """
    streams = {"reference": minute_series(reference, REFERENCE_GAP), "fused": stream.select(KEY, "minute", F.col("glucose").alias("value"))}
    out = hba1c.select(KEY, "hba1c")
    for name, raw in (("reference", reference), ("secondary_raw", secondary), ("fused", streams["fused"])):
        gmi = raw.groupBy(KEY).agg(C.rounded(C.gmi(F.avg("value")), 2).alias(f"gmi_{name}"))
        out = out.join(gmi, KEY, "left").withColumn(f"off_{name}", C.rounded(F.abs(F.col(f"gmi_{name}") - F.col("hba1c")), 2))
    spots = fingersticks.select(KEY, F.col("minute").alias("at"), F.col("value").alias("stick")).withColumn("minute", F.explode(F.sequence(F.col("at") - tolerance, F.col("at") + tolerance)))
    for name, series in streams.items():
        near = spots.join(series, [KEY, "minute"]).groupBy(KEY, "at").agg(F.first("stick").alias("stick"), F.min_by("value", F.struct(F.abs(F.col("minute") - F.col("at")), -F.col("minute"))).alias("v"))
        mard = near.groupBy(KEY).agg(C.rounded(100 * F.avg(F.abs(F.col("v") - F.col("stick")) / F.col("stick")), 1).alias(f"mard_{name}"), F.count("*").alias(f"n_{name}"))
        out = out.join(mard, KEY, "left").withColumn(f"n_{name}", F.coalesce(f"n_{name}", F.lit(0)))
    grid = stream.select(KEY, "minute").join(streams["reference"].select(KEY, "minute", F.lit(1).alias("hit")), [KEY, "minute"], "left").groupBy(KEY).agg(F.count("*").alias("all"), F.count("hit").alias("hits"))
    gain = grid.select(KEY, C.rounded(100 * (F.col("all") / F.nullif(F.col("hits"), F.lit(0)) - 1), 1).alias("coverage_gain"))
    return out.join(gain, KEY, "left")
