"""Clinical and time expressions. Times are naive local times unless a zone is named.

Fixed values: the published constants of GMI, Friedewald, CKD-EPI 2021, HOMA-IR, the HbA1c and glucose bands and the
Clarke grid.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(x: Column, digits: int = 0) -> Column:
    """Half away from zero on the double itself, the same in every engine."""
    scale = float(10**digits)
    x = x.cast("double")
    return F.signum(x) * (F.floor(F.abs(x) * scale + 0.5) / scale) + 0.0


def gmi(mean: Column) -> Column:
    """Glucose management indicator of a mean in mg/dL."""
    return 3.31 + 0.02392 * mean


def friedewald(total: Column, hdl: Column, triglycerides: Column) -> Column:
    """LDL by Friedewald; undefined above 400 mg/dL of triglycerides."""
    return F.when(triglycerides <= 400, total - hdl - triglycerides / 5)


def egfr(creatinine: Column, age: Column, female: Column) -> Column:
    """CKD-EPI 2021, unrounded."""
    k = F.when(female, 0.7).otherwise(0.9)
    low = F.pow(F.least(creatinine / k, F.lit(1.0)), F.when(female, -0.241).otherwise(-0.302))
    high = F.pow(F.greatest(creatinine / k, F.lit(1.0)), F.lit(-1.2))
    return 142 * low * high * F.pow(F.lit(0.9938), age) * F.when(female, 1.012).otherwise(1.0)


def homa_ir(glucose: Column, insulin: Column) -> Column:
    return glucose * insulin / 405


def age_at(birth: Column, day: Column) -> Column:
    """Whole years by (month, day) comparison."""
    before = (F.month(day) * 100 + F.dayofmonth(day)) < (F.month(birth) * 100 + F.dayofmonth(birth))
    return F.year(day) - F.year(birth) - before.cast("int")


def a1c_group(a1c: Column) -> Column:
    return F.when(a1c < 5.7, "normal").when(a1c < 6.5, "prediabetes").when(a1c.isNotNull(), "t2d")


def night_of(local: Column) -> Column:
    """The night a naive local time belongs to: the date twelve hours earlier."""
    return F.to_date(local - F.expr("interval 12 hours"))


def local_time(utc: Column, zone: str) -> Column:
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), utc)


def shift_days(local: Column, days: Column, zone: str) -> Column:
    """A wall-clock time moved by whole days; null where the zone skips or repeats that time."""
    moved = local + F.make_dt_interval(days)
    utc = F.convert_timezone(F.lit(zone), F.lit("UTC"), moved)
    back = F.convert_timezone(F.lit("UTC"), F.lit(zone), utc)
    twice = F.lit(False)
    for hour in (-1, 1):
        twice = twice | (F.convert_timezone(F.lit("UTC"), F.lit(zone), utc + F.make_dt_interval(F.lit(0), F.lit(hour))) == moved)
    return F.when((back == moved) & ~twice, moved)


def split_of(patient: Column) -> Column:
    """70/15/15 by the first 32 bits of the id's md5."""
    part = F.conv(F.substring(F.md5(patient.cast("string")), 1, 8), 16, 10).cast("long") % 100
    return F.when(part < 70, "train").when(part < 85, "validation").otherwise("test")


def glucose_band(x: Column) -> Column:
    return F.when(x < 54, "very_low").when(x < 70, "low").when(x <= 180, "in_range").when(x <= 250, "high").when(x.isNotNull(), "very_high")


def trend(slope: Column) -> Column:
    """Five levels of a slope in mg/dL a minute."""
    return F.when(slope < -2, "falling_fast").when(slope < -1, "falling").when(slope < 1, "steady").when(slope < 2, "rising").when(slope.isNotNull(), "rising_fast")


def trend_of(rise: str, run: str) -> Column:
    """Five levels of the slope rise / run in thousandths of mg/dL a second: whole numbers are compared, nothing is divided."""
    level = F.when(F.col(run) <= 0, None)
    for limit, name in ((-2, "falling_fast"), (-1, "falling"), (1, "steady"), (2, "rising")):
        level = level.when(60 * F.col(rise) < 1000 * limit * F.col(run), name)
    return level.when(F.col(rise).isNotNull(), "rising_fast")


def slope_of(rise: str, run: str) -> Column:
    """The same slope in mg/dL a minute, half away from zero to two digits."""
    size = F.expr(f"(12 * abs({rise}) + {run}) div (2 * {run})") / 100
    return F.when(F.col(run) > 0, F.when(F.col(rise) < 0, -size).otherwise(size))


def clarke_zone(reference: Column, predicted: Column) -> Column:
    """Clarke error grid. Zones overlap on their borders: A is asked first, then E, C and D; what is left is B."""
    r, p = reference.cast("double"), predicted.cast("double")
    hypo = 175.0 / 3
    near = (p >= 0.8 * r) & (p <= 1.2 * r) | (r <= 70) & (p <= 70)
    opposite = (r >= 180) & (p <= 70) | (r <= 70) & (p >= 180)
    overcorrect = r.between(70, 290) & (p >= r + 110) | r.between(130, 180) & (p <= 1.4 * r - 182)
    missed = ((r >= 240) | (r <= hypo)) & p.between(70, 180) | r.between(hypo, 70) & (p >= 1.2 * r)
    zone = F.when(near, "A").when(opposite, "E").when(overcorrect, "C").when(missed, "D").otherwise("B")
    return F.when(r.isNotNull() & p.isNotNull(), zone)
