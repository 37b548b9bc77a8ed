"""Ranges, flags, doses and texts of the record; ids and clock texts. Column expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Reference ranges by measure and sex (None: any): lower and upper limit of normal.
RANGES: list[tuple[str, str | None, float | None, float | None]] = [
    ("hba1c", None, None, 5.7),
    ("glucose_fasting", None, 70.0, 99.0),
    ("cholesterol_total", None, None, 199.0),
    ("hdl", "male", 40.0, None),
    ("hdl", "female", 50.0, None),
    ("triglycerides", None, None, 149.0),
    ("creatinine", "male", 0.74, 1.35),
    ("creatinine", "female", 0.59, 1.04),
    ("insulin", None, 2.6, 24.9),
]
# Panels of measures, in the order in which a record shows them.
PANELS: dict[str, tuple[str, ...]] = {
    "glycaemia": ("hba1c", "glucose_fasting", "insulin"),
    "lipids": ("cholesterol_total", "hdl", "triglycerides"),
    "kidney": ("creatinine",),
    "body": ("weight", "height"),
}
# Unit spellings that mean the expected one.
UNIT_ALIASES: dict[str, str] = {"mg/dl": "mg/dL", "MG/DL": "mg/dL", "percent": "%", "kilogram": "kg"}


def flag(value: Column, low: Column, high: Column) -> Column:
    """low, high or normal against a range with one or two limits; null without a value or any limit."""
    known = value.isNotNull() & (low.isNotNull() | high.isNotNull())
    return F.when(known, F.when(F.coalesce(value < low, F.lit(False)), "low").when(F.coalesce(value > high, F.lit(False)), "high").otherwise("normal"))


def worst(flags: Column) -> Column:
    """The flag of a result with several components: high before low before normal."""
    return F.when(F.array_contains(flags, "high"), "high").when(F.array_contains(flags, "low"), "low").when(F.array_contains(flags, "normal"), "normal")


def frequency(per_day: Column) -> Column:
    """Times a day in words: once, twice, three and four times, weekly, monthly, every n days."""
    days = F.round(1 / F.nullif(per_day, F.lit(0.0))).cast("int")
    words = F.when(per_day == 1, "once daily").when(per_day == 2, "twice daily").when(per_day == 3, "three times daily").when(per_day == 4, "four times daily")
    words = words.when(per_day > 1, F.concat(F.round(per_day).cast("int").cast("string"), F.lit(" times daily")))
    words = words.when(days == 7, "weekly").when(days.between(28, 31), "monthly")
    return words.when(per_day > 0, F.concat(F.lit("every "), days.cast("string"), F.lit(" days")))


def plain(x: Column) -> Column:
    """A number without trailing zeros, at most two decimals."""
    return F.regexp_replace(F.regexp_replace(x.cast("decimal(18,2)").cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")


def dosage_text(strength: Column, unit: Column, per_day: Column) -> Column:
    """Strength and frequency joined by a dot; what is missing is left out, null if both are."""
    amount = F.concat_ws(" ", plain(strength), F.when(strength.isNotNull(), unit))
    return F.nullif(F.concat_ws(" · ", F.nullif(amount, F.lit("")), frequency(per_day)), F.lit(""))


def dose(strength: Column, unit: Column, quantity: Column) -> Column:
    """Strength times quantity; null for concentrations, whose unit has a slash."""
    return F.when(~F.contains(unit, F.lit("/")), strength * quantity)


def canonical_unit(unit: Column) -> Column:
    out = unit
    for alias, name in UNIT_ALIASES.items():
        out = F.when(unit == alias, name).otherwise(out)
    return out


def clip(x: Column, low: float, high: float) -> Column:
    """Null stays null (least and greatest skip nulls)."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def time_of_day(local: Column) -> tuple[Column, Column]:
    """Sine and cosine of the minute of a naive local day."""
    angle = (F.hour(local) * 60 + F.minute(local)) * (2 * 3.141592653589793 / 1440)
    return F.sin(angle), F.cos(angle)


def uuid5(namespace: str, name: Column) -> Column:
    """The name-based (SHA-1, version 5) UUID in a namespace given as 32 hex digits, with built-in functions only."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "UTF-8")))
    variant = F.substring(F.lit("89ab"), (F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") % 4 + 1), F.lit(1))
    return F.concat_ws("-", F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.concat(F.lit("5"), F.substring(digest, 14, 3)), F.concat(variant, F.substring(digest, 18, 3)), F.substring(digest, 21, 12))


def iso_in_zone(utc: Column, zone: str) -> Column:
    """ISO text of a naive UTC time in a zone, with its offset from UTC."""
    local = F.convert_timezone(F.lit("UTC"), F.lit(zone), utc)
    minutes = (F.unix_micros(local.cast("timestamp")) - F.unix_micros(utc.cast("timestamp"))) / 60000000
    sign = F.when(minutes < 0, "-").otherwise("+")
    off = F.concat(sign, F.lpad(F.floor(F.abs(minutes) / 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((F.abs(minutes) % 60).cast("int").cast("string"), 2, "0"))
    return F.concat(F.date_format(local, "yyyy-MM-dd'T'HH:mm:ss"), off)
