"""Readers of sensor, survey and record exports: files to typed DataFrames, as projections of the raw text columns.

Every ``read_*`` takes a path that Spark can list (one file or a folder of them, so a cohort is one scan); every other
function takes the raw columns and can be used on any table that has them. What does not parse is null, and a file
without the columns that it must have is an error.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Columns of the exports, codes and conversion factors.
LB_TO_KG, IN_TO_CM = 0.45359237, 2.54
BIO_LABS = {
    "A1c PDL (Lab)": ("4548-4", 1.0),
    "Fasting GLU - PDL (Lab)": ("1558-6", 1.0),
    "Insulin": ("20448-7", 1.0),
    "Cholesterol": ("2093-3", 1.0),
    "HDL": ("2085-9", 1.0),
    "Triglycerides": ("2571-8", 1.0),
    "Body weight": ("29463-7", LB_TO_KG),
    "Height": ("8302-2", IN_TO_CM),
}
BIO_COLUMNS = ("subject", "Age", "Gender", "Self-identify", "Collection time PDL (Lab)", *BIO_LABS)
STICK = r"^#\d Contour Fingerstick GLU$"
SENSOR_COLUMNS = ("Timestamp", "Libre GL", "Dexcom GL", "HR", "Meal Type", "Image path")
MACROS = {"Calories": "energy_kcal", "Carbs": "carbs_g", "Protein": "protein_g", "Fat": "fat_g", "Fiber": "fiber_g", "Amount Consumed": "pct_consumed"}
CLOCKS = ("h:mm:ss a", "h:mm a", "H:mm:ss", "H:mm")
PERIODS = {"d": 1.0, "h": 24.0, "wk": 1 / 7, "mo": 1 / 30}
CYCLE_YEARS = {"G": 2012, "H": 2014}
ENCOUNTER_CLASSES = {"AMB": "ambulatory", "EMER": "emergency", "IMP": "inpatient", "VR": "virtual", "HH": "home"}
SMOKING = {"never": "266919005", "daily": "449868002", "occasional": "428041000124106", "former": "8517006"}
RXNORM = "http://www.nlm.nih.gov/research/umls/rxnorm"


def _clean(name: str) -> str:
    return name.lstrip("﻿").strip()


def _require(columns: Sequence[str], found: Sequence[str], what: str) -> None:
    missing = sorted(set(columns) - set(found))
    if missing:
        raise ValueError(f"{what} has no columns {missing}")


def read_text_table(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file as text columns; names are trimmed, unnamed columns are dropped, of equal names the first counts."""
    raw = spark.read.csv(path, header=False, multiLine=True, escape='"')
    first = spark.read.csv(path, header=False, multiLine=True, escape='"').first()
    if first is None:
        raise ValueError(f"{path} is empty")
    names = [_clean(c or "") for c in first]
    keep = [i for i, n in enumerate(names) if n and not n.startswith("Unnamed") and n not in names[:i]]
    head = F.col(raw.columns[0]).eqNullSafe(F.lit(first[0]))  # every file of a folder has the header again
    return raw.where(~head).select(*[F.col(raw.columns[i]).alias(names[i]) for i in keep])


def read_bio(spark: SparkSession, path: str) -> DataFrame:
    """Participants: (subject_id, sex, age, race, labs, lab_time, fingersticks).

    A fingerstick's clock is the column to its right, whatever that is called: several have one name. ``labs`` are
    (code, value) in UCUM units. Rows without a subject are dropped.
    """
    raw = spark.read.csv(path, header=False)
    first = raw.first()
    names = [_clean(c or "") for c in first]
    _require(BIO_COLUMNS, names, path)
    rows = raw.where(~F.col(raw.columns[0]).eqNullSafe(F.lit(first[0])))
    at = lambda name: F.col(raw.columns[names.index(name)])
    lab = lambda name, code, factor: F.struct(F.lit(code).alias("code"), F.round(number(at(name)) * factor, 2).alias("value"))
    sticks = [i for i, n in enumerate(names) if n.startswith("#") and n.endswith(" Contour Fingerstick GLU") and i + 1 < len(names)]
    stick = [F.struct(clock(F.col(raw.columns[i + 1])).alias("clock"), number(F.col(raw.columns[i])).alias("mg_dl")) for i in sticks]
    return rows.where(F.trim(at("subject")) != "").select(
        F.lpad(F.trim(at("subject")).cast("int").cast("string"), 3, "0").alias("subject_id"),
        F.when(F.upper(F.trim(at("Gender"))) == "F", "female").when(F.upper(F.trim(at("Gender"))) == "M", "male").otherwise(F.raise_error(F.lit("unknown gender"))).alias("sex"),
        number(at("Age")).cast("int").alias("age"),
        race(at("Self-identify")).alias("race"),
        F.filter(F.array(*[lab(n, *x) for n, x in BIO_LABS.items()]), lambda x: x["value"].isNotNull()).alias("labs"),
        clock(at("Collection time PDL (Lab)")).alias("lab_time"),
        F.filter(F.array(*stick), lambda x: x["clock"].isNotNull() & x["mg_dl"].isNotNull()).alias("fingersticks") if stick else F.array().alias("fingersticks"),
    )


def number(text: Column) -> Column:
    """A number or null; the texts nan and NaN are null."""
    x = F.trim(text.cast("string"))
    return F.when(~F.lower(x).isin("nan", ""), x.try_cast("double"))


def clock(text: Column) -> Column:
    """HH:mm:ss of a clock of 12 or 24 hours, with or without seconds; null if it is none."""
    x = F.upper(F.trim(text))
    times = [F.try_to_timestamp(F.concat(F.lit("2000-01-01 "), x), F.lit(f"yyyy-MM-dd {f}")) for f in CLOCKS]
    return F.date_format(F.coalesce(*times), "HH:mm:ss")


def race(text: Column) -> Column:
    x, low = F.trim(text), F.lower(F.trim(text))
    return F.when(low.contains("african american") | low.contains("black"), "Black or African American").when(x != "", x)


def meal_type(text: Column) -> Column:
    """snack, breakfast, lunch or dinner; null for none; anything else is an error."""
    x = F.lower(F.trim(text))
    known = F.when(x.isNull() | (x == ""), F.lit(None).cast("string")).when(x.startswith("snack"), "snack").when(x.isin("breakfast", "lunch", "dinner"), x)
    return known.otherwise(F.raise_error(F.concat(F.lit("unknown meal type "), x)).cast("string"))


def first_by_time(rows: DataFrame, key: Sequence[str], order: str) -> DataFrame:
    """The first row of each key in file order."""
    w = Window.partitionBy(*key).orderBy(order)
    return rows.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn", order)


def sensor_rows(raw: DataFrame, subject: Column | None = None) -> DataFrame:
    """Minute rows of a sensor export with a naive time; of repeated times the first in file order."""
    _require(SENSOR_COLUMNS, raw.columns, "the sensor export")
    rows = raw.select((subject if subject is not None else F.lit("")).alias("subject_id"), F.try_to_timestamp(F.col("Timestamp")).cast("timestamp_ntz").alias("time"), F.monotonically_increasing_id().alias("_at"), *[c for c in raw.columns if c != "Timestamp"])
    return first_by_time(rows.where("time is not null"), ["subject_id", "time"], "_at")


def wearable_minutes(rows: DataFrame) -> DataFrame:
    """(subject_id, time, heart_rate, mets, activity_level, active_kcal) of minutes with any of them; absent columns are null."""
    col = lambda name: number(F.col(f"`{name}`")) if name in rows.columns else F.lit(None).cast("double")
    out = rows.select("subject_id", "time", F.rint(col("HR")).alias("heart_rate"), (col("METs") / 10).alias("mets"), col("Intensity").alias("activity_level"), F.round(col("Calories (Activity)"), 3).alias("active_kcal"))
    return out.where("coalesce(heart_rate, mets, activity_level, active_kcal) is not null")


def meals(rows: DataFrame) -> DataFrame:
    """(subject_id, time, meal_type, macros...) of the rows with a meal; the share consumed is clipped to 0-100."""
    col = lambda name: number(F.col(f"`{name}`")) if name in rows.columns else F.lit(None).cast("double")
    out = rows.where(F.trim("Meal Type") != "").select("subject_id", "time", meal_type(F.col("Meal Type")).alias("meal_type"), *[col(a).alias(b) for a, b in MACROS.items()])
    return out.withColumn("pct_consumed", F.when(F.col("pct_consumed").isNotNull(), F.least(F.greatest("pct_consumed", F.lit(0.0)), F.lit(100.0))))


def ignored_columns(raw: DataFrame) -> list[str]:
    known = {*SENSOR_COLUMNS, *MACROS, "METs", "Intensity", "Calories (Activity)"}
    return sorted(c for c in raw.columns if c not in known)


def native_samples(minutes: DataFrame, interval_min: int, tol: float = 1e-3) -> DataFrame:
    """(key, time, value) of the readings behind a series that was interpolated to minutes (key, minute, value).

    Readings are where the slope changes or a stretch of minutes starts or ends. Between two of them that lie a
    multiple of ``interval_min`` apart in one stretch, those in a straight run are put back. ``minute`` is a whole
    number; rows without a value are gaps.
    """
    w = Window.partitionBy("key").orderBy("minute")
    v = minutes.where("value is not null").select("key", "minute", "value")
    v = v.withColumn("before", F.when(F.lag("minute").over(w) == F.col("minute") - 1, F.lag("value").over(w)))
    v = v.withColumn("after", F.when(F.lead("minute").over(w) == F.col("minute") + 1, F.lead("value").over(w)))
    v = v.withColumn("stretch", F.sum(F.col("before").isNull().cast("int")).over(w))
    bend = F.abs((F.col("after") - F.col("value")) - (F.col("value") - F.col("before"))) > tol
    knots = v.where(F.col("before").isNull() | F.col("after").isNull() | bend)
    k = Window.partitionBy("key", "stretch").orderBy("minute")
    knots = knots.withColumn("next", F.lead("minute").over(k)).withColumn("to", F.lead("value").over(k))
    gap = F.col("next") - F.col("minute")
    steps = F.when((gap > interval_min) & (gap % interval_min == 0), F.sequence(F.lit(0), (gap / interval_min).cast("int") - 1)).otherwise(F.array(F.lit(0)))
    put = knots.withColumn("i", F.explode(steps)).withColumn("at", F.col("minute") + F.col("i") * interval_min)
    value = F.when(F.col("i") == 0, F.col("value")).otherwise(F.col("value") + (F.col("to") - F.col("value")) * (F.col("i") * interval_min) / gap)
    return put.select("key", F.col("at").alias("minute"), F.rint(value).cast("long").alias("value"))


def dexcom(raw: DataFrame, key: Sequence[str] = ()) -> DataFrame:
    """(key, time, mg_dl): rows of the type EGV; Low is 40 and High 400; of repeated times the first."""
    stamp, value = (next(c for c in raw.columns if c.startswith(p)) for p in ("Timestamp", "Glucose Value"))
    v = F.when(F.col(f"`{value}`") == "Low", F.lit(40.0)).when(F.col(f"`{value}`") == "High", F.lit(400.0)).otherwise(number(F.col(f"`{value}`")))
    rows = raw.where(F.col("`Event Type`") == "EGV").select(*key, F.try_to_timestamp(F.col(f"`{stamp}`")).cast("timestamp_ntz").alias("time"), v.alias("mg_dl"), F.monotonically_increasing_id().alias("_at"))
    return first_by_time(rows.where("time is not null and mg_dl is not null"), [*key, "time"], "_at")


def minute_mean(rows: DataFrame, key: Sequence[str], value: str) -> DataFrame:
    """(key, time, value): mean of each minute. Partial sums and counts come before the shuffle."""
    minute = F.window("time", "1 minute")["start"]
    return rows.where(F.col(value).isNotNull()).groupBy(*key, minute.alias("time")).agg(F.avg(value).alias(value))


def beat_intervals(rows: DataFrame, key: Sequence[str], low: float = 300, high: float = 2000) -> DataFrame:
    """(key, time, ibi_ms) from seconds: plausible ones, the first of each time, one decimal."""
    ms = rows.select(*key, "time", (F.col("ibi") * 1000).alias("ibi_ms"), F.monotonically_increasing_id().alias("_at")).where(F.col("ibi_ms").between(low, high))
    return first_by_time(ms, [*key, "time"], "_at").withColumn("ibi_ms", F.round("ibi_ms", 1))


def demographics(raw: DataFrame) -> DataFrame:
    return raw.select(F.lpad(F.col("ID").cast("int").cast("string"), 3, "0").alias("subject_id"), F.lower(F.trim("Gender")).alias("sex"), number(F.col("HbA1c")).alias("hba1c"))


def read_vocabulary(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A typed vocabulary; empty fields are null, anything that does not fit the type is an error."""
    return spark.read.csv(path, schema=schema, header=True, nullValue="", mode="FAILFAST")


# --- survey ---------------------------------------------------------------------------------------------------------


def sas_number(x: Column) -> Column:
    """Exports write an exact zero as about 5e-79."""
    return F.when(F.abs(x) < 1e-70, F.lit(0.0)).otherwise(x)


def exam_date(cycle: Column, month: Column) -> Column:
    """1 August of the cycle's second year for exams of May to October (code 2), else 1 February."""
    year = F.element_at(F.create_map(*[F.lit(x) for kv in CYCLE_YEARS.items() for x in kv]), cycle)
    return F.make_date(year, F.when(month == 2, 8).otherwise(2), F.lit(1))


def cohort(people: DataFrame) -> DataFrame:
    """Adults with diabetes and no probable type 1; a missing answer is no yes, and missing pills are no pills."""
    yes = lambda c, v: F.coalesce(F.col(c) == v, F.lit(False))
    over = lambda c, v: F.coalesce(F.col(c) >= v, F.lit(False))
    diabetes = yes("DIQ010", 1) | over("LBXGH", 6.5) | over("LBXGLU", 126) | yes("DIQ050", 1) | yes("DIQ070", 1)
    type1 = F.coalesce(F.col("DID040") < 30, F.lit(False)) & yes("DIQ050", 1) & ~yes("DIQ070", 1)
    return people.where(over("RIDAGEYR", 20) & diabetes & ~type1)


def joined_components(base: DataFrame, components: Sequence[DataFrame], key: Sequence[str] = ("SEQN", "cycle")) -> DataFrame:
    """Components left-joined to a base; a column that is there already is not taken again."""
    for c in components:
        base = base.join(c.select(*key, *[x for x in c.columns if x not in base.columns]), list(key), "left")
    return base


def survey_observations(rows: DataFrame, labs: dict[str, str], key: Sequence[str] = ("SEQN",)) -> DataFrame:
    """(key, code, value): one row a measured value; blood pressure is the mean of the readings there are, without diastolic zeros."""
    there = [c for c in labs if c in rows.columns]
    pairs = [F.struct(F.lit(labs[c]).alias("code"), F.col(c).cast("double").alias("value")) for c in there]
    for code, stem in (("8480-6", "BPXSY"), ("8462-4", "BPXDI")):
        all_ = F.array(*[F.col(f"{stem}{i}").cast("double") for i in range(1, 5) if f"{stem}{i}" in rows.columns])
        used = F.filter(all_, lambda x: x.isNotNull() & ((x > 0) | F.lit(stem == "BPXSY")))
        mean = F.aggregate(used, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(used), F.lit(0))
        pairs.append(F.struct(F.lit(code).alias("code"), F.round(mean, 1).alias("value")))
    return rows.select(*key, F.inline(F.array(*pairs))).where("value is not null")


def smoking_status(ever: Column, now: Column) -> Column:
    code = F.when(ever == 2, SMOKING["never"]).when((ever == 1) & (now == 1), SMOKING["daily"]).when((ever == 1) & (now == 2), SMOKING["occasional"])
    return code.when((ever == 1) & (now == 3), SMOKING["former"])


def survey_conditions(rows: DataFrame, questions: dict[str, str], type2: str = "44054006") -> DataFrame:
    """(SEQN, code, onset): type 2 diabetes from the age at diagnosis, if that is an age; others at the exam, where the answer is 1."""
    dx = F.when(F.col("DID040").between(1, F.col("RIDAGEYR")), F.col("DID040"))
    onset = F.date_sub("exam_date", F.coalesce(F.rint(365.25 * (F.col("RIDAGEYR") - dx)), F.lit(0)).cast("int"))
    first = F.struct(F.lit(type2).alias("code"), onset.alias("onset"))
    rest = [F.when(F.col(q) == 1, F.struct(F.lit(c).alias("code"), F.col("exam_date").alias("onset"))) for q, c in questions.items()]
    return rows.select("SEQN", F.inline(F.array_compact(F.array(first, *rest))))


def birth_date(exam: Column, age: Column) -> Column:
    """The middle of the possible birth dates of an age in whole years."""
    return F.date_sub(exam, F.rint(365.25 * (age + 0.5)).cast("int"))


def prescriptions(rx: DataFrame) -> DataFrame:
    """(SEQN, name, days): one row an ingredient; days of refusals and don't-knows are null."""
    each = rx.where("RXDDRUG is not null").withColumn("name", F.explode(F.split("RXDDRUG", ";"))).withColumn("name", F.trim("name"))
    days = sas_number(F.col("RXDDAYS"))
    return each.where(~F.col("name").isin("", "99999")).select("SEQN", "name", F.when((days >= 0) & (days < 77777), days).alias("days"))


def minute_steps(steps: DataFrame, wear: DataFrame, minutes: Sequence[str]) -> DataFrame:
    """(SEQN, PAXDAYM, minute, steps): worn minutes (codes 1 and 2) of the days that both tables have."""
    key = ["SEQN", "PAXDAYM"]
    long = lambda df, name: df.select(*key, F.array(*[F.col(m).cast("double") for m in minutes]).alias(name))
    both = long(steps, "s").join(long(wear, "w"), key)
    return both.select(*key, F.posexplode(F.arrays_zip("s", "w")).alias("minute", "x")).where("x.w in (1, 2)").select(*key, "minute", F.col("x.s").alias("steps"))


# --- record bundles -------------------------------------------------------------------------------------------------

_CODING = "array<struct<system:string,code:string,display:string>>"
_CONCEPT = f"struct<coding:{_CODING}>"
_QUANTITY = "struct<value:double,unit:string,code:string>"
BUNDLE = f"""entry array<struct<fullUrl:string,resource:struct<resourceType:string,id:string,status:string,birthDate:string,gender:string,deceasedDateTime:string,
name:array<struct<use:string,family:string,given:array<string>>>,identifier:array<struct<value:string,type:{_CONCEPT}>>,
code:{_CONCEPT},effectiveDateTime:string,onsetDateTime:string,recordedDate:string,abatementDateTime:string,authoredOn:string,
valueQuantity:{_QUANTITY},valueCodeableConcept:{_CONCEPT},component:array<struct<code:{_CONCEPT},valueQuantity:{_QUANTITY}>>,
medicationCodeableConcept:{_CONCEPT},medicationReference:struct<reference:string>,
dosageInstruction:array<struct<asNeededBoolean:boolean,timing:struct<repeat:struct<frequency:double,period:double,periodUnit:string>>,doseAndRate:array<struct<doseQuantity:{_QUANTITY}>>>>,
class:struct<code:string>,period:struct<start:string,end:string>,type:array<{_CONCEPT}>,reasonCode:array<{_CONCEPT}>>>>""".replace("\n", "")


def read_bundles(spark: SparkSession, path: str) -> DataFrame:
    """(bundle, url, r): one row a resource of every bundle file."""
    raw = spark.read.json(path, schema=BUNDLE, multiLine=True).withColumn("bundle", F.input_file_name())
    return resources(raw)


def resources(raw: DataFrame) -> DataFrame:
    return raw.select("bundle", F.explode("entry").alias("e")).select("bundle", F.col("e.fullUrl").alias("url"), F.col("e.resource").alias("r"))


def parse_bundles(text: DataFrame) -> DataFrame:
    """Resources of bundles given as text (bundle, json)."""
    return resources(text.select("bundle", F.from_json("json", BUNDLE).alias("b")).select("bundle", "b.entry"))


def _code(c: str) -> Column:
    return F.try_element_at(F.col(f"{c}.coding"), F.lit(1))


def bundle_numbers(res: DataFrame, codes: Sequence[str]) -> DataFrame:
    """(bundle, code, at, value, unit): quantities of observations and of their components, for codes of the list."""
    o = res.where("r.resourceType = 'Observation' and r.effectiveDateTime is not null")
    own = F.struct(_code("r.code")["code"].alias("code"), F.col("r.valueQuantity").alias("q"))
    parts = F.transform(F.coalesce(F.col("r.component"), F.array().cast(f"array<struct<code:{_CONCEPT},valueQuantity:{_QUANTITY}>>")), lambda c: F.struct(F.try_element_at(c["code"]["coding"], F.lit(1))["code"].alias("code"), c["valueQuantity"].alias("q")))
    each = o.select("bundle", F.to_timestamp("r.effectiveDateTime").alias("at"), F.inline(F.concat(F.array(own), parts)))
    return each.where(F.col("q.value").isNotNull() & F.col("code").isin(*codes)).select("bundle", "code", "at", F.col("q.value").alias("value"), F.coalesce("q.code", "q.unit").alias("unit"))


def bundle_codes(res: DataFrame, codes: Sequence[str]) -> DataFrame:
    o = res.where("r.resourceType = 'Observation' and r.valueQuantity is null and r.valueCodeableConcept is not null")
    c = o.select("bundle", _code("r.code")["code"].alias("code"), F.to_timestamp("r.effectiveDateTime").alias("at"), _code("r.valueCodeableConcept").alias("v"))
    return c.where(F.col("code").isin(*codes) & F.col("at").isNotNull()).select("bundle", "code", "at", F.col("v.code").alias("value_code"), F.coalesce("v.display", "v.code").alias("display"))


def bundle_conditions(res: DataFrame) -> DataFrame:
    c = res.where("r.resourceType = 'Condition'").select("bundle", _code("r.code").alias("c"), F.to_timestamp(F.coalesce("r.onsetDateTime", "r.recordedDate")).alias("onset"), F.to_timestamp("r.abatementDateTime").alias("abated"))
    return c.where("onset is not null").select("bundle", F.col("c.code").alias("code"), F.coalesce("c.display", "c.code").alias("display"), "onset", "abated")


def times_per_day(repeat: Column) -> Column:
    """Frequency by period as times a day; null for other units or zeros."""
    unit = F.element_at(F.create_map(*[F.lit(x) for kv in PERIODS.items() for x in kv]), repeat["periodUnit"])
    known = repeat["periodUnit"].isin(*PERIODS)
    return F.when(known & (repeat["frequency"] != 0) & (repeat["period"] != 0), repeat["frequency"] / repeat["period"] * unit)


def bundle_orders(res: DataFrame) -> DataFrame:
    """(bundle, id, rxcui, display, authored_at, status, dose, times_per_day, as_needed): the drug inline or by reference."""
    rx = lambda concept: F.try_element_at(F.filter(concept["coding"], lambda c: c["system"] == RXNORM), F.lit(1))
    named = res.where("r.resourceType = 'Medication'").select("bundle", F.col("url").alias("ref"), rx(F.col("r.code")).alias("there"))
    first = F.try_element_at(F.col("r.dosageInstruction"), F.lit(1))
    doses = F.filter(F.transform(first["doseAndRate"], lambda d: d["doseQuantity"]["value"]), lambda v: v.isNotNull())
    m = res.where("r.resourceType = 'MedicationRequest'").select(
        "bundle", F.col("r.id").alias("id"), rx(F.col("r.medicationCodeableConcept")).alias("here"), F.col("r.medicationReference.reference").alias("ref"), F.to_timestamp("r.authoredOn").alias("authored_at"),
        F.coalesce("r.status", F.lit("")).alias("status"), F.try_element_at(doses, F.lit(-1)).alias("dose"), times_per_day(first["timing"]["repeat"]).alias("times_per_day"), F.coalesce(first["asNeededBoolean"], F.lit(False)).alias("as_needed"),
    )
    j = m.join(named, ["bundle", "ref"], "left").withColumn("drug", F.coalesce("here", "there"))
    return j.where("drug is not null and authored_at is not null").select("bundle", "id", F.col("drug.code").alias("rxcui"), F.col("drug.display").alias("display"), "authored_at", "status", "dose", "times_per_day", "as_needed")


def bundle_encounters(res: DataFrame) -> DataFrame:
    kind = F.element_at(F.create_map(*[F.lit(x) for kv in ENCOUNTER_CLASSES.items() for x in kv]), F.col("r.class.code"))
    e = res.where(F.col("r.resourceType").eqNullSafe("Encounter") & F.col("r.class.code").isin(*ENCOUNTER_CLASSES))
    return e.select("bundle", F.col("r.id").alias("id"), kind.alias("class"), F.to_timestamp("r.period.start").alias("started_at"), F.to_timestamp("r.period.end").alias("ended_at")).where("started_at is not null")


def bundle_index(res: DataFrame) -> DataFrame:
    """One row a bundle: id, official name, record number, last encounter end, latest BMI by the text of its time, deceased."""
    is_ = lambda kind: F.col("r.resourceType") == kind
    official = F.try_element_at(F.filter("r.name", lambda n: n["use"] == "official"), F.lit(1))
    mrn = F.try_element_at(F.filter("r.identifier", lambda i: F.exists(i["type"]["coding"], lambda c: c["code"] == "MR")), F.lit(1))["value"]
    bmi = is_("Observation") & (_code("r.code")["code"] == "39156-5") & F.col("r.effectiveDateTime").isNotNull()
    return res.groupBy("bundle").agg(
        F.max(F.when(is_("Patient"), F.col("r.id"))).alias("patient_id"),
        F.max(F.when(is_("Patient"), F.concat_ws(" ", F.array_join(official["given"], " "), official["family"]))).alias("name"),
        F.max(F.when(is_("Patient"), mrn)).alias("mrn"),
        F.max(F.when(is_("Encounter"), F.to_timestamp("r.period.end"))).alias("last_encounter_end"),
        F.max_by(F.when(bmi, F.col("r.valueQuantity.value")), F.when(bmi, F.col("r.effectiveDateTime"))).alias("bmi"),
        F.bool_or(is_("Patient") & F.col("r.deceasedDateTime").isNotNull()).alias("deceased"),
    )
