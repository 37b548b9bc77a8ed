"""Smaller relational building blocks: membership, sub-query joins, facets, fills, pairwise comparison, tails."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortspark.functions import clinical as C
from cohortspark.functions import measures as M

Tables = Mapping[str, DataFrame]


def tags(t: Tables) -> DataFrame:
    """(patient_id, tags): sorted distinct tags, empty for patients without any."""
    per = t["patient_tag"].groupBy("patient_id").agg(F.sort_array(F.collect_set("tag")).alias("tags"))
    return t["patient"].select("patient_id").join(per, "patient_id", "left").withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))


def has_tag(t: Tables, tag: str) -> DataFrame:
    """Patients with a tag."""
    return tags(t).where(F.array_contains("tags", tag)).select("patient_id")


def not_any(t: Tables, tag: str) -> DataFrame:
    return tags(t).select("patient_id", (~F.array_contains("tags", tag)).alias("without"), F.array_contains("tags", tag).alias("has"))


def appended(t: Tables, condition: Column, name: str) -> DataFrame:
    """Tags with one more where a condition holds."""
    more = F.when(condition, F.array(F.lit(name))).otherwise(F.array().cast("array<string>"))
    return tags(t).select("patient_id", F.array_join(F.concat("tags", more), ",").alias("tags"))


def cardinality(t: Tables) -> DataFrame:
    return tags(t).select("patient_id", F.size("tags").alias("n_tags"))


def payload(rows: DataFrame, key: str, fields: Sequence[str], strip_nulls: bool) -> DataFrame:
    """JSON of some columns, with or without those that are null."""
    return rows.select(key, F.to_json(F.struct(*fields), {"ignoreNullFields": str(strip_nulls).lower()}).alias("payload"))


def flags(t: Tables) -> DataFrame:
    """Latest observations against the range of the patient's sex; (patient_id, analyte, value, flag)."""
    spark = t["observation"].sparkSession
    ranges = spark.createDataFrame(M.RANGES, "analyte string, range_sex string, low double, high double")
    w = Window.partitionBy("patient_id", "analyte").orderBy("is_synthetic", F.desc("effective_at"), "l_orderkey", "l_linenumber", "value")
    latest = t["observation"].withColumn("rn", F.row_number().over(w)).where("rn = 1").join(t["patient"].select("patient_id", "sex"), "patient_id")
    j = latest.alias("o").join(F.broadcast(ranges).alias("r"), F.expr("o.analyte = r.analyte and (r.range_sex is null or r.range_sex = o.sex)"), "left")
    return j.select("patient_id", F.col("o.analyte").alias("analyte"), "value", M.flag(F.col("value"), F.col("low"), F.col("high")).alias("flag"))


def patient_flag(t: Tables) -> DataFrame:
    return flags(t).groupBy("patient_id").agg(M.worst(F.collect_set("flag")).alias("flag"))


def checked_units(rows: DataFrame, expected: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, counts): rows whose unit, aliases resolved, is the expected one of their analyte; and how many are not."""
    j = rows.join(expected, "analyte", "left").withColumn("fits", F.coalesce(M.canonical_unit(F.col("unit")) == F.col("expected_unit"), F.lit(False)))
    return j.where("fits").drop("fits", "expected_unit"), j.groupBy("analyte").agg(F.count(F.when(~F.col("fits"), 1)).alias("mismatches"))


def with_product(t: Tables) -> DataFrame:
    """Regimens with their product by a key of two columns; products of another medication never fit."""
    return t["supplied"].join(t["product"], ["medication_id", "supplier_id"], "left").select("patient_id", "l_orderkey", "l_linenumber", "medication_id", "supplier_id", "product")


def device_metrics(t: Tables, excluded: Sequence[str]) -> DataFrame:
    """Every device with every metric of the vocabulary but some, and the last reading if there is one.

    The vocabulary is small: one row a metric.
    """
    names = t["wearable"].select("metric").distinct().where(~F.col("metric").isin(*excluded))
    last = t["wearable"].groupBy("device_id", "metric").agg(F.max("time").alias("last_at"))
    return t["device"].select("device_id").crossJoin(F.broadcast(names)).join(last, ["device_id", "metric"], "left")


def on_drug(t: Tables, days: DataFrame) -> DataFrame:
    """Days of ``days`` (patient_id, day) on which some regimen of the patient runs."""
    r = t["regimen"].select("patient_id", F.to_date("started_at").alias("a"), F.to_date("ended_at").alias("b"))
    return days.join(r, (days["patient_id"] == r["patient_id"]) & (r["a"] <= days["day"]) & (r["b"].isNull() | (r["b"] >= days["day"])), "left_semi")


def readings_of(t: Tables, devices: DataFrame) -> DataFrame:
    return t["wearable"].join(devices, "device_id", "left_semi").groupBy("device_id").agg(F.count("*").alias("n"))


def on_common_grid(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Union of two indexes (key, at) with the values ``x`` of one and ``y`` of the other."""
    return a.join(b, [key, "at"], "full")


def values_by_code(t: Tables) -> DataFrame:
    """One JSON object a device and time of all metrics then; of several values the last by ordinal counts."""
    w = Window.partitionBy("device_id", "hour", "metric").orderBy(F.desc("ordinal"))
    last = t["hourly"].withColumn("rn", F.row_number().over(w)).where("rn = 1")
    pairs = F.array_sort(F.collect_list(F.struct("metric", F.col("value").cast("long").alias("value"))))
    text = F.transform(pairs, lambda p: F.concat(F.lit('"'), p["metric"], F.lit('":'), p["value"].cast("string")))
    return last.groupBy("device_id", "hour").agg(F.concat(F.lit("{"), F.array_join(text, ","), F.lit("}")).alias("payload"))


def robust_spread(rows: DataFrame, by: str, value: str) -> DataFrame:
    """Median and 1.4826 times the median absolute deviation: the second needs the first, so two aggregations."""
    mid = rows.groupBy(by).agg(F.median(value).alias("median"))
    off = rows.join(mid, by).groupBy(by).agg(F.first("median").alias("median"), F.median(F.abs(F.col(value) - F.col("median"))).alias("mad"))
    return off.select(by, "median", C.rounded(F.col("mad") * 1.4826, 4).alias("robust_sd"))


def phase(t: Tables) -> DataFrame:
    """The commonest minute of five at which a device reads; of equally common ones the smallest."""
    g = t["native"].groupBy("device_id", (F.minute("time") % 5).alias("phase")).count()
    return g.groupBy("device_id").agg(F.min_by("phase", F.struct((-F.col("count")).alias("c"), "phase")).alias("phase"))


def facets(rows: DataFrame, chosen: Mapping[str, object]) -> DataFrame:
    """(facet, value, n): counts by each facet of the rows that all other facets' choices leave."""
    out = None
    for name in chosen:
        left = rows
        for other, value in chosen.items():
            if other != name and value is not None:
                left = left.where(F.col(other) == F.lit(value))
        one = left.groupBy(F.col(name).cast("string").alias("value")).count().select(F.lit(name).alias("facet"), "value", F.col("count").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


def filled(t: Tables, limit_min: int) -> DataFrame:
    """For each heart rate the last glucose before or at it and the next after, if known within a limit."""
    sec = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    g = t["native"].select("device_id", "time", F.col("mg_dl").alias("known"), F.lit(0).alias("kind"))
    h = t["wearable"].where("metric = 'heart_rate'").select("device_id", "time", F.lit(None).cast("int").alias("known"), F.lit(1).alias("kind"))
    w = Window.partitionBy("device_id").orderBy("time", "kind")
    both = g.unionByName(h)
    at = F.when(F.col("known").isNotNull(), F.col("time"))
    both = both.select("*", F.last("known", True).over(w).alias("before"), F.last(at, True).over(w).alias("before_at"))
    ahead = w.rowsBetween(1, Window.unboundedFollowing)
    both = both.select("*", F.first("known", True).over(ahead).alias("after"), F.first(at, True).over(ahead).alias("after_at"))
    near = lambda a, b, v: F.when(sec(b) - sec(a) <= limit_min * 60000000, F.col(v))
    return both.where("kind = 1").select("device_id", "time", near("before_at", "time", "before").alias("before"), near("time", "after_at", "after").alias("after"))


def changes(t: Tables) -> DataFrame:
    """Consecutive regimens of a medication: the days between them and whether they overlap."""
    w = Window.partitionBy("patient_id", "medication_id").orderBy("started_at", "l_orderkey", "l_linenumber")
    before = F.lag(F.struct("started_at", "ended_at")).over(w)
    r = t["regimen"].withColumn("before", before).where("before is not null")
    return r.select(
        "patient_id", "medication_id", "l_orderkey", "l_linenumber",
        F.datediff("started_at", "before.started_at").alias("days"), F.coalesce(F.col("before.ended_at") >= F.col("started_at"), F.lit(True)).alias("overlaps"),
    )


def complete(t: Tables, rows: int) -> DataFrame:
    """Readings with ``rows`` readings of the last ``rows`` steps of five minutes: complete lookbacks."""
    s = F.unix_micros(F.col("time").cast("timestamp")) / 1000000
    w = Window.partitionBy("device_id").orderBy("s").rangeBetween(-300 * (rows - 1), 0)
    return t["glucose"].withColumn("s", s.cast("long")).withColumn("n", F.count("mg_dl").over(w)).where(F.col("n") == rows).select("device_id", "time")


def slope(t: Tables) -> DataFrame:
    """Least-squares slope (mg/dL a minute) over the trailing 15 minutes and its level; from three readings and ten minutes on.

    A fraction of sums of whole numbers, as in the live state: levels do not hang on the order of additions.
    """
    sec = F.unix_seconds(F.col("time").cast("timestamp"))
    w = Window.partitionBy("device_id").orderBy("s").rangeBetween(-900, 0)
    g = t["glucose"].withColumn("s", sec).withColumn("x", F.col("s") - 1_710_000_000).withColumn("y", F.round(F.col("mg_dl") * 1000).cast("long"))
    total = lambda c: F.sum(F.expr(f"cast({c} as decimal(19, 0))")).over(w)
    g = g.select("device_id", "time", "x", F.count("*").over(w).alias("n"), F.min("x").over(w).alias("first"), *[total(c).cast("decimal(19, 0)").alias(a) for c, a in (("x", "sx"), ("y", "sy"), ("x * y", "sxy"), ("x * x", "sxx"))])
    g = g.withColumn("rise", F.when((F.col("n") >= 3) & (F.col("x") - F.col("first") >= 600), F.expr("n * sxy - sx * sy"))).withColumn("run", F.expr("n * sxx - sx * sx"))
    return g.select("device_id", "time", C.slope_of("rise", "run").alias("slope"), C.trend_of("rise", "run").alias("trend"))


def recent(t: Tables, n: int) -> DataFrame:
    """All running regimens of a patient and the ``n`` latest of the others."""
    r = t["regimen"].withColumn("active", F.col("ended_at").isNull())
    w = Window.partitionBy("patient_id", "active").orderBy(F.desc("started_at"), "l_orderkey", "l_linenumber")
    return r.withColumn("rn", F.row_number().over(w)).where(F.col("active") | (F.col("rn") <= n)).select("patient_id", "l_orderkey", "l_linenumber", "active")


def tail(t: Tables, n: int = 12, at: str | None = None) -> DataFrame:
    """The last ``n`` values of each patient and analyte in time order, as text; each is taken before they are collected.

    Rows of one time, order and line come in order of the column ``at``, without one in order of value.
    """
    keys = ["effective_at", "l_orderkey", "l_linenumber", *([at] if at else [])]
    w = Window.partitionBy("patient_id", "analyte").orderBy(*[F.desc(k) for k in keys])
    last = t["observation"].withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n)
    points = F.array_sort(F.collect_list(F.struct(*keys, "value")))
    return last.groupBy("patient_id", "analyte").agg(F.array_join(F.transform(points, lambda p: p["value"].cast("decimal(18,2)").cast("string")), ",").alias("spark"))


def page_with_cursor(t: Tables, size: int, number: int) -> DataFrame:
    """One page of the visits, newest first, with the total and the next page's offset (null on the last)."""
    total = t["encounter"].agg(F.count("*").alias("total"))
    rows = t["encounter"].select("encounter_id", "started_at").orderBy(F.desc("started_at"), "encounter_id").offset(size * number).limit(size)
    after = F.when(F.col("total") > size * (number + 1), F.lit(size * (number + 1)))
    return rows.crossJoin(F.broadcast(total)).withColumn("next_cursor", after)  # the total is one row
