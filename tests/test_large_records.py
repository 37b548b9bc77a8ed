"""What makes the record's queries heavy on large tables: rows in one task, passes over the tables."""

import re

from oracle import same
from pyspark.sql import functions as F

from cohortspark.operators import record
from cohortspark.plans import registry
from cohortspark.sources import proxy


def test_episodes_without_a_visit_are_dealt_out(spark):
    """They are many, and no key of theirs may gather them in one task."""
    d = spark.range(4000).select((F.col("id") % 50).alias("patient_id"), F.when(F.col("id") < 20, F.col("id")).alias("encounter_id"), F.col("id").alias("episode_id"), F.lit(1).alias("concept_id"), F.lit("2024-01-01").cast("timestamp_ntz").alias("onset_at"), F.lit(None).cast("timestamp_ntz").alias("abated_at"))
    m = spark.range(200).select((F.col("id") % 100).alias("encounter_id"), (F.col("id") % 3).alias("ingredient_id"))
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    for k, v in zip(before, ("false", "-1")):
        spark.conf.set(k, v)
    try:
        got = record.condition_detail({"diagnosis": d, "medicine": m}).withColumn("part", F.spark_partition_id()).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    # episodes 20 to 99 have no visit, though visits with their numbers have medications
    assert {r.episode_id: r.related_medications for r in got} == {i: 2 if i < 20 else 0 for i in range(4000)}
    parts = [r.part for r in got]
    assert max(parts.count(p) for p in set(parts)) < 2000


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_the_overview_joins_lines_and_orders_once(spark):
    """Its tables are all of that join; the result reads it as stored, and results are dealt to patients only."""
    t = proxy.views(spark, "/root/testdata/sf0.001")
    plan = _plan(registry.queries()["r_overview"](spark, "/root/testdata/sf0.001"))
    assert "l_returnflag" in plan and "lineitem.parquet" not in plan
    dealt = re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", _plan(record.measure_summary(t)))
    assert not [d for d in dealt if "analyte" in d or "measure" in d]


def test_patient_features_join_lines_and_orders_once(spark):
    assert "lineitem.parquet" not in _plan(registry.queries()["v_patient_static"](spark, "/root/testdata/sf0.001"))


def _dense(spark, folder, keys=400):
    """Tables in which many records end within visits, at their very bounds too, and values are missing."""
    for t in ("region", "nation", "customer", "supplier", "part", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        (folder / f"{t}.parquet").symlink_to(f"/root/testdata/sf0.001/{t}.parquet")
    o = spark.range(keys).selectExpr(
        "id as o_orderkey", "nullif(id * 7 % 9, 8) as o_custkey", "substr('FOP', cast(id % 3 as int) + 1, 1) as o_orderstatus", "1.0d as o_totalprice",
        "case when id % 61 > 0 then timestampadd(hour, cast(id * 37 % 45 * 6 as int), timestamp_ntz '2024-01-01') end as o_orderdate", "concat(id % 5 + 1, '-X') as o_orderpriority",
    )
    n = spark.range(5 * keys).selectExpr(
        f"id * 31 % {keys + 20} as l_orderkey", "id * 13 % 97 as l_partkey", "id % 7 as l_suppkey", "cast(id % 7 + 1 as int) as l_linenumber", "nullif(cast(id % 8 as double), 7d) as l_quantity", "1d as l_extendedprice", "0d as l_discount", "0d as l_tax",
        "substr('NRA', cast(id % 11 % 3 as int) + 1, 1) as l_returnflag", "'O' as l_linestatus", "case when id % 17 > 0 then timestampadd(hour, cast(id * 29 % 50 * 6 as int), timestamp_ntz '2024-01-01') end as l_shipdate",
    ).where("l_orderkey % 10 <> 3")
    o.write.parquet(f"{folder}/orders.parquet")
    n.write.parquet(f"{folder}/lineitem.parquet")
    return str(folder)


def test_ends_within_visits_are_counted_as_in_the_sql(spark, tmp_path):
    """Visits of one moment, without lines, a date or a patient; ends at a visit's bounds and of its own records."""
    made = _dense(spark, tmp_path)
    for name in ("r_visit_detail", "r_visits", "r_overview"):
        same(registry.queries()[name](spark, made), registry.oracle_sql()[name], made)
    got = registry.queries()["r_visit_detail"](spark, made)
    assert got.where("resolved > 3 and stopped > 3").count() > 50 and got.where("tests + diagnoses + medications = 0").count() >= 40


def test_visits_that_repeat_an_id_stay(spark, tmp_path):
    """Two equal visits, and one id at two patients: all are rows, with every record of the id."""
    made = _dense(spark, tmp_path)
    o = spark.read.parquet(f"{made}/orders.parquet")
    o.where("o_orderkey between 100 and 110").union(o.where("o_orderkey between 200 and 210").withColumn("o_custkey", F.lit(7).cast("long"))).write.mode("append").parquet(f"{made}/orders.parquet")
    same(registry.queries()["r_visits"](spark, made), registry.oracle_sql()["r_visits"], made)
    cut = "SELECT patient_id, encounter_id, tests, diagnoses, medications FROM"
    same(registry.queries()["r_visit_detail"](spark, made).select("patient_id", "encounter_id", "tests", "diagnoses", "medications"), f"{cut} ({registry.oracle_sql()['r_visit_detail']})", made)


def test_visits_and_their_records_are_one_join_dealt_once_to_patients(spark):
    """Neither of the raw tables is read or dealt again for the next kind of record."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plans = {name: _plan(registry.queries()[name](spark, "/root/testdata/sf0.001")) for name in ("r_visits", "r_visit_detail")}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    dealt = {name: [re.sub(r"#\d+L?", "", d) for d in re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", plan)] for name, plan in plans.items()}
    assert dealt == {"r_visits": ["o_orderkey", "l_orderkey"], "r_visit_detail": ["patient_id", "o_orderkey", "l_orderkey"]}
