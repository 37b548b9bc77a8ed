"""Health tables as deterministic projections of a star schema and an event stream.

Every table keeps all rows that it is made of; readings pause for five minutes after every sixteenth, so series have gaps.
Each table is SQL that Spark and the oracle both run; ``{...}`` marks the few spellings that differ.
"""

from __future__ import annotations

import re
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspark.operators.rounds import dealt, folder

SPARK = {"ts": "TIMESTAMP_NTZ", "later": "timestampadd({unit}, cast({n} as int), {t})", "int": "INT", "mins": "timestampdiff(MINUTE, {a}, {b})"}
DUCK = {"ts": "TIMESTAMP", "later": "({t} + to_{unit}s(CAST({n} AS INT)))", "int": "INTEGER", "mins": "date_diff('minute', {a}, {b})"}


def _later(d: dict, t: str, n: str, unit: str) -> str:
    return d["later"].format(t=t, n=n, unit=unit.upper() if d is SPARK else unit)


def tables(d: dict) -> dict[str, str]:
    """SQL of each table by name, in the order of their needs."""
    base, zero = f"{d['ts']} '2024-03-09 00:00:00'", f"{d['ts']} '2024-01-01 00:00:00'"
    return {
        "ev": "SELECT event_id, ts, user_id, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events",
        "patient": "SELECT c_custkey AS patient_id, c_name AS name, CASE WHEN c_custkey % 2 = 0 THEN 'female' ELSE 'male' END AS sex, DATE '1950-01-01' + CAST(c_custkey % 15000 AS " + d["int"] + ") AS birth_date, c_nationkey % 3 AS source_id FROM customer",
        "device": "SELECT DISTINCT user_id AS device_id, user_id AS patient_id, user_id % 5 = 0 AS is_synthetic, user_id % 7 = 0 AS is_live FROM events",
        "glucose": f"SELECT user_id AS device_id, {_later(d, base, '5 * (rn + floor(rn / 17))', 'minute')} AS time, CAST(40 + floor(value) AS {d['int']}) AS mg_dl FROM ev",
        "fused": f"SELECT user_id AS patient_id, {_later(d, base, '5 * (rn + floor(rn / 17))', 'minute')} AS time, CAST(40 + floor(value) + (user_id % 10) / 10.0 AS DOUBLE) AS mg_dl, value >= 360 AS censored FROM ev",
        "native": f"SELECT user_id AS device_id, ts AS time, CAST(40 + floor(value) AS {d['int']}) AS mg_dl FROM ev WHERE event_type <> 'view'",
        "grid": f"SELECT user_id AS patient_id, {_later(d, zero, 'floor(' + d['mins'].format(a=zero, b='ts') + ' / 5.0) * 5', 'minute')} AS time, CAST(max(40 + floor(value)) AS DOUBLE) AS mg_dl, max(value) >= 360 AS censored FROM ev GROUP BY 1, 2",
        "wearable": "SELECT user_id AS device_id, ts AS time, CASE event_type WHEN 'view' THEN 'heart_rate' WHEN 'click' THEN 'steps' WHEN 'error' THEN 'spo2' WHEN 'purchase' THEN 'ibi_ms' ELSE CASE event_id % 12 WHEN 0 THEN 'wear_minutes' WHEN 1 THEN 'activity_level' WHEN 2 THEN 'active_kcal' WHEN 3 THEN 'respiration_rate' WHEN 4 THEN 'stress' WHEN 5 THEN 'skin_temp' WHEN 6 THEN 'eda' WHEN 7 THEN 'hrv_rmssd' ELSE 'mets' END END AS metric, "
        "CASE event_type WHEN 'view' THEN 50 + floor(value / 5) WHEN 'click' THEN floor(value) WHEN 'error' THEN 100 - floor(value / 20) WHEN 'purchase' THEN 600 + floor(value) ELSE 1 + floor(value / 100) END AS value FROM ev",
        "reading": f"SELECT user_id AS patient_id, {_later(d, base, '5 * (rn + floor(rn / 17))', 'minute')} AS time, 'glucose' AS metric, CAST(40 + floor(value) AS DOUBLE) AS value, CAST(NULL AS VARCHAR(9)) AS stage, CAST(NULL AS {d['ts']}) AS until, event_id AS ordinal FROM ev "
        f"UNION ALL SELECT user_id, {_later(d, base, '5 * (rn + floor(rn / 17))', 'minute')}, CASE event_type WHEN 'view' THEN 'heart_rate' WHEN 'click' THEN 'steps' WHEN 'error' THEN 'spo2' WHEN 'purchase' THEN 'sleep' ELSE 'mets' END, "
        f"CASE event_type WHEN 'view' THEN 40 + floor(value / 5) WHEN 'click' THEN floor(value) WHEN 'error' THEN 100 - floor(value / 25) WHEN 'purchase' THEN NULL ELSE floor(value / 60) END, CASE WHEN event_type = 'purchase' THEN CASE event_id % 3 WHEN 0 THEN 'deep' WHEN 1 THEN 'rem' ELSE 'light' END END, "
        f"CASE WHEN event_type = 'purchase' THEN {_later(d, base, '5 * (rn + floor(rn / 17)) + 10', 'minute')} END, event_id FROM ev",
        "sleep": f"SELECT user_id AS device_id, ts AS start_time, least(nxt, {_later(d, 'ts', '8', 'hour')}) AS end_time, CASE event_type WHEN 'view' THEN 'deep' WHEN 'click' THEN 'light' WHEN 'error' THEN 'rem' WHEN 'purchase' THEN 'awake' ELSE 'light' END AS stage FROM ev WHERE nxt IS NOT NULL AND nxt > ts",
        "observation": """SELECT o_custkey AS patient_id, l_orderkey, l_linenumber, l_shipdate AS effective_at, l_returnflag = 'N' AS is_synthetic,
  CASE (l_linenumber * 7 + l_partkey) % 10 WHEN 0 THEN 'hba1c' WHEN 1 THEN 'cholesterol_total' WHEN 2 THEN 'hdl' WHEN 3 THEN 'triglycerides' WHEN 4 THEN 'glucose_fasting' WHEN 5 THEN 'insulin' WHEN 6 THEN 'creatinine' WHEN 7 THEN 'weight' WHEN 8 THEN 'height' ELSE 'ldl' END AS analyte,
  CAST(CASE (l_linenumber * 7 + l_partkey) % 10 WHEN 0 THEN 4 + l_quantity / 10 WHEN 1 THEN 150 + l_quantity WHEN 2 THEN 30 + l_quantity WHEN 3 THEN 80 + 8 * l_quantity WHEN 4 THEN 70 + l_quantity WHEN 5 THEN 2 + l_quantity WHEN 6 THEN 0.5 + l_quantity / 25 WHEN 7 THEN 50 + l_quantity WHEN 8 THEN 150 + l_quantity ELSE 60 + 2 * l_quantity END AS DOUBLE) AS value
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
        "encounter": f"SELECT o_orderkey AS encounter_id, o_custkey AS patient_id, o_orderdate AS started_at, {_later(d, 'o_orderdate', 'o_orderkey % 48 + 1', 'hour')} AS ended_at, CASE WHEN o_orderpriority LIKE '1%' THEN 'emergency' WHEN o_orderpriority LIKE '2%' THEN 'inpatient' ELSE 'ambulatory' END AS class FROM orders",
        "regimen": f"SELECT o_custkey AS patient_id, l_orderkey, l_linenumber, l_partkey AS medication_id, o_orderdate AS started_at, CASE WHEN o_orderstatus = 'F' THEN {_later(d, 'o_orderdate', 'l_quantity', 'day')} END AS ended_at, l_returnflag = 'N' AS is_synthetic FROM orders JOIN lineitem ON l_orderkey = o_orderkey",
        "concept": "SELECT p_partkey AS concept_id, p_name || ' (' || p_type || ')' AS display, p_type AS grp, p_brand AS brand FROM part",
        "drug_class": "SELECT DISTINCT substr(p_brand, 1, length(p_brand) - CAST(p_partkey % 2 AS " + d["int"] + ")) AS prefix FROM part",
        "result": "SELECT patient_id, CASE WHEN l_linenumber <> 5 THEN l_orderkey END AS encounter_id, analyte, CASE WHEN l_linenumber <> 6 THEN value END AS value, CASE WHEN l_linenumber = 6 THEN 'text ' || analyte END AS value_text, effective_at, is_synthetic, l_orderkey * 10 + l_linenumber AS ordinal FROM observation",
        "diagnosis": "SELECT o_custkey AS patient_id, CASE WHEN l_linenumber < 6 THEN l_orderkey END AS encounter_id, l_orderkey * 10 + l_linenumber AS episode_id, l_partkey % 40 AS concept_id, CASE WHEN l_partkey % 4 = 0 THEN 'finding' ELSE 'diagnosis' END AS kind, o_orderdate AS onset_at, CASE WHEN l_returnflag <> 'R' THEN l_shipdate END AS abated_at, l_returnflag = 'N' AS is_synthetic FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
        "medicine": f"SELECT o_custkey AS patient_id, l_orderkey AS encounter_id, l_orderkey * 10 + l_linenumber AS regimen_id, l_partkey % 50 AS ingredient_id, l_partkey AS product_id, l_partkey % 50 % 4 = 0 AS lowering, l_quantity AS dose, l_suppkey % 3 AS per_day, o_orderdate AS started_at, CASE WHEN o_orderstatus <> 'O' THEN {_later(d, 'o_orderdate', 'CASE WHEN l_linenumber % 2 = 0 THEN 6 ELSE 24 * l_quantity END', 'hour')} END AS ended_at, l_returnflag = 'N' AS is_synthetic FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
        "source": "SELECT DISTINCT c_nationkey % 3 AS source_id, CASE c_nationkey % 3 WHEN 0 THEN 'cgm' WHEN 1 THEN 'survey' ELSE 'made' END AS code FROM customer",
        "person": "SELECT c_custkey AS patient_id, CASE WHEN c_custkey % 4 > 0 THEN 'Given' || CAST(c_custkey % 10 AS VARCHAR(9)) END AS given_name, CASE WHEN c_custkey % 6 > 2 THEN 'Family' || CAST(c_custkey % 7 AS VARCHAR(9)) END AS family_name, c_nationkey % 3 AS source_id, 'S' || CAST(c_custkey AS VARCHAR(20)) AS source_subject_id, CASE WHEN c_custkey % 5 > 0 THEN c_mktsegment END AS race FROM customer",
        "condition_group": "SELECT p_partkey % 40 AS concept_id, min(CASE p_partkey % 10 WHEN 0 THEN 'hypertension' WHEN 1 THEN 'dyslipidemia' WHEN 2 THEN 'ckd' WHEN 3 THEN 'retinopathy' WHEN 4 THEN 'neuropathy' WHEN 5 THEN 'cardiovascular' WHEN 6 THEN 'sleep_apnea' WHEN 7 THEN 'copd' ELSE 't2d' END) AS grp, min('Concept ' || CAST(p_partkey % 40 AS VARCHAR(9)) || CASE WHEN p_partkey % 3 = 0 THEN ' (disorder)' WHEN p_partkey % 3 = 1 THEN ' (finding)' ELSE '' END) AS display FROM part GROUP BY 1",
        "drug": "SELECT DISTINCT p_partkey % 50 AS ingredient_id, 'drug ' || CAST(p_partkey % 50 AS VARCHAR(9)) AS drug_name, CASE p_partkey % 50 % 12 WHEN 0 THEN 'biguanide' WHEN 1 THEN 'sulfonylurea' WHEN 2 THEN 'dpp4_inhibitor' WHEN 3 THEN 'sglt2_inhibitor' WHEN 4 THEN 'glp1_ra' WHEN 5 THEN 'thiazolidinedione' WHEN 6 THEN 'insulin_rapid' WHEN 7 THEN 'insulin_long' WHEN 8 THEN 'statin' WHEN 9 THEN 'ace_inhibitor' WHEN 10 THEN 'arb' END AS class_code, p_partkey % 50 % 12 < 8 AS class_lowers FROM part",
        "dose": f"SELECT user_id AS patient_id, {_later(d, base, '5 * (rn + floor(rn / 17))', 'minute')} AS time, CASE event_id % 7 WHEN 0 THEN 'insulin_rapid' WHEN 1 THEN 'insulin_premixed' WHEN 2 THEN 'insulin_long' WHEN 3 THEN 'insulin_intermediate' WHEN 4 THEN 'biguanide' WHEN 5 THEN 'statin' END AS class_code, event_id % 7 < 5 AS class_lowers, floor(value / 50) AS dose_value, 'U' AS dose_unit FROM ev",
        "patient_tag": "SELECT c_custkey AS patient_id, c_mktsegment AS tag FROM customer UNION ALL SELECT c_custkey, 'real' FROM customer WHERE c_nationkey % 3 = 0 UNION ALL SELECT c_custkey, 'gmi-warn' FROM customer WHERE c_custkey % 7 = 0 UNION ALL SELECT c_custkey, 'rich' FROM customer WHERE c_acctbal > 5000",
        "product": "SELECT DISTINCT l_partkey AS medication_id, l_suppkey AS supplier_id, 'product ' || CAST(l_partkey AS VARCHAR(20)) || '/' || CAST(l_suppkey AS VARCHAR(20)) AS product FROM lineitem",
        "supplied": "SELECT o_custkey AS patient_id, l_orderkey, l_linenumber, l_partkey AS medication_id, l_suppkey AS supplier_id FROM orders JOIN lineitem ON l_orderkey = o_orderkey",
        "hourly": f"SELECT user_id AS device_id, {_later(d, zero, 'floor(' + d['mins'].format(a=zero, b='ts') + ' / 60.0)', 'hour')} AS hour, event_type AS metric, value, event_id AS ordinal FROM events",
    }


def views(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The tables over ``sf_dir``; nothing is read before a table is used."""
    raw = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("events", "customer", "orders", "lineitem", "part", "supplier")}
    out: dict[str, DataFrame] = dict(raw)
    for name, sql in tables(SPARK).items():
        needs = {t: df for t, df in out.items() if f" {t}" in sql}
        marked = sql
        for t in needs:
            for word in ("FROM", "JOIN"):
                marked = marked.replace(f"{word} {t} ", f"{word} {{{t}}} ").replace(f"{word} {t}\n", f"{word} {{{t}}}\n")
                if marked.endswith(f"{word} {t}"):
                    marked = marked[: -len(t)] + f"{{{t}}}"
        used = {t: df for t, df in needs.items() if f"{{{t}}}" in marked}
        out[name] = spark.sql(marked, **used)
    out["visit_line"] = _visit_lines(out["orders"], out["lineitem"])
    return out


def _visit_lines(orders: DataFrame, lines: DataFrame) -> DataFrame:
    """Every encounter beside the records of each of its lines, ``result_``, ``diagnosis_`` and ``medicine_`` with the column's name; nulls if it has no line.

    ``visit_place`` tells encounters apart that repeat an id. All are columns of one join, which a query of several shuffles once; it stays dealt by encounter, so counts an encounter need no other shuffle.
    """
    placed_orders = dealt(orders.withColumn("visit_place", F.monotonically_increasing_id()), "o_orderkey")
    made, rows = tables(SPARK), placed_orders.join(dealt(lines, "l_orderkey"), F.col("o_orderkey") == F.col("l_orderkey"), "left")
    raw, out = rows.columns, [F.col("visit_place")]
    for name in ("encounter", "diagnosis", "medicine", "observation", "result"):
        columns = re.split(r"\sFROM\s", made[name].removeprefix("SELECT "))[0]
        wide = orders.sparkSession.sql(f"SELECT *, {columns} FROM {{rows}}", rows=rows)
        added = wide.columns[len(rows.columns) :]
        if name == "observation":  # which is what a result is made of
            rows = wide.toDF(*rows.columns, *[f"observation_{c}" if c in raw else c for c in added])
            continue
        rows = wide.toDF(*rows.columns, *[f"{name}_{c}" for c in added])
        out += [F.col(f"{name}_{c}").alias(c if name == "encounter" else f"{name}_{c}") for c in added]
    return rows.select(*out)


def with_lines(t: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """``t`` with observation, result, diagnosis, medicine and visit_line over one stored join of lines and orders, made now.

    For queries that read several of these tables, each of which is that join: it is shuffled once instead of once a table.
    """
    spark, path = t["orders"].sparkSession, f"{folder(t['orders'].sparkSession)}/lines-{uuid4().hex}"
    both = t["lineitem"].join(t["orders"], F.col("l_orderkey") == F.col("o_orderkey"))
    both.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "l_shipdate", "o_custkey", "o_orderdate", "o_orderstatus").write.parquet(path)
    made = tables(SPARK)
    on = "lineitem JOIN orders ON l_orderkey = o_orderkey"
    out = dict(t)
    for name in ("observation", "diagnosis", "medicine"):
        out[name] = spark.sql(made[name].replace(on, "{lines}"), lines=spark.read.parquet(path))
    out["result"] = spark.sql(made["result"].replace("FROM observation", "FROM {observation}"), observation=out["observation"])
    stored = spark.read.parquet(path)
    out["visit_line"] = _visit_lines(t["orders"], stored.select([c for c in stored.columns if c.startswith("l_")]))
    return out


def placed(t: dict[str, DataFrame], name: str, of: str) -> DataFrame:
    """A table made of a raw table ``of`` by one SELECT over ``of`` and orders, with ``place``: the file of a row of ``of``, then its number there.

    Spark deals files to tasks by their size, so no number that it gives to rows follows the files' order.
    """
    sql = tables(SPARK)[name].replace("SELECT ", "SELECT place, ", 1).replace(f"FROM {of} ", "FROM {of} ").replace("JOIN orders ", "JOIN {orders} ")
    return t["orders"].sparkSession.sql(sql, of=t[of].withColumn("place", F.struct("_metadata.file_path", "_metadata.row_index")), orders=t["orders"])


def oracle_with(sql: str) -> str:
    """``sql`` after the tables it may use, for the oracle's dialect."""
    parts, need = tables(DUCK), sql
    chosen: list[str] = []
    for name in reversed(list(parts)):
        if any(f"{w} {name}{end}" in need for w in ("FROM", "JOIN") for end in (" ", "\n", ")", ",")) or need.endswith(f"FROM {name}"):
            chosen.append(name)
            need += " " + parts[name] + " "
    if not chosen:
        return sql
    body = ",\n".join(f"{n} AS ({parts[n]})" for n in reversed(chosen))
    for word in ("WITH RECURSIVE ", "WITH "):
        if sql.lstrip().startswith(word):
            return f"{word}{body},\n{sql.lstrip()[len(word):]}"
    return f"WITH {body}\n{sql}"
