"""Rows that repeat a key: what the SQL leaves open, and readings of one second."""

from cohortspark.operators import relational as R
from cohortspark.plans import blocks, source_queries


def test_tail_keeps_stored_order_of_equal_keys(spark):
    rows = [(1, "hdl", 5, 7, 1, 50.0, 1), (1, "hdl", 5, 7, 1, 40.0, 2), (1, "hdl", 4, 9, 1, 10.0, 3)]
    o = spark.createDataFrame(rows, "patient_id long, analyte string, effective_at int, l_orderkey long, l_linenumber int, value double, place long")
    assert R.tail({"observation": o}, at="place").first()["spark"] == "10.00,50.00,40.00"
    assert R.tail({"observation": o}, 1, "place").first()["spark"] == "40.00"


def test_two_readings_of_one_second_are_two(spark):
    rows = [(1, 8, "2024-01-01 00:00:00.2", "click", 50.0), (2, 8, "2024-01-01 00:00:00.7", "click", 50.0), (3, 8, "2024-01-01 00:00:01", "view", 50.0)]
    e = spark.createDataFrame(rows, "event_id long, user_id long, s string, event_type string, value double").selectExpr("*", "to_timestamp_ntz(s) as ts")
    assert [(r.device_id, r.mg_dl) for r in source_queries.PLANS["src_dexcom"]({"events": e}).collect()] == [(8, 40.0)] * 2


def test_tail_follows_the_files_of_a_table(spark, tmp_path):
    """Of rows with equal keys that of the first file comes first, though the later file is larger and read before it."""
    o = spark.createDataFrame([(1, 7)], "o_orderkey long, o_custkey long")
    line = lambda quantity, n: (1, 1, 3, quantity, "N") if not n else (100 + n, 1, 3, 1.0, "N")
    for i, (quantity, many) in enumerate([(5.0, 1), (9.0, 4000)]):
        rows = spark.createDataFrame([line(quantity, n) for n in range(many)], "l_orderkey long, l_linenumber int, l_partkey long, l_quantity double, l_returnflag string")
        rows.selectExpr("*", "timestamp_ntz'1995-01-01' as l_shipdate").coalesce(1).write.parquet(f"{tmp_path}/{i}")
        next((tmp_path / str(i)).glob("*.parquet")).rename(tmp_path / f"part-{i}.parquet")
    lines = spark.read.parquet(f"{tmp_path}/part-0.parquet", f"{tmp_path}/part-1.parquet")
    assert [r["spark"] for r in blocks.PLANS["op_tail12"]({"lineitem": lines, "orders": o}).collect()] == ["4.50,4.90"]
