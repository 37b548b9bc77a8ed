"""The sink of new readings under replay."""

import datetime as dt
import random

from cohortspark.streaming.sink import KEY, NewReadings

SCHEMA = "device_id long, metric string, time timestamp_ntz, ordinal long, value double"
AT = dt.datetime(2031, 1, 1)


def rows(seed, n=60):
    rng = random.Random(seed)
    return [(rng.randrange(3), rng.choice(["glucose", "steps"]), AT + dt.timedelta(minutes=rng.randrange(20)), i, float(rng.randrange(100)), "bad" if rng.random() < 0.2 else None) for i in range(n)]


def by_hand(batches):
    held, counts, out = set(), {}, []
    for b, batch in enumerate(batches):
        new = 0
        for r in sorted(batch, key=lambda r: r[3]):
            if r[5] is None and r[:3] not in held:
                held.add(r[:3])
                out.append((*r[:5], b))
                new += 1
        bad = sum(r[5] is not None for r in batch)
        counts[b] = (len(batch), new, len(batch) - bad - new, bad)
    return sorted(out), counts


def check(spark, sink, batches):
    want, counts = by_hand(batches)
    got = sorted(tuple(r) for r in sink.stored(spark).select(*KEY, "ordinal", "value", "batch").collect())
    assert got == want
    assert {r.batch: (r.total, r.accepted, r.duplicates, r.rejected) for r in spark.read.parquet(sink.counts_path).collect()} == counts


def test_batches_that_run_again(spark, tmp_path):
    batches = [rows(1), rows(2), rows(3)]
    sink = NewReadings(spark, str(tmp_path), SCHEMA)
    frames = [spark.createDataFrame(b, SCHEMA + ", reason string") for b in batches]
    for b, df in enumerate(frames):
        sink(df, b)
        sink(df, b)  # a replay
    check(spark, sink, batches)
    NewReadings(spark, str(tmp_path), SCHEMA)(frames[2], 2)  # a new driver replays its last batch
    check(spark, sink, batches)


def test_as_the_sink_of_a_stream(spark, tmp_path):
    batches = [rows(4), rows(5)]
    for b in batches:
        spark.createDataFrame(b, SCHEMA + ", reason string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    sink = NewReadings(spark, str(tmp_path / "out"), SCHEMA)
    stream = spark.readStream.schema(SCHEMA + ", reason string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = stream.writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    assert q.awaitTermination(120) and q.exception() is None
    held = sink.stored(spark).select(*KEY).collect()
    assert len(held) == len(set(held)) == len({r[:3] for b in batches for r in b if r[5] is None})
    assert sorted(r.batch for r in spark.read.parquet(sink.counts_path).collect()) == [0, 1]


def test_a_batch_without_anything_new(spark, tmp_path):
    sink = NewReadings(spark, str(tmp_path), SCHEMA)
    df = spark.createDataFrame(rows(6), SCHEMA + ", reason string")
    sink(df, 0)
    sink(df, 1)
    assert sink.stored(spark).where("batch = 1").count() == 0
    assert spark.read.parquet(sink.counts_path).where("batch = 1").first().accepted == 0
