"""Groups that are compared within: dealt out in pairs of chunks, and met as runs of sorted rows in a task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dealt(rows: DataFrame, group: list[str], node: str, chunk: int) -> DataFrame:
    """``rows`` with c, lo and hi, sorted by group, lo, hi in each partition.

    A group of n rows has ceil(n / chunk) chunks; a row of chunk c comes once for every pair of chunks it is in, so
    a task holds at most two chunks. Two rows of different chunks meet once, in the group's (lo, hi) with both.
    """
    sizes = rows.groupBy(*group).count().where("count > 1").select(*group, F.ceil(F.col("count") / chunk).cast("int").alias("chunks"))
    out = rows.join(sizes, group).withColumn("c", F.pmod(F.xxhash64(node), F.col("chunks")).cast("int"))
    out = out.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    out = out.withColumn("lo", F.least("c", "k")).withColumn("hi", F.greatest("c", "k")).drop("chunks", "k")
    return out.repartition(*group, "lo", "hi").sortWithinPartitions(*group, "lo", "hi", node)


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray]]:
    """(table, key values by column, offsets of its groups): whole groups of sorted rows, over batch borders."""
    held: list[pa.Table] = []

    def values(t: pa.Table) -> np.ndarray:
        return np.stack([t.column(c).to_numpy().astype(np.int64) for c in keys])

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(pa.Table.from_batches([batch]))
        t = pa.concat_tables(held).combine_chunks()
        k = values(t)
        cut = np.flatnonzero((k[:, 1:] != k[:, :-1]).any(axis=0)) + 1
        if len(cut):  # the last group may go on
            yield t.slice(0, cut[-1]).combine_chunks(), k, np.append(0, cut)
            t = t.slice(cut[-1])
        held = [t]
    if held:
        t = pa.concat_tables(held).combine_chunks()
        yield t, values(t), np.array([0, t.num_rows])
