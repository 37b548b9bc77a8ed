"""Bounded samples of labelled rows for fitting models on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Values of a label at most; with more, nothing is fitted and an error says so.
VALUES = 1000


def bounded(labelled: DataFrame, docs: DataFrame, by: str, rows: int, seed: int = 5, values: int = VALUES) -> tuple[list, dict]:
    """At most ``rows`` rows (doc_id, text, ``by``) for each value of ``by``, by a seeded hash of the id; and how
    many rows each value has. More than ``values`` values raise a ValueError.

    ``labelled`` (doc_id, ``by``) is counted in full; the share taken follows from the counts, so what reaches the
    driver is bounded by ``rows`` and ``values`` whatever the size of the input.
    """
    clean = labelled.where(F.col("doc_id").isNotNull() & F.col(by).isNotNull())
    counts = {r[by]: r["count"] for r in clean.groupBy(by).count().orderBy(F.desc("count"), by).limit(values + 1).collect()}
    if len(counts) > values:
        raise ValueError(f"more than {values} values of {by} to learn")
    if not counts:
        return [], {}
    share = F
    for value, n in counts.items():
        share = share.when(F.col(by) == F.lit(value), F.lit(min(1.0, rows / n)))
    spot = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    chosen = clean.where(spot < share.otherwise(0.0)).dropDuplicates(["doc_id"]).limit(2 * rows * len(counts))
    ids = [(r["doc_id"], r[by]) for r in chosen.select("doc_id", by).collect()]
    given = dict(ids)
    texts = docs.where(F.col("doc_id").isin(list(given)) & F.col("text").isNotNull()).select("doc_id", "text").dropDuplicates(["doc_id"]).collect()
    return sorted((r["doc_id"], r["text"], given[r["doc_id"]]) for r in texts), counts
