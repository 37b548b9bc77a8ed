"""Shards from fixed virtual slots and a versioned slot-to-shard map, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspark.llm import scratch

#: Virtual slots; fixed for the life of a corpus, so a record never changes its slot.
SLOTS = 4096
OVERHEAD = 16


def sized(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """``docs`` with size (UTF-8 bytes of text plus ``OVERHEAD``), text_crc32 and virtual_slot.

    The slot is a hash of the id; rows without one are spread by their text, so a hot null key fills no slot alone.
    """
    text = F.col("text").cast("string")
    key = F.coalesce(F.xxhash64(F.col("doc_id").cast("long"), F.lit(11)), F.lit(0))
    key = F.when(F.col("doc_id").isNull(), F.xxhash64(text, F.lit(13))).otherwise(key)
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + OVERHEAD).alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.pmod(key, F.lit(slots)).cast("int").alias("virtual_slot"),
    )


def slot_bytes(rows: DataFrame, slots: int = SLOTS) -> DataFrame:
    """(virtual_slot, bytes, rows) of all ``slots``, those without rows with zeros."""
    used = rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    every = rows.sparkSession.range(slots).select(F.col("id").cast("int").alias("virtual_slot"))
    zero = F.lit(0).cast("long")
    return every.join(used, "virtual_slot", "left").select("virtual_slot", F.coalesce("bytes", zero).alias("bytes"), F.coalesce("rows", zero).alias("rows"))


def assign(bytes_: DataFrame, shards: int, version: int = 1) -> DataFrame:
    """The slot map (version, virtual_slot, shard, bytes, rows): heaviest slot first to the lightest shard.

    One fold over all slots, ``SLOTS`` at most; slots without rows are in it too, so a grown corpus finds its own.
    Ties go to the smaller slot and the smaller shard.
    """
    slots = F.sort_array(F.collect_list(F.struct((-F.col("bytes")).alias("minus"), F.col("virtual_slot").alias("slot"), "rows")))
    start = F.struct(
        F.array_repeat(F.lit(0).cast("long"), shards).alias("load"),
        F.array().cast("array<struct<slot:int,shard:int,bytes:bigint,rows:bigint>>").alias("put"),
    )

    def step(a, s):
        to = F.array_position(a["load"], F.array_min(a["load"])).cast("int") - 1
        load = F.transform(a["load"], lambda x, i: F.when(i == to, x - s["minus"]).otherwise(x))
        one = F.struct(s["slot"].alias("slot"), to.alias("shard"), (-s["minus"]).alias("bytes"), s["rows"].alias("rows"))
        return F.struct(load.alias("load"), F.concat(a["put"], F.array(one)).alias("put"))

    put = bytes_.agg(slots.alias("slots")).select(F.explode(F.aggregate("slots", start, step, lambda a: a["put"])).alias("p"))
    return put.select(F.lit(version).alias("version"), F.col("p.slot").alias("virtual_slot"), F.col("p.shard").alias("shard"), F.col("p.bytes").alias("bytes"), F.col("p.rows").alias("rows"))


def rebalance(slot_map: DataFrame, bytes_: DataFrame, shards: int, version: int) -> DataFrame:
    """The next map version: slots stay where they are, but for those that must go.

    Every shard keeps its heaviest slots up to an equal share of all bytes; the rest (and slots of shards that no
    longer exist, or that are new) go, heaviest first, to the room left in each shard. Unmoved slots keep shards.
    """
    now = bytes_.join(slot_map.select("virtual_slot", F.col("shard").alias("old")), "virtual_slot", "left")
    share = bytes_.agg((F.sum("bytes") / shards).alias("share"))
    run = F.expr("sum(bytes) over (partition by old order by bytes desc, virtual_slot)")
    ranked = now.crossJoin(F.broadcast(share)).withColumn("stays", F.coalesce((F.col("old") < shards) & (run <= F.col("share")), F.lit(False)))
    kept = ranked.where("stays").select("virtual_slot", F.col("old").alias("shard"), "bytes", "rows")
    moved = ranked.where("not stays").select("virtual_slot", "bytes", "rows")
    load = F.aggregate(
        F.collect_list(F.struct("shard", "bytes")),
        F.array_repeat(F.lit(0).cast("long"), shards),
        lambda a, s: F.transform(a, lambda x, i: F.when(i == s["shard"], x + s["bytes"]).otherwise(x)),
    )
    slots = F.sort_array(F.collect_list(F.struct((-F.col("bytes")).alias("minus"), F.col("virtual_slot").alias("slot"), "rows")))

    def step(a, s):
        to = F.array_position(a["load"], F.array_min(a["load"])).cast("int") - 1
        grown = F.transform(a["load"], lambda x, i: F.when(i == to, x - s["minus"]).otherwise(x))
        one = F.struct(s["slot"].alias("slot"), to.alias("shard"), (-s["minus"]).alias("bytes"), s["rows"].alias("rows"))
        return F.struct(grown.alias("load"), F.concat(a["put"], F.array(one)).alias("put"))

    empty = F.array().cast("array<struct<slot:int,shard:int,bytes:bigint,rows:bigint>>")
    both = moved.agg(slots.alias("slots")).crossJoin(kept.agg(load.alias("load")))
    put = both.select(F.explode(F.aggregate("slots", F.struct("load", empty.alias("put")), step, lambda a: a["put"])).alias("p"))
    fresh = put.select(F.col("p.slot").alias("virtual_slot"), F.col("p.shard").alias("shard"), F.col("p.bytes").alias("bytes"), F.col("p.rows").alias("rows"))
    return kept.unionByName(fresh).select(F.lit(version).alias("version"), "virtual_slot", "shard", "bytes", "rows")


def versions(spark: SparkSession, path: str) -> set[int]:
    """The versions stored in ``path``; none if there is nothing yet."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return set()
    return {r["version"] for r in spark.read.parquet(path).select("version").distinct().collect()}


def save(slot_map: DataFrame, path: str) -> None:
    """Add a version to the stored map; readers take the greatest version or the one they were built with.

    A version that is stored already is never written again: that is an error.
    """
    new = {r["version"] for r in slot_map.select("version").distinct().collect()}
    if twice := new & versions(slot_map.sparkSession, path):
        raise ValueError(f"{path} has version {sorted(twice)} already")
    slot_map.write.mode("append").partitionBy("version").parquet(path)


def load(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The slots of one version of the stored map, by default the greatest."""
    stored = spark.read.parquet(path)
    if version is None:
        version = stored.agg(F.max("version")).first()[0]
    return stored.where(F.col("version") == version)


def shard(docs: DataFrame, shards: int = 40, slots: int = SLOTS, slot_map: DataFrame | None = None, owner: str = "") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard, virtual_slot), one row per row of ``docs``.

    The law is ``bytes``: shards of nearly equal size, as the slot map (by default a new one) balances the bytes
    of hashed slots. ``slot`` numbers the rows of a shard without gaps from 0, in the order of virtual slots and,
    in one, of ids; repeated rows stand next to each other. Null and empty texts have the size ``OVERHEAD``; a null
    text has no checksum. Rows with null ids are placed by text. An empty table gives no rows. A given ``slot_map``
    must name every slot that has rows; a row whose slot it lacks is an error, never dropped. Extra columns are ignored.
    """
    rows = scratch.written(sized(docs, slots), "sized", owner)
    per_slot = slot_bytes(rows, slots)
    slot_map = scratch.written(slot_map if slot_map is not None else assign(per_slot, shards), "slot_map", owner)
    order = "over (partition by shard order by virtual_slot)"
    known = per_slot.select("virtual_slot", F.col("rows").alias("n")).join(slot_map, "virtual_slot", "left")
    missing = F.raise_error(F.concat(F.lit("the slot map has no slot "), F.col("virtual_slot").cast("string"))).cast("int")
    known = known.select("virtual_slot", "n", F.when(F.col("shard").isNotNull() | (F.col("n") == 0), F.col("shard")).otherwise(missing).alias("shard"))
    placed = known.select("virtual_slot", "shard", F.expr(f"sum(n) {order} - n").alias("before"))
    numbered = rows.withColumn("at", F.expr("row_number() over (partition by virtual_slot order by doc_id, text_crc32, size)"))
    out = numbered.join(F.broadcast(placed), "virtual_slot")  # at most ``slots`` rows
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("at") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "virtual_slot")
