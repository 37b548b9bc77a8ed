"""A training corpus from ``documents``: quality, near duplicates, decontamination, mixture, shards.

Each stage takes what its predecessor kept, stored as Parquet; its intermediate tables are deleted when the next stage
starts, as its own result is stored by then.
"""

from __future__ import annotations

import uuid
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspark.llm import decontaminate, mixing_query, scratch, shards
from cohortspark.llm.jaccard import jaccard_members
from cohortspark.llm.mixing import mix
from cohortspark.llm.quality import keep_good

#: Who the intermediate tables belong to: a run has a name of its own, so runs never delete each other's.
_owner: ContextVar[str] = ContextVar("owner", default=f"pipeline-{uuid.uuid4().hex}")
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Near copies: shingles of five words with Jaccard of at least 4/5; op6_jaccard has its own values.
WORDS, NUM, DEN = 5, 4, 5
#: The mixture of the pipeline: nine tenths of all tokens, at most two epochs of a source.
SHARE, EPOCHS = 0.9, 2


def _begin(spark: SparkSession) -> str:
    """The owner of the tables of this run; what its last stage left is deleted, as that stage's result is stored."""
    scratch.clear(spark, _owner.get())
    return _owner.get()


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts, repeated rows and null ids alike; null and empty texts are scored too.

    An empty table stays empty; without any labels to learn from every document stays.
    """
    _begin(spark)
    return keep_good(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of the n-gram Jaccard join: that with the smallest id, of those the smallest text hash.

    A row is named by its id and text hash, so other texts under the id of a dropped row stay. Of repeated rows one
    stays. Documents without words are in no class and stay; null ids come last in their class.
    """
    owner = _begin(spark)
    rows = scratch.written(jaccard_members(docs, k=WORDS, num=NUM, den=DEN, owner=owner), "classes", owner)
    full = rows.where("n_shingles > 0")
    own = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    least = scratch.written(full.groupBy("root").agg(F.min(own).alias("least")), "least", owner)  # two shuffles: Spark can split a hot class
    gone = full.join(least, "root").where(~own.eqNullSafe(F.col("least"))).select("doc_id", "text_hash").distinct()
    gone = scratch.written(gone, "gone", owner)
    twice = rows.where("doc_id is not null or n_shingles > 0").groupBy("doc_id", "text_hash").count().where("count > 1").select("doc_id", "text_hash")
    named = docs.select(*COLUMNS, F.xxhash64(F.col("text").cast("string")).alias("text_hash"))
    kept = _rows(named, scratch.small(gone), "left_anti")
    if not twice.limit(1).count():
        return kept.select(*COLUMNS)
    several = _rows(kept, twice, "left_semi").dropDuplicates(["doc_id", "text"])
    return _rows(kept, twice, "left_anti").unionByName(several).select(*COLUMNS)


def _rows(named: DataFrame, of: DataFrame, how: str) -> DataFrame:
    of = of.select(F.col("doc_id").alias("hit_id"), F.col("text_hash").alias("hit_hash"))
    return named.join(of, F.col("doc_id").cast("long").eqNullSafe(F.col("hit_id")) & (F.col("text_hash") == F.col("hit_hash")), how)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of ten words of a benchmark item occurs.

    Null and empty texts stay, as do repeated rows and null ids without an occurrence; rows are told apart by id and text.
    """
    owner = _begin(spark)
    docs = docs.select(*COLUMNS)
    _, found = decontaminate.matches(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"), owner=owner)
    hit = scratch.written(found.select(F.col("doc_id").alias("hit_id"), F.col("text_hash").alias("hit_hash")).distinct(), "hit", owner)
    return docs.join(scratch.small(hit), (F.coalesce("doc_id", F.lit(0)) == F.col("hit_id")) & (decontaminate.text_hash(F.col("text").cast("string")) == F.col("hit_hash")), "left_anti")


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents in the numbers that meet the target weights of domains, languages and sources.

    A document that a leaf takes in two epochs is there twice. Documents without words are never taken, null names
    count as ''. An empty table stays empty.
    """
    owner = _begin(spark)
    mixed = mix(docs.select(*COLUMNS), mixing_query.levels(), mixing_query.WEIGHTS, share=SHARE, max_epochs=EPOCHS, seed=mixing_query.SEED, whole_rows=True, owner=owner)
    return mixed.select(*COLUMNS)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard and the place in it of every document: null ids are placed by text, repeated rows stand side by side.

    Null and empty texts count as 16 bytes. An empty table gives no rows.
    """
    owner = _begin(spark)
    return shards.shard(docs, owner=owner)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mixture", mixture), ("sharding", sharding)]
#: The quality stage is a trained model, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``, each result stored as Parquet in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    name_of_run = f"pipeline-{uuid.uuid4().hex}"
    base = f"{scratch.shared_dir(spark).rstrip('/')}/cohortspark/{name_of_run}"
    token = _owner.set(name_of_run)
    try:
        for i, (name, stage) in enumerate(STAGES):
            path = f"{base}/{i}-{name}"
            stage(spark, docs, sf_dir).write.parquet(path)
            docs = spark.read.parquet(path)
    finally:
        scratch.clear(spark, name_of_run)
        _owner.reset(token)
    return docs
