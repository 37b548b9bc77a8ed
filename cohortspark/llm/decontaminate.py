"""Benchmark decontamination over a positional inverted index, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortspark.llm import scratch

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def tokens(text: Column) -> Column:
    """Words of letters, digits and non-ASCII characters, A-Z lower-cased; none for null."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    low = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    return F.coalesce(F.array_remove(F.split(low, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), ""), F.array().cast("array<string>"))


def windows(items: DataFrame, size: int) -> DataFrame:
    """(window_id, words, items): distinct windows of ``size`` consecutive item words; shorter items are one window."""
    w = items.select(F.col("item_id"), tokens(F.col("text")).alias("all")).where("size(all) > 0")
    starts = F.sequence(F.lit(1), F.greatest(F.size("all") - size + 1, F.lit(1)))
    each = w.select("item_id", "all", F.explode(starts).alias("at")).select("item_id", F.slice("all", F.col("at"), F.lit(size)).alias("words"))
    return each.groupBy("words").agg(F.collect_set("item_id").alias("items")).select(F.sha2(F.concat_ws(" ", "words"), 256).alias("window_id"), "words", "items")


def text_hash(text: Column) -> Column:
    """What tells apart rows that share an id."""
    return F.xxhash64(text, F.octet_length(text))


def index(docs: DataFrame, terms: DataFrame | None = None, owner: str = "") -> tuple[DataFrame, DataFrame]:
    """(vocabulary, postings) of ``docs``, stored: the positional inverted index.

    The vocabulary is (term, term_id): ``terms`` (term), or every word of the corpus, which serves any tests. Postings
    are (term_id, doc, text_hash, pos), sorted by term in each file, so that the lists of rare terms are read without
    the rest. One pass over the corpus whatever the number of terms. A null id is 0 there; equal texts have equal lists.
    """
    words = docs.select(F.coalesce(F.col("doc_id"), F.lit(0)).cast("long").alias("doc"), text_hash(F.col("text")).alias("text_hash"), F.posexplode(tokens(F.col("text"))).alias("pos", "term"))
    if terms is None:
        terms = words.select("term")
    vocabulary = scratch.written(terms.where("term is not null").select("term").distinct().withColumn("term_id", F.monotonically_increasing_id()), "vocabulary", owner)
    found = words.join(scratch.small(vocabulary), "term").select("term_id", "doc", "text_hash", "pos")
    return vocabulary, scratch.written(found.sortWithinPartitions("term_id", "doc", "text_hash", "pos"), "postings", owner)


def ranked(tests: DataFrame, vocabulary: DataFrame, postings: DataFrame, owner: str = "") -> DataFrame:
    """(window_id, length, offset, term_id, rank): the terms of each window, rank 1 has the fewest postings.

    Windows with a term that no document has cannot occur and are left out.
    """
    counts = scratch.written(postings.groupBy("term_id").count(), "counts", owner)
    known = scratch.small(scratch.written(vocabulary.join(counts, "term_id"), "known", owner))
    terms = tests.select("window_id", F.size("words").alias("length"), F.posexplode("words").alias("offset", "term")).join(known, "term", "left")
    w = Window.partitionBy("window_id")  # at most as many rows as a window has words
    terms = terms.withColumn("there", F.count("term_id").over(w)).where("there = length")
    terms = terms.withColumn("rank", F.row_number().over(w.orderBy("count", "offset")))
    return scratch.written(terms.select("window_id", "length", "offset", "term_id", "rank"), "ranked", owner)


PLACE = ["doc", "text_hash", "start", "window_id"]


def search(vocabulary: DataFrame, postings: DataFrame, tests: DataFrame, slop: int | None = None, owner: str = "") -> DataFrame:
    """(doc, text_hash, start, length, window_id, exact): every place where a window of ``tests`` occurs, from a stored index.

    The lists of each window's rarest term propose places (position less offset); the list of the next rarest must
    meet there, then those of all others, whose postings are read for the documents that are left only. With
    ``slop``, a term may stand up to ``slop`` words from its place (exact false), in any order.
    """
    terms = ranked(tests, vocabulary, postings, owner)
    reach = slop or 0
    one = terms.where("rank = 1").select("window_id", "length", "offset", "term_id")
    places = postings.join(scratch.small(one), "term_id").select("doc", "text_hash", (F.col("pos") - F.col("offset")).alias("start"), "window_id", "length")
    places = places.where(F.lit(slop is not None) | (F.col("start") >= 0))

    def wanted(rows: DataFrame, more: DataFrame) -> DataFrame:
        """The posting that each further term must have: one for every way it may be off its place."""
        off = F.explode(F.sequence(F.lit(-reach), F.lit(reach))).alias("off")
        want = rows.join(scratch.small(more.select("window_id", "offset", "term_id")), "window_id").select(*PLACE, "length", "offset", "term_id", off)
        return want.withColumn("pos", F.col("start") + F.col("offset") + F.col("off"))

    key = ["term_id", "doc", "text_hash", "pos"]
    two = terms.where("rank = 2")
    second = postings.join(scratch.small(two.select("term_id").distinct()), "term_id", "left_semi")
    met = wanted(places, two).join(second.hint("merge"), key, "left_semi").select(*PLACE, "length", F.abs("off").alias("off"))
    met = met.unionByName(places.where("length = 1").withColumn("off", F.lit(0)))
    met = scratch.written(met.groupBy(*PLACE, "length").agg(F.min("off").alias("off")), "places", owner)

    left = scratch.small(scratch.written(met.where("length > 2").select("doc", "text_hash").distinct(), "left", owner))
    rest = postings.join(left, ["doc", "text_hash"], "left_semi")
    others = wanted(met.drop("off"), terms.where("rank > 2")).join(rest, key, "left_semi")
    others = others.groupBy(*PLACE, "length", "offset").agg(F.min(F.abs("off")).alias("off")).groupBy(*PLACE, "length").agg(F.count("*").alias("n"), F.max("off").alias("far"))
    whole = met.where("length > 2").join(others.where("n = length - 2").drop("length"), PLACE).select(*PLACE, "length", F.greatest("off", "far").alias("off"))
    out = whole.unionByName(met.where("length <= 2").select(*PLACE, "length", "off"))
    return out.select("doc", "text_hash", "start", "length", "window_id", (F.col("off") == 0).alias("exact"))


def matches(docs: DataFrame, items: DataFrame, size: int = 10, slop: int | None = None, owner: str = "") -> tuple[DataFrame, DataFrame]:
    """(rows, matches): n_words of every row of ``docs``, and every place where a window of ``items`` occurs.

    Rows are (doc_id, text_hash, n_words); matches are (doc_id, text_hash, start, length, window_id, items, exact), with
    the id 0 for null. Only the terms of ``items`` are indexed.
    """
    tests = scratch.written(windows(items, size), "windows", owner)
    vocabulary, postings = index(docs, tests.select(F.explode("words").alias("term")), owner)
    found = scratch.written(search(vocabulary, postings, tests, slop, owner), "found", owner)
    rows = docs.select("doc_id", text_hash(F.col("text")).alias("text_hash"), F.size(tokens(F.col("text"))).alias("n_words"))
    return rows, found.join(tests.select("window_id", "items"), "window_id").select(F.col("doc").alias("doc_id"), "text_hash", "start", "length", "window_id", "items", "exact")


def contamination(docs: DataFrame, items: DataFrame, size: int = 10, owner: str = "") -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated), one row per row of ``docs``.

    A word is hit if it lies in an occurrence of a window of ``size`` consecutive item words (an item of fewer
    words is one window). Null and empty texts have no words and no hits; items without words never occur; null
    item ids count as hits but are not listed. Rows may repeat ids; null ids are kept. Extra columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counted, met = matches(docs, items.select("item_id", F.col("text").cast("string").alias("text")), size, owner=owner)
    # one text is one group: at most a span for each of its words
    spans = met.groupBy("doc_id", "text_hash", "start").agg(F.max("length").alias("length"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))
    whole = spans.groupBy("doc_id", "text_hash").agg(
        F.sort_array(F.collect_list(F.struct("start", (F.col("start") + F.col("length")).alias("stop")))).alias("spans"),
        F.flatten(F.collect_set("items")).alias("items"),
    )
    merged = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("stop"), F.lit(0).cast("long").alias("n")),
        lambda a, s: F.struct(F.greatest(a["stop"], s["stop"]).alias("stop"), (a["n"] + F.greatest(s["stop"] - F.greatest(a["stop"], s["start"]), F.lit(0))).alias("n")),
        lambda a: a["n"],
    )
    names = F.array_sort(F.array_distinct(F.transform("items", lambda x: x.cast("string"))))
    hits = whole.select(F.col("doc_id").alias("hit_id"), F.col("text_hash").alias("hit_hash"), merged.alias("n_hit"), names.alias("names"))
    hits = scratch.small(scratch.written(hits, "hits", owner))
    rows = counted.select("doc_id", "text_hash", F.col("n_words").cast("long").alias("n_words"))
    out = rows.join(hits, (F.coalesce("doc_id", F.lit(0)) == F.col("hit_id")) & (F.col("text_hash") == F.col("hit_hash")), "left")
    names = F.coalesce("names", F.array().cast("array<string>"))
    return out.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size(names).cast("long").alias("n_items"), F.sha2(F.array_join(names, ","), 256).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents
), b AS (
  SELECT item_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM benchmark
), t AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i+9], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)
), lens AS (SELECT DISTINCT n FROM t), p AS (
  SELECT doc_id, i, n, array_to_string(w[i:i+n-1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n)
), m AS (SELECT doc_id, i, p.n, item_id FROM p JOIN t ON p.g = t.g AND p.n = t.n
), h AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS x FROM m) GROUP BY 1
), k AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS names FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM m) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h ON d.doc_id = h.doc_id LEFT JOIN k ON d.doc_id = k.doc_id
"""
