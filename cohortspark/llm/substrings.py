"""Repeated passages: MinHash bands over paragraphs and content-defined windows, exact checks, removal by components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortspark.llm import pairjoin, scratch
from cohortspark.llm import textops as T

SHINGLE = 5
#: Shortest line, in words, that is a paragraph of its own; shorter ones count as parts of windows only.
MIN_WORDS = 20
#: 7 bands of 2: paragraphs of Jaccard 0.8 share none with a probability of (1 - 0.8^2)^7 = 0.0008.
BANDS, ROWS = 7, 2
#: A common run of PASSAGE words or more is found whatever the lines: the least hash of the ANCHOR-word shingles of any
#: PASSAGE words is an anchor, and of the windows of WINDOW words from 0, STEP, 2 STEP words before it one lies in the run.
PASSAGE, ANCHOR, STEP = 50, 16, 12
REACH = PASSAGE - ANCHOR + 1
WINDOW = PASSAGE - STEP + 1
_UNITS = "array<struct<para:int,start:int,stop:int,first:int,last:int,node:bigint,keys:array<bigint>>>"
_ANCHORS = "array<struct<at:int,key:bigint,w0:bigint,w1:bigint,w2:bigint>>"


def paragraphs(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets of all paragraphs (lines) and the text of each."""
    at = np.unique(np.concatenate([np.flatnonzero(raw == T.NEWLINE) + 1, off]))
    return at, np.searchsorted(off, at[:-1], "right") - 1


def minhash(h: np.ndarray, first: np.ndarray, count: int, salt: int = 4242) -> np.ndarray:
    """(row, function): the least of each range of hashes under each of ``count`` hash functions; ranges not empty."""
    out = np.empty((len(first) - 1, count), np.uint64)
    for i, s in enumerate(T.seeds(count, salt)):
        out[:, i] = np.minimum.reduceat((h ^ s) * (s | T.U(1)) >> T.U(20), first[:-1])
    return out


def band_keys(signature: np.ndarray, rows: int) -> np.ndarray:
    """One key for each band of ``rows`` minima."""
    bands = signature.shape[1] // rows
    key = np.zeros((len(signature), bands), T.U)
    for r in range(rows):
        key = T.mix(key + signature[:, r::rows][:, :bands] + T.U(r + 1))
    return T.mix(key ^ T.seeds(bands, 99)[None, :])


def anchors(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, word, key, windows) of the anchors of texts whose word hashes are ``h``; first: n + 1 word offsets.

    An anchor's key is the hash of its ANCHOR words; windows are hashes of the WINDOW words 0, STEP and 2 STEP before it.
    """
    runs = T.run_hash(h)
    start = np.arange(len(h))
    text = np.searchsorted(first, start, "right") - 1
    left = first[text + 1] - start  # words from here to the end of the text
    none = np.zeros(0, np.int64)
    whole = np.flatnonzero(left >= PASSAGE)
    if not len(whole):
        return none, none, none.view(np.uint64), np.zeros((3, 0), np.uint64)
    key = runs(np.arange(len(h) - ANCHOR + 1), ANCHOR)
    least = np.lib.stride_tricks.sliding_window_view(key, REACH)[whole].argmin(axis=1)
    at = np.unique(whole + least)
    windows = np.zeros((3, len(at)), np.uint64)
    for i in range(3):
        s = at - i * STEP
        ok = (s >= first[text[at]]) & (s + WINDOW <= first[text[at] + 1])
        windows[i, ok] = runs(s[ok], WINDOW) | T.U(1)  # 0 stands for none
    return text[at], at - first[text[at]], key[at], windows


def _lists(owner: np.ndarray, n: int, fields: dict[str, pa.Array]) -> pa.Array:
    """A list of structs for each of ``n`` rows; ``owner`` is the row of each struct, in order."""
    cut = np.searchsorted(owner, np.arange(n + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(cut), pa.StructArray.from_arrays(list(fields.values()), names=list(fields)))


def _index(min_words: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for row, raw, off in T.pieces(batch.column("text")):
                n = len(off) - 1
                at, text = paragraphs(raw, off)
                w = T.words(raw, at)
                many = np.diff(w.first)
                base = np.searchsorted(at, off)  # first line of each text
                use = np.flatnonzero(many >= min_words)
                node = _node(w, use)
                keys: list = [None] * len(use)
                new = np.array([i for i, v in enumerate(node.tolist()) if v not in seen and not seen.add(v)], np.int64)
                if len(seen) > 1_000_000:
                    seen.clear()
                if len(new):
                    h, owner = T.shingles(w, SHINGLE)
                    cut = np.searchsorted(owner, np.stack([use[new], use[new] + 1], axis=1))
                    part = np.concatenate([h[i:j] for i, j in cut])
                    first = np.concatenate([[0], np.cumsum(cut[:, 1] - cut[:, 0])])
                    for i, k in zip(new, band_keys(minhash(part, first, bands * rows), rows).view(np.int64)):
                        keys[i] = k
                t = text[use]
                units = {"para": pa.array((use - base[t]).astype(np.int32)), "start": pa.array((at[use] - off[t]).astype(np.int32)), "stop": pa.array((at[use + 1] - off[t]).astype(np.int32))}
                units |= {"first": pa.array((w.first[use] - w.first[base[t]]).astype(np.int32)), "last": pa.array((w.first[use + 1] - w.first[base[t]]).astype(np.int32))}
                units |= {"node": pa.array(node), "keys": pa.array(keys, pa.list_(pa.int64()))}
                place, word, key, windows = anchors(w.hash, w.first[base])
                marks = {"at": pa.array(word.astype(np.int32)), "key": pa.array(key.view(np.int64))}
                marks |= {f"w{i}": pa.array(x.view(np.int64), mask=x == 0) for i, x in enumerate(windows)}
                total = np.bincount(text[many > 0], minlength=n) if len(text) else np.zeros(n, int)
                columns = [batch.column("doc_id").slice(row, n), batch.column("text_hash").slice(row, n), pa.array(total, pa.int64()), _lists(t, n, units), _lists(place, n, marks)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_hash", "n_paragraphs", "units", "anchors"])

    return run


def _node(w: T.Words, use: np.ndarray) -> np.ndarray:
    """A hash of the word sequence of each paragraph of ``use``."""
    line = w.text
    at = np.arange(len(w.hash)) - w.first[line]
    whole = T.sums(T.mix(w.hash + at.astype(T.U) * T.U(0x9E3779B97F4A7C15)), w.first)
    return T.mix(whole + np.diff(w.first).astype(T.U))[use].view(np.int64)


def _sets(min_words: int, num: int, den: int):
    """A task: texts to (node, n, sketch, elements) of every paragraph."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, raw, off in T.pieces(batch.column("text")):
                w = T.words(raw, paragraphs(raw, off)[0])
                use = np.flatnonzero(np.diff(w.first) >= min_words)
                h, owner = T.shingles(w, SHINGLE)
                cut = np.searchsorted(owner, np.stack([use, use + 1], axis=1))
                sets = [np.unique(h[i:j]) for i, j in cut]
                if len(use):
                    columns = [pa.array(_node(w, use)), pa.array([len(e) for e in sets], pa.int64()), pa.array([pairjoin.sketch(e, num, den) for e in sets], pa.binary()), pa.array([e.tobytes() for e in sets], pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, names=["node", "n", "sketch", "elements"])

    return run


def _name() -> Column:
    return F.xxhash64("doc_id", "text_hash")


def indexed(docs: DataFrame, min_words: int = MIN_WORDS, bands: int = BANDS, rows: int = ROWS, owner: str = "") -> DataFrame:
    """(doc_id, text_hash, n_paragraphs, units, anchors) of every row: its lines and the anchors of its windows, stored."""
    docs = _texts(docs)
    return scratch.written(docs.mapInArrow(_index(min_words, bands, rows), f"doc_id long, text_hash long, n_paragraphs long, units {_UNITS}, anchors {_ANCHORS}"), "paragraphs", owner)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("text_hash", F.xxhash64("text"))


def repeated_lines(docs: DataFrame, index: DataFrame, num: int = 4, den: int = 5, min_words: int = MIN_WORDS, owner: str = "") -> DataFrame:
    """(doc_id, text_hash, para, first, last, class_id, across, removed) of the lines of a class with several occurrences.

    Equal word sequences (A-Z lower-cased) are one node; nodes that share a MinHash band are verified by exact Jaccard
    of their five-word shingles and joined to components. Of each class the occurrence with the smallest
    (doc_id, para) stays, nulls last. ``across`` says that several documents have it; first and last are word numbers.
    """
    units = index.select("doc_id", "text_hash", F.inline("units"))
    fresh = units.where("keys is not null")
    shared = pairjoin.shared_keys(fresh.select("node", F.explode("keys").alias("key")).distinct(), owner)
    nodes = scratch.written(shared.select("node").distinct(), "nodes", owner)
    holders = fresh.join(nodes, "node", "left_semi").groupBy("node").agg(F.min(F.struct("doc_id", "text_hash")).alias("at"))
    holders = scratch.written(holders.select(F.col("at.doc_id").alias("hit_id"), F.col("at.text_hash").alias("hit_hash")).distinct(), "holders", owner)
    # one way of joining at every size: ids and texts are dealt out by id and text
    found = _texts(docs).join(holders.hint("merge"), F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("text_hash") == F.col("hit_hash"))).select("text")
    marks = found.mapInArrow(_sets(min_words, num, den), "node long, n long, sketch binary, elements binary").join(nodes, "node", "left_semi")
    marks = scratch.written(marks.dropDuplicates(["node"]), "marks", owner)

    roots = pairjoin.classes(shared, marks.select("node", "n", "sketch"), pairjoin.checked(marks.select("node", "elements"), num, den), num, den, owner)
    scratch.forget(shared, nodes, holders, marks)
    placed = units.drop("keys", "start", "stop").join(roots, "node", "left").withColumn("class_id", F.coalesce("root", "node"))
    order = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "para", "text_hash")
    sizes = placed.groupBy("class_id").agg(F.count("*").alias("many"), F.min(order).alias("keep"), (F.min(_name()) != F.max(_name())).alias("across"))
    sizes = scratch.written(sizes.where("many > 1"), "classes", owner)  # so that Spark sees two shuffles and can split a hot class
    out = placed.join(sizes, "class_id").withColumn("removed", ~order.eqNullSafe(F.col("keep")))
    return out.select("doc_id", "text_hash", "para", "first", "last", "class_id", "across", "removed")


def repeated_windows(index: DataFrame, owner: str = "") -> DataFrame:
    """(doc_id, text_hash, first, last, class_id, removed) of the windows that several documents have, word for word.

    Every common run of PASSAGE words has one; a window has WINDOW words, first and last are word numbers. Anchors that
    one document alone has are left out first, before windows are dealt out. The occurrence with the smallest
    (doc_id, first) stays, nulls last.
    """
    rows = index.select("doc_id", "text_hash", F.inline("anchors")).withColumn("doc", _name())
    met = rows.groupBy("key").agg(F.min("doc").alias("low"), F.max("doc").alias("high")).where("low <> high").select("key")
    met = scratch.written(met, "anchors", owner)
    spots = F.array(*[F.struct(F.col(f"w{i}").alias("class_id"), (F.col("at") - i * STEP).alias("first")) for i in range(3)])
    near = rows.join(met, "key", "left_semi").select("doc_id", "text_hash", "doc", F.inline(F.filter(spots, lambda s: s["class_id"].isNotNull())))
    near = scratch.written(near, "windows", owner)
    scratch.forget(met)
    order = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "first", "text_hash")
    several = near.groupBy("class_id").agg(F.min("doc").alias("low"), F.max("doc").alias("high"), F.min(order).alias("keep")).where("low <> high")
    several = scratch.written(several.select("class_id", "keep"), "classes", owner)
    out = near.join(several, "class_id")
    return out.select("doc_id", "text_hash", "first", (F.col("first") + WINDOW).alias("last"), "class_id", (~order.eqNullSafe(F.col("keep"))).alias("removed"))


def _merged(spans: Column) -> Column:
    """Spans (first, last) of words, sorted, joined where they meet or overlap."""
    empty = F.array().cast("array<struct<first:int,last:int>>")

    def step(done: Column, s: Column) -> Column:
        end = F.element_at(done, -1)
        grown = F.struct(end["first"].alias("first"), F.greatest(end["last"], s["last"]).alias("last"))
        one = F.struct(s["first"].alias("first"), s["last"].alias("last"))
        return F.when((F.size(done) > 0) & (s["first"] <= F.try_element_at(done, F.lit(-1))["last"]), F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(grown))).otherwise(F.concat(done, F.array(one)))

    return F.aggregate(F.array_sort(spans), empty, step)


def _found(docs: DataFrame, owner: str, **settings) -> tuple[DataFrame, DataFrame]:
    """(index, per): the index, and for each (doc_id, text_hash) with repeats its lines and windows."""
    line = {k: v for k, v in settings.items() if k in ("min_words", "bands", "rows")}
    index = indexed(docs, owner=owner, **line)
    lines = repeated_lines(docs, index, owner=owner, **{k: v for k, v in settings.items() if k in ("min_words", "num", "den")})
    windows = repeated_windows(index, owner)
    both = lines.select("doc_id", "text_hash", "para", "first", "last", "class_id", "across", "removed").unionByName(windows.withColumn("across", F.lit(True)), allowMissingColumns=True)
    # one text is one group: at most an entry for each of its lines and anchors; rows that repeat are met once
    found = F.collect_set(F.struct("para", "first", "last", "class_id", "across", "removed"))
    return index, both.groupBy("doc_id", "text_hash").agg(found.alias("found")).withColumnsRenamed({"doc_id": "hit_id", "text_hash": "hit_hash"})


def substring_report(docs: DataFrame, owner: str = "", **settings) -> DataFrame:
    """(doc_id, repeated, passages, n_repeated_words, n_paragraphs, n_repeated, n_removed, removed, classes), one row per row of ``docs``.

    ``passages`` are the spans (first and last word number) that other documents have too, ``repeated`` says that one
    of them has ``WINDOW`` words or more: any run of ``PASSAGE`` words in common is found wherever its lines break. ``removed`` lists
    the numbers of the repeated lines to drop, ``classes`` the class of every repeated line, n_repeated and n_removed count
    them. Null and empty texts have no paragraphs. Rows that repeat an id and a text are one document and reported
    alike; null ids stand for one document per text. Texts of any length are read whole. An empty table gives no rows.
    Extra columns are ignored.
    """
    index, per = _found(docs, owner, **settings)
    lines = F.filter("found", lambda x: x["para"].isNotNull())
    spans = F.transform(F.filter("found", lambda x: x["across"]), lambda x: F.struct(x["first"].alias("first"), x["last"].alias("last")))
    per = per.select("hit_id", "hit_hash", lines.alias("lines"), _merged(spans).alias("passages"))
    per = per.withColumn("gone", F.filter("lines", lambda x: x["removed"]))
    out = index.select("doc_id", "text_hash", "n_paragraphs").join(per, F.col("doc_id").eqNullSafe(F.col("hit_id")) & F.col("text_hash").eqNullSafe(F.col("hit_hash")), "left")
    none = lambda c, kind: F.coalesce(c, F.array().cast(f"array<{kind}>"))
    passages = none(F.col("passages"), "struct<first:int,last:int>")
    size = lambda x: x["last"] - x["first"]
    return out.select(
        "doc_id",
        F.exists(passages, lambda x: size(x) >= WINDOW).alias("repeated"),
        passages.alias("passages"),
        F.aggregate(passages, F.lit(0).cast("long"), lambda a, x: a + size(x)).alias("n_repeated_words"),
        "n_paragraphs",
        F.coalesce(F.size(F.col("lines")), F.lit(0)).cast("long").alias("n_repeated"),
        F.coalesce(F.size(F.col("gone")), F.lit(0)).cast("long").alias("n_removed"),
        none(F.array_sort(F.transform("gone", lambda x: x["para"])), "int").alias("removed"),
        none(F.array_sort(F.array_distinct(F.transform("lines", lambda x: x["class_id"]))), "bigint").alias("classes"),
    )


def _cut(text: pd.Series, lines: pd.Series, gone: pd.Series, kept: pd.Series) -> pd.Series:
    """Each text without its dropped lines, and without the words of dropped windows that no kept one holds."""
    out = []
    for t, drop, off, on in zip(text, lines, gone, kept):
        raw, at = T.strings(pa.array([t]))
        w = T.words(raw, paragraphs(raw, at)[0])
        lost = np.zeros(len(w.hash), bool)
        for mark, spans in ((True, off), (False, on)):
            for s in spans:
                lost[s["first"] : s["last"]] = mark
        rest = []
        for i, line in enumerate(t.split("\n")):
            a, b = (w.first[i], w.first[i + 1]) if i + 1 < len(w.first) else (0, 0)
            if i in set(drop) or (b > a and lost[a:b].all()):
                continue
            rest.append(line if not lost[a:b].any() else " ".join(x.decode() for x, gone_ in zip((raw[s:e].tobytes() for s, e in zip(w.start[a:b], w.end[a:b])), lost[a:b]) if not gone_))
        out.append("\n".join(rest))
    return pd.Series(out, dtype=object)


def strip(docs: DataFrame, owner: str = "", **settings) -> DataFrame:
    """``docs`` with removed lines and the removed words of repeated windows cut from their texts; all columns and rows stay.

    A passage stays in its first document and is cut from the others. Null and empty texts stay as they are, rows that
    repeat an id and a text are cut alike, an empty table stays empty. Columns with names of the operator's own are kept.
    """
    _, per = _found(docs, owner, **settings)
    spans = lambda removed: F.transform(F.filter("found", lambda x: x["para"].isNull() & (x["removed"] == removed)), lambda x: F.struct(x["first"].alias("first"), x["last"].alias("last")))
    drop = F.transform(F.filter("found", lambda x: x["para"].isNotNull() & x["removed"]), lambda x: x["para"])
    per = per.where(F.exists("found", lambda x: x["removed"])).select("hit_id", "hit_hash", F.struct(drop.alias("lines"), spans(True).alias("gone"), spans(False).alias("kept")).alias("cut"))
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    joined = whole.join(per, F.col("row.doc_id").cast("long").eqNullSafe(F.col("hit_id")) & F.xxhash64(F.col("row.text").cast("string")).eqNullSafe(F.col("hit_hash")), "left")
    keep, hit = joined.where("cut is null").select("row.*"), joined.where("cut is not null")
    hit = hit.withColumn("text_", F.pandas_udf(_cut, "string")(F.col("row.text").cast("string"), "cut.lines", "cut.gone", "cut.kept"))
    return keep.unionAll(hit.select(*[F.col("text_").alias("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns]))
