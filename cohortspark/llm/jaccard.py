"""Exact n-gram Jaccard join: universe partitions, pigeonhole and one-deletion neighbourhoods."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.llm import pairjoin, scratch
from cohortspark.llm import textops as T

#: Assumed chance that one shingle of a random other text falls together; only steers costs, never results.
SHARE = 0.05
RESEEDS = 8
#: Smallest hashes of a set that show whether it can have a link, and the chance that they hide one.
LEAST, MISS = 24, 1e-11
_SETS = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n_shingles", pa.int64()), ("node", pa.int64()), ("least", pa.list_(pa.int64()))])


def allocate(high: int, members: float, num: int, den: int) -> tuple[int, int]:
    """(segments, of them with one-deletion neighbourhoods) for sets of up to ``high`` shingles.

    A mismatch in a plain segment takes one difference, in a one-deletion segment two. The cheapest split by
    emitted rows plus expected chance meetings in a band of ``members`` sets is taken.
    """
    need = pairjoin.gap(2 * high, num, den) + 1
    best = (float("inf"), need, 0)
    for ones in range(0, min(need // 2, 64) + 1):
        used = need - ones
        segments = used + max(1, used // 16) if used > 1 else 1
        fill = 0.75 * high / segments
        rows = (used - ones) + ones * (1 + fill)
        met = members * ((used - ones) * SHARE**fill + ones * fill * SHARE ** max(fill - 1, 1))
        best = min(best, (rows + met, segments, ones))
    return best[1], best[2]


@lru_cache(maxsize=4096)
def _plan(band: int, members: tuple, num: int, den: int) -> tuple[int, int, int]:
    high = 2 ** (band + 1) - 1
    return (high, *allocate(high, dict(members).get(band, 0), num, den))


def _keys(elements: np.ndarray, members: tuple, num: int, den: int) -> np.ndarray:
    """Signature keys of one set: two sets with Jaccard >= num/den share one."""
    n = len(elements)
    out: list[np.ndarray] = []
    own = n.bit_length() - 1
    for band in (own, own + 1):
        high, segments, ones = _plan(band, members, num, den)
        partner = min(high, n * den // num)
        if band > own and partner < 2**band:
            continue
        need = pairjoin.gap(n + partner, num, den) + 1
        for seed in range(RESEEDS + 1):
            e = T.mix(elements ^ T.seeds(1, 977 * seed + 13)[0])
            seg = (e >> T.U(33)).astype(np.int64) % segments
            value = T.mix(e + T.U(1))
            size = np.bincount(seg, minlength=segments)
            total = np.zeros(segments, T.U)
            np.add.at(total, seg, value)
            weight = np.where(size == 0, 0, np.where((np.arange(segments) < ones) & (size > 1), 2, 1))
            reached = np.cumsum(weight)
            enough = reached[-1] >= need
            used = int(np.searchsorted(reached, need)) + 1 if enough else segments
            label = T.mix(np.arange(used, dtype=T.U) + T.U((band << 40) + (seed << 34)))
            take = size[:used] > 0 if enough or seed < RESEEDS else np.ones(used, bool)
            out.append(T.mix(total[:used][take] ^ label[take]))
            near = (seg < min(ones, used)) & (size[seg] > 1)  # a lone shingle's neighbour would be the empty segment, met by strangers
            if near.any():
                out.append(T.mix((total[seg[near]] - value[near]) ^ label[seg[near]]))
            if enough:
                break
    return np.unique(np.concatenate(out))


def _sets(k: int, least: int):
    """A task: text rows to (doc_id, text_hash, n_shingles, node, least hashes); those once per set and task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            ids, hashes = batch.column("doc_id"), batch.column("text_hash")
            for at, raw, off in T.pieces(batch.column("text")):
                n = len(off) - 1
                h, first, node = _named(raw, off, k)
                count = np.diff(first)
                low: list = [None] * n
                for i in range(n):
                    if count[i] and int(node[i]) not in seen:
                        if len(seen) >= 500_000:
                            seen.clear()
                        seen.add(int(node[i]))
                        low[i] = np.sort(T.mix(h[first[i] : first[i + 1]]))[:least].view(np.int64)
                yield pa.RecordBatch.from_arrays([ids.slice(at, n), hashes.slice(at, n), pa.array(count, pa.int64()), pa.array(node), pa.array(low, pa.list_(pa.int64()))], schema=_SETS)

    return run


def _named(raw: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, their offsets, and one hash of each whole set."""
    h, first = T.distinct(*T.shingles(T.words(raw, off), k), len(off) - 1)
    return h, first, T.mix(T.sums(T.mix(h), first) + np.diff(first).astype(T.U)).view(np.int64)


def _signatures(k: int, num: int, den: int, members: tuple):
    """A task: texts to (node, n, keys, sketch, elements)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, raw, off in T.pieces(batch.column("text")):
                h, first, node = _named(raw, off, k)
                sets = [h[i:j] for i, j in zip(first[:-1], first[1:])]
                columns = [pa.array(node), pa.array(np.diff(first), pa.int64())]
                columns.append(pa.array([_keys(e, members, num, den).view(np.int64) if len(e) else None for e in sets], pa.list_(pa.int64())))
                columns.append(pa.array([pairjoin.sketch(e, num, den) for e in sets], pa.binary()))
                columns.append(pa.array([e.tobytes() for e in sets], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=["node", "n", "keys", "sketch", "elements"])

    return run


def meetings(num: int, den: int, least: int = LEAST, miss: float = MISS) -> int:
    """How many of the ``least`` smallest hashes of a set any set with Jaccard >= num/den has among its own.

    Of the smallest of both sets together a share of Jaccard lies in both, and these are among the smallest of each;
    fewer than the number returned are with a probability of at most ``miss``.
    """
    j, below, t = num / den, 0.0, 0
    while t < least and (below := below + comb(least, t) * j**t * (1 - j) ** (least - t)) <= miss:
        t += 1
    return t


def jaccard_classes(docs: DataFrame, k: int = 3, num: int = 9, den: int = 10, id_col: str = "doc_id", text_col: str = "text", owner: str = "", miss: float = MISS) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row: classes of texts linked by Jaccard >= num/den of k-word shingles.

    Words are runs without white space, A-Z lower-cased; a text of fewer than ``k`` words is one shingle, and one
    without words or null has an empty set and links with nothing. Shingles are 64-bit hashes. Equal sets are one
    node. Sets of which hardly any of the ``LEAST`` smallest hashes are met elsewhere are left out first (see
    ``meetings``), so most texts that are like no other never cost more than that; ``miss``, the chance that this hides
    a link, may be 0, and then no set is left out. Hashed shingles of the rest fall
    into segments by size band; sets within the threshold differ in fewer shingles than the segments can absorb, so
    they share a segment's signature (or, in one-deletion segments, one less a shingle). Per signature all nodes are
    first compared with the smallest one; where that leaves a signature's nodes in several components, the pairs
    across components are compared too. So no link between components is lost and no group is expanded into pairs.
    Duplicate ids take part row by row; rows with a null id link others and get the smallest id of their component,
    null if it has none. Extra columns are ignored. An empty table gives no rows.
    """
    placed = jaccard_members(docs, k, num, den, id_col, text_col, owner, miss)
    least = placed.where("n_shingles > 0").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    least = scratch.written(least, "least", owner)  # so that Spark sees two shuffles and can split a hot class
    full = placed.where("n_shingles > 0").join(least, "root").select("doc_id", "n_shingles", "component_id")
    return full.union(placed.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def jaccard_members(docs: DataFrame, k: int = 3, num: int = 9, den: int = 10, id_col: str = "doc_id", text_col: str = "text", owner: str = "", miss: float = MISS) -> DataFrame:
    """(doc_id, text_hash, n_shingles, root) of every row: ``root`` is one in each class of ``jaccard_classes``.

    Rows of one text are in one class, so id and text hash (xxhash64) name a row where ids repeat with other texts.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("text_hash", F.xxhash64("text"))
    table = scratch.written(docs.mapInArrow(_sets(k, LEAST), "doc_id long, text_hash long, n_shingles long, node long, least array<long>"), "sets", owner)
    near = _candidates(table.where("least is not null"), num, den, owner, miss)
    sizes = near.groupBy(F.floor(F.log2("n")).cast("int").alias("band")).count()
    members = tuple(sorted((r["band"], float(r["count"])) for r in sizes.collect()))  # at most 32 rows

    holders = table.where("least is not null").join(near.select("node"), "node", "left_semi").groupBy("node").agg(F.min(F.struct("doc_id", "text_hash")).alias("at"))
    holders = scratch.written(holders.select(F.col("at.doc_id").alias("hit_id"), F.col("at.text_hash").alias("hit_hash")).distinct(), "holders", owner)
    # one way of joining at every size: ids and texts are dealt out by id and text
    found = docs.join(holders.hint("merge"), F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("text_hash") == F.col("hit_hash"))).select("text")
    marks = found.mapInArrow(_signatures(k, num, den, members), "node long, n long, keys array<long>, sketch binary, elements binary")
    marks = scratch.written(marks.dropDuplicates(["node"]), "marks", owner)
    scratch.forget(holders)

    shared = pairjoin.shared_keys(marks.select("node", F.explode("keys").alias("key")), owner)
    roots = pairjoin.classes(shared, marks.select("node", "n", "sketch"), pairjoin.checked(marks.select("node", "elements"), num, den), num, den, owner)
    scratch.forget(near, marks, shared)
    rows = table.select("doc_id", "text_hash", "n_shingles", "node")
    return rows.join(roots, "node", "left").select("doc_id", "text_hash", "n_shingles", F.coalesce("root", "node").alias("root"))


def _candidates(sets: DataFrame, num: int, den: int, owner: str, miss: float) -> DataFrame:
    """(node, n) of the sets that may have a link, by how many of their smallest hashes other sets have too."""
    if not (some := meetings(num, den, miss=miss)):  # at low thresholds they tell nothing
        return scratch.written(sets.select("node", F.col("n_shingles").alias("n")).distinct(), "near", owner)
    keys = sets.select("node", F.col("n_shingles").alias("n"), F.explode("least").alias("key"))
    ends = keys.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low <> high").select("key")
    ends = scratch.written(ends, "met", owner)
    need = F.least(F.lit(some), F.ceil(F.col("n") * num / den))
    met = keys.join(ends, "key", "left_semi").groupBy("node", "n").count().where(F.col("count") >= need)
    out = scratch.written(met.select("node", "n"), "near", owner)
    scratch.forget(ends)
    return out
