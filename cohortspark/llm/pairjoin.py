"""Components of nodes that share keys and pass a check, without expanding groups into pairs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.llm import blocks, graph, scratch
from cohortspark.llm import textops as T

#: Bits of a sketch for each difference that two sets within the threshold may have, at least; sketches of unlike sets
#: differ in almost half of them, so this many rule them out.
BITS = 8
CHUNK = 1000
#: Smallest keys of a node that its rows carry, so that a pair with many common keys seldom comes out more than once.
HELD = 16


def gap(total, num: int, den: int):
    """Largest symmetric difference of two sets whose sizes add up to ``total`` with Jaccard >= num/den."""
    return total * (den - num) // (den + num)


def sketch(elements: np.ndarray, num: int, den: int) -> bytes:
    """Parities of the elements in hashed cells.

    The sketches of two sets differ in at most as many cells as the sets in elements, whatever falls together.
    """
    bits = 1 << max(6, int(BITS * max(1, gap(2 * len(elements), num, den)) - 1).bit_length())
    cell = (T.mix(elements ^ T.U(0x5BD1E995)) & T.U(bits - 1)).astype(np.int64)
    return np.packbits(np.bincount(cell, minlength=bits) & 1, bitorder="little").tobytes()


def _words(sketches: list[bytes], size: int) -> np.ndarray:
    """Sketches as rows of 64-bit words, folded to ``size`` words."""
    out = np.empty((len(sketches), size), np.uint64)
    for i, s in enumerate(sketches):
        w = np.frombuffer(s, np.uint64)
        while len(w) > size:
            w = w[: len(w) // 2] ^ w[len(w) // 2 :]
        out[i] = w
    return out


def may_link(a: list[bytes], na: np.ndarray, b: list[bytes], nb: np.ndarray, num: int, den: int) -> np.ndarray:
    """Which of the pairs a[i], b[i] the sketches and sizes do not rule out."""
    keep = np.minimum(na, nb) * den >= np.maximum(na, nb) * num
    for i in np.flatnonzero(keep):
        size = min(len(a[i]), len(b[i])) // 8
        x = _words([a[i], b[i]], size)
        keep[i] = np.bitwise_count(x[0] ^ x[1]).sum() <= gap(int(na[i] + nb[i]), num, den)
    return keep


def _pruned(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = may_link(batch.column("sa").to_pylist(), batch.column("na").to_numpy(), batch.column("sb").to_pylist(), batch.column("nb").to_numpy(), num, den)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _across(num: int, den: int, nearest: bool):
    """A task over blocks of nodes that share a key: pairs of different components that nothing rules out.

    With ``nearest`` only the pair of each node whose sketches differ least. A pair is passed over where ``held``, the
    HELD smallest keys of each node, show a smaller key that both have: it comes out under that one.
    """

    def lesser(t: pa.Table, at: int, key: int, known: dict[int, set[int]]) -> set[int]:
        if at not in known:
            own = t.column("held")[at].values.to_numpy()
            known[at] = set(own[own < key].tolist())
        return known[at]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, keys, cut in blocks.runs(batches, ["key", "lo", "hi"]):
            node, root, n, chunk = (t.column(c).to_numpy() for c in ("node", "root", "n", "c"))
            marks = t.column("sketch").to_pylist()
            for i, j in zip(cut[:-1], cut[1:]):
                key, lo, hi = keys[:, i]
                known: dict[int, set[int]] = {}
                length = np.array([len(m) // 8 for m in marks[i:j]])
                ids, r, size, own = node[i:j], root[i:j], n[i:j], chunk[i:j]
                for small in np.unique(length):
                    # sets within the threshold have sketches of one length or of the next
                    at = np.flatnonzero((length == small) | (length == 2 * small))
                    x = _words([marks[i + k] for k in at], int(small))
                    for s in range(0, len(at), 128):
                        row = at[s : s + 128]
                        differ = np.zeros((len(row), len(at)), np.int64)
                        for w in range(int(small)):
                            differ += np.bitwise_count(x[s : s + 128, w][:, None] ^ x[:, w][None, :])
                        ok = differ <= gap(size[row][:, None] + size[at][None, :], num, den)
                        ok &= (length[row] == small)[:, None] & (r[row][:, None] != r[at][None, :])
                        ok &= np.minimum(size[row][:, None], size[at][None, :]) * den >= np.maximum(size[row][:, None], size[at][None, :]) * num
                        if lo != hi:
                            ok &= own[row][:, None] != own[at][None, :]
                        if nearest:
                            p = np.flatnonzero(ok.any(axis=1))
                            q = np.where(ok, differ, 1 << 40)[p].argmin(axis=1)
                        else:
                            p, q = np.nonzero(ok)
                        p, q = row[p], at[q]
                        if not nearest:  # both ways round are looked at where sketches are of one length
                            one = (length[q] != small) | (ids[p] > ids[q])
                            p, q = p[one], q[one]
                        once = [lesser(t, i + a, key, known).isdisjoint(lesser(t, i + b, key, known)) for a, b in zip(p, q)]
                        p, q = p[once], q[once]
                        if len(p):
                            u, v = ids[p], ids[q]
                            yield pa.RecordBatch.from_arrays([pa.array(np.maximum(u, v)), pa.array(np.minimum(u, v))], names=["a", "b"])

    return run


def shared_keys(keys: DataFrame, owner: str = "") -> DataFrame:
    """(key, node, center) of the keys that several nodes have; center is the smallest of them.

    The ends of a key are aggregated before the shuffle, so no task holds a hot key; the join back can be split.
    """
    ends = keys.groupBy("key").agg(F.min("node").alias("center"), F.max("node").alias("far"))
    ends = scratch.written(ends.where("center <> far").select("key", "center"), "ends", owner)
    out = scratch.written(keys.join(ends, "key").select("key", "node", "center"), "shared", owner)
    scratch.forget(ends)
    return out


def _verify(num: int, den: int):
    """A task: (a, elements_a, b, elements_b) to the (a, b) whose sets reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("elements_a"), batch.column("elements_b")):
                x, y = (np.frombuffer(e.as_buffer(), T.U) for e in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(bool(both) and den * both >= num * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def checked(sets: DataFrame, num: int, den: int) -> Callable[[DataFrame], DataFrame]:
    """A check of pairs (a, b) by exact Jaccard of ``sets`` (node, elements: the bytes of distinct 64-bit hashes)."""

    def check(pairs: DataFrame) -> DataFrame:
        one = pairs.join(sets.withColumnsRenamed({"node": "a", "elements": "elements_a"}), "a")
        both = one.join(sets.withColumnsRenamed({"node": "b", "elements": "elements_b"}), "b")
        return both.select("a", "elements_a", "b", "elements_b").mapInArrow(_verify(num, den), "a long, b long")

    return check


def classes(shared: DataFrame, marks: DataFrame, check: Callable[[DataFrame], DataFrame], num: int, den: int, owner: str = "") -> DataFrame:
    """(node, root) of all nodes that links join: pairs of a common key with Jaccard >= num/den.

    ``marks`` has (node, n, sketch); ``check`` keeps the pairs (a, b) that are links. First every node of a key is
    checked against the key's center. Where that leaves the nodes of a key in several components, blocks of them are
    compared across components by sketch: first each node's nearest pair is checked, which joins what a large group
    of near copies was split into; then all pairs across the components still left that no sketch rules out. Sketches
    rule out no link, so any two linked nodes of a key end in one component.
    """
    pairs = shared.where("node <> center").select(F.col("node").alias("a"), F.col("center").alias("b")).distinct()
    both = pairs.join(marks.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa")), "a")
    both = both.join(marks.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb")), "b")
    tested = scratch.written(both.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(_pruned(num, den), "a long, b long"), "pairs", owner)
    links = scratch.written(check(tested), "links", owner)
    roots = scratch.written(graph.components(links, owner=owner), "roots", owner)

    for nearest in (True, False):
        r = roots.withColumnRenamed("node", "member")
        named = shared.select("key", "node").distinct().join(r, F.col("node") == F.col("member"), "left").select("key", "node", F.coalesce("root", "node").alias("root"))
        named = scratch.written(named, "named", owner)
        several = named.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("key")
        mixed = scratch.written(named.join(several, "key", "left_semi"), "mixed", owner)
        scratch.forget(named)
        held = scratch.written(mixed.groupBy("node").agg(F.slice(F.sort_array(F.collect_list("key")), 1, HELD).alias("held")), "held", owner)  # the keys of one set
        spread = blocks.dealt(mixed.join(marks, "node").join(held, "node"), ["key"], "node", CHUNK)
        more = spread.select("key", "lo", "hi", "c", "node", "root", "n", "sketch", "held").mapInArrow(_across(num, den, nearest), "a long, b long").distinct()
        more = scratch.written(more.join(tested, ["a", "b"], "left_anti"), "more", owner)
        again = scratch.written(check(more), "links", owner)
        tested, links = tested.union(more), links.union(again)
        scratch.forget(mixed, held)
        if again.limit(1).count():
            roots = scratch.written(graph.components(links, owner=owner), "roots", owner)
    return roots
