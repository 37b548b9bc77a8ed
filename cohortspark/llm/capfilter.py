"""Near-duplicate vectors by locality-sensitive spherical-cap filters with structured random product codes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.llm import graph, scratch

#: Vectors of one filter that a task compares at a time with as many others.
CHUNK = 1000


def codes(dim: int, blocks: int, words: int, seed: int) -> list[np.ndarray]:
    """One code book of ``words`` random unit vectors for each of ``blocks`` runs of a randomly rotated space."""
    rng = np.random.default_rng(seed)
    parts = np.array_split(np.arange(dim), blocks)
    out = []
    for p in parts:
        c = rng.standard_normal((words, len(p)))
        out.append(c / np.linalg.norm(c, axis=1, keepdims=True) / np.sqrt(blocks))
    return out


def rotation(dim: int, seed: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def decode(x: np.ndarray, books: list[np.ndarray], bound: float) -> list[np.ndarray]:
    """For each unit vector, every product code word whose inner product with it exceeds ``bound``.

    List decoding block by block: a partial code word goes on only while its sum plus the best that the
    remaining blocks can add still exceeds the bound.
    """
    cut = np.concatenate([[0], np.cumsum([b.shape[1] for b in books])])
    scores = [x[:, cut[i] : cut[i + 1]] @ b.T for i, b in enumerate(books)]
    rest = np.zeros((len(books) + 1, len(x)))
    for i in range(len(books) - 1, -1, -1):
        rest[i] = rest[i + 1] + scores[i].max(axis=1)
    row, code, total = np.arange(len(x)), np.zeros(len(x), np.int64), np.zeros(len(x))
    for i, s in enumerate(scores):
        grown = total[:, None] + s[row]
        r, c = np.nonzero(grown + rest[i + 1][row][:, None] > bound)
        row, code, total = row[r], code[r] * s.shape[1] + c, grown[r, c]
    return np.split(code, np.searchsorted(row, np.arange(1, len(x))))


def _best(y: np.ndarray, books: list[np.ndarray]) -> np.ndarray:
    """The product code word nearest to each vector."""
    cut = np.concatenate([[0], np.cumsum([b.shape[1] for b in books])])
    code = np.zeros(len(y), np.int64)
    for i, b in enumerate(books):
        code = code * len(b) + np.argmax(y[:, cut[i] : cut[i + 1]] @ b.T, axis=1)
    return code


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(float)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def near_vectors(
    vectors: DataFrame,
    threshold: float = 0.93,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    label_col: str = "label",
    tables: int = 10,
    blocks: int = 2,
    words: int = 48,
    deviations: float = 3.0,
    seed: int = 7,
    owner: str = "",
) -> DataFrame:
    """(vec_id, n_links, component_id, kept): vectors of one label linked by cosine >= ``threshold`` in doubles.

    Equal embeddings of one label are one node with a count. A filter is a random direction made of one code word
    per block of a rotated space; ``tables`` independent code books are used. A vector joins every filter whose
    direction it exceeds by ``deviations`` standard deviations of a random inner product, found by list decoding,
    and in each table its best one. Two vectors at the threshold then share a filter with a probability above
    0.999 in 64 dimensions; every pair that shares one is verified exactly, and counts only in the first filter
    it shares. A filter of more than ``CHUNK`` vectors is compared in pairs of chunks, so no task holds a whole hot
    filter, and tasks return counts and stars, never pairs. Null, zero and non-finite vectors, or those with null
    components or a null label, link with nothing (n_links 0, own component). Vectors of different lengths never
    link. Rows with a null id link and count, and are returned with a null ``kept``. Extra columns are ignored.
    """
    kind = "float" if dict(vectors.dtypes)[vec_col] == "array<float>" else "double"
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast(f"array<{kind}>").alias("v"), F.col(label_col).alias("label"))
    bad = F.exists("v", lambda x: x.isNull()) | F.exists("v", lambda x: F.isnan(x) | (F.abs(x) == float("inf"))) | ~F.exists("v", lambda x: x != 0)
    fine = F.col("v").isNotNull() & F.col("label").isNotNull() & ~F.coalesce(bad, F.lit(True))
    name = F.concat(F.hex(F.xxhash64("label", "v")), F.lit(":"), F.hex(F.hash("v")))
    rows = scratch.written(rows.withColumn("node", F.when(F.coalesce(fine, F.lit(False)), name)), "vectors", owner)
    nodes = rows.where("node is not null").groupBy("node").agg(F.first("label").alias("label"), F.first("v").alias("v"), F.count("*").alias("n"))

    def filters(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made: dict[int, list] = {}
        for whole in batches:
            for at in range(0, len(whole), 1000):
                batch = whole.iloc[at : at + 1000]
                dims = batch["v"].map(len).to_numpy()
                for dim in map(int, np.unique(dims)):
                    part = batch[dims == dim]
                    if dim not in made:
                        made[dim] = [(rotation(dim, seed + 2 * t), codes(dim, max(1, min(blocks, dim)), words, seed + 2 * t + 1)) for t in range(tables)]
                    x = unit(np.stack(part["v"].to_numpy()))
                    found: list[list] = [[] for _ in range(len(x))]
                    for t, (turn, books) in enumerate(made[dim]):
                        y = x @ turn
                        size = t * words ** len(books)
                        best = _best(y, books)
                        for i, f in enumerate(decode(y, books, deviations / np.sqrt(dim))):
                            found[i].append(np.append(f, best[i]) + size)
                    yield pd.DataFrame({"node": part["node"].to_numpy(), "label": part["label"].to_numpy(), "n": part["n"].to_numpy(), "v": part["v"].to_numpy(), "filters": [np.unique(np.concatenate(f)).astype(np.int32) for f in found]})

    label = dict(rows.dtypes)["label"]
    placed = nodes.select("node", "label", "n", "v").mapInPandas(filters, f"node string, label {label}, n long, v array<{kind}>, filters array<int>")
    placed = scratch.written(placed.withColumn("dim", F.size("v")), "filters", owner)
    place = ["label", "dim", "filter"]
    sizes = placed.select("label", "dim", F.explode("filters").alias("filter")).groupBy(place).count().where("count > 1")
    sizes = sizes.select(*place, F.ceil(F.col("count") / CHUNK).cast("int").alias("chunks"))
    spread = placed.select("*", F.explode("filters").alias("filter")).join(sizes, place)
    spread = spread.withColumn("c", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    spread = spread.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    spread = spread.select(F.xxhash64("label", "dim").alias("place"), "filter", F.least("c", "k").alias("lo"), F.greatest("c", "k").alias("hi"), "c", "node", "n", "v", "filters")
    group = ["place", "filter", "lo", "hi"]
    met = spread.repartition(*group).sortWithinPartitions(*group, "node").mapInArrow(_meet(threshold), "node string, links long, root string")
    met = scratch.written(met, "met", owner)

    counts = met.groupBy("node").agg(F.sum("links").alias("links"))
    roots = scratch.written(graph.components(met, "node", "root", owner), "roots", owner)
    ids = rows.select("vec_id", "node")
    full = ids.where("node is not null").join(nodes.select("node", "n"), "node").join(counts, "node", "left").join(roots, "node", "left")
    full = full.select("vec_id", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root", "node").alias("root"))
    least = full.groupBy("root").agg(F.min("vec_id").alias("component_id"))
    linked = full.join(least, "root").select("vec_id", "n_links", "component_id")
    alone = ids.where("node is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.col("vec_id") == F.col("component_id"))


def _meet(threshold: float):
    """A task over rows sorted by group: compares each group, at most two chunks, and forgets it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        out: list[tuple] = []
        for batch in batches:
            held.append(pa.Table.from_batches([batch]))
            t = pa.concat_tables(held).combine_chunks()
            keys = np.stack([t.column(c).to_numpy().astype(np.int64) for c in ("place", "filter", "lo", "hi")])
            cut = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
            if len(cut):  # the last group may go on
                out += _groups(t.slice(0, cut[-1]), keys, np.append(0, cut), threshold)
                t = t.slice(cut[-1])
            held = [t]
            yield from _sent(out)
            out = []
        if held and held[0].num_rows:
            t = pa.concat_tables(held).combine_chunks()
            keys = np.stack([t.column(c).to_numpy().astype(np.int64) for c in ("place", "filter", "lo", "hi")])
            yield from _sent(_groups(t, keys, np.array([0, t.num_rows]), threshold))

    return run


def _sent(out: list[tuple]) -> Iterator[pa.RecordBatch]:
    if out:
        node, links, root = (np.concatenate([o[i] for o in out]) for i in range(3))
        yield pa.RecordBatch.from_arrays([pa.array(node, pa.string()), pa.array(links), pa.array(root, pa.string())], names=["node", "links", "root"])


def _groups(t: pa.Table, keys: np.ndarray, cut: np.ndarray, threshold: float) -> list[tuple]:
    n, weight, chunk = t.num_rows, t.column("n").to_numpy(), t.column("c").to_numpy()
    if not n:
        return []
    names = t.column("node").to_pandas().to_numpy()
    vec = t.column("v").combine_chunks()
    flat, at = vec.flatten().to_numpy(zero_copy_only=False), np.append(0, np.cumsum(vec.value_lengths().to_numpy(zero_copy_only=False)))
    lists = t.column("filters").combine_chunks()
    codes_, code_at = lists.flatten().to_numpy(zero_copy_only=False), np.append(0, np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False)))
    out = []
    for i, j in zip(cut[:-1], cut[1:]):
        if j - i < 2:
            continue
        x = unit(flat[at[i] : at[j]].reshape(j - i, -1))
        _, own, lo, hi = keys[:, i]
        found = compare(x, weight[i:j], chunk[i:j], codes_[code_at[i] : code_at[j]], np.diff(code_at[i : j + 1]), own, lo, hi, threshold)
        if found is not None:
            keep, links, root = found
            out.append((names[i:j][keep], links, names[i:j][root]))
    return out


def compare(x, weight, chunk, codes_, lengths, own, lo, hi, threshold):
    """(rows with links, their counts, their local root) of one group; rows are sorted by node."""
    left = np.flatnonzero(chunk == lo)
    right = left if lo == hi else np.flatnonzero(chunk == hi)
    links, parent, earlier = np.zeros(len(x), np.int64), np.arange(len(x)), None
    for i in range(0, len(left), 256):
        some = left[i : i + 256]
        hit = x[some] @ x[right].T >= threshold
        if lo == hi:
            hit &= right[None, :] > some[:, None]
        if not hit.any():
            continue
        if earlier is None:
            earlier = _earlier(codes_, lengths, own)
        hit &= earlier[some] @ earlier[right].T == 0
        links[some] += hit @ weight[right]
        links[right] += weight[some] @ hit
        for r in np.flatnonzero(hit.any(axis=1)):
            _union(parent, np.append(right[hit[r]], some[r]))
    keep = np.flatnonzero(links)
    return (keep, links[keep], _find(parent, keep)) if len(keep) else None


def _earlier(code: np.ndarray, lengths: np.ndarray, own: int) -> np.ndarray:
    """Row by row, which filters before ``own`` a vector is in, for those with two vectors here or more."""
    row = np.repeat(np.arange(len(lengths)), lengths)
    row, code = row[code < own], code[code < own]
    found, at, count = np.unique(code, return_inverse=True, return_counts=True)
    column = np.cumsum(count > 1) - 1
    many = count[at] > 1
    out = np.zeros((len(lengths), max(1, int((count > 1).sum()))), np.float32)
    out[row[many], column[at[many]]] = 1
    return out


def _find(parent: np.ndarray, at: np.ndarray) -> np.ndarray:
    root = parent[at]
    while (parent[root] != root).any():
        root = parent[root]
    parent[at] = root
    return root


def _union(parent: np.ndarray, at: np.ndarray) -> None:
    roots = _find(parent, at)
    parent[roots] = roots.min()
