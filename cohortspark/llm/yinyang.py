"""Clusters of vectors around centroids: exact integer k-means with Yinyang's bounds (Ding et al. 2015)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortspark.llm import scratch

DIMS, SCALE, K, ROUNDS = 64, 256, 40, 5
#: Centroids a group has on average; each group has one lower bound per vector.
PER_GROUP = 10
#: Largest size of a scaled component, so that squared distances stay exact in 64 bits.
MOST = 1 << 26
#: Distances between components of up to this size are exact integers in doubles as well.
_EXACT = 1 << 20
_STATE = "vec_id long, x array<long>, cluster int, distance long, upper double, lower array<double>"
_SUMS = pa.schema([("cluster", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))])


@dataclass(frozen=True)
class Move:
    """Centroids of a round, how far each moved since the last one (None: first round), and the group of each."""

    centroids: np.ndarray
    drift: np.ndarray | None
    group: np.ndarray


def scaled(vectors: DataFrame, dims: int = DIMS, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, x) of the vectors of ``dims`` components, all finite; x is floor(scale * component)."""
    e = F.col(vector_col).cast("array<double>")
    fine = (F.size(e) == dims) & F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return vectors.where(F.coalesce(fine, F.lit(False))).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(e, lambda v: F.floor(F.lit(float(scale)) * v)).alias("x"))


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of x to all rows of c, as integers."""
    if max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)) <= _EXACT:
        a, b = x.astype(float), c.astype(float)
        return ((a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)).astype(np.int64)
    out = np.empty((len(x), len(c)), np.int64)
    for j, row in enumerate(c):
        out[:, j] = ((x - row) ** 2).sum(axis=1)
    return out


def grouped(c: np.ndarray, per_group: int = PER_GROUP) -> np.ndarray:
    """The group of each centroid, by a few rounds of k-means over the centroids themselves; steers costs only."""
    many = max(1, len(c) // per_group)
    heads = c[:many].astype(float)
    for _ in range(5):
        group = ((c[:, None, :] - heads[None]) ** 2).sum(axis=2).argmin(axis=1)
        heads = np.array([c[group == g].mean(axis=0) if (group == g).any() else heads[g] for g in range(many)])
    return np.unique(group, return_inverse=True)[1]


def _least_others(d: np.ndarray, taken: np.ndarray, members: np.ndarray) -> np.ndarray:
    """Distance to the nearest of the ``members`` that the row has not taken."""
    root = np.sqrt(d.astype(float))
    root[taken[:, None] == members[None, :]] = np.inf
    return root.min(axis=1, initial=np.inf)


def first(x: np.ndarray, move: Move) -> tuple[np.ndarray, ...]:
    """(cluster, distance, upper, lower) by all distances; of equally near centroids the smaller number."""
    d = squared(x, move.centroids)
    cluster = d.argmin(axis=1)
    distance = d[np.arange(len(x)), cluster]
    groups = move.group.max(initial=-1) + 1
    members = [np.flatnonzero(move.group == g) for g in range(groups)]
    lower = np.stack([_least_others(d[:, m], cluster, m) for m in members], axis=1)
    return cluster, distance, np.sqrt(distance.astype(float)), lower


def again(x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, move: Move) -> tuple[np.ndarray, ...]:
    """The same after centroids moved, looking only at what the bounds leave open.

    A vector none of whose groups can hold a centroid as near as its own keeps it; then, with its own distance
    measured, the same is asked again, and only groups that may hold one as near are scanned. Bounds must be
    exceeded by more than rounding can account for, so ties are always scanned. Distances that were not measured
    are -1.
    """
    cluster, lower = cluster.copy(), lower - np.array([move.drift[move.group == g].max() for g in range(lower.shape[1])])
    upper = upper + move.drift[cluster]
    distance = np.full(len(x), -1, np.int64)

    def open_(rows: np.ndarray) -> np.ndarray:
        return lower[rows] <= (upper[rows] * (1 + 1e-9) + 1e-6)[:, None]

    at = np.flatnonzero(open_(np.arange(len(x))).any(axis=1))
    if len(at):
        own = move.centroids[cluster[at]]
        distance[at] = ((x[at] - own) ** 2).sum(axis=1)
        upper[at] = np.sqrt(distance[at].astype(float))
        scan = open_(at)
        at, scan = at[scan.any(axis=1)], scan[scan.any(axis=1)]
    if not len(at):
        return cluster, distance, upper, lower
    was, measured = cluster[at].copy(), upper[at].copy()
    best, seen = distance[at].copy(), []
    for g in range(lower.shape[1]):
        rows, members = np.flatnonzero(scan[:, g]), np.flatnonzero(move.group == g)
        if len(rows):
            d = squared(x[at[rows]], move.centroids[members])
            j = d.argmin(axis=1)
            near, number = d[np.arange(len(rows)), j], members[j]
            better = (near < best[rows]) | ((near == best[rows]) & (number < cluster[at[rows]]))
            best[rows[better]] = near[better]
            cluster[at[rows[better]]] = number[better]
            seen.append((g, rows, members, d))
    for g, rows, members, d in seen:
        lower[at[rows], g] = _least_others(d, cluster[at[rows]], members)
    left = np.flatnonzero(cluster[at] != was)  # the centroid that was left is now one of the others of its group
    home = move.group[was[left]]
    lower[at[left], home] = np.minimum(lower[at[left], home], measured[left])
    distance[at] = best
    upper[at] = np.sqrt(best.astype(float))
    return cluster, distance, upper, lower


def _matrix(column: pa.Array, dtype) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False).reshape(len(column), -1)


def _assign(move: Move, measure: bool):
    """A task: a state to the next one; ``measure`` fills in every distance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("x"), np.int64)
            if np.abs(x).max() > MOST:
                raise ValueError(f"scaled components beyond {MOST} have no exact 64-bit distances")
            if move.drift is None:
                cluster, distance, upper, lower = first(x, move)
            else:
                state = batch.column("cluster").to_numpy(), batch.column("upper").to_numpy(), _matrix(batch.column("lower"), float)
                cluster, distance, upper, lower = again(x, state[0].astype(np.int64), state[1], state[2], move)
            if measure:
                distance = ((x - move.centroids[cluster]) ** 2).sum(axis=1)
            lows = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * lower.shape[1], pa.int32()), pa.array(lower.ravel()))
            columns = [batch.column("vec_id"), batch.column("x"), pa.array(cluster, pa.int32()), pa.array(distance, pa.int64()), pa.array(upper), lows]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "x", "cluster", "distance", "upper", "lower"])

    return run


def _partial(k: int):
    """A task: its vectors to one row a cluster: how many, and the sum of each component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = np.zeros(k, np.int64), None
        for batch in batches:
            if batch.num_rows:
                x, cluster = _matrix(batch.column("x"), np.int64), batch.column("cluster").to_numpy()
                sums = np.zeros((k, x.shape[1]), np.int64) if sums is None else sums
                n += np.bincount(cluster, minlength=k)
                order = np.argsort(cluster, kind="stable")
                some, begin = np.unique(cluster[order], return_index=True)
                sums[some] += np.add.reduceat(x[order], begin, axis=0)
        at = np.flatnonzero(n)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(n[at]), pa.array(list(sums[at]), pa.list_(pa.int64()))], schema=_SUMS)

    return run


def centers(state: DataFrame, before: np.ndarray) -> np.ndarray:
    """floor(sum / count) of every component of every cluster; a cluster without vectors keeps its centroid.

    One row a cluster and component comes to the driver, from sums that each task made of its own vectors.
    """
    parts = state.select("cluster", "x").mapInArrow(_partial(len(before)), "cluster int, n long, sums array<long>")
    whole = parts.select("cluster", "n", F.posexplode("sums").alias("at", "v")).groupBy("cluster", "at").agg(F.sum("n").alias("n"), F.sum(F.col("v").cast("decimal(38,0)")).alias("v"))
    after = before.copy()
    for r in whole.collect():
        after[r["cluster"], r["at"]] = int(r["v"]) // int(r["n"])
    return after


def seeds(vectors: DataFrame, k: int, salt: str) -> np.ndarray:
    """The k vectors whose id comes first by the hash of ``salt:id``; equal ids by components, null ids last."""
    h = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.select("x", h.alias("h")).orderBy(F.col("h").asc_nulls_last(), "x").limit(k).collect()
    return np.array([r["x"] for r in rows], np.int64)


def cluster(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, salt: str = "2", id_col: str = "vec_id", vector_col: str = "embedding", owner: str = "") -> tuple[DataFrame, np.ndarray]:
    """(vec_id, x, cluster, distance) of every vector that takes part, and the final centroids.

    Vectors take part if they have exactly ``dims`` components, none null or non-finite; components become whole
    numbers. Centroids start as k vectors chosen by hash; each round assigns every vector to the nearest (ties: the
    smaller number) and moves centroids to the floor of their vectors' mean. Vectors carry one upper bound and a lower
    bound for each group of centroids from round to round in a stored table, so no round shuffles a vector; only sums
    by cluster travel. Repeated rows and null ids take part row by row; fewer than k vectors give fewer clusters; no
    vectors give no rows; columns other than the two named are ignored. Scaled components beyond 2^26 are an error.
    """
    taken = scratch.written(scaled(vectors, dims, scale, id_col, vector_col), "vectors", owner)
    c = seeds(taken, k, salt)
    if not len(c):
        return taken.select("vec_id", "x", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), c
    group, state = grouped(c), taken
    drift = None
    for i in range(rounds + 1):
        then = scratch.written(state.mapInArrow(_assign(Move(c, drift, group), i == rounds), _STATE), f"state{i}", owner)
        scratch.forget(state)
        state = then
        if i < rounds:
            after = centers(state, c)
            drift = np.sqrt(((after - c) ** 2).sum(axis=1).astype(float))
            c = after
    return state.select("vec_id", "x", "cluster", "distance"), c


def clusters(vectors: DataFrame, **options) -> DataFrame:
    """Every vector's cluster, squared distance, sums of these over its cluster and all, and a digest of its centroid."""
    rows, c = cluster(vectors, **options)
    total = {r["cluster"]: int(r["d"]) for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()} if len(c) else {}
    known = [(i, total[i], hashlib.sha256(",".join(map(str, row.tolist())).encode()).hexdigest()) for i, row in enumerate(c) if i in total]
    fields = T.StructType([T.StructField("number", T.IntegerType()), T.StructField("cluster_inertia", T.LongType()), T.StructField("centroid_sha256", T.StringType())])
    table = F.broadcast(rows.sparkSession.createDataFrame(known, fields))  # at most k rows
    every: Column = F.lit(sum(total.values())).cast("long")
    return rows.join(table, rows["cluster"] == table["number"]).select("vec_id", "cluster", "distance", "cluster_inertia", every.alias("inertia"), "centroid_sha256")


def _oracle(rounds: int = ROUNDS) -> str:
    """The same by all distances in SQL, round by round."""
    near = "SELECT rid, first(c ORDER BY d, c) AS c, min(d) AS d FROM (SELECT v.rid, k.c, list_inner_product(v.x, v.x) - 2 * list_inner_product(v.x, k.x) + list_inner_product(k.x, k.x) AS d FROM v, {k} k) GROUP BY rid"
    parts = [
        "v AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: floor(256 * x)) AS x FROM embeddings"
        " WHERE len(embedding) = 64 AND len(list_filter(CAST(embedding AS DOUBLE[]), lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"k0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id), x) - 1 AS c, x FROM v ORDER BY 1 LIMIT {K})",
    ]
    for i in range(rounds):
        parts.append(f"a{i} AS MATERIALIZED ({near.format(k=f'k{i}')})")
        parts.append(f"s{i} AS MATERIALIZED (SELECT c, list(m ORDER BY pos) AS x FROM (SELECT c, pos, floor(sum(e) / count(*)) AS m FROM (SELECT a.c, unnest(v.x) AS e, unnest(range(64)) AS pos FROM a{i} a JOIN v ON v.rid = a.rid) GROUP BY c, pos) GROUP BY c)")
        parts.append(f"k{i + 1} AS MATERIALIZED (SELECT k.c, coalesce(s.x, k.x) AS x FROM k{i} k LEFT JOIN s{i} s ON s.c = k.c)")
    parts.append(f"z AS MATERIALIZED ({near.format(k=f'k{rounds}')})")
    return (
        "WITH " + ",\n".join(parts) + "\nSELECT v.vec_id, CAST(z.c AS INTEGER) AS cluster, CAST(z.d AS BIGINT) AS distance, CAST(sum(z.d) OVER (PARTITION BY z.c) AS BIGINT) AS cluster_inertia, CAST(sum(z.d) OVER () AS BIGINT) AS inertia,"
        f" sha256(array_to_string(list_transform(k.x, lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ',')) AS centroid_sha256 FROM z JOIN v ON v.rid = z.rid JOIN k{rounds} k ON k.c = z.c"
    )


ORACLE = _oracle()
