import hashlib

import numpy as np
import pytest

from cohortspark.llm import yinyang

ROWS = "vec_id long, embedding array<double>, cluster string, x int, distance string, label int"


def plain(ids, x, k, rounds):
    """Clusters by all distances with Python's whole numbers."""
    order = sorted(range(len(x)), key=lambda i: (ids[i] is None, hashlib.sha256(f"2:{ids[i]}".encode()).hexdigest(), x[i]))[:k]
    c = [list(x[i]) for i in order]
    dist = lambda a, b: sum((p - q) ** 2 for p, q in zip(a, b))
    near = lambda: [min((dist(v, m), j) for j, m in enumerate(c)) for v in x]
    for _ in range(rounds):
        a = near()
        for j in range(len(c)):
            own = [v for v, (_, i) in zip(x, a) if i == j]
            if own:
                c[j] = [sum(col) // len(own) for col in zip(*own)]
    return [(j, d) for d, j in near()], c


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("spread", [1, 3, 300])
def test_bounds_never_change_a_cluster(seed, spread):
    rng = np.random.default_rng(seed)
    x = rng.integers(-spread, spread + 1, (600, 6))  # small spreads are full of ties
    c = x[rng.choice(600, 25, replace=False)].copy()
    group = yinyang.grouped(c, 5)
    cluster, distance, upper, lower = yinyang.first(x, yinyang.Move(c, None, group))
    for _ in range(6):
        after = c.copy()
        for j in range(len(c)):
            if (cluster == j).any():
                after[j] = x[cluster == j].sum(axis=0) // (cluster == j).sum()
        drift = np.sqrt(((after - c) ** 2).sum(axis=1).astype(float))
        c = after
        cluster, distance, upper, lower = yinyang.again(x, cluster, upper, lower, yinyang.Move(c, drift, group))
        d = yinyang.squared(x, c)
        assert (cluster == d.argmin(axis=1)).all()
        own = d[np.arange(len(x)), cluster]
        assert ((distance == -1) | (distance == own)).all() and (upper >= np.sqrt(own) - 1e-6).all()
        for g in range(lower.shape[1]):
            others = np.where((group == g)[None, :] & (np.arange(len(c))[None, :] != cluster[:, None]), np.sqrt(d.astype(float)), np.inf).min(axis=1)
            assert (lower[:, g] <= others + 1e-6).all()


def test_bounds_save_distances():
    rng = np.random.default_rng(9)
    heads = rng.integers(-3000, 3000, (40, 16))
    x = heads[rng.integers(0, 40, 4000)] + rng.integers(-20, 20, (4000, 16))
    group = yinyang.grouped(heads)
    state = yinyang.first(x, yinyang.Move(heads, None, group))
    moved = heads + rng.integers(-3, 3, heads.shape)
    drift = np.sqrt(((moved - heads) ** 2).sum(axis=1).astype(float))
    _, distance, _, _ = yinyang.again(x, state[0], state[2], state[3], yinyang.Move(moved, drift, group))
    assert (distance == -1).mean() > 0.99


def test_squared_is_exact_for_large_components():
    x = np.array([[yinyang.MOST, -yinyang.MOST, 7]])
    assert yinyang.squared(x, -x)[0, 0] == 4 * yinyang.MOST**2 * 2 + 196


def test_clusters_by_definition_with_odd_rows(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(v) for v in rng.normal(0, 0.2, 5)], "c", 1, "d", i % 3) for i in range(120)]
    rows += [rows[3], rows[3], (7, [0.5] * 5, None, None, None, None), (None, [0.25] * 5, "c", 1, "d", 0), (None, [0.25] * 5, "c", 1, "d", 0)]
    odd = [(900, None), (901, []), (902, [0.1] * 4), (903, [0.1] * 6), (904, [0.1, None, 0.1, 0.1, 0.1]), (905, [float("nan")] + [0.1] * 4), (906, [float("inf")] + [0.1] * 4)]
    df = spark.createDataFrame(rows + [(i, e, None, None, None, None) for i, e in odd], ROWS)
    ids, x = [r[0] for r in rows], [[int(np.floor(256 * v)) for v in r[1]] for r in rows]
    want, c = plain(ids, x, 12, 5)
    got, centroids = yinyang.cluster(df, k=12, dims=5)
    assert sorted(((r.vec_id, list(r.x), r.cluster, r.distance) for r in got.collect()), key=str) == sorted(((i, v, j, d) for i, v, (j, d) in zip(ids, x, want)), key=str)
    assert centroids.tolist() == c
    sums = {j: sum(d for i, d in want if i == j) for j, _ in want}
    for r in yinyang.clusters(df, k=12, dims=5).collect():
        assert (r.cluster_inertia, r.inertia) == (sums[r.cluster], sum(sums.values()))
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, c[r.cluster])).encode()).hexdigest()


def test_few_or_no_vectors(spark):
    few = spark.createDataFrame([(1, [0.5] * 64, "c", 1, "d", 0), (2, [0.25] * 64, "c", 1, "d", 0)], ROWS)
    assert sorted((r.vec_id, r.distance, r.inertia) for r in yinyang.clusters(few).collect()) == [(1, 0, 0), (2, 0, 0)]
    none = yinyang.clusters(few.where("false"))
    assert none.count() == 0 and none.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_components_too_large_are_an_error(spark):
    with pytest.raises(Exception, match="64-bit"):
        yinyang.clusters(spark.createDataFrame([(1, [1e9] * 64, "c", 1, "d", 0)], ROWS)).collect()
