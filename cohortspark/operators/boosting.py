"""Gradient boosted trees with folds by group: every row is predicted by a model that has not seen its group."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool
from uuid import uuid4

from pyspark import inheritable_thread_target
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from cohortspark.operators.rounds import folder

#: Groups that one task orders when folds are dealt; more groups are dealt in as many parts as are needed.
GROUPS_A_PART = 100_000


@dataclass(frozen=True)
class Trees:
    """How trees are grown."""

    rounds: int = 50
    depth: int = 5
    rate: float = 0.1
    bins: int = 64
    least_rows: int = 5
    seed: int = 0


@dataclass(frozen=True)
class Boosted:
    """Trees over ``features``; a missing value is its feature's mean of the rows fitted on, beside a mark that it was missing.

    Only ``marked`` features have a mark, those with a missing value in the rows fitted on (None: all): no tree splits on
    a mark that is never set, but each would count it in every pass. ``dropped`` are features without any value in those rows. With ``base`` the trees say what is added to that column.
    """

    features: tuple[str, ...]
    dropped: tuple[str, ...]
    fills: tuple[float, ...]
    base: str | None
    trees: GBTRegressionModel
    marked: tuple[str, ...] | None = None

    def predict(self, rows: DataFrame, name: str = "pred") -> DataFrame:
        """``rows`` with the prediction: null where the base is null."""
        out = self.trees.transform(_assembled(rows, self.features, self.fills, self.marked))
        p = F.col("_told") + F.col(self.base).cast("double") if self.base else F.col("_told")
        return out.select(*[c for c in rows.columns if c != name], p.alias(name))


def _value(name: str) -> Column:
    """A feature as a double, null for what is not a number."""
    x = F.col(name).cast("double")
    return F.when(~F.isnan(x), x)


def _assembled(rows: DataFrame, features: Sequence[str], fills: Sequence[float], marked: Sequence[str] | None = None) -> DataFrame:
    parts = []
    for i, (n, v) in enumerate(zip(features, fills)):
        parts.append(F.coalesce(_value(n), F.lit(v)).alias(f"_v{i}"))
        if marked is None or n in marked:
            parts.append(_value(n).isNull().cast("double").alias(f"_m{i}"))
    made = rows.select("*", *parts)
    names = made.columns[len(rows.columns) :]
    return VectorAssembler(inputCols=names, outputCol="_x").transform(made).drop(*names)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the folder of ``spark.checkpoint.dir``: what it is made of is worked out once."""
    path = f"{folder(df.sparkSession)}/{name}-{uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def folds(rows: DataFrame, group: str, n: int = 5) -> DataFrame:
    """(group, fold) of every group, null included: folds 0 to n - 1 of near-equal rows, no group in two.

    Groups are dealt to and fro from the largest to the smallest, of equally large ones by their value. With fewer
    groups than ``n`` every group is a fold. The rows are read once, for the groups' sizes, which are stored.
    """
    sizes = stored(rows.groupBy(group).count(), "sizes")
    many = sizes.count()
    n, parts = max(1, min(n, many)), 1 + many // GROUPS_A_PART
    part = F.pmod(F.xxhash64(group), F.lit(parts))
    place = F.row_number().over(Window.partitionBy(part).orderBy(F.desc("count"), group)) - 1
    turn = F.when(F.floor(place / n) % 2 == 1, n - 1 - place % n).otherwise(place % n)
    return sizes.select(group, F.pmod(turn + part, F.lit(n)).cast("int").alias("fold"))


def _seen(rows: DataFrame, features: Sequence[str], by: str) -> dict[int, list[tuple[int, float]]]:
    """Count and sum of every feature's values by fold, then the count of rows: one row a fold."""
    got = rows.groupBy(by).agg(F.count("*").alias("n"), *[c for i, n in enumerate(features) for c in (F.count(_value(n)).alias(f"n{i}"), F.sum(_value(n)).alias(f"s{i}"))]).collect()
    return {r[by]: [*[(r[f"n{i}"], r[f"s{i}"] or 0.0) for i in range(len(features))], (r["n"], 0.0)] for r in got}


def _fit(rows: DataFrame, seen: list[tuple[int, float]], features: Sequence[str], target: str, base: str | None, how: Trees) -> Boosted:
    *seen, (many, _) = seen
    use = [i for i, (n, _) in enumerate(seen) if n]
    if not use:
        raise ValueError("no feature has a value")
    names, fills = [features[i] for i in use], [seen[i][1] / seen[i][0] for i in use]
    y = F.col(target).cast("double") - F.col(base).cast("double") if base else F.col(target).cast("double")
    marked = tuple(features[i] for i in use if seen[i][0] < many)
    data = _assembled(rows.withColumn("_y", y), names, fills, marked).select("_x", "_y")
    trees = GBTRegressor(featuresCol="_x", labelCol="_y", predictionCol="_told", maxIter=how.rounds, maxDepth=how.depth, stepSize=how.rate, maxBins=how.bins, minInstancesPerNode=how.least_rows, seed=how.seed)
    return Boosted(tuple(names), tuple(f for i, f in enumerate(features) if i not in use), tuple(fills), base, trees.fit(data), marked)


def _known(rows: DataFrame, target: str, base: str | None) -> DataFrame:
    return rows.where(_value(target).isNotNull() & (_value(base).isNotNull() if base else F.lit(True)))


def fit(rows: DataFrame, features: Sequence[str], target: str, base: str | None = None, how: Trees = Trees()) -> Boosted:
    """A model of all rows with a target and a base; none of them, or none with a feature, is an error.

    The rows should be a stored table: trees are grown in many passes.
    """
    known = _known(rows, target, base).select(*dict.fromkeys([*features, target, *([base] if base else [])])).withColumn("_f", F.lit(0))
    seen = _seen(known, features, "_f")
    if not seen:
        raise ValueError("no rows to fit on")
    return _fit(known, seen[0], features, target, base, how)


def cross_fit(rows: DataFrame, features: Sequence[str], target: str, group: str, base: str | None = None, n: int = 5, how: Trees = Trees(), at_once: int = 2) -> tuple[DataFrame, list[Boosted]]:
    """Every row of ``rows`` with ``fold`` and ``pred``, told by the model of the other folds, and those models by fold.

    Rows without a target are predicted and not learned from. The rows are read twice, so costly ones should be a stored
    table, and stored once with their folds, in the folder of ``spark.checkpoint.dir``, so that each pass reads columns
    and a lost executor costs its parts alone; ``at_once`` models are grown side by side. Fewer than two groups are an error. Columns called fold or pred are replaced.
    """
    spark = rows.sparkSession
    rows = rows.drop("fold", "pred")
    dealt = folds(rows, group, n).withColumnRenamed(group, "_group")
    held = stored(rows.join(dealt, F.col(group).eqNullSafe(F.col("_group"))).drop("_group"), "folds")
    known = _known(held, target, base)
    seen = _seen(known, features, "fold")
    all_folds = sorted(r["fold"] for r in held.select("fold").distinct().collect())
    if len(all_folds) < 2:
        raise ValueError("folds by group need two groups")

    def one(k: int) -> Boosted:
        others = [v for f, v in seen.items() if f != k]
        if not others:
            raise ValueError(f"no rows to fit on beside fold {k}")
        total = [(sum(v[i][0] for v in others), sum(v[i][1] for v in others)) for i in range(len(features) + 1)]
        return _fit(known.where(F.col("fold") != k), total, features, target, base, how)

    with ThreadPool(min(at_once, len(all_folds))) as pool:
        models = pool.map(inheritable_thread_target(spark)(one), all_folds)
    parts = [m.predict(held.where(F.col("fold") == k)) for k, m in zip(all_folds, models)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out, models
