"""Mixing sources to target weights by hierarchical budgets, with DataFrame functions only."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortspark.llm import scratch

#: Rows of a leaf that share a range of the shuffled order; only the range that holds the cut is ever sorted.
RANGE_ROWS = 2048


def n_tokens(text: Column) -> Column:
    """Words between white space; 0 for null."""
    return F.coalesce(F.size(F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")), F.lit(0)).cast("long")


def place(seed: int, epoch: Column, doc_id: Column) -> Column:
    """Where a document stands in an epoch's shuffled order: 60 bits of a seeded hash."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 15), 16, 10).cast("long")


def _level(nodes: DataFrame, path: Sequence[str], weights: Mapping[tuple, int]) -> DataFrame:
    """Budgets of the children of every node: shares by weight, shortages dealt out among siblings.

    ``nodes`` has the path, cap and the parent's budget. A child that cannot use its share gives all it has; what
    is missing goes to its siblings by weight. Whole tokens: remainders go one each in the order of names.
    """
    weight = F.lit(1)
    for key, w in weights.items():
        if len(key) == len(path):
            if w < 1:
                raise ValueError("weights are positive integers")
            hit = F.lit(True)
            for c, v in zip(path, key):
                hit = hit & (F.lit(v is None) | (F.col(c) == F.lit(v if v is not None else "")))
            weight = F.when(hit, F.lit(w)).otherwise(weight)
    by = ", ".join(path[:-1]) or "1"
    n = nodes.withColumn("w", weight.cast("decimal(18,0)")).withColumn("cap", F.col("cap").cast("decimal(18,0)")).withColumn("b", F.col("parent_budget").cast("decimal(18,0)"))
    order = f"partition by {by} order by cast(cap as double) / cast(w as double), {path[-1]}"
    n = n.withColumn("before", F.expr(f"cast(sum(cap) over ({order} rows between unbounded preceding and current row) - cap as decimal(18,0))"))
    n = n.withColumn("left_w", F.expr(f"cast(sum(w) over ({order} rows between current row and unbounded following) as decimal(18,0))"))
    n = n.withColumn("short", F.expr("cap * left_w <= (b - before) * w"))
    n = n.withColumn("rest", F.expr(f"cast(b - coalesce(sum(case when short then cap end) over (partition by {by}), 0) as decimal(18,0))"))
    n = n.withColumn("rest_w", F.expr(f"cast(sum(case when not short then w end) over (partition by {by}) as decimal(18,0))"))
    n = n.withColumn("share", F.expr("case when not short then (rest * w) div rest_w end"))
    n = n.withColumn("over", F.expr(f"rest - sum(share) over (partition by {by})"))
    n = n.withColumn("rank", F.expr(f"row_number() over (partition by {by}, short order by {path[-1]})"))
    budget = F.expr("cast(case when short then cap else share + case when rank <= over then 1 else 0 end end as bigint)")
    return n.select(*path, budget.alias("budget"))


def budgets(leaves: DataFrame, levels: Sequence[str], weights: Mapping[tuple, int], budget: int | Column, max_epochs: int) -> DataFrame:
    """(levels, tokens, rows, budget) of every leaf of the tree of ``levels``, root to leaf.

    A node never gets more than all its leaves can give in ``max_epochs`` epochs, so a shortage is met among
    siblings first and by the ancestors' siblings only for the part that is left.
    """
    base = leaves.withColumn("cap", F.col("tokens") * max_epochs)
    total = base.agg(F.coalesce(F.sum("cap"), F.lit(0)).alias("cap"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens")).select(F.least(F.col("cap"), F.lit(budget) if isinstance(budget, int) else budget).alias("parent_budget"))
    given = None
    for i in range(1, len(levels) + 1):
        path = list(levels[:i])
        nodes = base.groupBy(*path).agg(F.sum("cap").alias("cap"))
        nodes = nodes.crossJoin(total) if given is None else nodes.join(given.withColumnRenamed("budget", "parent_budget"), path[:-1])
        given = _level(nodes, path, weights)
    return leaves.join(given, list(levels))


def mix(
    docs: DataFrame,
    levels: Mapping[str, Column],
    weights: Mapping[tuple, int],
    budget: int | None = None,
    share: float = 0.5,
    max_epochs: int = 4,
    seed: int = 17,
    whole_rows: bool = False,
    owner: str = "",
) -> DataFrame:
    """Rows of ``docs`` chosen so that the token counts of a tree's nodes meet target weights.

    ``levels`` names the tree's levels from root to leaf; ``weights`` gives positive integers by path (None stands
    for any name, later entries win, 1 if none fits). ``budget`` is a number of tokens, or ``share`` of all tokens.
    A leaf gives whole epochs, then the token prefix of one more epoch in that epoch's own seeded order. Returns
    (doc_id, levels, epoch, n_tokens, take_tokens), or with ``whole_rows`` the columns of ``docs`` plus epoch and
    take_tokens: the last document of a prefix is cut to ``take_tokens``. Null names count as ''. Documents without
    tokens are never chosen. Rows that share an id and hash stand together; if the cut falls on them, each is
    taken up to the tokens left there. Extra columns are ignored, or kept with ``whole_rows`` whatever their names;
    only epoch and take_tokens of the documents come out as epoch_of_document and take_tokens_of_document. An empty
    table gives no rows.
    """
    names = list(levels)
    own = {c: F.coalesce(x.cast("string"), F.lit("")).alias(f"_mix_{c}") for c, x in levels.items()}
    cols = [f"_mix_{c}" for c in names]
    renamed = {k: v for k, v in weights.items()}
    whole = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_mix_row")] if whole_rows else []
    full_rows = docs.select(*whole, *own.values(), n_tokens(F.col("text").cast("string")).alias("_mix_n"), F.col("doc_id").cast("long").alias("_mix_id"))
    narrow = scratch.written(full_rows.select("_mix_id", *cols, "_mix_n"), "tokens", owner)

    leaves = narrow.groupBy(*cols).agg(F.sum("_mix_n").alias("tokens"), F.count("*").alias("rows"))
    target = F.floor(F.col("tokens") * F.lit(share)).cast("long") if budget is None else budget
    plan = budgets(leaves, cols, renamed, target, max_epochs).where("tokens > 0 and budget > 0")
    plan = plan.withColumn("full", F.expr("budget div tokens")).withColumn("part", F.expr("budget % tokens")).withColumn("ranges", F.ceil(F.col("rows") / RANGE_ROWS).cast("long"))
    plan = scratch.written(plan, "budgets", owner)

    placed = narrow.where("_mix_n > 0").join(scratch.small(plan.where("part > 0")), cols).withColumn("h", place(seed, F.col("full"), F.col("_mix_id")))
    placed = placed.withColumn("range", F.expr("shiftright(shiftright(h, 30) * ranges, 30)"))
    sums = placed.groupBy(*cols, "part", "range").agg(F.sum("_mix_n").alias("n"))
    leaf = ", ".join(cols)
    sums = sums.withColumn("before", F.expr(f"sum(n) over (partition by {leaf} order by range) - n")).where("before < part and part <= before + n")
    # a hot leaf is no hot task: only the one range that the cut falls into, RANGE_ROWS rows on average, is sorted
    edge = placed.join(scratch.small(scratch.written(sums.select(*cols, "range", "before"), "ranges", owner)), [*cols, "range"])
    units = edge.groupBy(*cols, "part", "before", "h", "_mix_id").agg(F.sum("_mix_n").alias("n"))
    units = units.withColumn("start", F.expr(f"before + sum(n) over (partition by {leaf} order by h, _mix_id) - n")).where("start < part and part <= start + n")
    cuts = units.select(*cols, F.col("h").alias("cut_h"), F.col("_mix_id").alias("cut_id"), (F.col("part") - F.col("start")).alias("cut_take"))
    plan = scratch.written(plan.join(cuts, cols, "left").select(*cols, "full", "part", "budget", "cut_h", "cut_id", "cut_take"), "cuts", owner)

    plan = plan.withColumnsRenamed({c: f"_mix_{c}" for c in ("full", "part", "budget", "cut_h", "cut_id", "cut_take")})
    rows = (full_rows if whole_rows else narrow).where("_mix_n > 0").join(scratch.small(plan), cols)
    rows = rows.withColumn("_mix_h", place(seed, F.col("_mix_full"), F.col("_mix_id")))
    at_cut = F.expr("_mix_h = _mix_cut_h and _mix_id <=> _mix_cut_id")
    last = F.expr("_mix_part > 0 and (_mix_h < _mix_cut_h or (_mix_h = _mix_cut_h and (_mix_id <=> _mix_cut_id or coalesce(_mix_id < _mix_cut_id, _mix_id is null))))")
    epochs = F.expr("case when _mix_full > 0 then sequence(0, cast(_mix_full as int) - 1) else cast(array() as array<int>) end")
    epochs = F.when(last, F.concat(epochs, F.array(F.col("_mix_full").cast("int")))).otherwise(epochs)
    rows = rows.withColumn("_mix_epoch", F.explode(epochs))
    take = F.when((F.col("_mix_epoch") == F.col("_mix_full")) & at_cut, F.least("_mix_n", "_mix_cut_take")).otherwise(F.col("_mix_n"))
    if whole_rows:
        more = {"epoch": F.col("_mix_epoch"), "take_tokens": take}
        # a column of the documents that has a name of these two makes way under another name
        return rows.select(*[F.col("_mix_row")[c].alias(f"{c}_of_document" if c in more else c) for c in docs.columns], *[x.alias(c) for c, x in more.items()])
    return rows.select(F.col("_mix_id").alias("doc_id"), *[F.col(f"_mix_{c}").alias(c) for c in names], F.col("_mix_epoch").alias("epoch"), F.col("_mix_n").alias("n_tokens"), take.alias("take_tokens"))
