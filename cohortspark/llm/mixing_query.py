"""The registered mixture over ``documents`` and its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortspark.llm.mixing import mix

DOMAINS = 4
#: Target weights: of domains, of languages in any domain; sources in a language weigh alike.
WEIGHTS = {("domain0",): 4, ("domain1",): 3, ("domain2",): 2, ("domain3",): 1, (None, "en"): 4, (None, "de"): 2, (None, "fr"): 2, (None, "es"): 2}
SHARE, EPOCHS, SEED = 0.5, 4, 17


def domain(source: Column) -> Column:
    """The documents name no domain, so a hash deals sources to a few."""
    return F.concat(F.lit("domain"), F.pmod(F.conv(F.substring(F.md5(F.coalesce(source, F.lit(""))), 1, 4), 16, 10).cast("int"), F.lit(DOMAINS)).cast("string"))


def levels() -> dict[str, Column]:
    return {"domain": domain(F.col("source")), "lang": F.col("lang"), "source": F.col("source")}


def mixture(docs: DataFrame) -> DataFrame:
    return mix(docs, levels(), WEIGHTS, share=SHARE, max_epochs=EPOCHS, seed=SEED)


def _fill(i: int, path: list[str], parent: list[str], weight: str) -> str:
    """SQL of one level of the tree: CTE g{i} with the path and its budget, from g{i-1}."""
    p, by = ", ".join(path), ", ".join(parent) or "1"
    join = f"JOIN g{i - 1} USING ({', '.join(parent)})" if parent else "CROSS JOIN g0"
    return f"""
a{i} AS (SELECT {p}, CAST(sum(tokens) * {EPOCHS} AS HUGEINT) AS cap, CAST({weight} AS HUGEINT) AS w FROM leaves GROUP BY {p}),
b{i} AS (SELECT a{i}.*, budget AS b,
  sum(cap) OVER (PARTITION BY {by} ORDER BY CAST(cap AS DOUBLE) / CAST(w AS DOUBLE), {path[-1]} ROWS UNBOUNDED PRECEDING) - cap AS before,
  sum(w) OVER (PARTITION BY {by} ORDER BY CAST(cap AS DOUBLE) / CAST(w AS DOUBLE), {path[-1]} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS left_w
  FROM a{i} {join}),
c{i} AS (SELECT *, cap * left_w <= (b - before) * w AS short FROM b{i}),
d{i} AS (SELECT *, b - coalesce(sum(CASE WHEN short THEN cap END) OVER (PARTITION BY {by}), 0) AS rest, sum(CASE WHEN NOT short THEN w END) OVER (PARTITION BY {by}) AS rest_w FROM c{i}),
e{i} AS (SELECT *, CASE WHEN NOT short THEN CAST(rest AS HUGEINT) * w // CAST(rest_w AS HUGEINT) END AS part FROM d{i}),
g{i} AS (SELECT {p}, CAST(CASE WHEN short THEN cap ELSE part + CASE WHEN rn <= extra THEN 1 ELSE 0 END END AS HUGEINT) AS budget
  FROM (SELECT *, rest - sum(part) OVER (PARTITION BY {by}) AS extra, row_number() OVER (PARTITION BY {by}, short ORDER BY {path[-1]}) AS rn FROM e{i}))"""


def _case(level: int, column: str) -> str:
    hits = [f"WHEN {column} = '{k[-1]}' THEN {w}" for k, w in WEIGHTS.items() if len(k) == level]
    return f"CASE {' '.join(hits)} ELSE 1 END" if hits else "1"


_HASH = "CAST('0x' || substr(md5('{seed}:' || {epoch} || ':' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT)"

ORACLE = rf"""
WITH rows_ AS (
  SELECT doc_id, 'domain' || (CAST('0x' || substr(md5(coalesce(source, '')), 1, 4) AS INTEGER) % {DOMAINS}) AS domain, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS n_tokens FROM documents
), leaves AS (SELECT domain, lang, source, sum(n_tokens) AS tokens FROM rows_ GROUP BY ALL
), g0 AS (SELECT CAST(least(sum(tokens) * {EPOCHS}, floor(sum(tokens) * {SHARE})) AS HUGEINT) AS budget FROM leaves),
{_fill(1, ["domain"], [], _case(1, "domain"))},
{_fill(2, ["domain", "lang"], ["domain"], _case(2, "lang"))},
{_fill(3, ["domain", "lang", "source"], ["domain", "lang"], _case(3, "source"))},
plan AS (SELECT *, budget // tokens AS whole, budget % tokens AS part FROM (SELECT domain, lang, source, CAST(budget AS BIGINT) AS budget, CAST(tokens AS BIGINT) AS tokens FROM g3 JOIN leaves USING (domain, lang, source)) WHERE tokens > 0 AND budget > 0),
placed AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY {_HASH.format(seed=SEED, epoch="whole")}, doc_id) - n_tokens AS start
  FROM rows_ JOIN plan USING (domain, lang, source) WHERE n_tokens > 0),
chosen AS (SELECT doc_id, domain, lang, source, n_tokens, part, start, whole, unnest(range(0, whole + CASE WHEN start < part THEN 1 ELSE 0 END)) AS epoch FROM placed)
SELECT doc_id, domain, lang, source, CAST(epoch AS INTEGER) AS epoch, n_tokens, CAST(CASE WHEN epoch = whole THEN least(n_tokens, part - start) ELSE n_tokens END AS BIGINT) AS take_tokens FROM chosen
"""
