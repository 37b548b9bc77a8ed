"""Runs SQL in DuckDB over a folder of tables and compares rows without regard to order."""

from __future__ import annotations

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(sql: str, sf_dir: str) -> tuple[list[str], list[tuple]]:
    c = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    names = [d[0] for d in c.sql(f"DESCRIBE {sql}").fetchall()]
    return names, c.sql(sql).fetchall()


def same(df, sql: str, sf_dir: str) -> None:
    names, want = rows(sql, sf_dir)
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    text = lambda v: f"{v:.6f}" if isinstance(v, float) else str(v)
    at = [names.index(n) for n in order]
    a = sorted(tuple(text(r[n]) for n in order) for r in df.collect())
    b = sorted(tuple(text(r[i]) for i in at) for r in want)
    assert a == b
