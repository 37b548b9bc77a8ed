"""Periodic runs of words: Lempel-Ziv factors from a suffix automaton, runs by Main's extensions and by copying (Kolpakov and Kucherov 1999)."""

from __future__ import annotations

from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortspark.llm import textops as T

#: Shortest run in words.
LEAST = 12
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(_RUN)), ("collapsed", pa.string())])

Run = tuple[int, int, int]


def factors(w: Sequence[int]) -> list[tuple[int, int]]:
    """(length, start of an earlier occurrence or -1) of each factor: a new letter, or the longest stretch met before.

    The automaton of the whole sequence knows where each of its strings ends first. Most states have one transition,
    which stands in two arrays; only those that branch have a dictionary.
    """
    size = array("q", [0])
    link = array("q", [-1])
    ends = array("q", [-1])
    letter, target = array("q", [-1]), array("q", [0])
    more: dict[int, dict[int, int]] = {}

    def follow(s: int, c: int) -> int:
        if letter[s] == c:
            return target[s]
        return more[s].get(c, 0) if s in more else 0

    def point(s: int, c: int, to: int) -> None:
        if letter[s] in (-1, c):
            letter[s], target[s] = c, to
        else:
            more.setdefault(s, {})[c] = to

    last = 0
    for i, c in enumerate(w):
        new = len(size)
        size.append(size[last] + 1)
        link.append(0)
        ends.append(i)
        letter.append(-1)
        target.append(0)
        p = last
        while p != -1 and not follow(p, c):
            point(p, c, new)
            p = link[p]
        if p != -1:
            q = follow(p, c)
            if size[q] == size[p] + 1:
                link[new] = q
            else:
                twin = len(size)
                size.append(size[p] + 1)
                link.append(link[q])
                ends.append(ends[q])
                letter.append(letter[q])
                target.append(target[q])
                if q in more:
                    more[twin] = dict(more[q])
                while p != -1 and follow(p, c) == q:
                    point(p, c, twin)
                    p = link[p]
                link[q] = link[new] = twin
        last = new

    out, at, n = [], 0, len(w)
    while at < n:
        s, j = 0, at
        while j < n and (t := follow(s, w[j])) and ends[t] < j:
            s, j = t, j + 1
        out.append((j - at, ends[s] - (j - at) + 1) if j > at else (1, -1))
        at = max(j, at + 1)
    return out


def common(w: Sequence[int]) -> list[int]:
    """For each place how many letters from there on equal those from the start on."""
    n = len(w)
    z = [0] * n
    left = right = 0
    for i in range(1, n):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and w[k] == w[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def _around(w: Sequence[int], low: int, b: int, high: int, least: int, found: dict[tuple[int, int], int]) -> None:
    """Runs of w that touch place b, as far as low and high show them, into found: (start, end) to the smallest period."""
    u, v = w[low:b], w[b:high]
    nu, nv, n = len(u), len(v), len(w)
    back = u[::-1]
    on = common(v + [-1] + u + v)
    rear = common(back + [-1] + v[::-1] + back)
    spans = []
    for q in range(1, nv + 1):  # a whole period lies to the right of b
        before, after = min(rear[nu + 1 + nv - q], nu), on[q] if q < nv else 0
        if before + after >= q and before + after + q >= least:
            spans.append((b - before, b + q + after - 1, q))
    for q in range(1, nu + 1):  # a whole period lies to the left of b
        before, after = rear[q] if q < nu else 0, min(on[nv + 1 + nu - q], nv)
        if before + after >= q and before + after + q >= least:
            spans.append((b - q - before, b + after - 1, q))
    for s, e, q in spans:
        if (s == 0 or w[s - 1] != w[s - 1 + q]) and (e == n - 1 or w[e + 1] != w[e + 1 - q]):
            found[s, e] = min(q, found.get((s, e), q))


def runs(w: Sequence[int], least: int = LEAST) -> list[Run]:
    """(start, length, period) of all runs of at least ``least`` and two periods, by start, then period.

    A run that touches a border of factors ends in a factor or right before it, and then starts at most two previous
    factors and one of its own before that; Main's extensions find all of these in linear time. Any other run lies
    inside a factor and is copied from where the factor was met before.
    """
    w = list(w)
    parts = factors(w)
    found: dict[tuple[int, int], int] = {}
    b = was = 0
    for size in [p[0] for p in parts] + [0]:
        low = max(0, b - 2 * was - size)
        if b and b + size - low >= least:
            _around(w, low, b, b + size, least, found)
        b, was = b + size, size
    touching = sorted((s, e, q) for (s, e), q in found.items())
    starts = [r[0] for r in touching]
    inner: list[Run] = []
    begun: list[int] = []
    b = 0
    for size, past in parts:
        end = b + size - 1
        if size > least:
            step, fresh = b - past, []
            stop = min(b, past + size - 1)
            for rows, first in ((touching, starts), (inner, begun)):
                for s, e, q in rows[bisect_right(first, past) : bisect_right(first, stop)]:
                    for k in range(step, end - e, step):
                        fresh.append((s + k, e + k, q))
            fresh.sort()
            inner += fresh
            begun += [r[0] for r in fresh]
        b += size
    return sorted(((s, e - s + 1, q) for s, e, q in touching + inner), key=lambda r: (r[0], r[2]))


def repeated(ids: np.ndarray, least: int = LEAST) -> list[tuple[int, int]]:
    """Stretches [start, stop) outside which no run can be: every word of a run stands in a group of words met twice.

    A run of period q and length n >= max(least, 2q) without its last q words, and without its first q, are equal
    stretches of n - q >= least / 2 words, and together they are the run.
    """
    k = (least + 1) // 2
    n = len(ids) - k + 1
    if n < 2 or len(ids) < least:
        return []
    mixed = T.mix(ids.astype(T.U) + T.U(1))
    h = np.zeros(n, T.U)
    for i, m in enumerate(T.seeds(k, 12)):
        h += mixed[i : i + n] * m
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    again = np.zeros(n, bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    at = np.flatnonzero(again)
    if not len(at):
        return []
    cut = np.flatnonzero(np.diff(at) > k) + 1
    return [(int(g[0]), int(g[-1]) + k) for g in np.split(at, cut) if g[-1] + k - g[0] >= least]


def text_runs(text: bytes, least: int = LEAST) -> tuple[int, list[Run], bytes]:
    """(words, runs, text without the repeats) of one text; words are separated by ASCII white space."""
    words = text.split()
    if len(words) < least:
        return len(words), [], b" ".join(words)
    number: dict[bytes, int] = {}
    ids = [number.setdefault(x, len(number)) for x in words]
    out: list[Run] = []
    if len(number) < len(ids):
        for i, j in repeated(np.array(ids), least):
            out += [(s + i, n, q) for s, n, q in runs(ids[i:j], least)]
    if not out:
        return len(words), out, b" ".join(words)
    keep, until = [], 0
    for s, n, q in sorted(out, key=lambda r: r[0] + r[2]):
        first = s + q
        if first > until:
            keep += words[until:first]
        until = max(until, s + n)
    return len(words), out, b" ".join(keep + words[until:])


def _task(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            for at, raw, off in T.pieces(batch.column("text")):
                rows = [text_runs(raw[i:j].tobytes(), least) for i, j in zip(off[:-1], off[1:])]
                found = [[{"start": s, "length": n, "period": q} for s, n, q in r[1]] for r in rows]
                columns = [ids.slice(at, len(rows)), pa.array([r[0] for r in rows], pa.int64()), pa.array(found, pa.list_(_RUN)), pa.array([r[2].decode() for r in rows], pa.string())]
                yield pa.RecordBatch.from_arrays(columns, schema=_OUT)

    return run


def word_runs(docs: DataFrame, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of every row: all periodic runs of its words, and its text without the repeats.

    A run is a stretch of consecutive words with smallest period q (words q apart are equal) and at least
    max(least, 2q) words that cannot be extended. ``runs`` has start (word number from 0), length and period, by start,
    then period. ``collapsed`` drops what any run has after its first q words and joins the rest by one space. A null
    or empty text has no words, no runs and an empty text; repeated rows and null ids come out row by row; columns
    other than the two named are ignored; an empty table gives no rows. Rows are worked on alone, without a shuffle.
    Words are compared exactly: hashes only leave out stretches in which no run can be.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_task(least), f"doc_id long, n_words long, runs {RUNS}, collapsed string")


def looped(doc_id: Column, text: Column) -> Column:
    """The text of every tenth id (by crc32) as a text that goes in circles from a word on; others, and null ids, as they are."""
    h = F.crc32(doc_id.cast("long").cast("string"))
    g = F.floor(h / 10)

    def turned(w: Column) -> Column:
        n = F.size(w).cast("long")
        a = g % n
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))
        at = F.sequence(F.lit(0), F.size(w) - 1)
        return F.array_join(F.transform(at, lambda i: F.get(w, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int"))), " ")

    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda x: x != "")
    # a lambda's argument is worked out once, so the words are split once
    whole = F.get(F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, turned(w)).otherwise("")), 0)
    return F.when(h % 10 == 0, whole).otherwise(text)


def digests(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """The runs of every document, some of them looped first: the longest run, and digests of all runs and of what is kept."""
    found = word_runs(docs.select("doc_id", looped(F.col("doc_id"), F.col("text").cast("string")).alias("text")), least)
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("size"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    lines = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    length = -F.col("best.size")
    milli = F.floor(F.lit(1000) * length / F.col("best.period")).cast("long")
    return rows.select("doc_id", "n_runs", F.col("best.start").alias("start"), length.alias("length"), F.col("best.period").alias("period"), milli.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


# Runs by definition: for each distance, stretches of equal groups of six words; no other runs exist (see ``repeated``).
ORACLE = r"""
WITH crc AS (SELECT list_transform(range(256), lambda x: list_reduce(list_prepend(CAST(x AS BIGINT), [CAST(k AS BIGINT) for k in range(8)]), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t),
d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w,
    xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda c, b: xor(c // 256, t[xor(c, b) % 256 + 1])), 4294967295) AS h FROM documents, crc),
e AS (SELECT doc_id, h, w, len(w) AS n, CASE WHEN len(w) > 0 THEN (h // 10) % len(w) END AS a FROM d),
f AS (SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: w[(CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + (h // 10) % 8)) END) + 1]) ELSE w END AS w FROM e),
g AS (SELECT doc_id, i, array_to_string(w[i+1:i+6], ' ') AS k FROM (SELECT doc_id, w, unnest(range(n - 5)) AS i FROM f WHERE n >= 12)),
p AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM g x JOIN g y ON x.doc_id = y.doc_id AND x.k = y.k AND x.i < y.i),
s AS (SELECT doc_id, q, min(i) AS start, count(*) + 5 AS m FROM (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS grp FROM p) GROUP BY doc_id, q, grp),
r AS (SELECT doc_id, start, m + q AS length, min(q) AS period FROM s WHERE m >= q AND m + q >= 12 GROUP BY doc_id, start, m + q),
b AS (SELECT doc_id, count(*) AS n_runs, first(start ORDER BY length DESC, start, period) AS start, first(length ORDER BY length DESC, start, period) AS length, first(period ORDER BY length DESC, start, period) AS period,
    string_agg(concat(start, ',', length, ',', period, chr(10)), '' ORDER BY start, period) AS lines FROM r GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, i FROM (SELECT doc_id, unnest(range(start + period, start + length)) AS i FROM r)),
kept AS (SELECT u.doc_id, string_agg(x, ' ' ORDER BY u.i) AS t FROM (SELECT doc_id, unnest(w) AS x, unnest(range(n)) AS i FROM f) u LEFT JOIN gone ON gone.doc_id = u.doc_id AND gone.i = u.i WHERE gone.i IS NULL GROUP BY u.doc_id)
SELECT f.doc_id, CAST(coalesce(b.n_runs, 0) AS BIGINT) AS n_runs, CAST(b.start AS BIGINT) AS start, CAST(b.length AS BIGINT) AS length, CAST(b.period AS BIGINT) AS period, CAST(1000 * b.length // b.period AS BIGINT) AS exponent_milli,
    sha256(coalesce(b.lines, '')) AS runs_sha256, sha256(coalesce(kept.t, '')) AS collapsed_sha256
FROM f LEFT JOIN b ON b.doc_id = f.doc_id LEFT JOIN kept ON kept.doc_id = f.doc_id
"""
