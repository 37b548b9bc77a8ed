import random
import zlib

import numpy as np
import pytest

from cohortspark.llm import periodic

DOCS = "doc_id long, text string, n_words string, runs int, collapsed int"


def by_definition(w, least):
    """All maximal stretches, distance by distance."""
    out = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i < len(w) - q:
            j = i
            while j < len(w) - q and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(least, 2 * q):
                out[i, j - i + q] = min(q, out.get((i, j - i + q), q))
            i = j + 1
    return sorted(((s, n, q) for (s, n), q in out.items()), key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("letters", [1, 2, 3, 5])
@pytest.mark.parametrize("least", [2, 3, 12])
def test_runs_by_definition(letters, least):
    rng = random.Random(letters * 100 + least)
    for _ in range(150):
        w = []
        while len(w) < rng.randint(0, 120):
            if w and rng.random() < 0.5:  # copies make long factors, also such that overlap themselves
                at, n = rng.randrange(len(w)), rng.randint(1, 30)
                for j in range(n):
                    w.append(w[at + j])
            else:
                w.append(rng.randrange(letters))
        want = by_definition(w, least)
        assert periodic.runs(w, least) == want
        cut = [(s + i, n, q) for i, j in periodic.repeated(np.array(w), least) for s, n, q in periodic.runs(w[i:j], least)]
        assert cut == want


def test_many_runs_in_a_fibonacci_word():
    a, b = [0], [0, 1]
    while len(b) < 2000:
        a, b = b, b + a
    assert periodic.runs(b) == by_definition(b, 12)


def test_factors_cover_and_repeat():
    rng = random.Random(3)
    for _ in range(200):
        w, at = [rng.randrange(3) for _ in range(rng.randint(0, 60))], 0
        for n, past in periodic.factors(w):
            if past < 0:
                assert n == 1 and w[at] not in w[:at]
            else:
                assert past < at and w[past : past + n] == w[at : at + n]
                assert at + n == len(w) or not any(w[p : p + n + 1] == w[at : at + n + 1] for p in range(at))
            at += n
        assert at == len(w)


def test_edges(spark):
    long = " ".join(["alpha"] * 40000)
    rows = [(1, None, "x", 1, 2), (2, "", "x", 1, 2), (3, " \n\t", "x", 1, 2), (4, long, None, None, None), (4, long, None, None, None), (None, "a b " * 6, "x", 1, 2), (5, "é b " * 12, "x", 1, 2)]
    got = sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in periodic.word_runs(spark.createDataFrame(rows, DOCS)).collect()), key=str)
    want = [(1, 0, [], ""), (2, 0, [], ""), (3, 0, [], ""), (4, 40000, [(0, 40000, 1)], "alpha"), (4, 40000, [(0, 40000, 1)], "alpha"), (None, 12, [(0, 12, 2)], "a b"), (5, 12, [(0, 12, 1)], "é b")]
    assert got == sorted(want, key=str)
    assert periodic.word_runs(spark.createDataFrame([], DOCS)).count() == 0
    digests = periodic.digests(spark.createDataFrame(rows, DOCS)).collect()
    assert len(digests) == 7 and all(r.runs_sha256 and r.collapsed_sha256 for r in digests)
    assert [(r.n_runs, r.start, r.length, r.period, r.exponent_milli) for r in digests if r.doc_id == 1] == [(0, None, None, None, None)]


def test_overlapping_runs_drop_their_repeats_once():
    words = "x x x x x x x x x x x x y x x x x x x x x x x x x y z".split()
    n, runs, kept = periodic.text_runs(" ".join(words).encode())
    gone = {i for s, length, q in by_definition(words, 12) for i in range(s + q, s + length)}
    assert n == 27 and runs == by_definition(words, 12) and kept.decode().split() == [x for i, x in enumerate(words) if i not in gone]


def test_looped_texts(spark):
    rows = [(i, " ".join(f"w{j}" for j in range(60))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    looped = dict(df.select("doc_id", periodic.looped(df.doc_id, df.text).alias("t")).collect())
    some = 0
    for i, text in rows:
        h, w = zlib.crc32(str(i).encode()), text.split()
        if h % 10 == 0:
            g = h // 10
            a = g % 60
            p = 1 + (60 - a) // (3 + g % 8)
            w, some = [x if k < a else w[a + (k - a) % p] for k, x in enumerate(w)], some + 1
        assert looped[i].split() == w
    assert some
