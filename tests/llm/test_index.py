import random

from cohortspark.llm import decontaminate as D
from pyspark.sql import functions as F


def _texts(rng, n):
    words = [f"w{i}" for i in range(40)]
    return [" ".join(rng.choice(words) for _ in range(rng.randrange(0, 80))) for _ in range(n)]


def _places(texts, items, size):
    want = set()
    for i, t in enumerate(texts):
        w = t.split()
        for item in items:
            x = item.split()
            k = min(size, len(x))
            for s in range(len(x) - k + 1) if k else []:
                want |= {(i, at, tuple(x[s : s + k])) for at in range(len(w) - k + 1) if w[at : at + k] == x[s : s + k]}
    return want


def test_one_stored_index_answers_several_test_sets(spark):
    rng = random.Random(5)
    texts = _texts(rng, 60)
    docs = spark.createDataFrame(list(enumerate(texts)) + [(None, texts[3]), (7, texts[7])], "doc_id long, text string")
    vocabulary, postings = D.index(docs)
    for size in (1, 2, 4):
        items = [" ".join(t.split()[5:15]) for t in texts[size::9]] + ["w1 absent w2", "w3"]
        tests = D.windows(spark.createDataFrame(list(enumerate(items)), "item_id long, text string"), size)
        got = D.search(vocabulary, postings, tests).join(tests.select("window_id", "words"), "window_id")
        rows = [(r.doc, r.start, tuple(r.words)) for r in got.where("exact").collect()]
        want = _places(texts, items, size)
        extra = {(0, at, w) for i, at, w in want if i == 3}  # the null id is 0 and has another text than document 0
        assert set(rows) == want | extra and len(rows) == len(want) + len(extra)


def test_proximity_against_brute_force(spark):
    rng = random.Random(6)
    texts = _texts(rng, 40)
    items = [" ".join(t.split()[3:7]) for t in texts[::5] if len(t.split()) > 7]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    _, found = D.matches(docs, spark.createDataFrame(list(enumerate(items)), "item_id long, text string"), 4, slop=2)
    got = {(r.doc_id, r.start) for r in found.where("exact").collect()}
    assert got == {(i, at) for i, at, _ in _places(texts, items, 4)}
    near = {r.doc_id for r in found.where("not exact").collect()}
    for i in near:
        w = texts[i].split()
        assert any(set(x.split()) <= set(w[max(0, at - 4) : at + 10]) for x in items for at in range(len(w)))
    assert found.where(F.col("length") != 4).count() == 0
