import itertools

import numpy as np

import corpus_pipeline
from cohortspark.llm import blocks, jaccard, pairjoin
from pyspark.sql import functions as F

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def stage(spark, rows):
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], COLUMNS)
    return sorted(((r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()), key=str)


def test_near_copies_by_five_words(spark):
    rng, rows = np.random.default_rng(4), []
    for size in (3, 6, 12, 40, 130, 600):
        words = [f"w{x}" for x in rng.integers(0, 5000, size)]
        for cut, edits in ((0, 0), (size // 7, 0), (0, 1), (0, size // 45), (size // 4, 0), (0, size // 20)):
            w = list(words[: size - cut])
            for at in rng.integers(0, len(w), edits):
                w[at] = f"x{rng.integers(0, 99)}"
            rows.append((len(rows), " ".join(w)))
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(max(1, len(t.split()) - 4))} for i, t in rows}
    root = {i: i for i in sets}
    for a, b in itertools.combinations(sets, 2):
        if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
            old, new = max(root[a], root[b]), min(root[a], root[b])
            root = {k: new if v == old else v for k, v in root.items()}
    kept = [i for i, _ in stage(spark, rows)]
    assert sorted(kept) == sorted(set(root.values()))
    narrow = {r.doc_id for r in jaccard.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r.doc_id == r.component_id}
    assert narrow - set(kept)


def test_rows_of_one_id_leave_by_text(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    near = b.replace("b0 ", "x ", 1)
    rows = [(5, a), (5, b), (3, b), (3, b), (7, c), (7, near), (None, c), (None, a + " y"), (None, None), (9, ""), (9, None)]
    assert stage(spark, rows) == sorted([(5, a), (3, b), (7, c), (None, None), (9, ""), (9, None)], key=str)
    alone = [(None, a), (None, a), (8, b), (8, b.replace("b0 ", "x ", 1))]
    kept = stage(spark, alone)
    assert len(kept) == 2 and (None, a) in kept and {i for i, _ in kept} == {8, None}


def near_copies(seed, sizes=(30, 150, 400), copies=40):
    rng, rows = np.random.default_rng(seed), []
    for size in sizes:
        words = [f"w{x}" for x in rng.integers(0, 5000, size)]
        for _ in range(copies):
            w = list(words)
            for at in rng.integers(0, size, rng.integers(0, size // 15 + 2)):
                w[at] = f"x{rng.integers(0, 9999)}"
            rows.append((len(rows), " ".join(w)))
    return rows


def test_no_set_is_left_out_without_a_chance_of_missing(spark):
    df = spark.createDataFrame(near_copies(8), "doc_id long, text string")
    with_, without = (sorted(map(tuple, jaccard.jaccard_classes(df, 5, 4, 5, miss=m).collect())) for m in (jaccard.MISS, 0))
    assert with_ == without
    assert jaccard.meetings(4, 5) > 0 and jaccard.meetings(4, 5, miss=0) == 0


def test_strangers_share_no_key_at_any_number_of_sets():
    rng = np.random.default_rng(6)
    for size in (140, 300):
        for members in (1e3, 1e6):
            counts = tuple((b, members) for b in range(16))
            seen: dict[int, int] = {}
            for i in range(400):
                for key in jaccard._keys(np.unique(rng.integers(0, 2**63, size).astype(np.uint64)), counts, 4, 5).tolist():
                    assert seen.setdefault(key, i) == i


def test_linked_sets_share_a_key_with_one_deletion_segments():
    rng = np.random.default_rng(7)
    for num, den in ((4, 5), (9, 10)):
        counts, links = tuple((b, 1e6) for b in range(16)), 0
        for _ in range(300):
            n = int(rng.integers(5, 400))
            x = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
            cut = int(rng.integers(0, 1 + n * (den - num) // den))
            y = np.unique(np.append(x[cut:], rng.integers(0, 2**63, int(rng.integers(0, cut + 1))).astype(np.uint64)))
            both = len(np.intersect1d(x, y))
            if den * both >= num * (len(x) + len(y) - both):
                links += 1
                assert len(np.intersect1d(jaccard._keys(x, counts, num, den), jaccard._keys(y, counts, num, den)))
        assert links > 100


def test_blocks_put_each_pair_out_once(spark, monkeypatch):
    """Pairs across components that many keys show come out of the comparison once, or seldom if few keys are carried."""
    made = []
    rows = near_copies(11, sizes=(200,), copies=60)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    before = pairjoin.scratch.written

    def spy(table, name, owner=""):
        out = before(table, name, owner)
        if name == "shared":
            made.append(out)
        return out

    monkeypatch.setattr(pairjoin.scratch, "written", spy)
    monkeypatch.setattr(pairjoin.scratch, "forget", lambda *tables: None)
    jaccard.jaccard_members(df, 5, 4, 5)
    shared = made[0].select("key", "node").distinct()
    held = shared.groupBy("node").agg(F.sort_array(F.collect_list("key")).alias("held"))
    n = {r.node: len(r.held) for r in held.collect()}
    marks = shared.select("node").distinct().selectExpr("node", "node as root", "200L as n", "unhex(repeat('00', 64)) as sketch")
    spread = blocks.dealt(shared.join(marks, "node").join(held, "node"), ["key"], "node", 7)
    pairs = spread.select("key", "lo", "hi", "c", "node", "root", "n", "sketch", "held").mapInArrow(pairjoin._across(4, 5, False), "a long, b long").collect()
    a = shared.withColumnRenamed("node", "a")
    want = a.join(shared.withColumnRenamed("node", "b"), "key").where("a > b").select("a", "b").distinct().collect()
    assert sorted(map(tuple, pairs)) == sorted(map(tuple, want)) and max(n.values()) > 5
    some = spread.withColumn("held", F.slice("held", 1, pairjoin.HELD)).select("key", "lo", "hi", "c", "node", "root", "n", "sketch", "held").mapInArrow(pairjoin._across(4, 5, False), "a long, b long").collect()
    assert {tuple(r) for r in some} == {tuple(r) for r in want} and len(some) < 1.5 * len(want)
