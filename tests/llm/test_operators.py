import hashlib
import itertools
import re
import zlib

import numpy as np
import pytest
from oracle import same

import corpus_pipeline
from cohortspark.llm import crf, decontaminate, graph, htmltext, jaccard, langid, licenses, mixing, mixing_query, pairjoin, quality, queries, shards, substrings
from cohortspark.llm.capfilter import near_vectors
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, node string, key int"
LONG = "alpha " * 30000
EDGE = [
    (1, None, None, None, None, "x", 1),
    (2, "", "en", "s", 0, "x", 1),
    (None, "one two three four five six", None, "s", 1, None, None),
    (3, "one two three four five six", "en", None, 1, "y", 2),
    (3, "one two three four five six", "en", None, 1, "y", 2),
    (4, LONG, "en", "s", len(LONG), "z", 3),
    (5, "\n\n !!! \n", "de", "s", 4, "z", 3),
]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(EDGE, DOCS)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def low(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_matches_sql(spark, name):
    same(queries.QUERIES[name](spark, SF), queries.ORACLE[name], SF)


def test_jaccard_edges(edge, spark):
    got = sorted(map(tuple, jaccard.jaccard_classes(edge).collect()), key=str)
    want = [(1, 0, 1), (2, 0, 2), (3, 4, 3), (3, 4, 3), (4, 1, 4), (5, 1, 5), (None, 4, 3)]
    assert got == sorted(want, key=str)
    assert jaccard.jaccard_classes(edge.where("false")).count() == 0


def test_jaccard_near_copies_of_every_size(spark):
    rng, rows = np.random.default_rng(1), []
    for size in (3, 9, 11, 12, 21, 40, 130, 600):
        words = [f"w{x}" for x in rng.integers(0, 5000, size + 2)]
        for edits in (0, 0, 1, 1, 2, 3, size // 30, size // 25):
            w = list(words)
            for at in rng.integers(0, len(w), edits):
                w[at] = f"x{rng.integers(0, 99)}"
            rows.append((len(rows), " ".join(w)))
    sets = {i: {tuple(t.split()[k : k + 3]) for k in range(len(t.split()) - 2)} for i, t in rows}
    root = {i: i for i in sets}
    for a, b in itertools.combinations(sets, 2):
        if 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b]):
            old, new = max(root[a], root[b]), min(root[a], root[b])
            root = {k: new if v == old else v for k, v in root.items()}
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == root


def test_sketch_never_rules_out_a_link():
    rng = np.random.default_rng(2)
    for n in (5, 20, 300):
        x = rng.integers(0, 2**63, n).astype(np.uint64)
        y = np.append(x[: n - n // 20], rng.integers(0, 2**63, n // 40).astype(np.uint64))
        j = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
        ok = pairjoin.may_link([pairjoin.sketch(x, 9, 10)], np.array([len(x)]), [pairjoin.sketch(y, 9, 10)], np.array([len(y)]), 9, 10)
        assert ok[0] or j < 0.9


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 200), (300, 200), (5, 5)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 200: 100, 300: 100}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_vector_edges(spark):
    nan, e = float("nan"), [1.0] + [0.0] * 7
    rows = [(1, e, 1), (2, e, 1), (3, [2 * x for x in e], 1), (4, e, 2), (5, None, 1), (6, [0.0] * 8, 1), (7, [nan] * 8, 1), (8, e, None), (9, [1.0, None], 1), (10, [1.0, 0.0], 1), (11, [1.0, 0.3] + [0.0] * 6, 1)]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    assert got == {1: (3, 1, True), 2: (3, 1, False), 3: (3, 1, False), 11: (3, 1, False)} | {i: (0, i, True) for i in (4, 5, 6, 7, 8, 9, 10)}


def test_vector_recall(spark):
    rng = np.random.default_rng(0)
    base = rng.standard_normal((300, 64))
    near = base + rng.standard_normal((300, 64)) * np.linalg.norm(base, axis=1)[:, None] / 8 * 0.38
    x = np.vstack([base, near])
    u = x / np.linalg.norm(x, axis=1)[:, None]
    hit = u @ u.T >= 0.93
    got = {r.vec_id: r.n_links for r in near_vectors(spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")).collect()}
    want = hit.sum(axis=1) - 1
    assert want.sum() > 100 and sum(got.values()) >= 0.99 * want.sum() and all(got[i] <= n for i, n in enumerate(want))


def test_shards(docs, edge):
    rows = shards.shard(docs, 8).collect()
    text = {r.doc_id: r.text for r in docs.collect()}
    assert len(rows) == len(text)
    for r in rows:
        assert r.size == len(text[r.doc_id].encode()) + 16 and r.text_crc32 == zlib.crc32(text[r.doc_id].encode()) and r.law == "bytes"
    for s in range(8):
        own = sorted(r.slot for r in rows if r.shard == s)
        assert own == list(range(len(own)))
    size = [sum(r.size for r in rows if r.shard == s) for s in range(8)]
    assert max(size) - min(size) <= max(r.size for r in rows)
    got = shards.shard(edge, 3).collect()
    assert len(got) == len(EDGE) and next(r for r in got if r.doc_id == 1).text_crc32 is None
    assert shards.shard(edge.where("false"), 3).count() == 0


def test_rebalance_moves_few_slots(docs, tmp_path, spark):
    b = shards.slot_bytes(shards.sized(docs, 256))
    one = shards.assign(b, 4)
    shards.save(one, str(tmp_path / "map"))
    shards.save(shards.rebalance(shards.load(spark, str(tmp_path / "map")), b, 5, 2), str(tmp_path / "map"))
    old = {r.virtual_slot: r.shard for r in shards.load(spark, str(tmp_path / "map"), 1).collect()}
    new = {r.virtual_slot: r.shard for r in shards.load(spark, str(tmp_path / "map")).collect()}
    assert old.keys() == new.keys() and set(new.values()) == set(range(5))
    size = {r.virtual_slot: r.bytes for r in b.collect()}
    assert sum(n for s, n in size.items() if old[s] != new[s]) < 0.4 * sum(size.values())


def test_budgets_meet_weights_and_shortages(spark):
    leaves = spark.createDataFrame([("a", "x", 100, 1), ("a", "y", 10, 1), ("b", "z", 1000, 1)], "d string, s string, tokens long, rows long")
    got = {r.s: r.budget for r in mixing.budgets(leaves, ["d", "s"], {}, 200, 1).collect()}
    assert got == {"x": 90, "y": 10, "z": 100}  # y's shortage goes to its sibling first
    got = {r.s: r.budget for r in mixing.budgets(leaves, ["d", "s"], {("b",): 3}, 1000, 1).collect()}
    assert got == {"x": 100, "y": 10, "z": 890}  # then to the ancestors' siblings


def test_mix_edges(edge):
    out = mixing_query.mixture(edge)
    assert set(out.columns) == {"doc_id", "domain", "lang", "source", "epoch", "n_tokens", "take_tokens"}
    assert all(0 < r.take_tokens <= r.n_tokens for r in out.collect())
    whole = mixing.mix(edge, mixing_query.levels(), {}, share=1.0, max_epochs=1, whole_rows=True)
    assert whole.count() == 5 and whole.columns == [*edge.columns, "epoch", "take_tokens"]
    assert mixing_query.mixture(edge.where("false")).count() == 0


def test_decontaminate_edges(edge, spark):
    items = spark.createDataFrame([(1, "Three FOUR!"), (2, None), (None, "six"), (3, "absent"), (10, "two three, four")], "item_id long, text string")
    got = decontaminate.contamination(edge, items).collect()
    assert len(got) == len(EDGE)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for r in got:
        six = r.doc_id in (None, 3)
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == ((6, 4, 2, True) if six else (30000 if r.doc_id == 4 else 0, 0, 0, False))
        assert r.items_sha256 == sha("1,10" if six else "")
    assert decontaminate.contamination(edge, items.where("false")).where("contaminated").count() == 0
    assert decontaminate.contamination(edge.where("false"), items).count() == 0


def test_proximity(spark):
    d = spark.createDataFrame([(1, "a quick brown x fox jumps"), (2, "quick brown fox jumps"), (3, "quick one two three four five brown fox jumps")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "quick brown fox jumps")], "item_id long, text string")
    _, found = decontaminate.matches(d, items, slop=2)
    assert sorted({(r.doc_id, r.exact) for r in found.collect() if not (r.doc_id == 2 and not r.exact)}) == [(1, False), (2, True)]


def test_licenses(docs, edge):
    words = lambda s: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low(s))
    made = {}
    for n, s in licenses.TEMPLATES.items():
        k = min(5, len(words(s)))
        made[n] = k, {tuple(words(s)[i : i + k]) for i in range(len(words(s)) - k + 1)}
    got = {r.doc_id: list(r.licenses) for r in licenses.license_report(docs).collect()}
    for r in docs.collect():
        w = words(r.text)
        assert got[r.doc_id] == sorted(n for n, (k, s) in made.items() if len({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} & s) >= 0.8 * len(s))
    assert {r.n_matches for r in licenses.license_report(edge).collect()} == {0}
    assert 1 - (1 - 0.2) ** licenses.bands_for(0.2) >= 1 - licenses.MISS


def test_license_in_long_text(spark):
    text = "lorem " * 777 + licenses.TEMPLATES["MIT"].replace("merge, ", "") + " ipsum" * 500
    got = licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().matches
    assert [m.license for m in got] == ["MIT"] and text.encode()[got[0].start : got[0].stop].decode().startswith("Permission")


def test_substrings(docs, edge):
    units = {}
    for r in docs.collect():
        for p, line in enumerate(r.text.split("\n")):
            w = low(line).split()
            if len(w) >= 20:
                units[r.doc_id, p] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    root = {k: k for k in units}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(units), 2):
        small, large = sorted((len(units[a]), len(units[b])))
        if small >= 0.8 * large and len(units[a] & units[b]) >= 0.8 * len(units[a] | units[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    removed = {k for k in units if find(k) != k}
    got = {(r.doc_id, p) for r in substrings.substring_report(docs).collect() for p in r.removed}
    assert got == removed and removed
    assert {r.n_removed for r in substrings.substring_report(edge).collect()} <= {0, 1}


def test_strip_keeps_the_first(spark):
    p = " ".join(f"w{i}" for i in range(60))
    d = spark.createDataFrame([(1, f"own a\n{p}"), (2, f"{p.replace('w7 ', 'x ')}\nown b"), (3, "clean")], "doc_id long, text string")
    assert {r.doc_id: r.text for r in substrings.strip(d).collect()} == {1: f"own a\n{p}", 2: "own b", 3: "clean"}


def test_html(spark):
    page = (
        "<html><head><title>T</title><script>var a='<p>no</p>'</script></head><body><header>Site</header><nav><ul><li><a>Home</a></ul></nav><div class='cookie-notice'>We use cookies</div>"
        "<div id=content><h1>Title &amp; more</h1><p>Long \n paragraph of the article with many words in it.<p>Second <b>bold</b>ness.<ul><li>one<li>two</ul><p>ok.</p><form><label>Mail</label></form></div>"
        "<div class=sidebar><a>Related</a></div><section class=comments><p>Nice post, I liked it a lot, with many more words</p></section><footer>&copy; x</footer>"
    )
    got = htmltext.main_text(spark.createDataFrame([(1, "u", page), (2, None, None), (3, "u", ""), (3, "u", "<p>a<br>b &lt;c")], "page_id long, url string, html string")).collect()
    assert [r.text for r in got] == ["Title & more Long paragraph of the article with many words in it. Second boldness. one two ok.", "", "", "a b <c"]
    assert [r.n_chars for r in got] == [len(r.text) for r in got]


def test_forward_backward():
    rng = np.random.default_rng(0)
    first, k = np.array([0, 3, 3, 7]), 3
    s, t, b = rng.normal(size=(7, k)), rng.normal(size=(k, k)), rng.normal(size=k)
    p, counts, logz = crf.marginals(s, t, b, first, True)
    want, total = np.zeros((7, k)), 0.0
    for i, j in ((0, 3), (3, 7)):
        z, part = 0.0, np.zeros((j - i, k))
        for y in itertools.product(range(k), repeat=j - i):
            w = np.exp(b[y[0]] + sum(s[i + n, v] for n, v in enumerate(y)) + sum(t[a, c] for a, c in zip(y, y[1:])))
            z += w
            for n, v in enumerate(y):
                part[n, v] += w
        want[i:j], total = part / z, total + np.log(z)
    assert np.allclose(p, want) and np.isclose(logz, total) and np.isclose(counts.sum(), 5)


def test_language(spark, docs, edge):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.identify(d, 60).join(d.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.97 * len(got) and all(0 <= r.score <= 1 for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    out = langid.identify(edge).collect()
    assert len(out) == len(EDGE) and all(r.lang_pred == "und" and r.score == 0 for r in out if r.doc_id in (1, 2, 5))
    assert langid.identify(edge.where("false")).count() == 0


def test_quality(spark, edge):
    d, l = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = quality.classify(d, l, sample_rows=400).join(l, "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.quality for r in got) >= 0.96 * len(got)
    assert all(r.predicted == (r.score >= 0.7) for r in got)
    none = l.where("false")
    assert {r.score for r in quality.classify(edge, none).collect()} == {0.5}
    assert quality.classify(edge.where("false"), none).count() == 0


def test_pipeline(spark, docs):
    q = docs
    for name, stage in corpus_pipeline.STAGES:
        before = q
        path = f"{corpus_pipeline.scratch.shared_dir(spark)}/test-{name}"
        stage(spark, before, SF).write.mode("overwrite").parquet(path)
        q = spark.read.parquet(path)
        if name != "sharding":
            assert sorted(q.columns) == sorted(docs.columns)
        if name == "near_duplicates":
            classes = jaccard.jaccard_classes(before, k=corpus_pipeline.WORDS, num=corpus_pipeline.NUM, den=corpus_pipeline.DEN).collect()
            assert sorted(r.doc_id for r in q.collect()) == sorted(r.doc_id for r in classes if r.doc_id == r.component_id)
        if name == "decontamination":
            bad = decontaminate.contamination(before, spark.read.parquet(f"{SF}/benchmark.parquet")).where("contaminated")
            assert sorted(r.doc_id for r in q.collect()) == sorted(r.doc_id for r in before.join(bad, "doc_id", "left_anti").collect())
    assert q.count() == before.count() and q.where(F.col("shard").between(0, 39)).count() == q.count()


def test_pipeline_keeps_rows_of_empty_tables(spark, docs):
    empty = docs.where("false")
    for _, stage in corpus_pipeline.STAGES[1:]:
        assert stage(spark, empty, SF).count() == 0
