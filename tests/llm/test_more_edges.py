import corpus_pipeline
from cohortspark.llm import quality
from cohortspark.llm.capfilter import near_vectors

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, quality int"
LONG = "word " * 30000
EDGE = [(1, None, None, None, None, 0.1, 1), (2, "", "en", "s", 0, 0.1, 0), (None, "some words of a text", None, "s", 1, None, None), (3, "one two three", "en", None, 1, 0.2, 1), (3, "one two three", "en", None, 1, 0.2, 1), (4, LONG, "en", "s", len(LONG), 0.3, 1), (5, "\n\n !!! \n", "de", "s", 4, 0.3, 1)]


def test_vectors_of_repeated_ids_and_none(spark):
    e = [1.0] + [0.0] * 7
    rows = [(1, e, 1, "x"), (1, e, 1, "x"), (2, e, 1, "x"), (None, e, 1, "x"), (3, [0.0, 1.0] + [0.0] * 6, 1, "x")]
    schema = "vec_id long, embedding array<double>, label int, node string"
    got = sorted(((r.vec_id, r.n_links, r.component_id) for r in near_vectors(spark.createDataFrame(rows, schema)).collect()), key=str)
    assert got == sorted([(1, 3, 1), (1, 3, 1), (2, 3, 1), (None, 3, 1), (3, 0, 3)], key=str)
    assert near_vectors(spark.createDataFrame([], schema)).count() == 0


def test_quality_of_odd_texts_under_a_fitted_model(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    odd = spark.createDataFrame([(r[0] + 10_000_000 if r[0] else None, *r[1:]) for r in EDGE], DOCS)
    both = docs.unionByName(odd, allowMissingColumns=True)
    got = [r for r in quality.classify(both, labels, sample_rows=100).collect() if r.doc_id is None or r.doc_id > 9_000_000]
    assert len(got) == len(EDGE) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)


def test_every_stage_takes_odd_and_no_rows(spark):
    docs = spark.createDataFrame(EDGE, DOCS)
    for name, stage in corpus_pipeline.STAGES:
        epochs = corpus_pipeline.EPOCHS if name == "mixture" else 1
        assert stage(spark, docs, "/root/testdata/sf0.001").count() <= epochs * len(EDGE)
        assert stage(spark, docs.where("false"), "/root/testdata/sf0.001").count() == 0


def test_stages_drop_what_they_must(spark):
    item = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").where("text is not null and length(text) > 100").first().text
    rows = [(1, "own words only here " + item, "en", "s", 1), (None, "more of it " + item, "en", "s", 1), (2, "a clean text about nothing", "en", "s", 1), (None, "a clean text about something", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = dict(corpus_pipeline.STAGES)["decontamination"](spark, docs, "/root/testdata/sf0.001").collect()
    assert sorted((r.doc_id, r.text) for r in kept if r.doc_id) == [(2, "a clean text about nothing")] and [r.text for r in kept if r.doc_id is None] == ["a clean text about something"]
