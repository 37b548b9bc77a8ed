import pytest

from cohortspark.llm import mixing, mixing_query, shards

ROWS = "doc_id long, text string, lang string, source string, part int, budget string, epoch int, full int, cut_h int, cut_take int"


def _docs(spark, n, start=0):
    return spark.createDataFrame([(i, "word " * (i % 9 + 1), "en", f"s{i % 3}", i, "b", 7, 1, 2, 3) for i in range(start, start + n)], ROWS)


def test_a_grown_corpus_keeps_all_rows_under_an_old_map(spark):
    old = shards.assign(shards.slot_bytes(shards.sized(_docs(spark, 200))), 8)
    assert old.count() == shards.SLOTS
    rows = shards.shard(_docs(spark, 600), 8, slot_map=old).collect()
    assert len(rows) == 600
    for s in range(8):
        own = sorted(r.slot for r in rows if r.shard == s)
        assert own == list(range(len(own)))
    first = {r.doc_id: r.shard for r in shards.shard(_docs(spark, 200), 8, slot_map=old).collect()}
    assert all(r.shard == first[r.doc_id] for r in rows if r.doc_id in first)


def test_an_unknown_slot_is_an_error(spark):
    part = shards.assign(shards.slot_bytes(shards.sized(_docs(spark, 200))), 8).where("virtual_slot < 2000")
    with pytest.raises(Exception, match="has no slot"):
        shards.shard(_docs(spark, 200), 8, slot_map=part).collect()


def test_a_stored_version_is_not_written_twice(spark, tmp_path):
    one = shards.assign(shards.slot_bytes(shards.sized(_docs(spark, 50))), 4)
    shards.save(one, str(tmp_path / "map"))
    with pytest.raises(ValueError):
        shards.save(one, str(tmp_path / "map"))
    assert shards.load(spark, str(tmp_path / "map")).count() == shards.SLOTS


def test_columns_of_any_name_pass_through_the_mixture(spark):
    docs = _docs(spark, 60)
    out = mixing.mix(docs, mixing_query.levels(), {}, share=0.5, max_epochs=2, whole_rows=True)
    assert out.columns == ["doc_id", "text", "lang", "source", "part", "budget", "epoch_of_document", "full", "cut_h", "cut_take", "epoch", "take_tokens"]
    assert all(r.part == r.doc_id and r.epoch_of_document == 7 and r.budget == "b" for r in out.collect())
    got = sum(r.take_tokens for r in out.collect())
    assert got == sum(i % 9 + 1 for i in range(60)) // 2
