import numpy as np
import pytest

from cohortspark.llm import langid


@pytest.fixture(scope="module")
def docs(spark):
    rng, rows = np.random.default_rng(6), []
    for k in range(70):
        letters = rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 8, replace=False)
        lexicon = ["".join(rng.choice(letters, rng.integers(3, 8))) for _ in range(12)]
        for _ in range(12 if k else 40):
            rows.append((len(rows), " ".join(rng.choice(lexicon, 20)), f"l{k:02d}"))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_every_language_is_learned(docs):
    got = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.95 * len(got)
    assert {r.lang_pred for r in got} == {r.lang for r in got}


def test_too_many_languages_are_an_error(docs):
    with pytest.raises(ValueError, match="69 values of lang"):
        langid.identify(docs, languages=69)
