import pytest

from cohortspark.llm import licenses
from cohortspark.llm import textops as T
import pyarrow as pa

CLASSES = licenses.compile_templates(licenses.TEMPLATES)


@pytest.mark.parametrize("name", ["BSD-3-Clause", "MIT", "GPL-3.0 (header)", "ISC"])
def test_words_in_the_middle_hide_no_notice_at_any_offset(name):
    words = licenses.TEMPLATES[name].split()
    extra = [f"x{i}" for i in range(min(60, len(words)))]
    texts = []
    for offset in range(0, 280):
        half = len(words) // 2
        texts.append(" ".join([f"f{i}" for i in range(offset)] + words[:half] + extra + words[half:] + [f"e{i}" for i in range(100)]))
    raw, off = T.strings(pa.array(texts, pa.large_string()))
    found = {t for t, n, *_ in licenses.scan_piece(raw, off, CLASSES) if n == name}
    grams = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    cut = words[: len(words) // 2], words[len(words) // 2 :]
    share = (len(grams(cut[0])) + len(grams(cut[1]))) / len(grams(words))
    assert found == (set(range(280)) if share >= 0.8 else set())


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string, matches int")
    assert licenses.license_report(none).count() == 0
