import random
from collections import defaultdict

import pytest

from cohortspark.llm import substrings

EDGE = "doc_id long, text string, found string, hit_id long, row int"


def words(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()


def runs(texts, size):
    """Documents with a run of ``size`` words that another document has too."""
    seen = defaultdict(set)
    for d, t in texts.items():
        w = words(t)
        for i in range(len(w) - size + 1):
            seen[tuple(w[i : i + size])].add(d)
    return {d for docs in seen.values() if len(docs) > 1 for d in docs}


def test_every_common_run_is_found(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: r for r in substrings.substring_report(docs).collect()}
    must, may = runs(texts, substrings.PASSAGE), runs(texts, substrings.WINDOW)
    flagged = {d for d, r in got.items() if r.repeated}
    assert must and must <= flagged
    near = {d for d in flagged - may if got[d].n_repeated}  # lines alike but not equal
    assert flagged - may <= near and len(near) < 0.02 * len(texts)


@pytest.mark.parametrize("length", [51, 60, 100, 200])
def test_passages_inside_longer_lines(spark, length):
    rng = random.Random(length)
    own = lambda n: [f"w{rng.randrange(20000)}" for _ in range(n)]
    passage, rows = own(length), []
    for i in range(20):
        a, b = own(rng.randrange(50, 200)), own(rng.randrange(50, 200))
        glue = "\n" if i % 5 == 4 else " "
        wrapped = glue.join(passage) if i % 5 == 4 else " ".join(passage)  # one word a line
        rows.append((i, " ".join(a) + " " + wrapped + " " + " ".join(b)))
    rows += [(100 + i, " ".join(own(300))) for i in range(20)]
    got = {r.doc_id: r for r in substrings.substring_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i].repeated for i in range(20)) and not any(got[100 + i].repeated for i in range(20))
    stripped = {r.doc_id: r.text for r in substrings.strip(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    text = " ".join(passage)
    assert text in " ".join(stripped[0].split())
    cut = [len(rows[i][1].split()) - len(stripped[i].split()) for i in range(20)]
    assert cut[0] == 0 and all(n <= length for n in cut) and sum(cut) >= 0.75 * 19 * length
    assert all(stripped[100 + i] == rows[20 + i][1] for i in range(20))


def test_edges_of_passages(spark):
    p = " ".join(f"w{i}" for i in range(70))
    rows = [(1, p, "x", 7, 1), (1, p, "x", 7, 1), (2, None, None, None, None), (3, "", "", 1, 1), (None, "own " + p, "y", 2, 2), (4, "a " * 40000, "z", 3, 3), (5, f"{p}\n{p}", "z", 3, 3)]
    docs = spark.createDataFrame(rows, EDGE)
    got = sorted(((r.doc_id, r.repeated, [tuple(x) for x in r.passages]) for r in substrings.substring_report(docs).collect()), key=str)
    at = {d: (again, spans) for d, again, spans in got}
    assert len(got) == 7 and at[2] == at[3] == at[4] == (False, [])
    assert at[1][0] and at[None][0] and at[5][0] and at[5][1][0][0] == 0
    out = substrings.strip(docs)
    assert out.columns == docs.columns and out.count() == 7
    text = {r.doc_id: r.text for r in out.collect()}
    assert text[1] == p and text[4] == rows[5][1] and text[2] is None and p not in text[5] and p not in text[None]
    assert substrings.substring_report(docs.where("false")).count() == 0 and substrings.strip(docs.where("false")).count() == 0
