"""Language of code-switched text: a linear-chain conditional random field labels every word."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.llm import crf
from cohortspark.llm import textops as T
from cohortspark.llm.sample import VALUES, bounded

#: Labelled rows a language at most that the model is fitted on.
SAMPLE_ROWS = 100
#: Hash cells of each kind of feature: letter pairs, triples, affixes of four, and words of the lexicon.
CELLS = 1 << 14
PAIR, TRIPLE, PREFIX, SUFFIX, WORD = (i * CELLS for i in range(5))
SIZE = 5 * CELLS
LEXICON = 300
#: Words that count as the start or the end of a text.
ENDS = 12
U = np.uint64


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x20000)] + [True])


def _cell(x: np.ndarray) -> np.ndarray:
    x = x * U(0x9E3779B97F4A7C15)
    return ((x ^ (x >> U(29))) * U(0xBF58476D1CE4E5B9) >> U(50)).astype(np.int64)


def split(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Code points of the lower-cased texts between separators, and of each word its start, end and text."""
    low = [t.lower() for t in texts]
    cp = np.frombuffer(" ".join(["", *low, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    alpha = _letters()[np.minimum(cp, 0x20000)]
    edge = np.flatnonzero(np.diff(alpha.astype(np.int8)))
    start, end = edge[::2] + 1, edge[1::2] + 1
    stop = np.cumsum([len(t) + 1 for t in low])
    return cp, start, end, np.searchsorted(stop, start, "right")


def features(cp: np.ndarray, start: np.ndarray, end: np.ndarray, lexicon: np.ndarray) -> list[tuple[np.ndarray, np.ndarray | None]]:
    """Cells of each kind: letter n-grams run over the words' letters and one boundary after, others one a word."""
    n = len(start)
    if not n:
        return []
    width = end - start + 1
    first = np.concatenate([[0], np.cumsum(width)])
    word = np.repeat(np.arange(n), width)
    at = np.arange(first[-1]) - first[word] + start[word]
    c = cp[at].astype(U)
    c[first[1:] - 1] = 1
    c1 = np.concatenate([[U(1)], c[:-1]])
    c2 = np.concatenate([[U(1)], c1[:-1]])
    c2[first[:-1]] = 2
    pair, triple = c1 * U(2097169) + c, (c2 * U(2097169) + c1) * U(2097169) + c
    tail, head = np.zeros(n, U), np.zeros(n, U)
    for i in range(4):
        tail = tail * U(2097169) + np.where(end - 1 - i >= start, cp[np.maximum(end - 1 - i, 0)], 1).astype(U)
        head = head * U(2097169) + np.where(start + i < end, cp[np.minimum(start + i, len(cp) - 1)], 1).astype(U)
    whole = names(cp, start, end)
    known = np.minimum(np.searchsorted(lexicon, whole), max(len(lexicon) - 1, 0))
    here = lexicon[known] == whole if len(lexicon) else np.zeros(n, bool)
    return [(_cell(pair) + PAIR, first), (_cell(triple) + TRIPLE, first), (_cell(head) + PREFIX, None), (_cell(tail) + SUFFIX, None), (np.where(here, _cell(whole) + WORD, -1), None)]


def names(cp: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each word."""
    up, down = T._power(len(cp) + 1)
    total = np.zeros(len(cp) + 1, U)
    np.cumsum((cp.astype(U) + U(1)) * up[: len(cp)], out=total[1:])
    return T.mix((total[end] - total[start]) * down[start])


def scores(found: list, weights: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros((n, weights.shape[1]), weights.dtype)
    for cell, first in found:
        if first is None:
            has = cell >= 0
            out[has] += weights[cell[has]]
        else:
            out += np.add.reduceat(weights[cell], first[:-1], axis=0)
    return out


def fit(rows: list[tuple], epochs: int = 20, seed: int = 3) -> tuple[crf.Model, np.ndarray, np.ndarray] | None:
    """A model from (doc_id, text, language) rows.

    All words of a row carry its language. To learn how languages change inside a text, as many more sequences
    are spliced from runs of 5 to 40 words of rows of any language.
    """
    labels = sorted({r[2] for r in rows})
    cp, start, end, text = split([r[1] for r in rows])
    if not len(start):
        return None
    gold = np.array([labels.index(r[2]) for r in rows])[text]
    name = names(cp, start, end)
    lexicon: list[np.ndarray] = []
    for k in range(len(labels)):
        u, count = np.unique(name[gold == k], return_counts=True)
        lexicon.append(u[np.argsort(-count, kind="stable")][:LEXICON])
    lexicon = np.unique(np.concatenate(lexicon))
    _, one, item = np.unique(name, return_index=True, return_inverse=True)
    found = features(cp, start[one], end[one], lexicon)
    owner, cells = [], []
    for cell, first in found:
        who = np.repeat(np.arange(len(one)), np.diff(first)) if first is not None else np.arange(len(one))
        owner.append(who[cell >= 0])
        cells.append(cell[cell >= 0])
    owner, cells = np.concatenate(owner), np.concatenate(cells)
    order = np.argsort(owner, kind="stable")
    at = np.searchsorted(owner[order], np.arange(len(one) + 1))
    rng = np.random.default_rng(seed)
    first = np.searchsorted(text, np.arange(len(rows) + 1))
    runs, made = [], 0
    while made < len(item):
        s = int(rng.integers(len(item)))
        e = min(s + int(rng.integers(5, 41)), first[text[s] + 1])
        runs.append(np.arange(s, e))
        made += e - s
    spliced = np.concatenate(runs)
    seqs = np.concatenate([first, first[-1] + np.append(np.arange(400, len(spliced), 400), len(spliced))])
    use = np.concatenate([np.arange(len(item)), spliced])
    model = crf.fit(labels, SIZE, cells[order], at, item[use], seqs, gold[use], epochs, rate=0.2)
    model.weights = model.weights.astype(np.float32)
    which = np.array([labels.index(r[2]) for r in rows])
    shares = np.concatenate([evidence([r[1] for r in rows[i : i + 50]], model, lexicon) for i in range(0, len(rows), 50)])
    return model, lexicon, weigh(shares, which)


def evidence(texts: list[str | None], model: crf.Model, lexicon: np.ndarray) -> np.ndarray:
    """(text, language, 3): a language's share of the letters by the words' marginals, in all, at the start, at the end."""
    cp, start, end, text = split([t or "" for t in texts])
    n, k = len(texts), len(model.labels)
    out = np.zeros((n, k, 3))
    if not len(start):
        return out
    first = np.searchsorted(text, np.arange(n + 1))
    s = scores(features(cp, start, end, lexicon), model.weights, len(start))
    p = crf.marginals(s.astype(float), model.trans, model.begin, first)
    at = np.arange(len(start))
    width = (end - start).astype(float)
    for i, use in enumerate((at >= 0, at - first[text] < ENDS, first[text + 1] - at <= ENDS)):
        w = width * use
        total = np.maximum(np.bincount(text, w, n), 1)
        for j in range(k):
            out[:, j, i] = np.bincount(text, p[:, j] * w, n) / total
    return out


def weigh(found: np.ndarray, gold: np.ndarray, steps: int = 300) -> np.ndarray:
    """Weights of a text's three shares by conditional logit: text spliced into another does not make its language."""
    w = np.array([5.0, 1.0, 1.0])
    for _ in range(steps):
        z = found @ w
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        gap = found[np.arange(len(gold)), gold] - np.einsum("nk,nkf->nf", p, found)
        w = np.maximum(w + 2.0 * gap.mean(axis=0) - 0.002 * w, 0)
    return w


def predict(texts: list[str | None], model: crf.Model, lexicon: np.ndarray, weights: np.ndarray) -> tuple[list[str], np.ndarray]:
    """(language, probability) of each text."""
    found = evidence(texts, model, lexicon)
    some = found[:, :, 0].sum(axis=1) > 0
    z = found @ weights
    p = np.exp(z - z.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    best = p.argmax(axis=1)
    return [model.labels[b] if s else "und" for b, s in zip(best, some)], np.where(some, p.max(axis=1), 0.0)


def word_languages(text: str, model: crf.Model, lexicon: np.ndarray) -> list[tuple[str, str, float]]:
    """(word, language, probability) of every word of one text."""
    cp, start, end, _ = split([text])
    s = scores(features(cp, start, end, lexicon), model.weights, len(start))
    p = crf.marginals(s.astype(float), model.trans, model.begin, np.array([0, len(start)]))
    chars = bytes(cp).decode("utf-32-le", "surrogatepass")
    return [(chars[a:b], model.labels[int(x.argmax())], float(x.max())) for a, b, x in zip(start, end, p)]


def held_out(id_: str, folds: int, fold: int):
    return F.coalesce(F.pmod(F.crc32(F.col(id_).cast("string")), F.lit(folds)) == fold, F.lit(False))


def identify(docs: DataFrame, sample_rows: int = SAMPLE_ROWS, folds: int = 5, fold: int = 0, languages: int = VALUES) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row of ``docs`` (doc_id, text, lang).

    The model learns every language (more than ``languages`` of them are an error) from at most ``sample_rows`` rows
    each, of those whose crc32(doc_id) mod ``folds`` is not ``fold`` and whose language and id are not null. Predictions see whole texts and nothing else. Texts that
    are null or have no letter, and all if nothing can be learned, are ``und`` with score 0. Rows with null ids are
    not held out. Duplicate ids are predicted row by row. Extra columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    known = docs.where(~held_out("doc_id", folds, fold) & (F.length("text") > 0)).select("doc_id", "lang")
    rows, _ = bounded(known, docs.select("doc_id", "text"), "lang", sample_rows, values=languages)
    fitted = fit(rows) if rows else None
    part_bytes = 6_000_000 // max(4, len(fitted[0].labels) if fitted else 0)  # a score for each word and language is held

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.diff(T.strings(batch.column("text"))[1])
            cut = np.flatnonzero(np.diff(np.cumsum(sizes) // part_bytes)) + 1
            for i, j in zip([0, *cut], [*cut, batch.num_rows]):
                part = batch.slice(i, j - i)
                texts = part.column("text").to_pylist()
                if fitted is None:
                    lang, score = ["und"] * len(texts), np.zeros(len(texts))
                else:
                    lang, score = predict(texts, *fitted)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(lang, pa.string()), pa.array(score)], names=["doc_id", "held_out", "lang_pred", "score"])

    return docs.select("doc_id", held_out("doc_id", folds, fold).alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
