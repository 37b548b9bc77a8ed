"""Document quality from a linear-chain conditional random field that labels every line good or bad."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.llm import crf
from cohortspark.llm import textops as T
from cohortspark.llm.langid import held_out
from cohortspark.llm.sample import bounded

#: Labelled rows of either label at most that the model is fitted on.
SAMPLE_ROWS = 1500
THRESHOLD = 0.7
BINS = 12
_ONES = np.arange(256)
UPPER = (_ONES >= 65) & (_ONES <= 90)
LOWER = (_ONES >= 97) & (_ONES <= 122)
DIGIT = (_ONES >= 48) & (_ONES <= 57)
SPACE = ~T.NOT_SPACE
HIGH = (_ONES >= 0xC3) & (_ONES < 0xF8)
INNER = (_ONES >= 0x80) & (_ONES < 0xC0)
STOP = np.isin(_ONES, [33, 63, 46, 44, 59, 58])
BANG = np.isin(_ONES, [33, 63])
SYMBOL = ~(UPPER | LOWER | DIGIT | SPACE | (_ONES >= 128) | STOP)
BAR = np.isin(_ONES, [124, 60, 62, 123, 125, 92])


def lines(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets of all lines and of each text's lines; a text that ends has a last line, if only an empty one."""
    cut = np.flatnonzero(raw == T.NEWLINE) + 1
    at = np.union1d(cut, off) if len(cut) else np.unique(off)
    # texts without bytes have one empty line
    first = np.searchsorted(at, off[:-1])
    stop = np.searchsorted(at, off[1:])
    count = np.maximum(stop - first, 1)
    start = np.concatenate([at[f:s] if s > f else off[i : i + 1] for i, (f, s) in enumerate(zip(first, stop))]) if len(first) else np.zeros(0, np.int64)
    seq = np.concatenate([[0], np.cumsum(count)])
    end = np.append(start[1:], off[-1]) if len(start) else start
    end[seq[1:] - 1] = off[1:]
    return np.stack([start, end], axis=1), seq


def _sum(mask: np.ndarray, span: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(mask)])
    return (total[span[:, 1]] - total[span[:, 0]]).astype(float)


def _bin(x: np.ndarray, top: float = 1.0) -> np.ndarray:
    """Bins of a ratio: 0 alone, then equal parts, then all from ``top`` on."""
    return np.where(x <= 0, 0, 1 + np.minimum((x / top * (BINS - 2)).astype(np.int64), BINS - 2))


def traits(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Binned traits of every line, the lines' lengths, and the offsets of each text's lines."""
    span, seq = lines(raw, off)
    n = len(span)
    length = (span[:, 1] - span[:, 0]).astype(float)
    w = T.words(raw, off)
    line = np.searchsorted(span[:, 0], w.start, "right") - 1
    count = np.bincount(line, minlength=n).astype(float)
    capital = UPPER[raw]
    capital[1:] |= (raw[:-1] == 0xC3) & (raw[1:] <= 0x9E) & (raw[1:] >= 0x80)
    upper, letter = _sum(capital, span), _sum(UPPER[raw] | LOWER[raw] | HIGH[raw], span)
    letters = np.maximum(letter, 1)
    ink = np.maximum(_sum(T.NOT_SPACE[raw] & ~INNER[raw], span), 1)
    some = np.maximum(count, 1)
    like = np.zeros(len(line), bool)
    like[1:] = (w.hash[1:] == w.hash[:-1]) & (line[1:] == line[:-1])
    echo = np.bincount(line[like], minlength=n).astype(float)
    key = (line.astype(T.U) << T.U(40)) | (w.hash >> T.U(24))
    different = np.unique(key)
    distinct = np.bincount((different >> T.U(40)).astype(np.int64), minlength=n)
    whole = T.mix(T.sums(T.mix(w.hash + (np.arange(len(w.hash), dtype=T.U) - np.searchsorted(line, line).astype(T.U)) * T.U(0x9E3779B97F4A7C15)), np.searchsorted(line, np.arange(n + 1))))
    text = np.repeat(np.arange(len(seq) - 1), np.diff(seq))
    same = T.mix(whole + text.astype(T.U))
    _, first, back = np.unique(same, return_index=True, return_inverse=True)
    again = np.where((first[back] < np.arange(n)) & (count > 0), 1, 0)
    often = np.bincount(back)[back]
    place = np.arange(n) - seq[text]
    left = seq[text + 1] - 1 - np.arange(n)
    own = np.stack(
        [
            _bin(upper / letters),
            _bin(_sum(SYMBOL[raw], span) / ink, 0.5),
            _bin(_sum(STOP[raw], span) / some, 1.2),
            _bin(_sum(BANG[raw], span) / some, 1.2),
            _bin(ink / some, 16),
            np.minimum(np.log2(count + 1).astype(np.int64), BINS - 1),
            _bin(_sum(DIGIT[raw], span) / ink, 0.5),
            _bin(_sum(BAR[raw], span) / some, 0.5),
            _bin(1 - distinct / some),
            again,
            np.minimum(often, BINS) - 1,
            np.where(left == 0, 2, np.where(place == 0, 1, 0)) + 3 * np.minimum(np.log2(np.diff(seq)[text]).astype(np.int64), 2),
            _bin(1 - (letters / ink), 0.5),
            np.minimum(np.log2(length + 1).astype(np.int64), BINS - 1),
            _bin(echo / some),
        ],
        axis=1,
    )
    return own, length, seq


NEAR = (0, 1, 3, 5, 8, 9, 12, 14)
TRAITS = 15
SIZE = (TRAITS + 2 * len(NEAR)) * (BINS + 1)


def features(own: np.ndarray, seq: np.ndarray) -> np.ndarray:
    """Feature numbers of every line: its own traits and its neighbours' (a bin apart where there is none)."""
    n = len(own)
    text = np.repeat(np.arange(len(seq) - 1), np.diff(seq))
    near = own[:, NEAR]
    before = np.full_like(near, BINS)
    after = np.full_like(near, BINS)
    if n > 1:
        inner = text[1:] == text[:-1]
        before[1:][inner] = near[:-1][inner]
        after[:-1][inner] = near[1:][inner]
    allx = np.concatenate([own, before, after], axis=1)
    return allx + np.arange(allx.shape[1]) * (BINS + 1)


def _summary(p: np.ndarray, length: np.ndarray, seq: np.ndarray) -> np.ndarray:
    """Per text: length-weighted mean of P(good), its log odds, the worst line's, the share of lines likely bad, one."""
    weight = length + 1
    total = np.add.reduceat(weight, seq[:-1])
    mean = np.add.reduceat(p * weight, seq[:-1]) / total
    worst = np.minimum.reduceat(np.where(length > 20, p, 1.0), seq[:-1])
    bad = np.add.reduceat((p < 0.5) * weight, seq[:-1]) / total
    m, q = np.clip(mean, 1e-4, 1 - 1e-4), np.clip(worst, 1e-4, 1 - 1e-4)
    return np.stack([np.log(m / (1 - m)), np.log(q / (1 - q)), mean, bad, np.ones(len(m))], axis=1)


def _logistic(x: np.ndarray, y: np.ndarray, each: np.ndarray, steps: int = 50) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (each * (y - p)) - 0.05 * w
        h = (x * (each * p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(len(w))
        w = w + np.linalg.solve(h, g)
    return w


def fit(rows: list[tuple], counts: dict[int, int] | None = None, rounds: int = 2, epochs: int = 40) -> tuple[crf.Model, np.ndarray] | None:
    """A model from (doc_id, text, label) rows, label 1 for good; ``counts``: rows of either label in all.

    Lines first carry their text's label. As a bad text may hold good lines, its lines that the model finds good
    are then relabelled, its worst line excepted, and the model is fitted anew.
    """
    if not rows:
        return None
    y = np.array([int(r[2]) for r in rows])
    parts = [traits(raw, off) for i in range(0, len(rows), 100) for raw, off in [_joined([r[1] for r in rows[i : i + 100]])]]
    length = np.concatenate([p[1] for p in parts])
    seq = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(p[2]) for p in parts]))])
    cell = np.concatenate([features(p[0], p[2]) for p in parts])
    distinct, item = np.unique(cell, axis=0, return_inverse=True)
    item = item.ravel()
    at = np.arange(len(distinct) + 1) * cell.shape[1]
    text = np.repeat(np.arange(len(y)), np.diff(seq))
    gold = y[text]
    for _ in range(rounds):
        model = crf.fit([0, 1], SIZE, distinct.ravel(), at, item, seq, gold, epochs)
        p = _good(model, cell, seq)
        worst = np.minimum.reduceat(p, seq[:-1])
        gold = np.where(y[text] == 1, 1, ((p > 0.5) & (p > worst[text])).astype(np.int64))
    here = np.bincount(y, minlength=2)
    share = np.array([(counts or {}).get(k, here[k]) for k in (0, 1)]) / np.maximum(here, 1)
    return model, _logistic(_summary(p, length, seq), y, share[y] / share[y].mean())


def _joined(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    return T.strings(pa.array(texts, pa.large_string()))


def _good(model: crf.Model, cell: np.ndarray, seq: np.ndarray) -> np.ndarray:
    s = model.weights[cell.ravel()].reshape(len(cell), cell.shape[1], 2).sum(axis=1)
    return crf.marginals(s, model.trans, model.begin, seq)[:, 1]


def score(raw: np.ndarray, off: np.ndarray, model: crf.Model, weights: np.ndarray) -> np.ndarray:
    """P(label 1) of each text."""
    if len(off) < 2:
        return np.zeros(0)
    own, length, seq = traits(raw, off)
    p = _good(model, features(own, seq), seq)
    return 1 / (1 + np.exp(-np.clip(_summary(p, length, seq) @ weights, -30, 30)))


def fitted(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, folds: int = 4, fold: int = 2):
    """The model from at most ``sample_rows`` rows of either label; ids with both labels are left out."""
    given = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("quality in (0, 1)")
    clear = given.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("most")).where("quality = most").drop("most")
    return fit(*bounded(clear.where(~held_out("doc_id", folds, fold)), docs, "quality", sample_rows))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample_rows: int = SAMPLE_ROWS, folds: int = 4, fold: int = 2) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs`` (doc_id, text).

    The model learns from at most ``sample_rows`` rows of either label, of those whose crc32(doc_id) mod ``folds`` is
    not ``fold``. Scores see whole texts and nothing else; null and empty texts are one empty line, scored as such.
    Without labels every score is 0.5. Rows with null ids are not held out; duplicate ids are scored row by row.
    Extra columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    model = fitted(docs, labels, sample_rows, folds, fold)
    rows = docs.select("doc_id", held_out("doc_id", folds, fold).alias("held_out"), "text").mapInArrow(_scorer(model), "doc_id long, held_out boolean, score double")
    return rows.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of ``docs`` whose score reaches ``threshold``, with all their columns."""
    model = fitted(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), labels, sample_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, raw, off in T.pieces(batch.column("text")):
                p = score(raw, off, *model) if model else np.full(len(off) - 1, 1.0)
                yield batch.slice(at, len(off) - 1).filter(pa.array(p >= threshold))

    return docs.mapInArrow(run, docs.schema)


def _scorer(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, raw, off in T.pieces(batch.column("text")):
                p = score(raw, off, *model) if model else np.full(len(off) - 1, 0.5)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, len(p)), batch.column("held_out").slice(at, len(p)), pa.array(p)], names=["doc_id", "held_out", "score"])

    return run
