"""Quality by naive Bayes support vectors over n-gram indicators.

Features are the runs of three bytes that a text has, once each, hashed to a fixed
number of columns, and its runs of three word shapes. Each is scaled by the logarithm of how much more often good
texts have it than bad ones, and the row is divided by the root of its number of
features, so that long texts do not weigh more. A linear hinge-loss model is
fitted on these rows by dual coordinate descent; its weights are drawn towards
their mean magnitude, as with naive Bayes alone. A logistic curve, fitted on
sample rows that the descent has not seen, turns the margin into a probability.

Cases: null and empty texts have no feature and get the curve's value at the
model's offset; with labels of one class only, or none, every score is the share
of good ones (0.5 without any); repeated rows each get a row; an empty table gives
no row; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.llm.common import fold, map_arrow, query, table
from tidegauge.llm.labelled import fit_sample
from tidegauge.llm.spans import Texts, slices, windows

GRAM, BITS = 3, 18
#: Columns of runs of three word shapes, after those of the byte runs. A shape has SHAPE_BITS yes-or-no marks.
SHAPE_BITS, RUN = 5, 3
COLUMNS = (1 << BITS) + (1 << SHAPE_BITS * RUN)


def _in(*ranges: range) -> np.ndarray:
    out = np.zeros(256, bool)
    for r in ranges:
        out[list(r)] = True
    return out


UPPER, LETTER = _in(range(65, 91)), _in(range(65, 91), range(97, 123), range(128, 256))


def shapes(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Owner and shape of every word: begins with a capital, has two or more, ends without a letter, is the word
    before, begins three words that the text had before."""
    starts, ends, borders = texts.words()
    words = texts.hashes(starts, ends)
    owner = np.repeat(np.arange(len(texts)), np.diff(borders))
    capitals = np.zeros(len(texts.data) + 1, np.int64)
    np.cumsum(UPPER[texts.data], out=capitals[1:])
    same = np.zeros(len(words), bool)
    same[1:] = (words[1:] == words[:-1]) & (owner[1:] == owner[:-1])
    run, at = windows(words, borders, RUN)
    order = np.lexsort((run, np.repeat(np.arange(len(texts)), np.diff(at))))
    of = np.repeat(np.arange(len(texts)), np.diff(at))[order]
    later = np.zeros(len(run), bool)
    later[order[1:]] = (run[order][1:] == run[order][:-1]) & (of[1:] == of[:-1])
    again = np.zeros(len(words), bool)
    again[np.repeat(borders[:-1] - at[:-1], np.diff(at)) + np.arange(len(run))] = later
    marks = (UPPER[texts.data[starts]], capitals[ends] - capitals[starts] > 1, ~LETTER[texts.data[ends - 1]], same, again)
    return owner, sum(m.astype(np.int64) << i for i, m in enumerate(marks))


def indicators(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Owner and column of the distinct n-grams of each text, by owner. N-grams do not cross from one text into the next."""
    inside = np.maximum(np.diff(texts.at) - GRAM + 1, 0)
    if not inside.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    size = len(texts.data) - GRAM + 1
    value = np.zeros(size, np.uint32)
    for k in range(GRAM):
        value = (value << np.uint32(8)) | texts.data[k : k + size]
    column = (value * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)
    owner = np.repeat(np.arange(len(texts)), inside)
    first = np.concatenate([[0], np.cumsum(inside)])[:-1]
    at = np.repeat(texts.at[:-1] - first, inside) + np.arange(len(owner))
    keys = np.sort(owner * COLUMNS + column[at])
    word_owner, shape = shapes(texts)
    full = np.flatnonzero(word_owner[RUN - 1 :] == word_owner[: len(word_owner) - RUN + 1])
    run = sum(shape[full + k] << SHAPE_BITS * k for k in range(RUN))
    keys = np.concatenate([keys[np.concatenate([[True], keys[1:] != keys[:-1]])], np.unique(word_owner[full] * COLUMNS + (1 << BITS) + run)])
    keys = np.sort(keys, kind="stable")
    return keys // COLUMNS, keys % COLUMNS


@dataclass
class QualityModel:
    weights: np.ndarray  # of the columns, with the log-count ratios multiplied in
    offset: float
    slope: float
    shift: float

    def probability(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -700, 700)))

    def score(self, texts: Texts) -> np.ndarray:
        owner, column = indicators(texts)
        n = np.bincount(owner, minlength=len(texts))
        sums = np.bincount(owner, self.weights[column], len(texts))
        return self.probability(sums / np.sqrt(np.maximum(n, 1)) + self.offset)


def log_count_ratio(rows: list[np.ndarray], good: np.ndarray, smoothing: float = 1.0) -> np.ndarray:
    """Of every column: logarithm of its share of the good texts' indicators by its share of the bad texts'."""
    of = [np.full(COLUMNS, smoothing), np.full(COLUMNS, smoothing)]
    for row, y in zip(rows, good):
        of[int(y)][row] += 1
    return np.log(of[1] / of[1].sum()) - np.log(of[0] / of[0].sum())


def descend(rows: list[np.ndarray], values: list[np.ndarray], sign: np.ndarray, cost: np.ndarray, epochs: int, seed: int) -> np.ndarray:
    """Weights (the last one is the offset) of the linear hinge-loss model, by coordinate descent on its dual."""
    weights, dual = np.zeros(COLUMNS + 1), np.zeros(len(rows))
    norm = np.array([v @ v + 1.0 for v in values])
    random = np.random.default_rng(seed)
    for _ in range(epochs):
        worst = 0.0
        for i in random.permutation(len(rows)):
            gradient = sign[i] * (weights[rows[i]] @ values[i] + weights[-1]) - 1
            new = min(max(dual[i] - gradient / norm[i], 0.0), cost[i])
            step = new - dual[i]
            if step:
                worst = max(worst, abs(gradient))
                dual[i] = new
                weights[rows[i]] += step * sign[i] * values[i]
                weights[-1] += step * sign[i]
        if worst < 1e-3:
            break
    return weights


def curve(margin: np.ndarray, good: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve from margin to probability, by Newton's method with smoothed targets."""
    n_good, n_bad = good.sum(), len(good) - good.sum()
    target = np.where(good == 1, (n_good + 1) / (n_good + 2), 1 / (n_bad + 2))
    a, b = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -700, 700)))
        g, h = p - target, np.maximum(p * (1 - p), 1e-9)
        step = np.linalg.solve(
            [[h @ (margin * margin) + 1e-3, h @ margin], [h @ margin, h.sum() + 1e-3]], [g @ margin + 1e-3 * (a - 1), g.sum() + 1e-3 * b]
        )
        a, b = a - np.clip(step[0], -1, 1), b - np.clip(step[1], -1, 1)
        if np.abs(step).max() < 1e-9:
            break
    return max(float(a), 1e-3), float(b)


def fit_quality(
    docs: DataFrame, labels: DataFrame, per_class: int = 6000, label: str = "quality", cost: float = 1.0, blend: float = 0.25, epochs: int = 20
) -> QualityModel:
    """The model of at most ``per_class`` labelled texts of each class; see ``fit_sample``.

    ``blend`` is the share of the fitted weights against their mean magnitude. One
    fifth of the sample, by id, fits the curve instead of the weights.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = []
            for _, _, texts in slices(batch.column(1)):
                owner, column = indicators(texts)
                borders = np.searchsorted(owner, np.arange(len(texts) + 1))
                packed += [column[a:b].astype(np.int32).tobytes() for a, b in zip(borders[:-1], borders[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(packed, pa.binary())], names=["doc_id", "label", "columns"]
            )

    sample = fit_sample(docs, labels, label, per_class)
    found = map_arrow(sample, read, "doc_id long, label int, columns binary").orderBy("doc_id", "columns").collect()
    rows = [np.frombuffer(r[2], np.int32) for r in found]
    good = np.array([r[1] for r in found], np.int64)
    if not len(good) or good.min() == good.max():
        share = float(good.mean()) if len(good) else 0.5
        return QualityModel(np.zeros(COLUMNS), 0.0, 1.0, float(np.log((share + 1e-6) / (1 - share + 1e-6))))
    aside = np.array([r[0] * 2654435761 % 1000 < 200 for r in found])
    if min(np.bincount(good[~aside], minlength=2)) == 0 or min(np.bincount(good[aside], minlength=2)) == 0:
        aside[:] = False
    fit = np.flatnonzero(~aside)
    ratio = log_count_ratio([rows[i] for i in fit], good[fit])
    values = [ratio[r] / np.sqrt(max(1, len(r))) for r in rows]
    each = cost * len(fit) / (2 * np.bincount(good[fit], minlength=2))
    raw = descend([rows[i] for i in fit], [values[i] for i in fit], 2.0 * good[fit] - 1, each[good[fit]], epochs, 0)
    used = np.abs(raw[:-1][raw[:-1] != 0])
    weights = (1 - blend) * (used.mean() if len(used) else 0.0) + blend * raw[:-1]
    judged = np.flatnonzero(aside) if aside.any() else fit
    margin = np.array([weights[rows[i]] @ values[i] + raw[-1] for i in judged])
    return QualityModel(weights * ratio, float(raw[-1]), *curve(margin, good[judged]))


def score_quality(docs: DataFrame, model: QualityModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and score, the probability that a label calls the text good, row by row."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [model.score(texts) for _, _, texts in slices(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate([np.zeros(0), *scores]))], names=["doc_id", "score"])

    return map_arrow(docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")), score, "doc_id long, score double")


@query("op4_quality")
def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score_quality(docs, fit_quality(docs, table(spark, sf_dir, "labels")))
    held_out = (fold(F.col("doc_id")) == 0).alias("held_out")
    return scored.select("doc_id", held_out, "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
