"""Toxicity by the nearest labelled examples under TF-IDF cosine over selected toxic terms.

Terms are runs of five bytes inside a word, its border included, in lower case.
From a bounded sample of labelled texts come the terms that toxic texts have
clearly more often, and the examples; all other terms are left out of the vectors
and their norms. How common a term is in the corpus (its
idf) is counted over all documents. The examples stand in an inverted index whose
postings are cut into blocks of neighbouring examples, each with the largest
weight of every term. A search adds up these bounds, visits blocks from the
highest on and ends when no other block can reach the k-th similarity: the result
is exact. The neighbours vote with their squared similarity; a logistic curve
fitted on votes that leave the example itself out makes the share a probability.

Cases: null and empty texts, and texts without a term, get the share of toxic ones
among such examples; without labels of both classes every score is that of the
class seen, or 0; ties go to the earlier example; repeated rows each get a row; an
empty table gives no row; further columns are ignored.
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
from tidegauge.llm.spans import Texts, slices

GRAM = 5
#: A term must be in this share of the toxic examples, and in so many of them, to be looked at.
LEAST_SHARE, LEAST_EXAMPLES = 0.004, 3
#: ... and be so many times as frequent there, with such a log-likelihood ratio (G squared).
LEAST_RATIO, LEAST_G2 = 4.0, 15.0


def _lower() -> np.ndarray:
    out = np.full(256, 32, np.uint8)
    out[97:123] = np.arange(97, 123)
    out[65:91] = np.arange(97, 123)
    out[128:] = np.arange(128, 256)
    return out


LOWER = _lower()


def grams(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Number of the text and value of every term, in order."""
    n, lengths = len(texts.data), np.diff(texts.at)
    flat = np.full(n + len(texts) + GRAM, 32, np.uint8)
    owner = np.repeat(np.arange(len(texts), dtype=np.int64), lengths)
    data = LOWER[texts.data]
    if n:  # capital letters of two bytes that begin with C3
        capital = (texts.data[1:] >= 0x80) & (texts.data[1:] <= 0x9E) & (texts.data[1:] != 0x97) & (texts.data[:-1] == 0xC3)
        data[1:][capital] += 0x20
    flat[np.arange(n) + owner + 1] = data
    letter = flat != 32
    size = len(flat) - GRAM + 1
    inner = letter[1 : 1 + size] & letter[2 : 2 + size] & letter[3 : 3 + size]
    at = np.flatnonzero(inner)
    value = np.zeros(len(at), np.uint64)
    for k in range(GRAM):
        value = (value << np.uint64(8)) | flat[at + k]
    borders = texts.at + np.arange(len(texts) + 1)
    return np.searchsorted(borders, at, "right") - 1, value


def term_counts(docs: DataFrame, wanted: np.ndarray | None = None) -> DataFrame:
    """term, n: in how many of the texts each term stands; of ``wanted`` terms only, if given (sorted)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, texts in slices(batch.column(0)):
                owner, value = grams(texts)
                if wanted is not None:
                    spot = np.minimum(np.searchsorted(wanted, value), len(wanted) - 1)
                    hit = wanted[spot] == value
                    owner, value = owner[hit], value[hit]
                both = np.unique((owner.astype(np.uint64) << np.uint64(8 * GRAM)) | value)
                term, n = np.unique(both & np.uint64((1 << 8 * GRAM) - 1), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(term.astype(np.int64)), pa.array(n.astype(np.int64))], names=["term", "n"])

    if wanted is not None and not len(wanted):
        return docs.sparkSession.createDataFrame([], "term long, n long")
    return map_arrow(docs.select("text"), count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))


def toxic_terms(sample: DataFrame, n_toxic: int, n_clean: int) -> np.ndarray:
    """Terms that toxic examples have clearly more often than clean ones, sorted.

    The driver gets the terms of a fixed share of the toxic examples, whose number
    is bounded by their mean number of terms over that share.
    """
    least = max(LEAST_EXAMPLES, LEAST_SHARE * n_toxic)
    toxic = {r[0]: r[1] for r in term_counts(sample.filter("label = 1")).filter(F.col("n") >= least).collect()}
    if not toxic or not n_clean:
        return np.zeros(0, np.uint64)
    wanted = np.array(sorted(toxic), np.uint64)
    clean = {r[0]: r[1] for r in term_counts(sample.filter("label = 0"), wanted).collect()}
    a = np.array([toxic[t] for t in wanted.tolist()], float)
    b = np.array([clean.get(t, 0) for t in wanted.tolist()], float)
    ratio = np.log((a + 0.5) / (n_toxic + 1)) - np.log((b + 0.5) / (n_clean + 1))
    share = (a + b) / (n_toxic + n_clean)

    def part(seen: np.ndarray, expected: np.ndarray) -> np.ndarray:
        return seen * np.log(np.maximum(seen, 1e-12) / np.maximum(expected, 1e-12))

    cells = ((a, n_toxic * share), (b, n_clean * share), (n_toxic - a, n_toxic * (1 - share)), (n_clean - b, n_clean * (1 - share)))
    return wanted[(ratio >= np.log(LEAST_RATIO)) & (2 * sum(part(x, y) for x, y in cells) >= LEAST_G2)]


class TermFinder:
    """Finds the terms of texts among known ones (sorted)."""

    BITS, SPREAD = 20, np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, terms: np.ndarray):
        self.terms = terms
        self.seen = np.zeros(1 << self.BITS, bool)
        self.seen[(terms * self.SPREAD) >> np.uint64(64 - self.BITS)] = True

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Borders of each text, and number in ``terms`` and times of each of its terms."""
        keys: list[np.ndarray] = [np.zeros(0, np.int64)]
        width = len(self.terms) + 1
        for begin, _, texts in slices(column):
            owner, value = grams(texts)
            hit = self.seen[(value * self.SPREAD) >> np.uint64(64 - self.BITS)]
            owner, value = owner[hit], value[hit]
            if len(value):
                spot = np.minimum(np.searchsorted(self.terms, value), width - 2)
                hit = self.terms[spot] == value
                keys.append((owner[hit] + begin) * width + spot[hit])
        key, times = np.unique(np.concatenate(keys), return_counts=True)
        return np.searchsorted(key, np.arange(len(column) + 1) * width), key % width, times


def term_vectors(docs: DataFrame, terms: np.ndarray, *also: str) -> DataFrame:
    """doc_id, terms (numbers in ``terms``, rising), times, and the columns in ``also``, one row per document."""
    finder = TermFinder(terms)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            borders, term, times = finder(batch.column(1))
            lists = [pa.ListArray.from_arrays(pa.array(borders.astype(np.int32)), pa.array(x.astype(np.int32))) for x in (term, times)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *lists, *batch.columns[2:]], names=["doc_id", "terms", "times", *also])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *also)
    more = "".join(f", {f.name} {f.dataType.simpleString()}" for f in rows.schema[2:])
    return map_arrow(rows, find, f"doc_id long, terms array<int>, times array<int>{more}")


@dataclass
class BlockMaxIndex:
    """Unit vectors of the examples as postings by term, in blocks of ``size`` neighbouring examples."""

    idf: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    first: np.ndarray  # of each term's postings in each block, terms by blocks + 1
    examples: np.ndarray
    weights: np.ndarray
    highest: np.ndarray  # of each term in each block
    size: int = 64

    @classmethod
    def build(cls, idf: np.ndarray, rows: list[tuple[int, list[int], list[int], int]], size: int = 64) -> tuple[BlockMaxIndex, list]:
        """The index of (id, terms, times, label) rows, and the terms and weights of each place."""
        weighed = [(i, np.array(t), unit(np.array(t), np.array(n), idf), y) for i, t, n, y in rows]
        # examples with the same strongest terms become neighbours, which keeps the bounds of other blocks low
        weighed.sort(key=lambda r: (tuple(r[1][np.argsort(-r[2], kind="stable")][:3].tolist()), r[3], r[0]))
        blocks = -(-len(weighed) // size)
        term = np.concatenate([r[1] for r in weighed] or [np.zeros(0, np.int64)]).astype(np.int64)
        example = np.repeat(np.arange(len(weighed)), [len(r[1]) for r in weighed])
        weight = np.concatenate([r[2] for r in weighed] or [np.zeros(0)])
        order = np.lexsort((example, term))
        term, example, weight = term[order], example[order], weight[order]
        cell = term * blocks + example // size
        first = np.searchsorted(cell, np.arange(len(idf) * blocks + 1))
        highest = np.zeros(len(idf) * blocks)
        np.maximum.at(highest, cell, weight)
        index = cls(
            idf, np.array([r[0] for r in weighed], np.int64), np.array([r[3] for r in weighed], np.int64),
            first, example, weight, highest.reshape(len(idf), blocks), size,
        )
        return index, [(r[1], r[2]) for r in weighed]

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int, but: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Places and similarities of the ``k`` most similar examples, highest first, ties to the earlier place."""
        blocks = self.highest.shape[1]
        bound = weights @ self.highest[terms]
        order = np.argsort(-bound, kind="stable")
        places, found = np.zeros(0, np.int64), np.zeros(0)
        least = 0.0
        for block in order:
            if bound[block] <= 0 or len(found) >= k and bound[block] < least - 1e-9:
                break
            sums = np.zeros(self.size)
            for t, w in zip(terms, weights):
                cell = t * blocks + block
                lo, hi = self.first[cell], self.first[cell + 1]
                sums[self.examples[lo:hi] - block * self.size] += w * self.weights[lo:hi]
            here = np.flatnonzero(sums > 0) + block * self.size
            here = here[here != but]
            places, found = np.concatenate([places, here]), np.concatenate([found, sums[here - block * self.size]])
            if len(found) > k:
                # rounded so that equal vectors tie whatever the order of additions
                best = np.lexsort((places, -np.round(found, 9)))[:k]
                places, found = places[best], found[best]
            if len(found) >= k:
                least = found.min()
        best = np.lexsort((places, -np.round(found, 9)))
        return places[best], found[best]


def unit(terms: np.ndarray, times: np.ndarray, idf: np.ndarray) -> np.ndarray:
    raw = (1 + np.log(times)) * idf[terms]
    return raw / np.sqrt(raw @ raw)


def vote(labels: np.ndarray, similar: np.ndarray, prior: float) -> float:
    """Share of the toxic among neighbours, weighted by squared similarity, with half a vote for the prior."""
    weight = np.minimum(similar, 1.0) ** 2
    return float((weight @ labels + 0.5 * prior) / (weight.sum() + 0.5))


def logistic(votes: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the curve from a vote's log odds to a probability, by Newton's method with smoothed targets."""
    toxic, clean = labels.sum(), len(labels) - labels.sum()
    if not toxic or not clean:
        return 1.0, 0.0
    x = odds(votes)
    target = np.where(labels == 1, (toxic + 1) / (toxic + 2), 1 / (clean + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-(a * x + b)))
        g, h = p - target, np.maximum(p * (1 - p), 1e-9)
        hessian = np.array([[h @ (x * x) + 1e-3, h @ x], [h @ x, h.sum() + 1e-3]])
        step = np.linalg.solve(hessian, [g @ x + 1e-3 * (a - 1), g.sum() + 1e-3 * b])
        a, b = a - np.clip(step[0], -1, 1), b - np.clip(step[1], -1, 1)
        if np.abs(step).max() < 1e-9:
            break
    return max(float(a), 0.05), float(b)


def odds(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


@dataclass
class ToxicityModel:
    """What every task needs to score texts; its size is bounded by the labelled sample."""

    terms: np.ndarray
    index: BlockMaxIndex
    k: int
    prior: float
    bare_score: float
    slope: float
    offset: float

    def score(self, terms: tuple[int, ...], times: tuple[int, ...]) -> tuple[float, list[int], float]:
        if not terms:
            return self.bare_score, [], 0.0
        own = np.array(terms)
        near, similar = self.index.nearest(own, unit(own, np.array(times), self.index.idf), self.k)
        raw = vote(self.index.labels[near], similar, self.prior)
        value = 1 / (1 + np.exp(-(self.slope * odds(np.array(raw)) + self.offset)))
        return float(value), self.index.ids[near].tolist(), float(similar[0]) if len(similar) else 0.0


def fit_toxicity(docs: DataFrame, labels: DataFrame, k: int = 15, per_class: int = 6000, label: str = "toxic") -> ToxicityModel:
    """The model of at most ``per_class`` labelled examples of each class, with idf counted over all of ``docs``."""
    sample = fit_sample(docs, labels, label, per_class)
    n = {r[0]: r[1] for r in sample.groupBy("label").count().collect()}
    terms = toxic_terms(sample, n.get(1, 0), n.get(0, 0))
    in_corpus = np.zeros(len(terms))
    for term, times in term_counts(docs, terms).collect():
        in_corpus[np.searchsorted(terms, np.uint64(term))] = times
    idf = np.log((1 + docs.count()) / (1 + in_corpus)) + 1.0
    # the examples are bounded by the sample, so that their vectors may be gathered
    examples = [tuple(r) for r in term_vectors(sample, terms, "label").orderBy("doc_id", "terms", "times", "label").collect()]
    bare = [r for r in examples if not r[1]]
    index, placed = BlockMaxIndex.build(idf, [r for r in examples if r[1]])
    prior = sum(r[3] for r in examples) / max(1, len(examples))
    bare_score = (sum(r[3] for r in bare) + prior) / (len(bare) + 1)
    votes = []
    for place, (t, weights) in enumerate(placed):
        near, similar = index.nearest(t, weights, k, place)
        votes.append(vote(index.labels[near], similar, prior))
    slope, offset = logistic(np.array(votes), index.labels) if votes else (1.0, 0.0)
    return ToxicityModel(terms, index, k, prior, bare_score, slope, offset)


def score_toxicity(docs: DataFrame, model: ToxicityModel, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, score, evidence (ids of the nearest examples), similarity of the nearest, and the columns in ``carry``, row by row."""
    inner = [f"carry_{i}" for i in range(len(carry))]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *[F.col(c).alias(i) for c, i in zip(carry, inner)])
    finder = TermFinder(model.terms)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple, tuple[float, list[int], float]] = {}
        for batch in batches:
            borders, term, times = finder(batch.column(1))
            out = []
            for a, b in zip(borders[:-1], borders[1:]):
                key = (tuple(term[a:b].tolist()), tuple(times[a:b].tolist()))
                if key not in known:
                    if len(known) > 20_000:  # bounds memory, not results
                        known.clear()
                    known[key] = model.score(*key)
                out.append(known[key])
            columns = list(zip(*out)) or [(), (), ()]
            kinds = (pa.float64(), pa.list_(pa.int64()), pa.float64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, kind) for c, kind in zip(columns, kinds)], *batch.columns[2:]],
                names=["doc_id", "score", "evidence", "similarity", *inner],
            )

    more = "".join(f", {f.name} {f.dataType.simpleString()}" for f in rows.schema[2:])
    scored = map_arrow(rows, score, f"doc_id long, score double, evidence array<long>, similarity double{more}")
    return scored.select("doc_id", "score", "evidence", "similarity", *[F.col(i).alias(c) for c, i in zip(carry, inner) if c != "doc_id"])


@query("op7_toxicity")
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score_toxicity(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id",
        (fold(F.col("doc_id")) == 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        "evidence",
        "similarity",
    )
