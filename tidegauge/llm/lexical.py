"""Exact ranked lexical search over posting lists that are blocked by the likeness of their documents.

A document scores the sum of what it holds of the query's terms; a term in a
document has a whole-number impact made of the term's weight, its occurrences and
the document's length. The terms of a block of queries are known, so documents are
read once and kept as counts of those terms, in the shared folder. Corpus figures
(documents, terms, holders of each term) are counted over all documents.

Documents are searched in segments of bounded size, as they come, without a
shuffle. In a segment,

* the posting list of a term is cut into blocks by geometry: its documents go to
  the nearest of some of them, by the product of their (projected) impact vectors;
* each block stores the largest impact of every term among its documents, so that
  query times summary is at least the score of each of them;
* lists are visited from the largest impact on. A query leaves as soon as all that
  the remaining lists can add is below its k-th score; in a list that it visits, it
  scores the blocks whose bound reaches its k-th score, the best one first.

Scores are whole numbers below 2**53 in double arithmetic, else 64-bit integers,
so bounds and scores are exact, and only a bound below the k-th score skips. That
starts from a bounded sample of documents: the k-th score among them is reached by
k documents for certain, so it can only hide what is no result. Blocks are made
when a query first needs their list; lists of frequent terms mostly never are.

Cases: a null or empty text has no term, nor is such a document counted; a text is
used whole, whatever its length; each row counts as a document of its own, also
repeated ones, but a doc_id is listed once, with its best score; rows without an id
are counted and never listed; of several texts of one item the smallest asks; items
without an id or a term have no rows; equal scores go by doc_id; an empty table
gives no row; further columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegauge.llm.common import cut, map_arrow, query, table

#: Documents of a block, (document, term) cells of a segment, dimensions that likeness is judged in.
BLOCK, CELLS, SKETCH = 4, 8_000_000, 32
#: Documents that starting thresholds come from, and (item, term) pairs that are searched at once.
SAMPLE, PAIRS = 8192, 500_000

#: Every byte as it counts: upper case as lower, what is not part of a term as a blank.
_PLAIN = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256)
)


def terms(text: str | bytes | None) -> list[bytes]:
    """The terms of a text in their order, as UTF-8."""
    data = text.encode() if isinstance(text, str) else text or b""
    return data.translate(_PLAIN).split()


def weights(n_docs: int, holders: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(d) + 1))) for d in holders], np.int64)


def impacts(weight: np.ndarray, times: np.ndarray, length: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """What each (term, document) adds to a score, given the term's weight and times and the document's length."""
    m = 25 + (75 * length.astype(np.int64) * n_docs) // max(1, n_terms)
    return weight * ((1_000_000_000 * times.astype(np.int64)) // (1000 * times.astype(np.int64) + 8 * m))


class Queries:
    """A block of queries: for each, its places in the vocabulary and how often it has each term."""

    def __init__(self, ids: list[int], places: list[np.ndarray], times: list[np.ndarray], k: int):
        self.ids, self.places, self.times, self.k = ids, places, times, k
        self.flat_place = np.concatenate([np.zeros(0, np.int64), *places])
        self.flat_times = np.concatenate([np.zeros(0, np.int64), *times])
        self.flat_query = np.repeat(np.arange(len(ids)), [len(p) for p in places])

    def exact_in_doubles(self, weight: np.ndarray) -> bool:
        return all(int((t * weight[p]).sum()) * 1_000_000 < 1 << 53 for p, t in zip(self.places, self.times))


class Search:
    """Best documents of each query so far; ``blocks`` and ``scored`` count what was bounded and what was scored."""

    def __init__(self, queries: Queries, least: np.ndarray):
        self.queries = queries
        self.least = np.maximum(least, 1)  # scores of 0 are no results
        self.best: list[dict[int, int]] = [{} for _ in queries.ids]
        self.blocks = self.skipped = self.scored = self.pairs = 0

    def keep(self, q: int, ids: np.ndarray, scores: np.ndarray) -> None:
        good = np.flatnonzero(scores >= self.least[q])
        if not len(good):
            return
        best = self.best[q]
        for i, s in zip(ids[good].tolist(), scores[good].tolist()):
            if best.get(i, 0) < s:
                best[i] = int(s)
        if len(best) >= self.queries.k:
            ranked = sorted(best.items(), key=lambda x: (-x[1], x[0]))[: self.queries.k]
            self.best[q] = dict(ranked)
            self.least[q] = max(self.least[q], ranked[-1][1])

    def segment(self, ids: np.ndarray, row: np.ndarray, place: np.ndarray, impact: np.ndarray, n_places: int, kind) -> None:
        """Searches documents ``ids``; ``row``, ``place`` and ``impact`` are their terms, with row numbers that rise."""
        queries, n = self.queries, len(ids)
        grid = np.zeros((n_places, n), kind)
        grid[place, row] = impact
        highest = grid.max(axis=1) if n else np.zeros(n_places, kind)
        by_place = np.argsort(place, kind="stable")
        borders = np.searchsorted(place[by_place], np.arange(n_places + 1))
        sketch = _sketches(grid)
        # what a query can still gain from each of its lists on, lists in falling order of their largest impact
        adds = highest[queries.flat_place] * queries.flat_times
        order = np.lexsort((queries.flat_place, -highest[queries.flat_place], queries.flat_query))
        sums = np.cumsum(adds[order][::-1])[::-1]
        after = np.append(sums, 0)[np.searchsorted(queries.flat_query[order], queries.flat_query[order], "right")]
        gain = np.empty_like(sums)
        gain[order] = sums - after
        done = np.zeros((len(queries.ids), n), bool)
        self.pairs += n * len(queries.ids)
        visit = np.lexsort((queries.flat_place, -highest[queries.flat_place]))
        own = queries.flat_place[visit]
        edges = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1], [True]])) if len(own) else np.zeros(1, np.int64)
        for begin, end in zip(edges[:-1], edges[1:]):
            asked = visit[begin:end]
            asking = queries.flat_query[asked]
            asking = asking[(gain[asked] >= self.least[asking]) & (gain[asked] > 0)].tolist()
            if not asking:
                continue
            at = own[begin]
            members, starts = blocks(row[by_place[borders[at] : borders[at + 1]]], sketch)
            ends = np.append(starts[1:], len(members))
            # summaries hold the coordinates that any of these queries has
            held = np.unique(np.concatenate([queries.places[q] for q in asking]))
            summary = np.maximum.reduceat(grid[held[:, None], members], starts, axis=1)
            for q in asking:
                places, times = queries.places[q], queries.times[q].astype(kind)
                bound = times @ summary[np.searchsorted(held, places)]
                self._list(q, ids, grid, places, times, members, starts, ends, bound, done[q])

    def _list(self, q, ids, grid, places, times, members, starts, ends, bound, done) -> None:
        """Scores the documents of the blocks whose bound reaches the query's k-th score, the best blocks first."""
        order = np.flatnonzero(bound >= self.least[q])
        order = order[np.argsort(-bound[order], kind="stable")]
        self.blocks += len(bound)
        at, step, scored = 0, 1, 0
        while at < len(order) and bound[order[at]] >= self.least[q]:
            chosen = order[at : at + step]
            chosen = chosen[bound[chosen] >= self.least[q]]
            docs = np.concatenate([members[starts[b] : ends[b]] for b in chosen.tolist()])
            docs = docs[~done[docs]]
            if len(docs):
                done[docs] = True
                self.scored += len(docs)
                self.keep(q, ids[docs], times @ grid[places[:, None], docs])
            at += len(chosen)
            scored += len(chosen)
            step *= 4
        self.skipped += len(bound) - scored

    def rows(self) -> list[tuple[int, int, int]]:
        return [(self.queries.ids[q], i, s) for q, best in enumerate(self.best) for i, s in best.items()]


def _sketches(grid: np.ndarray) -> np.ndarray:
    """A unit vector for each document (column), close in direction where documents are: a seeded random projection."""
    signs = np.random.default_rng(len(grid)).choice(np.array([-1.0, 1.0], np.float32), (SKETCH, len(grid)))
    out = (signs @ grid.astype(np.float32)).T
    return out / np.maximum(np.sqrt((out**2).sum(axis=1, keepdims=True)), 1e-30)


def blocks(members: np.ndarray, sketch: np.ndarray, size: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """The members of a list ordered by block, and where each block starts: like documents share a block of at most ``size``."""
    if len(members) <= size:
        return members, np.zeros(1, np.int64)
    own = sketch[members]
    heads = own[:: max(1, size // 2)]
    near = own @ heads.T
    head = near.argmax(axis=1)
    order = np.lexsort((-near[np.arange(len(own)), head], head))
    head = head[order]
    first = np.flatnonzero(np.concatenate([[True], head[1:] != head[:-1]]))
    since = np.arange(len(head)) - np.repeat(first, np.diff(np.append(first, len(head))))
    return members[order], np.flatnonzero(since % size == 0)


def _counted(docs: DataFrame, vocabulary: list[bytes]) -> DataFrame:
    """doc_id, n (terms of the document) and the places and times of those of the vocabulary, written once."""
    at = {t: i for i, t in enumerate(vocabulary)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = at.keys()
        for batch in batches:
            n, places, times, borders = [], [], [], [0]
            for text in batch.column(1).cast(pa.binary()).to_pylist():
                own = terms(text)
                found = Counter(own)
                n.append(len(own))
                held = sorted(at[t] for t in known & found.keys())
                places += held
                times += [found[vocabulary[p]] for p in held]
                borders.append(len(places))
            lists = [pa.ListArray.from_arrays(pa.array(borders, pa.int32()), pa.array(x, k)) for x, k in ((places, pa.int32()), (times, pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), *lists], names=["doc_id", "n", "places", "times"])

    return cut(map_arrow(docs.select("doc_id", "text"), count, "doc_id long, n long, places array<int>, times array<long>").filter("n > 0"))


def _figures(counted: DataFrame, n_places: int) -> tuple[int, int, np.ndarray]:
    """Documents, their terms, and the holders of each term of the vocabulary."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_places + 2, np.int64)
        for batch in batches:
            places = np.asarray(batch.column(1).flatten(), np.int64)
            total[:n_places] += np.bincount(places, minlength=n_places)
            total[n_places] += batch.num_rows
            total[n_places + 1] += int(np.asarray(batch.column(0)).sum())
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["place", "n"])

    out = np.zeros(n_places + 2, np.int64)
    for r in counted.select("n", "places").mapInArrow(add, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).collect():
        out[r[0]] = r[1]
    return int(out[n_places]), int(out[n_places + 1]), out[:n_places]


def _best(counted: DataFrame, queries: Queries, weight: np.ndarray, n_docs: int, n_terms: int, least: np.ndarray) -> DataFrame:
    """item_id, doc_id, score, ranked by ``rank``: the best documents of each query that reach its ``least``."""
    n_places = len(weight)
    kind = np.float64 if queries.exact_in_doubles(weight) else np.int64
    size = max(1, CELLS // max(1, n_places))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(queries, least)
        for batch in batches:
            for begin in range(0, batch.num_rows, size):
                part = batch.slice(begin, size)
                lengths = pa.compute.list_value_length(part.column(2)).to_numpy()
                row = np.repeat(np.arange(part.num_rows), lengths)
                place = np.asarray(part.column(2).flatten(), np.int64)
                times = np.asarray(part.column(3).flatten(), np.int64)
                impact = impacts(weight[place], times, np.asarray(part.column(1))[row], n_docs, n_terms)
                search.segment(np.asarray(part.column(0)), row, place, impact, n_places, kind)
        rows = search.rows()
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.int64()) for c in range(3)], names=["item_id", "doc_id", "score"])

    found = counted.filter("doc_id is not null").mapInArrow(find, "item_id long, doc_id long, score long")
    found = found.groupBy("item_id", "doc_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")).cast("int")
    return found.withColumn("rank", rank).filter(F.col("rank") <= queries.k).select("item_id", "rank", "doc_id", "score")


def _asked(items: DataFrame) -> DataFrame:
    """item_id, term, times of the items, written once."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, t, n) for i, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for t, n in Counter(terms(x)).items()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.int64())],
                names=["item_id", "term", "times"],
            )

    one = items.filter("item_id is not null").groupBy("item_id").agg(F.min("text").alias("text"))
    return cut(map_arrow(one, count, "item_id long, term binary, times long"))


def search(docs: DataFrame, items: DataFrame, k: int = 10, sample: int = SAMPLE, pairs: int = PAIRS) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` best of ``docs`` (doc_id, text) for each of ``items`` (item_id, text).

    Items are searched in blocks of about ``pairs`` (item, term) pairs, which is what
    the driver and every task hold of them.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    asked = _asked(items.select(F.col("item_id").cast("long").alias("item_id"), "text"))
    n_blocks = -(-asked.count() // pairs)
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for block in range(n_blocks):
        rows = asked.filter(F.pmod(F.xxhash64("item_id"), F.lit(n_blocks)) == block).orderBy("item_id", "term").collect()
        if not rows:
            continue
        vocabulary = sorted({bytes(r.term) for r in rows})
        at = {t: i for i, t in enumerate(vocabulary)}
        by_item: dict[int, list[tuple[int, int]]] = {}
        for r in rows:
            by_item.setdefault(r.item_id, []).append((at[bytes(r.term)], r.times))
        places = [np.array([p for p, _ in x], np.int64) for x in by_item.values()]
        queries = Queries(list(by_item), places, [np.array([n for _, n in x], np.int64) for x in by_item.values()], k)
        counted = _counted(docs, vocabulary)
        n_docs, n_terms, holders = _figures(counted, len(vocabulary))
        weight = weights(n_docs, holders)
        least = np.zeros(len(queries.ids), np.int64)
        if (share := n_docs // sample) > 1:
            some = counted.filter(F.pmod(F.xxhash64("doc_id", "n"), F.lit(share)) == 0)
            reached = _best(some, queries, weight, n_docs, n_terms, least).filter(F.col("rank") == k).select("item_id", "score")
            of = {i: q for q, i in enumerate(queries.ids)}
            for r in reached.collect():
                least[of[r[0]]] = r[1]
        out = out.unionByName(_best(counted, queries, weight, n_docs, n_terms, least))
    return out


SQL = r"""
with words as (
  select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from documents),
asks as (
  select item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark),
held as (select doc_id, term, count(*)::bigint as tf from words group by doc_id, term),
lengths as (select doc_id, sum(tf)::bigint as own from held group by doc_id),
corpus as (select count(*)::bigint as docs, sum(own)::bigint as total from lengths),
weighed as (
  select term, floor(1000 * ln((2 * docs + 2)::double / (2 * count(*) + 1)::double))::bigint as w
  from held, corpus group by term, docs),
asked as (select item_id, term, count(*)::bigint as times from asks group by item_id, term),
scored as (
  select item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * own * docs) // total))))::bigint as score
  from asked join held using (term) join weighed using (term) join lengths using (doc_id), corpus
  group by item_id, doc_id),
ranked as (select *, row_number() over (partition by item_id order by score desc, doc_id)::int as rank from scored where score > 0)
select item_id, rank, doc_id, score from ranked where rank <= 10
"""


@query("op13_lexical", SQL)
def op13_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
