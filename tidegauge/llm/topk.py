"""Exact top-k search by inner product as a Voronoi kNN join.

Pivots are chosen from a bounded sample. Every vector belongs to the cell of its
nearest pivot. Summaries of the cells are all the driver sees: for queries their
number, the largest distance to the pivot and the largest norm; for data the
``k + 1`` smallest distances to the pivot. For a query q of cell i and a vector x
of cell j at distance r from its pivot,

    p_i.p_j - U_i |p_j| - N_i r  <=  q.x  <=  p_i.p_j + U_i |p_j| + N_i r

with U_i and N_i the largest distance and norm in cell i. The lower bounds of the
summaries give a score that each query of cell i reaches k times for certain; data
whose upper bound is below it are not sent there. Query cells are gathered into
groups of bounded size, larger cells are split. The data sent to a group come in
chunks of bounded size; a task holds one group and one chunk and returns the best
k of the chunk for each query, from which the best k in all follow.

Cases: vectors that are null or hold null or non-finite components take no part,
nor do rows without an id; shorter vectors count as padded with zeros; equal rows
count once; a row with the query's id is no candidate; of several vectors under
one query id the smallest asks; ties go to the smaller id; queries with fewer
candidates get all; scores beyond 64 bits wrap; an empty table gives no row;
further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegauge.llm.common import query, table

#: Pivots, the sample they come from, queries of a group, fewest groups, data rows of a chunk.
PIVOTS, SAMPLE, GROUP, LEAST_GROUPS, CHUNK = 64, 2048, 2048, 4, 16384


def quantised(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", factor: float = 256.0) -> DataFrame:
    """vec_id, v: floor(factor * x) of each component x, for the vectors that take part."""
    good = F.forall(F.col(embedding), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = vectors.filter(F.col(embedding).isNotNull() & F.col(vec_id).isNotNull() & good)
    whole = F.transform(F.col(embedding), lambda x: F.floor(x.cast("double") * factor).cast("long"))
    return rows.select(F.col(vec_id).cast("long").alias("vec_id"), whole.alias("v"))


def matrix(column: pa.ListArray, width: int) -> np.ndarray:
    """The vectors of a column as rows, padded with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    values = np.asarray(column.flatten(), dtype=np.int64)
    lengths = np.diff(np.asarray(column.offsets))
    if (lengths == width).all():
        return values.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width), np.int64)
    row = np.repeat(np.arange(len(lengths)), lengths)
    out[row, np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = values
    return out


def choose_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """Rows far from each other: each next one is the farthest from those chosen."""
    chosen = [0]
    away = ((sample - sample[0]) ** 2).sum(axis=1)
    while len(chosen) < min(n, len(sample)) and away.max() > 0:
        chosen.append(int(away.argmax()))
        away = np.minimum(away, ((sample - sample[chosen[-1]]) ** 2).sum(axis=1))
    return sample[chosen]


def cells(x: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest pivot of each row, and the distance to it."""
    cell = np.argmax(x @ pivots.T - 0.5 * (pivots**2).sum(axis=1), axis=1)
    return cell, np.sqrt(((x - pivots[cell]) ** 2).sum(axis=1))


def in_cells(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """vec_id, cell, away (distance to the pivot), norm."""
    width = pivots.shape[1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(1), width).astype(float)
            cell, away = cells(x, pivots)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(cell.astype(np.int32)), pa.array(away), pa.array(np.sqrt((x**2).sum(axis=1)))],
                names=["vec_id", "cell", "away", "norm"],
            )

    return rows.mapInArrow(place, "vec_id long, cell int, away double, norm double")


def nearest_in_cells(placed: DataFrame, n: int) -> dict[int, list[float]]:
    """The ``n`` smallest distances to the pivot of each cell, of different ids; a cell is first thinned out in parts."""
    own = placed.select("cell", "vec_id", "away").withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(16)))
    # equal rows must not count twice: the first n different ids are among the first rows of each id
    own = own.withColumn("copy", F.row_number().over(Window.partitionBy("cell", "part", "vec_id").orderBy("away"))).filter("copy = 1")
    for keys in (("cell", "part"), ("cell",)):
        own = own.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy("away", "vec_id"))).filter(F.col("place") <= n)
    out: dict[int, list[float]] = {}
    for row in own.select("cell", "away").collect():
        out.setdefault(row[0], []).append(row[1])
    return {c: sorted(a) for c, a in out.items()}


def group_cells(count: dict[int, int], most: int, least_groups: int) -> list[list[tuple[int, int, int]]]:
    """Groups of (cell, part, parts) with about ``most`` queries each; larger cells are split into parts."""
    total = sum(count.values())
    most = max(1, min(most, -(-total // least_groups)))
    groups: list[list[tuple[int, int, int]]] = [[]]
    held = 0
    for cell in sorted(count):
        parts = -(-count[cell] // most)
        for part in range(parts):
            own = -(-count[cell] // parts)
            if groups[-1] and held + own > most:
                groups.append([])
                held = 0
            groups[-1].append((cell, part, parts))
            held += own
    return groups


def least_distance(
    pivots: np.ndarray, of_queries: dict[int, tuple[int, float, float]], of_data: dict[int, list[float]], k: int
) -> dict[int, np.ndarray]:
    """For each query cell: from what distance on to its own pivot a vector of each data cell may be needed."""
    products, norms = pivots @ pivots.T, np.sqrt((pivots**2).sum(axis=1))
    out = {}
    for i, (_, spread, norm) in of_queries.items():
        sure = np.sort([products[i, j] - spread * norms[j] - norm * r for j, rs in of_data.items() for r in rs])[::-1]
        if len(sure) <= k or norm == 0:  # the query itself may be among them, so that k + 1 are needed
            out[i] = np.full(len(pivots), -1.0)
            continue
        slack = 1e-6 * (1 + np.abs(products[i]) + spread * norms + abs(sure[k]))
        out[i] = (sure[k] - products[i] - spread * norms - slack) / norm - 1e-6
    return out


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the ``k`` best of each row, ties to the smaller id, and their number of the row."""
    rows, places = [], []
    k = min(k, scores.shape[1])
    for r, line in enumerate(scores):
        at = np.flatnonzero(line >= np.partition(line, -k)[-k]) if k else np.zeros(0, np.int64)
        at = at[np.lexsort((ids[at], -line[at]))][:k]
        places.append(at)
        rows.append(np.full(len(at), r))
    return np.concatenate(rows), np.concatenate(places)


def search(vectors: DataFrame, asks: Column, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` best of ``vectors`` (vec_id, v) for each row of them that ``asks``."""
    spark = vectors.sparkSession
    none = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    first = vectors.agg(F.max(F.size("v")), F.count(F.lit(1))).first()
    width, n = first[0] or 0, first[1]
    asking = vectors.filter(asks).groupBy("vec_id").agg(F.min("v").alias("v"))
    sample = [r[0] for r in vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v").collect()]
    if not sample:
        return none
    pivots = choose_pivots(np.array([list(v) + [0] * (width - len(v)) for v in sample], float).reshape(len(sample), width), PIVOTS)
    placed = in_cells(asking, pivots).groupBy("cell").agg(F.count(F.lit(1)), F.max("away"), F.max("norm"))
    of_queries = {r[0]: (r[1], r[2], r[3]) for r in placed.collect()}
    if not of_queries:
        return none
    needed = least_distance(pivots, of_queries, nearest_in_cells(in_cells(vectors, pivots), k + 1), k)
    groups = group_cells({c: q[0] for c, q in of_queries.items()}, GROUP, LEAST_GROUPS)
    from_distance = np.array([np.min([needed[c] for c, _, _ in group], axis=0) for group in groups])
    chunks = max(1, -(-n // CHUNK))
    parts = {c: p for group in groups for c, _, p in group}
    group_of = {(c, part): g for g, group in enumerate(groups) for c, part, _ in group}

    def send_queries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.asarray(batch.column(0))
            cell, _ = cells(matrix(batch.column(1), width).astype(float), pivots)
            group = [group_of[c, int(hash_of(i)) % parts[c]] for c, i in zip(cell.tolist(), ids.tolist())]
            row = np.repeat(np.arange(len(ids)), chunks)
            yield _sent(batch, row, np.repeat(group, chunks), np.tile(np.arange(chunks), len(ids)), True)

    def send_data(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.asarray(batch.column(0))
            cell, away = cells(matrix(batch.column(1), width).astype(float), pivots)
            chunk = np.array([hash_of(i) % chunks for i in ids.tolist()], np.int64)
            for g in range(len(groups)):
                row = np.flatnonzero(away >= from_distance[g][cell])
                if len(row):
                    yield _sent(batch, row, np.full(len(row), g), chunk[row], False)

    def solve(task: pa.Table) -> pa.Table:
        is_query = np.asarray(task["asks"])
        ids, v = np.asarray(task["vec_id"]), matrix(task["v"], width)
        q_ids, q = ids[is_query], v[is_query]
        ids, v = ids[~is_query], v[~is_query]
        if len(ids) > 1:
            order = np.argsort(ids, kind="stable")
            ids, v = ids[order], v[order]
            if (ids[1:] == ids[:-1]).any():
                _, kept = np.unique(np.column_stack([ids, v]), axis=0, return_index=True)
                kept.sort()
                ids, v = ids[kept], v[kept]
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        small = len(v) and len(q) and float(np.abs(v).max()) * float(np.abs(q).max()) * width < 2**53
        data = v.T.astype(float) if small else v.T
        step = max(1, (4 << 20) // max(1, len(v)))
        for begin in range(0, len(q) if len(v) else 0, step):
            own, own_ids = q[begin : begin + step], q_ids[begin : begin + step]
            scores = np.rint(own.astype(float) @ data).astype(np.int64) if small else own @ data
            # one more, as the query itself may be among the best
            row, at = best(scores, ids, k + int((ids[None, :] == own_ids[:, None]).sum(axis=1).max()))
            other = ids[at] != own_ids[row]
            row, at = row[other], at[other]
            out.append((own_ids[row], ids[at], scores[row, at]))
        columns = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64)] * 3
        return pa.table({"query_id": columns[0], "vec_id": columns[1], "score": columns[2]})

    sent = "grp int, chunk int, asks boolean, vec_id long, v array<long>"
    rows = asking.mapInArrow(send_queries, sent).unionByName(vectors.select("vec_id", "v").mapInArrow(send_data, sent))
    found = rows.groupBy("grp", "chunk").applyInArrow(solve, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank.cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def hash_of(i: int) -> int:
    """Spreads ids evenly, also those that are multiples of a number."""
    return (i * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> 33


def _sent(batch: pa.RecordBatch, row: np.ndarray, group: np.ndarray, chunk: np.ndarray, asks: bool) -> pa.RecordBatch:
    taken = batch.take(pa.array(row))
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.asarray(group, np.int32)),
            pa.array(chunk.astype(np.int32)),
            pa.array(np.full(len(row), asks)),
            taken.column(0),
            taken.column(1),
        ],
        names=["grp", "chunk", "asks", "vec_id", "v"],
    )


SQL = """
with whole as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (
  select q.vec_id as query_id, d.vec_id, list_sum(list_transform(list_zip(q.v, d.v), lambda p: p[1] * p[2]))::bigint as score
  from whole q join whole d on q.vec_id <> d.vec_id where q.vec_id % 50 = 0),
ranked as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from scored)
select query_id, rank, vec_id, score from ranked where rank <= 5
"""


@query("op1_topk", SQL)
def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(quantised(table(spark, sf_dir, "embeddings")), F.col("vec_id") % 50 == 0)
