"""Near-duplicate vectors by spherical-cap filters.

A filter is a direction on the sphere; a vector passes it if their inner product
reaches a height, that is, if it lies in the cap around it. The directions are
random product codes: after a random rotation, the coordinates are cut into blocks,
each block has a list of random words, and every combination of words is a
direction. Those that a vector passes are list-decoded: words of a block are taken
in falling order of their product, only as far as the best words of the blocks to
come can still reach the height, so that work follows the size of the result.
Vectors of one label that pass a filter together are compared in double precision.

* The height is measured on random pairs at exactly the least cosine, so that
  they share no filter of one code in a share of ``MISSED ** (1 / CODES)``; the codes
  are rotated independently, so ``MISSED`` of such pairs share none. Closer pairs are
  missed less. Code and height depend on the width of the vectors and the least
  cosine; the number of words also grows with the largest label, so that a filter
  holds few unlike vectors. This changes cost, not what is found.
* Equal vectors of one label are one node that counts as many.
* Each node looks for a leader: of the hubs of its filters (the node that shares
  most filters with others), the one it meets most often. Nodes within half the
  angle of a leader are linked with each other for certain, hence counted without
  being compared: a clump. What remains of a filter after its hub's clump meets the
  whole filter in blocks of bounded size, so that a huge group of close copies costs
  no more than its members. Each pair counts in the first filter that it shares.
* A task returns the links that it counted for each node, and links that join
  clumps, each only if its earlier ones have not joined them.

Cases: a vector that is null, empty, zero or holds null or non-finite components has
no link, and is a class of its own, as has one without a label; shorter vectors
count as padded with zeros; rows of equal id and vector are one vector with one
result each; rows of one id with other vectors or labels are judged by these; a row
without an id takes no part, and has no class; ties of cosines do not matter; an
empty table gives no row; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.llm.common import cut, map_arrow, query, table
from tidegauge.llm.components import components

SIMILARITY = 0.93
#: Rotated codes, blocks of coordinates, words of a block at least and at most, share of pairs at the least cosine that may be missed.
CODES, BLOCKS, WORDS, MOST_WORDS, MISSED = 8, 2, 256, 1024, 0.002
#: Filters of one code that a vector may pass on the mean, unlike vectors of a filter from which words are added.
MOST_FILTERS, CROWD = 32, 0.1
#: Members of a filter that one block compares, rows of a group of meetings.
BLOCK, GROUP = 2048, 4096
#: Cosines within this of a bound are not decided by it.
SLACK = 1e-9


class Code:
    """A rotated random product code; ``height`` is what a vector's product with a direction must reach."""

    def __init__(self, width: int, n_words: int, seed: int, height: float = 0.0):
        rng = np.random.default_rng([seed, width, n_words])
        self.rotation, _ = np.linalg.qr(rng.standard_normal((width, width)))
        self.columns = np.array_split(np.arange(width), min(BLOCKS, width))
        self.words = []
        for own in self.columns:
            words = rng.standard_normal((n_words, len(own)))
            words /= np.linalg.norm(words, axis=1, keepdims=True)
            self.words.append(np.unique(words, axis=0) / math.sqrt(len(self.columns)))
        self.height = height

    def products(self, unit: np.ndarray) -> list[np.ndarray]:
        """For each block, the products of all vectors with all its words."""
        turned = unit @ self.rotation
        return [turned[:, own] @ words.T for own, words in zip(self.columns, self.words)]

    def decode(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row and direction of every filter that a row of ``unit`` passes, by row."""
        falling, which = [], []
        for products in self.products(unit):
            order = np.argsort(-products, axis=1, kind="stable")
            falling.append(np.take_along_axis(products, order, 1))
            which.append(order)
        to_come = np.zeros((len(falling) + 1, len(unit)))
        for b in range(len(falling) - 1, -1, -1):
            to_come[b] = to_come[b + 1] + falling[b][:, 0]
        row, sums, direction = np.arange(len(unit)), np.zeros(len(unit)), np.zeros(len(unit), np.int64)
        for b, products in enumerate(falling):
            least = self.height - sums - to_come[b + 1][row]
            reach = (products[row] >= least[:, None]).sum(axis=1)
            origin = np.repeat(np.arange(len(row)), reach)
            place = np.arange(len(origin)) - np.repeat(np.cumsum(reach) - reach, reach)
            row, sums = row[origin], sums[origin] + products[row[origin], place]
            direction = direction[origin] * products.shape[1] + which[b][row, place]
        return row, direction


def _random_pairs(width: int, cosine: float, n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng([seed, width])
    a = rng.standard_normal((n, width))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    if width == 1:
        return a, a
    b = rng.standard_normal((n, width))
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    return a, cosine * a + math.sqrt(max(0.0, 1 - cosine * cosine)) * b


def codes_for(width: int, least: float, n: int, missed: float = MISSED) -> list[Code]:
    """The codes for ``n`` vectors of a label: heights measured on random pairs at the least cosine."""
    share = missed ** (1 / CODES)
    n_words = WORDS
    found: list[Code] = []
    while True:
        code = Code(width, n_words, 0)
        a, b = _random_pairs(width, least, 300, 1)
        best, passed = np.empty(len(a)), []
        for i in range(len(a)):
            sums_a, sums_b = np.zeros(1), np.zeros(1)
            for x, y in zip(code.products(a[i : i + 1]), code.products(b[i : i + 1])):
                sums_a, sums_b = np.add.outer(sums_a, x[0]).ravel(), np.add.outer(sums_b, y[0]).ravel()
            best[i] = np.minimum(sums_a, sums_b).max()
            passed.append(np.sort(sums_a[np.argpartition(sums_a, -min(len(sums_a), 4096))[-4096:]]))
        height = float(np.quantile(best, share)) - SLACK
        filters = float(np.mean([len(p) - np.searchsorted(p, height) for p in passed]))
        directions = math.prod(len(w) for w in code.words)
        if filters > MOST_FILTERS and n_words > 2:
            if found:
                return found
            n_words //= 2  # few dimensions: less directions
            continue
        grown = bool(found)
        found = [Code(width, n_words, seed, height) for seed in range(CODES)]
        if n_words >= MOST_WORDS or n_words < WORDS or n * filters / directions <= CROWD or (grown and directions <= 4):
            return found
        n_words *= 2


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Unit vectors of a list column, as rows padded with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = np.diff(np.asarray(column.offsets))
    out = np.zeros((len(lengths), width))
    row = np.repeat(np.arange(len(lengths)), lengths)
    values = np.asarray(column.flatten(), float)
    out[row, np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = values
    if width:
        out /= np.abs(out).max(axis=1, keepdims=True)  # squares must neither overflow nor vanish
        out /= np.sqrt((out * out).sum(axis=1, keepdims=True))
    return out


def _filters(nodes: DataFrame, codes: list[Code], width: int) -> DataFrame:
    """node and its filters: one value for each direction that it passes, told apart by code and label."""

    def pass_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit = _matrix(batch.column(1), width)
            rows, keys = [], []
            for number, code in enumerate(codes):
                row, direction = code.decode(unit)
                rows.append(row)
                keys.append(direction * len(codes) + number)
            row, key = np.concatenate(rows), np.concatenate(keys)
            order = np.argsort(row, kind="stable")
            borders = np.searchsorted(row[order], np.arange(batch.num_rows + 1)).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(borders), pa.array(key[order]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), lists], names=["node", "label", "passed"])

    passed = map_arrow(nodes.select("node", "v", "label"), pass_all, "node long, label long, passed array<long>")
    return passed.select("node", F.explode("passed").alias("direction"), "label").select("node", F.xxhash64("label", "direction").alias("key"))


def _cosines(pairs: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """a, b, cosine of pairs of nodes."""
    left = nodes.select(F.col("node").alias("a"), F.col("v").alias("va"))
    right = nodes.select(F.col("node").alias("b"), F.col("v").alias("vb"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cosine = (_matrix(batch.column(2), width) * _matrix(batch.column(3), width)).sum(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cosine)], names=["a", "b", "cosine"])

    rows = pairs.join(left, "a").join(right, "b").select("a", "b", "va", "vb")
    return map_arrow(rows, compare, "a long, b long, cosine double")


def _leaders(members: DataFrame, nodes: DataFrame, width: int, least: float) -> DataFrame:
    """node, leader of the nodes within half the angle of the hub that they meet most often."""
    hubs = cut(members.groupBy("key").agg(F.max_by("node", F.struct("mates", "node")).alias("b")))
    met = members.select("key", F.col("node").alias("a")).join(hubs, "key").filter("a <> b")
    met = met.groupBy("a", "b").agg(F.count(F.lit(1)).alias("times"))
    one = met.groupBy("a").agg(F.max_by("b", F.struct("times", "b")).alias("b"))
    half = math.cos(math.acos(max(-1.0, min(1.0, least))) / 2)
    close = _cosines(one, nodes, width).filter(F.col("cosine") >= half + SLACK)
    return cut(close.select(F.col("a").alias("node"), F.col("b").alias("leader")))


def _meet(rows: DataFrame, width: int, least: float) -> DataFrame:
    """node, other, links: links counted for a node, or (links null) a link that joins two clumps."""

    def meet(group: pa.Table) -> pa.Table:
        meeting, key, asks, rest, node, clump, label, weight = (
            np.asarray(group[c]) for c in ("meeting", "key", "asks", "rest", "node", "clump", "label", "weight")
        )
        unit = _matrix(group["v"], width)
        lists = group["keys"].combine_chunks()
        at, keys = np.asarray(lists.offsets), np.asarray(lists.flatten())
        at = at - at[0]
        above: dict[int, int] = {}

        def top(c: int) -> int:
            while above.get(c, c) != c:
                c = above[c]
            return c

        links = np.zeros(len(node), np.int64)
        joined: list[tuple[int, int]] = []
        order = np.lexsort((asks, meeting))
        borders = np.flatnonzero(np.concatenate([[True], meeting[order][1:] != meeting[order][:-1], [True]]))
        for begin, end in zip(borders[:-1], borders[1:]):
            own = order[begin:end]
            others, askers = own[~asks[own]], own[asks[own]]
            step = max(1, (1 << 21) // max(1, len(others)))
            for first in range(0, len(askers), step):
                some = askers[first : first + step]
                x, y = np.nonzero(unit[some] @ unit[others].T >= least)
                x, y = some[x], others[y]
                linked = (clump[x] != clump[y]) & (label[x] == label[y])
                x, y = x[linked], y[linked]
                shared = np.fromiter((_first_shared(keys[at[i] : at[i + 1]], keys[at[j] : at[j + 1]]) == key[i] for i, j in zip(x, y)), bool, len(x))
                x, y = x[shared], y[shared]
                np.add.at(links, x, weight[y])
                back = ~rest[y]  # those that ask nothing learn of it here
                np.add.at(links, y[back], weight[x[back]])
                for i, j in zip(x.tolist(), y.tolist()):
                    a, b = top(clump[i]), top(clump[j])
                    if a != b:
                        above[max(a, b)] = min(a, b)
                        joined.append((int(clump[i]), int(clump[j])))
        counted = np.flatnonzero(links)
        return pa.table(
            {
                "node": pa.array(np.concatenate([node[counted], np.array([p[0] for p in joined], np.int64)])),
                "other": pa.array([None] * len(counted) + [p[1] for p in joined], pa.int64()),
                "links": pa.array(links[counted].tolist() + [None] * len(joined), pa.int64()),
            }
        )

    return rows.groupBy("together").applyInArrow(meet, "node long, other long, links long")


def _first_shared(a: np.ndarray, b: np.ndarray) -> int:
    both = np.intersect1d(a, b, assume_unique=True)
    return both[0] if len(both) else 0


def _across(members: DataFrame, clumps: DataFrame, nodes: DataFrame, width: int, least: float) -> DataFrame:
    """What ``_meet`` finds among the members of filters that hold several clumps."""
    marked = members.join(clumps, "node", "left").withColumn("clump", F.coalesce("leader", "node")).drop("leader")
    mixed = marked.groupBy("key").agg(
        F.min("clump").alias("low"), F.max("clump").alias("high"), F.max_by("clump", F.struct("mates", "node")).alias("hub")
    )
    marked = marked.join(mixed.filter("low <> high").select("key", "hub"), "key")
    marked = cut(marked.select("key", "node", "clump", (F.col("clump") != F.col("hub")).alias("rest")))
    sizes = marked.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("rest").cast("long")).alias("r"))
    sizes = sizes.select("key", F.ceil(F.col("r") / BLOCK).alias("blocks"), F.ceil(F.col("n") / BLOCK).alias("parts"))
    own = marked.join(sizes, "key")
    slot = F.pmod(F.xxhash64("node"), F.lit(1 << 30))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    asked = own.filter("rest").withColumn("block", slot % F.col("blocks")).withColumn("part", every("parts")).withColumn("asks", F.lit(True))
    all_ = own.withColumn("part", slot % F.col("parts")).withColumn("block", every("blocks")).withColumn("asks", F.lit(False))
    rows = asked.unionByName(all_).select("key", "node", "clump", "rest", "asks", F.xxhash64("key", "block", "part").alias("meeting"))
    rows = cut(rows)
    # many small meetings share a group, which saves the cost of a group for each
    groups = max(1, rows.count() // GROUP)
    # the filters of a node, of which the smallest that two share counts their link
    keys = marked.groupBy("node").agg(F.sort_array(F.collect_set("key")).alias("keys"))
    rows = rows.join(nodes.select("node", "v", "label", "weight").join(keys, "node"), "node")
    return cut(_meet(rows.withColumn("together", F.pmod("meeting", F.lit(groups))), width, least))


def links(vectors: DataFrame, least: float = SIMILARITY, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, n_links, component_id, kept, a row per row of ``vectors``."""
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    takes_part = F.col("vec_id").isNotNull() & F.col("own_label").isNotNull() & F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0)
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v"), F.col(label).alias("own_label"))
    rows = rows.withColumn("part", F.coalesce(takes_part, F.lit(False)))
    # 128 bits name a vector under its label
    names = [F.when(F.col("part"), F.xxhash64(F.lit(salt), F.col("own_label"), F.col("v"))).alias(f"h{salt}") for salt in (1, 2)]
    rows = rows.select("vec_id", "v", F.xxhash64("own_label").alias("label"), *names)
    nodes = rows.filter("h1 is not null").groupBy("h1", "h2")
    nodes = nodes.agg(F.any_value("v").alias("v"), F.any_value("label").alias("label"), F.min("vec_id").alias("first"), F.count_distinct("vec_id").alias("weight"))
    nodes = cut(nodes.withColumn("node", F.monotonically_increasing_id()))
    figures = nodes.groupBy("label").agg(F.max(F.size("v")).alias("width"), F.count(F.lit(1)).alias("n"))
    figures = figures.agg(F.max("width"), F.max("n")).first()
    alone = [F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept")]
    if figures[0] is None:
        return rows.select("vec_id", *alone)
    width = figures[0]
    keys = cut(_filters(nodes, codes_for(width, least, figures[1]), width))
    shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = cut(keys.join(shared, "key"))
    members = shared.join(shared.groupBy("node").agg(F.sum("n").alias("mates")), "node").select("key", "node", "mates")
    members = cut(members)
    clumps = _leaders(members, nodes, width, least)
    found = _across(members, clumps, nodes, width, least)
    counted = found.filter("links is not null").groupBy("node").agg(F.sum("links").alias("links"))
    # clumps are joined by links, and by leaders that follow others
    follow = clumps.join(clumps.select(F.col("leader").alias("node")).distinct(), "node", "left_semi")
    joins = found.filter("links is null").select(F.col("node").alias("a"), F.col("other").alias("b"))
    joins = joins.unionByName(follow.select(F.col("node").alias("a"), F.col("leader").alias("b"))).distinct()
    labels = components(joins).select(F.col("node").alias("clump"), F.col("label").alias("top"))
    own = nodes.select("node", "h1", "h2", "first", "weight").join(clumps, "node", "left").withColumn("clump", F.coalesce("leader", "node"))
    own = own.join(labels, "clump", "left").withColumn("top", F.coalesce("top", "clump")).join(counted, "node", "left")
    own = cut(own.select("h1", "h2", "first", "weight", "clump", "top", F.coalesce("links", F.lit(0)).alias("links")))
    clump_size = own.groupBy("clump").agg(F.sum("weight").alias("all"))
    smallest = own.groupBy("top").agg(F.min("first").alias("component_id"))
    own = own.join(clump_size, "clump").join(smallest, "top").select("h1", "h2", (F.col("all") - 1 + F.col("links")).alias("found"), "component_id")
    out = rows.select("vec_id", "h1", "h2").join(own, ["h1", "h2"], "left")
    out = out.select("vec_id", F.coalesce("found", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


SQL = """
with recursive good as (
  select vec_id, label, embedding::double[] as v from embeddings
  where vec_id is not null and label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
normed as (select *, sqrt(list_dot_product(v, v)) as r from good),
links as (
  select a.vec_id as a, b.vec_id as b from normed a join normed b on a.label = b.label and a.vec_id <> b.vec_id
  where list_dot_product(a.v, b.v) / (a.r * b.r) >= 0.93),
reach as (select vec_id as a, vec_id as b from embeddings where vec_id is not null union select r.a, l.b from reach r join links l on r.b = l.a),
classes as (select a as vec_id, min(b) as component_id from reach group by a),
counted as (select a as vec_id, count(*) as n from links group by a)
select e.vec_id, coalesce(n, 0)::bigint as n_links, component_id, coalesce(e.vec_id = component_id, false) as kept
from embeddings e left join classes using (vec_id) left join counted using (vec_id)
"""


@query("op11_caps", SQL)
def op11_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links(table(spark, sf_dir, "embeddings"))
