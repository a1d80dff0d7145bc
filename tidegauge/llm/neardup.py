"""Near duplicates by improved consistent weighted sampling over TF-IDF shingles.

A shingle is a run of five words (a shorter text is one shingle); its weight is
``(1 + ln times) * idf``. Each text gives samples whose chance to agree between
two texts is their weighted Jaccard similarity; bands of samples are the keys
under which texts meet. Every pair that is linked has been verified by the exact
weighted Jaccard similarity of the whole texts.

* Equal texts (the same words) are one node, named by a 64-bit hash of its words. Their rows are never paired.
* idf is ``ln(1 + (families + SMOOTHING) / max(df, least))``: every shingle above the least df, a share of RARE
  and no less than FEWEST, has the weight of its df, rarer ones weigh alike. df counts families, not documents:
  documents that have the same least shingle under half of LEAST orders are taken for near copies,
  and each counts as its part of such a group. The families of the whole table are the different
  least shingles, under the order with most. A group of near copies may hold a third of
  all documents; were what they share to weigh less than what was changed in
  them, the links of the largest groups would be lost. All documents are counted
  twice: shingles by hash bucket, which leaves out those that cannot reach the share, and then exactly.
* A bucket is first compared with its hub, the node that shares most buckets with
  others (among near copies of one text: that text). What still belongs to other
  classes meets everything else of its bucket in blocks of bounded size. Their
  tasks verify all pairs that may be similar and emit only links that join classes,
  so that thousands of near copies make no more rows than a multiple of them.
* Classes are the connected components of the verified links.

Cases: null texts are empty, and all texts without words are copies of each other;
a row without an id has no class; repeated rows each get a row, and rows of one id
with different texts are judged by text; an empty table gives no row; further
columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.llm.common import cut, map_arrow, query, table, worker_state
from tidegauge.llm.components import components
from tidegauge.llm.spans import BASE, Texts, mix, slices, windows

WORDS, SIMILARITY = 5, 0.8
BANDS, BAND_SIZE = 10, 3
#: Share of the families above which a shingle has a weight of its own, if it is in more than FEWEST; and families added to all.
RARE, FEWEST, SMOOTHING = 0.001, 20, 1000
#: Share of documents below which plain comparisons of a few texts may weigh all shingles alike; tables are weighed by RARE.
COMMON = 0.5
#: Orders of shingles that tell near copies, and the part of all documents that a group of them exceeds to count as less.
LEAST, GROUPS = 8, 10_000
#: Hash buckets of shingles, buckets of one block of counts, and the unit of a document's part in a count.
BUCKETS, COUNTS, UNIT = 1 << 20, 1 << 14, 1 << 32
#: Members of a bucket that one block compares.
BLOCK = 512
#: Samples that must agree before blocks compare a pair; at similarity 0.8 fewer do in about one pair of 4000.
LEAST_AGREEING = 16


def shingles(texts: Texts, n: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Owner, hash and times of the distinct shingles of each text, by owner; and the hash of each text's words."""
    starts, ends, borders = texts.words()
    word = texts.hashes(starts, ends)
    run, at = windows(word, borders, n)
    owner = np.repeat(np.arange(len(texts)), np.diff(at))
    order = np.lexsort((run, owner)) if len(texts) > 1 else np.argsort(run)
    run, owner = run[order], owner[order]
    new = np.ones(len(run), bool)
    new[1:] = (run[1:] != run[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new)
    times = np.diff(np.append(first, len(run)))
    return owner[first], run[first], times, _text_hash(word, borders)


def _text_hash(word: np.ndarray, borders: np.ndarray) -> np.ndarray:
    """Two 64-bit hashes of the word sequence of each text."""
    place = np.arange(len(word), dtype=np.uint64) - np.repeat(borders[:-1], np.diff(borders)).astype(np.uint64)
    out = []
    for salt in (0x51ED270B, 0x2545F491):
        keyed = mix(word ^ mix(place * np.uint64(BASE) + np.uint64(salt)))
        sums = np.zeros(len(word) + 1, np.uint64)
        np.cumsum(keyed, out=sums[1:])
        out.append(mix(np.diff(sums[borders]) + np.diff(borders).astype(np.uint64)).view(np.int64))
    return np.stack(out)


class Idf:
    """Weights of shingles: ``common`` ones (sorted) have their own, all others ``rare``."""

    def __init__(self, common: np.ndarray, weight: np.ndarray, rare: float):
        self.common, self.weight, self.rare = common, weight, rare

    def __call__(self, shingle: np.ndarray, times: np.ndarray) -> np.ndarray:
        idf = np.full(len(shingle), self.rare)
        if len(self.common):
            spot = np.minimum(np.searchsorted(self.common, shingle), len(self.common) - 1)
            hit = self.common[spot] == shingle
            idf[hit] = self.weight[spot[hit]]
        return idf * (1 + np.log(times))


def _least(owner: np.ndarray, shingle: np.ndarray) -> np.ndarray:
    """The least shingle of each text that has one, under LEAST orders."""
    if not len(owner):
        return np.zeros((LEAST, 0), np.uint64)
    first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    salts = mix(np.arange(1, LEAST + 1, dtype=np.uint64))
    return np.stack([np.minimum.reduceat(mix(shingle ^ salt), first) for salt in salts])


def _count_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """kind, key, n, counts: texts by least shingle (kind 1 and more), and blocks of counts of shingles by hash bucket (kind 0)."""
    total = np.zeros(BUCKETS, np.int64)
    least: list[np.ndarray] = []

    def report(kinds: list, keys: list, numbers: list, counts: list) -> pa.RecordBatch:
        columns = [pa.array(kinds, pa.int32()), pa.array(keys, pa.int64()), pa.array(numbers, pa.int64()), pa.array(counts, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=["kind", "key", "n", "counts"])

    def families() -> Iterator[pa.RecordBatch]:
        for k, keys in enumerate(np.concatenate(least, axis=1) if least else (), 1):
            found, n = np.unique(keys.view(np.int64), return_counts=True)
            yield report(np.full(len(found), k), found, n, [None] * len(found))
        least.clear()

    held = 0
    for batch in batches:
        for _, _, texts in slices(batch.column(0)):
            owner, found, _, _ = shingles(texts)
            total += np.bincount((found % np.uint64(BUCKETS)).astype(np.intp), minlength=BUCKETS)
            least.append(_least(owner, found))
            held += len(texts)
        if held > 100_000:
            yield from families()
            held = 0
    yield from families()
    if total.any():
        blocks = range(BUCKETS // COUNTS)
        packed = [zlib.compress(total[b * COUNTS : (b + 1) * COUNTS].tobytes(), 1) for b in blocks]
        yield report([0] * len(packed), list(blocks), [None] * len(packed), packed)


def _hot_buckets(least: float):
    """Of a block's counts by task: the buckets with more than ``least`` in all."""

    def add(group: pa.Table) -> pa.Table:
        total = np.zeros(COUNTS, np.int64)
        for packed in group["counts"]:
            total += np.frombuffer(zlib.decompress(packed.as_py()), np.int64)
        return pa.table({"bucket": pa.array(np.flatnonzero(total > least) + group["key"][0].as_py() * COUNTS, pa.int64())})

    return add


def corpus_idf(docs: DataFrame, share: float = RARE) -> Idf:
    """Idf of the shingles of ``docs`` (a column ``text``), counted over all of them.

    The tables that all tasks get hold the shingles in more than ``share`` of the
    families, the hash buckets that may hold such, and the least shingles of
    large groups: LEAST * GROUPS at most. None grows with the number of documents.
    """
    texts = docs.select("text")
    counted = cut(map_arrow(texts, _count_all, "kind int, key long, n long, counts binary"))
    alike = cut(counted.filter("kind > 0").groupBy("kind", "key").agg(F.sum("n").alias("n")))
    orders = alike.groupBy("kind").agg(F.sum("n").alias("docs"), F.count(F.lit(1)).alias("families"))
    n_docs, families = orders.agg(F.coalesce(F.max("docs"), F.lit(0)), F.coalesce(F.max("families"), F.lit(0))).first()
    most = max(share * (families + SMOOTHING), FEWEST)  # a few documents are no evidence of what is common
    rare = math.log1p((families + SMOOTHING) / most)
    hot_rows = counted.filter("kind = 0").select("key", "counts").groupBy("key").applyInArrow(_hot_buckets(most), "bucket long").collect()
    hot = np.zeros(BUCKETS, bool)
    hot[[r[0] for r in hot_rows]] = True
    if not hot.any():
        return Idf(np.zeros(0, np.uint64), np.zeros(0), rare)
    large = alike.filter(F.col("n") > max(1, n_docs // GROUPS)).groupBy("key").agg(F.max("n")).orderBy("key").collect()
    large_key, large_size = np.array([r[0] for r in large], np.int64), np.array([r[1] for r in large], np.int64)

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        n_held = 0

        def report() -> pa.RecordBatch:
            found, place = np.unique(np.concatenate([f for f, _ in held] or [np.zeros(0, np.uint64)]), return_inverse=True)
            n = np.zeros(len(found), np.int64)
            np.add.at(n, place, np.concatenate([p for _, p in held] or [np.zeros(0, np.int64)]))
            return pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n)], names=["shingle", "n"])

        for batch in batches:
            for _, _, part in slices(batch.column(0)):
                owner, found, _, _ = shingles(part)
                size = np.ones(len(part), np.int64)
                if len(large_key) and len(owner):
                    keys = _least(owner, found).view(np.int64)
                    spot = np.minimum(np.searchsorted(large_key, keys), len(large_key) - 1)
                    sizes = np.where(large_key[spot] == keys, large_size[spot], 1)
                    size[np.unique(owner)] = np.sort(sizes, axis=0)[LEAST // 2]
                may = hot[(found % np.uint64(BUCKETS)).astype(np.intp)]
                held.append((found[may], UNIT // size[owner[may]]))
                n_held += int(may.sum())
                if n_held > 2_000_000:
                    yield report()
                    held.clear()
                    n_held = 0
        yield report()

    # sums of whole numbers do not depend on their order
    sums = map_arrow(texts, exact, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    rows = sums.filter(F.col("n") > most * UNIT).collect()
    common = np.array([r[0] for r in rows], np.int64).view(np.uint64)
    weight = np.log1p((families + SMOOTHING) / (np.array([float(r[1]) for r in rows]) / UNIT)) if rows else np.zeros(0)
    order = np.argsort(common)
    return Idf(common[order], weight[order], rare)


def _draws() -> tuple[np.ndarray, np.ndarray]:
    """Quantiles of Gamma(2, 1) at 65536 even steps, and the logarithms of others like them."""
    x = np.concatenate([np.geomspace(1e-6, 1e-2, 20_000)[:-1], np.linspace(1e-2, 30, 400_000)])
    chance = -np.expm1(-x) - x * np.exp(-x)
    gamma = np.interp((np.arange(65536) + 0.5) / 65536, chance, x)
    return gamma, np.log(gamma)


def samples(owner: np.ndarray, shingle: np.ndarray, weight: np.ndarray, n_texts: int, n: int = BANDS * BAND_SIZE) -> np.ndarray:
    """``n`` consistent weighted samples of each text, as 64-bit values; texts without shingles get their number."""
    gamma, log_gamma = worker_state("gamma", _draws)
    out = np.tile(np.arange(n_texts, dtype=np.uint64), (n, 1))
    if not len(owner):
        return out
    first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    size = np.diff(np.append(first, len(owner)))
    log_weight = np.log(weight)
    low, scale = np.uint64(0xFFFF), 1.0 / (1 << 32)
    for k in range(n):
        u = (shingle ^ np.uint64((k + 1) * 0xA24BAED4963EE407 & (1 << 64) - 1)) * np.uint64(0x9FB21C651E98DF25)
        u ^= u >> np.uint64(28)
        u *= np.uint64(0x9FB21C651E98DF25)
        u ^= u >> np.uint64(32)
        r = gamma[(u & low).astype(np.intp)]
        shift = (u >> np.uint64(32)).astype(np.float64) * scale
        level = np.floor(log_weight / r + shift)
        rank = log_gamma[((u >> np.uint64(16)) & low).astype(np.intp)] - r * (level - shift + 1)
        least = np.minimum.reduceat(rank, first)
        hit = np.flatnonzero(rank == np.repeat(least, size))
        of = owner[hit]
        hit = hit[np.concatenate([[True], of[1:] != of[:-1]])]
        out[k, owner[first]] = mix(shingle[hit] + mix(level[hit].astype(np.int64).view(np.uint64) + np.uint64(k)))
    return out


def signatures(docs: DataFrame, idf: Idf) -> DataFrame:
    """doc_id, h1, h2 (hashes of the words), bands (keys) and short (32 bits of each sample); texts without words have no bands."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, bands, short, filled = [], [], [], []
            for _, _, texts in slices(batch.column(1), 1 << 19):
                owner, shingle, times, whole = shingles(texts)
                drawn = samples(owner, shingle, idf(shingle, times), len(texts))
                key = np.zeros((BANDS, len(texts)), np.uint64)
                for b in range(BANDS):
                    for k in range(BAND_SIZE):
                        key[b] = mix(key[b] * np.uint64(BASE) + drawn[b * BAND_SIZE + k] + np.uint64(b + 1))
                has = np.bincount(owner, minlength=len(texts)) > 0
                hashes.append(whole)
                filled.append(has)
                bands.append(key.T[has].view(np.int64).ravel())
                short.append(drawn.T[has].astype(np.uint32).view(np.int32).ravel())
            has = np.concatenate(filled) if filled else np.zeros(0, bool)
            both = np.concatenate(hashes, axis=1) if hashes else np.zeros((2, 0), np.int64)

            def lists(parts: list[np.ndarray], each: int, kind) -> pa.ListArray:
                borders = np.concatenate([[0], np.cumsum(has * each)]).astype(np.int32)
                return pa.ListArray.from_arrays(pa.array(borders), pa.array(np.concatenate(parts) if parts else [], kind))

            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(both[0]),
                    pa.array(both[1]),
                    lists(bands, BANDS, pa.int64()),
                    lists(short, BANDS * BAND_SIZE, pa.int32()),
                ],
                names=["doc_id", "h1", "h2", "bands", "short"],
            )

    return map_arrow(docs, sign, "doc_id long, h1 long, h2 long, bands array<long>, short array<int>")


def similarities(pairs: DataFrame, idf: Idf) -> DataFrame:
    """a, b, similarity of rows a, b, text_a, text_b: exact weighted Jaccard over whole texts."""

    def weigh(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Keys (shingle told apart by row) and weights, sorted by key."""
        keys, weights = [], []
        for begin, _, texts in slices(column):
            owner, shingle, times, _ = shingles(texts)
            keys.append(mix(shingle ^ mix((owner + begin + 1).astype(np.uint64))))
            weights.append((idf(shingle, times), owner + begin))
        key = np.concatenate(keys)
        order = np.argsort(key)
        return key[order], np.concatenate([w for w, _ in weights])[order], np.concatenate([o for _, o in weights])[order]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                part = batch.slice(begin, 256)
                (key_a, weight_a, own_a), (key_b, weight_b, own_b) = weigh(part.column(2)), weigh(part.column(3))
                n = part.num_rows
                spot = np.minimum(np.searchsorted(key_b, key_a), max(len(key_b) - 1, 0))
                hit = key_b[spot] == key_a if len(key_b) else np.zeros(len(key_a), bool)
                shared = np.bincount(own_a[hit], np.minimum(weight_a[hit], weight_b[spot[hit]]), n)
                total = np.bincount(own_a, weight_a, n) + np.bincount(own_b, weight_b, n) - shared
                value = np.where(total > 0, shared / np.maximum(total, 1e-300), 1.0)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(value)], names=["a", "b", "similarity"])

    return map_arrow(pairs.select("a", "b", "text_a", "text_b"), compare, "a long, b long, similarity double")


def _verified(pairs: DataFrame, texts: DataFrame, idf: Idf, least: float) -> DataFrame:
    """The pairs ``a``, ``b`` of nodes that are similar enough."""
    left = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    # a hundredth of a promille less: sums in another order must not part equal values
    return cut(similarities(pairs.join(left, "a").join(right, "b"), idf).filter(F.col("similarity") >= least - 1e-9))


def _stars(members: DataFrame) -> DataFrame:
    """Distinct pairs (a, b) of each member of a bucket with its hub b, the member that shares most buckets with others."""
    hubs = cut(members.groupBy("key").agg(F.max_by("node", F.struct("mates", "node")).alias("b")))
    return members.select("key", F.col("node").alias("a")).join(hubs, "key").filter("a <> b").select("a", "b").distinct()


def _first_labels(links: DataFrame) -> DataFrame:
    """node, label of the members that are linked with a hub: the smallest of their hubs, or that of this one.

    Two steps along the links, not whole components: members that these would
    join are only compared once more.
    """
    own = cut(links.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label")))
    above = own.select(F.col("node").alias("label"), F.col("label").alias("next"))
    return cut(own.join(above, "label", "left").select("node", F.coalesce("next", "label").alias("label")))


def _unlike(members: DataFrame, labels: DataFrame) -> DataFrame:
    """key, node, mates, label, hub of the buckets that hold several classes; hub is the class of the bucket's hub."""
    marked = members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    mixed = marked.groupBy("key").agg(
        F.min("label").alias("low"), F.max("label").alias("high"), F.max_by("label", F.struct("mates", "node")).alias("hub")
    )
    return cut(marked.join(cut(mixed.filter("low <> high").select("key", "hub")), "key"))


def _across(unlike: DataFrame, nodes: DataFrame, texts: DataFrame, idf: Idf, least: float) -> DataFrame:
    """Verified pairs (a, b) that join the classes that still meet in a bucket.

    The members outside the hub's class are cut into blocks, the whole bucket into
    parts; each block meets each part in a group of its own, which compares every
    pair of different classes whose samples agree often enough, in the first bucket
    that it shares. A group emits a link only if it joins two classes that its
    earlier links have not joined, so that links are fewer than members.
    """
    members = unlike.withColumn("rest", F.col("label") != F.col("hub"))
    sizes = members.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("rest").cast("long")).alias("r"))
    sizes = cut(sizes.select("key", F.ceil(F.col("r") / BLOCK).alias("blocks"), F.ceil(F.col("n") / BLOCK).alias("parts")))
    members = members.select("key", "node", "label", "rest").join(sizes, "key")
    slot = F.pmod(F.xxhash64("node"), F.lit(1 << 30))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    asked = members.filter("rest").withColumn("block", slot % F.col("blocks")).withColumn("part", every("parts")).withColumn("asks", F.lit(True))
    all_ = members.withColumn("part", slot % F.col("parts")).withColumn("block", every("blocks")).withColumn("asks", F.lit(False))
    rows = asked.unionByName(all_).select("key", "block", "part", "asks", "node", "label")
    rows = cut(rows.withColumn("meeting", F.xxhash64("key", "block", "part")))
    # many small meetings share a group, which saves the cost of a group for each
    groups = max(1, rows.count() // BLOCK)
    rows = rows.withColumn("together", F.pmod("meeting", F.lit(groups)))
    rows = rows.join(texts, "node").join(nodes.select("node", "bands", "short"), "node")
    rows = rows.select("together", "meeting", "key", "asks", "node", "label", "bands", "short", "text").repartition("together")

    def meet(group: pa.Table) -> pa.Table:
        keys, meeting, asks, node = (np.array(group[c]) for c in ("key", "meeting", "asks", "node"))
        label = group["label"].to_pylist()
        bands = np.array(group["bands"].combine_chunks().flatten()).reshape(len(node), -1)
        drawn = np.array(group["short"].combine_chunks().flatten()).reshape(len(node), -1)
        # each text is cut into shingles once, though it may stand in many meetings
        _, first_row, text_of = np.unique(node, return_index=True, return_inverse=True)
        owner, shingle, times = [], [], []
        for begin, _, part in slices(group["text"].take(pa.array(first_row))):
            of, values, n, _ = shingles(part)
            owner.append(of + begin)
            shingle.append(values)
            times.append(n)
        owner, shingle = np.concatenate(owner), np.concatenate(shingle)
        weight = idf(shingle, np.concatenate(times))
        kinds, kind = np.unique(shingle, return_inverse=True)
        at = np.searchsorted(owner, np.arange(len(first_row) + 1))
        total = np.bincount(owner, weight, len(first_row))
        above = {c: c for c in label}

        def top(c: int) -> int:
            while above[c] != c:
                above[c] = above[above[c]]
                c = above[c]
            return c

        found = []
        place = np.zeros(len(kinds))
        order = np.lexsort((asks, meeting))
        borders = np.flatnonzero(np.concatenate([[True], meeting[order][1:] != meeting[order][:-1], [True]]))
        for begin, end in zip(borders[:-1], borders[1:]):
            own_rows = order[begin:end]
            others, askers = own_rows[~asks[own_rows]], own_rows[asks[own_rows]]
            if not len(others):
                continue
            for x in askers:
                same_bands = bands[others] == bands[x]
                here = bands[x][same_bands.argmax(axis=1)] == keys[x]
                y = others[here & same_bands.any(axis=1) & ((drawn[others] == drawn[x]).sum(axis=1) >= LEAST_AGREEING)]
                y = np.array([i for i in y.tolist() if top(label[i]) != top(label[x])], np.int64)
                tx, ty = text_of[x], text_of[y]
                # the lighter text is at least the shared part, the heavier at most the union
                fit = np.minimum(total[ty], total[tx]) >= (least - 1e-9) * np.maximum(total[ty], total[tx])
                y, ty = y[fit], ty[fit]
                if not len(y):
                    continue
                own = slice(at[tx], at[tx + 1])
                place[kind[own]] = weight[own]
                lengths = at[ty + 1] - at[ty]
                ahead = np.concatenate([[0], np.cumsum(lengths)[:-1]])
                spots = np.repeat(at[ty] - ahead, lengths) + np.arange(lengths.sum())
                shared = np.add.reduceat(np.minimum(place[kind[spots]], weight[spots]), ahead)
                place[kind[own]] = 0
                near = shared >= (least - 1e-9) * (total[tx] + total[ty] - shared)
                for i in y[near].tolist():
                    a, b = top(label[x]), top(label[i])
                    if a != b:
                        above[a] = b
                        found.append((int(node[x]), int(node[i])))
        return pa.table({"a": pa.array([p[0] for p in found], pa.int64()), "b": pa.array([p[1] for p in found], pa.int64())})

    return rows.groupBy("together").applyInArrow(meet, "a long, b long").distinct()


def _node_texts(own: DataFrame, wanted: DataFrame) -> DataFrame:
    """node, text of the ``wanted`` nodes, found by the document named with each; other texts under its id are passed over."""

    def right(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own_hash = [_text_hash(t.hashes(*(w := t.words())[:2]), w[2])[0] for _, _, t in slices(batch.column(1))]
            yield batch.filter(pa.array(np.concatenate([np.zeros(0, np.int64), *own_hash]) == np.array(batch.column(0))))

    found = map_arrow(own.join(wanted, "doc_id").select("node", "text"), right, "node long, text string")
    return found.groupBy("node").agg(F.min("text").alias("text"))


def classes(docs: DataFrame, least: float = SIMILARITY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and class_id, the smallest id of its class, a row per row of ``docs``."""
    own = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    idf = corpus_idf(own)
    signed = cut(signatures(own, idf).withColumnRenamed("h1", "node"))
    nodes = cut(
        signed.filter("doc_id is not null")
        .groupBy("node")
        .agg(F.min("doc_id").alias("doc_id"), F.any_value("bands").alias("bands"), F.any_value("short").alias("short"))
    )
    keys = nodes.select("node", F.explode("bands").alias("key"))
    full = keys.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.count(F.lit(1)).alias("n"))
    shared = keys.join(cut(full.filter("low <> high").select("key", "n")), "key")
    # a node has at most BANDS buckets
    shared = shared.groupBy("node").agg(F.collect_list("key").alias("keys"), F.sum("n").alias("mates"))
    members = cut(shared.select("node", "mates", F.explode("keys").alias("key")))
    texts = cut(_node_texts(own, members.select("node").distinct().join(nodes.select("node", "doc_id"), "node")))
    links = _verified(_stars(members), texts, idf, least)
    labels = _first_labels(links)
    links = links.select("a", "b").unionByName(cut(_across(_unlike(members, labels), nodes, texts, idf, least)))
    labels = components(links)
    named = nodes.select("node", "doc_id").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    named = cut(named)
    ids = named.groupBy("label").agg(F.min("doc_id").alias("class_id"))
    of_node = named.join(ids, "label").select("node", "class_id")
    joined = signed.select("doc_id", "node").join(of_node, "node", "left")
    return joined.select("doc_id", F.when(F.col("doc_id").isNotNull(), F.col("class_id")).alias("class_id"))


@query("op9_neardup")
def op9_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents"))
