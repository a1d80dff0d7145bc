"""Cap filters, whitening and blocked posting lists against plain versions, on random and awkward rows."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import cases
from tidegauge.llm import caps, lexical, whitening

VECTORS = "vec_id long, embedding array<double>, label int"


def plain_links(rows, least=caps.SIMILARITY):
    """n_links and class of each id by comparing all pairs; ids are distinct."""
    own = [(i, np.array(v) / max(map(abs, v)), y) for i, v, y in rows if v and y is not None and None not in v and np.isfinite(v).all() and any(v)]
    own = [(i, v / np.linalg.norm(v), y) for i, v, y in own]
    above = {i: i for i, _, _ in rows}

    def top(i):
        while above[i] != i:
            i = above[i]
        return i

    n = Counter()
    for a, x, y in own:
        for b, z, w in own:
            if a < b and y == w and float(x @ z) >= least:
                n[a] += 1
                n[b] += 1
                p, q = top(a), top(b)
                above[max(p, q)] = min(p, q)
    return {i: (n[i], top(i)) for i, _, _ in rows}


def found_links(df):
    return {r.vec_id: (r.n_links, r.component_id) for r in caps.links(df).collect()}


def test_links_of_groups_and_chains(spark):
    """A tight group, a loose one whose members are not all linked, chains, and strangers."""
    rng = np.random.default_rng(2)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    base = unit(rng.standard_normal((3, 24)))
    tight = unit(base[0] + 0.02 * rng.standard_normal((150, 24)))
    loose = unit(base[1] + 0.06 * rng.standard_normal((150, 24)))
    chain, turned = [base[2]], unit(np.cross(np.eye(24)[:3, :3], base[2][:3]).sum(axis=0))
    other = unit(np.concatenate([turned, np.zeros(21)]) - base[2] * (np.concatenate([turned, np.zeros(21)]) @ base[2]))
    chain = [math.cos(k * 0.3) * base[2] + math.sin(k * 0.3) * other for k in range(10)]
    vectors = np.concatenate([tight, loose, np.array(chain), unit(rng.standard_normal((200, 24)))])
    scale = rng.uniform(0.1, 1e6, len(vectors))
    rows = [(i, (v * s).tolist(), i % 2 if 100 <= i < 150 else 1) for i, (v, s) in enumerate(zip(vectors, scale))]
    assert found_links(spark.createDataFrame(rows, VECTORS)) == plain_links(rows)


def test_links_of_awkward_rows(spark):
    bad = [(1, None, 1), (2, [], 1), (3, [0.0, 0.0], 1), (4, [1.0, None], 1), (5, [float("nan"), 1.0], 1), (6, [float("inf"), 1.0], 1), (7, [1.0, 1.0], None)]
    good = [(10, [1.0, 1.0], 1), (11, [2.0, 2.0], 1), (12, [1e-200, 1e-200], 1), (13, [1e200, 1e200], 1), (14, [1.0, 1.0], 2), (15, [3.0], 1), (16, [3.0, 0.0], 1), (17, [-1.0, -1.0], 1)]
    rows = bad + good + [(20 + i, [0.1, 0.9], 1) for i in range(40)]
    clash = {c: F.lit(1) for c in ("v", "node", "key", "weight", "clump", "keys", "links", "part", "first", "h1", "n")}
    df = spark.createDataFrame(rows, VECTORS)
    want = plain_links([(i, v + [0.0] * (2 - len(v)) if v else v, y) for i, v, y in rows])
    assert found_links(df.withColumns(clash)) == want
    twice = caps.links(df.union(df).union(spark.createDataFrame([(None, [1.0, 1.0], 1)], VECTORS))).collect()
    assert Counter(r.vec_id for r in twice) == {i: 2 for i in want} | {None: 1}
    assert {r.vec_id: (r.n_links, r.component_id) for r in twice if r.vec_id is not None} == want
    assert [(r.n_links, r.component_id, r.kept) for r in twice if r.vec_id is None] == [(0, None, False)]
    assert all(r.kept == (r.vec_id == r.component_id) for r in twice if r.vec_id is not None)
    assert caps.links(cases.empty(spark, VECTORS)).count() == 0
    assert caps.links(spark.createDataFrame(bad, VECTORS)).count() == len(bad)


@pytest.mark.parametrize("width", [1, 2, 3, 9, 64])
def test_filters_meet_at_the_least_cosine(width):
    codes = caps.codes_for(width, 0.93, 1000)
    a, b = caps._random_pairs(width, 0.93, 600, 7)
    met = np.zeros(len(a), bool)
    for code in codes:
        (ra, ka), (rb, kb) = code.decode(a), code.decode(b)
        met[np.intersect1d(ra * (1 << 40) + ka, rb * (1 << 40) + kb) >> 40] = True
    assert met.mean() >= 0.99


def test_list_decoding_is_complete():
    code = caps.Code(10, 12, 3, 0.4)
    x = np.random.default_rng(1).standard_normal((50, 10))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    row, direction = code.decode(x)
    first, second = code.products(x)
    every = first[:, :, None] + second[:, None, :]
    want = {(r, i * 12 + j) for r, i, j in zip(*np.nonzero(every >= 0.4))}
    assert set(zip(row.tolist(), direction.tolist())) == want and len(row) == len(want)


def plain_whitening(x):
    distinct = np.unique(x, axis=0)
    n, sums = len(distinct), distinct.sum(axis=0)
    centred = distinct - sums / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    return n, ((n * x - sums) ** 2).sum(axis=1), (x - sums / n) @ axes[:, ::-1] / np.sqrt(values[::-1]), values[::-1]


def test_whitening(spark, small):
    rows = whitening.op12_whitening(spark, small).orderBy("vec_id", "component").collect()
    own = sorted((r.vec_id, r.embedding) for r in spark.read.parquet(f"{small}/embeddings.parquet").collect())
    x = np.floor(64 * np.array([v for _, v in own], float)).astype(np.int64) + 1_000_000
    n, deviation, want, values = plain_whitening(x)
    got = np.array([r.whitened for r in rows]).reshape(len(x), 16)
    signs = np.sign((got * want[:, :16]).sum(axis=0))
    assert np.abs(got * signs - want[:, :16]).max() < 1e-9
    assert [r.deviation for r in rows[::16]] == deviation.tolist() and {r.n for r in rows} == {n}
    assert np.allclose([r.explained for r in rows[:16]], values[:16] / values.sum(), rtol=1e-12)
    assert max(r.identity_error for r in rows) < 1e-10


def test_whitening_of_awkward_rows(spark):
    rng = np.random.default_rng(4)
    bad = [(100, None, 1), (101, [None, 1.0], 1), (102, [float("nan")], 1), (103, [float("-inf")], 1), (104, [1e30], 1)]
    flat = rng.integers(-9, 9, (60, 2))  # of rank 2 in three dimensions
    good = [(i, [float(a), float(b), float(a + b)], 1) for i, (a, b) in enumerate(flat.tolist())]
    more = [(None, [1.0, 2.0, 3.0], 1), (3, good[3][1], 1), (61, [5.0], 1), (62, [], 1)]
    df = spark.createDataFrame(bad + good + more, VECTORS)
    rows = whitening.whitened(df.withColumns({c: F.lit(0) for c in ("x", "v", "n", "component", "i")})).collect()
    ids = [r[0] for r in good + more]
    assert Counter(r.vec_id for r in rows) == {i: 3 * n for i, n in Counter(ids).items()}  # [5] and [] leave the plane
    x = np.array([(v + [0.0] * 3)[:3] for _, v, _ in good + more]).astype(np.int64) * 64 + 1_000_000
    n, deviation, want, values = plain_whitening(x)
    assert {r.n for r in rows} == {n} and {(r.vec_id, r.deviation) for r in rows} == set(zip(ids, deviation.tolist()))
    first = {r.vec_id: r.whitened for r in rows if r.component == 1}
    assert np.allclose(sorted(abs(first[i]) for i in range(60)), sorted(np.abs(want[:60, 0])))
    flat_only = whitening.whitened(spark.createDataFrame(good, VECTORS)).collect()
    assert {r.component for r in flat_only} == {1, 2}
    for none in (spark.createDataFrame(good[:1] * 3, VECTORS), spark.createDataFrame(bad, VECTORS), cases.empty(spark, VECTORS)):
        assert whitening.whitened(none).count() == 0


def test_deviations_beyond_doubles():
    model = whitening.Whitening(10**9, [10**15 + 7, 3], np.ones(2), np.eye(2), 2.0, 0)
    x = np.array([[10**6 + 3, -2], [10**6 - 5, 40]])
    want = [sum((10**9 * int(a) - s) ** 2 for a, s in zip(row, model.sums)) for row in x]
    assert model.deviations(x) == [w if w < 1 << 63 else None for w in want]


def test_jacobi_of_a_factor():
    rng = np.random.default_rng(3)
    for n, rank in ((1, 1), (7, 7), (40, 12), (65, 65)):
        m = rng.standard_normal((n, rank)) * np.geomspace(1, 1e-3, rank)
        v = m @ m.T
        values, axes = whitening.components(v)
        assert len(values) == rank and (np.diff(values) <= 0).all()
        assert np.allclose(axes.T @ axes, np.eye(rank), atol=1e-12) and np.abs(v @ axes - axes * values).max() < 1e-12 * values[0]


def plain_search(docs, items, k=10):
    held = [(i, Counter(lexical.terms(t))) for i, t in docs]
    held = [(i, c, sum(c.values())) for i, c in held if c]
    total, df = sum(n for _, _, n in held), Counter(t for _, c, _ in held for t in c)
    out = {}
    for item, text in items:
        best = {}
        for i, c, n in held:
            m = 25 + 75 * n * len(held) // total
            score = sum(
                times * math.floor(1000 * math.log((2 * len(held) + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m))
                for t, times in Counter(lexical.terms(text)).items()
            )
            if i is not None and score > best.get(i, 0):
                best[i] = score
        out[item] = sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k]
    return {i: x for i, x in out.items() if x}


def found_ranks(df):
    out = {}
    for r in df.orderBy("item_id", "rank").collect():
        out.setdefault(r.item_id, []).append((r.doc_id, r.score))
        assert r.rank == len(out[r.item_id])
    return out


def test_terms():
    assert lexical.terms("A-b_C 9É x\x00y\x7f日本{z}") == ["a".encode(), b"b", b"c", "9É".encode(), b"x", b"y", "日本".encode(), b"z"]
    assert lexical.terms(None) == lexical.terms("") == lexical.terms(" \n-") == []


@pytest.mark.parametrize("sample, cells, pairs", [(8192, 8_000_000, 500_000), (40, 2000, 60)])
def test_search(spark, monkeypatch, sample, cells, pairs):
    """Whole tables at once, and in many segments, from a small sample and in several blocks of items."""
    monkeypatch.setattr(lexical, "CELLS", cells)
    docs = cases.documents(spark).unionByName(cases.documents(spark, seed=8).filter("doc_id between 10 and 39").withColumn("doc_id", F.col("doc_id") + 200))
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    items = [(i, texts[4 + i][1]) for i in range(20)] + [(30, texts[40][1]), (31, "zwölf w1 w1 w1"), (32, "short"), (33, ""), (34, None), (35, "nowhere")]
    asked = spark.createDataFrame(items + [(None, "w1"), (32, "zz")], "item_id long, text string")
    clash = {c: F.lit("x") for c in ("n", "places", "times", "term", "rank")}
    assert found_ranks(lexical.search(docs.withColumns(clash), asked.withColumns(clash), sample=sample, pairs=pairs)) == plain_search(texts, items)


def test_search_in_whole_numbers(spark):
    """Scores beyond what doubles hold exactly: an item of very many terms."""
    docs = [(i, " ".join(f"t{j}" for j in range(i, 400 + i))) for i in range(30)]
    items = [(1, " ".join(f"t{j}" for j in range(0, 430, 3)) + " t7" * 3_000_000)]
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert found_ranks(lexical.search(*frames)) == plain_search(docs, items)


def test_search_of_empty_tables(spark):
    docs, items = cases.empty(spark), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical.search(docs, items).count() == 0
    assert lexical.search(cases.documents(spark), items.limit(0)).count() == 0


def test_blocks_are_skipped():
    """Most blocks are passed over once thresholds are known, and the best documents still found."""
    rng = np.random.default_rng(6)
    n, n_places, groups = 600, 300, 30
    rows = [np.unique(np.concatenate([rng.choice(10, 2) + 10 * (d % groups), rng.choice(n_places, 12)])) for d in range(n)]
    row, place = np.repeat(np.arange(n), [len(r) for r in rows]), np.concatenate(rows)
    impact = rng.integers(1, 50, len(row)) * np.where(place // 10 == row % groups, 40, 1)
    places = [np.sort(rng.choice(10, 4, replace=False)) + 10 * (q % groups) for q in range(60)]
    queries = lexical.Queries(list(range(60)), places, [np.ones(4, np.int64)] * 60, 5)
    search = lexical.Search(queries, np.zeros(60, np.int64))
    search.segment(np.arange(n), row, place, impact, n_places, np.float64)
    grid = np.zeros((n, n_places))
    grid[row, place] = impact
    for q in range(60):
        score = grid[:, places[q]].sum(axis=1)
        want = [(i, int(score[i])) for i in np.lexsort((np.arange(n), -score))[:5]]
        assert sorted(search.best[q].items(), key=lambda x: (-x[1], x[0])) == want
    assert search.skipped > 0.5 * search.blocks and search.scored < 0.1 * search.pairs
