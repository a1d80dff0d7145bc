"""Every operator on awkward rows and on empty tables."""

import hashlib
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tests.llm import cases
from tidegauge.llm import mixing, neardup, packing, quality, rules, sharding, tokencounts, topk, toxicity, wrappers
from tidegauge.llm.tokenize import Encoder, default_path

TOKENIZER = default_path()


@pytest.fixture(scope="module")
def docs(spark):
    return cases.documents(spark).cache()


@pytest.fixture(scope="module")
def some_labels(spark):
    return cases.labels(spark, [(i, i % 2, int(i % 5 == 0)) for i in range(10, 40)] + [(10, 1, 1), (None, 1, 1), (11, None, None)])


def ids(df):
    return Counter(r[0] for r in df.select("doc_id").collect())


def test_packing(spark, docs):
    rows = packing.pack_documents(docs, TOKENIZER, capacity=512, open_bins=3).collect()
    encode = Encoder(TOKENIZER)
    want = Counter()
    for r in docs.select("doc_id", "text").collect():
        whole = encode(r.text or "") + bytes(4)
        for at in range(0, len(whole), 2048):
            part = whole[at : at + 2048]
            want[r.doc_id, at // 2048, at // 4, len(part) // 4, zlib.crc32(part)] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 512
    assert packing.pack_documents(cases.empty(spark), TOKENIZER).count() == 0


def test_sharding(spark, docs):
    rows = sharding.shard_documents(docs, 4).collect()
    assert Counter(r.doc_id for r in rows) == ids(docs)
    for shard in {r.shard for r in rows}:
        slots = sorted(r.slot for r in rows if r.shard == shard)
        assert slots == list(range(len(slots)))
    assert len({r.shard for r in rows if r.doc_id in (50, 51)}) == 1
    assert sharding.shard_documents(cases.empty(spark)).count() == 0


def test_quality(spark, docs, some_labels):
    rows = quality.score_quality(docs, quality.fit_quality(docs, some_labels)).collect()
    assert Counter(r.doc_id for r in rows) == ids(docs)
    assert all(0 <= r.score <= 1 for r in rows)
    none = quality.fit_quality(docs, cases.labels(spark))
    assert {round(r.score, 6) for r in quality.score_quality(docs, none).collect()} == {0.5}
    model = quality.fit_quality(cases.empty(spark), some_labels)
    assert quality.score_quality(cases.empty(spark), model).count() == 0


def test_toxicity(spark, docs, some_labels):
    rows = toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, some_labels), carry=("lang", "score")).collect()
    assert Counter(r.doc_id for r in rows) == ids(docs)
    none = toxicity.fit_toxicity(docs, cases.labels(spark))
    assert {r.score for r in toxicity.score_toxicity(docs, none).collect()} == {0.0}
    assert toxicity.score_toxicity(cases.empty(spark), toxicity.fit_toxicity(cases.empty(spark), some_labels)).count() == 0


def test_rules(spark, docs, some_labels):
    rows = rules.quality_rules(docs, some_labels, carry=("doc_id", "text", "label")).collect()
    assert Counter(r.doc_id for r in rows) == ids(docs)
    assert not any(r.kept for r in rows if r.doc_id in (1, 2, 3, 53, 56))
    assert {r.n_words for r in rows if r.doc_id == 55} == {60_000}
    assert rules.quality_rules(docs, cases.labels(spark)).count() == len(rows)
    assert rules.quality_rules(cases.empty(spark), some_labels).count() == 0


def test_neardup(spark, docs):
    rows = neardup.classes(docs).collect()
    assert Counter(r.doc_id for r in rows) == ids(docs)
    of = {r.doc_id: r.class_id for r in rows}
    assert of[None] is None
    assert of[1] == of[2] == of[3] == 1
    assert of[50] == of[51] == of[52] == 50
    assert of[53] == of[54] == 53
    assert all(of[i] == i for i in [*range(10, 40), 55, 56, 57])
    assert neardup.classes(cases.empty(spark)).count() == 0


def test_mixing(spark, docs):
    rows = mixing.mix(docs, carry=("text", "source", "size")).collect()
    assert Counter(r.doc_id for r in rows) == ids(docs)
    assert all(0 <= r.taken <= 3 * (r[1]) for r in rows)
    empty = mixing.mix(cases.empty(spark))
    assert empty.count() == 0


def test_token_counts(spark, docs):
    blocks = tokencounts.token_blocks(docs, TOKENIZER)
    encode = Encoder(TOKENIZER)
    want = Counter((r.doc_id, len(encode(r.text or "")) // 4) for r in docs.select("doc_id", "text").collect())
    found = tokencounts.documents(blocks, names="ended").collect()
    assert Counter((r.name, r.n_tokens) for r in found) == want
    assert tokencounts.documents(tokencounts.token_blocks(cases.empty(spark), TOKENIZER), names="ended").count() == 0


def test_token_files_of_awkward_rows(spark, docs, tmp_path):
    folder = f"file:{tmp_path}/t"
    names = tokencounts.write_token_files(docs, folder, TOKENIZER)
    found = tokencounts.documents(tokencounts.file_blocks(spark, f"{folder}/ids")).withColumn("file", F.regexp_extract("file", "[^/]+$", 0))
    ids = Encoder(TOKENIZER)
    want = Counter((r.doc_id, len(ids(r.text or "")) // 4) for r in docs.collect())
    assert Counter((r.doc_id, r.n_tokens) for r in found.join(names, ["file", "ordinal"]).collect()) == want
    none = tokencounts.write_token_files(cases.empty(spark), f"{folder}0", TOKENIZER)
    assert none.count() == 0 and tokencounts.documents(tokencounts.file_blocks(spark, f"{folder}0/ids")).count() == 0


def test_search(spark):
    bad = [(50, None), (100, [1.0, None]), (150, [float("nan"), 1.0]), (200, [float("inf"), 1.0]), (None, [1.0, 1.0])]
    same = [(i, [0.5, 0.25]) for i in range(1, 9)] + [(3, [0.5, 0.25])]
    more = [(0, [0.5, 0.25]), (0, [0.5, 0.25]), (250, [1.0]), (300, []), (9, [1.0, 1.0, 1.0]), (10, [-1e30, 1.0])]
    df = spark.createDataFrame(bad + same + more, "vec_id long, embedding array<float>")
    df = df.withColumns({c: F.lit(1) for c in ("v", "cell", "score", "rank", "grp", "chunk", "asks")})
    found = {}
    for r in topk.search(topk.quantised(df), F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(found) == {0, 250, 300}
    assert found[0] == [(9, 192 * 1 * 256), (250, 128 * 256), (1, 128 * 128 + 64 * 64), (2, 20480), (3, 20480)]
    assert found[300] == [(0, 0), (1, 0), (2, 0), (3, 0), (4, 0)]
    two = spark.createDataFrame([(0, [1.0]), (50, [2.0])], "vec_id long, embedding array<float>")
    assert topk.search(topk.quantised(two), F.col("vec_id") % 50 == 0).count() == 2
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.search(topk.quantised(none), F.col("vec_id") % 50 == 0).count() == 0


def test_pages(spark):
    page = "<html><head><title>t{0}</title></head><body><div class='menu'>m</div><p>Same notice</p><article><h1>H{0}</h1><p>a &amp; b<p>c<br>d</article></body>"
    rows = [(i, "http://h.org/x", page.format(i)) for i in range(5)]
    rows += [(None, None, None), (7, "", ""), (8, "http://h.org/y", "no tags at all < 3"), (9, "http://k.org", "<p>" * 2000 + "deep"), (1, "http://h.org/x", page.format(1))]
    df = cases.with_clash(spark.createDataFrame(rows, "page_id long, url string, html string")).withColumn("host", F.lit("z"))
    found = wrappers.main_text(df).collect()
    assert Counter(r.page_id for r in found) == Counter(r[0] for r in rows)
    text = {r.page_id: r.text for r in found}
    assert text[2] == "H2\na & b\nc\nd"
    assert text[None] == "" and text[7] == "" and text[8] == "no tags at all < 3" and text[9] == "deep"
    assert all(r.n_chars == len(r.text) for r in found)
    assert wrappers.main_text(cases.empty(spark, "page_id long, url string, html string")).count() == 0


def test_a_sample_has_one_row_of_each_id(spark):
    from tidegauge.llm.labelled import fit_sample

    often = spark.range(100_000).select(F.lit(1).cast("long").alias("doc_id"), F.concat(F.lit("text "), F.col("id") % 977).alias("text"))
    rows = [(2, None), (2, "b"), (2, "b"), (3, None), (4, "d"), (None, "e")]
    docs = often.unionByName(spark.createDataFrame(rows, "doc_id long, text string"))
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 5)] + [(1, 0), (2, None)], "doc_id long, toxic int")
    held = {i for i in range(1, 5) if zlib.crc32(str(i).encode()) % 5 == 0}
    sample = {r.doc_id: (r.text, r.label) for r in fit_sample(docs, labels, "toxic", 10).collect()}
    smallest = min((f"text {i}" for i in range(977)), key=lambda t: hashlib.md5(t.encode()).hexdigest())
    want = {1: (smallest, 1), 2: ("b", 0), 3: (None, 1), 4: ("d", 0)}
    assert sample == {i: v for i, v in want.items() if i not in held} and len(sample) > 1
    assert fit_sample(docs, labels, "toxic", 10).count() == len(sample)


def test_mixing_spreads_rows_without_an_id(spark):
    """Rows that all lack an id are spread over ranges, and a rerun in another order takes the same of each text."""
    rows = [(None, f"w{i} " * (1 + i % 7), "en", f"s{i % 2}", 1) for i in range(4000)] + [(7, "a b c", "en", "s0", 1), (7, "d e f", "en", "s0", 1)]
    df = spark.createDataFrame(rows, cases.DOC_SCHEMA)
    order = F.md5(F.concat(F.lit("0:null:"), F.md5(F.col("text").cast("binary"))))
    assert df.where("doc_id is null").select(F.substring(order, 1, mixing.RANGES_DIGITS)).distinct().count() > 1500
    once = mixing.mix(df, carry=("text",))
    again = mixing.mix(df.orderBy(F.desc(F.xxhash64("text"))).repartition(3), carry=("text",))
    assert sorted(map(str, once.collect())) == sorted(map(str, again.collect()))
    for r in once.groupBy("source_size", "target").agg(F.sum("taken").alias("taken")).collect():
        assert abs(r.taken - r.target) <= 1


def test_pages_of_any_depth_and_runs_of_any_length(spark):
    def deep(i):
        return "<html><body>" + "<div>" * 20_000 + f"text {i}" + "</div>" * 20_000 + "<p>Same notice</p></body></html>"

    def long(n, i):
        return "<html><body><div>Same notice</div>" + "".join(f"<div>part {i} {j}</div>" for j in range(n)) + "</body></html>"

    rows = [(i, "http://deep.org/x", deep(i)) for i in range(5)]
    rows += [(100 * n + i, f"http://long{n}.org/x", long(n, i)) for n in (60, 70, 1500) for i in range(5)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for r in wrappers.main_text(df).collect():
        n, i = divmod(r.page_id, 100)
        assert r.text == (f"text {i}" if n == 0 else "\n".join(f"part {i} {j}" for j in range(n)))


def test_alignment_alone_on_given_pages(spark):
    """Pages whose names of classes and elements are taken away: what alignment finds, and that it finds more than no wrapper."""
    import re

    def bare(html):
        html = re.sub(r"""\s(class|id|role|itemprop)=("[^"]*"|'[^']*')""", "", html or "")
        return re.sub(r"<(/?)(article|main|nav|footer|header|aside)\b", r"<\1div", html)

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url", "html")
    want = {r.page_id: r.text for r in wrappers.main_text(pages).collect()}
    named = {r.page_id: (r.url, r.html) for r in pages.collect()}
    stripped = spark.createDataFrame([(i, u, bare(h)) for i, (u, h) in named.items()], "page_id long, url string, html string")
    found, shared, total, kept, plain = 0, 0, 0, 0, 0
    for r in wrappers.main_text(stripped).collect():
        words, own = Counter(want[r.page_id].split()), Counter(r.text.split())
        shared, total, kept = shared + sum((words & own).values()), total + sum(words.values()), kept + sum(own.values())
        alone = wrappers.extract(bare(named[r.page_id][1]), None)
        plain, found = plain + len(alone.split()), found + (alone != r.text)
    assert shared >= 0.99 * total and shared >= 0.88 * kept and kept < plain and found > 0
