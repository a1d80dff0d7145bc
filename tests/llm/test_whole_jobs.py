"""Operators that once did less than their whole job, on tables small enough to reckon by hand."""

import json
from collections import Counter

import corpus_pipeline
from tidegauge.llm import mixing, wrappers


def test_the_mix_leaves_out_what_is_above_the_target(spark):
    """The words of each source in the stage's output are those that the mix takes."""
    rows = [(i, f"a{i} " * 10, "en", "a", 1) for i in range(300)]
    rows += [(1000 + i, f"b{i} " * 7, "en", "b", 1) for i in range(100)] + [(2000 + i, f"c{i} " * 9, "en", "c", 1) for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    planned, size, found = Counter(), Counter(), Counter()
    for r in mixing.mix(docs, carry=("source",)).collect():
        planned[r.source] += r.taken
        size[r.source] += r.size
    for r in corpus_pipeline.mixing(spark, docs, "").collect():
        found[r.source] += len(r.text.split())
        assert r.n_chars in (1, len(r.text))
    assert 0 < planned["a"] < size["a"] and planned["c"] > size["c"]
    assert found == planned


def test_a_host_whose_pages_have_one_title_has_a_wrapper():
    page = "<title>Our site</title><body><div>Open all day</div><div><p>Story {0} begins</p></div></body>"
    packed = wrappers.induce([page.format(i) for i in range(5)])
    assert wrappers.extract(page.format(9), wrappers.Wrapper(json.loads(packed))) == "Story 9 begins"
    assert wrappers.induce([page.format(1), page.format(1).replace("<body>", "<body >")]) is None


def test_near_duplicates_of_repeated_and_missing_ids(spark):
    x, y, z = (" ".join(f"{stem}{i}" for i in range(60)) for stem in "xyz")
    rows = [(3, x), (None, x), (None, z), (None, z)]
    for i in range(10, 20):  # each id stands with a copy of x and with a text of its own
        rows += [(i, x), (i, " ".join(f"{w}{i}" for w in y.split()))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    found = corpus_pipeline.near_duplicates(spark, docs, "")
    assert found.columns == docs.columns
    want = {(3, x), (None, z)} | {(i, t) for i, t in rows if i and t[0] == "y"}
    assert Counter((r.doc_id, r.text) for r in found.collect()) == Counter(want)
