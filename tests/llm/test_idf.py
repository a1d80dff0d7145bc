"""Weights of shingles are counted over all documents, near copies once."""

import random

from tidegauge.llm import neardup


def test_phrases_of_some_documents_weigh_less(spark):
    """A phrase of 10 % of the documents weighs less than what one has, and what a group of near copies shares does not."""
    rng = random.Random(8)
    phrase = [f"p{i}" for i in range(30)]
    base = [f"w{i}" for i in range(100)]
    rows = []
    for i in range(1000):
        own = list(base) if i < 200 else [f"y{rng.randrange(10**6)}" for _ in range(100)]
        own[rng.randrange(100)] = f"x{i}"
        rows.append((i, " ".join(own + (phrase if 200 <= i < 300 else []))))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    idf = neardup.corpus_idf(docs)
    assert len(idf.common) == 26 and (idf.weight < idf.rare - 1).all()
    found = {r.doc_id: r.class_id for r in neardup.classes(docs).collect()}
    assert all(found[i] == 0 for i in range(200)) and all(found[i] == i for i in range(200, 1000))


def test_weights_do_not_depend_on_partitions(spark):
    rng = random.Random(5)
    phrase = " ".join(f"p{k}" for k in range(8))
    rows = [(i, " ".join(f"w{rng.randrange(999)}" for _ in range(40)) + " " + phrase * (i % 2)) for i in range(200)]
    rows += [(i, text) for i, text in rows[:50]] + [(None, None), (7, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    one, many = (neardup.corpus_idf(docs.repartition(n)) for n in (1, 23))
    assert len(one.common) and (one.common == many.common).all() and (one.weight == many.weight).all()
