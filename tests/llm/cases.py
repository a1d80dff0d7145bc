"""Small tables with the awkward cases: nulls, empty and long texts, ties, repeated rows, clashing extra columns."""

import random

from pyspark.sql import Row

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Extra columns named like what operators use inside or return.
CLASH = ("score", "size", "label", "node", "text_crc32", "words", "key", "hub", "shard", "row", "terms", "a", "b", "own", "carried")


def words(rng, n, stem="w"):
    return " ".join(f"{stem}{rng.randrange(4000)}" for _ in range(n))


def documents(spark, clash=True, seed=7):
    rng = random.Random(seed)
    rows = [(None, words(rng, 60), "en", "x", 1), (1, None, None, None, None), (2, "", "en", "x", 0), (3, " \n\t ", "en", None, 4)]
    base = words(rng, 120)
    for i in range(10, 40):
        rows.append((i, words(rng, rng.randrange(1, 200)), ("en", "de")[i % 2], f"s{i % 3}", 1))
    rows += [(50, base, "en", "s1", 1), (51, base, "en", "s1", 1), (51, base, "en", "s1", 1)]
    edited = base.split()
    edited[60] = "changed"
    rows.append((52, " ".join(edited), "en", "s2", 1))
    rows.append((53, "short", "en", "s2", 1))
    rows.append((54, "short", "en", None, 1))
    rows.append((55, words(rng, 60_000), "en", "s0", 1))
    rows.append((56, "é" * 300_000, "fr", "s0", 1))
    rows.append((57, "zwölf 日本 <|endoftext|> \x1c x\n\nzwölf 日本", "de", "s0", 1))
    df = spark.createDataFrame([Row(*r) for r in rows], DOC_SCHEMA)
    return with_clash(df) if clash else df


def with_clash(df):
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit("clash") for c in CLASH if c not in df.columns})


def empty(spark, schema=DOC_SCHEMA):
    return spark.createDataFrame([], schema)


def labels(spark, rows=()):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")
