"""From raw documents to packed training sequences: five stages, each on all that the one before kept.

Toxic documents go, then those that quality rules reject, then all but one of each
group of near duplicates; sources are mixed to target weights, and the result is
packed. Every stage is written as Parquet in the shared folder and read again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.llm.common import shared_folder, table
from tidegauge.llm.mixing import mix
from tidegauge.llm.neardup import classes
from tidegauge.llm.packing import pack_documents
from tidegauge.llm.rules import quality_rules
from tidegauge.llm.tokenize import default_path
from tidegauge.llm.toxicity import fit_toxicity, score_toxicity

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Words with the white space before them.
SPACED_WORD = r"([\x20\x09-\x0D]*[^\x20\x09-\x0D]+)"


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score under 0.5."""
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"))
    return score_toxicity(docs, model, carry=COLUMNS).filter("score < 0.5").select(*COLUMNS)


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    judged = quality_rules(docs, table(spark, sf_dir, "labels"), carry=COLUMNS)
    return judged.filter("kept").select("carried.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near duplicates, that with the smallest id; those without an id come last.

    Rows are told apart by id and text, as an id may stand with several texts or be null.
    """
    rows = docs.select(F.xxhash64("doc_id", "text").alias("row"), *COLUMNS)
    found = classes(rows, key="row").distinct().withColumnRenamed("doc_id", "row")
    ids = rows.select("row", "doc_id").distinct()
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row")).alias("first")
    heads = found.join(ids, "row").groupBy("class_id").agg(first).select("first.row")
    kept = rows.join(heads, "row", "left_semi")
    return kept.groupBy("row").agg(F.min(F.struct(*COLUMNS)).alias("one")).select("one.*")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; what it takes in part is cut after so many words."""
    # without the filter, sequence(1, 0) would count down and give copies of what the mix leaves out
    taken = mix(docs, carry=COLUMNS).filter("whole > 0 or part > 0")
    taken = taken.withColumn("copy", F.explode(F.expr("sequence(1L, whole + if(part > 0, 1L, 0L))")))
    in_part = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(SPACED_WORD), 1), 1, F.col("part").cast("int")), "")
    text = F.when(F.col("copy") <= F.col("whole"), F.col("text")).otherwise(in_part)
    chars = F.when(F.col("copy") <= F.col("whole"), F.col("n_chars")).otherwise(F.length(in_part).cast("long"))
    return taken.select("doc_id", text.alias("text"), "lang", "source", chars.alias("n_chars"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every document in its sequence."""
    return pack_documents(docs, default_path())


STAGES = [
    ("toxicity", toxicity),
    ("quality rules", rules),
    ("near duplicates", near_duplicates),
    ("mixing", mixing),
    ("packing", packing),
]

#: Token ids and similarity of whole texts have no SQL form; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{number}")
        docs = spark.read.parquet(f"{folder}/{number}")
    return docs
