"""A bounded sample of labelled texts to fit a classifier on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import cut, fold


def fit_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text, label of labelled texts outside fold 0, written once.

    At most ``per_class`` labelled ids of each class, the first in the order of
    their md5, which is the same for any layout of the table. The ids are the only
    thing that is sent to all tasks, so its size is bounded by the parameter.
    Contradicting labels of an id count as its highest; null labels and ids are left out.
    An id that stands with several texts gives one row, that of the smallest md5 of
    the text (a null text only where there is no other), so that the sample has at
    most twice ``per_class`` rows however often an id is repeated.
    """
    ids = labels.filter(F.col(label).isin(0, 1) & F.col(key).isNotNull())
    ids = ids.groupBy(F.col(key).cast("long").alias("own")).agg(F.max(label).cast("int").alias("own_label"))
    ids = ids.filter(fold(F.col("own")) != 0).withColumn("order", F.md5(F.col("own").cast("string").cast("binary")))
    classes = [ids.filter(F.col("own_label") == c).orderBy("order", "own").limit(per_class) for c in (0, 1)]
    chosen = classes[0].unionByName(classes[1]).select("own", "own_label")
    rows = docs.select(F.col(key).cast("long").alias("own"), F.col(text).alias("own_text"))
    joined = rows.join(F.broadcast(chosen), "own")
    first = F.min_by("own_text", F.md5(F.col("own_text").cast("binary")))
    single = joined.groupBy("own", "own_label").agg(first.alias("text"))
    return cut(single.select(F.col("own").alias("doc_id"), "text", F.col("own_label").alias("label")))
