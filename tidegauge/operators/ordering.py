"""Next-row lookups that do not gather a hot key in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge.operators.segments import key_text


def with_next(
    df: DataFrame,
    order: str,
    keys: Sequence[str] = (),
    *,
    tie: Sequence[str] = (),
    chunk: int = 3_600_000,
    name: str = "next_value",
) -> DataFrame:
    """Add the ``order`` value (BIGINT) of the following row of the key, NULL for the last.

    ``order`` holds whole numbers, such as milliseconds.

    Rows of equal value follow each other by ``tie``; without it they all take
    the next greater value. Rows shrink to distinct values before they are
    ordered, within chunks of ``chunk`` units, so that no ordered group exceeds
    that many values; the last value of a chunk takes the first one of the
    key's next chunk.
    """
    kind = df.schema[order].dataType
    if not isinstance(kind, T.IntegralType):
        raise TypeError(f"{order} must hold whole numbers, not {kind.simpleString()}")
    group = ["_key", "_chunk"]
    rows = df.withColumns({"_key": key_text(df, keys), "_value": F.col(order).cast("bigint")})
    last = F.max(F.struct(*tie)) if tie else F.lit(None)
    width = F.lit(chunk).cast("bigint")
    values = (
        rows.where(F.col("_value").isNotNull())
        .groupBy("_key", "_value")
        .agg(last.alias("_last"))
        .withColumn("_chunk", ((F.col("_value") - F.pmod("_value", width)) / width).cast("bigint"))
    )
    heads = values.groupBy(*group).agg(F.min("_value").alias("_head"))
    later = Window.partitionBy("_key").orderBy("_chunk")
    follow = heads.select(*group, F.lead("_head").over(later).alias("_following"))
    inside = Window.partitionBy(*group).orderBy("_value")
    led = values.withColumn("_lead", F.lead("_value").over(inside)).join(follow, group)
    lookup = led.select("_key", "_value", "_last", F.coalesce("_lead", "_following").alias("_next"))
    found = rows.join(lookup, ["_key", "_value"], "left")
    following = F.col("_next")
    if tie:
        following = F.when(F.struct(*tie) < F.col("_last"), F.col("_value")).otherwise(following)
    return found.select(*df.columns, following.alias(name))
