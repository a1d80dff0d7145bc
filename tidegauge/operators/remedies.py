"""Choice of remedies that raise one attribute without harming others."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.functions.quality import inverse_variation
from tidegauge.operators.filters import check_attributes
from tidegauge.schema import ATTRIBUTES


def remedies_preserving(
    effects: DataFrame, targets: DataFrame, priority: str, preserve: Sequence[str] = ()
) -> DataFrame:
    """Effect rows that move ``priority`` the right way and whose parameter spares the rest.

    ``effects``: remedy, param, type, min, max, initial, attribute,
    param_variation, attribute_variation. ``targets``: name, should_be. A
    parameter is ruled out by any effect that moves another preserved attribute
    against its target. An empty result means there is no suitable remedy.
    """
    check_attributes([priority, *preserve])
    good = targets.where(F.col("name") == priority).select(
        F.col("name").alias("attribute"), F.col("should_be").alias("attribute_variation")
    )
    others = [a for a in preserve if a != priority]
    helping = effects.join(good, ["attribute", "attribute_variation"]).select(*effects.columns)
    if others:
        bad = targets.where(F.col("name").isin(*others)).select(
            F.col("name").alias("attribute"), inverse_variation(F.col("should_be")).alias("attribute_variation")
        )
        harmful = effects.join(bad, ["attribute", "attribute_variation"]).select("param").distinct()
        helping = helping.join(harmful, "param", "left_anti")
    return helping.select(
        "remedy", "param", "type", "min", "max", "initial", "attribute", "param_variation", "attribute_variation"
    ).distinct()


def remedy_of_requests(effects: DataFrame, targets: DataFrame, requests: DataFrame, priority: str = "OBS_RATE") -> DataFrame:
    """The first remedy by name that suits each request's own ``interested_in``: request_id and the remedy's columns.

    Requests differ only in which attributes they want spared, and there are few
    attributes: one pass over the effects finds the first remedy for every set of
    them, and requests meet these by set. A request without a row has no remedy.
    """
    check_attributes([priority])
    others = [a for a in ATTRIBUTES if a != priority]
    helping = remedies_preserving(effects, targets, priority)
    against = targets.select(F.col("name").alias("attribute"), inverse_variation(F.col("should_be")).alias("attribute_variation"))
    harmed = [F.coalesce(F.max(F.col("attribute") == a), F.lit(False)).alias(f"_harms_{a}") for a in others]
    harmful = effects.join(against, ["attribute", "attribute_variation"]).groupBy("param").agg(*harmed)
    judged = helping.join(harmful, "param", "left")
    whole = F.struct(*[c for c in helping.columns])
    sets = range(1 << len(others))

    def first(wanted: int):
        spared = F.lit(True)
        for i, name in enumerate(others):
            if wanted >> i & 1:
                spared = spared & ~F.coalesce(F.col(f"_harms_{name}"), F.lit(False))
        return F.struct(F.lit(wanted).alias("_set"), F.min(F.when(spared, whole)).alias("_remedy"))

    best = judged.agg(F.array(*[first(w) for w in sets]).alias("_best")).select(F.inline("_best")).where("_remedy is not null")
    wishes = F.coalesce(F.col("interested_in"), F.array().cast("array<string>"))
    own = sum((F.array_contains(wishes, name).cast("int") * (1 << i) for i, name in enumerate(others)), F.lit(0))
    return requests.select("request_id", own.alias("_set")).join(best, "_set").select("request_id", "_remedy.*")
