"""Aggregates over observations, reports and documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.schema import OPERATORS


def aggregate_observations(
    obs: DataFrame, operator: str, window: str, *, ts: str = "date", keys: Sequence[str] = ("topic",)
) -> DataFrame:
    """AVG, MIN or MAX of ``value`` per key and epoch-aligned window; NONE passes rows on.

    Key and window are the caller's choice, as a request names only the
    operator. NaN values are left out.
    """
    if operator not in OPERATORS:
        raise ValueError(f"unknown operator {operator!r}")
    if operator == "NONE":
        return obs
    function = {"AVG": F.avg, "MIN": F.min, "MAX": F.max}[operator]
    usable = obs.where(~F.isnan("value"))
    return (
        usable.groupBy(*keys, F.window(ts, window).alias("_w"))
        .agg(function("value").alias("value"), F.count(F.lit(1)).alias("n"))
        .select(*keys, F.col("_w.start").alias("window_start"), "value", "n")
    )


def total_rate(reports: DataFrame, keys: Sequence[str] = ("report_ms",)) -> DataFrame:
    """Sum of a rate report over its producers."""
    return reports.groupBy(*keys).agg(F.sum("n").alias("n"))


def platform_counters(documents: DataFrame, exact: bool = True) -> DataFrame:
    """Distinct applications, producers and requests among documents with an application."""
    wanted = documents.where(F.col("application_id").isNotNull())
    names = {"application_id": "applications", "producer": "producers", "request_id": "requests"}
    return wanted.agg(*[distinct_count(c, exact).alias(n) for c, n in names.items() if c in documents.columns])


def distinct_count(column: str, exact: bool = True) -> Column:
    return F.countDistinct(column) if exact else F.approx_count_distinct(column)


def container_counter(documents: DataFrame, column: str = "container") -> DataFrame:
    return documents.agg(F.countDistinct(column).alias("containers"))


def nest_effects(rows: DataFrame) -> DataFrame:
    """Flat effect rows to one row per parameter with a sorted ``has`` array."""
    effect = F.struct("attribute", "param_variation", "attribute_variation")
    return rows.groupBy("remedy", "param", "type", "min", "max", "initial").agg(
        F.array_sort(F.collect_set(effect)).alias("has")
    )


def nest_params(params: DataFrame) -> DataFrame:
    """Parameter rows to one row per remedy with a sorted ``customizable_params`` array."""
    param = F.struct("param", "type", "min", "max", "initial", "has")
    return params.groupBy("remedy").agg(F.array_sort(F.collect_set(param)).alias("customizable_params"))


def first_remedy(remedies: DataFrame) -> DataFrame:
    """The remedy that is first by name."""
    whole = F.struct(*remedies.columns)
    return remedies.agg(F.min_by(whole, "remedy").alias("_first")).where("_first is not null").select("_first.*")
