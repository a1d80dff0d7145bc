"""Selection of observations: by sensor, value, age, attribute and level."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.functions.clock import as_column
from tidegauge.functions.params import parse_age
from tidegauge.functions.trail import first_trail_time
from tidegauge.schema import ATTRIBUTES, LEVELS, SMALLEST_POSITIVE_DOUBLE, Compat


def allow_sensors(
    obs: DataFrame,
    allowed: str | Sequence[str] | DataFrame,
    bypass_prefixes: Sequence[str] = (),
) -> DataFrame:
    """Keep producers on the list, or starting with a bypass prefix.

    The list is text separated by ``;``, a sequence, or a frame with a
    ``sensor_id`` column, which is joined instead of listed.
    """
    bypass = F.lit(False)
    for prefix in bypass_prefixes:
        bypass = bypass | F.col("producer").startswith(prefix)
    if isinstance(allowed, DataFrame):
        ids = allowed.select(F.col("sensor_id").alias("producer")).distinct()
        if not bypass_prefixes:
            return obs.join(ids, "producer", "left_semi").select(*obs.columns)
        marked = obs.join(ids.withColumn("_listed", F.lit(True)), "producer", "left")
        return marked.where(F.col("_listed").isNotNull() | bypass).select(*obs.columns)
    names = allowed.split(";") if isinstance(allowed, str) else list(allowed)
    return obs.where(F.col("producer").isin(*names) | bypass)


def filter_threshold(
    obs: DataFrame,
    minimum: float | Column | None = None,
    maximum: float | Column | None = None,
    compat: Compat = Compat(),
) -> DataFrame:
    """Keep ``minimum <= value <= maximum``; an unset or NULL side is open, NaN fails."""
    value = F.col("value")
    keep = ~F.isnan(value)
    unset_low = F.lit(SMALLEST_POSITIVE_DOUBLE if compat.positive_default_min else float("-inf"))
    low = unset_low if minimum is None else F.coalesce(as_column(minimum), unset_low)
    keep = keep & (value >= low)
    if maximum is not None:
        keep = keep & (value <= F.coalesce(as_column(maximum), F.lit(float("inf"))))
    return obs.where(keep)


def filter_age(
    obs: DataFrame, age_max: str | Column | None, as_of_ms: int | Column
) -> DataFrame:
    """Keep what was produced less than ``age_max`` before ``as_of_ms``.

    ``age_max`` is a text such as ``150 ms``, or a column of milliseconds in
    which NULL keeps the row.
    """
    age = as_column(as_of_ms) - first_trail_time(F.col("timestamps"))
    if isinstance(age_max, Column):
        return obs.where(age_max.isNull() | (age < age_max))
    limit = parse_age(age_max)
    return obs if limit is None else obs.where(age < F.lit(limit))


def check_attributes(names: Sequence[str]) -> list[str]:
    unknown = [n for n in names if n not in ATTRIBUTES]
    if unknown:
        raise ValueError(f"unknown quality attributes {unknown}")
    return list(names)


def select_attributes(values: Column, interested_in: str | Sequence[str] | Column) -> Column:
    """The map reduced to the wanted attributes, in the order of the wish list."""
    if isinstance(interested_in, Column):
        known = F.array(*[F.lit(a) for a in ATTRIBUTES])
        strange = F.array_except(interested_in, known)
        wanted = F.when(
            F.size(strange) > 0,
            F.raise_error(F.concat(F.lit("unknown quality attributes "), F.array_join(strange, ","))).cast(
                "array<string>"
            ),
        ).otherwise(F.coalesce(interested_in, F.array().cast("array<string>")))
    else:
        names = interested_in.split(";") if isinstance(interested_in, str) else interested_in
        names = check_attributes([n for n in names if n])
        if not names:
            return F.map_from_entries(F.array().cast("array<struct<key:string,value:string>>"))
        wanted = F.array(*[F.lit(n) for n in names])
    present = F.filter(F.array_distinct(wanted), lambda k: F.map_contains_key(values, k))
    return F.map_from_entries(F.transform(present, lambda k: F.struct(k, values[k])))


def project_level(obs: DataFrame, level: str, wire=None) -> DataFrame:
    """Delivered columns of a level; expects what the level needs to be attached."""
    from tidegauge.operators.knowledge import knowledge_nodes

    raw = ["date", "value", "producer", "timestamps", "qoOAttributeValues"]
    if level not in LEVELS:
        return obs.select(*raw).where(F.lit(False))
    if level == "RAW_DATA":
        return obs.select(*raw)
    if level == "INFORMATION":
        return obs.select(*raw, "sensorContext")
    return obs.select(knowledge_nodes(wire).alias("obs"))


def has_field(documents: DataFrame, field: str) -> DataFrame:
    """Documents that carry the field at all."""
    return documents.where(F.col(field).isNotNull())
