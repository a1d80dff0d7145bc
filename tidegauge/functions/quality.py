"""Quality attributes of one observation, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidegauge.functions.clock import as_column
from tidegauge.schema import LARGEST_FLOAT, SMALLEST_POSITIVE_FLOAT, Compat


def parse_bound(text: Column, compat: Compat = Compat()) -> Column:
    """Capability bound as DOUBLE; ``-INF`` and ``+INF`` are allowed."""
    low = SMALLEST_POSITIVE_FLOAT if compat.float_infinity else float("-inf")
    high = LARGEST_FLOAT if compat.float_infinity else float("inf")
    return (
        F.when(text.contains("-INF"), F.lit(low))
        .when(text.contains("+INF"), F.lit(high))
        .otherwise(text.try_cast("double"))
    )


def accuracy(
    value: Column,
    low: Column,
    high: Column,
    scale: str = "fraction",
    compat: Compat = Compat(),
) -> Column:
    """100 inside [low, high]; outside, the share of one range width still left.

    The outside score is a fraction in 0..1 (``scale="percent"`` multiplies it
    by 100), 0.0 from one width away on and where a bound is unknown. A NaN
    value with known bounds gives NULL. With an infinite bound only the
    in-range test can score, as the width has no finite share.
    """
    if scale not in ("fraction", "percent"):
        raise ValueError(f"unknown scale {scale!r}")
    infinity = F.lit(float("inf"))
    width = high - low
    distance = F.greatest(low - value, value - high)
    share = (width - distance) / F.nullif(width, F.lit(0.0))
    if scale == "percent":
        share = share * 100.0
    in_range_nan = F.lit(1.0 if compat.nan_is_accurate else None).cast("double")
    return (
        F.when(low.isNull() | high.isNull(), F.lit(0.0))
        .when(F.isnan(value), in_range_nan)
        .when((value >= low) & (value <= high), F.lit(100.0))
        .when((distance >= width) | (width == infinity), F.lit(0.0))
        .otherwise(share)
    )


def freshness(date_ms: Column, as_of_ms: int | Column) -> Column:
    """Age in milliseconds as DOUBLE."""
    return (as_column(as_of_ms) - date_ms).cast("double")


def get_attribute(values: Column, name: str) -> Column:
    """Value of an attribute in the text map, empty text if absent."""
    return F.coalesce(F.try_element_at(values, F.lit(name)), F.lit(""))


def key_by_value(values: Column, wanted: str | Column) -> Column:
    """First key of a map that has this value, else NULL."""
    hits = F.filter(F.map_entries(values), lambda e: e["value"] == as_column(wanted))
    return F.try_element_at(hits, F.lit(1))["key"]


def inverse_variation(direction: Column) -> Column:
    """HIGH and LOW swapped, anything else unchanged."""
    return (
        F.when(direction == "HIGH", F.lit("LOW"))
        .when(direction == "LOW", F.lit("HIGH"))
        .otherwise(direction)
    )
