"""Parameter texts of requests: ages (``150 ms``) and rates (``2/min``)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unit words of the parameter texts, in milliseconds.
UNIT_MS = {
    "ms": 1,
    "s": 1_000,
    "min": 60_000,
    "mins": 60_000,
    "hour": 3_600_000,
    "hours": 3_600_000,
}
RATE_UNITS = ("s", "min", "mins", "hour", "hours")
UNSET = "unset"


def parse_age(text: str | None) -> int | None:
    """Milliseconds of a literal age, None if unset; malformed text raises."""
    if text is None or text == UNSET:
        return None
    parts = text.split(" ")
    if len(parts) != 2 or parts[1] not in UNIT_MS or not parts[0].lstrip("-").isdigit():
        raise ValueError(f"malformed age {text!r}, expected '<int> <unit>'")
    return int(parts[0]) * UNIT_MS[parts[1]]


def parse_rate(text: str | None) -> tuple[int, int] | None:
    """(n, period in ms) of a literal rate, None if unset; malformed text raises."""
    if text is None or text == UNSET:
        return None
    parts = text.split("/")
    if len(parts) != 2 or parts[1] not in RATE_UNITS or not parts[0].isdigit():
        raise ValueError(f"malformed rate {text!r}, expected '<int>/<unit>'")
    return int(parts[0]), UNIT_MS[parts[1]]


def _unit_ms(unit: Column, allowed) -> Column:
    pairs = [x for u in allowed for x in (F.lit(u), F.lit(UNIT_MS[u]).cast("bigint"))]
    return F.try_element_at(F.create_map(*pairs), unit)


def age_ms(text: Column) -> Column:
    """Column form of :func:`parse_age`; unset or malformed text gives NULL."""
    n = F.split_part(text, F.lit(" "), F.lit(1)).try_cast("bigint")
    return n * _unit_ms(F.split_part(text, F.lit(" "), F.lit(2)), UNIT_MS)


def rate(text: Column) -> Column:
    """Column form of :func:`parse_rate` as STRUCT<n, period_ms>, NULL if malformed."""
    n = F.split_part(text, F.lit("/"), F.lit(1)).try_cast("bigint")
    period = _unit_ms(F.split_part(text, F.lit("/"), F.lit(2)), RATE_UNITS)
    return F.when(
        n.isNotNull() & period.isNotNull(),
        F.struct(n.alias("n"), period.alias("period_ms")),
    )


def per_second(text: Column) -> Column:
    """A rate text as events per second."""
    parsed = rate(text)
    return parsed["n"] * F.lit(1000.0) / parsed["period_ms"]
