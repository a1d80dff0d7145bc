"""Schemas, closed vocabularies and the two settings objects of the library."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Closed vocabularies of the message formats.
LEVELS = ("RAW_DATA", "INFORMATION", "KNOWLEDGE")
LEVEL_ABBREVIATIONS = {"RAW_DATA": "RD", "INFORMATION": "INFO", "KNOWLEDGE": "KNOW"}
ATTRIBUTES = ("OBS_RATE", "OBS_FRESHNESS", "OBS_ACCURACY")
OPERATORS = ("NONE", "AVG", "MIN", "MAX")
SLA_LEVELS = ("BEST_EFFORT", "GUARANTEED")
STATUSES = ("CREATED", "SUBMITTED", "ENFORCED", "HEALED", "REJECTED", "REMOVED")
NOT_AVAILABLE = "N/A"
ALL = "ALL"

# Which status may follow which.
TRANSITIONS = (
    ("CREATED", "SUBMITTED"),
    ("CREATED", "REJECTED"),
    ("SUBMITTED", "ENFORCED"),
    ("ENFORCED", "HEALED"),
    ("HEALED", "HEALED"),
    ("HEALED", "ENFORCED"),
    ("HEALED", "REMOVED"),
    ("ENFORCED", "REMOVED"),
)

CONTEXT_FIELDS = ("latitude", "longitude", "altitude", "relativeLocation", "topic")

# Every field is read as text: producers quote their numbers, re-encoded
# messages do not, and a STRING field accepts both.
MESSAGE_TEXT = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("date", "value", "producer", "timestamps")]
)

OBSERVATION = T.StructType(
    [
        T.StructField("date", T.TimestampType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("producer", T.StringType()),
        T.StructField("timestamps", T.StringType()),
    ]
)

TRIPLE = T.StructType([T.StructField(n, T.StringType()) for n in ("s", "p", "o")])

STATE = T.StructType(
    [
        T.StructField("status", T.StringType()),
        T.StructField("start_date", T.LongType()),
        T.StructField("end_date", T.LongType()),
    ]
)


@dataclass(frozen=True)
class WireNames:
    """Names that a deployment chooses for itself and that appear in messages.

    ``base_iri`` is the namespace of sensors, places and quality nodes,
    ``in_step`` / ``out_step`` are the trail steps stamped on entry and exit,
    ``params_field`` is the field of a request that holds the built-in
    quality parameters.
    """

    base_iri: str = "http://example.org/observation-quality#"
    in_step: str = "platform_in"
    out_step: str = "platform_out"
    params_field: str = "platform_params"

    def request_schema(self) -> T.StructType:
        text_map = T.MapType(T.StringType(), T.StringType())
        quality = T.StructType(
            [
                T.StructField("interested_in", T.ArrayType(T.StringType())),
                T.StructField("operator", T.StringType()),
                T.StructField("sla_level", T.StringType()),
                T.StructField(self.params_field, text_map),
                T.StructField("custom_params", text_map),
            ]
        )
        names = ("request_id", "application_id", "topic", "location", "obs_level")
        return T.StructType(
            [T.StructField(n, T.StringType()) for n in names]
            + [
                T.StructField("qoo", quality),
                T.StructField("statesList", T.ArrayType(STATE)),
                T.StructField("logs", T.ArrayType(T.StringType())),
            ]
        )


@dataclass(frozen=True)
class Compat:
    """Switches that bring back surprising behaviour of the original platform.

    All are off by default; each names one rule and nothing else.
    """

    positive_default_min: bool = False
    """An unset lower threshold is the smallest positive double."""
    nan_is_accurate: bool = False
    """A NaN value inside known bounds scores 1.0 instead of NULL."""
    float_infinity: bool = False
    """-INF/+INF bounds become the smallest/largest positive float."""
    attributes_need_capabilities: bool = False
    """No attribute is attached while the capability table is empty."""
    any_known_place: bool = False
    """Any known place name selects all sensors of the topic."""
    shared_needs_custom_params: bool = False
    """Requests are equal only if both carry custom parameters."""
    per_second_minimum: bool = False
    """The unit of a minimum rate is ignored and read as per second."""
    bypass_prefixes: tuple[str, ...] = ()
    """Producers starting with one of these pass every allow-list."""


# Limits used by the compat switches above.
SMALLEST_POSITIVE_DOUBLE = 4.9e-324
SMALLEST_POSITIVE_FLOAT = 1.401298464324817e-45
LARGEST_FLOAT = 3.4028234663852886e38


def has_column(df: DataFrame, name: str) -> bool:
    return name in df.columns


def require_columns(df: DataFrame, *names: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; have {df.columns}")
