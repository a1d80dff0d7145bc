"""Sensor context, capabilities and quality scores attached to observations."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.functions.clock import as_column, epoch_ms
from tidegauge.functions.quality import accuracy, freshness, parse_bound
from tidegauge.operators.filters import check_attributes, select_attributes
from tidegauge.schema import NOT_AVAILABLE, Compat

# Columns of the sensor table behind the five context fields.
CONTEXT_SOURCES = {
    "latitude": "latitude",
    "longitude": "longitude",
    "altitude": "altitude",
    "relativeLocation": "relative_location",
    "topic": "topic",
}


def one_per_sensor(rows: DataFrame, order_by: str | None = None) -> DataFrame:
    """The last row of each sensor by ``order_by`` (else by content); combines before the shuffle."""
    others = [c for c in rows.columns if c != "sensor_id"]
    whole = F.struct(*others)
    order = F.struct(F.col(order_by), whole) if order_by else whole
    last = rows.groupBy("sensor_id").agg(F.max_by(whole, order).alias("_last"))
    return last.select("sensor_id", "_last.*")


def with_sensor_context(obs: DataFrame, sensors: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """Left join by producer; adds ``sensorContext`` with ``N/A`` for unknown sensors.

    ``extra`` names further sensor columns to carry along, NULL if unknown.
    """
    present = [c for c in CONTEXT_SOURCES.values() if c in sensors.columns]
    side = one_per_sensor(sensors.select("sensor_id", *dict.fromkeys([*present, *extra])))
    side = side.select(
        F.col("sensor_id").alias("producer"),
        F.struct(
            *[
                F.coalesce(F.col(c) if c in present else F.lit(None), F.lit(NOT_AVAILABLE)).alias(f)
                for f, c in CONTEXT_SOURCES.items()
            ]
        ).alias("_context"),
        *[F.col(c).alias(f"_extra_{c}") for c in extra],
    )
    unknown = F.struct(*[F.lit(NOT_AVAILABLE).alias(f) for f in CONTEXT_SOURCES])
    joined = obs.join(side, "producer", "left")
    return joined.select(
        *obs.columns,
        F.coalesce("_context", unknown).alias("sensorContext"),
        *[F.col(f"_extra_{c}").alias(c) for c in extra],
    )


def with_capability(
    obs: DataFrame, capabilities: DataFrame, order_by: str | None = None, compat: Compat = Compat()
) -> DataFrame:
    """Left join of the bounds ``min_value`` and ``max_value`` as DOUBLE, NULL if unknown."""
    names = ["sensor_id", "min_value", "max_value"]
    wanted = names + ([order_by] if order_by and order_by not in names else [])
    side = one_per_sensor(capabilities.select(*wanted), order_by).select(
        F.col("sensor_id").alias("producer"),
        parse_bound(F.col("min_value"), compat).alias("min_value"),
        parse_bound(F.col("max_value"), compat).alias("max_value"),
    )
    return obs.join(side, "producer", "left").select(*obs.columns, "min_value", "max_value")


@dataclass(frozen=True)
class Attribute:
    """A quality attribute: an expression over a frame and the columns it needs."""

    name: str
    compute: Callable[[DataFrame], Column]
    params: tuple[str, ...] = ()


@dataclass
class AttributeRegistry:
    """Attributes by name; applications add their own with :meth:`register`."""

    known: dict[str, Attribute] = field(default_factory=dict)

    def register(
        self, name: str, compute: Callable[[DataFrame], Column], params: Sequence[str] = ()
    ) -> Attribute:
        attribute = Attribute(name, compute, tuple(params))
        self.known[name] = attribute
        return attribute

    def column(self, df: DataFrame, name: str) -> Column:
        if name not in self.known:
            raise ValueError(f"unknown quality attribute {name!r}")
        missing = [p for p in self.known[name].params if p not in df.columns]
        if missing:
            raise ValueError(f"attribute {name!r} needs columns {missing}")
        return self.known[name].compute(df)


def default_attributes(
    as_of_ms: int | Column, scale: str = "fraction", compat: Compat = Compat()
) -> AttributeRegistry:
    """Accuracy from the sensor's bounds and freshness from the date."""
    registry = AttributeRegistry()
    registry.register(
        "OBS_ACCURACY",
        lambda df: accuracy(F.col("value"), F.col("min_value"), F.col("max_value"), scale, compat),
        ("value", "min_value", "max_value"),
    )
    registry.register("OBS_FRESHNESS", lambda df: freshness(epoch_ms(df, "date"), as_column(as_of_ms)), ("date",))
    return registry


def score(obs: DataFrame, interested_in: Sequence[str], registry: AttributeRegistry) -> DataFrame:
    """Add one DOUBLE column per wanted attribute, in lower case."""
    scored = [n for n in dict.fromkeys(interested_in) if n in registry.known]
    return obs.withColumns({n.lower(): registry.column(obs, n) for n in scored}) if scored else obs


def attach_attributes(obs: DataFrame, interested_in: str | Sequence[str]) -> DataFrame:
    """Add ``qoOAttributeValues``, the scored attributes as text in wish order."""
    names = interested_in.split(";") if isinstance(interested_in, str) else list(interested_in)
    names = check_attributes([n for n in names if n])
    scored = [n for n in names if n.lower() in obs.columns]
    if not scored:
        empty = F.array().cast("array<struct<key:string,value:string>>")
        return obs.withColumn("qoOAttributeValues", F.map_from_entries(empty))
    full = F.create_map(*[x for n in scored for x in (F.lit(n), F.col(n.lower()).cast("string"))])
    full = F.map_filter(full, lambda k, v: v.isNotNull())
    return obs.withColumn("qoOAttributeValues", select_attributes(full, scored))
