"""The linked-data form of a scored observation: nodes and triples."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.functions.naming import date_text
from tidegauge.schema import ATTRIBUTES, NOT_AVAILABLE, WireNames
from tidegauge.sources.vocabulary import iri

# The keys of a node in output order, with the property each stands for.
NODE_KEYS = {
    "alt": "geo:alt",
    "altRelative": "iot-lite:altRelative",
    "featureOfInterest": "ssn:featureOfInterest",
    "hasQoO": "qoo:hasQoO",
    "hasQoOValue": "qoo:hasQoOValue",
    "hasQuantityKind": "iot-lite:hasQuantityKind",
    "hasUnit": "iot-lite:hasUnit",
    "hasValue": "ssn:hasValue",
    "isAbout": "qoo:isAbout",
    "lat": "geo:lat",
    "location": "geo:location",
    "long": "geo:long",
    "obsDateValue": "qoo:obsDateValue",
    "obsLevelValue": "qoo:obsLevelValue",
    "obsStrValue": "qoo:obsStrValue",
    "obsTimestampsValue": "qoo:obsTimestampsValue",
    "observationResult": "ssn:observationResult",
    "observedBy": "ssn:observedBy",
    "observedProperty": "ssn:observedProperty",
    "qooStrValue": "qoo:qooStrValue",
    "relativeLocation": "iot-lite:relativeLocation",
    "_1": "rdf:_1",
    "_2": "rdf:_2",
    "_3": "rdf:_3",
}

# Unit and kind of each attribute that has them.
ATTRIBUTE_UNITS = {"OBS_ACCURACY": ("accuracy", "Percent"), "OBS_FRESHNESS": ("freshness", "Millisecond")}

# Sensor columns used besides the five context fields.
SENSOR_EXTRAS = ("relative_altitude", "quantity_kind", "unit", "feature")


@dataclass(frozen=True)
class _Node:
    """A node: its id, type, fields by key, and whether it is there at all."""

    identity: Column
    kind: str
    fields: Mapping[str, Column]
    present: Column | None = None


def _nodes(wire: WireNames, zone: str) -> list[_Node]:
    def own(name: str) -> Column:
        return F.lit(wire.base_iri + name)

    def term(curie: str) -> str:
        return iri(curie, wire)

    def known(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(NOT_AVAILABLE))

    context, values = F.col("sensorContext"), F.col("qoOAttributeValues")
    sensor = F.concat(F.lit(wire.base_iri), F.col("producer"))
    listed = F.map_keys(values)
    topic = context["topic"]
    nodes = [
        _Node(
            own("obs"),
            term("ssn:Observation"),
            {
                "featureOfInterest": known("feature"),
                "observationResult": own("sensorOutput"),
                "observedBy": sensor,
                "observedProperty": F.when(topic == NOT_AVAILABLE, topic).otherwise(
                    F.concat(F.lit(wire.base_iri), topic)
                ),
            },
        ),
        _Node(sensor, term("ssn:Sensor"), {"location": own("location")}),
        _Node(
            own("location"),
            term("geo:Point"),
            {
                "alt": context["altitude"],
                "altRelative": known("relative_altitude"),
                "lat": context["latitude"],
                "long": context["longitude"],
                "relativeLocation": context["relativeLocation"],
            },
        ),
        _Node(own("sensorOutput"), term("ssn:SensorOutput"), {"hasValue": own("obsValue")}),
        _Node(
            own("obsValue"),
            term("ssn:ObservationValue"),
            {
                "hasQoO": F.when(F.size(listed) > 0, own("qooAttributesList")),
                "hasQuantityKind": known("quantity_kind"),
                "hasUnit": known("unit"),
                "obsDateValue": date_text(F.col("date"), zone),
                "obsLevelValue": F.lit("KNOWLEDGE"),
                "obsStrValue": F.col("value").cast("string"),
                "obsTimestampsValue": F.col("timestamps"),
            },
        ),
        _Node(
            own("qooAttributesList"),
            "rdf:Seq",
            {
                f"_{i}": F.concat(own("qooIntrinsic_"), F.try_element_at(listed, F.lit(i)))
                for i in range(1, len(ATTRIBUTES) + 1)
            },
        ),
    ]
    for name in ATTRIBUTES:
        value = F.try_element_at(values, F.lit(name))
        here = value.isNotNull()
        about = {"hasQoOValue": own("qooValue_" + name), "isAbout": F.lit(name)}
        amount = {"qooStrValue": value}
        if name in ATTRIBUTE_UNITS:
            stem, unit = ATTRIBUTE_UNITS[name]
            amount |= {"hasQuantityKind": own(stem + "Kind"), "hasUnit": own(stem + "Unit")}
            nodes.append(_Node(own(stem + "Kind"), term("m3-lite:Others"), {}, here))
            nodes.append(_Node(own(stem + "Unit"), term("m3-lite:" + unit), {}, here))
        nodes.append(_Node(own("qooIntrinsic_" + name), term("qoo:QoOIntrisicQuality"), about, here))
        nodes.append(_Node(own("qooValue_" + name), term("qoo:QoOValue"), amount, here))
    return nodes


def knowledge_nodes(wire: WireNames | None = None, zone: str = "UTC") -> Column:
    """ARRAY of nodes, sorted by id, of a row with the columns of an information row.

    Reads ``date, value, producer, timestamps, qoOAttributeValues,
    sensorContext`` and the sensor columns ``relative_altitude, quantity_kind,
    unit, feature``; NULL there reads as ``N/A``. Keys absent from a node are
    NULL, which JSON output drops.
    """
    none = F.lit(None).cast("string")

    def struct(node: _Node) -> Column:
        fields = [node.fields.get(k, none).alias(k) for k in NODE_KEYS]
        whole = F.struct(node.identity.alias("@id"), F.lit(node.kind).alias("@type"), *fields)
        return whole if node.present is None else F.when(node.present, whole)

    nodes = F.array_compact(F.array(*[struct(n) for n in _nodes(wire or WireNames(), zone)]))
    return F.array_sort(nodes)


def knowledge_triples(
    obs: DataFrame, keep: tuple[str, ...] = ("obs_id",), wire: WireNames | None = None, zone: str = "UTC"
) -> DataFrame:
    """The same graph as (keep..., s, p, o) rows."""
    wire = wire or WireNames()
    columns = [c for c in keep if c in obs.columns]
    rows = []
    for node in _nodes(wire, zone):
        pairs = {"rdf:type": F.lit(node.kind), **{NODE_KEYS[k]: v for k, v in node.fields.items()}}
        for curie, value in pairs.items():
            target = value if node.present is None else F.when(node.present, value)
            rows.append(F.struct(node.identity.alias("s"), F.lit(iri(curie, wire)).alias("p"), target.alias("o")))
    return obs.select(*columns, F.inline(F.array(*rows))).where(F.col("o").isNotNull())
