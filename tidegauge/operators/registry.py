"""Registry queries over a ``triples(s, p, o)`` frame with full IRIs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.functions.naming import local_name
from tidegauge.functions.quality import parse_bound
from tidegauge.operators.spread import distinct
from tidegauge.schema import Compat, WireNames
from tidegauge.sources.vocabulary import expand, iri

SENSOR_COLUMNS = (
    "sensor",
    "topic",
    "feature",
    "unit",
    "quantity_kind",
    "url",
    "interface_type",
    "interface_description",
    "longitude",
    "latitude",
    "altitude",
    "relative_altitude",
    "relative_location",
)
PLACE_COLUMNS = ("latitude", "longitude", "altitude", "relative_location", "relative_altitude")

# Place properties by column.
_PLACE = {
    "longitude": "geo:long",
    "latitude": "geo:lat",
    "altitude": "geo:alt",
    "relative_altitude": "iot-lite:altRelative",
    "relative_location": "iot-lite:relativeLocation",
}
# Service properties by column.
_SERVICE = {
    "url": "iot-lite:endpoint",
    "interface_type": "iot-lite:interfaceType",
    "interface_description": "iot-lite:interfaceDescription",
}


class Registry:
    """Triples with helpers for the fixed graph patterns of the queries.

    A pattern around one subject is answered by one grouping of the wanted
    predicates, not by one join per predicate; patterns that lead from node to
    node are equi-joins.
    """

    def __init__(self, triples: DataFrame, wire: WireNames | None = None):
        self.triples = triples
        self.wire = wire or WireNames()

    def iri(self, curie: str) -> str:
        return iri(curie, self.wire)

    def links(self, predicate: str, subject: str, target: str) -> DataFrame:
        """Distinct (subject, object) pairs of one predicate."""
        hits = self.triples.where(F.col("p") == self.iri(predicate))
        return hits.select(F.col("s").alias(subject), F.col("o").alias(target)).distinct()

    def of_type(self, curie: str, subject: str) -> DataFrame:
        kind = (F.col("p") == self.iri("rdf:type")) & (F.col("o") == self.iri(curie))
        return self.triples.where(kind).select(F.col("s").alias(subject)).distinct()

    def star(self, subject: str, wanted: dict[str, str], kind: str | None = None) -> DataFrame:
        """Subjects that have all wanted predicates, one row per combination of values.

        For predicates with few values per subject; for others use ``links``.
        """
        by_iri = {self.iri(curie): name for name, curie in wanted.items()}
        use = F.col("p").isin(*by_iri)
        if kind:
            use = use | ((F.col("p") == self.iri("rdf:type")) & (F.col("o") == self.iri(kind)))
        sets = [
            F.collect_set(F.when(F.col("p") == full, F.col("o"))).alias(name) for full, name in by_iri.items()
        ]
        typed = F.max(F.col("p") == self.iri("rdf:type")).alias("_typed")
        rows = self.triples.where(use).groupBy(F.col("s").alias(subject)).agg(*sets, typed)
        if kind:
            rows = rows.where("_typed")
        rows = rows.drop("_typed")
        for name in wanted:
            others = [c for c in rows.columns if c != name]
            rows = rows.select(*others, F.explode(name).alias(name))
        return rows.select(subject, *wanted)

    # Sensors, topics and places

    def sensors(self, sensor_id: str | None = None) -> DataFrame:
        """Sensors with topic, unit, service and place; optionally one by its short id."""
        wanted = {
            "_obs": "ssn:madeObservation",
            "_service": "iot-lite:exposedBy",
            "_place": "geo:location",
        }
        sensor = self.star("sensor", wanted, kind="ssn:Sensor")
        if sensor_id is not None:
            ids = self.links("iot-lite:id", "sensor", "_id").where(F.col("_id") == sensor_id)
            sensor = sensor.join(ids.select("sensor"), "sensor", "left_semi")
        made = self.star("_obs", {"_result": "ssn:observationResult", "topic": "ssn:observedProperty"})
        value = self.links("iot-lite:hasValue", "_result", "_value")
        measured = self.star("_value", {"_unit": "iot-lite:hasUnit", "_kind": "iot-lite:hasQuantityKind"})
        types = self.links("rdf:type", "_node", "_type")
        units = types.select(F.col("_node").alias("_unit"), F.col("_type").alias("unit"))
        kinds = types.select(F.col("_node").alias("_kind"), F.col("_type").alias("quantity_kind"))
        feature = self.links("ssn:isPropertyOf", "topic", "feature")
        service = self.star("_service", _SERVICE)
        offered = self.links("qoo:canBeRetrievedThrough", "_property", "_service").select("_service")
        place = self.star("_place", _PLACE)
        return (
            sensor.join(made, "_obs")
            .join(value, "_result")
            .join(measured, "_value")
            .join(units, "_unit")
            .join(kinds, "_kind")
            .join(feature, "topic")
            .join(offered, "_service", "left_semi")
            .join(service, "_service")
            .join(place, "_place")
            .select(*SENSOR_COLUMNS)
        )

    def sensor(self, sensor_id: str) -> DataFrame:
        """One row of a sensor; of several units or services the first in order of all columns."""
        return self.sensors(sensor_id).orderBy(*SENSOR_COLUMNS).limit(1)

    def topics(self) -> DataFrame:
        service = self.of_type("iot-lite:Service", "_service")
        through = self.links("qoo:canBeRetrievedThrough", "topic", "_service")
        prop = self.of_type("ssn:Property", "topic")
        offered = through.join(service, "_service", "left_semi").select("topic").distinct()
        return offered.join(prop, "topic", "left_semi")

    def topic_endpoints(self, topic: str | None = None) -> DataFrame:
        """Service endpoints by topic, or of one topic given by local name."""
        through = self.links("qoo:canBeRetrievedThrough", "topic", "service")
        if topic is not None:
            through = through.where(F.col("topic") == self.wire.base_iri + topic)
        through = through.join(self.of_type("ssn:Property", "topic"), "topic", "left_semi")
        return through.join(self.star("service", _SERVICE), "service").select("topic", "service", *_SERVICE)

    def _sensor_places(self) -> DataFrame:
        at = self.star("_sensor", {"_place": "geo:location"}, kind="ssn:Sensor").select("_place").distinct()
        point = self.star("_place", _PLACE, kind="geo:Point")
        return point.join(at, "_place", "left_semi")

    def places(self) -> DataFrame:
        return self._sensor_places().select(*PLACE_COLUMNS).distinct()

    def places_near(self, area: str | None = None) -> DataFrame:
        """Places of sensors in an area; without a name, of every area, with its name."""
        named = self.star("_area", {"area": "iot-lite:relativeLocation"}, kind="geo:Point")
        if area is not None:
            named = named.where(F.col("area") == area)
        inside = self.links("qoo:isInTheAreaOf", "_place", "_area")
        near = self._sensor_places().join(inside, "_place").join(named, "_area")
        return near.select("area", *PLACE_COLUMNS).distinct()

    def sensors_near(self, area: str | None = None) -> DataFrame:
        """Sensors whose place lies in an area."""
        named = self.star("_area", {"area": "iot-lite:relativeLocation"}, kind="geo:Point")
        if area is not None:
            named = named.where(F.col("area") == area)
        inside = self.links("qoo:isInTheAreaOf", "_place", "_area").join(named, "_area")
        at = self.star("sensor", {"_place": "geo:location"}, kind="ssn:Sensor")
        return at.join(inside, "_place").select("area", "sensor").distinct()

    # Quality vocabulary

    def quality_attributes(self) -> DataFrame:
        return self.star("attribute", {"should_be": "qoo:shouldBe"}, kind="qoo:QoOAttribute").distinct()

    def effects(self) -> DataFrame:
        """Flat (param, doc, type, min, max, initial, attribute, variations) rows."""
        params = {
            "type": "qoo:paramType",
            "doc": "qoo:documentation",
            "min": "qoo:paramMinValue",
            "max": "qoo:paramMaxValue",
            "initial": "qoo:paramInitialValue",
        }
        effect = {
            "attribute": "qoo:impacts",
            "param_variation": "qoo:paramVariation",
            "attribute_variation": "qoo:qooAttributeVariation",
        }
        param = self.star("param", params, kind="qoo:QoOCustomizableParameter")
        has = self.links("qoo:has", "param", "_effect").join(self.star("_effect", effect), "_effect")
        return param.join(has.drop("_effect"), "param")

    def remedy_effects(self) -> DataFrame:
        """Effect rows per remedy with local names, as remedy selection reads them."""
        named = self.links("qoo:allowsToSet", "remedy", "param")
        named = named.join(self.of_type("qoo:QoOPipeline", "remedy"), "remedy", "left_semi")
        rows = named.join(self.effects(), "param")
        return rows.select(
            local_name(F.col("remedy")).alias("remedy"),
            local_name(F.col("param")).alias("param"),
            "type",
            "min",
            "max",
            "initial",
            local_name(F.col("attribute")).alias("attribute"),
            "param_variation",
            "attribute_variation",
        )

    def customizable_params(self) -> DataFrame:
        """Parameters with their effects nested and sorted."""
        effect = F.struct("attribute", "param_variation", "attribute_variation")
        return (
            self.effects()
            .groupBy("param", "doc", "type", "min", "max", "initial")
            .agg(F.array_sort(F.collect_set(effect)).alias("has"))
        )

    def sensor_capabilities(self, compat: Compat = Compat()) -> DataFrame:
        capable = self.star("sensor", {"_capability": "ssn:hasMeasurementCapability"}, kind="ssn:Sensor")
        capability = self.star(
            "_capability", {"topic": "ssn:forProperty", "_range": "ssn:hasMeasurementProperty"}
        )
        limits = self.star("_range", {"_min": "qoo:hasMinValue", "_max": "qoo:hasMaxValue"})
        return (
            capable.join(capability, "_capability")
            .join(limits, "_range")
            .select(
                "sensor",
                "topic",
                parse_bound(F.col("_min"), compat).alias("min_value"),
                parse_bound(F.col("_max"), compat).alias("max_value"),
            )
        )


def _text(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def sensor_triples(sensors: DataFrame, wire: WireNames | None = None) -> DataFrame:
    """The 28 triples of each sensor.

    Columns: sensor_id, topic, location, quantity_kind, unit (the last four as
    ``prefix:name``), url, interface_type, interface_description, min_value,
    max_value. Sensors lacking one of them are left out.
    """
    wire = wire or WireNames()
    needed = (
        "sensor_id", "topic", "location", "quantity_kind", "unit", "url",
        "interface_type", "interface_description", "min_value", "max_value",
    )
    complete = sensors
    for name in needed:
        complete = complete.where(F.col(name).isNotNull() & (F.col(name) != ""))

    def own(stem: str) -> Column:
        return F.concat(F.lit(wire.base_iri + stem), F.col("sensor_id"))

    def term(curie: str) -> Column:
        return F.lit(iri(curie, wire))

    sensor, topic = own(""), expand(F.col("topic"), wire)
    # The statements that describe a registered sensor in the graph.
    rows = [
        (sensor, "rdf:type", term("ssn:Sensor")),
        (sensor, "iot-lite:id", F.col("sensor_id")),
        (sensor, "geo:location", expand(F.col("location"), wire)),
        (sensor, "qoo:sensorStateValue", F.lit("CONNECTED")),
        (sensor, "ssn:madeObservation", own("obs_")),
        (sensor, "iot-lite:exposedBy", own("serv_")),
        (sensor, "ssn:hasMeasurementCapability", own("capa_")),
        (own("obs_"), "ssn:observationResult", own("out_")),
        (own("obs_"), "ssn:observedProperty", topic),
        (topic, "rdf:type", term("ssn:Property")),
        (topic, "qoo:canBeRetrievedThrough", own("serv_")),
        (topic, "ssn:isPropertyOf", term("qoo:publicLocations")),
        (own("out_"), "iot-lite:hasValue", own("ex_obs_out_")),
        (own("ex_obs_out_"), "rdf:type", term("ssn:ObservationValue")),
        (own("ex_obs_out_"), "iot-lite:hasUnit", own("unit_")),
        (own("ex_obs_out_"), "iot-lite:hasQuantityKind", own("quantityKind_")),
        (own("unit_"), "rdf:type", expand(F.col("unit"), wire)),
        (own("quantityKind_"), "rdf:type", expand(F.col("quantity_kind"), wire)),
        (own("capa_"), "rdf:type", term("ssn:hasMeasurementCapability")),
        (own("capa_"), "ssn:hasMeasurementProperty", own("range_")),
        (own("capa_"), "ssn:forProperty", topic),
        (own("range_"), "rdf:type", term("ssn:MeasurementRange")),
        (own("range_"), "qoo:hasMinValue", F.col("min_value")),
        (own("range_"), "qoo:hasMaxValue", F.col("max_value")),
        (own("serv_"), "rdf:type", term("iot-lite:Service")),
        (own("serv_"), "iot-lite:interfaceType", F.col("interface_type")),
        (own("serv_"), "iot-lite:endpoint", F.col("url")),
        (own("serv_"), "iot-lite:interfaceDescription", F.col("interface_description")),
    ]
    structs = [F.struct(s.alias("s"), term(p).alias("p"), o.alias("o")) for s, p, o in rows]
    return complete.select(F.inline(F.array(*structs)))


def place_triples(places: DataFrame, wire: WireNames | None = None) -> DataFrame:
    """Points with coordinates; ``area`` (may be NULL) links to the point of the area."""
    wire = wire or WireNames()
    base, kind = F.lit(wire.base_iri + "loc_"), F.lit(iri("rdf:type", wire))
    point = F.concat(base, F.col("name"))
    area = F.concat(base, F.col("area"))
    rows = [
        F.struct(point.alias("s"), kind.alias("p"), F.lit(iri("geo:Point", wire)).alias("o")),
        *[
            F.struct(point.alias("s"), F.lit(iri(curie, wire)).alias("p"), F.col(name).alias("o"))
            for name, curie in _PLACE.items()
        ],
        F.struct(point.alias("s"), F.lit(iri("qoo:isInTheAreaOf", wire)).alias("p"), area.alias("o")),
    ]
    return places.select(F.inline(F.array(*rows))).where("o is not null")


def register_sensors(triples: DataFrame, sensors: DataFrame, wire: WireNames | None = None) -> DataFrame:
    """Triples with the new sensors added; ids that exist already are refused.

    Of several new sensors with one id the first by content is taken.
    """
    wire = wire or WireNames()
    known = triples.where(F.col("p") == iri("iot-lite:id", wire)).select(F.col("o").alias("sensor_id")).distinct()
    fresh = sensors.join(known, "sensor_id", "left_anti")
    others = [c for c in sensors.columns if c != "sensor_id"]
    once = fresh.groupBy("sensor_id").agg(F.min(F.struct(*others)).alias("_row")).select("sensor_id", "_row.*")
    return distinct(triples.unionByName(sensor_triples(once, wire)))


def delete_sensors(triples: DataFrame, sensor_ids: DataFrame, wire: WireNames | None = None) -> DataFrame:
    """Triples without those whose subject is a sensor with one of the ids."""
    wire = wire or WireNames()
    subjects = (
        triples.where(F.col("p") == iri("iot-lite:id", wire))
        .select("s", F.col("o").alias("sensor_id"))
        .join(sensor_ids.select("sensor_id").distinct(), "sensor_id", "left_semi")
        .select("s")
        .distinct()
    )
    return triples.join(subjects, "s", "left_anti").select("s", "p", "o")


def remedy_triples(effects: DataFrame, wire: WireNames | None = None, provider: str = "platform") -> DataFrame:
    """Triples of remedies, their parameters and effects, from flat effect rows."""
    wire = wire or WireNames()

    def own(*parts: Column | str) -> Column:
        return F.concat(F.lit(wire.base_iri), *[_text(p) for p in parts])

    def term(curie: str) -> Column:
        return F.lit(iri(curie, wire))

    remedy, param = own("remedy"), own("param")
    effect = own(
        F.lit("effect_"), "param", F.lit("_"), "attribute", F.lit("_"),
        "param_variation", F.lit("_"), "attribute_variation",
    )
    rows: Sequence[tuple[Column, str, Column]] = [
        (own(F.lit(provider)), "qoo:provides", remedy),
        (remedy, "rdf:type", term("qoo:QoOPipeline")),
        (remedy, "qoo:allowsToSet", param),
        (param, "rdf:type", term("qoo:QoOCustomizableParameter")),
        (param, "qoo:documentation", F.concat(F.lit("Documentation for "), F.col("param"))),
        (param, "qoo:paramType", F.col("type")),
        (param, "qoo:paramMinValue", F.col("min")),
        (param, "qoo:paramMaxValue", F.col("max")),
        (param, "qoo:paramInitialValue", F.col("initial")),
        (param, "qoo:has", effect),
        (effect, "rdf:type", term("qoo:QoOEffect")),
        (effect, "qoo:impacts", own("attribute")),
        (effect, "qoo:paramVariation", F.col("param_variation")),
        (effect, "qoo:qooAttributeVariation", F.col("attribute_variation")),
    ]
    structs = [F.struct(s.alias("s"), term(p).alias("p"), o.alias("o")) for s, p, o in rows]
    return distinct(effects.select(F.inline(F.array(*structs))))


def attribute_triples(targets: DataFrame, wire: WireNames | None = None) -> DataFrame:
    """Triples of quality attributes and the direction in which each is good."""
    wire = wire or WireNames()
    name = F.concat(F.lit(wire.base_iri), F.col("name"))
    rows = [
        F.struct(name.alias("s"), F.lit(iri("rdf:type", wire)).alias("p"), F.lit(iri("qoo:QoOAttribute", wire)).alias("o")),
        F.struct(name.alias("s"), F.lit(iri("qoo:shouldBe", wire)).alias("p"), F.col("should_be").alias("o")),
    ]
    return targets.select(F.inline(F.array(*rows)))


def endpoint_status(sensors: DataFrame, connected: DataFrame) -> DataFrame:
    """Every sensor with its reachable flag from a supplied table; not listed means not reachable."""
    flags = connected.groupBy("sensor_id").agg(F.max("connected").alias("connected"))
    joined = sensors.select("sensor_id").distinct().join(flags, "sensor_id", "left")
    return joined.select("sensor_id", F.coalesce("connected", F.lit(False)).alias("connected"))
