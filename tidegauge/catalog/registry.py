"""Checked queries: registry triples, sensors, places, remedies."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegauge.catalog.base import BASE, query, with_ctes
from tidegauge.operators import aggregates, registry, remedies
from tidegauge.operators.spread import spread
from tidegauge.schema import Compat
from tidegauge.sources import fixtures as fx
from tidegauge.sources import triples as nt
from tidegauge.sources.vocabulary import expand, iri, prefixes, shorten


def _triples(spark, d):
    return fx.registry_triples(spark, d)


def _registry(spark, d):
    return registry.Registry(_triples(spark, d))


class _Pattern:
    """A triple pattern list as SQL: one self-join per pattern."""

    def __init__(self):
        self.froms: list[str] = []
        self.where: list[str] = []
        self.bound: dict[str, str] = {}

    def add(self, s: str, p: str, o: str) -> _Pattern:
        alias = f"t{len(self.froms)}"
        self.froms.append(f"triples {alias}")
        self.where.append(f"{alias}.p = '{iri(p)}'")
        for term, column in ((s, "s"), (o, "o")):
            name = f"{alias}.{column}"
            if not term.startswith("?"):
                self.where.append(f"{name} = '{term}'")
            elif term in self.bound:
                self.where.append(f"{name} = {self.bound[term]}")
            else:
                self.bound[term] = name
        return self

    def sql(self, columns: dict[str, str], distinct: bool = True) -> str:
        listed = ", ".join(f"{self.bound[v]} as {name}" for name, v in columns.items())
        kind = "distinct " if distinct else ""
        return f"select {kind}{listed} from {', '.join(self.froms)} where {' and '.join(self.where)}"


def _patterns(*rows: tuple[str, str, str]) -> _Pattern:
    pattern = _Pattern()
    for row in rows:
        pattern.add(*row)
    return pattern


PLACE = (
    ("?pos", "geo:long", "?longitude"),
    ("?pos", "geo:lat", "?latitude"),
    ("?pos", "iot-lite:relativeLocation", "?relative_location"),
    ("?pos", "iot-lite:altRelative", "?relative_altitude"),
    ("?pos", "geo:alt", "?altitude"),
)
SENSOR = (
    ("?sensor", "rdf:type", iri("ssn:Sensor")),
    ("?sensor", "ssn:madeObservation", "?obs"),
    ("?obs", "ssn:observationResult", "?result"),
    ("?result", "iot-lite:hasValue", "?value"),
    ("?value", "iot-lite:hasUnit", "?u"),
    ("?u", "rdf:type", "?unit"),
    ("?value", "iot-lite:hasQuantityKind", "?q"),
    ("?q", "rdf:type", "?quantity_kind"),
    ("?obs", "ssn:observedProperty", "?topic"),
    ("?topic", "ssn:isPropertyOf", "?feature"),
    ("?sensor", "iot-lite:exposedBy", "?s"),
    ("?prop", "qoo:canBeRetrievedThrough", "?s"),
    ("?s", "iot-lite:endpoint", "?url"),
    ("?s", "iot-lite:interfaceType", "?interface_type"),
    ("?s", "iot-lite:interfaceDescription", "?interface_description"),
    ("?sensor", "geo:location", "?pos"),
    *PLACE,
)
SENSOR_OUT = {c: f"?{c}" for c in registry.SENSOR_COLUMNS}
PLACE_OUT = {c: f"?{c}" for c in registry.PLACE_COLUMNS}
SENSOR_AT = (
    ("?sensor", "rdf:type", iri("ssn:Sensor")),
    ("?sensor", "geo:location", "?pos"),
    ("?pos", "rdf:type", iri("geo:Point")),
)
AREA = (
    ("?area_node", "rdf:type", iri("geo:Point")),
    ("?area_node", "iot-lite:relativeLocation", "?area"),
    ("?pos", "qoo:isInTheAreaOf", "?area_node"),
)
PARAM = (
    ("?param", "rdf:type", iri("qoo:QoOCustomizableParameter")),
    ("?param", "qoo:paramType", "?type"),
    ("?param", "qoo:documentation", "?doc"),
    ("?param", "qoo:paramMinValue", "?min"),
    ("?param", "qoo:paramMaxValue", "?max"),
    ("?param", "qoo:paramInitialValue", "?initial"),
    ("?param", "qoo:has", "?effect"),
    ("?effect", "qoo:impacts", "?attribute"),
    ("?effect", "qoo:paramVariation", "?param_variation"),
    ("?effect", "qoo:qooAttributeVariation", "?attribute_variation"),
)
PARAM_OUT = {
    c: f"?{c}"
    for c in ("param", "doc", "type", "min", "max", "initial", "attribute", "param_variation", "attribute_variation")
}


# Triples


@query("src4_read_triples", with_ctes("select s, p, o from triples", "triples"))
def _(spark, d):
    return nt.parse_ntriples(nt.to_ntriples(_triples(spark, d)))


@query(
    "src4_rejected_lines",
    with_ctes(
        """select concat('<', s, '> <', p, '> "', o, '"') as value from triples where ends_with(p, 'paramType')""", "triples"
    ),
)
def _(spark, d):
    """Lines that lost their end, among good ones, a comment and a blank line for each."""
    lines = nt.to_ntriples(_triples(spark, d))
    cut = F.contains("value", F.lit("paramType>"))
    broken = F.when(cut, F.regexp_replace("value", " [.]$", "")).otherwise(F.col("value"))
    more = F.explode(F.array(broken, F.lit("# a comment"), F.lit("  ")))
    return nt.rejected_lines(lines.select(more.alias("value")))


@query(
    "src4_statements",
    """select concat('http://x.example/é', p_partkey) as s, 'http://x.example/name' as p,
      concat('caf', 'é ', chr(92), chr(128512), ' ', p_partkey, chr(10), '"', p_brand, '"') as o, 'literal' as kind,
      case when p_partkey % 2 = 0 then 'fr-CH' end as lang,
      case when p_partkey % 2 = 1 then 'http://www.w3.org/2001/XMLSchema#string' end as datatype from part""",
)
def _(spark, d):
    """Both lengths of numbered escapes, in IRIs and literals, with language or type."""
    key = F.col("p_partkey").cast("string")
    tail = F.when(F.col("p_partkey") % 2 == 0, F.lit("@fr-CH")).otherwise(F.lit("^^<http://www.w3.org/2001/XMLSchema#string>"))
    line = F.concat(
        F.lit("<http://x.example/\\u00e9"), key, F.lit('> <http://x.example/name> "caf\\u00E9 \\\\\\U0001F600 '), key,
        F.lit('\\n\\"'), F.col("p_brand"), F.lit('\\""'), tail, F.lit(" . # end"),
    )
    # the compact table is read by few tasks, which are not to parse all lines
    read = nt.parse_statements(spread(fx.table(spark, d, "part"), "p_partkey").select(line.alias("value")))
    # written and read once more, nothing is lost
    return nt.parse_statements(nt.to_ntriples(read))


@query(
    "src5_prefix_expansion",
    with_ctes(
        "select s, p, o, case "
        + " ".join(
            f"when starts_with(p, '{full}') then concat('{short}:', substr(p, {len(full) + 1}))"
            for short, full in prefixes().items()
        )
        + " else p end as short from triples",
        "triples",
    ),
)
def _(spark, d):
    short = _triples(spark, d).withColumn("short", shorten(F.col("p")))
    return short.select("s", expand(F.col("short")).alias("p"), "o", "short")


# Sensors, topics, places


@query("rg1_sensors", with_ctes(_patterns(*SENSOR).sql(SENSOR_OUT), "triples"))
def _(spark, d):
    return _registry(spark, d).sensors()


@query(
    "rg2_sensor_by_id",
    with_ctes(_patterns(("?sensor", "iot-lite:id", "sensor7"), *SENSOR).sql(SENSOR_OUT), "triples"),
)
def _(spark, d):
    return _registry(spark, d).sensor("sensor7")


@query(
    "rg3_topics",
    with_ctes(
        _patterns(
            ("?s", "rdf:type", iri("iot-lite:Service")),
            ("?topic", "qoo:canBeRetrievedThrough", "?s"),
            ("?topic", "rdf:type", iri("ssn:Property")),
        ).sql({"topic": "?topic"}),
        "triples",
    ),
)
def _(spark, d):
    return _registry(spark, d).topics()


@query(
    "rg4_topic_endpoints",
    with_ctes(
        _patterns(
            (BASE + "error", "rdf:type", iri("ssn:Property")),
            (BASE + "error", "qoo:canBeRetrievedThrough", "?service"),
            ("?service", "iot-lite:endpoint", "?url"),
            ("?service", "iot-lite:interfaceType", "?interface_type"),
            ("?service", "iot-lite:interfaceDescription", "?interface_description"),
        ).sql({c: f"?{c}" for c in ("service", "url", "interface_type", "interface_description")}),
        "triples",
    ),
)
def _(spark, d):
    return _registry(spark, d).topic_endpoints("error").drop("topic")


@query("rg5_places", with_ctes(_patterns(*SENSOR_AT, *PLACE).sql(PLACE_OUT), "triples"))
def _(spark, d):
    return _registry(spark, d).places()


@query(
    "jn6_places_near",
    with_ctes(_patterns(*SENSOR_AT, *AREA, *PLACE).sql({"area": "?area", **PLACE_OUT}), "triples"),
)
def _(spark, d):
    return _registry(spark, d).places_near()


@query(
    "jn6_sensors_near",
    with_ctes(
        _patterns(*SENSOR_AT, *AREA).sql({"area": "?area", "sensor": "?sensor"}) + " and t4.o = 'ASIA'", "triples"
    ),
)
def _(spark, d):
    return _registry(spark, d).sensors_near("ASIA")


# Quality vocabulary


@query(
    "rg6_quality_attributes",
    with_ctes(
        _patterns(
            ("?attribute", "rdf:type", iri("qoo:QoOAttribute")), ("?attribute", "qoo:shouldBe", "?should_be")
        ).sql({"attribute": "?attribute", "should_be": "?should_be"}),
        "triples",
    ),
)
def _(spark, d):
    return _registry(spark, d).quality_attributes()


def _effects_text(column: str = "has"):
    line = F.transform(column, lambda e: F.concat_ws("/", e["attribute"], e["param_variation"], e["attribute_variation"]))
    return F.array_join(line, ";").alias(column)


@query(
    "rg7_customizable_params",
    with_ctes(
        f"""select param, doc, type, min, max, initial, string_agg(attribute || '/' || param_variation || '/'
          || attribute_variation, ';' order by attribute, param_variation, attribute_variation) as has
        from ({_patterns(*PARAM).sql(PARAM_OUT)}) group by all""",
        "triples",
    ),
)
def _(spark, d):
    return _registry(spark, d).customizable_params().withColumn("has", _effects_text())


@query(
    "rg8_sensor_capabilities",
    with_ctes(
        f"""select concat('{BASE}', sensor_id) as sensor, concat('{BASE}', topic) as topic,
        case when min_value = '-INF' then '-infinity'::double else min_value::double end as min_value,
        case when max_value = '+INF' then 'infinity'::double else max_value::double end as max_value from caps""",
        "caps",
    ),
)
def _(spark, d):
    return _registry(spark, d).sensor_capabilities()


@query(
    "rg8_sensor_capabilities_compat",
    with_ctes(
        f"""select concat('{BASE}', sensor_id) as sensor, min_value = '-INF' as positive_low,
        case when max_value = '+INF' then 3.4028234663852886e38 else max_value::double end as max_value from caps""",
        "caps",
    ),
)
def _(spark, d):
    rows = _registry(spark, d).sensor_capabilities(Compat(float_infinity=True))
    return rows.select("sensor", (F.col("min_value") > 0).alias("positive_low"), "max_value")


# Changes


@query(
    "rg9_register_sensors",
    with_ctes("select s, p, o from triples", "triples").replace(" where c_acctbal >= 0", ""),
)
def _(spark, d):
    # Customers that are not in good standing register late; the others are refused as known.
    forms = fx.registration_forms(spark, d)
    c = fx.table(spark, d, "customer")
    n = fx.table(spark, d, "nation")
    key = F.col("c_custkey")
    late = c.join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    high = F.concat((F.lit(50) + (key % 5) * 40).cast("string"), F.lit(".0"))
    late = late.select(
        F.concat(F.lit("sensor"), key.cast("string")).alias("sensor_id"),
        F.concat(F.lit("qoo:"), fx.pick(key, fx.TOPICS)).alias("topic"),
        F.concat(F.lit("qoo:loc_"), F.col("n_name")).alias("location"),
        F.concat(F.lit("m3-lite:kind"), (key % 4).cast("string")).alias("quantity_kind"),
        F.concat(F.lit("m3-lite:unit"), (key % 4).cast("string")).alias("unit"),
        F.concat(F.lit("http://sensor.example/"), key.cast("string")).alias("url"),
        F.lit("http").alias("interface_type"),
        F.concat(F.lit("reads "), fx.pick(key, fx.TOPICS)).alias("interface_description"),
        F.when(key % 7 == 0, F.lit("-INF")).otherwise(F.lit("-20.0")).alias("min_value"),
        F.when(key % 11 == 0, F.lit("+INF")).otherwise(high).alias("max_value"),
    )
    return registry.register_sensors(_triples(spark, d), forms.unionByName(late))


@query(
    "rg10_delete_sensors",
    with_ctes(
        f"""select s, p, o from triples where s not in
        (select concat('{BASE}', sensor_id) from sens where area = 'EUROPE')""",
        "triples",
    ),
)
def _(spark, d):
    gone = fx.sensors(spark, d).where(F.col("area") == "EUROPE").select("sensor_id")
    return registry.delete_sensors(_triples(spark, d), gone)


@query(
    "rg11_register_remedies",
    with_ctes(
        f"""select distinct s, p, o from triples where starts_with(s, '{BASE}Remedy') or starts_with(s, '{BASE}param')
        or starts_with(s, '{BASE}effect_') or s = '{BASE}platform'""",
        "triples",
    ),
)
def _(spark, d):
    return registry.remedy_triples(fx.remedy_catalogue(spark, d))


@query(
    "rg13_endpoint_status",
    with_ctes(
        """select sensor_id, coalesce(bool_or(value > 0), false) as connected from sens left join obs
        on producer = sensor_id group by 1""",
        "sens", "obs",
    ),
)
def _(spark, d):
    seen = fx.observations(spark, d).select(
        F.col("producer").alias("sensor_id"), (F.col("value") > 0).alias("connected")
    )
    return registry.endpoint_status(fx.sensors(spark, d), seen)


# Remedies


REMEDIES = """select distinct remedy, param, type, min, max, initial, e.attribute, param_variation, e.attribute_variation
    from effects e where attribute = 'OBS_RATE' and attribute_variation = 'HIGH' and not exists (
      select 1 from effects x where x.param = e.param and ((x.attribute = 'OBS_ACCURACY' and x.attribute_variation = 'LOW')
        or (x.attribute = 'OBS_FRESHNESS' and x.attribute_variation = 'HIGH')))"""


def _remedies(spark, d):
    return remedies.remedies_preserving(
        fx.remedy_catalogue(spark, d), fx.attribute_targets(spark), "OBS_RATE", ["OBS_ACCURACY", "OBS_FRESHNESS"]
    )


@query("jn7_remedies_preserving", with_ctes(REMEDIES, "effects"))
def _(spark, d):
    return _remedies(spark, d)


@query(
    "jn7_remedies_from_triples",
    with_ctes(REMEDIES, "effects"),
)
def _(spark, d):
    graph = _registry(spark, d)
    targets = graph.quality_attributes().select(
        F.split_part("attribute", F.lit("#"), F.lit(2)).alias("name"), "should_be"
    )
    return remedies.remedies_preserving(
        graph.remedy_effects(), targets, "OBS_RATE", ["OBS_ACCURACY", "OBS_FRESHNESS"]
    )


@query(
    "ag6_nest_effects",
    with_ctes(
        """select remedy, param, string_agg(attribute || '/' || param_variation || '/' || attribute_variation, ';'
          order by attribute, param_variation, attribute_variation) as has from effects group by 1, 2""",
        "effects",
    ),
)
def _(spark, d):
    nested = aggregates.nest_params(aggregates.nest_effects(fx.remedy_catalogue(spark, d)))
    rows = nested.select("remedy", F.inline("customizable_params"))
    return rows.select("remedy", "param", _effects_text())


@query(
    "ag7_first_remedy",
    with_ctes(f"select remedy, param, initial from ({REMEDIES}) order by remedy limit 1", "effects"),
)
def _(spark, d):
    return aggregates.first_remedy(_remedies(spark, d)).select("remedy", "param", "initial")
