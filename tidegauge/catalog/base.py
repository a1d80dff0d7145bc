"""Collecting the checked queries, and the input shapes as SQL."""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge.schema import WireNames
from tidegauge.sources.fixtures import AS_OF_MS, SPREADS
from tidegauge.sources.vocabulary import iri
from tidegauge.streaming.runs import checkpoint_root

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

BASE = WireNames().base_iri


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(function: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return add


def scratch(spark: SparkSession) -> str:
    """A folder that all executors share: the session's checkpoint folder, or a temporary one where none is set."""
    return checkpoint_root(spark, tempfile.gettempdir())


def flat(df: DataFrame) -> DataFrame:
    """Timestamps as ``<name>_ms``, so that both engines compare plain numbers."""
    columns = [
        F.unix_millis(f.name).alias(f"{f.name}_ms") if isinstance(f.dataType, T.TimestampType) else F.col(f.name)
        for f in df.schema.fields
    ]
    return df.select(*columns)


MS = "(epoch_us(ts) // 1000)"
ORDER_MS = "(epoch_us(o_orderdate) // 1000)"


def _pick(position: str, *words: str) -> str:
    listed = ", ".join(f"'{w}'" for w in words)
    return f"([{listed}])[cast(({position}) % {len(words)} as int) + 1]"


def _spread(field: int) -> str:
    return f"(((cast(o_orderkey as bigint) * {SPREADS[field]}) % 4294967296) // 65536)"


CTES = {
    "obs": f"""select event_id as obs_id, event_type as topic,
        concat('sensor', cast(user_id as varchar)) as producer, {MS} as date_ms, value - 100.0 as value,
        {MS} + 50 + (event_id % 7) * 100 as ingest_ms, concat('produced:', cast({MS} as varchar)) as timestamps
        from events""",
    "sens": f"""select concat('sensor', cast(c_custkey as varchar)) as sensor_id,
        {_pick('c_custkey', 'click', 'purchase', 'error', 'signup', 'view')} as topic,
        n_name as relative_location, r_name as area,
        cast(c_nationkey * 3 - 36 as varchar) as latitude, cast(c_nationkey * 7 - 84 as varchar) as longitude,
        cast(c_nationkey * 10 as varchar) as altitude, '0' as relative_altitude,
        concat('kind', cast(c_custkey % 4 as varchar)) as quantity_kind,
        concat('unit', cast(c_custkey % 4 as varchar)) as unit,
        concat('http://sensor.example/', cast(c_custkey as varchar)) as url
        from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey
        where c_acctbal >= 0""",
    "caps": f"""select concat('sensor', cast(c_custkey as varchar)) as sensor_id,
        {_pick('c_custkey', 'click', 'purchase', 'error', 'signup', 'view')} as topic,
        case when c_custkey % 7 = 0 then '-INF' else '-20.0' end as min_value,
        case when c_custkey % 11 = 0 then '+INF'
             else concat(cast(50 + (c_custkey % 5) * 40 as varchar), '.0') end as max_value
        from customer where c_acctbal >= 0""",
    "bounds": """select sensor_id as producer,
        case when min_value = '-INF' then cast('-infinity' as double) else cast(min_value as double) end as min_value,
        case when max_value = '+INF' then cast('infinity' as double) else cast(max_value as double) end as max_value
        from caps""",
    "req": f"""select concat('req', cast(o_orderkey as varchar)) as request_id,
        concat('app', cast(o_custkey % 5 as varchar)) as application_id,
        {_pick(_spread(0), 'click', 'purchase', 'error', 'signup', 'view', 'ALL')} as topic,
        {_pick(_spread(1), 'ALL', 'ASIA', 'EUROPE', 'ATLANTIS')} as area,
        {_pick(_spread(2), 'RAW_DATA', 'INFORMATION', 'KNOWLEDGE')} as obs_level,
        case when {_spread(3)} % 2 = 0 then cast(-50.0 as double) end as threshold_min,
        case when {_spread(4)} % 3 = 0 then cast(120.0 as double) end as threshold_max,
        case when {_spread(5)} % 4 = 1 then '2/hour' end as obsrate_max,
        case when {_spread(5)} % 4 = 2 then {_pick(_spread(6), '1/hour', '3/hour', '8/hour')} end as obsrate_min,
        case when {_spread(7)} % 5 = 0 then '72 hours' else 'unset' end as age_max,
        case when o_orderkey % 2 = 0 then 'GUARANTEED' else 'BEST_EFFORT' end as sla_level,
        {ORDER_MS} as created_ms, o_orderstatus as order_status, o_orderpriority as priority,
        case o_orderstatus when 'O' then 'ENFORCED' when 'P' then 'SUBMITTED' else 'REMOVED' end as status
        from orders""",
    "steps": """select request_id, application_id, seq, path[seq + 1] as status, created_ms + seq * 1000 as start_ms
        from (select *, unnest(range(len(path))) as seq from (
          select *, case when area = 'ATLANTIS' then ['CREATED', 'REJECTED']
            when order_status = 'F' then ['CREATED', 'SUBMITTED', 'ENFORCED', 'HEALED', 'REMOVED']
            else ['CREATED', 'SUBMITTED', 'ENFORCED'] end as path from req))""",
    "effects": f"""select distinct remedy, param, type, '0' as min, cast(p_size + 1 as varchar) as max,
        cast(p_size as varchar) as initial, attribute, param_variation, attribute_variation from (
          select *, concat('Remedy', cast(p_partkey as varchar)) as remedy,
            concat('param', cast(p_partkey as varchar)) as param,
            {_pick('p_partkey', 'Integer', 'Integer', 'String')} as type,
            'OBS_RATE' as attribute, {_pick('p_partkey', 'HIGH', 'LOW', 'CONSTANT')} as param_variation,
            {_pick('p_size', 'HIGH', 'LOW')} as attribute_variation from part
          union all
          select *, concat('Remedy', cast(p_partkey as varchar)), concat('param', cast(p_partkey as varchar)),
            {_pick('p_partkey', 'Integer', 'Integer', 'String')},
            {_pick('p_partkey', 'OBS_ACCURACY', 'OBS_FRESHNESS', 'OBS_RATE')},
            {_pick('p_partkey + 1', 'HIGH', 'LOW', 'CONSTANT')},
            {_pick('p_size + p_partkey', 'LOW', 'HIGH')} from part)""",
}


def _triples() -> str:
    def t(curie: str) -> str:
        return f"'{iri(curie)}'"

    own = {
        stem: f"concat('{BASE}{stem}', sensor_id)"
        for stem in ("", "obs_", "serv_", "capa_", "out_", "ex_obs_out_", "unit_", "quantityKind_", "range_")
    }
    topic = f"concat('{BASE}', topic)"
    place = f"concat('{BASE}loc_', relative_location)"
    m3 = iri("m3-lite:")
    sensor_rows = [
        (own[""], "rdf:type", t("ssn:Sensor")),
        (own[""], "iot-lite:id", "sensor_id"),
        (own[""], "geo:location", place),
        (own[""], "qoo:sensorStateValue", "'CONNECTED'"),
        (own[""], "ssn:madeObservation", own["obs_"]),
        (own[""], "iot-lite:exposedBy", own["serv_"]),
        (own[""], "ssn:hasMeasurementCapability", own["capa_"]),
        (own["obs_"], "ssn:observationResult", own["out_"]),
        (own["obs_"], "ssn:observedProperty", topic),
        (topic, "rdf:type", t("ssn:Property")),
        (topic, "qoo:canBeRetrievedThrough", own["serv_"]),
        (topic, "ssn:isPropertyOf", t("qoo:publicLocations")),
        (own["out_"], "iot-lite:hasValue", own["ex_obs_out_"]),
        (own["ex_obs_out_"], "rdf:type", t("ssn:ObservationValue")),
        (own["ex_obs_out_"], "iot-lite:hasUnit", own["unit_"]),
        (own["ex_obs_out_"], "iot-lite:hasQuantityKind", own["quantityKind_"]),
        (own["unit_"], "rdf:type", f"concat('{m3}', unit)"),
        (own["quantityKind_"], "rdf:type", f"concat('{m3}', quantity_kind)"),
        (own["capa_"], "rdf:type", t("ssn:hasMeasurementCapability")),
        (own["capa_"], "ssn:hasMeasurementProperty", own["range_"]),
        (own["capa_"], "ssn:forProperty", topic),
        (own["range_"], "rdf:type", t("ssn:MeasurementRange")),
        (own["range_"], "qoo:hasMinValue", "min_value"),
        (own["range_"], "qoo:hasMaxValue", "max_value"),
        (own["serv_"], "rdf:type", t("iot-lite:Service")),
        (own["serv_"], "iot-lite:interfaceType", "'http'"),
        (own["serv_"], "iot-lite:endpoint", "url"),
        (own["serv_"], "iot-lite:interfaceDescription", "concat('reads ', topic)"),
    ]
    point = f"concat('{BASE}loc_', name)"
    place_rows = [
        (point, "rdf:type", t("geo:Point")),
        (point, "geo:long", "longitude"),
        (point, "geo:lat", "latitude"),
        (point, "geo:alt", "altitude"),
        (point, "iot-lite:altRelative", "'0'"),
        (point, "iot-lite:relativeLocation", "name"),
        (point, "qoo:isInTheAreaOf", f"concat('{BASE}loc_', area)"),
    ]
    remedy, param = f"concat('{BASE}', remedy)", f"concat('{BASE}', param)"
    effect = f"concat('{BASE}effect_', param, '_', attribute, '_', param_variation, '_', attribute_variation)"
    remedy_rows = [
        (f"'{BASE}platform'", "qoo:provides", remedy),
        (remedy, "rdf:type", t("qoo:QoOPipeline")),
        (remedy, "qoo:allowsToSet", param),
        (param, "rdf:type", t("qoo:QoOCustomizableParameter")),
        (param, "qoo:documentation", "concat('Documentation for ', param)"),
        (param, "qoo:paramType", "type"),
        (param, "qoo:paramMinValue", "min"),
        (param, "qoo:paramMaxValue", "max"),
        (param, "qoo:paramInitialValue", "initial"),
        (param, "qoo:has", effect),
        (effect, "rdf:type", t("qoo:QoOEffect")),
        (effect, "qoo:impacts", f"concat('{BASE}', attribute)"),
        (effect, "qoo:paramVariation", "param_variation"),
        (effect, "qoo:qooAttributeVariation", "attribute_variation"),
    ]
    attribute_rows = [
        (f"concat('{BASE}', name)", "rdf:type", t("qoo:QoOAttribute")),
        (f"concat('{BASE}', name)", "qoo:shouldBe", "should_be"),
    ]
    sources = [
        (sensor_rows, "(select s.*, c.min_value, c.max_value from sens s join caps c using (sensor_id))"),
        (
            place_rows,
            """(select n_name as name, r_name as area, cast(n_nationkey * 3 - 36 as varchar) as latitude,
                cast(n_nationkey * 7 - 84 as varchar) as longitude, cast(n_nationkey * 10 as varchar) as altitude
                from nation join region on n_regionkey = r_regionkey
                union all select r_name, null, '0', '0', '0' from region)""",
        ),
        (remedy_rows, "effects"),
        (attribute_rows, "targets"),
    ]
    selects = [
        f"select {s} as s, {t(p)} as p, {o} as o from {source}"
        + (" where area is not null" if p == "qoo:isInTheAreaOf" else "")
        for rows, source in sources
        for s, p, o in rows
    ]
    return "select distinct s, p, o from (" + " union all ".join(selects) + ")"


CTES["targets"] = (
    "select * from (values ('OBS_RATE', 'HIGH'), ('OBS_ACCURACY', 'HIGH'), ('OBS_FRESHNESS', 'LOW')) "
    "as t(name, should_be)"
)
CTES["triples"] = _triples()
NEEDS = {
    "bounds": ("caps",),
    "steps": ("req",),
    "triples": ("sens", "caps", "effects", "targets"),
}


def with_ctes(body: str, *names: str, recursive: bool = False) -> str:
    """The body with the named input shapes, and those they need, in front."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for need in NEEDS.get(name, ()):
            add(need)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        add(name)
    parts = [f"{n} as ({CTES[n]})" for n in ordered]
    head = "with recursive " if recursive else "with "
    text = body.strip()
    if text.lower().startswith("with "):
        return head + ", ".join(parts) + ", " + text[5:]
    return head + ", ".join(parts) + " " + text


AS_OF = str(AS_OF_MS)
FIXED_ACCURACY = """case when min_value is null or max_value is null then 0.0
    when value between min_value and max_value then 100.0
    when greatest(min_value - value, value - max_value) >= max_value - min_value
      or isinf(max_value - min_value) then 0.0
    else ((max_value - min_value) - greatest(min_value - value, value - max_value)) / (max_value - min_value) end"""
