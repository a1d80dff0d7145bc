"""Checked queries: sources, sinks, filters, scalar functions, linked data."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidegauge.catalog.base import AS_OF, BASE, FIXED_ACCURACY, flat, query, scratch, with_ctes
from tidegauge.functions import naming, params, quality, trail
from tidegauge.functions.clock import epoch_ms
from tidegauge.operators import enrich, filters, knowledge
from tidegauge.schema import Compat, WireNames
from tidegauge.sources import fixtures as fx
from tidegauge.sources import observations as src
from tidegauge.sources import sinks
from tidegauge.sources.vocabulary import iri
from tidegauge.streaming import topics

WISHES = ["OBS_ACCURACY", "OBS_FRESHNESS"]
RAW = ["obs_id", "topic", "producer", "date", "value", "timestamps"]
RAW_SQL = "obs_id, topic, producer, date_ms, value, timestamps"


def _scored(spark, d):
    obs = enrich.with_capability(fx.observations(spark, d), fx.capabilities(spark, d))
    return enrich.score(obs, WISHES, enrich.default_attributes(fx.AS_OF_MS))


SCORED = f"""scored as (select o.*, min_value, max_value, {FIXED_ACCURACY} as obs_accuracy,
    cast({AS_OF} - date_ms as double) as obs_freshness from obs o left join bounds using (producer))"""


# Sources


@query(
    "src1_read_observations",
    """select event_id, event_type, user_id, value from events where event_type in ('click', 'view')""",
)
def _(spark, d):
    frame = src.read_observations(
        spark, f"{d}/events.parquet", topics=["click", "view"], topic_column="event_type"
    )
    return frame.select("event_id", "event_type", "user_id", "value")


@query(
    "src1_topic_offsets",
    with_ctes(
        """select 'all' as part, topic, producer, date_ms, value from obs
        union all select 'later', topic, producer, date_ms, value from obs where obs_id % 2 = 1""",
        "obs",
    ),
)
def _(spark, d):
    """All messages, appended to a topic log in two batches and read back; then from where the first batch ended."""
    path = f"{scratch(spark)}/topics-{uuid.uuid4().hex}"
    sent = fx.messages(spark, d)
    topics.append_messages(sent.where(F.col("obs_id") % 2 == 0), path, "even")
    ended = topics.topic_ends(spark, path)
    topics.append_messages(sent.where(F.col("obs_id") % 2 == 1), path, "odd")
    parts = {"all": "earliest", "later": ended}
    read = [src.read_observations(spark, path, fmt="topics", starting=at).withColumn("part", F.lit(p)) for p, at in parts.items()]
    decoded = src.decode_observation(read[0].unionByName(read[1]))
    return flat(decoded.select("part", "topic", "producer", "date", "value"))


@query("src2_union_topics", with_ctes(f"select {RAW_SQL} from obs", "obs"))
def _(spark, d):
    obs = fx.observations(spark, d).select(*RAW)
    return flat(src.union_topics({t: obs.where(F.col("topic") == t).drop("topic") for t in fx.TOPICS}))


@query("src3_decode_observation", with_ctes(f"select {RAW_SQL} from obs", "obs"))
def _(spark, d):
    return flat(src.decode_observation(fx.messages(spark, d)))


@query(
    "src3_rejected_messages",
    "select event_id as obs_id, event_type as topic, props as message from events",
)
def _(spark, d):
    return src.rejected_observations(fx.messages(spark, d))


@query(
    "src9_constant_messages",
    """select event_id as id,
    '{"date": "1499850317000", "value": "1.309", "producer": "sensor01", "timestamps": "produced:1499850317000"}'
    as message, 107 as n_bytes from events""",
)
def _(spark, d):
    ids = fx.table(spark, d, "events").select(F.col("event_id").alias("id"))
    return src.synthetic_observations(ids).withColumn("n_bytes", F.octet_length("message"))


@query(
    "src9_sequential_messages",
    """select event_id as id, rpad('Topic:temperature:ThreadID:0:MessageID:'
    || lpad(cast(event_id as varchar), 10, '0') || ':', 192, 'x') as message from events""",
)
def _(spark, d):
    ids = fx.table(spark, d, "events").select(F.col("event_id").alias("id"))
    return src.synthetic_observations(ids, sequential=True)


# Sinks


@query(
    "snk1_encode_observation",
    with_ctes(
        f"""with {SCORED}
        select obs_id, date_ms as date, value, producer, timestamps, obs_accuracy as accuracy,
          obs_freshness as freshness, coalesce(latitude, 'N/A') as latitude,
          coalesce(relative_location, 'N/A') as place
        from scored left join (select sensor_id as producer, latitude, relative_location from sens) using (producer)""",
        "obs", "bounds", "sens",
    ),
)
def _(spark, d):
    attached = enrich.attach_attributes(_scored(spark, d), WISHES)
    rows = enrich.with_sensor_context(attached, fx.sensors(spark, d))
    text = rows.select("obs_id", sinks.encode_observation(rows).alias("text"))

    def field(path):
        return F.get_json_object("text", path)

    return text.select(
        "obs_id",
        field("$.date").cast("bigint").alias("date"),
        field("$.value").cast("double").alias("value"),
        field("$.producer").alias("producer"),
        field("$.timestamps").alias("timestamps"),
        field("$.qoOAttributeValues.OBS_ACCURACY").cast("double").alias("accuracy"),
        field("$.qoOAttributeValues.OBS_FRESHNESS").cast("double").alias("freshness"),
        field("$.sensorContext.latitude").alias("latitude"),
        field("$.sensorContext.relativeLocation").alias("place"),
    )


def _knowledge_rows(spark, d):
    attached = enrich.attach_attributes(_scored(spark, d), WISHES)
    sensors = fx.sensors(spark, d).withColumn("feature", F.lit(BASE + "publicLocations"))
    return enrich.with_sensor_context(attached, sensors, knowledge.SENSOR_EXTRAS)


@query(
    "snk3_delivery_topics",
    with_ctes(
        """select request_id, obs_level, concat(application_id, '_', request_id) as delivery_topic from req""", "req"
    ),
)
def _(spark, d):
    return sinks.with_delivery_topic(fx.requests(spark, d)).select("request_id", "obs_level", "delivery_topic")


@query(
    "snk3_write_delivery",
    with_ctes(
        "select concat('app', obs_id % 5, '_', topic) as delivery_topic, obs_id, producer, date_ms, value from obs", "obs"
    ),
)
def _(spark, d):
    """Rows written to one folder per delivery topic, and read back."""
    path = f"{scratch(spark)}/delivery-{uuid.uuid4().hex}"
    obs = fx.observations(spark, d)
    rows = obs.select(
        F.concat(F.lit("app"), (F.col("obs_id") % 5).cast("string")).alias("application_id"),
        F.col("topic").alias("request_id"), "obs_id", "producer", F.unix_millis("date").alias("date_ms"), "value",
    )
    sinks.write_delivery(sinks.with_delivery_topic(rows), path)
    return spark.read.parquet(path).select("delivery_topic", "obs_id", "producer", "date_ms", "value")


@query(
    "snk6_throughput_by_day",
    with_ctes(
        """select date_ms // 86400000 * 86400000 as start_ms, cast(sum(length(timestamps)) as bigint) as bytes,
          count(*) as messages, sum(length(timestamps)) / 1048576.0 as mb,
          sum(length(timestamps)) / 1048576.0 / 86400.0 as mb_per_s, count(*) / 86400.0 as messages_per_s
        from obs group by 1""",
        "obs",
    ).replace("1048576.0", "1048576::double").replace("86400.0", "86400::double"),
)
def _(spark, d):
    rows = fx.observations(spark, d).withColumnRenamed("timestamps", "message")
    return sinks.throughput_report(rows, "date", interval="1 day")


@query(
    "snk6_throughput_whole_run",
    with_ctes(
        """select min(date_ms) as start_ms, cast(sum(length(timestamps)) as bigint) as bytes, count(*) as messages,
          sum(length(timestamps)) / 1048576::double as mb,
          sum(length(timestamps)) / 1048576::double / ((max(date_ms) - min(date_ms)) / 1000::double) as mb_per_s,
          count(*) / ((max(date_ms) - min(date_ms)) / 1000::double) as messages_per_s from obs""",
        "obs",
    ),
)
def _(spark, d):
    rows = fx.observations(spark, d).withColumnRenamed("timestamps", "message")
    return sinks.throughput_report(rows, "date")


# Filters


@query(
    "flt1_allow_sensors",
    with_ctes(
        f"""select {RAW_SQL} from obs where producer in (select sensor_id from sens)""", "obs", "sens"
    ),
)
def _(spark, d):
    return flat(filters.allow_sensors(fx.observations(spark, d), fx.sensors(spark, d)).select(*RAW))


@query(
    "flt1_allow_sensors_bypass",
    with_ctes(
        f"""select {RAW_SQL} from obs where producer in (select sensor_id from sens)
        or starts_with(producer, 'sensor1') or starts_with(producer, 'sensor8')""",
        "obs", "sens",
    ),
)
def _(spark, d):
    kept = filters.allow_sensors(fx.observations(spark, d), fx.sensors(spark, d), ("sensor1", "sensor8"))
    return flat(kept.select(*RAW))


@query(
    "flt2_filter_threshold",
    with_ctes(f"select {RAW_SQL} from obs where value >= -50.0 and value <= 120.0", "obs"),
)
def _(spark, d):
    return flat(filters.filter_threshold(fx.observations(spark, d), -50.0, 120.0).select(*RAW))


@query(
    "flt2_filter_threshold_compat",
    with_ctes(f"select {RAW_SQL} from obs where value > 0 and value <= 120.0", "obs"),
)
def _(spark, d):
    compat = Compat(positive_default_min=True)
    return flat(filters.filter_threshold(fx.observations(spark, d), None, 120.0, compat).select(*RAW))


@query(
    "flt3_filter_age",
    with_ctes(f"select {RAW_SQL} from obs where {AS_OF} - date_ms < 72 * 3600000", "obs"),
)
def _(spark, d):
    return flat(filters.filter_age(fx.observations(spark, d), "72 hours", fx.AS_OF_MS).select(*RAW))


@query(
    "flt4_select_attributes",
    with_ctes(
        """select obs_id, case obs_id % 3 when 0 then 'OBS_FRESHNESS;OBS_ACCURACY' when 1 then 'OBS_ACCURACY'
          else '' end as attributes, case when obs_id % 3 < 2 then obs_accuracy end as accuracy
        from scored""".replace("from scored", f"from (select o.*, {FIXED_ACCURACY} as obs_accuracy "
                               "from obs o left join bounds using (producer))"),
        "obs", "bounds",
    ),
)
def _(spark, d):
    rows = _scored(spark, d)
    full = F.create_map(
        F.lit("OBS_ACCURACY"), F.col("obs_accuracy").cast("string"),
        F.lit("OBS_FRESHNESS"), F.col("obs_freshness").cast("string"),
    )
    both = F.array(F.lit("OBS_FRESHNESS"), F.lit("OBS_ACCURACY"))
    wanted = (
        F.when(F.col("obs_id") % 3 == 0, both)
        .when(F.col("obs_id") % 3 == 1, F.array(F.lit("OBS_ACCURACY")))
        .otherwise(F.array(F.lit("OBS_RATE")))
    )
    chosen = rows.withColumn("chosen", filters.select_attributes(full, wanted))
    return chosen.select(
        "obs_id",
        F.array_join(F.map_keys("chosen"), ";").alias("attributes"),
        F.try_element_at("chosen", F.lit("OBS_ACCURACY")).cast("double").alias("accuracy"),
    )


def _level(level: str, extra_sql: str):
    @query(
        f"flt5_project_{level.lower()}",
        with_ctes(
            f"""with {SCORED} select producer, date_ms, value, timestamps,
              obs_accuracy as accuracy, obs_freshness as freshness {extra_sql} from scored
              left join (select sensor_id as producer, latitude, longitude, altitude, relative_location,
                topic as sensor_topic from sens) using (producer)""",
            "obs", "bounds", "sens",
        ),
    )
    def _(spark, d):
        rows = filters.project_level(_knowledge_rows(spark, d), level)
        values = F.col("qoOAttributeValues")
        more = ["sensorContext.*"] if level == "INFORMATION" else []
        return flat(
            rows.select(
                "producer", "date", "value", "timestamps",
                values["OBS_ACCURACY"].cast("double").alias("accuracy"),
                values["OBS_FRESHNESS"].cast("double").alias("freshness"),
                *more,
            )
        )


_level("RAW_DATA", "")
_level(
    "INFORMATION",
    """, coalesce(latitude, 'N/A') as latitude, coalesce(longitude, 'N/A') as longitude,
    coalesce(altitude, 'N/A') as altitude, coalesce(relative_location, 'N/A') as "relativeLocation",
    coalesce(sensor_topic, 'N/A') as topic""",
)


@query(
    "flt10_has_field",
    with_ctes("select request_id, obsrate_max from req where obsrate_max is not null", "req"),
)
def _(spark, d):
    return filters.has_field(fx.requests(spark, d), "obsrate_max").select("request_id", "obsrate_max")


# Enrichment


@query(
    "jn1_with_sensor_context",
    with_ctes(
        """select obs_id, producer, coalesce(latitude, 'N/A') as latitude, coalesce(longitude, 'N/A') as longitude,
          coalesce(altitude, 'N/A') as altitude, coalesce(relative_location, 'N/A') as "relativeLocation",
          coalesce(s.topic, 'N/A') as topic from obs o left join sens s on producer = sensor_id""",
        "obs", "sens",
    ),
)
def _(spark, d):
    rows = enrich.with_sensor_context(fx.observations(spark, d), fx.sensors(spark, d))
    return rows.select("obs_id", "producer", "sensorContext.*")


@query(
    "jn2_with_capability",
    with_ctes(
        """select obs_id, producer, value, min_value, max_value from obs left join bounds using (producer)""",
        "obs", "bounds",
    ),
)
def _(spark, d):
    rows = enrich.with_capability(fx.observations(spark, d), fx.capabilities(spark, d))
    return rows.select("obs_id", "producer", "value", "min_value", "max_value")


# Scalar functions


@query(
    "fn1_accuracy",
    with_ctes(f"with {SCORED} select obs_id, value, obs_accuracy from scored", "obs", "bounds"),
)
def _(spark, d):
    return _scored(spark, d).select("obs_id", "value", "obs_accuracy")


@query(
    "fn1_accuracy_percent",
    with_ctes(
        f"""with {SCORED} select obs_id, case when value between min_value and max_value then 100.0
        else obs_accuracy * 100.0 end as obs_accuracy from scored""",
        "obs", "bounds",
    ),
)
def _(spark, d):
    obs = enrich.with_capability(fx.observations(spark, d), fx.capabilities(spark, d))
    registry = enrich.default_attributes(fx.AS_OF_MS, scale="percent")
    return enrich.score(obs, ["OBS_ACCURACY"], registry).select("obs_id", "obs_accuracy")


@query("fn2_freshness", with_ctes(f"select obs_id, cast({AS_OF} - date_ms as double) as freshness from obs", "obs"))
def _(spark, d):
    obs = fx.observations(spark, d)
    return obs.select("obs_id", quality.freshness(epoch_ms(obs, "date"), fx.AS_OF_MS).alias("freshness"))


def _stamped(spark, d):
    obs = fx.observations(spark, d)
    entered = trail.append_stamp(F.col("timestamps"), "platform_in", F.col("ingest_ms"))
    left = trail.append_stamp(entered, "platform_out", F.col("ingest_ms") + F.col("obs_id") % 50)
    return obs.withColumn("stamped", left)


@query(
    "fn3_append_stamp",
    with_ctes(
        """select obs_id, concat(timestamps, ';platform_in:', cast(ingest_ms as varchar), ';platform_out:',
        cast(ingest_ms + obs_id % 50 as varchar)) as stamped from obs""",
        "obs",
    ),
)
def _(spark, d):
    return _stamped(spark, d).select("obs_id", "stamped")


@query(
    "fn4_trail_times",
    with_ctes(
        """select obs_id, date_ms as first_ms, ingest_ms as in_ms, cast(null as bigint) as other_ms from obs""",
        "obs",
    ),
)
def _(spark, d):
    stamped = F.col("stamped")
    return _stamped(spark, d).select(
        "obs_id",
        trail.first_trail_time(stamped).alias("first_ms"),
        trail.trail_time(stamped, "platform_in").alias("in_ms"),
        trail.trail_time(stamped, "elsewhere").alias("other_ms"),
    )


@query(
    "fn5_delays",
    with_ctes(
        f"""select obs_id, {AS_OF} - date_ms as end_to_end_ms, obs_id % 50 as platform_ms from obs""", "obs"
    ),
)
def _(spark, d):
    stamped = F.col("stamped")
    return _stamped(spark, d).select(
        "obs_id",
        trail.end_to_end_ms(stamped, F.lit(fx.AS_OF_MS).cast("bigint")).alias("end_to_end_ms"),
        trail.platform_ms(stamped, "platform_in", "platform_out").alias("platform_ms"),
    )


@query(
    "fn6_parse_age",
    with_ctes("select request_id, case when age_max = '72 hours' then 259200000 end as age_ms from req", "req").replace(
        "259200000", "cast(259200000 as bigint)"
    ),
)
def _(spark, d):
    return fx.requests(spark, d).select("request_id", params.age_ms(F.col("age_max")).alias("age_ms"))


@query(
    "fn7_parse_rate",
    with_ctes(
        """select request_id, case when obsrate_max is not null then 2::bigint when obsrate_min is not null then
          cast(split_part(obsrate_min, '/', 1) as bigint) when created_ms // 86400000 % 3 = 0 then 7::bigint end as n,
          case when obsrate_max is not null or obsrate_min is not null then 3600000::bigint
          when created_ms // 86400000 % 3 = 0 then 60000::bigint end as period_ms from req""",
        "req",
    ),
)
def _(spark, d):
    other = F.when(F.floor(F.col("created_ms") / 86_400_000) % 3 == 0, F.lit("7/min")).otherwise(F.lit("often"))
    parsed = params.rate(F.coalesce("obsrate_max", "obsrate_min", other))
    return fx.requests(spark, d).select("request_id", parsed["n"].alias("n"), parsed["period_ms"].alias("period_ms"))


@query(
    "fn8_local_name",
    """select c_custkey, cast(c_custkey as varchar) as local, split_part(c_name, '#', 2) as of_name,
    '' as without from customer""",
)
def _(spark, d):
    full = F.concat(F.lit(BASE), F.col("c_custkey").cast("string"))
    return fx.table(spark, d, "customer").select(
        "c_custkey",
        naming.local_name(full).alias("local"),
        naming.local_name(F.col("c_name")).alias("of_name"),
        naming.local_name(F.col("c_mktsegment")).alias("without"),
    )


@query(
    "fn9_parse_bound",
    with_ctes("select producer as sensor_id, min_value, max_value from bounds", "bounds"),
)
def _(spark, d):
    return fx.capabilities(spark, d).select(
        "sensor_id",
        quality.parse_bound(F.col("min_value")).alias("min_value"),
        quality.parse_bound(F.col("max_value")).alias("max_value"),
    )


@query(
    "fn9_parse_bound_compat",
    with_ctes(
        """select sensor_id, min_value = '-INF' as low_open,
        case when max_value = '+INF' then 3.4028234663852886e38 else cast(max_value as double) end as max_value
        from caps""",
        "caps",
    ),
)
def _(spark, d):
    compat = Compat(float_infinity=True)
    return fx.capabilities(spark, d).select(
        "sensor_id",
        (quality.parse_bound(F.col("min_value"), compat) > 0).alias("low_open"),
        quality.parse_bound(F.col("max_value"), compat).alias("max_value"),
    )


@query(
    "fn10_inverse_variation",
    with_ctes(
        """select remedy, attribute, param_variation, attribute_variation, case param_variation when 'HIGH' then 'LOW'
        when 'LOW' then 'HIGH' else param_variation end as inverse from effects""",
        "effects",
    ),
)
def _(spark, d):
    rows = fx.remedy_catalogue(spark, d)
    return rows.select(
        "remedy", "attribute", "param_variation", "attribute_variation",
        quality.inverse_variation(F.col("param_variation")).alias("inverse"),
    )


@query(
    "fn11_level_abbrev",
    with_ctes(
        """select request_id, case obs_level when 'INFORMATION' then 'INFO' when 'KNOWLEDGE' then 'KNOW' else 'RD' end
        as abbrev from req""",
        "req",
    ),
)
def _(spark, d):
    return fx.requests(spark, d).select("request_id", naming.level_abbrev(F.col("obs_level")).alias("abbrev"))


@query(
    "fn12_stage_topic_names",
    with_ctes(
        """select request_id, concat(topic, '_', area, '_', case obs_level when 'INFORMATION' then 'INFO'
          when 'KNOWLEDGE' then 'KNOW' else 'RD' end) as selection,
          concat(application_id, '_', request_id, '_QOO2') as second_quality,
          concat(application_id, '_', request_id, '_RemedyClone') as remedy,
          concat(application_id, '_', request_id) as sink from req""",
        "req",
    ),
)
def _(spark, d):
    app, req = F.col("application_id"), F.col("request_id")
    return fx.requests(spark, d).select(
        "request_id",
        naming.selection_topic(F.col("topic"), F.col("area"), F.col("obs_level")).alias("selection"),
        naming.quality_topic(app, req, 2).alias("second_quality"),
        naming.remedy_topic(app, req, F.lit("RemedyClone")).alias("remedy"),
        naming.delivery_topic(app, req).alias("sink"),
    )


@query(
    "fn13_unique_stage_id",
    with_ctes(
        """select request_id, concat('ingest_', request_id) as stage_id, 'ingest' as stage, request_id as instance
        from req""",
        "req",
    ),
)
def _(spark, d):
    ids = fx.requests(spark, d).select(
        "request_id", naming.unique_stage_id("ingest", F.col("request_id")).alias("stage_id")
    )
    return ids.select("request_id", "stage_id", naming.split_stage_id(F.col("stage_id")).alias("p")).select(
        "request_id", "stage_id", "p.*"
    )


@query(
    "fn14_get_attribute",
    with_ctes(
        f"""with {SCORED} select obs_id, obs_accuracy as accuracy, '' as rate from scored""", "obs", "bounds"
    ),
)
def _(spark, d):
    rows = enrich.attach_attributes(_scored(spark, d), WISHES)
    values = F.col("qoOAttributeValues")
    return rows.select(
        "obs_id",
        quality.get_attribute(values, "OBS_ACCURACY").cast("double").alias("accuracy"),
        quality.get_attribute(values, "OBS_RATE").alias("rate"),
    )


@query(
    "fn15_key_by_value",
    with_ctes(
        """select request_id, case when threshold_max is not null then 'threshold_max' end as upper,
        case when obsrate_max is not null then 'obsRate_max' end as limit_key from req""",
        "req",
    ),
)
def _(spark, d):
    values = F.col("params")
    return fx.request_table(spark, d).select(
        "request_id",
        quality.key_by_value(values, "120.0").alias("upper"),
        quality.key_by_value(values, "2/hour").alias("limit_key"),
    )


@query(
    "fn16_date_text",
    with_ctes(
        """select obs_id, regexp_replace(strftime(make_timestamp(date_ms * 1000), '%Y-%m-%d %H:%M:%S.%g'),
        '(\\.\\d+?)0+$', '\\1') as date_text from obs""",
        "obs",
    ),
)
def _(spark, d):
    return fx.observations(spark, d).select("obs_id", naming.date_text(F.col("date")).alias("date_text"))


@query(
    "fn17_pad_message",
    """select o_orderkey, rpad('Topic:' || o_orderpriority || ':ThreadID:3:MessageID:'
    || lpad(cast(o_orderkey as varchar), 10, '0') || ':', 100, 'x') as message from orders""",
)
def _(spark, d):
    text = naming.pad_message(F.col("o_orderpriority"), 3, F.col("o_orderkey"), 100)
    return fx.table(spark, d, "orders").select("o_orderkey", text.alias("message"))


# Linked data


def _gr2_sql() -> str:
    def own(name):
        return f"'{BASE}{name}'"

    def p(curie):
        return f"'{iri(curie)}'"

    sensor = f"concat('{BASE}', producer)"
    rows = [
        (own("obs"), "rdf:type", p("ssn:Observation")),
        (own("obs"), "ssn:featureOfInterest", f"case when s_topic is null then 'N/A' else {own('publicLocations')} end"),
        (own("obs"), "ssn:observationResult", own("sensorOutput")),
        (own("obs"), "ssn:observedBy", sensor),
        (own("obs"), "ssn:observedProperty", f"coalesce(concat_ws('', {own('')}, nullif(s_topic, '')), 'N/A')"),
        (sensor, "rdf:type", p("ssn:Sensor")),
        (sensor, "geo:location", own("location")),
        (own("location"), "rdf:type", p("geo:Point")),
        (own("location"), "geo:alt", "coalesce(altitude, 'N/A')"),
        (own("location"), "iot-lite:altRelative", "coalesce(relative_altitude, 'N/A')"),
        (own("location"), "geo:lat", "coalesce(latitude, 'N/A')"),
        (own("location"), "geo:long", "coalesce(longitude, 'N/A')"),
        (own("location"), "iot-lite:relativeLocation", "coalesce(relative_location, 'N/A')"),
        (own("sensorOutput"), "rdf:type", p("ssn:SensorOutput")),
        (own("sensorOutput"), "ssn:hasValue", own("obsValue")),
        (own("obsValue"), "rdf:type", p("ssn:ObservationValue")),
        (own("obsValue"), "qoo:hasQoO", own("qooAttributesList")),
        (own("obsValue"), "iot-lite:hasQuantityKind", "coalesce(quantity_kind, 'N/A')"),
        (own("obsValue"), "iot-lite:hasUnit", "coalesce(unit, 'N/A')"),
        (own("obsValue"), "qoo:obsDateValue",
         "regexp_replace(strftime(make_timestamp(date_ms * 1000), '%Y-%m-%d %H:%M:%S.%g'), '(\\.\\d+?)0+$', '\\1')"),
        (own("obsValue"), "qoo:obsLevelValue", "'KNOWLEDGE'"),
        (own("obsValue"), "qoo:obsStrValue", "value"),
        (own("obsValue"), "qoo:obsTimestampsValue", "timestamps"),
        (own("qooAttributesList"), "rdf:type", "'rdf:Seq'"),
        (own("qooAttributesList"), "rdf:_1", own("qooIntrinsic_OBS_ACCURACY")),
        (own("qooAttributesList"), "rdf:_2", own("qooIntrinsic_OBS_FRESHNESS")),
    ]
    for name, stem, unit, column in (
        ("OBS_ACCURACY", "accuracy", "Percent", "obs_accuracy"),
        ("OBS_FRESHNESS", "freshness", "Millisecond", "obs_freshness"),
    ):
        rows += [
            (own("qooIntrinsic_" + name), "rdf:type", p("qoo:QoOIntrisicQuality")),
            (own("qooIntrinsic_" + name), "qoo:hasQoOValue", own("qooValue_" + name)),
            (own("qooIntrinsic_" + name), "qoo:isAbout", f"'{name}'"),
            (own("qooValue_" + name), "rdf:type", p("qoo:QoOValue")),
            (own("qooValue_" + name), "iot-lite:hasQuantityKind", own(stem + "Kind")),
            (own("qooValue_" + name), "iot-lite:hasUnit", own(stem + "Unit")),
            (own("qooValue_" + name), "qoo:qooStrValue", column),
            (own(stem + "Kind"), "rdf:type", p("m3-lite:Others")),
            (own(stem + "Unit"), "rdf:type", p("m3-lite:" + unit)),
        ]
    numeric = ("qoo:obsStrValue", "qoo:qooStrValue")
    selects = [
        f"select obs_id, {s} as s, {p(c)} as p, "
        + (f"cast(null as varchar) as o, cast({o} as double) as number" if c in numeric
           else f"{o} as o, cast(null as double) as number")
        + " from wide"
        for s, c, o in rows
    ]
    return f"""with {SCORED}, wide as (select scored.*, latitude, longitude, altitude, relative_altitude,
        relative_location, quantity_kind, unit, s_topic from scored left join (select sensor_id as producer, latitude,
        longitude, altitude, relative_altitude, relative_location, quantity_kind, unit, topic as s_topic from sens)
        using (producer)) """ + " union all ".join(selects)


GR2 = with_ctes(_gr2_sql(), "obs", "bounds", "sens").replace(
    f"coalesce(concat_ws('', '{BASE}', nullif(s_topic, '')), 'N/A')",
    f"case when s_topic is null then 'N/A' else concat('{BASE}', s_topic) end",
)


@query("gr2_knowledge_triples", GR2)
def _(spark, d):
    triples = knowledge.knowledge_triples(_knowledge_rows(spark, d))
    numeric = F.col("p").isin(iri("qoo:obsStrValue"), iri("qoo:qooStrValue"))
    return triples.select(
        "obs_id", "s", "p",
        F.when(~numeric, F.col("o")).alias("o"),
        F.when(numeric, F.col("o").cast("double")).alias("number"),
    )


def _node_statements(rows, column: str):
    """Every key of every node as a statement, in the form of the triples."""
    keys = knowledge.NODE_KEYS
    named = F.col(column).getField

    def pair(predicate: str, value):
        return F.struct(F.lit(predicate).alias("p"), value.alias("o"))

    exploded = rows.select("obs_id", F.explode(column).alias("node"))
    node = F.col("node")
    pairs = F.array(pair(iri("rdf:type"), node["@type"]), *[pair(iri(c), node[k]) for k, c in keys.items()])
    flat_rows = exploded.select("obs_id", node["@id"].alias("s"), F.inline(pairs)).where("o is not null")
    numeric = F.col("p").isin(iri("qoo:obsStrValue"), iri("qoo:qooStrValue"))
    return flat_rows.select(
        "obs_id", "s", "p", F.when(~numeric, F.col("o")).alias("o"), F.when(numeric, F.col("o").cast("double")).alias("number")
    )


def _text_statements(rows):
    """Every key of every node of ``text`` as a statement; a node is read as the few keys that it has, not as all it may have."""
    named = {"@type": iri("rdf:type"), **{k: iri(c) for k, c in knowledge.NODE_KEYS.items()}}
    predicate = F.create_map(*[F.lit(x) for pair in named.items() for x in pair])
    parsed = rows.select("obs_id", F.from_json("text", "obs array<map<string,string>>").alias("doc"))
    nodes = parsed.select("obs_id", F.explode("doc.obs").alias("node"))
    keys = nodes.select("obs_id", F.col("node")["@id"].alias("s"), F.explode("node").alias("key", "o"))
    found = keys.select("obs_id", "s", predicate[F.col("key")].alias("p"), "o").where("p is not null and o is not null")
    numeric = F.col("p").isin(iri("qoo:obsStrValue"), iri("qoo:qooStrValue"))
    return found.select(
        "obs_id", "s", "p", F.when(~numeric, F.col("o")).alias("o"), F.when(numeric, F.col("o").cast("double")).alias("number")
    )


@query("gr1_knowledge_nodes", GR2)
def _(spark, d):
    rows = _knowledge_rows(spark, d).select("obs_id", knowledge.knowledge_nodes(WireNames()).alias("nodes"))
    return _node_statements(rows, "nodes")


@query("snk2_encode_knowledge", GR2)
def _(spark, d):
    """All nodes of the written text, read back."""
    text = _knowledge_rows(spark, d).select("obs_id", sinks.encode_knowledge().alias("text"))
    return _text_statements(text)


DATE_TEXT = "regexp_replace(strftime(make_timestamp(date_ms * 1000), '%Y-%m-%d %H:%M:%S.%g'), '(\\.\\d+?)0+$', '\\1')"


@query("flt5_project_knowledge", GR2.replace("select obs_id,", f"select {DATE_TEXT} as at, producer as maker,"))
def _(spark, d):
    rows = _knowledge_rows(spark, d)
    shaped = filters.project_level(rows, "KNOWLEDGE")
    # the level delivers nodes only; the maker and time of a document are read from these
    def value(node: str, key: str):
        return F.filter("obs", lambda n: n["@id"] == BASE + node)[0][key]

    maker = F.substring(value("obs", "observedBy"), len(BASE) + 1, 1000)
    named = shaped.select(F.struct(value("obsValue", "obsDateValue").alias("at"), maker.alias("maker")).alias("obs_id"), "obs")
    return _node_statements(named, "obs").select("obs_id.at", "obs_id.maker", "s", "p", "o", "number")
