"""The library's input shapes, derived from the given star-schema tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.functions.clock import epoch_ms
from tidegauge.operators.spread import distinct

AS_OF_MS = 1_706_659_200_000

# Texts that the adapters assign by position.
TOPICS = ("click", "purchase", "error", "signup", "view")
REQUEST_TOPICS = ("click", "purchase", "error", "signup", "view", "ALL")
REQUEST_AREAS = ("ALL", "ASIA", "EUROPE", "ATLANTIS")
REQUEST_MINIMA = ("1/hour", "3/hour", "8/hour")
REQUEST_LEVELS = ("RAW_DATA", "INFORMATION", "KNOWLEDGE")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(position: Column, words: tuple[str, ...]) -> Column:
    """``words[position]`` as a column; used to spread texts over keys."""
    index = F.pmod(position, F.lit(len(words))).cast("int") + 1
    return F.element_at(F.array(*[F.lit(w) for w in words]), index)


# Odd multipliers that spread a key differently for each field.
SPREADS = (2654435761, 2246822519, 3266489917, 668265263, 374761393, 2146121005, 3550635117, 1181783497)


def spread(key: Column, field: int) -> Column:
    """A number from 0 to 65535 by key, independent for each field."""
    return F.shiftright((key.cast("bigint") * F.lit(SPREADS[field])) % F.lit(1 << 32), 16)


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    ms = epoch_ms(events, "ts")
    return events.select(
        F.col("event_id").alias("obs_id"),
        F.col("event_type").alias("topic"),
        F.concat(F.lit("sensor"), F.col("user_id").cast("string")).alias("producer"),
        F.timestamp_millis(ms).alias("date"),
        (F.col("value") - F.lit(100.0)).alias("value"),
        (ms + 50 + (F.col("event_id") % 7) * 100).alias("ingest_ms"),
        F.concat(F.lit("produced:"), ms.cast("string")).alias("timestamps"),
    )


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations as the JSON text that producers send, plus what is no observation.

    Every event also contributes its ``props`` text, which is JSON without the
    four fields, so that half of the messages are malformed.
    """
    obs = observations(spark, sf_dir)
    body = F.to_json(
        F.struct(
            F.unix_millis("date").cast("string").alias("date"),
            F.col("value").alias("value"),
            "producer",
            "timestamps",
        )
    )
    good = obs.select("obs_id", "topic", body.alias("message"))
    events = table(spark, sf_dir, "events")
    bad = events.select(
        F.col("event_id").alias("obs_id"),
        F.col("event_type").alias("topic"),
        F.col("props").alias("message"),
    )
    return good.unionByName(bad)


def sensors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers in good standing are registered sensors; the others stay unknown."""
    c = table(spark, sf_dir, "customer").where(F.col("c_acctbal") >= 0)
    n = table(spark, sf_dir, "nation")
    r = table(spark, sf_dir, "region")
    joined = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(
        r, F.col("n_regionkey") == F.col("r_regionkey")
    )
    key = F.col("c_custkey")
    return joined.select(
        F.concat(F.lit("sensor"), key.cast("string")).alias("sensor_id"),
        pick(key, TOPICS).alias("topic"),
        F.col("n_name").alias("relative_location"),
        F.col("r_name").alias("area"),
        (F.col("c_nationkey") * 3 - 36).cast("string").alias("latitude"),
        (F.col("c_nationkey") * 7 - 84).cast("string").alias("longitude"),
        (F.col("c_nationkey") * 10).cast("string").alias("altitude"),
        F.lit("0").alias("relative_altitude"),
        F.concat(F.lit("kind"), (key % 4).cast("string")).alias("quantity_kind"),
        F.concat(F.lit("unit"), (key % 4).cast("string")).alias("unit"),
        F.concat(F.lit("http://sensor.example/"), key.cast("string")).alias("url"),
    )


def capabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").where(F.col("c_acctbal") >= 0)
    key = F.col("c_custkey")
    high = F.concat((F.lit(50) + (key % 5) * 40).cast("string"), F.lit(".0"))
    return c.select(
        F.concat(F.lit("sensor"), key.cast("string")).alias("sensor_id"),
        pick(key, TOPICS).alias("topic"),
        F.when(key % 7 == 0, F.lit("-INF")).otherwise(F.lit("-20.0")).alias("min_value"),
        F.when(key % 11 == 0, F.lit("+INF")).otherwise(high).alias("max_value"),
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One request per order; fields are drawn independently and repeat, so that requests coincide."""
    key = F.col("o_orderkey")
    orders = table(spark, sf_dir, "orders")
    return orders.select(
        F.concat(F.lit("req"), key.cast("string")).alias("request_id"),
        F.concat(F.lit("app"), (F.col("o_custkey") % 5).cast("string")).alias("application_id"),
        pick(spread(key, 0), REQUEST_TOPICS).alias("topic"),
        pick(spread(key, 1), REQUEST_AREAS).alias("area"),
        pick(spread(key, 2), REQUEST_LEVELS).alias("obs_level"),
        F.when(spread(key, 3) % 2 == 0, F.lit(-50.0)).alias("threshold_min"),
        F.when(spread(key, 4) % 3 == 0, F.lit(120.0)).alias("threshold_max"),
        F.when(spread(key, 5) % 4 == 1, F.lit("2/hour")).alias("obsrate_max"),
        F.when(spread(key, 5) % 4 == 2, pick(spread(key, 6), REQUEST_MINIMA)).alias("obsrate_min"),
        F.when(spread(key, 7) % 5 == 0, F.lit("72 hours")).otherwise(F.lit("unset")).alias("age_max"),
        F.when(key % 2 == 0, F.lit("GUARANTEED")).otherwise(F.lit("BEST_EFFORT")).alias("sla_level"),
        epoch_ms(orders, "o_orderdate").alias("created_ms"),
        F.col("o_orderstatus").alias("order_status"),
    )


def request_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State log: every request is created and submitted, then enforced or rejected.

    Finished orders are healed and removed after that, so histories differ.
    """
    req = requests(spark, sf_dir)
    tail = F.when(F.col("area") == "ATLANTIS", F.array(F.lit("REJECTED")))
    tail = tail.when(
        F.col("order_status") == "F",
        F.array(F.lit("SUBMITTED"), F.lit("ENFORCED"), F.lit("HEALED"), F.lit("REMOVED")),
    ).otherwise(F.array(F.lit("SUBMITTED"), F.lit("ENFORCED")))
    path = F.concat(F.array(F.lit("CREATED")), tail)
    steps = req.select("request_id", "application_id", "created_ms", F.posexplode(path).alias("seq", "status"))
    return steps.select(
        "request_id",
        "application_id",
        "seq",
        "status",
        (F.col("created_ms") + F.col("seq") * 1000).alias("start_ms"),
    )


def request_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests with their state history as an array, oldest first."""
    req = requests(spark, sf_dir)
    start = F.col("created_ms")

    def entry(status: str, begin: Column, end: Column) -> Column:
        return F.struct(
            F.lit(status).alias("status"), begin.alias("start_date"), end.alias("end_date")
        )

    created = entry("CREATED", start, start + 1000)
    rejected = entry("REJECTED", start + 1000, start + 1000)
    submitted = entry("SUBMITTED", start + 1000, start + 2000)
    enforced_open = entry("ENFORCED", start + 2000, start + 2000)
    enforced = entry("ENFORCED", start + 2000, start + 3000)
    healed = entry("HEALED", start + 3000, start + 4000)
    removed = entry("REMOVED", start + 4000, start + 4000)
    states = (
        F.when(F.col("area") == "ATLANTIS", F.array(created, rejected))
        .when(
            F.col("order_status") == "F",
            F.array(created, submitted, enforced, healed, removed),
        )
        .otherwise(F.array(created, submitted, enforced_open))
    )
    created_log = F.concat(start.cast("string"), F.lit(": Request received."))
    second_log = F.concat((start + 1000).cast("string"), F.lit(": Looked up: sensors."))
    return req.select(
        "request_id",
        "application_id",
        "topic",
        "area",
        "obs_level",
        "sla_level",
        F.when(
            F.col("sla_level") == "GUARANTEED",
            F.array(F.lit("OBS_ACCURACY"), F.lit("OBS_FRESHNESS")),
        )
        .otherwise(F.array(F.lit("OBS_RATE")))
        .alias("interested_in"),
        "created_ms",
        states.alias("states"),
        F.array(second_log, created_log).alias("logs"),
    )


def request_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full request rows: wishes, parameter maps, states and logs, with the current status.

    Open orders are enforced requests, pending ones submitted, finished ones removed.
    """
    req = requests(spark, sf_dir)
    priority = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("req"), F.col("o_orderkey").cast("string")).alias("request_id"),
        F.col("o_orderpriority").alias("priority"),
    )

    def pair(name: str, value: Column) -> Column:
        return F.struct(F.lit(name).alias("key"), value.alias("value"))

    wanted = (
        pair("threshold_min", F.when(F.col("threshold_min").isNotNull(), F.lit("-50.0"))),
        pair("threshold_max", F.when(F.col("threshold_max").isNotNull(), F.lit("120.0"))),
        pair("obsRate_max", F.col("obsrate_max")),
        pair("obsRate_min", F.col("obsrate_min")),
    )
    pairs = F.filter(F.array(*wanted), lambda p: p["value"].isNotNull())
    states = request_states(spark, sf_dir).select("request_id", "states", "logs", "interested_in")
    joined = req.join(priority, "request_id").join(states, "request_id")
    return joined.select(
        "request_id",
        "application_id",
        "topic",
        F.col("area").alias("location"),
        "obs_level",
        "interested_in",
        F.lit("NONE").alias("operator"),
        "sla_level",
        F.map_from_entries(pairs).alias("params"),
        F.create_map(F.lit("priority"), F.col("priority")).alias("custom_params"),
        "states",
        "logs",
        "created_ms",
        F.element_at(
            F.create_map(
                *[F.lit(x) for x in ("O", "ENFORCED", "P", "SUBMITTED", "F", "REMOVED")]
            ),
            F.col("order_status"),
        ).alias("status"),
    )


def request_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests as applications post them; some leave out the level, some the topic."""
    rows = request_table(spark, sf_dir)
    body = F.struct(
        "application_id",
        F.when(F.col("custom_params")["priority"] != "5-LOW", F.col("topic")).alias("topic"),
        "location",
        F.when(F.col("obs_level") != "RAW_DATA", F.col("obs_level")).alias("obs_level"),
        F.when(
            F.col("sla_level") == "GUARANTEED", F.struct("interested_in", "sla_level", F.col("params").alias("platform_params"))
        ).alias("qoo"),
    )
    return rows.select("request_id", F.to_json(body).alias("message"))


def remedy_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One remedy with one parameter per part; its brand and size set the effects."""
    key = F.col("p_partkey")
    directions = ("HIGH", "LOW", "CONSTANT")
    first = F.struct(
        F.lit("OBS_RATE").alias("attribute"),
        pick(key, directions).alias("param_variation"),
        pick(F.col("p_size"), ("HIGH", "LOW")).alias("attribute_variation"),
    )
    second = F.struct(
        pick(key, ("OBS_ACCURACY", "OBS_FRESHNESS", "OBS_RATE")).alias("attribute"),
        pick(key + 1, directions).alias("param_variation"),
        pick(F.col("p_size") + key, ("LOW", "HIGH")).alias("attribute_variation"),
    )
    exploded = table(spark, sf_dir, "part").select(
        F.concat(F.lit("Remedy"), key.cast("string")).alias("remedy"),
        F.concat(F.lit("param"), key.cast("string")).alias("param"),
        pick(key, ("Integer", "Integer", "String")).alias("type"),
        F.lit("0").alias("min"),
        (F.col("p_size") + 1).cast("string").alias("max"),
        F.col("p_size").cast("string").alias("initial"),
        F.explode(F.array(first, second)).alias("effect"),
    )
    return distinct(exploded.select("remedy", "param", "type", "min", "max", "initial", "effect.*"))


def attribute_targets(spark: SparkSession) -> DataFrame:
    """The direction in which each quality attribute is good (three rows, fixed)."""
    return spark.createDataFrame(
        [("OBS_RATE", "HIGH"), ("OBS_ACCURACY", "HIGH"), ("OBS_FRESHNESS", "LOW")],
        "name string, should_be string",
    )


def registry_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sensors, their places, remedies and attributes as one triple table."""
    from tidegauge.operators.registry import attribute_triples, place_triples, remedy_triples, sensor_triples

    forms = registration_forms(spark, sf_dir)
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    nowhere = F.lit(None).cast("string")
    places = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_name").alias("name"),
        F.col("n_name").alias("relative_location"),
        F.col("r_name").alias("area"),
        (F.col("n_nationkey") * 3 - 36).cast("string").alias("latitude"),
        (F.col("n_nationkey") * 7 - 84).cast("string").alias("longitude"),
        (F.col("n_nationkey") * 10).cast("string").alias("altitude"),
        F.lit("0").alias("relative_altitude"),
    )
    areas = r.select(
        F.col("r_name").alias("name"),
        F.col("r_name").alias("relative_location"),
        nowhere.alias("area"),
        F.lit("0").alias("latitude"),
        F.lit("0").alias("longitude"),
        F.lit("0").alias("altitude"),
        F.lit("0").alias("relative_altitude"),
    )
    return distinct(
        sensor_triples(forms)
        .unionByName(place_triples(places))
        .unionByName(place_triples(areas))
        .unionByName(remedy_triples(remedy_catalogue(spark, sf_dir)))
        .unionByName(attribute_triples(attribute_targets(spark)))
    )


def registration_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registered sensors as the rows that ``register_sensors`` takes."""
    caps = capabilities(spark, sf_dir).drop("topic")
    known = sensors(spark, sf_dir).join(caps, "sensor_id")
    return known.select(
        "sensor_id",
        F.concat(F.lit("qoo:"), F.col("topic")).alias("topic"),
        F.concat(F.lit("qoo:loc_"), F.col("relative_location")).alias("location"),
        F.concat(F.lit("m3-lite:"), F.col("quantity_kind")).alias("quantity_kind"),
        F.concat(F.lit("m3-lite:"), F.col("unit")).alias("unit"),
        "url",
        F.lit("http").alias("interface_type"),
        F.concat(F.lit("reads "), F.col("topic")).alias("interface_description"),
        "min_value",
        "max_value",
    )
