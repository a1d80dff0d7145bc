"""Requests: look-ups, state history, matching, sharing and differences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.functions.clock import as_column
from tidegauge.schema import ALL, STATUSES, TRANSITIONS, Compat

# Look-ups


def requests_by(requests: DataFrame, field: str, value: str) -> DataFrame:
    return requests.where(F.col(field) == value)


def single_request(requests: DataFrame, request_id: str) -> DataFrame:
    """The one request with this id; the job fails if there is none or several."""
    hits = requests.where(F.col("request_id") == request_id)
    count = hits.limit(2).count()
    if count != 1:
        raise LookupError(f"{'no' if count == 0 else 'more than one'} request {request_id!r}")
    return hits


def current_status(states: Column) -> Column:
    return F.try_element_at(states, F.lit(-1))["status"]


def requests_by_app_status(requests: DataFrame, application: str | None, statuses: Sequence[str]) -> DataFrame:
    """Requests (of an application) whose current status is one of ``statuses``."""
    unknown = set(statuses) - set(STATUSES)
    if unknown:
        raise ValueError(f"unknown statuses {sorted(unknown)}")
    kept = requests.where(current_status(F.col("states")).isin(*statuses))
    return kept if application is None else kept.where(F.col("application_id") == application)


def was_in_state(states: Column, status: str) -> Column:
    return F.exists(states, lambda s: s["status"] == status)


def state_details(states: Column, status: str) -> Column:
    """First entry with this status; the job fails where there is none."""
    hits = F.filter(states, lambda s: s["status"] == status)
    message = F.concat(F.lit(f"never in state {status}: "), F.array_join(F.transform(states, lambda s: s["status"]), ","))
    return F.when(F.size(hits) > 0, F.try_element_at(hits, F.lit(1))).otherwise(
        F.raise_error(message).cast("struct<status:string,start_date:bigint,end_date:bigint>")
    )


def interested_requests(requests: DataFrame, attribute: str) -> DataFrame:
    return requests.where(F.array_contains("interested_in", attribute))


# State history and logs


def advance_state(states: Column, status: str | Column, now_ms: int | Column) -> Column:
    """Close the open entry at ``now_ms`` and append the new one."""
    now = as_column(now_ms).cast("bigint")
    before = F.slice(states, 1, F.greatest(F.size(states) - 1, F.lit(0)))
    closed = F.transform(
        F.slice(states, -1, 1),
        lambda s: F.struct(s["status"].alias("status"), s["start_date"].alias("start_date"), now.alias("end_date")),
    )
    new = F.struct(as_column(status).alias("status"), now.alias("start_date"), now.alias("end_date"))
    return F.when(F.size(states) > 0, F.concat(before, closed, F.array(new))).otherwise(F.array(new))


def history_from_events(events: DataFrame) -> DataFrame:
    """State log (request_id, seq, status, start_ms) with ``end_ms``; open entries end as they start."""
    window = Window.partitionBy("request_id").orderBy("start_ms", "seq")
    return events.withColumn("end_ms", F.coalesce(F.lead("start_ms").over(window), F.col("start_ms")))


def state_durations(requests: DataFrame) -> DataFrame:
    """Milliseconds that each request spent in each state entry."""
    rows = requests.select("request_id", F.posexplode("states").alias("seq", "_s"))
    return rows.select(
        "request_id",
        "seq",
        F.col("_s.status").alias("status"),
        (F.col("_s.end_date") - F.col("_s.start_date")).alias("duration_ms"),
    )


def prepend_log(logs: Column, text: str | Column, now_ms: int | Column) -> Column:
    """Newest first: ``ms: text`` in front of the list."""
    line = F.concat(as_column(now_ms).cast("string"), F.lit(": "), as_column(text))
    return F.concat(F.array(line), logs)


def request_start(logs: Column) -> Column:
    """Creation time, the number before the colon of the oldest entry."""
    return F.split_part(F.try_element_at(logs, F.lit(-1)), F.lit(":"), F.lit(1)).try_cast("bigint")


def list_requests(requests: DataFrame) -> DataFrame:
    """All requests, newest first."""
    started = requests.withColumn("start_ms", request_start(F.col("logs")))
    return started.orderBy(F.desc("start_ms"), "request_id")


def apply_lifecycle(events: DataFrame, by_user: str | None = None) -> DataFrame:
    """State log with ``previous`` and ``valid``: whether the transition is allowed.

    The first entry must be CREATED. ``by_user`` names a BOOLEAN column; a
    removal by the user is allowed from ENFORCED or HEALED only.
    """
    window = Window.partitionBy("request_id").orderBy("start_ms", "seq")
    previous = F.lag("status").over(window)
    pairs = F.lit(False)
    for before, after in TRANSITIONS:
        pairs = pairs | ((F.col("previous") == before) & (F.col("status") == after))
    valid = F.when(F.col("previous").isNull(), F.col("status") == "CREATED").otherwise(pairs)
    if by_user:
        deletion = F.col(by_user) & (F.col("status") == "REMOVED")
        valid = F.when(deletion, F.coalesce(F.col("previous").isin("ENFORCED", "HEALED"), F.lit(False))).otherwise(valid)
    return events.withColumn("previous", previous).withColumn("valid", valid)


# Matching with sensors


def offers(sensors: DataFrame) -> DataFrame:
    """Sensors under every (topic, area) by which a request can select them, ``ALL`` included."""
    by_topic = sensors.withColumn("sel_topic", F.explode(F.array(F.col("topic"), F.lit(ALL))))
    return by_topic.withColumn("sel_area", F.explode(F.array(F.col("area"), F.lit(ALL))))


def match_requests_to_sensors(
    requests: DataFrame, sensors: DataFrame, compat: Compat = Compat()
) -> DataFrame:
    """Sensors of every distinct (topic, area) that requests ask for.

    ``ALL`` selects everything. The result has one row per selection and
    sensor; requests with equal selections share it by an equi-join on both
    columns.
    """
    chosen = offers(sensors).select("sensor_id", "sel_topic", "sel_area").distinct()
    return _selections(requests, sensors, compat).join(chosen, _selects()).select("topic", "area", "sensor_id")


def _selections(requests: DataFrame, sensors: DataFrame, compat: Compat) -> DataFrame:
    """Distinct (topic, area) of requests, with the area ``_use`` under which sensors are looked up."""
    wanted = requests.select("topic", "area").distinct()
    if not compat.any_known_place:
        return wanted.withColumn("_use", F.col("area"))
    known = sensors.select("area").distinct().withColumn("_known", F.lit(True))
    return wanted.join(known, "area", "left").select(
        "topic",
        "area",
        F.when(F.col("_known") | (F.col("area") == ALL), F.lit(ALL)).otherwise(F.col("area")).alias("_use"),
    )


def _selects() -> Column:
    return (F.col("topic") == F.col("sel_topic")) & (F.col("_use") == F.col("sel_area"))


def admit_requests(requests: DataFrame, sensors: DataFrame, compat: Compat = Compat()) -> DataFrame:
    """Add ``status`` (SUBMITTED or REJECTED) and the ``log`` text of the decision.

    Selections are looked up among those that sensors offer, not sensor by sensor.
    """
    places = offers(sensors.select("topic", "area").distinct()).select("sel_topic", "sel_area").distinct()
    found = _selections(requests, sensors, compat).join(places, _selects(), "left_semi").select("topic", "area")
    joined = requests.join(found.withColumn("_found", F.lit(True)), ["topic", "area"], "left")
    hit = F.coalesce("_found", F.lit(False))
    pair = F.concat(F.lit("("), F.col("topic"), F.lit(" / "), F.col("area"), F.lit(")"))
    log = F.when(hit, F.concat(F.lit("Sensors are known for "), pair)).otherwise(
        F.concat(F.lit("Rejected, as no sensor serves "), pair)
    )
    status = F.when(hit, F.lit("SUBMITTED")).otherwise(F.lit("REJECTED"))
    return joined.select(*requests.columns, status.alias("status"), log.alias("log"))


# Sharing and differences


def canonical_map(values: Column) -> Column:
    """Text of a map that is equal for equal maps, whatever their entry order."""
    return F.to_json(F.array_sort(F.map_entries(values)))


def sharing_key(columns: Sequence[str] | None = None) -> Column:
    """Text that is equal for requests served by the same chain.

    Compares topic, location, level, the ordered wish list, operator, service
    level and both parameter maps, or the given plain columns.
    """
    if columns is not None:
        return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    return F.to_json(
        F.struct(
            "topic",
            "location",
            "obs_level",
            "interested_in",
            "operator",
            "sla_level",
            canonical_map(F.col("params")).alias("params"),
            canonical_map(F.col("custom_params")).alias("custom_params"),
        ),
        {"ignoreNullFields": "false"},
    )


def find_shared_requests(
    requests: DataFrame,
    *,
    key: Column | None = None,
    status: str = "status",
    order_by: str = "created_ms",
    compat: Compat = Compat(),
) -> DataFrame:
    """For each SUBMITTED request the first equal ENFORCED one: request_id, shared_with.

    ``shared_with`` is NULL if there is none. Equal requests are compared by one
    value per group, never pair by pair.
    """
    keyed = requests.withColumn("_equal", sharing_key() if key is None else key)
    usable = keyed
    if compat.shared_needs_custom_params:
        usable = usable.where(F.size("custom_params") > 0)
    first = (
        usable.where(F.col(status) == "ENFORCED")
        .groupBy("_equal")
        .agg(F.min_by("request_id", F.struct(order_by, "request_id")).alias("shared_with"))
    )
    new = keyed.where(F.col(status) == "SUBMITTED")
    return new.join(first, "_equal", "left").select("request_id", "shared_with")


def request_diff(old: DataFrame, new: DataFrame, key: str = "request_id") -> DataFrame:
    """Names of the fields in which two versions of a request differ."""
    plain = ("obs_level", "interested_in", "operator", "sla_level")
    maps = ("custom_params", "params")

    def side(df: DataFrame, suffix: str) -> DataFrame:
        return df.select(
            key,
            *[F.col(c).alias(c + suffix) for c in plain if c in df.columns],
            *[canonical_map(F.col(c)).alias(c + suffix) for c in maps if c in df.columns],
        )

    both = [c for c in plain + maps if c in old.columns and c in new.columns]
    joined = side(old, "_a").join(side(new, "_b"), key)
    names = [F.when(~F.col(c + "_a").eqNullSafe(F.col(c + "_b")), F.lit(c)) for c in both]
    return joined.select(key, F.array_compact(F.array(*names)).alias("changed"))


def registry_diff(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Entries that are NEW, CHANGED or MISSING between two scans, by content hash."""

    def hashed(df: DataFrame, name: str) -> DataFrame:
        content = F.md5(F.to_json(F.struct(*[c for c in df.columns if c != key]), {"ignoreNullFields": "false"}))
        return df.select(key, content.alias(name))

    joined = hashed(old, "_old").join(hashed(new, "_new"), key, "full_outer")
    change = (
        F.when(F.col("_old").isNull(), F.lit("NEW"))
        .when(F.col("_new").isNull(), F.lit("MISSING"))
        .when(F.col("_old") != F.col("_new"), F.lit("CHANGED"))
    )
    return joined.select(key, change.alias("change")).where(F.col("change").isNotNull())


# Delivered observations and reports


def latest_per(rows: DataFrame, n: int, ts: str, keys: Sequence[str], tie: Sequence[str] = ()) -> DataFrame:
    """The last ``n`` rows per key, newest first by ``rank``.

    Each task drops what cannot be among them before rows are shuffled.
    """
    order = [F.desc(ts), *[F.desc(t) for t in tie]]
    window = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= n)


def latest_observations(
    log: DataFrame, request_id: str, n: int = 20, ts: str = "timestamp_ms", tie: Sequence[str] | None = None
) -> DataFrame:
    """The last ``n`` delivered observations of one request, newest first.

    Those of one time are ordered by ``tie``, by default by all columns.
    """
    others = [c for c in log.columns if c != ts] if tie is None else tie
    return log.where(F.col("request_id") == request_id).orderBy(F.desc(ts), *[F.desc(c) for c in others]).limit(n)


def quality_series(log: DataFrame, ts: str = "consumed_ms", keys: Sequence[str] = ("request_id",)) -> DataFrame:
    """Consumed time, freshness and accuracy, oldest first, decimals cut off."""
    whole = {n: F.col(n).cast("bigint") for n in ("freshness", "accuracy") if n in log.columns}
    return log.select(*keys, ts, *[c.alias(n) for n, c in whole.items()]).orderBy(*keys, ts)
