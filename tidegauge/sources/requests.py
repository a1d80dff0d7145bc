"""Requests and request topologies as documents and tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.functions.clock import as_column
from tidegauge.operators.requests import prepend_log
from tidegauge.schema import ATTRIBUTES, LEVELS, OPERATORS, SLA_LEVELS, WireNames

_TEXT_MAP = "map<string,string>"


def read_requests(spark: SparkSession, path: str, fmt: str = "json", wire: WireNames | None = None) -> DataFrame:
    """Request documents as a table with the quality requirements flattened."""
    wire = wire or WireNames()
    return flatten_requests(spark.read.schema(wire.request_schema()).format(fmt).load(path), wire)


def parse_requests(documents: DataFrame, column: str = "document", wire: WireNames | None = None) -> DataFrame:
    """Like :func:`read_requests`, for documents that are a text column."""
    wire = wire or WireNames()
    body = F.from_json(F.col(column), wire.request_schema()).alias("_body")
    return flatten_requests(documents.select(body).select("_body.*"), wire)


def flatten_requests(documents: DataFrame, wire: WireNames | None = None) -> DataFrame:
    wire = wire or WireNames()
    quality = F.col("qoo")
    return documents.select(
        "request_id",
        "application_id",
        "topic",
        "location",
        "obs_level",
        F.coalesce(quality["interested_in"], F.array().cast("array<string>")).alias("interested_in"),
        F.coalesce(quality["operator"], F.lit("NONE")).alias("operator"),
        F.coalesce(quality["sla_level"], F.lit("BEST_EFFORT")).alias("sla_level"),
        F.coalesce(quality[wire.params_field], _empty_map()).alias("params"),
        F.coalesce(quality["custom_params"], _empty_map()).alias("custom_params"),
        F.col("statesList").alias("states"),
        "logs",
    )


def _empty_map() -> Column:
    return F.map_from_entries(F.array().cast("array<struct<key:string,value:string>>")).cast(_TEXT_MAP)


def submit_requests(
    messages: DataFrame,
    now_ms: int | Column,
    *,
    column: str = "message",
    id_column: str | None = None,
    position: Sequence[str] = (),
    wire: WireNames | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Posted JSON to (accepted requests, rejects with ``reason``).

    Defaults: raw level, no quality wishes, BEST_EFFORT, operator NONE, state
    CREATED and a first log line. The id comes from ``id_column``, else from
    the message, else from a hash of the message and the columns in
    ``position`` (such as partition and offset), which tell equal messages
    apart; it is the same whenever the plan is evaluated.
    """
    wire = wire or WireNames()
    now = as_column(now_ms).cast("bigint")
    body = F.from_json(F.col(column), wire.request_schema())
    parsed = messages.withColumn("_body", body).withColumns(
        {
            "_level": F.coalesce(F.col("_body.obs_level"), F.lit("RAW_DATA")),
            "_operator": F.coalesce(F.col("_body.qoo.operator"), F.lit("NONE")),
            "_sla": F.coalesce(F.col("_body.qoo.sla_level"), F.lit("BEST_EFFORT")),
            "_wishes": F.coalesce(F.col("_body.qoo.interested_in"), F.array().cast("array<string>")),
        }
    )
    known = F.array(*[F.lit(a) for a in ATTRIBUTES])
    reason = (
        F.when(F.col("_body.application_id").isNull(), F.lit("no application_id"))
        .when(F.col("_body.topic").isNull(), F.lit("no topic"))
        .when(F.col("_body.location").isNull(), F.lit("no location"))
        .when(~F.col("_level").isin(*LEVELS), F.lit("unknown obs_level"))
        .when(~F.col("_operator").isin(*OPERATORS), F.lit("unknown operator"))
        .when(~F.col("_sla").isin(*SLA_LEVELS), F.lit("unknown sla_level"))
        .when(F.size(F.array_except("_wishes", known)) > 0, F.lit("unknown attribute"))
    )
    judged = parsed.withColumn("reason", reason)
    rejects = judged.where(F.col("reason").isNotNull()).select(*messages.columns, "reason")
    given = F.col(id_column).cast("string") if id_column else F.nullif(F.col("_body.request_id"), F.lit(""))
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (column, *position)]
    made = F.regexp_replace(F.md5(F.to_json(F.array(*parts))), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    state = F.struct(F.lit("CREATED").alias("status"), now.alias("start_date"), now.alias("end_date"))
    accepted = judged.where(F.col("reason").isNull()).select(
        (given if id_column else F.coalesce(given, made)).alias("request_id"),
        F.col("_body.application_id").alias("application_id"),
        F.col("_body.topic").alias("topic"),
        F.col("_body.location").alias("location"),
        F.col("_level").alias("obs_level"),
        F.col("_wishes").alias("interested_in"),
        F.col("_operator").alias("operator"),
        F.col("_sla").alias("sla_level"),
        F.coalesce(F.col("_body.qoo")[wire.params_field], _empty_map()).alias("params"),
        F.coalesce(F.col("_body.qoo.custom_params"), _empty_map()).alias("custom_params"),
        F.array(state).alias("states"),
        prepend_log(F.array().cast("array<string>"), "Request received.", now).alias("logs"),
    )
    return accepted, rejects


def request_document(wire: WireNames | None = None) -> Column:
    """Stored JSON form of a row of the request table."""
    wire = wire or WireNames()
    quality = F.struct(
        "interested_in",
        "operator",
        "sla_level",
        F.col("params").alias(wire.params_field),
        "custom_params",
    )
    return F.to_json(
        F.struct(
            "request_id",
            "application_id",
            "topic",
            "location",
            "obs_level",
            quality.alias("qoo"),
            F.col("states").alias("statesList"),
            "logs",
        )
    )


_MAPPING = (
    "request_id string, application_id string, constructed_from string, dependent_requests array<string>, "
    "all_topics map<string, struct<name:string, level:int, observation_level:string, source:string, sink:string, "
    "for_heal:boolean, parents:array<string>, children:array<string>, enforced:map<string,string>>>"
)


def parse_mappings(documents: DataFrame, column: str = "document") -> DataFrame:
    """Topology documents to an edge table, one row per (parent, child)."""
    body = documents.select(F.from_json(F.col(column), _MAPPING).alias("_m")).select("_m.*")
    return flatten_mappings(body)


def read_mappings(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    return flatten_mappings(spark.read.schema(_MAPPING).format(fmt).load(path))


def flatten_mappings(mappings: DataFrame) -> DataFrame:
    topics = mappings.select(
        "request_id",
        "application_id",
        "constructed_from",
        F.col("all_topics").alias("_all"),
        F.explode(F.map_values("all_topics")).alias("_t"),
    )
    edges = topics.select("*", F.explode(F.col("_t.children")).alias("child"))
    below = F.try_element_at("_all", F.col("child"))
    return edges.select(
        "request_id",
        "application_id",
        "constructed_from",
        F.col("_t.name").alias("parent"),
        "child",
        F.try_element_at(F.col("_t.enforced"), F.col("child")).alias("stage"),
        below["level"].alias("level"),
        F.col("_t.source").isNotNull().alias("is_source"),
        F.coalesce(below["for_heal"], F.lit(False)).alias("is_heal"),
        below["sink"].isNotNull().alias("is_sink"),
    )


def mapping_documents(edges: DataFrame, dependents: DataFrame | None = None) -> DataFrame:
    """Edge table to one JSON document per request (request_id, document).

    ``dependents``: request_id, dependent_requests (ARRAY), if documents shall list them.
    """
    as_parent = edges.select(
        "request_id", "application_id", F.col("parent").alias("name"), F.col("level").alias("child_level"),
        "is_source", F.lit(False).alias("is_heal"), F.lit(False).alias("is_sink"),
        F.lit(None).cast("int").alias("own_level"), F.lit(None).cast("string").alias("up"),
        F.col("child").alias("down"), "stage",
    )
    as_child = edges.select(
        "request_id", "application_id", F.col("child").alias("name"), F.lit(None).cast("int").alias("child_level"),
        F.lit(False).alias("is_source"), "is_heal", "is_sink",
        F.col("level").cast("int").alias("own_level"), F.col("parent").alias("up"),
        F.lit(None).cast("string").alias("down"), F.lit(None).cast("string").alias("stage"),
    )
    topics = (
        as_parent.unionByName(as_child)
        .groupBy("request_id", "application_id", "name")
        .agg(
            F.coalesce(F.max("own_level"), F.lit(0)).alias("level"),
            F.max("is_source").alias("_source"),
            F.max("is_sink").alias("_sink"),
            F.max("is_heal").alias("for_heal"),
            F.array_sort(F.collect_set("up")).alias("parents"),
            F.array_sort(F.collect_set("down")).alias("children"),
            F.map_from_entries(
                F.array_sort(F.collect_set(F.when(F.col("down").isNotNull(), F.struct("down", "stage"))))
            ).alias("enforced"),
        )
    )
    entry = F.struct(
        "name",
        "level",
        F.when(F.col("_source"), F.col("name")).alias("source"),
        F.when(F.col("_sink"), F.col("application_id")).alias("sink"),
        "for_heal",
        "parents",
        "children",
        "enforced",
    )
    grouped = topics.groupBy("request_id", "application_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("name"), entry.alias("entry"))), _by_name)).alias(
            "all_topics"
        )
    )
    if dependents is not None:
        grouped = grouped.join(dependents, "request_id", "left")
    else:
        grouped = grouped.withColumn("dependent_requests", F.lit(None).cast("array<string>"))
    empty = F.array().cast("array<string>")
    body = F.struct(
        "request_id",
        "application_id",
        F.coalesce("dependent_requests", empty).alias("dependent_requests"),
        "all_topics",
    )
    return grouped.select("request_id", F.to_json(body).alias("document"))


def _by_name(a: Column, b: Column) -> Column:
    return F.when(a["name"] < b["name"], -1).when(a["name"] > b["name"], 1).otherwise(0)
