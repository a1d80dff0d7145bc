"""Names built from requests, stages and IRIs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidegauge.functions.clock import as_column
from tidegauge.schema import LEVEL_ABBREVIATIONS


def local_name(iri: Column) -> Column:
    """Text after ``#``; empty if there is none."""
    return F.split_part(iri, F.lit("#"), F.lit(2))


def level_abbrev(level: Column) -> Column:
    """Short form of a level; unknown levels read as raw data."""
    expr = F.lit(LEVEL_ABBREVIATIONS["RAW_DATA"])
    for name in ("INFORMATION", "KNOWLEDGE"):
        expr = F.when(level == name, F.lit(LEVEL_ABBREVIATIONS[name])).otherwise(expr)
    return expr


def selection_topic(topic: Column, location: Column, level: Column) -> Column:
    """Topic behind the ingest stage, shared by every request with these three."""
    return F.concat_ws("_", topic, location, level_abbrev(level))


def quality_topic(application: Column, request: Column, position: int | Column) -> Column:
    """Topic behind the k-th quality stage of a request."""
    return F.concat(
        application, F.lit("_"), request, F.lit("_QOO"), as_column(position).cast("string")
    )


def delivery_topic(application: Column, request: Column) -> Column:
    return F.concat_ws("_", application, request)


def remedy_topic(application: Column, request: Column, remedy: Column) -> Column:
    return F.concat_ws("_", application, request, remedy)


def unique_stage_id(stage: str | Column, instance: Column) -> Column:
    return F.concat_ws("_", as_column(stage), instance)


def split_stage_id(stage_id: Column) -> Column:
    """STRUCT<stage, instance> of a stage id."""
    return F.struct(
        F.split_part(stage_id, F.lit("_"), F.lit(1)).alias("stage"),
        F.split_part(stage_id, F.lit("_"), F.lit(2)).alias("instance"),
    )


def date_text(date: Column, zone: str = "UTC") -> Column:
    """Timestamp text of the linked-data form, for TIMESTAMP input in UTC session."""
    shifted = F.convert_timezone(F.lit("UTC"), F.lit(zone), date.cast("timestamp_ntz"))
    return F.concat(
        F.date_format(shifted, "yyyy-MM-dd HH:mm:ss."), _millis_text(shifted)
    )


def _millis_text(ts: Column) -> Column:
    # A trailing zero of the fraction is not printed, but one digit always is.
    digits = F.regexp_replace(F.date_format(ts, "SSS"), "0+$", "")
    return F.when(digits == "", F.lit("0")).otherwise(digits)


def pad_message(
    topic: str | Column, worker: int | Column, sequence: Column, size: int, digits: int = 10
) -> Column:
    """Load-test text with a zero-padded id, filled with ``x`` up to ``size`` bytes."""
    head = F.concat(
        F.lit("Topic:"), as_column(topic),
        F.lit(":ThreadID:"), as_column(worker).cast("string"),
        F.lit(":MessageID:"), F.lpad(sequence.cast("string"), digits, "0"),
        F.lit(":"),
    )
    return F.rpad(head, F.greatest(F.lit(size), F.length(head)), F.lit("x"))
