"""Reading, decoding and generating observation messages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge.functions.naming import pad_message
from tidegauge.schema import ALL, MESSAGE_TEXT, require_columns


def read_observations(
    spark: SparkSession,
    path: str | list[str] | None = None,
    *,
    topics: list[str] | None = None,
    fmt: str = "parquet",
    schema: T.StructType | str | None = None,
    streaming: bool = False,
    topic_column: str = "topic",
    **options,
) -> DataFrame:
    """Messages of a set of topics from files or, with ``fmt="kafka"``, a broker.

    Files carry the topic as a column (a directory partitioned by it prunes);
    the filter reaches the scan. All partitions of a topic are read. Kafka
    needs the connector on the class path and takes its options as given.
    ``fmt="topics"`` reads numbered messages of a shared folder, see
    :func:`tidegauge.streaming.topics.read_topics`, which takes the options.
    """
    if fmt == "topics":
        from tidegauge.streaming.topics import read_topics

        return read_topics(spark, path, topics, streaming=streaming, **options)
    reader = (spark.readStream if streaming else spark.read).options(**options)
    if fmt == "kafka":
        if topics:
            reader = reader.option("subscribe", ",".join(topics))
        raw = reader.format("kafka").load()
        return raw.select(
            "topic",
            F.col("value").cast("string").alias("message"),
            F.col("timestamp").alias("ingest_time"),
        )
    if schema is not None:
        reader = reader.schema(schema)
    frame = reader.format(fmt).load(path)
    if topics and ALL not in topics:
        frame = frame.where(F.col(topic_column).isin(*topics))
    return frame


def union_topics(frames: dict[str, DataFrame]) -> DataFrame:
    """One frame out of one frame per topic, each row tagged with its topic."""
    if not frames:
        raise ValueError("at least one topic is needed")
    tagged = [frame.withColumn("topic", F.lit(name)) for name, frame in frames.items()]
    return reduce(lambda a, b: a.unionByName(b), tagged)


def _parsed(messages: DataFrame, column: str) -> DataFrame:
    # json_tuple reads all four fields as text in one pass over the message;
    # from_json would be pruned to one field per use and parse once for each.
    names = MESSAGE_TEXT.names
    keep = [c for c in messages.columns if c not in names]
    texts = [f"_{n}" for n in names]
    fields = messages.select(*keep, F.json_tuple(F.col(column), *names).alias(*texts))
    return fields.select(
        *keep,
        F.timestamp_millis(F.col("_date").try_cast("bigint")).alias("date"),
        F.col("_value").try_cast("double").alias("value"),
        F.col("_producer").alias("producer"),
        F.col("_timestamps").alias("timestamps"),
    )


def _complete() -> Column:
    present = [F.col(n).isNotNull() for n in MESSAGE_TEXT.names]
    return reduce(lambda a, b: a & b, present)


def decode_observation(
    messages: DataFrame, column: str = "message", mode: str = "quarantine"
) -> DataFrame:
    """Message text to (date, value, producer, timestamps); other columns stay.

    Numbers may be quoted or bare and extra fields are ignored. A message that
    is not JSON, or lacks one of the four fields, is left out (``quarantine``;
    see :func:`rejected_observations`) or fails the job (``failfast``).
    """
    require_columns(messages, column)
    parsed = _parsed(messages, column)
    if mode == "quarantine":
        return parsed.where(_complete()).drop(column)
    if mode != "failfast":
        raise ValueError(f"unknown mode {mode!r}")
    failure = F.raise_error(F.concat(F.lit("malformed observation: "), F.col(column)))
    checked = parsed.withColumn(
        "producer", F.when(_complete(), F.col("producer")).otherwise(failure.cast("string"))
    )
    return checked.drop(column)


def rejected_observations(messages: DataFrame, column: str = "message") -> DataFrame:
    """The messages that :func:`decode_observation` leaves out, as they came."""
    kept = [F.col(c) for c in messages.columns if c not in MESSAGE_TEXT.names]
    return _parsed(messages, column).where(~_complete()).select(*kept)


# Fixed value: the constant load-test message, 107 bytes.
CONSTANT_MESSAGE = (
    '{"date": "1499850317000", "value": "1.309", "producer": "sensor01", '
    '"timestamps": "produced:1499850317000"}'
)


def synthetic_observations(
    ids: DataFrame,
    id_column: str = "id",
    *,
    sequential: bool = False,
    size: int = 192,
    random_size: bool = False,
    seed: int = 0,
    topic: str = "temperature",
    worker: int = 0,
    initial_id: int = 0,
) -> DataFrame:
    """One load-test message per id (``spark.range(n)`` or a rate stream).

    Without ``sequential`` every message is the same observation; with it, the
    id is padded into a text of ``size`` bytes, or of a size in 1..``size``
    drawn from the id and ``seed``.
    """
    if not sequential:
        return ids.withColumn("message", F.lit(CONSTANT_MESSAGE))
    text = pad_message(topic, worker, F.col(id_column) + F.lit(initial_id), size)
    if random_size:
        drawn = (F.pmod(F.xxhash64(F.col(id_column), F.lit(seed)), F.lit(size)) + 1).cast("int")
        bare = F.regexp_replace(text, "x+$", "")
        text = F.rpad(bare, F.greatest(drawn, F.length(bare)), F.lit("x"))
    return ids.withColumn("message", text)
