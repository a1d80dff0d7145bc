"""Starting streaming queries: delivery, three outlets, live sensor context."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from tidegauge.operators.enrich import with_sensor_context


def checkpoint_root(spark: SparkSession, fallback: str | None = None) -> str:
    """Shared folder for checkpoints: the one the cluster names, else the caller's.

    A fallback is for sessions without the setting, such as tests.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    if fallback is None:
        raise ValueError("spark.checkpoint.dir is not set and no folder was given")
    return fallback


def late_rows(query: StreamingQuery) -> int:
    """How many rows of the query's known progress came after the watermark and were dropped by its steps."""
    return sum(state.get("numRowsDroppedByWatermark", 0) for p in query.recentProgress for state in p["stateOperators"])


def start_outlets(
    frames: Mapping[str, DataFrame],
    path: str,
    checkpoints: str,
    fmt: str = "parquet",
    **trigger,
) -> dict[str, StreamingQuery]:
    """One query per outlet of a tee; each reads the source on its own and keeps its own state."""
    started = {}
    for name, frame in frames.items():
        writer = frame.writeStream.format(fmt).option("path", str(PurePosixPath(path) / name))
        writer = writer.option("checkpointLocation", str(PurePosixPath(checkpoints) / name))
        started[name] = writer.queryName(name).trigger(**(trigger or {"availableNow": True})).start()
    return started


def with_live_context(
    obs: DataFrame,
    read_sensors: Callable[[], DataFrame],
    write: Callable[[DataFrame, int], None],
    checkpoint: str,
    **trigger,
) -> StreamingQuery:
    """Enrich each micro-batch with the sensor table as it is then.

    ``read_sensors`` is called once per micro-batch, so an updated registry
    counts from the next one on. ``write(frame, batch_id)`` must be idempotent
    per batch id.
    """

    def one_batch(batch: DataFrame, batch_id: int) -> None:
        write(with_sensor_context(batch, read_sensors()), batch_id)

    writer = obs.writeStream.foreachBatch(one_batch).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def with_live_parameters(
    obs: DataFrame,
    read_settings: Callable[[], Mapping[str, str]],
    build: Callable[[DataFrame, Mapping[str, str]], DataFrame],
    write: Callable[[DataFrame, int], None],
    checkpoint: str,
    **trigger,
) -> StreamingQuery:
    """Run a stateless stage whose parameters are read anew for each micro-batch."""

    def one_batch(batch: DataFrame, batch_id: int) -> None:
        write(build(batch, read_settings()), batch_id)

    writer = obs.writeStream.foreachBatch(one_batch).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


class ThroughputListener(StreamingQueryListener):
    """Collects rows and rates of every micro-batch, for throughput reports."""

    def __init__(self) -> None:
        self.rows: list[tuple[str, int, int, float]] = []

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.rows.append((str(p.id), p.batchId, p.numInputRows, p.processedRowsPerSecond or 0.0))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def report(self, spark: SparkSession) -> DataFrame:
        schema = "query_id string, batch_id long, messages long, messages_per_s double"
        return spark.createDataFrame(self.rows, schema).where(F.col("messages") > 0)
