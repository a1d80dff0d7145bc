"""The control loop as running streams: deliver, report, compare, buffer, decide, rewrite, deliver otherwise.

Two queries share a folder:

* the first delivers. For each micro-batch it reads which requests are healed at that
  moment and with what, passes the rows of their stage through the remedy, and writes
  what goes out, once per batch;
* the second reads that and is one query of four stateful steps under one watermark:
  rate reports by stage, windows of requests with too few observations, the buffer of
  symptoms, and decisions. Each batch of decisions is recorded, and makes the next
  version of the topology and of the table that the first query reads.

A delivered row carries the version of that table which it was routed by. Reports keep
the versions apart, and a request counts those of a stage only in the versions in which
it used the stage. So the counts do not depend on when a report is made, although
requests move from stage to stage meanwhile. The second query reads the versions when
it starts; whoever runs the loop starts it anew between batches (:meth:`Loop.turn`),
and its checkpoint lets it go on where it was.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tidegauge.functions.naming import remedy_topic
from tidegauge.operators.lifecycle import insert_heal_stage, remove_heal_stage
from tidegauge.streaming.batches import Folder, Snapshots, write_once
from tidegauge.streaming.mechanisms import (
    stream_heal_decisions,
    stream_min_rate_violations,
    stream_rate_reports,
    stream_symptom_buffer,
)

# A remedy takes rows and the value of its parameter and gives the rows that go out instead.
Remedy = Callable[[DataFrame, Column], DataFrame]

#: Who uses which stage, in which versions: ``until_version`` is null while that lasts.
USE = ("request_id", "application_id", "base_stage", "stage_id", "remedy", "value", "from_version", "until_version")


def clone_remedy(rows: DataFrame, value: Column) -> DataFrame:
    """Every row ``value`` times, numbered by ``copy``."""
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.greatest(value.cast("int"), F.lit(1)))))


def next_uses(uses: DataFrame, decisions: DataFrame, version: int) -> DataFrame:
    """``uses`` as of ``version``: the last decision on a request ends its use, and begins another unless it is removed.

    HEAL leads to the request's own stage behind its base stage, ENFORCED back to
    the base stage.
    """
    last = decisions.groupBy("request_id").agg(F.max(F.struct("decided_ms", "status", "remedy", "value")).alias("_last"))
    marked = uses.join(last, "request_id", "left")
    ends = F.col("until_version").isNull() & F.col("_last").isNotNull()
    closed = marked.withColumn("until_version", F.when(ends, F.lit(version).cast("long")).otherwise(F.col("until_version")))
    healed = F.col("_last.status") == "HEALED"
    stage = F.when(healed, remedy_topic(F.col("application_id"), F.col("request_id"), F.col("_last.remedy")))
    opened = marked.where(ends & (F.col("_last.status") != "REMOVED")).select(
        "request_id",
        "application_id",
        "base_stage",
        F.coalesce(stage, F.col("base_stage")).alias("stage_id"),
        F.when(healed, F.col("_last.remedy")).alias("remedy"),
        F.when(healed, F.col("_last.value")).alias("value"),
        F.lit(version).cast("long").alias("from_version"),
        F.lit(None).cast("long").alias("until_version"),
    )
    return closed.select(*USE).unionByName(opened)


def next_edges(edges: DataFrame, decisions: DataFrame) -> DataFrame:
    """Topology after the last decision on each request: one remedy stage where it is healed, none where it is given up."""
    last = decisions.groupBy("request_id").agg(F.max(F.struct("decided_ms", "status", "remedy")).alias("_last"))
    last = last.select("request_id", "_last.*")
    plain = remove_heal_stage(edges, last)
    left = plain.join(last.where("status = 'REMOVED'"), "request_id", "left_anti")
    return insert_heal_stage(left, last.where("status = 'HEALED'").select("request_id", "remedy"))


def reports_of_versions(reports: DataFrame, uses: DataFrame, demands: DataFrame) -> DataFrame:
    """Reports (stage_id, version, n, times) for each request that used the stage in that version, with its demand."""
    spans = uses.select("stage_id", "request_id", "from_version", "until_version")
    routed = reports.join(spans, "stage_id")
    inside = (F.col("version") >= F.col("from_version")) & (F.col("until_version").isNull() | (F.col("version") < F.col("until_version")))
    wanted = demands.select("request_id", "min_per_s", "start_ms", "until_ms")
    return routed.where(inside).drop("stage_id", "version", "from_version", "until_version").join(wanted, "request_id")


@dataclass(frozen=True)
class Loop:
    """A running control loop.

    ``demands``: request_id, application_id, stage_id (that serves the request),
    sla_level, min_per_s, start_ms, until_ms. ``remedy``: one for all requests or a
    batch frame, as in :func:`stream_heal_decisions`. ``remedies`` says what each does
    to rows. Under ``path``: ``delivered`` and ``decisions`` by batch, and the versioned
    tables ``uses`` and ``edges``.
    """

    spark: SparkSession
    path: str
    demands: DataFrame
    remedy: DataFrame | Mapping | None
    remedies: Mapping[str, Remedy]
    report_ms: int = 1000
    step_ms: int = 10_000
    events_before_symptom: int = 2
    symptoms_before_action: int = 2
    lifetime_ms: int = 30_000
    observe_ms: int = 60_000
    max_retries: int = 5
    delay: str = "10 seconds"
    tie: tuple[str, ...] = ("obs_id", "copy")

    def _snapshots(self, name: str) -> Snapshots:
        return Snapshots(self.spark, f"{self.path}/{name}")

    def begin(self, edges: DataFrame) -> None:
        """Write the first versions, unless they are there already."""
        if self._snapshots("uses").read() is None:
            none, text = F.lit(None).cast("long"), F.lit(None).cast("string")
            first = self.demands.select(
                "request_id", "application_id", F.col("stage_id").alias("base_stage"), "stage_id",
                text.alias("remedy"), text.alias("value"), F.lit(0).cast("long").alias("from_version"), none.alias("until_version"),
            )
            self._snapshots("uses").write(first)
        if self._snapshots("edges").read() is None:
            self._snapshots("edges").write(edges)

    def uses(self) -> DataFrame:
        return self._snapshots("uses").read()

    def edges(self) -> DataFrame:
        return self._snapshots("edges").read()

    def decisions(self) -> DataFrame:
        """All decisions so far."""
        return self.spark.read.schema(f"{self._decided}, batch int").parquet(f"{self.path}/decisions")

    _decided = "request_id string, decided_ms long, attempt int, decision string, status string, remedy string, param string, value string"

    def delivered_schema(self, rows: T.StructType) -> T.StructType:
        return T.StructType([*rows.fields, T.StructField("copy", T.IntegerType()), T.StructField("version", T.LongType())])

    def deliver(self, rows: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        """Start the first query. ``rows``: stage_id, date and whatever else goes out, as a stream."""
        names = self.delivered_schema(rows.schema).names

        def one_batch(batch: DataFrame, number: int) -> None:
            if Folder(self.spark, f"{self.path}/delivered").has(f"batch={number}"):
                return  # handed over again; what it was routed by may have changed since
            table = self._snapshots("uses")
            version = F.lit(table.manifest()["version"]).cast("long")
            healed = table.read().where("until_version is null and remedy is not null")
            healed = healed.select(F.col("base_stage").alias("_base"), F.col("stage_id").alias("_own"), "remedy", F.col("value").alias("_value"))
            out = batch.withColumns({"copy": F.lit(0), "version": version}).select(*names)
            for name, apply in self.remedies.items():
                own = batch.join(healed.where(F.col("remedy") == name), F.col("stage_id") == F.col("_base"))
                changed = apply(own.withColumn("copy", F.lit(0)), F.col("_value"))
                changed = changed.withColumns({"stage_id": F.col("_own"), "copy": F.col("copy").cast("int"), "version": version})
                out = out.unionByName(changed.select(*names))
            write_once(out, f"{self.path}/delivered", f"batch={number}")

        writer = rows.writeStream.foreachBatch(one_batch).option("checkpointLocation", checkpoint)
        return writer.trigger(**(trigger or {"availableNow": True})).start()

    def watched(self, rows: T.StructType) -> DataFrame:
        """Decisions as a stream of what is delivered: four steps, one watermark."""
        schema = self.delivered_schema(rows)
        sent = self.spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{self.path}/delivered")
        reports = stream_rate_reports(
            sent, self.report_ms, keys=["stage_id"], producer="version", tie=self.tie, delay=self.delay, event_time="report_time"
        )
        counts = reports_of_versions(reports, self.uses(), self.demands)
        short = stream_min_rate_violations(
            counts, ts="report_time", step_ms=self.step_ms, events_before_symptom=self.events_before_symptom,
            demands=self.demands, delay=None, at="report_ms", event_time="symptom_time",
        )
        symptoms = short.join(self.demands.select("request_id", "stage_id", "sla_level"), "request_id")
        full = stream_symptom_buffer(
            symptoms, symptoms_before_action=self.symptoms_before_action, lifetime_ms=self.lifetime_ms,
            delay=None, at="symptom_ms", event_time="symptom_time",
        )
        return stream_heal_decisions(
            full, self.remedy, observe_ms=self.observe_ms, max_retries=self.max_retries, lifetime_ms=self.lifetime_ms,
            delay=None, at="symptom_ms",
        )

    def monitor(self, rows: T.StructType, checkpoint: str, **trigger) -> StreamingQuery:
        """Start the second query; ``rows`` is the schema of what :meth:`deliver` was given."""

        def one_batch(batch: DataFrame, number: int) -> None:
            write_once(batch, f"{self.path}/decisions", f"batch={number}")
            decided = self.spark.read.schema(self._decided).parquet(f"{self.path}/decisions/batch={number}")
            if decided.isEmpty():
                return
            edges, uses = self._snapshots("edges"), self._snapshots("uses")
            edges.write(next_edges(edges.read(), decided), number)
            known = uses.manifest()
            uses.write(next_uses(uses.read(), decided, known["version"] + 1), number)

        writer = self.watched(rows).writeStream.foreachBatch(one_batch).option("checkpointLocation", checkpoint)
        return writer.trigger(**(trigger or {"availableNow": True})).start()

    def turn(self, rows: DataFrame, checkpoints: str) -> None:
        """Deliver what has arrived, then watch it with the versions as they are now."""
        for query in (lambda: self.deliver(rows, f"{checkpoints}/deliver"), lambda: self.monitor(rows.schema, f"{checkpoints}/monitor")):
            query().awaitTermination()
