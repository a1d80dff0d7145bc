"""All requests at once on a live stream, with a request table that changes meanwhile.

Two queries run behind each other, with a shared folder between them:

* the first routes observations. For each micro-batch it reads the request table as
  it is then, joins the observations with the chains that select them and writes the
  routed rows, once per batch. A chain is a selection and the batch from which on it
  has run without a break; requests with equal selections share it, and one that
  joins later finds its limit as it stands;
* the second limits the rate of each chain in event time, with the number and period
  that the rows carry, then scores and filters by age with the capabilities as they
  are, and hands over each micro-batch.

When the last request of a chain is gone, a row that says so follows the chain's last
observation, and the chain's state is dropped behind it. A chain that comes back is a
new one. Rows later than ``delay`` are dropped by limited chains only; the others
keep no state and pass them on.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tidegauge.functions.params import age_ms, rate
from tidegauge.operators.enrich import default_attributes, score, with_capability
from tidegauge.operators.filters import filter_age, filter_threshold
from tidegauge.operators.requests import sharing_key
from tidegauge.plans.chain import SELECTION, selected, selection_chains
from tidegauge.schema import Compat
from tidegauge.streaming.batches import Folder, write_once
from tidegauge.streaming.ordered import ordered_stream

Read = Callable[[], DataFrame]
Write = Callable[[DataFrame, int], None]


@dataclass(frozen=True)
class Enforcement:
    """Where a running enforcement keeps what its two queries share: ``chains``, ``seen``, ``members`` and ``routed`` by batch."""

    spark: SparkSession
    path: str
    delay: str = "10 minutes"
    compat: Compat = Compat()

    def _table(self, kind: str, batch: int) -> DataFrame | None:
        folder = Folder(self.spark, f"{self.path}/{kind}")
        return self.spark.read.parquet(folder.at(f"batch={batch}")) if folder.has(f"batch={batch}") else None

    def _write(self, frame: DataFrame, kind: str, batch: int) -> DataFrame:
        write_once(frame, f"{self.path}/{kind}", f"batch={batch}")
        return self._table(kind, batch)

    def _plan(self, requests: DataFrame, batch: int) -> DataFrame:
        """Chains of a batch: spec, since, last_ms (latest observation so far), ended, and what they select."""
        now = selection_chains(requests).drop("chain_id").withColumn("spec", F.sha2("spec", 256))
        before, seen = self._table("chains", batch - 1), self._table("seen", batch - 1)
        if before is None:
            plan = now.select("*", F.lit(batch).cast("long").alias("since"), F.lit(None).cast("long").alias("last_ms"), F.lit(False).alias("ended"))
            return self._write(plan, "chains", batch)
        running = before.where("not ended").join(seen, ["spec", "since"], "left")
        running = running.withColumn("last_ms", F.greatest("last_ms", "seen_ms")).drop("seen_ms", "ended")
        kept = now.join(running.select("spec", "since", "last_ms"), "spec", "left")
        kept = kept.withColumn("since", F.coalesce("since", F.lit(batch).cast("long"))).withColumn("ended", F.lit(False))
        gone = running.join(now, "spec", "left_anti").withColumn("ended", F.lit(True))
        return self._write(kept.unionByName(gone), "chains", batch)

    def _members(self, requests: DataFrame, batch: int) -> None:
        """request_id, spec and the batch from which on the request has asked for that."""
        spec = F.sha2(sharing_key(SELECTION), 256).alias("spec")
        now = requests.select("request_id", spec).distinct()
        before = self._table("members", batch - 1)
        if before is None:
            now = now.withColumn("member_since", F.lit(batch).cast("long"))
        else:
            now = now.join(before, ["request_id", "spec"], "left")
            now = now.withColumn("member_since", F.coalesce("member_since", F.lit(batch).cast("long")))
        self._write(now, "members", batch)

    def members(self) -> DataFrame:
        """request_id, spec, member_since as of the last routed batch."""
        names = [n for n in Folder(self.spark, f"{self.path}/members").names() if n.startswith("batch=")]
        return self._table("members", max(int(n.removeprefix("batch=")) for n in names))

    def route(self, obs: DataFrame, read_requests: Read, read_sensors: Read, checkpoint: str, **trigger) -> StreamingQuery:
        """Start the first query. A batch that is handed over again uses the chains that it was planned with."""

        def one_batch(batch: DataFrame, number: int) -> None:
            requests = read_requests()
            plan = self._table("chains", number)
            plan = self._plan(requests, number) if plan is None else plan
            self._members(requests, number)
            limit = rate(F.col("obsrate_max"))
            chains = plan.where("not ended").select(
                F.col("topic").alias("_sel_topic"),
                F.col("area").alias("_sel_area"),
                "spec",
                "since",
                F.col("threshold_min").alias("_low"),
                F.col("threshold_max").alias("_high"),
                age_ms(F.col("age_max")).alias("age_ms"),
                limit["n"].cast("long").alias("limit_n"),
                limit["period_ms"].cast("long").alias("limit_ms"),
            )
            rows = filter_threshold(selected(batch, chains, read_sensors(), self.compat), F.col("_low"), F.col("_high"), self.compat)
            rows = rows.drop("_low", "_high").withColumns({"ends": F.lit(False), "batch": F.lit(number).cast("long")})
            ends = plan.where("ended and last_ms is not null").select("spec", "since", F.timestamp_millis("last_ms").alias("date"))
            # time also passes for chains that no observation of this batch belongs to
            passed = batch.agg(F.max("date").alias("date")).where("date is not null")
            passed = passed.select(F.lit("").alias("spec"), F.lit(-1).cast("long").alias("since"), "date")
            marks = ends.unionByName(passed).withColumns({"ends": F.lit(True), "batch": F.lit(number).cast("long")})
            rows = rows.unionByName(marks, allowMissingColumns=True).select(*self.routed_schema(batch.schema).names)
            write_once(rows, f"{self.path}/routed", f"batch={number}")
            if self._table("seen", number) is None:
                own = self.spark.read.schema(rows.schema).parquet(f"{self.path}/routed/batch={number}").where("not ends")
                self._write(own.groupBy("spec", "since").agg(F.unix_millis(F.max("date")).alias("seen_ms")), "seen", number)
            for kind in ("chains", "seen", "members"):
                Folder(self.spark, f"{self.path}/{kind}").remove(f"batch={number - 3}")

        writer = obs.writeStream.foreachBatch(one_batch).option("checkpointLocation", checkpoint)
        return writer.trigger(**(trigger or {"availableNow": True})).start()

    def routed_schema(self, obs: T.StructType) -> T.StructType:
        extra = "spec string, since long, age_ms long, limit_n long, limit_ms long, ends boolean, batch long"
        return T.StructType([*obs.fields, *T._parse_datatype_string(extra).fields])

    def limited(self, obs_schema: T.StructType, tie: tuple[str, ...] = ("obs_id",)) -> DataFrame:
        """Routed observations after the limits of their chains, as a stream."""
        schema = self.routed_schema(obs_schema)
        routed = self.spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{self.path}/routed")
        held = routed.where("limit_n is not null or ends")
        kept = ordered_stream(held, _limit_by_row, schema, keys=["spec", "since"], tie=["ends", *tie], delay=self.delay)
        return kept.unionByName(routed.where("limit_n is null and not ends"))

    def deliver(
        self,
        obs_schema: T.StructType,
        read_capabilities: Read,
        write: Write,
        checkpoint: str,
        as_of_ms: int | Column,
        *,
        tie: tuple[str, ...] = ("obs_id",),
        **trigger,
    ) -> StreamingQuery:
        """Start the second query; ``write(frame, batch_id)`` gets spec, since, batch, the observation and both scores."""

        def one_batch(batch: DataFrame, number: int) -> None:
            attributes = default_attributes(as_of_ms, compat=self.compat)
            able = with_capability(batch, read_capabilities(), compat=self.compat)
            scored = score(able, ["OBS_ACCURACY", "OBS_FRESHNESS"], attributes)
            fresh = filter_age(scored, F.col("age_ms"), as_of_ms)
            write(fresh.select("spec", "since", "batch", *obs_schema.names, "obs_accuracy", "obs_freshness"), number)

        writer = self.limited(obs_schema, tie).writeStream.foreachBatch(one_batch).option("checkpointLocation", checkpoint)
        return writer.trigger(**(trigger or {"availableNow": True})).start()

    def to_requests(self, rows: DataFrame) -> DataFrame:
        """Delivered chain rows for each request that asked for them when they were routed and still does."""
        return rows.join(self.members(), "spec").where("batch >= member_since").drop("member_since")


def _limit_by_row(memory: dict | None, rows: pd.DataFrame, known: int):
    """The first ``limit_n`` rows of each window of ``limit_ms``, which begins with a row; a row that ends its chain leaves no memory."""
    start, count = (memory["start"], memory["count"]) if memory else (None, 0)
    period, ended = memory["period"] if memory else 0, bool(memory and memory["ended"])
    kept = []
    for i, (at, n, length, ends) in enumerate(zip(rows["_ts"].tolist(), rows["limit_n"].tolist(), rows["limit_ms"].tolist(), rows["ends"].tolist())):
        if ends:
            ended = True
            continue
        if start is None or at >= start + period:
            start, count, period = at, 0, int(length)
        if count < n:
            kept.append(i)
            count += 1
    out = rows.iloc[kept]
    if ended or start is None or known >= start + period:
        return None, out, None  # whatever comes opens a new window
    return {"start": start, "count": count, "period": period, "ended": ended}, out, start + period
