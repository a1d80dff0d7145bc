"""Keyed streaming steps that see rows in event-time order.

Rows of a key are held until the watermark has passed them, then handed over
sorted, with a small memory that the step carries along. The result does not
depend on arrival order within the watermark delay and equals the batch form.
"""

from __future__ import annotations

import json
import pickle
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidegauge.operators.segments import key_text

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

# A step takes its memory (None at first), the key's next rows in order and the
# time up to which everything is known; it returns the new memory, the rows to
# emit, and the time at which it wants to be called again even without rows.
Step = Callable[[dict | None, pd.DataFrame, int], tuple[dict | None, pd.DataFrame | None, int | None]]


class OrderedProcessor(StatefulProcessor):
    """Holds rows of a key until the watermark passes them, then runs the step.

    Held rows lie in buckets of ``bucket_ms`` by their time; a timer reads only the
    buckets that the watermark has reached, whatever else the key holds.
    """

    def __init__(
        self,
        step: Step,
        schema: T.StructType,
        order: Sequence[str],
        output: Sequence[str],
        bucket_ms: int = 60_000,
        event_time: tuple[str, str] | None = None,
    ):
        self.step = step
        self.event_time = event_time
        self.schema = schema
        self.order = list(order)
        self.output = list(output)
        self.bucket_ms = max(1, bucket_ms)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getMapState("held", "bucket long", "rows binary")
        self.memory = handle.getValueState("memory", "text string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frames = [
            # Spark renames columns that start with an underscore; positions hold.
            frame.set_axis([*self.schema.names, "_key"], axis=1)[self.schema.names]
            for frame in rows
            if len(frame)
        ]
        if frames:
            new = pd.concat(frames, ignore_index=True)
            self._hold(new)
            # One millisecond later: rows at the watermark itself may still come.
            self.handle.registerTimer(int(new["_ts"].min()) + 1)
        return iter([])

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        """Rows that are there before the stream begins are held like others, and wake their key without any input."""
        rows = initialState.set_axis([*self.schema.names, "_key"], axis=1)[self.schema.names]
        if len(rows):
            self._hold(rows)
            self.handle.registerTimer(int(rows["_ts"].min()) + 1)

    def _hold(self, new: pd.DataFrame) -> None:
        for bucket, rows in new.groupby(new["_ts"] // self.bucket_ms):
            place = (int(bucket),)
            old = pickle.loads(self.held.getValue(place)[0]) if self.held.containsKey(place) else []
            self.held.updateValue(place, (pickle.dumps(old + plain_rows(rows)),))

    def _due(self, known: int) -> tuple[pd.DataFrame, int | None]:
        """Rows before the known time, in order, taken out of the state; and the time of the first that stays."""
        buckets = sorted(int(k[0]) for k in self.held.keys())
        ready, first = [], None
        for bucket in buckets:
            if bucket * self.bucket_ms >= known:
                first = bucket * self.bucket_ms if first is None else first
                break
            own = pickle.loads(self.held.getValue((bucket,))[0])
            at = self.schema.names.index("_ts")
            stays = [r for r in own if r[at] >= known]
            ready += [r for r in own if r[at] < known]
            if not stays:
                self.held.removeKey((bucket,))
            else:
                first = min(r[at] for r in stays)
                if len(stays) < len(own):
                    self.held.updateValue((bucket,), (pickle.dumps(stays),))
                break
        frame = pd.DataFrame(ready, columns=self.schema.names)
        return frame.sort_values(self.order, kind="stable").reset_index(drop=True), first

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        known = int(timerValues.getCurrentWatermarkInMs())
        ready, first = self._due(known)
        stored = self.memory.get() if self.memory.exists() else None
        memory = json.loads(stored[0]) if stored else None
        memory, out, wake = self.step(memory, ready, known)
        if memory is None:
            self.memory.clear()
        else:
            self.memory.update((json.dumps(memory),))
        if first is not None:
            self.handle.registerTimer(max(first, known) + 1)
        if wake is not None:
            self.handle.registerTimer(wake + 1)
        if out is not None and len(out):
            if self.event_time is not None:
                name, source = self.event_time
                # a millisecond later, since rows at the watermark itself are emitted with the next one
                out = out.assign(**{name: pd.to_datetime(out[source].astype("int64") + 1, unit="ms", utc=True)})
            yield out[self.output]

    def close(self) -> None:
        pass


def delay_ms(delay: str) -> int:
    """Milliseconds of a watermark delay such as ``10 minutes``."""
    units = {"millisecond": 1, "second": 1000, "minute": 60_000, "hour": 3_600_000, "day": 86_400_000, "week": 604_800_000}
    words = delay.lower().removeprefix("interval ").split()
    return sum(int(n) * units[u.rstrip("s")] for n, u in zip(words[::2], words[1::2]))


def plain_rows(frame: pd.DataFrame) -> list[list]:
    """Rows as Python values that the state encoder accepts."""
    columns = []
    for name in frame.columns:
        values = frame[name]
        if pd.api.types.is_datetime64_any_dtype(values):
            columns.append([None if pd.isna(v) else v.to_pydatetime() for v in values])
        else:
            columns.append([None if v is None or v is pd.NA else v for v in values.astype(object).tolist()])
    return [list(r) for r in zip(*columns)]


def ordered_stream(
    df: DataFrame,
    step: Step,
    output: T.StructType | str,
    *,
    ts: str = "date",
    keys: Sequence[str] = (),
    tie: Sequence[str] = (),
    delay: str | None = "10 minutes",
    initial: DataFrame | None = None,
    at: str | None = None,
    event_time: tuple[str, str] | None = None,
) -> DataFrame:
    """Run a step per key on a stream; rows later than ``delay`` are dropped by the watermark.

    Steps can follow each other in one query, under the watermark of its source. A
    step that has a follower names ``event_time``: a timestamp column that it adds,
    and the column of milliseconds that it is made of. The follower takes that as
    ``ts``, the milliseconds as ``at``, and None as ``delay``, which leaves the watermark as it is.

    ``initial``: rows of the same columns, of a batch frame, that the keys know of
    before the stream begins; a new query takes them in once. The state store must be
    RocksDB (:func:`use_rocksdb`). A stream without keys runs in one task, as its
    order is global.
    """

    def with_key(rows: DataFrame) -> DataFrame:
        time = F.unix_millis(ts) if at is None else F.col(at).cast("long")
        return rows.withColumn("_ts", time).withColumn("_key", key_text(df, keys))

    keyed = with_key(df if delay is None else df.withWatermark(ts, delay))
    schema = T.StructType([f for f in keyed.schema.fields if f.name not in ("_key",)])
    target = output if isinstance(output, T.StructType) else T._parse_datatype_string(output)
    if event_time is not None:
        target = T.StructType([*target.fields, T.StructField(event_time[0], T.TimestampType())])
    # some buckets within the delay, so that few rows of other times are touched with those that are due
    bucket = 60_000 if delay is None else max(1000, delay_ms(delay) // 32)
    processor = OrderedProcessor(step, schema, ["_ts", *tie], target.names, bucket, event_time)
    return keyed.groupBy("_key").transformWithStateInPandas(
        statefulProcessor=processor,
        outputStructType=target,
        outputMode="Append",
        timeMode="EventTime",
        initialState=None if initial is None else with_key(initial.select(*df.columns)).groupBy("_key"),
        eventTimeColumnName="" if event_time is None else event_time[0],
    )


def use_rocksdb(spark) -> None:
    """The state store that keyed list state and timers need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
