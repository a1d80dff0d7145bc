"""Streaming forms of the rate, repeat, monitor and heal operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidegauge.operators.rates import clone_values, rate_limit, rate_reports, repeat_last, sample_reports
from tidegauge.operators.segments import key_text
from tidegauge.plans.stages import Mechanism
from tidegauge.streaming.ordered import delay_ms, ordered_stream, plain_rows


def _limit_step(n: int, period_ms: int, aligned: bool):
    def step(memory, rows, known):
        start, count = (memory["start"], memory["count"]) if memory else (None, 0)
        kept = []
        for i, at in enumerate(rows["_ts"].tolist()):
            if start is None or at >= start + period_ms:
                start, count = at - at % period_ms if aligned else at, 0
            if count < n:
                kept.append(i)
                count += 1
        if start is None or known >= start + period_ms:
            return None, rows.iloc[kept], None  # whatever comes opens a new window
        return {"start": start, "count": count}, rows.iloc[kept], start + period_ms

    return step


def stream_rate_limit(
    df: DataFrame,
    n: int,
    period_ms: int,
    *,
    ts: str = "date",
    keys: Sequence[str] = (),
    tie: Sequence[str] = ("obs_id",),
    anchor: str = "first",
    delay: str = "10 minutes",
) -> DataFrame:
    """Streaming form of ``rate_limit``."""
    if n <= 0:
        return df.where(F.lit(False))
    if anchor not in ("first", "epoch"):
        raise ValueError(f"unsupported anchor {anchor!r}")
    step = _limit_step(n, period_ms, anchor == "epoch")
    return ordered_stream(df, step, df.schema, ts=ts, keys=keys, tie=tie, delay=delay)


def stream_sample_reports(df: DataFrame, period_ms: int = 1000, **options) -> DataFrame:
    """Streaming form of ``sample_reports``: the rows that open a window."""
    return stream_rate_limit(df, 1, period_ms, **options)


def _report_step(period_ms: int, keys: Sequence[str], producer: str):
    def step(memory, rows, known):
        # pairs, since a JSON object would turn producers that are numbers into texts
        last, counts = (memory["last"], dict(memory["counts"])) if memory else (None, {})
        out = []
        names = rows[producer].tolist()
        for i, (at, name) in enumerate(zip(rows["_ts"].tolist(), names)):
            counts[name] = counts.get(name, 0) + 1
            if last is None or at - last >= period_ms:
                group = [rows[k].iloc[i] for k in keys]
                out += [(*group, at, p, c) for p, c in counts.items()]
                last, counts = at, {}
        frame = pd.DataFrame(out, columns=[*keys, "report_ms", producer, "n"])
        return {"last": last, "counts": list(counts.items())}, frame, None

    return step


def stream_rate_reports(
    df: DataFrame,
    period_ms: int,
    *,
    ts: str = "date",
    keys: Sequence[str] = (),
    producer: str = "producer",
    tie: Sequence[str] = ("obs_id",),
    delay: str | None = "10 minutes",
    event_time: str | None = None,
) -> DataFrame:
    """Streaming form of ``rate_reports``; ``event_time`` adds a column of that name for a step that follows."""
    fields = [df.schema[k] for k in keys]
    output = T.StructType(
        [
            *fields,
            T.StructField("report_ms", T.LongType()),
            df.schema[producer],
            T.StructField("n", T.LongType()),
        ]
    )
    step = _report_step(period_ms, list(keys), producer)
    following = (event_time, "report_ms") if event_time else None
    return ordered_stream(df, step, output, ts=ts, keys=keys, tie=tie, delay=delay, event_time=following)


def _repeat_step(window_ms: int, columns: Sequence[str], times: Sequence[str]):
    def packed(row: dict) -> dict:
        return {c: row[c].isoformat() if c in times and row[c] is not None else row[c] for c in columns}

    def unpacked(row: dict) -> dict:
        return {c: pd.Timestamp(row[c]) if c in times and row[c] is not None else row[c] for c in columns}

    def step(memory, rows, known):
        last = unpacked(memory["row"]) if memory else None
        due = memory["due"] if memory else None
        out = []

        def copies(until: int) -> None:
            nonlocal due
            while last is not None and due < until:
                out.append({**last, "emit_ms": due, "repeated": True})
                due += window_ms

        for row in rows.to_dict("records"):
            at = row["_ts"]
            copies(at)
            last = {c: row[c] for c in columns}
            due = at + window_ms
            out.append({**last, "emit_ms": at, "repeated": False})
        copies(known)
        frame = pd.DataFrame(out, columns=[*columns, "emit_ms", "repeated"])
        return {"row": packed(last), "due": due} if last else None, frame, due

    return step


def stream_repeat_last(
    df: DataFrame,
    window_ms: int,
    *,
    ts: str = "date",
    keys: Sequence[str] = (),
    tie: Sequence[str] = ("obs_id",),
    delay: str = "10 minutes",
) -> DataFrame:
    """Streaming form of ``repeat_last``; copies follow the watermark, also in silence."""
    output = T.StructType(
        [*df.schema.fields, T.StructField("emit_ms", T.LongType()), T.StructField("repeated", T.BooleanType())]
    )
    times = [f.name for f in df.schema.fields if isinstance(f.dataType, T.TimestampType)]
    step = _repeat_step(window_ms, df.columns, times)
    return ordered_stream(df, step, output, ts=ts, keys=keys, tie=tie, delay=delay)


def _violation_step(step_ms: int, events_before_symptom: int, consecutive: bool):
    def step(memory, rows, known):
        state = memory
        out = []

        def close_until(at: int) -> None:
            """End every window that is over at this time, silent ones included."""
            while state["end"] <= at and state["end"] <= state["until"]:
                if state["count"] < state["need"]:
                    state["short"] += 1
                    if state["short"] >= events_before_symptom:
                        out.append((state["id"], state["window"], state["end"]))
                        state["short"] = 0
                elif consecutive:
                    state["short"] = 0
                state["count"] = 0
                state["window"] += 1
                state["end"] += step_ms

        for row in rows.to_dict("records"):
            if state is None:
                state = {
                    "id": row["request_id"],
                    "need": row["min_per_s"] * step_ms / 1000.0,
                    "until": row["until_ms"],
                    "end": row["start_ms"] + step_ms,
                    "window": 0,
                    "count": 0,
                    "short": 0,
                }
            close_until(row["_ts"])
            state["count"] += row["n"]
        wake = None
        if state is not None:
            # What lies before the known time is complete, so windows ending there are over.
            close_until(known)
            wake = state["end"] if state["end"] <= state["until"] else None
        return state, pd.DataFrame(out, columns=["request_id", "window", "symptom_ms"]), wake

    return step


def stream_min_rate_violations(
    counts: DataFrame,
    *,
    ts: str = "report_time",
    step_ms: int = 10_000,
    events_before_symptom: int = 2,
    consecutive: bool = False,
    delay: str | None = "10 seconds",
    demands: DataFrame | None = None,
    at: str | None = None,
    event_time: str | None = None,
) -> DataFrame:
    """Streaming form of ``min_rate_violations``.

    ``counts``: request_id, min_per_s, start_ms, until_ms, n and an event time.
    ``demands``: request_id, min_per_s, start_ms, until_ms of the requests that are
    known when the query begins, of a batch frame. Their windows open at their start
    and are closed by timers, so that a request without any report raises symptoms
    as time passes on the stream. Requests that come later open theirs with a row of
    n = 0 at their start. ``at`` and ``event_time`` are for steps before and after, as
    in :func:`ordered_stream`.
    """
    output = "request_id string, window long, symptom_ms long"
    step = _violation_step(step_ms, events_before_symptom, consecutive)
    initial = None
    if demands is not None:
        known = {"request_id", "min_per_s", "start_ms", "until_ms"}
        opening = {ts: F.timestamp_millis("start_ms"), "n": F.lit(0).cast(counts.schema["n"].dataType)}
        if at is not None:
            opening[at] = F.col("start_ms")
        initial = demands.where(F.col("min_per_s") > 0).select(
            *[
                opening.get(f.name, F.col(f.name) if f.name in known else F.lit(None).cast(f.dataType)).cast(f.dataType).alias(f.name)
                for f in counts.schema.fields
            ]
        )
    following = (event_time, "symptom_ms") if event_time else None
    return ordered_stream(counts, step, output, ts=ts, keys=["request_id"], delay=delay, initial=initial, at=at, event_time=following)


def stream_windows_of_requests(
    reports: DataFrame, usage: DataFrame, requests: DataFrame, step_ms: int = 10_000, *, ts: str = "report_time", delay: str = "10 seconds"
) -> DataFrame:
    """Streaming form of ``windows_of_requests``: request_id, window, n, each once its window is over for good.

    ``reports``: stage_id, n and an event time, as a stream. ``usage`` and
    ``requests`` are batch frames. Reports are summed by stage, window and phase
    (where in a step requests begin), and these sums by request. Time is moved back by
    the phase before it is cut into windows, hence one watermark serves all phases: a
    report counts if it is no more than ``delay`` behind the latest one of any stage,
    and at the latest a step beyond that it is dropped as late.
    """
    step = F.lit(step_ms).cast("bigint")
    uses = usage.select("stage_id", "request_id").distinct()
    asked = uses.join(requests.select("request_id", "start_ms", "until_ms"), "request_id")
    asked = asked.withColumn("_phase", F.pmod("start_ms", step))
    phases = asked.select("stage_id", "_phase").distinct()
    length = f"{step_ms} milliseconds"
    moved = reports.select("stage_id", "n", F.unix_millis(ts).alias("_at")).join(phases, "stage_id")
    moved = moved.withColumn("_moved", F.timestamp_millis(F.col("_at") - F.col("_phase")))
    sums = (
        moved.withWatermark("_moved", f"{delay_ms(delay) + step_ms} milliseconds")
        .groupBy("stage_id", "_phase", F.window("_moved", length).alias("_window"))
        .agg(F.sum("n").alias("n"))
    )
    routed = sums.join(asked, ["stage_id", "_phase"])
    whole = F.floor((F.col("until_ms") - F.col("start_ms")) / step).cast("bigint")
    nth = F.floor((F.unix_millis("_window.start") + F.col("_phase") - F.col("start_ms")) / step).cast("bigint")
    inside = routed.withColumn("window", nth).where((F.col("window") >= 0) & (F.col("window") < whole))
    again = F.window(F.window_time("_window"), length).alias("_over")
    return inside.groupBy("request_id", "window", again).agg(F.sum("n").alias("n")).select("request_id", "window", "n")


def _stable_step(observe_ms: int, keys: Sequence[str]):
    def step(memory, rows, known):
        open_heals = memory["heals"] if memory else []
        for at, request, group in zip(rows["_ts"].tolist(), rows["request_id"].tolist(), rows[list(keys)].to_dict("records")):
            if request is None:  # a symptom ends the hope for all heals that it follows within the time
                open_heals = [h for h in open_heals if not h["at"] < at <= h["at"] + observe_ms]
            else:
                open_heals.append({"request": request, "at": at, "keys": group})
        over = [h for h in open_heals if h["at"] + observe_ms < known]
        rest = [h for h in open_heals if h["at"] + observe_ms >= known]
        out = [(*h["keys"].values(), h["request"], h["at"], h["at"] + observe_ms) for h in over]
        frame = pd.DataFrame(out, columns=[*keys, "request_id", "heal_ms", "stable_ms"])
        wake = min(h["at"] for h in rest) + observe_ms if rest else None
        return {"heals": rest} if rest else None, frame, wake

    return step


def stream_stable_requests(
    heals: DataFrame, symptoms: DataFrame, *, keys: Sequence[str] = ("stage_id",), observe_ms: int = 60_000, ts: str = "at", delay: str = "10 seconds"
) -> DataFrame:
    """Streaming form of ``stable_requests``: keys, request_id, heal_ms, stable_ms.

    ``heals``: keys, request_id and an event time; ``symptoms``: keys and an event
    time; both streams. A heal proves stable when the watermark, that is the slower of
    the two streams, has passed its observation time and no symptom of its stage came
    within that. Only heals under observation are remembered.
    """
    text = F.lit(None).cast("string")
    both = heals.select(*keys, F.col("request_id").cast("string").alias("request_id"), ts)
    both = both.unionByName(symptoms.select(*keys, text.alias("request_id"), ts))
    fields = [heals.schema[k] for k in keys]
    output = T.StructType([*fields, *T._parse_datatype_string("request_id string, heal_ms long, stable_ms long").fields])
    return ordered_stream(both, _stable_step(observe_ms, list(keys)), output, ts=ts, keys=list(keys), delay=delay)


class RecentProcessor(StatefulProcessor):
    """The last ``n`` rows of a key in a list state; rows may arrive in any order."""

    def __init__(self, schema: T.StructType, order: Sequence[str], n: int, ttl_ms: int | None):
        self.schema, self.order, self.n, self.ttl_ms = schema, list(order), n, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ring = handle.getListState("ring", self.schema, self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        names = self.schema.names
        held = [tuple(r) for r in self.ring.get()] if self.ring.exists() else []
        kept = held
        at = [names.index(c) for c in self.order]
        for frame in rows:
            if len(frame):
                new = plain_rows(frame.set_axis([*names, "_key"], axis=1)[names])
                # stable sorts from the last order column to the first, all falling, nulls last
                kept = kept + [tuple(r) for r in new]
                for i in reversed(at):
                    kept = sorted(kept, key=lambda r: (r[i] is not None, r[i] if r[i] is not None else 0), reverse=True)
                kept = kept[: self.n]
        if kept != held:
            self.ring.put(kept)
            out = pd.DataFrame(kept, columns=names)
            out["rank"] = pd.Series(range(1, len(kept) + 1), dtype="int32")
            yield out

    def close(self) -> None:
        pass


def stream_latest_per(
    rows: DataFrame, n: int, ts: str, keys: Sequence[str], tie: Sequence[str] = (), ttl_ms: int | None = None
) -> DataFrame:
    """Streaming form of ``latest_per``: whenever a key's last ``n`` rows change, all of them with their ``rank``.

    For output mode ``update``: the rows of a key in a batch replace what was emitted
    for it before. A key holds ``n`` rows, whenever they came, and is forgotten
    ``ttl_ms`` of processing time after its last change, never if that is not given.
    """
    output = T.StructType([*rows.schema.fields, T.StructField("rank", T.IntegerType())])
    processor = RecentProcessor(rows.schema, [ts, *tie], n, ttl_ms)
    return rows.withColumn("_key", key_text(rows, keys)).groupBy("_key").transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=output, outputMode="Update", timeMode="ProcessingTime"
    )


def _buffer_step(symptoms_before_action: int, lifetime_ms: int):
    def step(memory, rows, known):
        times = memory["times"] if memory else []
        act = []
        for at in rows["_ts"].tolist():
            times = [*times, at][-symptoms_before_action:]
            act.append(len(times) == symptoms_before_action and at - times[0] <= lifetime_ms)
        return {"times": times}, rows.assign(act=act), None

    return step


def stream_symptom_buffer(
    symptoms: DataFrame,
    *,
    ts: str = "symptom_time",
    keys: Sequence[str] = ("stage_id",),
    tie: Sequence[str] = ("request_id",),
    symptoms_before_action: int = 2,
    lifetime_ms: int = 30_000,
    delay: str | None = "10 seconds",
    at: str | None = None,
    event_time: str | None = None,
) -> DataFrame:
    """Streaming form of ``symptom_buffer``; ``at`` and ``event_time`` as in :func:`ordered_stream`."""
    output = T.StructType([*(f for f in symptoms.schema.fields if at is None or f.name != ts), T.StructField("act", T.BooleanType())])
    step = _buffer_step(symptoms_before_action, lifetime_ms)
    following = (event_time, at) if event_time else None
    return ordered_stream(symptoms, step, output, ts=ts, keys=keys, tie=tie, delay=delay, at=at, event_time=following)


REMEDY = ("remedy", "param", "type", "initial", "param_variation")


def _heal_step(observe_ms: int, max_retries: int, lifetime_ms: int):
    def value_of(remedy: dict, times: int) -> str:
        start = remedy["initial"]
        if remedy["type"] != "Integer":
            return start
        return str(int(start) + {"HIGH": 1, "LOW": -1}.get(remedy["param_variation"], 0) * times)

    def step(memory, rows, known):
        # tried: how often each remedy was since the request was last stable
        state = memory or {"tries": 0, "tried": {}, "until": None, "before": None, "closed": False, "remedy": None}
        out = []
        for row in rows.to_dict("records"):
            at = row["_ts"]
            if state["closed"]:
                break
            if row["_symptom"] != 1 or row["_carried"]:
                state["remedy"] = {f: row[f] for f in REMEDY} if row["remedy"] is not None else None
            if row["_symptom"] != 1:
                continue
            if state["until"] is not None and at > max(state["until"], state["before"] + lifetime_ms):
                state.update(tries=0, tried={}, until=None)
            state["before"] = at
            if not row["act"] or (state["until"] is not None and at < state["until"]):
                continue
            remedy, attempt = state["remedy"], state["tries"] + 1
            times = state["tried"].get(remedy["remedy"], 0) if remedy else 0
            if remedy is None or (attempt > max_retries and times > 0):
                decision = "NO_REMEDY" if remedy is None else "GIVE_UP"
                status = "REMOVED" if row["sla_level"] == "GUARANTEED" else "ENFORCED"
                out.append((row["request_id"], at, attempt, decision, status, None, None, None))
                state.update(closed=True, tried={}, remedy=None)
            else:
                out.append((row["request_id"], at, attempt, "HEAL", "HEALED", remedy["remedy"], remedy["param"], value_of(remedy, times)))
                state.update(tries=attempt, until=at + observe_ms)
                state["tried"][remedy["remedy"]] = times + 1
        names = ["request_id", "decided_ms", "attempt", "decision", "status", "remedy", "param", "value"]
        return state, pd.DataFrame(out, columns=names), None

    return step


HEAL_OUTPUT = (
    "request_id string, decided_ms long, attempt int, decision string, status string, "
    "remedy string, param string, value string"
)


def stream_heal_decisions(
    symptoms: DataFrame,
    remedy: DataFrame | Mapping | None,
    *,
    ts: str = "symptom_time",
    observe_ms: int = 60_000,
    max_retries: int = 5,
    lifetime_ms: int = 30_000,
    delay: str | None = "10 seconds",
    at: str | None = None,
) -> DataFrame:
    """Streaming form of ``heal_decisions``; rows carry request_id, act, sla_level and an event time.

    ``remedy``: one for all requests; a batch frame with a remedy per request_id; or a
    stream of changes (request_id, the remedy's columns, an event time of the same
    name), of which the last before a symptom counts for it, or none if that is null.
    """
    own = symptoms.select("request_id", ts, *([at] if at else []), "act", "sla_level")
    text = [F.lit(None).cast("string").alias(f) for f in REMEDY]
    if not isinstance(remedy, DataFrame):
        given = [F.lit(None if remedy is None else remedy[f]).cast("string").alias(f) for f in REMEDY]
        rows = own.select("*", *given, F.lit(1).alias("_symptom"), F.lit(True).alias("_carried"))
    elif remedy.isStreaming:
        marked = own.select("*", *text, F.lit(1).alias("_symptom"), F.lit(False).alias("_carried"))
        change = [F.lit(False).alias("act"), F.lit(None).cast("string").alias("sla_level")]
        values = [F.col(f).cast("string").alias(f) for f in REMEDY]
        rows = marked.unionByName(remedy.select("request_id", ts, *change, *values, F.lit(0).alias("_symptom"), F.lit(False).alias("_carried")))
    else:
        values = F.struct(*[F.col(f).cast("string").alias(f) for f in REMEDY])
        by_request = ["request_id"] if "request_id" in remedy.columns else []
        chosen = remedy.groupBy(*by_request).agg(F.min(values).alias("_remedy"))
        joined = own.join(chosen, by_request, "left") if by_request else own.join(F.broadcast(chosen))
        rows = joined.select(*own.columns, "_remedy.*", F.lit(1).alias("_symptom"), F.lit(True).alias("_carried"))
    step = _heal_step(observe_ms, max_retries, lifetime_ms)
    # of one instant a change comes first, and the last by name of several
    return ordered_stream(rows, step, HEAL_OUTPUT, ts=ts, keys=["request_id"], tie=["_symptom", "remedy"], delay=delay, at=at)


RATE_LIMIT = Mechanism("rate_limit", rate_limit, stream_rate_limit)
SAMPLE = Mechanism("sample_reports", sample_reports, stream_sample_reports)
RATE_REPORTS = Mechanism("rate_reports", rate_reports, stream_rate_reports)
REPEAT = Mechanism("repeat_last", repeat_last, stream_repeat_last)
CLONE = Mechanism("clone_values", clone_values, clone_values)


class MechanismRegistry:
    """Mechanisms by name; applications add their own batch and streaming forms."""

    def __init__(self) -> None:
        self.known = {m.name: m for m in (RATE_LIMIT, SAMPLE, RATE_REPORTS, REPEAT, CLONE)}

    def register(
        self, name: str, batch: Callable[..., DataFrame], streaming: Callable[..., DataFrame] | None = None
    ) -> Mechanism:
        mechanism = Mechanism(name, batch, streaming)
        self.known[name] = mechanism
        return mechanism

    def __getitem__(self, name: str) -> Mechanism:
        return self.known[name]
