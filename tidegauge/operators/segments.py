"""Greedy time segments: the core of rate limits, samples and rate reports.

Per key, the first timestamp is an anchor, and every later anchor is the first
timestamp at least ``period`` after the one before. Each anchor depends on the
previous one, so no window frame expresses it, and scanning a key from end to
end would put a hot key into one task. Instead:

1. Rows shrink to distinct (key, timestamp) pairs, combined before the shuffle.
2. Time is cut into chunks of many periods, and RUN chunks make a run. Per chunk a
   step function says which last anchor results from every possible way of entering
   it, with few steps where chains that start apart soon meet. One task per (key,
   run) takes its chunks from the last one on and composes their functions into
   one, no larger than that of the first chunk.
3. A pass per key over these few composed functions fixes how each run is entered.
4. Every (key, run) walks its own anchors from that entry, chunk by chunk.

A hot key is thereby spread over its runs in steps 2 and 4, where a task holds one
chunk at a time, and only the functions of runs meet in step 3. Chains of dense and
regular keys never meet, so that a run has as many steps as a period has rows.
Anchors are at least one period apart, so an epoch-aligned cell of one period holds
at most one, and the anchor of a row lies in its own cell or in the one before; rows
find their segment by an equi-join on (key, cell).

A task needs memory for the distinct milliseconds of one chunk.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge.functions.clock import epoch_ms

LONG_MIN = -(2**63)
_STEPS = "_key string, _period long, _chunk long, upto long, leave long"
_ENTRIES = "_key string, _period long, _chunk long, enter long"
_ANCHORS = "_key string, _period long, anchor_ms long, previous_ms long"


def key_text(df: DataFrame, keys: Sequence[str]) -> Column:
    """All key columns as one non-null text, injective for any key values.

    Instants count in microseconds: their text repeats when a clock is set back.
    """
    parts = []
    for k in keys:
        instant = isinstance(df.schema[k].dataType, T.TimestampType)
        text = (F.unix_micros(F.col(k)) if instant else F.col(k)).cast("string")
        parts.append(F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.concat_ws(",", *parts) if parts else F.lit("")


def _period_column(period_ms: int | str) -> Column:
    if isinstance(period_ms, str):
        return F.col(period_ms).cast("bigint")
    if period_ms <= 0:
        raise ValueError("period must be positive")
    return F.lit(int(period_ms)).cast("bigint")


def _chunk_ms(period: Column, periods: int | None) -> Column:
    """Chunk length: many short periods, but two at least."""
    if periods is not None:
        return period * F.lit(int(periods)).cast("bigint")
    many = F.floor(F.lit(4_000_000) / period).cast("bigint")
    return period * F.greatest(F.lit(2).cast("bigint"), F.least(F.lit(512).cast("bigint"), many))


def _floor_div(ms: Column, width: Column) -> Column:
    return ((ms - F.pmod(ms, width)) / width).cast("bigint")


GROUP = ("_key", "_period", "_chunk")
#: Chunks that one task takes one after the other.
RUN = 2


class _Groups:
    """Next pointers of times sorted within groups; ``first`` marks where a group starts."""

    def __init__(self, ts: np.ndarray, period: np.ndarray, first: np.ndarray):
        self.ts = ts
        self.period = period
        self.first = first
        group = np.cumsum(first) - 1
        self.starts = np.flatnonzero(first)
        self.end = np.append(self.starts[1:], len(ts))[group]
        relative = ts - ts[self.starts][group]
        # Groups are laid side by side on one axis, far enough apart that the
        # search for "own time plus period" cannot run past the next group.
        self.stride = int(relative.max()) + int(period.max()) + 1
        self.axis = group * self.stride + relative

    def after_period(self) -> np.ndarray:
        """Row of the first timestamp at least one period later, -1 if outside the group."""
        nxt = np.searchsorted(self.axis, self.axis + self.period)
        return np.where(nxt < self.end, nxt, -1)


def _group_starts(frame: pd.DataFrame) -> np.ndarray:
    """Marks the rows that differ from the one before in key, period or chunk."""
    first = np.zeros(len(frame), dtype=bool)
    first[0] = True
    for name in GROUP:
        values = frame[name].to_numpy()
        first[1:] |= values[1:] != values[:-1]
    return first


def _whole_groups(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Re-cut sorted batches so that no (key, period, chunk) spans two of them."""

    def head(frame: pd.DataFrame, at: int) -> tuple:
        return tuple(frame[name].iat[at] for name in GROUP)

    def joined(parts: list[pd.DataFrame]) -> tuple[pd.DataFrame, np.ndarray]:
        whole = pd.concat(parts, ignore_index=True) if len(parts) > 1 else parts[0]
        return whole, _group_starts(whole)

    held: list[pd.DataFrame] = []
    for batch in batches:
        if len(batch) == 0:
            continue
        last = head(batch, -1)
        if head(batch, 0) == last:
            cut = 0
            fresh = bool(held) and head(held[-1], -1) != last
        else:
            cut = int(np.flatnonzero(_group_starts(batch))[-1])
            fresh = True
        if fresh:
            ready = [*held, batch.iloc[:cut]] if cut else held
            if ready:
                yield joined(ready)
            held = []
        held.append(batch.iloc[cut:])
    if held:
        yield joined(held)


def _chunk_steps(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per chunk: for a chain that may start at ``upto`` at the latest, its last anchor."""
    for frame, first in _whole_groups(batches):
        groups = _Groups(frame["ts"].to_numpy(np.int64), frame["_period"].to_numpy(np.int64), first)
        nxt = groups.after_period()
        own = np.arange(len(frame))
        leave = np.where(nxt >= 0, nxt, own)
        while True:
            further = leave[leave]
            if np.array_equal(further, leave):
                break
            leave = further
        into_chunk = groups.ts - frame["_chunk_start"].to_numpy(dtype=np.int64)
        early = into_chunk < groups.period
        previous_early = np.append(False, early[:-1])
        entry = np.flatnonzero(early | groups.first | previous_early)
        exits = leave[entry]
        # The last of a run of entries with one exit stands for the run; exits
        # of different groups differ anyway.
        keep = np.append(exits[1:] != exits[:-1], True)
        rows = entry[keep]
        yield pd.DataFrame(
            {
                "_key": frame["_key"].to_numpy()[rows],
                "_period": groups.period[rows],
                "_chunk": frame["_chunk"].to_numpy()[rows],
                "_group": frame["_run"].to_numpy()[rows],
                "upto": groups.ts[rows],
                "leave": groups.ts[exits[keep]],
            }
        )


def _parts(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
    """Key, period, group, chunk, upto and leave of each chunk of sorted step rows."""
    for frame, first in _whole_groups(batches):
        starts = np.flatnonzero(first)
        ends = np.append(starts[1:], len(frame)).tolist()
        starts = starts.tolist()
        key, group = frame["_key"].to_numpy(), frame["_group"].to_numpy(np.int64)
        period, chunk = frame["_period"].to_numpy(np.int64), frame["_chunk"].to_numpy(np.int64)
        upto, leave = frame["upto"].to_numpy(np.int64), frame["leave"].to_numpy(np.int64)
        for a, b in zip(starts, ends):
            yield key[a], int(period[a]), int(group[a]), int(chunk[a]), upto[a:b], leave[a:b]


def _fold_steps(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Step functions of whole groups of chunks; input sorted by key, group, chunk from last to first, upto.

    The chunks are taken in from the last one on: where a chain leaves a chunk it
    enters what has been composed of the later ones. A chain that finds no row in
    a chunk comes into the next one before its start, and so by its first step.
    """
    of, upto, leave = None, None, None
    done: list[tuple] = []
    held = 0

    def frame() -> pd.DataFrame:
        sizes = [len(u) for _, u, _ in done]
        names = [np.repeat(np.array([k[i] for k, _, _ in done], dtype=kind), sizes) for i, kind in enumerate((object, np.int64, np.int64))]
        return pd.DataFrame(
            {
                "_key": names[0],
                "_period": names[1],
                "_chunk": names[2],
                "upto": np.concatenate([u for _, u, _ in done]),
                "leave": np.concatenate([x for _, _, x in done]),
            }
        )

    for key, period, group, _, own_upto, own_leave in _parts(batches):
        if of != (key, period, group):
            if of is not None:
                done.append((of, upto, leave))
                held += len(upto)
            if held >= 10_000:
                yield frame()
                done, held = [], 0
            of, upto, leave = (key, period, group), own_upto, own_leave
            continue
        onward = np.searchsorted(upto, own_leave + period)
        carried = np.where(onward < len(upto), leave[np.minimum(onward, len(upto) - 1)], own_leave)
        upto, leave = np.append(own_upto, upto[0]), np.append(carried, leave[0])
        # the last of a run of steps with one exit stands for the run
        keep = np.append(leave[1:] != leave[:-1], True)
        upto, leave = upto[keep], leave[keep]
    if of is not None:
        done.append((of, upto, leave))
        yield frame()


def _lone(frame: pd.DataFrame, outer: str) -> np.ndarray:
    """Marks the rows of those (key, period, ``outer``) that have one chunk and neither begin nor end the frame."""
    key, period = frame["_key"].to_numpy(), frame["_period"].to_numpy(np.int64)
    group, chunk = frame[outer].to_numpy(np.int64), frame["_chunk"].to_numpy(np.int64)
    new = np.ones(len(frame), dtype=bool)
    new[1:] = (key[1:] != key[:-1]) | (period[1:] != period[:-1]) | (group[1:] != group[:-1])
    of = np.cumsum(new) - 1
    several = np.zeros(of[-1] + 1, dtype=bool)
    several[of[1:][~new[1:] & (chunk[1:] != chunk[:-1])]] = True
    several[[0, -1]] = True
    return ~several[of]


def _run_steps(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Composed step functions of runs; input sorted by key, run, chunk from last to first, time."""
    alone: list[pd.DataFrame] = []

    def others() -> Iterator[pd.DataFrame]:
        for frame in _chunk_steps(batches):
            lone = _lone(frame, "_group")
            if lone.any():
                alone.append(frame.loc[lone, ["_key", "_period", "_group", "upto", "leave"]].rename(columns={"_group": "_chunk"}))
                frame = frame[~lone]
            if len(frame):
                yield frame

    for folded in _fold_steps(others()):
        yield folded
        yield from alone
        alone.clear()
    yield from alone


def _enter_runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Where the chain of each key enters its runs; input sorted by key, run, upto. Nothing holds it back before the first."""
    names = ["_key", "_period", "_chunk", "enter"]
    ready: list[pd.DataFrame] = []

    def others() -> Iterator[pd.DataFrame]:
        for frame in batches:
            if not len(frame):
                continue
            lone = _lone(frame, "_group")  # keys of one run
            if lone.any():
                ready.append(frame.loc[lone, names[:3]].drop_duplicates().assign(enter=LONG_MIN))
                frame = frame[~lone]
            if len(frame):
                yield frame

    of, earliest = None, LONG_MIN
    out: list[tuple] = []
    for key, period, _, run, upto, leave in _parts(others()):
        if of != (key, period):
            of, earliest = (key, period), LONG_MIN
        at = int(np.searchsorted(upto, earliest))
        if at < len(upto):
            out.append((key, period, run, earliest))
            earliest = int(leave[at]) + period
        if len(out) >= 10_000:
            ready.append(pd.DataFrame(out, columns=names))
            out = []
        yield from ready
        ready.clear()
    yield from ready
    yield pd.DataFrame(out, columns=names)


def _walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Anchors of every run that is entered; a run begins with its entry row, then its times follow, some chunks at a time."""
    carried, enter_next = None, None
    for frame, _ in _whole_groups(batches):
        is_entry = frame["is_entry"].to_numpy(dtype=bool)
        key, period, run = frame["_key"].to_numpy(), frame["_period"].to_numpy(np.int64), frame["_run"].to_numpy(np.int64)
        times = frame["ts"].to_numpy(np.int64)
        new_run = np.ones(len(frame), dtype=bool)
        new_run[1:] = (key[1:] != key[:-1]) | (period[1:] != period[:-1]) | (run[1:] != run[:-1])
        time_rows = np.flatnonzero(~is_entry)
        last = (key[-1], int(period[-1]), int(run[-1]))
        if not len(time_rows):
            carried, enter_next = last, int(times[-1])
            continue
        after_entry = np.append(False, is_entry[:-1])
        groups = _Groups(times[time_rows], period[time_rows], (new_run | after_entry)[time_rows])
        starts = groups.starts
        entered = after_entry[time_rows[starts]]
        enter = np.full(len(starts), LONG_MIN)
        enter[entered] = times[time_rows[starts[entered]] - 1]
        first = time_rows[0]
        if carried == (key[first], int(period[first]), int(run[first])) and not entered[0]:
            entered[0], enter[0] = True, enter_next
        # An entry before the first timestamp means that timestamp; it may lie
        # too far back to subtract.
        head_ts = groups.ts[starts]
        offset = np.minimum(np.maximum(enter, head_ts) - head_ts, groups.stride - 1)
        axis = np.arange(len(starts)) * groups.stride + offset
        at = np.searchsorted(groups.axis, axis)
        walked = entered & (at < groups.end[starts])
        # A run that goes on in the next frame is entered there where the chain leaves this one.
        carried, enter_next = None, None
        if is_entry[-1]:
            carried, enter_next = last, int(times[-1])
        elif entered[-1]:
            carried, enter_next = last, int(enter[-1])
        goes_on = walked[-1] and not is_entry[-1]
        at = at[walked]
        # The entry is one period after the last anchor before the chunk, if there is one.
        known = enter[walked] != LONG_MIN
        before = np.where(known, enter[walked], 0) - groups.period[starts[walked]]
        nxt = groups.after_period()
        rows, previous, chained = [at], [before], [known]
        while at.size:
            onward = nxt[at]
            moved = onward >= 0
            previous.append(groups.ts[at[moved]])
            at = onward[moved]
            rows.append(at)
            chained.append(np.ones(len(at), dtype=bool))
        found = np.concatenate(rows)
        if goes_on:
            # anchors of the last group are the last rows found in it
            enter_next = int(groups.ts[found[found >= starts[-1]].max()]) + int(groups.period[-1])
        source = time_rows[found]
        yield pd.DataFrame(
            {
                "_key": key[source],
                "_period": groups.period[found],
                "anchor_ms": groups.ts[found],
                "previous_ms": pd.arrays.IntegerArray(
                    np.concatenate(previous), ~np.concatenate(chained)
                ),
            }
        )


def _keyed(df: DataFrame, ts: str, period_ms: int | str, keys: Sequence[str]) -> DataFrame:
    return df.withColumns(
        {"_key": key_text(df, keys), "_period": _period_column(period_ms), "_ts": epoch_ms(df, ts)}
    )


def _anchors(keyed: DataFrame, chunk_periods: int | None) -> DataFrame:
    """(_key, _period, anchor_ms, previous_ms) of a frame with _key, _period and _ts."""
    group = ["_key", "_period", "_run"]
    chunk = _chunk_ms(F.col("_period"), chunk_periods)
    times = (
        keyed.where(F.col("_ts").isNotNull() & F.col("_period").isNotNull())
        .select("_key", "_period", F.col("_ts").alias("ts"))
        .distinct()
        .withColumn("_chunk", _floor_div(F.col("ts"), chunk))
        .withColumn("_run", _floor_div(F.col("_chunk"), F.lit(RUN).cast("bigint")))
    )
    runs = (
        times.withColumn("_chunk_start", F.col("_chunk") * chunk)
        .repartition(*group)
        .sortWithinPartitions(*group, F.desc("_chunk"), "ts")
        .mapInPandas(_run_steps, _STEPS)
    )
    entries = (
        runs.withColumn("_group", F.lit(0).cast("bigint"))
        .repartition("_key", "_period")
        .sortWithinPartitions("_key", "_period", "_chunk", "upto")
        .mapInPandas(_enter_runs, _ENTRIES)
    )
    begun = entries.select(
        "_key", "_period", F.col("enter").alias("ts"), F.lit(LONG_MIN).alias("_chunk"), F.col("_chunk").alias("_run"), F.lit(True).alias("is_entry")
    )
    both = times.withColumn("is_entry", F.lit(False)).unionByName(begun)
    return both.repartition(*group).sortWithinPartitions(*group, "_chunk", "ts").mapInPandas(_walk, _ANCHORS)


def greedy_segments(
    df: DataFrame,
    ts: str,
    period_ms: int | str,
    keys: Sequence[str] = (),
    *,
    chunk_periods: int | None = None,
    with_next: bool = False,
    keep_untimed: bool = False,
) -> DataFrame:
    """Add ``segment_ms``, the greatest anchor not after the row's own time.

    ``period_ms`` is a number or the name of a column that is constant per key.
    ``with_next`` adds ``next_segment_ms``, NULL in a key's last segment. Rows
    without a time or a period are left out, or kept with NULL on
    ``keep_untimed``.
    """
    keyed = _keyed(df, ts, period_ms, keys)
    anchors = _anchors(keyed, chunk_periods)
    none = F.lit(None).cast("bigint")
    anchor, previous = F.col("anchor_ms"), F.col("previous_ms")

    def entry(cell: Column, own: Column, before: Column, own_next: Column, before_next: Column) -> Column:
        return F.struct(
            cell.alias("_cell"),
            own.alias("own"),
            before.alias("before"),
            own_next.alias("own_next"),
            before_next.alias("before_next"),
        )

    cell = _floor_div(anchor, F.col("_period"))
    near = [entry(cell, anchor, none, none, none), entry(cell + 1, none, anchor, none, none)]
    if with_next:
        earlier = _floor_div(previous, F.col("_period"))
        near += [entry(earlier, none, none, anchor, none), entry(earlier + 1, none, none, none, anchor)]
    lookup = (
        anchors.select("_key", "_period", F.inline(F.array(*near)))
        .where(F.col("_cell").isNotNull())
        .groupBy("_key", "_period", "_cell")
        .agg(*[F.max(c).alias("_" + c) for c in ("own", "before", "own_next", "before_next")])
    )
    rows = keyed.withColumn("_cell", _floor_div(F.col("_ts"), F.col("_period")))
    joined = rows.join(lookup, ["_key", "_period", "_cell"], "left" if keep_untimed else "inner")
    in_own = F.col("_own") <= F.col("_ts")
    out = [*df.columns, F.when(in_own, F.col("_own")).otherwise(F.col("_before")).alias("segment_ms")]
    if with_next:
        out.append(F.when(in_own, F.col("_own_next")).otherwise(F.col("_before_next")).alias("next_segment_ms"))
    return joined.select(*out)


def greedy_anchors(
    df: DataFrame,
    ts: str,
    period_ms: int | str,
    keys: Sequence[str] = (),
    *,
    chunk_periods: int | None = None,
) -> DataFrame:
    """The anchors alone: key columns and ``anchor_ms``."""
    keyed = _keyed(df, ts, period_ms, keys)
    anchors = _anchors(keyed, chunk_periods)
    if not keys:
        return anchors.select("anchor_ms")
    names = keyed.select("_key", *keys).distinct()
    return anchors.join(names, "_key").select(*keys, "anchor_ms")
