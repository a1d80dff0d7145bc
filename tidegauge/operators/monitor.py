"""From rate reports to symptoms, and from symptoms to heal decisions."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.functions.params import per_second, rate
from tidegauge.operators.rates import steps
from tidegauge.operators.segments import greedy_segments
from tidegauge.schema import Compat

# Product settings of the control loop, in milliseconds and counts.
LOOP_SETTINGS = {
    "tick_ms": 10_000,
    "report_ms": 1_000,
    "events_before_symptom": 2,
    "symptoms_before_action": 2,
    "symptom_lifetime_ms": 30_000,
    "observe_ms": 60_000,
    "max_retries": 5,
}


def minimum_rates(requests: DataFrame, compat: Compat = Compat()) -> DataFrame:
    """Requests with a minimum rate: request_id, min_per_s. A maximum rate overrides it."""
    parsed = rate(F.col("obsrate_min"))
    value = parsed["n"].cast("double") if compat.per_second_minimum else per_second(F.col("obsrate_min"))
    kept = requests.where(parsed.isNotNull() & F.col("obsrate_max").isNull())
    return kept.select("request_id", value.alias("min_per_s"))


def equal_demands(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requests that ask the same of the same stages as one: (groups, members).

    ``requests``: request_id and any of stage_id, min_per_s, start_ms and until_ms.
    ``groups`` has these columns, with the name of the group as request_id, and can
    stand for the requests wherever nothing else of them is asked; ``members``,
    request_id and group_id, leads back (:func:`for_members`). Requests are equal if all
    rows of one id are those of the other; rows without an id belong to no request.
    """
    asked = [c for c in ("stage_id", "min_per_s", "start_ms", "until_ms") if c in requests.columns]
    rows = F.sort_array(F.collect_list(F.struct(*asked))).alias("_rows")
    own = requests.where(F.col("request_id").isNotNull()).groupBy("request_id").agg(rows)
    name = F.to_json(F.struct("_rows"))
    groups = own.select("_rows").distinct().select(name.alias("request_id"), F.inline("_rows"))
    return groups, own.select("request_id", name.alias("group_id"))


def for_members(rows: DataFrame, members: DataFrame) -> DataFrame:
    """Rows of the groups of :func:`equal_demands`, for each of their requests."""
    others = [c for c in rows.columns if c != "request_id"]
    named = rows.select(F.col("request_id").alias("group_id"), *others)
    return members.join(named, "group_id").select("request_id", *others)


def reports_to_requests(reports: DataFrame, usage: DataFrame) -> DataFrame:
    """Rate reports of a stage, summed, for every request that uses the stage.

    ``reports``: stage_id, report_ms, producer, n. ``usage``: stage_id,
    request_id. Reports are summed before they are joined.
    """
    totals = reports.groupBy("stage_id", "report_ms").agg(F.sum("n").alias("n"))
    routed = totals.join(usage.select("stage_id", "request_id").distinct(), "stage_id")
    return routed.groupBy("request_id", "report_ms").agg(F.sum("n").alias("n"))


def count_by_window(
    counts: DataFrame, requests: DataFrame, step_ms: int = 10_000
) -> DataFrame:
    """Observations per request and window since its start: request_id, window, n.

    ``counts``: request_id, report_ms, n. ``requests``: request_id, start_ms,
    until_ms. Windows without reports have no row.
    """
    joined = counts.join(requests.select("request_id", "start_ms", "until_ms"), "request_id")
    inside = joined.where((F.col("report_ms") >= F.col("start_ms")) & (F.col("report_ms") < F.col("until_ms")))
    window = F.floor((F.col("report_ms") - F.col("start_ms")) / step_ms).cast("bigint")
    return inside.groupBy("request_id", window.alias("window")).agg(F.sum("n").alias("n"))


def windows_of_requests(reports: DataFrame, usage: DataFrame, requests: DataFrame, step_ms: int = 10_000) -> DataFrame:
    """Observations per request and whole window since its start, straight from stage reports: request_id, window, n.

    The same as :func:`count_by_window` of :func:`reports_to_requests`, but for
    a window that ``until_ms`` cuts. Reports are summed by stage, window and
    phase (where in a step requests of the stage begin), and only these sums are
    joined with requests, so that a stage's reports are not copied for each of them.
    """
    step = F.lit(step_ms).cast("bigint")
    uses = usage.select("stage_id", "request_id").distinct()
    asked = uses.join(requests.select("request_id", "start_ms", "until_ms"), "request_id")
    asked = asked.withColumn("_phase", F.pmod("start_ms", step))
    totals = reports.groupBy("stage_id", "report_ms").agg(F.sum("n").alias("n"))
    phases = asked.select("stage_id", "_phase").distinct()
    slot = F.floor((F.col("report_ms") - F.col("_phase")) / step).cast("bigint")
    sums = totals.join(phases, "stage_id").groupBy("stage_id", "_phase", slot.alias("_slot")).agg(F.sum("n").alias("n"))
    routed = sums.join(asked, ["stage_id", "_phase"])
    window = F.col("_slot") - F.floor((F.col("start_ms") - F.col("_phase")) / step).cast("bigint")
    whole = F.floor((F.col("until_ms") - F.col("start_ms")) / step).cast("bigint")
    inside = routed.withColumn("window", window).where((F.col("window") >= 0) & (F.col("window") < whole))
    return inside.groupBy("request_id", "window").agg(F.sum("n").alias("n"))


def min_rate_violations(
    counts: DataFrame,
    requests: DataFrame,
    *,
    step_ms: int = 10_000,
    events_before_symptom: int = 2,
    consecutive: bool = False,
) -> DataFrame:
    """Symptoms of requests that fall short of their minimum rate: request_id, window, symptom_ms.

    ``requests``: request_id, min_per_s, start_ms, until_ms. A window is short
    if it has fewer observations than the rate asks for; silence counts as 0.
    Every ``events_before_symptom`` short windows raise a symptom, at the end of
    the last of them. A good window does not reset the count, unless
    ``consecutive`` is set.

    Silent windows are never laid out: between two good windows all are short,
    so the windows that complete a symptom follow from their positions.
    """
    return window_violations(
        count_by_window(counts, requests, step_ms),
        requests,
        step_ms=step_ms,
        events_before_symptom=events_before_symptom,
        consecutive=consecutive,
    )


def window_violations(
    per_window: DataFrame,
    requests: DataFrame,
    *,
    step_ms: int = 10_000,
    events_before_symptom: int = 2,
    consecutive: bool = False,
) -> DataFrame:
    """:func:`min_rate_violations` from counts per window: request_id, window, n."""
    total = F.floor((F.col("until_ms") - F.col("start_ms")) / step_ms).cast("bigint")
    bounds = requests.where(F.col("min_per_s") > 0).select(
        "request_id", "start_ms", (F.col("min_per_s") * step_ms / 1000.0).alias("_need"), total.alias("_total")
    )
    good = per_window.join(bounds.select("request_id", "_need", "_total"), "request_id").where(
        (F.col("n") >= F.col("_need")) & (F.col("window") < F.col("_total"))
    )
    marks = good.select("request_id", "window").unionByName(
        bounds.select("request_id", F.lit(-1).cast("bigint").alias("window"))
    )
    order = Window.partitionBy("request_id").orderBy("window")
    stretches = (
        marks.withColumn("_next", F.lead("window").over(order))
        .withColumn("_good", F.row_number().over(order) - 1)
        .join(bounds.select("request_id", "start_ms", "_total"), "request_id")
    )
    k = F.lit(events_before_symptom).cast("bigint")
    before = F.lit(0).cast("bigint") if consecutive else (F.col("window") + 1 - F.col("_good")).cast("bigint")
    length = F.coalesce(F.col("_next"), F.col("_total")) - F.col("window") - 1
    counted = stretches.withColumns({"_before": before, "_length": length})
    first = F.col("_before") - F.pmod(F.col("_before"), k) + k
    last = F.col("_before") + F.col("_length")
    number = F.when(first <= last, F.floor((last - first) / k) + 1).otherwise(0)
    placed = counted.select("request_id", "start_ms", "window", "_before", first.alias("_first"), number.alias("_number"))
    raised = steps(placed, F.lit(0), F.col("_number"), "_nth")
    at = F.col("window") + F.col("_first") + F.col("_nth") * k - F.col("_before")
    return raised.select(
        "request_id", at.alias("window"), (F.col("start_ms") + (at + 1) * step_ms).alias("symptom_ms")
    )


def _first_of_batches(rows: DataFrame, n_group: int, most: int) -> DataFrame:
    """The first ``most`` different rows of each group in every Arrow batch, and so the first of all among them.

    The first ``n_group`` columns are the group, the others the order.
    """

    def differs(column: pa.Array) -> np.ndarray:
        before, after = column.slice(0, len(column) - 1), column.slice(1)
        other = pc.fill_null(pc.not_equal(before, after), False)
        return np.asarray(pc.or_(other, pc.xor(pc.is_null(before), pc.is_null(after))))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            order = pc.sort_indices(batch, sort_keys=[(c, "ascending") for c in batch.schema.names], null_placement="at_start")
            batch = batch.take(order)
            new_group = np.ones(batch.num_rows, bool)
            new_group[1:] = np.any([differs(c) for c in batch.columns[:n_group]], axis=0)
            new = new_group.copy()
            new[1:] |= np.any([differs(c) for c in batch.columns[n_group:]], axis=0)
            number = np.cumsum(new)
            place = number - np.maximum.accumulate(np.where(new_group, number, 0))
            yield batch.filter(pa.array(new & (place < most)))

    return rows.mapInArrow(first, rows.schema)


def symptom_buffer(
    symptoms: DataFrame,
    *,
    keys: tuple[str, ...] = ("stage_id",),
    ts: str = "symptom_ms",
    tie: tuple[str, ...] = ("request_id",),
    symptoms_before_action: int = 2,
    lifetime_ms: int = 30_000,
) -> DataFrame:
    """Add ``act``: the buffer of the last symptoms, none expired, is full with this one.

    A symptom acts if the lifetime before it holds enough earlier ones. These are
    counted from the numbers per instant, within cells of one lifetime, so that a
    stage with many symptoms is not sorted in one task; of those of one instant
    only the first few need a rank, and no task sorts more than the first few of each batch of rows.
    """
    needed = symptoms_before_action - 1
    if needed <= 0:
        return symptoms.withColumn("act", F.col(ts).isNotNull())
    group = [*keys, ts]
    numbers = symptoms.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"))
    cell = F.floor(F.col(ts) / lifetime_ms) if lifetime_ms > 0 else F.col(ts)
    cells = F.explode(F.array(cell, cell + 1))
    spread = numbers.withColumn("_own", cell).withColumn("_cell", cells)
    before = Window.partitionBy(*keys, "_cell").orderBy(ts).rangeBetween(-lifetime_ms, -1)
    seen = spread.withColumn("_earlier", F.coalesce(F.sum("_n").over(before), F.lit(0))).where("_cell = _own")
    seen = seen.select(*[F.col(c).alias(f"_{c}_") for c in group], "_earlier")
    by_tie = Window.partitionBy(*group).orderBy(*tie)
    early = _first_of_batches(symptoms.select(*group, *tie), len(group), needed).distinct()
    early = early.withColumn("_place", F.row_number().over(by_tie)).where(F.col("_place") <= needed)
    early = early.select(*[F.col(c).alias(f"_{c}_e") for c in (*group, *tie)], "_place")

    def same(columns: tuple[str, ...] | list[str], suffix: str) -> Column:
        return reduce(and_, [F.col(c).eqNullSafe(F.col(f"_{c}{suffix}")) for c in columns])

    found = symptoms.join(seen, same(group, "_"), "left").join(early, same([*group, *tie], "_e"), "left")
    ahead = F.col("_earlier") + F.coalesce(F.col("_place") - 1, F.lit(needed))
    return found.select(*symptoms.columns, F.coalesce(F.col(ts).isNotNull() & (ahead >= needed), F.lit(False)).alias("act"))


def heal_decisions(
    symptoms: DataFrame,
    requests: DataFrame,
    remedy: DataFrame | Mapping | None,
    *,
    ts: str = "symptom_ms",
    observe_ms: int = 60_000,
    max_retries: int = 5,
    lifetime_ms: int = 30_000,
) -> DataFrame:
    """Heal attempts and their end: request_id, decided_ms, attempt, decision, status, remedy, param, value.

    ``symptoms``: request_id, symptom time, ``act``. ``requests``: request_id,
    sla_level. ``remedy``: remedy, param, type, initial and param_variation, as
    one remedy for all requests, or as rows with a request_id (see
    :func:`tidegauge.operators.remedies.remedy_of_requests`); of several rows for
    a request the first by name counts. A request without a row has no remedy. With
    a column ``since_ms`` beside request_id a row holds from then on, until the next
    of its request; before the first, and from a row with a null remedy on, there is none.

    A request is healed at the first acting symptom and then at the first one
    after each observation time: greedy segments of that length. Attempt 1
    of a remedy takes the initial value, later ones move an Integer parameter by one
    in the direction of the effect or repeat the value. After ``max_retries`` attempts,
    unless the remedy was not tried before, or at once if there is none, the request is
    given up: a GUARANTEED one is REMOVED, the other goes back to ENFORCED and is left
    alone. If symptoms pause for the lifetime after an observation time, the request
    counted as stable, and attempts and tried remedies start anew.
    """
    by_time = Window.partitionBy("request_id").orderBy(ts)
    times = symptoms.groupBy("request_id", ts).agg(F.max("act").alias("act"))
    cut = greedy_segments(
        times.withColumn("_acting_ms", F.when(F.col("act"), F.col(ts))),
        "_acting_ms",
        observe_ms,
        ["request_id"],
        keep_untimed=True,
    )
    marked = cut.withColumn("_attempt", F.coalesce(F.col("_acting_ms") == F.col("segment_ms"), F.lit(False)))
    last_heal = F.last(F.when(F.col("_attempt"), F.col(ts)), ignorenulls=True).over(
        by_time.rowsBetween(Window.unboundedPreceding, -1)
    )
    quiet_until = F.greatest(last_heal + observe_ms, F.lag(ts).over(by_time) + lifetime_ms)
    renewed = F.coalesce((last_heal.isNotNull() & (F.col(ts) > quiet_until)).cast("int"), F.lit(0))
    epochs = marked.withColumn("_renewed", renewed).withColumn("_epoch", F.sum("_renewed").over(by_time))
    in_epoch = Window.partitionBy("request_id", "_epoch").orderBy(ts)
    numbered = epochs.where("_attempt").withColumn("attempt", F.row_number().over(in_epoch))

    fields = ("remedy", "param", "type", "initial", "param_variation")
    if isinstance(remedy, DataFrame):
        by_request = "request_id" in remedy.columns
        values = F.struct(*[F.col(f).cast("string").alias(f) for f in fields])
    if isinstance(remedy, DataFrame) and "since_ms" in remedy.columns:
        if not by_request:
            raise ValueError("remedies that change need a request_id")
        changes = remedy.groupBy("request_id", F.col("since_ms").alias(ts)).agg(F.min(values).alias("_change"))
        both = numbered.withColumn("_tried", F.lit(True)).unionByName(changes, allowMissingColumns=True)
        until_now = Window.partitionBy("request_id").orderBy(ts, F.col("_tried").isNotNull())
        last = F.last("_change", ignorenulls=True).over(until_now.rowsBetween(Window.unboundedPreceding, 0))
        found = both.withColumn("_now", last).where("_tried")
        numbered = found.withColumn("_remedy", F.when(F.col("_now.remedy").isNotNull(), F.col("_now"))).drop("_now", "_change", "_tried")
    elif isinstance(remedy, DataFrame):
        chosen = remedy.groupBy(*["request_id"][: int(by_request)]).agg(F.min(values).alias("_remedy"))
        # without request ids the frame is one row for all
        numbered = numbered.join(chosen, "request_id", "left") if by_request else numbered.join(F.broadcast(chosen))
    else:
        given = [F.lit(None if remedy is None else remedy[f]).cast("string").alias(f) for f in fields]
        numbered = numbered.withColumn("_remedy", F.lit(None) if remedy is None else F.struct(*given))
        if remedy is None:
            numbered = numbered.withColumn("_remedy", F.lit(None).cast("struct<" + ",".join(f"{f}:string" for f in fields) + ">"))

    def of_remedy(name: str) -> Column:
        return F.col("_remedy")[name]

    none = F.col("_remedy").isNull()
    # the how manieth attempt with its remedy since the request was last stable
    same_remedy = Window.partitionBy("request_id", "_epoch", of_remedy("remedy")).orderBy(ts)
    nth = numbered.withColumn("_nth", F.row_number().over(same_remedy))
    judged = nth.withColumn("_end", none | ((F.col("attempt") > max_retries) & (F.col("_nth") > 1)))
    so_far = by_time.rowsBetween(Window.unboundedPreceding, -1)
    open_still = judged.withColumn("_closed", F.coalesce(F.max("_end").over(so_far), F.lit(False))).where("not _closed")

    direction, initial = of_remedy("param_variation"), of_remedy("initial")
    step = F.when(direction == "HIGH", F.lit(1)).when(direction == "LOW", F.lit(-1)).otherwise(F.lit(0))
    moved = (initial.try_cast("bigint") + step * (F.col("_nth") - 1)).cast("string")
    value = F.when(of_remedy("type") == "Integer", F.coalesce(moved, initial)).otherwise(initial)
    guaranteed = F.col("sla_level") == "GUARANTEED"
    final = F.when(guaranteed, F.lit("REMOVED")).otherwise(F.lit("ENFORCED"))
    decision = (
        F.when(~F.col("_end"), F.lit("HEAL"))
        .otherwise(F.when(none, F.lit("NO_REMEDY")).otherwise(F.lit("GIVE_UP")))
    )
    joined = open_still.join(requests.select("request_id", "sla_level"), "request_id")
    return joined.select(
        "request_id",
        F.col(ts).alias("decided_ms"),
        "attempt",
        decision.alias("decision"),
        F.when(~F.col("_end"), F.lit("HEALED")).otherwise(final).alias("status"),
        F.when(~F.col("_end"), of_remedy("remedy")).alias("remedy"),
        F.when(~F.col("_end"), of_remedy("param")).alias("param"),
        F.when(~F.col("_end"), value).alias("value"),
    )


def stable_requests(
    heals: DataFrame,
    symptoms: DataFrame,
    *,
    keys: tuple[str, ...] = ("stage_id",),
    ts: str = "symptom_ms",
    observe_ms: int = 60_000,
    as_of_ms: int | Column | None = None,
) -> DataFrame:
    """Heals without a symptom of their stage in (heal_ms, heal_ms + observe], with ``stable_ms``.

    ``heals``: keys, request_id, heal_ms. With ``as_of_ms`` only those whose
    observation time is over by then. Time is cut into cells of one observation
    time: a symptom within it lies later in the heal's own cell or early enough
    in the next, so that the first and last symptom of each cell decide.
    """
    width = F.lit(observe_ms).cast("bigint")
    found = symptoms.where(F.col(ts).isNotNull()).groupBy(*keys, F.floor(F.col(ts) / width).alias("_cell"))
    found = found.agg(F.min(ts).alias("_low"), F.max(ts).alias("_high"))

    def cell(shift: int, name: str, bound: str) -> DataFrame:
        return found.select(*[F.col(k).alias(f"_{k}{name}") for k in keys], (F.col("_cell") - shift).alias(f"_cell{name}"), F.col(bound).alias(name))

    def same(name: str) -> Column:
        own = F.col("_own_cell") == F.col(f"_cell{name}")
        return reduce(and_, [F.col(k).eqNullSafe(F.col(f"_{k}{name}")) for k in keys], own)

    seen = heals.select(*keys, "request_id", F.col("heal_ms").alias("_at")).withColumn("_own_cell", F.floor(F.col("_at") / width))
    seen = seen.join(cell(0, "_last", "_high"), same("_last"), "left").join(cell(1, "_next", "_low"), same("_next"), "left")
    until = F.col("_at") + observe_ms
    disturbed = F.coalesce(F.col("_last") > F.col("_at"), F.lit(False)) | F.coalesce(F.col("_next") <= until, F.lit(False))
    stable = seen.where(~disturbed)
    if as_of_ms is not None:
        limit = as_of_ms if isinstance(as_of_ms, Column) else F.lit(as_of_ms)
        stable = stable.where(until < limit)
    return stable.select(*keys, "request_id", F.col("_at").alias("heal_ms"), until.alias("stable_ms"))
