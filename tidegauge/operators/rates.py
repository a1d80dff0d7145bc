"""Rate limits, samples, rate reports, repeats and copies (batch forms)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge.functions.clock import epoch_ms, floor_to
from tidegauge.operators.ordering import with_next
from tidegauge.operators.segments import greedy_segments, key_text


PARTS = 32

#: Up to this number the first rows of all parts of a window are ranked together.
FEW = 10_000

#: Time cells that a window's rows are counted in.
CELLS = 1024


def tie_order(df: DataFrame, tie: Sequence[str] | None) -> list[Column]:
    """Columns that order rows of equal time: those named, else ``obs_id``, else a hash of the row."""
    if tie is None:
        tie = ["obs_id"] if "obs_id" in df.columns else []
        if not tie:
            plain = [f.name for f in df.schema if not isinstance(f.dataType, T.MapType)]
            return [F.xxhash64(*plain)]
    return [F.col(t) for t in tie]


def steps(df: DataFrame, first: Column, count: Column, name: str, coarse: int = 1000) -> DataFrame:
    """Each row once for ``first``, ``first + 1`` and so on, ``count`` times, with the number as ``name``.

    In two steps, so that no row holds more than ``coarse`` numbers, or a
    ``coarse``-th of them, at once.
    """
    whole = F.col("_count").cast("bigint")
    blocks = F.sequence(F.lit(0).cast("bigint"), F.ceil(whole / coarse).cast("bigint") - 1)
    begun = df.withColumn("_from", first.cast("bigint")).withColumn("_count", count.cast("bigint")).where("_count > 0")
    blocked = begun.withColumn("_block", F.explode(blocks))
    inside = F.sequence(F.col("_block") * coarse, F.least((F.col("_block") + 1) * coarse, whole) - 1)
    return blocked.withColumn("_step", F.explode(inside)).withColumn(name, F.col("_from") + F.col("_step")).drop("_from", "_count", "_block", "_step")


def _first_by_parts(cut: DataFrame, n: int | Column, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first ``n`` rows of each window: ranked within PARTS parts, then the first ``n`` of each part together."""
    parted = cut.withColumn("_part", F.pmod(F.xxhash64(*order), F.lit(PARTS)))
    for group in ([*keys, "segment_ms", "_part"], [*keys, "segment_ms"]):
        ranked = parted.withColumn("_rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
        parted = ranked.where(F.col("_rank") <= n)
    return parted


def _first_by_counts(
    cut: DataFrame, n: int | Column, period_ms: int | str, ts: str, keys: Sequence[str], order: Sequence[Column]
) -> DataFrame:
    """The first ``n`` rows of each window: a running count over its milliseconds says which of them pass.

    Rows are counted by window and millisecond, these counts are summed within
    time cells and over the cells before, and only rows of one millisecond are ranked.
    """
    period = F.col(period_ms) if isinstance(period_ms, str) else F.lit(period_ms)
    group = ["_window", "segment_ms"]
    timed = cut.withColumns({"_window": key_text(cut, keys), "_ms": epoch_ms(cut, ts)})
    counts = (
        timed.withColumn("_cell", F.floor((F.col("_ms") - F.col("segment_ms")) * CELLS / period))
        .groupBy(*group, "_cell", "_ms")
        .agg(F.count(F.lit(1)).alias("_rows"))
    )
    earlier = Window.partitionBy(*group).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = counts.groupBy(*group, "_cell").agg(F.sum("_rows").alias("_rows"))
    cells = cells.select(*group, "_cell", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_of_cells"))
    inside = Window.partitionBy(*group, "_cell").orderBy("_ms").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.withColumn("_inside", F.coalesce(F.sum("_rows").over(inside), F.lit(0))).join(cells, [*group, "_cell"])
    before = before.select(*group, "_ms", (F.col("_of_cells") + F.col("_inside")).alias("_before"))
    if isinstance(n, int):
        before = before.where(F.col("_before") < n)
    reached = timed.join(before, [*group, "_ms"])
    rank = F.row_number().over(Window.partitionBy(*group, "_ms").orderBy(*order))
    return reached.withColumn("_rank", rank).where(F.col("_before") + F.col("_rank") <= n)


def rate_limit(
    df: DataFrame,
    n: int | Column,
    period_ms: int | str,
    *,
    ts: str = "date",
    keys: Sequence[str] = (),
    tie: Sequence[str] | None = None,
    anchor: str = "first",
    by_counts: bool | None = None,
) -> DataFrame:
    """Let the first ``n`` rows of every window pass and drop the rest.

    ``anchor="first"``: a window opens at the first row after the previous one
    has ended. ``anchor="epoch"``: windows are aligned to the epoch. Without
    keys the limit is global. ``n`` is a number or a column, which by
    parts has one value in a window. Rows of one time follow
    each other by ``tie``, by default ``obs_id`` or, where there is none, a hash
    of the whole row.

    The same rows are found in one of two ways. Where ``n`` is small, rows are
    ranked within PARTS parts of a window and the first ``n`` of each part
    together, so that a task sorts PARTS times ``n`` rows at most. With
    ``by_counts`` a window's rows are counted by time instead, and a task sorts
    rows of one millisecond at most, whatever ``n`` is; the input is read twice.
    Unless said, numbers above FEW are done by counts, columns by parts.
    """
    if isinstance(n, int) and n <= 0:
        return df.where(F.lit(False))
    if anchor == "first":
        cut = greedy_segments(df, ts, period_ms, keys)
    elif anchor == "epoch" and isinstance(period_ms, int):
        cut = df.withColumn("segment_ms", floor_to(epoch_ms(df, ts), period_ms))
    else:
        raise ValueError(f"unsupported anchor {anchor!r} for period {period_ms!r}")
    order = [F.col(ts), *tie_order(df, tie)]
    if by_counts is None:
        by_counts = isinstance(n, int) and n > FEW
    if by_counts:
        return _first_by_counts(cut, n, period_ms, ts, keys, order).select(*df.columns)
    return _first_by_parts(cut, n, keys, order).select(*df.columns)


def sample_reports(
    df: DataFrame,
    period_ms: int = 1000,
    *,
    ts: str = "date",
    keys: Sequence[str] = (),
    tie: Sequence[str] | None = None,
) -> DataFrame:
    """The first row, then the first row at least ``period_ms`` after the last one taken."""
    cut = greedy_segments(df, ts, period_ms, keys)
    at_anchor = cut.where(epoch_ms(df, ts) == F.col("segment_ms"))
    window = Window.partitionBy(*keys, "segment_ms").orderBy(*tie_order(df, tie))
    ranked = at_anchor.withColumn("_rank", F.row_number().over(window))
    return ranked.where(F.col("_rank") == 1).select(*df.columns)


def rate_reports(
    df: DataFrame,
    period_ms: int,
    *,
    ts: str = "date",
    keys: Sequence[str] = (),
    producer: str = "producer",
    tie: Sequence[str] | None = None,
    flush_tail: bool = False,
) -> DataFrame:
    """Counts per producer over (previous report, this report]: keys, report_ms, producer, n.

    A report is due with the first row at least ``period_ms`` after the last
    report and counts that row. What follows the last report is not reported,
    unless ``flush_tail`` asks for it, one period after the last report.
    """
    cut = greedy_segments(df, ts, period_ms, keys, with_next=True)
    order = F.struct(F.col(ts), *[c.alias(f"_tie{i}") for i, c in enumerate(tie_order(df, tie))])
    counts = cut.groupBy(*keys, "segment_ms", "next_segment_ms", producer).agg(
        F.count(F.lit(1)).alias("n"), F.min(order).alias("_first")
    )
    # The row that opens a segment belongs to the report of that very moment,
    # all other rows of the segment to the report that ends it.
    group = [*keys, "segment_ms"]
    openers = counts.groupBy(*[F.col(c).alias(f"_of_{c}") for c in group]).agg(F.min("_first").alias("_opener"))
    both = counts.join(openers, reduce(and_, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in group]))
    marked = both.withColumn("_opens", (F.col("_first") == F.col("_opener")).cast("bigint"))
    tail = F.col("segment_ms") + period_ms if flush_tail else F.lit(None).cast("bigint")
    parts = F.array(
        F.struct(F.coalesce("next_segment_ms", tail).alias("report_ms"), (F.col("n") - F.col("_opens")).alias("n")),
        F.struct(F.col("segment_ms").alias("report_ms"), F.col("_opens").alias("n")),
    )
    return (
        marked.select(*keys, producer, F.inline(parts))
        .where(F.col("report_ms").isNotNull() & (F.col("n") > 0))
        .groupBy(*keys, "report_ms", producer)
        .agg(F.sum("n").alias("n"))
    )


def aligned_rates(
    df: DataFrame, period: str, *, ts: str = "date", keys: Sequence[str] = (), producer: str = "producer"
) -> DataFrame:
    """Counts per producer over epoch-aligned windows; also valid on a stream."""
    return (
        df.groupBy(*keys, F.window(ts, period).alias("_window"), producer)
        .agg(F.count(F.lit(1)).alias("n"))
        .select(*keys, F.col("_window.start").alias("window_start"), producer, "n")
    )


def repeat_last(
    df: DataFrame,
    window_ms: int,
    until_ms: int,
    *,
    ts: str = "date",
    keys: Sequence[str] = (),
    tie: Sequence[str] | None = None,
) -> DataFrame:
    """Each row, and its copies after every ``window_ms`` of silence.

    Adds ``emit_ms`` and ``repeated``. Copies lie strictly before the next row
    of the key; those of the last row end at ``until_ms``.
    """
    rows = df.withColumn("_at", epoch_ms(df, ts))
    if tie is None and "obs_id" not in df.columns:
        rows, tie = rows.withColumn("_tie", tie_order(df, None)[0]), ("_tie",)
    led = with_next(rows, "_at", keys, tie=tie or ("obs_id",), name="_next")
    last_copy = F.coalesce(F.col("_next") - 1, F.lit(until_ms).cast("bigint"))
    first_copy = F.col("_at") + window_ms
    number = F.when(first_copy <= last_copy, F.floor((last_copy - first_copy) / window_ms) + 1).otherwise(0)
    counted = led.select(*df.columns, "_at", number.cast("bigint").alias("_copies"))
    # Copy 0 is the row itself.
    numbered = steps(counted, F.lit(0), F.col("_copies") + 1, "_copy")
    emit = (F.col("_at") + F.col("_copy") * window_ms).alias("emit_ms")
    return numbered.select(*df.columns, emit, (F.col("_copy") > 0).alias("repeated"))


def clone_values(df: DataFrame, n: int) -> DataFrame:
    """Every row ``n`` times; none for n = 0."""
    if n < 0:
        raise ValueError("a row cannot be emitted a negative number of times")
    if n == 0:
        return df.where(F.lit(False))
    copies = F.explode(F.array_repeat(F.lit(0), n)).alias("_copy")
    return df.select(*df.columns, copies).drop("_copy")


def tee(df: DataFrame, report_period_ms: int, sample_period_ms: int = 1000, **options) -> dict[str, DataFrame]:
    """The three outlets of an output stage: delivery, quality sample and rate report."""
    return {
        "delivery": df,
        "quality": sample_reports(df, sample_period_ms, **options),
        "rate": rate_reports(df, report_period_ms, **options),
    }
