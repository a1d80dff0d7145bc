import random

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidegauge.operators import ordering, rates, segments


def greedy(times, period):
    anchors = []
    for t in sorted(set(times)):
        if not anchors or t >= anchors[-1] + period:
            anchors.append(t)
    return anchors


def in_batches(frame, size):
    for i in range(0, len(frame), size):
        yield frame.iloc[i : i + size].reset_index(drop=True)


def run_steps(frame, batch):
    group = ["_key", "_period", "_run"]
    frame = frame.sort_values([*group, "_chunk", "ts"], ascending=[True, True, True, False, True])
    return pd.concat(segments._run_steps(in_batches(frame, batch)))


def all_passes(times_by_key, period, periods, batch, run=3):
    """The task functions one after the other, sorted as Spark sorts them."""
    width = period * periods
    rows = [
        (k, period, t // width // run, t // width, t, t // width * width) for k, times in times_by_key.items() for t in set(times)
    ]
    frame = pd.DataFrame(rows, columns=["_key", "_period", "_run", "_chunk", "ts", "_chunk_start"])
    runs = run_steps(frame, batch).assign(_group=0).sort_values(["_key", "_period", "_chunk", "upto"])
    entries = pd.concat(segments._enter_runs(in_batches(runs, batch)))
    entries = entries.rename(columns={"enter": "ts", "_chunk": "_run"}).assign(is_entry=True, _chunk=segments.LONG_MIN)
    names = ["_key", "_period", "_run", "_chunk", "ts", "is_entry"]
    both = pd.concat([frame.assign(is_entry=False)[names], entries[names]])
    both = both.sort_values(["_key", "_period", "_run", "_chunk", "ts"])
    out = [f for f in segments._walk(in_batches(both, batch))]
    found = pd.concat(out) if out else pd.DataFrame(columns=["_key", "anchor_ms"])
    for _, own in found.groupby("_key"):
        own = own.sort_values("anchor_ms")
        assert own["previous_ms"].isna().tolist() == [True] + [False] * (len(own) - 1)
        assert own["previous_ms"].iloc[1:].tolist() == own["anchor_ms"].iloc[:-1].tolist()
    return {k: sorted(found.loc[found["_key"] == k, "anchor_ms"].tolist()) for k in times_by_key}


@settings(max_examples=300, deadline=None)
@given(
    st.dictionaries(
        st.sampled_from(["a", "b", "c"]), st.lists(st.integers(-200, 1_000), min_size=1, max_size=80), min_size=1
    ),
    st.integers(1, 120),
    st.integers(1, 6),
    st.integers(1, 50),
    st.integers(1, 5),
)
def test_chunked_passes_equal_the_scan(times_by_key, period, periods, batch, run):
    got = all_passes(times_by_key, period, periods, batch, run)
    assert got == {k: greedy(v, period) for k, v in times_by_key.items()}


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1_704_000_000_000, 1_704_000_100_000), min_size=1, max_size=200), st.integers(1, 30_000))
def test_anchors_are_a_period_apart_and_cover_every_row(times, period):
    anchors = all_passes({"k": times}, period, 3, 64)["k"]
    assert all(b - a >= period for a, b in zip(anchors, anchors[1:]))
    assert all(any(a <= t < a + period or t == a for a in anchors) or t >= anchors[-1] for t in times)


def events(spark, rows):
    return spark.createDataFrame(rows, "k string, t long, id long")


@pytest.fixture(scope="module")
def hot(spark):
    """One key holds most rows; times repeat."""
    rnd = random.Random(5)
    rows = [("hot", rnd.randint(0, 40_000), i) for i in range(4_000)]
    rows += [(rnd.choice("abc"), rnd.randint(0, 40_000), i) for i in range(4_000, 5_000)]
    rows += [(None, rnd.randint(0, 40_000), i) for i in range(5_000, 5_100)]
    return rows


@pytest.mark.parametrize("period,periods", [(7, 2), (50, None), (3_000, 1)])
def test_hot_key_segments(spark, hot, period, periods):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        got = segments.greedy_segments(events(spark, hot), "t", period, ["k"], chunk_periods=periods).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == len(hot)
    by_key = {}
    for k, t, _ in hot:
        by_key.setdefault(k, []).append(t)
    anchors = {k: np.array(greedy(v, period)) for k, v in by_key.items()}
    for r in got:
        mine = anchors[r["k"]]
        assert r["segment_ms"] == mine[np.searchsorted(mine, r["t"], side="right") - 1]


def test_period_column(spark, hot):
    rows = events(spark, [r for r in hot if r[0]]).withColumn("p", F.when(F.col("k") == "hot", 50).otherwise(900))
    got = segments.greedy_anchors(rows, "t", "p", ["k"]).collect()
    for k, period in (("hot", 50), ("a", 900)):
        mine = sorted(r["anchor_ms"] for r in got if r["k"] == k)
        assert mine == greedy([t for x, t, _ in hot if x == k], period)


def test_keys_that_look_alike_stay_apart(spark):
    frame = spark.createDataFrame(
        [("a,1", "b", 1), ("a", "1,b", 2), (None, "-", 3), ("-", None, 4), ("", "", 5)], "x string, y string, t long"
    )
    assert segments.greedy_anchors(frame, "t", 1000, ["x", "y"]).count() == 5


def test_rate_limit_never_admits_more_than_n(spark, hot):
    kept = rates.rate_limit(events(spark, hot), 3, 100, ts="t", keys=["k"], tie=["id"]).collect()
    by_key = {}
    for r in kept:
        by_key.setdefault(r["k"], []).append((r["t"], r["id"]))
    for k, mine in by_key.items():
        expected, start, count = [], None, 0
        for t, i in sorted((t, i) for x, t, i in hot if x == k):
            if start is None or t >= start + 100:
                start, count = t, 0
            if count < 3:
                expected.append((t, i))
                count += 1
        assert sorted(mine) == expected
    assert rates.rate_limit(events(spark, hot), 0, 100, ts="t").count() == 0


def test_rate_limit_drops_rows_before_the_shuffle(spark, hot):
    kept = rates.rate_limit(events(spark, hot), 3, 100, ts="t", keys=["k"], tie=["id"], anchor="epoch")
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 4


def test_a_large_limit_sorts_no_window_whole(spark):
    """Beyond the limit up to which the engine itself prunes, parts of a window are ranked first."""
    rows = spark.range(60_000).select(F.col("id"), (F.col("id") % 977).alias("t"))
    kept = rates.rate_limit(rows, 5000, 1_000_000, ts="t", tie=["id"], anchor="epoch")
    want = sorted((t, i) for i, t in ((i, i % 977) for i in range(60_000)))[:5000]
    assert sorted((r["t"], r["id"]) for r in kept.collect()) == want
    parted = kept._jdf.queryExecution().optimizedPlan().toString()
    assert parted.count("Window [row_number()") == 2 and "_part" in parted


def reports_by_scan(rows, period):
    out, counts, last = {}, {}, None
    for t, _, p in sorted(rows):
        counts[p] = counts.get(p, 0) + 1
        if last is None or t - last >= period:
            out.update({(t, q): n for q, n in counts.items()})
            counts, last = {}, t
    return out, counts


@pytest.mark.parametrize("period", [1, 40, 700, 100_000])
def test_rate_reports(spark, period):
    rnd = random.Random(period)
    rows = [(rnd.randint(0, 3_000), i, rnd.choice(["p", "q", None])) for i in range(400)]
    frame = spark.createDataFrame(rows, "t long, id long, producer string")
    got = rates.rate_reports(frame, period, ts="t", tie=["id"]).collect()
    expected, left = reports_by_scan([(t, i, p or "") for t, i, p in rows], period)
    assert {(r["report_ms"], r["producer"] or ""): r["n"] for r in got} == expected
    flushed = rates.rate_reports(frame, period, ts="t", tie=["id"], flush_tail=True)
    assert flushed.agg(F.sum("n")).first()[0] == len(rows)


def test_samples_are_the_first_rows(spark):
    rows = [("k", 0, 2), ("k", 0, 1), ("k", 5, 3), ("k", 10, 5), ("k", 10, 4)]
    got = rates.sample_reports(events(spark, rows), 10, ts="t", keys=["k"], tie=["id"]).collect()
    assert sorted(r["id"] for r in got) == [1, 4]


def test_repeats_fill_silence_only(spark):
    rows = [("k", 0, 1), ("k", 25, 2), ("k", 35, 3), ("x", 5, 4)]
    got = rates.repeat_last(events(spark, rows), 10, 60, ts="t", keys=["k"], tie=["id"]).collect()
    by_id = {}
    for r in got:
        by_id.setdefault(r["id"], []).append((r["emit_ms"], r["repeated"]))
    assert sorted(by_id[1]) == [(0, False), (10, True), (20, True)]
    assert sorted(by_id[2]) == [(25, False)]
    assert sorted(by_id[3]) == [(35, False), (45, True), (55, True)]
    assert sorted(by_id[4]) == [(5, False), (15, True), (25, True), (35, True), (45, True), (55, True)]


def test_next_value_across_chunks(spark, hot):
    frame = events(spark, [r for r in hot if r[0]])
    got = ordering.with_next(frame, "t", ["k"], tie=["id"], chunk=64, name="n").collect()
    for k in ("hot", "a"):
        mine = sorted((r["t"], r["id"], r["n"]) for r in got if r["k"] == k)
        assert [n for *_, n in mine] == [t for t, *_ in mine[1:]] + [None]


def test_clones(spark):
    frame = spark.range(3)
    assert rates.clone_values(frame, 2).count() == 6
    assert rates.clone_values(frame, 0).count() == 0
    with pytest.raises(ValueError):
        rates.clone_values(frame, -1)


def test_dense_keys_leave_few_steps_to_the_pass_per_key():
    """A regular dense key, whose chains never meet: its steps are composed in runs of chunks."""
    period, width = 1000, 2000
    times = np.arange(0, 64 * 8 * width, 10)
    chunk = times // width
    frame = pd.DataFrame({"_key": "k", "_period": period, "_run": chunk // segments.RUN, "_chunk": chunk, "ts": times, "_chunk_start": chunk * width})
    runs = run_steps(frame, 5000)
    assert len(runs) <= 64 * 8 // segments.RUN * (period // 10 + 2)
    assert all_passes({"k": times.tolist()}, period, 2, 5000, segments.RUN)["k"] == list(range(0, 64 * 8 * width, period))


@pytest.mark.parametrize("anchor", ["first", "epoch"])
@pytest.mark.parametrize("n", [1, 3, 7, 40, 5000])
def test_limits_by_counts_keep_the_rows_of_ranks(spark, anchor, n):
    rng = random.Random(n)
    hot = [(rng.choice(["a", "a", "a", "b", None]), rng.choice([0, 5, 5, rng.randrange(3000)]), i) for i in range(600)]
    df = spark.createDataFrame(hot, "k string, t bigint, id bigint")
    options = {"ts": "t", "keys": ["k"], "tie": ["id"], "anchor": anchor}
    kept = [rates.rate_limit(df, n, 100, by_counts=way, **options) for way in (True, False)]
    assert sorted(r.id for r in kept[0].collect()) == sorted(r.id for r in kept[1].collect())
    own = df.withColumn("most", F.when(F.col("id") % 2 == 0, n).otherwise(2))
    cut = segments.greedy_segments(own, "t", 100, ["k"]) if anchor == "first" else own.withColumn("segment_ms", F.col("t") - F.pmod("t", F.lit(100)))
    groups = {}
    for r in cut.collect():
        groups.setdefault((r.k, r.segment_ms), []).append(r)
    plain = [r.id for rows in groups.values() for i, r in enumerate(sorted(rows, key=lambda r: (r.t, r.id))) if i < r.most]
    by_row = rates.rate_limit(own, F.col("most"), 100, by_counts=True, **options)
    assert sorted(r.id for r in by_row.collect()) == sorted(plain)


def test_limits_beyond_few_rank_single_milliseconds_only(spark):
    rows = spark.range(60_000).select(F.col("id"), (F.col("id") % 977).alias("t"))
    kept = rates.rate_limit(rows, 50_000, 1_000_000, ts="t", tie=["id"], anchor="epoch")
    want = sorted((t, i) for i, t in ((i, i % 977) for i in range(60_000)))[:50_000]
    assert sorted((r["t"], r["id"]) for r in kept.collect()) == want
    ranks = [line for line in kept._jdf.queryExecution().optimizedPlan().toString().splitlines() if "row_number()" in line]
    assert len(ranks) == 1 and "_ms#" in ranks[0]
