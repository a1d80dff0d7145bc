"""Checked queries: aggregates, segments, rates, monitoring and healing."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidegauge.catalog.base import AS_OF, FIXED_ACCURACY, flat, query, scratch, with_ctes
from tidegauge.catalog.registry import REMEDIES
from tidegauge.operators import aggregates, enrich, monitor, ordering, rates, remedies, segments
from tidegauge.operators import requests as rq
from tidegauge.sources import fixtures as fx

HOUR = 3_600_000
DAY = 24 * HOUR
START = 1_704_067_200_000


def _obs(spark, d):
    return fx.observations(spark, d)


def _anchors(period: int, key: str | None) -> str:
    """Greedy anchors as a recursive query named ``anchors(k, a)``."""
    k = key or "'all'"
    return f"""times as (select distinct {k} as k, date_ms as t from obs),
      anchors(k, a) as (select k, min(t) from times group by k
        union all select anchors.k, (select min(t) from times where times.k = anchors.k and t >= a + {period})
        from anchors where a is not null)"""


def _cut(period: int, key: str | None) -> str:
    """Rows with their segment as ``cut``."""
    k = key or "'all'"
    return (
        _anchors(period, key)
        + f""", cut as (select r.*, x.a as segment_ms from (select *, {k} as k from obs) r asof join
        (select * from anchors where a is not null) x on r.k = x.k and r.date_ms >= x.a)"""
    )


# Aggregates


for _operator, _sql in (("avg", "round(avg(value), 8)"), ("min", "min(value)"), ("max", "max(value)")):

    @query(
        f"ag1_aggregate_{_operator}",
        with_ctes(
            f"""select topic, date_ms // {DAY} * {DAY} as window_start_ms, {_sql} as value, count(*) as n from obs
            group by 1, 2""",
            "obs",
        ),
    )
    def _(spark, d, operator=_operator):
        rows = aggregates.aggregate_observations(_obs(spark, d), operator.upper(), "1 day")
        return flat(rows.withColumn("value", F.round("value", 8) if operator == "avg" else F.col("value")))


@query(
    "ag2_obs_rate",
    with_ctes(
        f"""select topic, date_ms // {HOUR} * {HOUR} as window_start_ms, producer, count(*) as n from obs
        group by 1, 2, 3""",
        "obs",
    ),
)
def _(spark, d):
    return flat(rates.aligned_rates(_obs(spark, d), "1 hour", keys=["topic"]))


@query(
    "ag3_total_rate",
    with_ctes(f"select date_ms // {HOUR} * {HOUR} as report_ms, count(*) as n from obs group by 1", "obs"),
)
def _(spark, d):
    reports = flat(rates.aligned_rates(_obs(spark, d), "1 hour")).withColumnRenamed("window_start_ms", "report_ms")
    return aggregates.total_rate(reports)


def _documents(spark, d):
    nothing = F.lit(None).cast("string")
    req = fx.requests(spark, d).select("application_id", nothing.alias("producer"), "request_id")
    app = F.concat(F.lit("app"), (F.col("obs_id") % 7).cast("string"))
    mine = F.when(F.col("value") > 0, app)
    obs = _obs(spark, d).select(mine.alias("application_id"), "producer", nothing.alias("request_id"))
    return req.unionByName(obs)


@query(
    "ag4_platform_counters",
    with_ctes(
        """with docs as (select application_id, null as producer, request_id from req union all
          select case when value > 0 then concat('app', cast(obs_id % 7 as varchar)) end, producer, null from obs)
        select count(distinct application_id) as applications, count(distinct producer) as producers,
          count(distinct request_id) as requests from docs where application_id is not null""",
        "req", "obs",
    ),
)
def _(spark, d):
    return aggregates.platform_counters(_documents(spark, d))


@query("ag5_container_counter", "select count(distinct p_brand) as containers from part")
def _(spark, d):
    return aggregates.container_counter(fx.table(spark, d, "part"), "p_brand")


# Last rows and series


@query(
    "wn4_latest_observations",
    with_ctes(
        """select producer, obs_id, value, date_ms, cast(row_number() over (partition by producer
          order by date_ms desc, obs_id desc) as int) as rank from obs qualify rank <= 20""",
        "obs",
    ),
)
def _(spark, d):
    rows = rq.latest_per(_obs(spark, d), 20, "date", ["producer"], ["obs_id"])
    return flat(rows.select("producer", "obs_id", "value", "date", "rank"))


@query(
    "wn4_latest_of_one_request",
    with_ctes(
        "select request_id, obs_id, value, timestamp_ms from (select topic as request_id, obs_id, value, "
        "date_ms as timestamp_ms from obs) where request_id = 'error' order by timestamp_ms desc, obs_id desc limit 20",
        "obs",
    ),
)
def _(spark, d):
    log = _obs(spark, d).select(
        F.col("topic").alias("request_id"), "obs_id", "value", F.unix_millis("date").alias("timestamp_ms")
    )
    return rq.latest_observations(log, "error", tie=["obs_id"])


@query(
    "wn7_recent_reports",
    with_ctes(
        """select topic as request_id, producer, date_ms as report_ms, cast(row_number() over (partition by topic
          order by date_ms desc, obs_id desc) as int) as rank from obs qualify rank <= 5""",
        "obs",
    ),
)
def _(spark, d):
    reports = _obs(spark, d).select(
        F.col("topic").alias("request_id"), "producer", "obs_id", F.unix_millis("date").alias("report_ms")
    )
    return rq.latest_per(reports, 5, "report_ms", ["request_id"], ["obs_id"]).drop("obs_id")


@query(
    "wn9_quality_series",
    with_ctes(
        f"""select topic as request_id, ingest_ms as consumed_ms, {AS_OF} - date_ms as freshness,
          cast(trunc({FIXED_ACCURACY}) as bigint) as accuracy from obs left join bounds using (producer)
        order by 1, 2""",
        "obs", "bounds",
    ),
)
def _(spark, d):
    scored = enrich.score(
        enrich.with_capability(_obs(spark, d), fx.capabilities(spark, d)),
        ["OBS_ACCURACY", "OBS_FRESHNESS"],
        enrich.default_attributes(fx.AS_OF_MS),
    )
    log = scored.select(
        F.col("topic").alias("request_id"), F.col("ingest_ms").alias("consumed_ms"),
        F.col("obs_freshness").alias("freshness"), F.col("obs_accuracy").alias("accuracy"),
    )
    return rq.quality_series(log)


# Segments and rates


@query(
    "seg1_anchors_per_producer",
    with_ctes(
        f"with {_anchors(6 * HOUR, 'producer')} select k as producer, a as anchor_ms from anchors where a is not null",
        "obs", recursive=True,
    ),
)
def _(spark, d):
    return segments.greedy_anchors(_obs(spark, d), "date", 6 * HOUR, ["producer"])


@query(
    "seg1_segments_of_one_key",
    with_ctes(f"with {_cut(HOUR, None)} select obs_id, date_ms, segment_ms from cut", "obs", recursive=True),
)
def _(spark, d):
    return flat(segments.greedy_segments(_obs(spark, d).select("obs_id", "date"), "date", HOUR))


@query(
    "st1_rate_limit_first",
    with_ctes(
        f"""with {_cut(6 * HOUR, 'topic')} select obs_id, topic, producer, date_ms from cut qualify
        row_number() over (partition by topic, segment_ms order by date_ms, obs_id) <= 2""",
        "obs", recursive=True,
    ),
)
def _(spark, d):
    kept = rates.rate_limit(_obs(spark, d), 2, 6 * HOUR, keys=["topic"])
    return flat(kept.select("obs_id", "topic", "producer", "date"))


@query(
    "st1_rate_limit_global",
    with_ctes(
        f"""with {_cut(HOUR, None)} select obs_id, topic, producer, date_ms from cut qualify
        row_number() over (partition by segment_ms order by date_ms, obs_id) <= 3""",
        "obs", recursive=True,
    ),
)
def _(spark, d):
    return flat(rates.rate_limit(_obs(spark, d), 3, HOUR).select("obs_id", "topic", "producer", "date"))


@query(
    "st1_rate_limit_epoch",
    with_ctes(
        f"""select obs_id, producer, date_ms from obs qualify row_number() over (partition by producer,
        date_ms // {DAY} order by date_ms, obs_id) <= 1""",
        "obs",
    ),
)
def _(spark, d):
    kept = rates.rate_limit(_obs(spark, d), 1, DAY, keys=["producer"], anchor="epoch")
    return flat(kept.select("obs_id", "producer", "date"))


@query(
    "st1_rate_limit_many",
    with_ctes(
        f"""with {_cut(DAY, 'topic')}, ranked as (select *, row_number() over (partition by topic, segment_ms
          order by date_ms, obs_id) as nr from cut)
        select obs_id, topic, producer, date_ms from ranked where nr <= 4000
        union all select obs_id, 'few of ' || topic, producer, date_ms from ranked where nr <= 5""",
        "obs", recursive=True,
    ),
)
def _(spark, d):
    """Limits as large as a window, and one that cuts through it, by counts instead of ranks."""
    obs = _obs(spark, d)
    many = rates.rate_limit(obs, 4000, DAY, keys=["topic"], by_counts=True)
    some = rates.rate_limit(obs, 5, DAY, keys=["topic"], by_counts=True)
    some = some.withColumn("topic", F.concat(F.lit("few of "), "topic"))
    return flat(many.unionByName(some).select("obs_id", "topic", "producer", "date"))


@query(
    "st2_sample_reports",
    with_ctes(
        f"""with {_cut(2 * HOUR, 'topic')} select obs_id, topic, producer, date_ms from cut where date_ms = segment_ms
        qualify row_number() over (partition by topic, segment_ms order by obs_id) = 1""",
        "obs", recursive=True,
    ),
)
def _(spark, d):
    kept = rates.sample_reports(_obs(spark, d), 2 * HOUR, keys=["topic"])
    return flat(kept.select("obs_id", "topic", "producer", "date"))


def _reports_sql(flush: str) -> str:
    return f"""with {_cut(4 * HOUR, 'topic')}, placed as (select *, row_number() over (partition by topic, segment_ms
        order by date_ms, obs_id) = 1 as opens from cut),
      following as (select k as topic, a as segment_ms, lead(a) over (partition by k order by a) as next_ms from anchors
        where a is not null),
      reported as (select topic, producer, case when opens then segment_ms else coalesce(next_ms, {flush}) end as report_ms
        from placed join following using (topic, segment_ms))
      select topic, report_ms, producer, count(*) as n from reported where report_ms is not null group by 1, 2, 3"""


@query("st3_rate_reports", with_ctes(_reports_sql("null"), "obs", recursive=True))
def _(spark, d):
    return rates.rate_reports(_obs(spark, d), 4 * HOUR, keys=["topic"])


@query("st3_rate_reports_flushed", with_ctes(_reports_sql(f"segment_ms + {4 * HOUR}"), "obs", recursive=True))
def _(spark, d):
    return rates.rate_reports(_obs(spark, d), 4 * HOUR, keys=["topic"], flush_tail=True)


@query(
    "st4_repeat_last",
    with_ctes(
        f"""with led as (select *, lead(date_ms) over (partition by producer order by date_ms, obs_id) as next_ms from obs)
        select obs_id, producer, value, date_ms as emit_ms, false as repeated from led
        union all select obs_id, producer, value, unnest(range(date_ms + {6 * HOUR},
          coalesce(next_ms, {AS_OF} + 1), {6 * HOUR})) as emit_ms, true from led""",
        "obs",
    ),
)
def _(spark, d):
    rows = rates.repeat_last(_obs(spark, d), 6 * HOUR, fx.AS_OF_MS, keys=["producer"])
    return rows.select("obs_id", "producer", "value", "emit_ms", "repeated")


@query(
    "st4_next_of_hot_key",
    with_ctes("select obs_id, lead(date_ms) over (order by date_ms, obs_id) as next_ms from obs", "obs"),
)
def _(spark, d):
    rows = _obs(spark, d).select("obs_id", F.unix_millis("date").alias("date_ms"))
    return ordering.with_next(rows, "date_ms", tie=("obs_id",), name="next_ms").drop("date_ms")


@query("st5_clone_values", with_ctes("select obs_id, value from obs, range(3)", "obs"))
def _(spark, d):
    return rates.clone_values(_obs(spark, d).select("obs_id", "value"), 3)


@query(
    "st6_tee",
    with_ctes(
        f"""with {_cut(HOUR, None)}, following as (select a as segment_ms, lead(a) over (order by a) as next_ms
            from anchors where a is not null)
        select 'delivery' as outlet, obs_id, producer, date_ms as at_ms, cast(null as bigint) as n from obs
        union all select * from (select 'quality', obs_id, producer, date_ms, null from cut where date_ms = segment_ms
          qualify row_number() over (partition by segment_ms order by obs_id) = 1)
        union all select 'rate', null, producer, report_ms, count(*) from (select producer, case when row_number() over
          (partition by segment_ms order by date_ms, obs_id) = 1 then segment_ms else next_ms end as report_ms
          from cut join following using (segment_ms)) where report_ms is not null group by 3, 4""",
        "obs", recursive=True,
    ),
)
def _(spark, d):
    outlets = rates.tee(_obs(spark, d), HOUR, HOUR)
    none = F.lit(None).cast("bigint")
    at = F.unix_millis("date").alias("at_ms")
    rows = [
        outlets[o].select(F.lit(o).alias("outlet"), "obs_id", "producer", at, none.alias("n")) for o in ("delivery", "quality")
    ]
    reports = outlets["rate"].select(
        F.lit("rate").alias("outlet"), none.alias("obs_id"), "producer", F.col("report_ms").alias("at_ms"), "n"
    )
    return rows[0].unionByName(rows[1]).unionByName(reports)


# Monitoring: every request with a minimum rate, and the stage of its topic, which for ALL sees all observations


STEP = DAY
LIFE = 3 * DAY
DEMANDS = f"""need as (select request_id, topic as stage_id, cast(split_part(obsrate_min, '/', 1) as double) * 1000.0::double
        / {HOUR} as per_s, sla_level = 'GUARANTEED' as g from req where obsrate_min is not null and obsrate_max is null),
    staged as (select topic as stage_id, date_ms from obs union all select 'ALL', date_ms from obs),
    daily as (select stage_id, (date_ms - {START}) // {STEP} as h, count(*) as n from staged
      where date_ms >= {START} and date_ms < {AS_OF} group by 1, 2)"""
GRID = f"""grid as (select request_id, stage_id, h, coalesce(n, 0) < per_s * {STEP} / 1000.0::double as short
      from need cross join range(0, ({AS_OF} - {START}) // {STEP}) as r(h) left join daily using (stage_id, h)),
    runs as (select *, sum(cast(short as int)) over (partition by request_id order by h) as s,
      sum(cast(not short as int)) over (partition by request_id order by h) as good from grid)"""
SYMPTOMS = (
    DEMANDS
    + ", "
    + GRID
    + f""", symptoms as (select request_id, stage_id, cast(h as bigint) as "window", {START} + (h + 1) * {STEP} as symptom_ms
      from runs where short and s % 2 = 0)"""
)


def _demands(spark, d):
    req = fx.requests(spark, d)
    return monitor.minimum_rates(req).join(req, "request_id").select(
        "request_id",
        F.col("topic").alias("stage_id"),
        "min_per_s",
        F.lit(START).cast("bigint").alias("start_ms"),
        F.lit(fx.AS_OF_MS).cast("bigint").alias("until_ms"),
        "sla_level",
        F.when(F.col("sla_level") == "GUARANTEED", F.array(F.lit("OBS_ACCURACY"), F.lit("OBS_FRESHNESS")))
        .otherwise(F.array(F.lit("OBS_RATE")))
        .alias("interested_in"),
    )


def _reports(spark, d, period: int):
    """Reports of each producer by stage; a stage per topic, and one of everything."""
    at = F.unix_millis("date")
    staged = _obs(spark, d).select(F.explode(F.array("topic", F.lit("ALL"))).alias("stage_id"), "producer", at.alias("_at"))
    slot = F.floor((F.col("_at") - START) / period) * period + START
    return staged.groupBy("stage_id", slot.cast("bigint").alias("report_ms"), "producer").agg(F.count(F.lit(1)).alias("n"))


def _windows(spark, d, step: int = STEP):
    """Counts of one-second reports by window, for each group of equal demands; the groups; and their members."""
    groups, members = monitor.equal_demands(_demands(spark, d))
    return monitor.windows_of_requests(_reports(spark, d, 1000), groups, groups, step), groups, members


@query(
    "jn8_reports_to_requests",
    with_ctes(
        f"""with {DEMANDS}, reported as (select stage_id, (date_ms - {START}) // {STEP} * {STEP} + {START} as report_ms,
          count(*) as n from staged where date_ms >= {START} group by 1, 2)
        select request_id, report_ms, n from need join reported using (stage_id)""",
        "obs", "req",
    ),
)
def _(spark, d):
    reports = _reports(spark, d, STEP).where(F.col("report_ms") >= START)
    groups, members = monitor.equal_demands(_demands(spark, d))
    return monitor.for_members(monitor.reports_to_requests(reports, groups), members)


@query(
    "jn8_reports_of_seconds",
    with_ctes(
        f"""with {DEMANDS}, reported as (select stage_id, date_ms // 1000 * 1000 as report_ms, count(*) as n
          from staged where date_ms >= {START} group by 1, 2)
        select request_id, count(*) as reports, cast(sum(n) as bigint) as n, cast(sum(report_ms) as bigint) as report_sum
        from need join reported using (stage_id) group by 1""",
        "obs", "req",
    ),
)
def _(spark, d):
    """One-second reports of a stage's producers, each routed to all requests that read the stage, summed by request.

    Requests of equal demands get the same reports, which are routed and summed once for all of them.
    """
    reports = _reports(spark, d, 1000).where(F.col("report_ms") >= START)
    groups, members = monitor.equal_demands(_demands(spark, d))
    sums = monitor.reports_to_requests(reports, groups).groupBy("request_id").agg(
        F.count(F.lit(1)).alias("reports"), F.sum("n").alias("n"), F.sum("report_ms").alias("report_sum")
    )
    return monitor.for_members(sums, members)


@query(
    "jn8_minimum_rates",
    with_ctes(
        f"""select request_id, cast(split_part(obsrate_min, '/', 1) as bigint) * 1000.0::double / {HOUR} as min_per_s from req
        where obsrate_min is not null and obsrate_max is null""",
        "req",
    ),
)
def _(spark, d):
    return monitor.minimum_rates(fx.requests(spark, d))


@query(
    "st11_count_by_request",
    with_ctes(f"""with {DEMANDS} select request_id, h as "window", n from need join daily using (stage_id)""", "obs", "req"),
)
def _(spark, d):
    counts, _, members = _windows(spark, d)
    return monitor.for_members(counts, members)


@query(
    "st11_count_from_reports",
    with_ctes(f"""with {DEMANDS} select request_id, h as "window", n from need join daily using (stage_id)""", "obs", "req"),
)
def _(spark, d):
    groups, members = monitor.equal_demands(_demands(spark, d))
    counts = monitor.reports_to_requests(_reports(spark, d, STEP), groups)
    return monitor.for_members(monitor.count_by_window(counts, groups, STEP), members)


def _symptoms(spark, d, **options):
    counts, groups, members = _windows(spark, d)
    return monitor.for_members(monitor.window_violations(counts, groups, step_ms=STEP, **options), members)


@query(
    "st7_min_rate_violations",
    with_ctes(f'with {SYMPTOMS} select request_id, "window", symptom_ms from symptoms', "obs", "req"),
)
def _(spark, d):
    return _symptoms(spark, d)


@query(
    "st7_consecutive_violations",
    with_ctes(
        f"""with {DEMANDS}, {GRID} select request_id, h as "window", {START} + (h + 1) * {STEP} as symptom_ms from runs
        where short qualify row_number() over (partition by request_id, good, short order by h) % 2 = 0""",
        "obs", "req",
    ),
)
def _(spark, d):
    return _symptoms(spark, d, consecutive=True)


HOURLY = f"""{DEMANDS}, hourly as (select stage_id, (date_ms - {START}) // {HOUR} as h, count(*) as n from staged
      where date_ms >= {START} and date_ms < {AS_OF} group by 1, 2)"""


@query(
    "st11_count_by_hour",
    with_ctes(
        f"""with {HOURLY} select request_id, count(*) as windows, cast(sum(n) as bigint) as n,
          cast(sum(h * n) as bigint) as weighted from need join hourly using (stage_id) group by 1""",
        "obs", "req",
    ),
)
def _(spark, d):
    """Hourly counts of every request, from one-second reports, summed by request."""
    counts, _, members = _windows(spark, d, HOUR)
    weighted = F.sum(F.col("window") * F.col("n")).alias("weighted")
    sums = counts.groupBy("request_id").agg(F.count(F.lit(1)).alias("windows"), F.sum("n").alias("n"), weighted)
    return monitor.for_members(sums, members)


@query(
    "st7_violations_by_hour",
    with_ctes(
        f"""with {HOURLY}, grid as (select request_id, h, coalesce(n, 0) < per_s * {HOUR} / 1000.0::double as short
            from need cross join range(0, ({AS_OF} - {START}) // {HOUR}) as r(h) left join hourly using (stage_id, h)),
          runs as (select *, sum(cast(short as int)) over (partition by request_id order by h) as s from grid)
        select request_id, count(*) as symptoms, cast(sum(h) as bigint) as window_sum,
          min({START} + (h + 1) * {HOUR}) as first_ms, max({START} + (h + 1) * {HOUR}) as last_ms
        from runs where short and s % 2 = 0 group by 1""",
        "obs", "req",
    ),
)
def _(spark, d):
    """Symptoms of hourly windows, summed by request."""
    counts, groups, members = _windows(spark, d, HOUR)
    symptoms = monitor.window_violations(counts, groups, step_ms=HOUR)
    sums = symptoms.groupBy("request_id").agg(
        F.count(F.lit(1)).alias("symptoms"), F.sum("window").alias("window_sum"),
        F.min("symptom_ms").alias("first_ms"), F.max("symptom_ms").alias("last_ms"),
    )
    return monitor.for_members(sums, members)


def _buffered(spark, d):
    staged = _symptoms(spark, d).join(_demands(spark, d).select("request_id", "stage_id"), "request_id")
    return monitor.symptom_buffer(staged, symptoms_before_action=3, lifetime_ms=LIFE)


BUFFERED = (
    SYMPTOMS
    + f""", buffered as (select *, coalesce(symptom_ms - lag(symptom_ms, 2) over (partition by stage_id
      order by symptom_ms, request_id) <= {LIFE}, false) as act from symptoms)"""
)


@query(
    "st8_symptom_buffer",
    with_ctes(f"with {BUFFERED} select request_id, stage_id, symptom_ms, act from buffered", "obs", "req"),
)
def _(spark, d):
    return _buffered(spark, d).select("request_id", "stage_id", "symptom_ms", "act")


OBSERVE = 3 * DAY
DECISIONS = (
    BUFFERED
    + f""", acting as (select request_id as k, symptom_ms as t from buffered where act),
    tries(k, a) as (select k, min(t) from acting group by k union all
      select tries.k, (select min(t) from acting where acting.k = tries.k and t >= a + {OBSERVE}) from tries
      where a is not null),
    timeline as (select b.request_id, symptom_ms, a is not null as tried,
      lag(symptom_ms) over (partition by b.request_id order by symptom_ms) as before_ms,
      max(a) over (partition by b.request_id order by symptom_ms rows between unbounded preceding and 1 preceding) as healed
      from buffered b left join tries on k = b.request_id and a = symptom_ms),
    epochs as (select *, sum(case when healed is not null and symptom_ms > greatest(healed + {OBSERVE}, before_ms + {LIFE})
      then 1 else 0 end) over (partition by request_id order by symptom_ms) as epoch from timeline),
    numbered as (select *, row_number() over (partition by request_id, epoch order by symptom_ms) as attempt
      from epochs where tried),
    helping as (select distinct remedy, param, type, min, max, initial, attribute, param_variation, attribute_variation
      from effects where attribute = 'OBS_RATE' and attribute_variation = 'HIGH'),
    best as (select * from (select *, true as g from ({REMEDIES}) order by remedy, param, type, param_variation limit 1)
      union all select * from (select *, false as g from helping order by remedy, param, type, param_variation limit 1)),
    remedied as (select request_id, stage_id, need.g, remedy, param, type, initial, param_variation
      from need left join best on need.g = best.g),
    judged as (select *, remedy is null or attempt > 3 as ended from numbered join remedied using (request_id)),
    open as (select *, coalesce(bool_or(ended) over (partition by request_id order by symptom_ms
      rows between unbounded preceding and 1 preceding), false) as closed from judged),
    decisions as (select request_id, symptom_ms as decided_ms, cast(attempt as int) as attempt,
      case when not ended then 'HEAL' when remedy is null then 'NO_REMEDY' else 'GIVE_UP' end as decision,
      case when not ended then 'HEALED' when g then 'REMOVED' else 'ENFORCED' end as status,
      case when not ended then remedy end as remedy, case when not ended then param end as param,
      case when not ended then case when type = 'Integer' then cast(cast(initial as bigint)
        + case param_variation when 'HIGH' then 1 when 'LOW' then -1 else 0 end * (attempt - 1) as varchar)
        else initial end end as value
      from open where not closed)"""
)


def _symptom_log(spark, d):
    """The symptoms as a written table, as the control loop keeps them; healing reads it several times."""
    path = f"{scratch(spark)}/symptoms-{uuid.uuid4().hex}"
    _buffered(spark, d).write.parquet(path)
    return spark.read.parquet(path)


def _decisions(spark, d, symptoms):
    demands = _demands(spark, d)
    chosen = remedies.remedy_of_requests(fx.remedy_catalogue(spark, d), fx.attribute_targets(spark), demands)
    return monitor.heal_decisions(
        symptoms, demands, chosen, observe_ms=OBSERVE, max_retries=3, lifetime_ms=LIFE
    )


@query(
    "st9_heal_decisions",
    with_ctes(f"with {DECISIONS} select * from decisions", "obs", "req", "effects", recursive=True),
)
def _(spark, d):
    return _decisions(spark, d, _symptom_log(spark, d))


# From day 14 on another remedy, which may be tried although the first one's retries are used up; from day 24 on none
CHANGED, ENDED = START + 14 * DAY, START + 24 * DAY
CHANGING = (
    DECISIONS.replace(
        "judged as (select *, remedy is null or attempt > 3 as ended from numbered join remedied using (request_id))",
        f"""dated as (select numbered.*, stage_id, g, symptom_ms >= {CHANGED} as later,
      case when symptom_ms >= {ENDED} then null when later then 'RemedySmooth' else remedy end as remedy,
      case when later then 'level' else param end as param, case when later then 'Integer' else type end as type,
      case when later then '7' else initial end as initial, case when later then 'LOW' else param_variation end as param_variation
      from numbered join remedied using (request_id)),
    judged as (select *, remedy is null or (attempt > 3 and nth > 1) as ended from
      (select *, row_number() over (partition by request_id, epoch, remedy order by symptom_ms) as nth from dated))""",
    ).replace("* (attempt - 1)", "* (nth - 1)")
)


def _changing(spark, d):
    """Remedies of each request with the time from which on they hold."""
    demands = _demands(spark, d)
    chosen = remedies.remedy_of_requests(fx.remedy_catalogue(spark, d), fx.attribute_targets(spark), demands)
    fields = ("remedy", "param", "type", "initial", "param_variation")
    first = chosen.select("request_id", F.lit(START).cast("bigint").alias("since_ms"), *fields)
    smooth = [F.lit(v).alias(f) for f, v in zip(fields, ("RemedySmooth", "level", "Integer", "7", "LOW"))]
    second = demands.select("request_id", F.lit(CHANGED).cast("bigint").alias("since_ms"), *smooth)
    none = [F.lit(None).cast("string").alias(f) for f in fields]
    return first.unionByName(second).unionByName(demands.select("request_id", F.lit(ENDED).cast("bigint").alias("since_ms"), *none))


@query(
    "st9_heal_with_changing_remedies",
    with_ctes(f"with {CHANGING} select * from decisions", "obs", "req", "effects", recursive=True),
)
def _(spark, d):
    return monitor.heal_decisions(
        _symptom_log(spark, d), _demands(spark, d), _changing(spark, d), observe_ms=OBSERVE, max_retries=3, lifetime_ms=LIFE
    )


@query(
    "jn7_remedy_of_requests",
    with_ctes(
        f"""with {DECISIONS} select request_id, remedy, param, initial, param_variation from remedied
        where remedy is not null""",
        "obs", "req", "effects", recursive=True,
    ),
)
def _(spark, d):
    chosen = remedies.remedy_of_requests(fx.remedy_catalogue(spark, d), fx.attribute_targets(spark), _demands(spark, d))
    return chosen.select("request_id", "remedy", "param", "initial", "param_variation")


@query(
    "st10_stable_requests",
    with_ctes(
        f"""with {DECISIONS}, heals as (select request_id, stage_id, decided_ms as heal_ms from decisions
          join need using (request_id) where decision = 'HEAL'),
        disturbed as (select distinct h.stage_id, h.heal_ms from (select distinct stage_id, heal_ms from heals) h
          join (select distinct stage_id, symptom_ms from symptoms) s on s.stage_id = h.stage_id
            and symptom_ms > heal_ms and symptom_ms <= heal_ms + {DAY})
        select stage_id, request_id, heal_ms, heal_ms + {DAY} as stable_ms from heals
        where (stage_id, heal_ms) not in (select (stage_id, heal_ms) from disturbed)""",
        "obs", "req", "effects", recursive=True,
    ),
)
def _(spark, d):
    log = _symptom_log(spark, d)
    heals = (
        _decisions(spark, d, log)
        .where(F.col("decision") == "HEAL")
        .join(_demands(spark, d).select("request_id", "stage_id"), "request_id")
        .select("request_id", "stage_id", F.col("decided_ms").alias("heal_ms"))
    )
    return monitor.stable_requests(heals, log.select("stage_id", "symptom_ms"), observe_ms=DAY)
