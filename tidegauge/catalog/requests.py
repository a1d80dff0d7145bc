"""Checked queries: requests, their history, matching, sharing and topology."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidegauge.catalog.base import AS_OF, FIXED_ACCURACY, query, with_ctes
from tidegauge.functions.clock import epoch_ms
from tidegauge.operators import enrich, lifecycle, ordering, rates
from tidegauge.operators import requests as rq
from tidegauge.plans import chain, stages
from tidegauge.schema import Compat
from tidegauge.sources import fixtures as fx
from tidegauge.sources import observations, sinks
from tidegauge.sources import requests as docs
from tidegauge.sources.observations import union_topics
from tidegauge.streaming import mechanisms

STATE_ROWS = """states as (select *, row_number() over (partition by request_id order by seq) as nr,
    lead(start_ms) over (partition by request_id order by seq) as next_ms from steps)"""
PARAMS = """case when threshold_min is not null then 'threshold_min=-50.0;' else '' end
    || case when threshold_max is not null then 'threshold_max=120.0;' else '' end
    || case when obsrate_max is not null then 'obsRate_max=' || obsrate_max || ';' else '' end
    || case when obsrate_min is not null then 'obsRate_min=' || obsrate_min || ';' else '' end"""
WISHES = "case when sla_level = 'GUARANTEED' then 'OBS_ACCURACY;OBS_FRESHNESS' else 'OBS_RATE' end"


def _state(status: str, start: int, end: int) -> str:
    return f"{{'status': '{status}', 'start_date': created_ms + {start}, 'end_date': created_ms + {end}}}"


STATES = f"""case when area = 'ATLANTIS' then [{_state('CREATED', 0, 1000)}, {_state('REJECTED', 1000, 1000)}]
    when order_status = 'F' then [{_state('CREATED', 0, 1000)}, {_state('SUBMITTED', 1000, 2000)},
      {_state('ENFORCED', 2000, 3000)}, {_state('HEALED', 3000, 4000)}, {_state('REMOVED', 4000, 4000)}]
    else [{_state('CREATED', 0, 1000)}, {_state('SUBMITTED', 1000, 2000)}, {_state('ENFORCED', 2000, 2000)}] end"""
LOGS = ("(created_ms + 1000) || ': Looked up: sensors.'", "created_ms || ': Request received.'")


def _params_text(column="params"):
    parts = F.transform(F.map_entries(column), lambda e: F.concat(e["key"], F.lit("="), e["value"], F.lit(";")))
    return F.array_join(parts, "")


# Documents


@query(
    "src6_read_requests",
    with_ctes(
        f"""select request_id, application_id, topic, area as location, obs_level, {WISHES} as wishes,
          'NONE' as operator, sla_level, {PARAMS} as params, priority,
          list_reduce(list_transform(states, lambda s: s.status || ':' || s.start_date || ':' || s.end_date),
            lambda a, b: a || ';' || b) as states, {LOGS[0]} || ';' || {LOGS[1]} as logs
        from (select *, {STATES} as states from req)""",
        "req",
    ),
)
def _(spark, d):
    stored = fx.request_table(spark, d).select(docs.request_document().alias("document"))
    back = docs.parse_requests(stored)
    return back.select(
        "request_id", "application_id", "topic", "location", "obs_level",
        F.array_join("interested_in", ";").alias("wishes"), "operator", "sla_level",
        _params_text().alias("params"), F.col("custom_params")["priority"].alias("priority"),
        F.array_join(F.transform("states", lambda s: F.concat_ws(":", s["status"], s["start_date"], s["end_date"])), ";").alias("states"),
        F.array_join("logs", ";").alias("logs"),
    )


NOW = 1_700_000_000_000


@query(
    "src7_submit_requests",
    with_ctes(
        f"""select request_id, application_id, topic, area as location, obs_level,
          case when sla_level = 'GUARANTEED' then {WISHES} else '' end as wishes, 'NONE' as operator,
          case when sla_level = 'GUARANTEED' then 'GUARANTEED' else 'BEST_EFFORT' end as sla_level,
          case when sla_level = 'GUARANTEED' then {PARAMS} else '' end as params, 'CREATED' as status,
          {NOW}::bigint as start_date, '{NOW}: Request received.' as log
        from req where priority <> '5-LOW'""",
        "req",
    ),
)
def _(spark, d):
    accepted, _ = docs.submit_requests(fx.request_messages(spark, d), NOW, id_column="request_id")
    return accepted.select(
        "request_id", "application_id", "topic", "location", "obs_level",
        F.array_join("interested_in", ";").alias("wishes"), "operator", "sla_level",
        _params_text().alias("params"), F.col("states")[0]["status"].alias("status"),
        F.col("states")[0]["start_date"].alias("start_date"), F.col("logs")[0].alias("log"),
    )


@query(
    "src7_rejected_requests",
    with_ctes("select request_id, 'no topic' as reason from req where priority = '5-LOW'", "req"),
)
def _(spark, d):
    _, rejects = docs.submit_requests(fx.request_messages(spark, d), NOW, id_column="request_id")
    return rejects.select("request_id", "reason")


@query(
    "snk5_requests_to_documents",
    with_ctes(
        """select request_id, '{"request_id":"' || request_id || '","application_id":"' || application_id
          || '","topic":"' || topic || '","location":"' || area || '","obs_level":"' || obs_level
          || '","qoo":{"interested_in":' || case when sla_level = 'GUARANTEED' then '["OBS_ACCURACY","OBS_FRESHNESS"]'
          else '["OBS_RATE"]' end || ',"operator":"NONE","sla_level":"' || sla_level || '","platform_params":{'
          || array_to_string(list_filter([
            case when threshold_min is not null then '"threshold_min":"-50.0"' end,
            case when threshold_max is not null then '"threshold_max":"120.0"' end,
            '"obsRate_max":"' || obsrate_max || '"', '"obsRate_min":"' || obsrate_min || '"'],
            x -> x is not null), ',')
          || '},"custom_params":{"priority":"' || priority || '"}},"statesList":['
          || list_reduce(list_transform(states, lambda s: '{"status":"' || s.status || '","start_date":' || s.start_date
            || ',"end_date":' || s.end_date || '}'), lambda a, b: a || ',' || b)
          || '],"logs":["' || LOG0 || '","' || LOG1 || '"]}' as document
        from (select *, STATES as states from req)""".replace("x -> x", "lambda x: x")
        .replace("STATES as", f"{STATES} as").replace("LOG0", LOGS[0]).replace("LOG1", LOGS[1]),
        "req",
    ),
)
def _(spark, d):
    return fx.request_table(spark, d).select("request_id", docs.request_document().alias("document"))


@query(
    "snk4_upsert_requests",
    with_ctes(
        """select request_id, application_id, case when order_status = 'P' then 'KNOWLEDGE' else obs_level end as obs_level,
          case when order_status = 'P' then 2 else 1 end as version from req where order_status <> 'F'""",
        "req",
    ),
)
def _(spark, d):
    req = fx.requests(spark, d)
    current = req.select("request_id", "application_id", "obs_level", F.lit(1).alias("version"))
    replaced = req.where(F.col("order_status") == "P").select(
        "request_id", "application_id", F.lit("KNOWLEDGE").alias("obs_level"), F.lit(2).alias("version"),
        F.lit(False).alias("deleted"),
    )
    removed = req.where(F.col("order_status") == "F").select(
        "request_id", "application_id", "obs_level", F.lit(3).alias("version"), F.lit(True).alias("deleted")
    )
    return sinks.upsert(current, replaced.unionByName(removed))


# Look-ups


@query(
    "flt6_requests_by_application",
    with_ctes("select request_id, topic, obs_level from req where application_id = 'app3'", "req"),
)
def _(spark, d):
    return rq.requests_by(fx.requests(spark, d), "application_id", "app3").select("request_id", "topic", "obs_level")


@query(
    "flt6_specific_request",
    with_ctes("select request_id, application_id, topic from req where request_id = 'req77'", "req"),
)
def _(spark, d):
    return rq.single_request(fx.requests(spark, d), "req77").select("request_id", "application_id", "topic")


@query(
    "flt7_requests_by_app_status",
    with_ctes(
        """select request_id, max_by(status, seq) as status from steps where application_id = 'app1' group by 1
        having max_by(status, seq) in ('ENFORCED', 'REJECTED')""",
        "steps",
    ),
)
def _(spark, d):
    kept = rq.requests_by_app_status(fx.request_states(spark, d), "app1", ["ENFORCED", "REJECTED"])
    return kept.select("request_id", rq.current_status(F.col("states")).alias("status"))


@query(
    "flt8_was_in_state",
    with_ctes(
        """select request_id, bool_or(status = 'HEALED') as healed, bool_or(status = 'REJECTED') as rejected,
        min(start_ms) filter (where status = 'CREATED') as created from steps group by 1""",
        "steps",
    ),
)
def _(spark, d):
    states = F.col("states")
    return fx.request_states(spark, d).select(
        "request_id",
        rq.was_in_state(states, "HEALED").alias("healed"),
        rq.was_in_state(states, "REJECTED").alias("rejected"),
        rq.state_details(states, "CREATED")["start_date"].alias("created"),
    )


@query(
    "flt9_interested_requests",
    with_ctes("select request_id, sla_level from req where sla_level = 'GUARANTEED'", "req"),
)
def _(spark, d):
    return rq.interested_requests(fx.request_states(spark, d), "OBS_ACCURACY").select("request_id", "sla_level")


# State history


@query(
    "wn1_current_status",
    with_ctes("select request_id, max_by(status, seq) as status from steps group by 1", "steps"),
)
def _(spark, d):
    return fx.request_states(spark, d).select("request_id", rq.current_status(F.col("states")).alias("status"))


@query(
    "wn2_advance_state",
    with_ctes(
        f"""with {STATE_ROWS}
        select request_id, cast(seq as bigint) as position, status, start_ms as start_date,
          coalesce(next_ms, 1900000000000) as end_date from states
        union all select request_id, max(seq) + 1, 'REMOVED', 1900000000000, 1900000000000 from states group by 1""",
        "steps",
    ),
)
def _(spark, d):
    moved = rq.advance_state(F.col("states"), "REMOVED", 1_900_000_000_000)
    rows = fx.request_states(spark, d).select("request_id", F.posexplode(moved).alias("position", "s"))
    return rows.select("request_id", F.col("position").cast("bigint").alias("position"), "s.*")


@query(
    "wn2_history_from_events",
    with_ctes(
        f"""with {STATE_ROWS} select request_id, seq, status, start_ms, coalesce(next_ms, start_ms) as end_ms
        from states""",
        "steps",
    ).replace("select request_id, seq, status, start_ms, coalesce", "select request_id, cast(seq as int) as seq, status, start_ms, coalesce"),
)
def _(spark, d):
    return rq.history_from_events(fx.request_events(spark, d)).drop("application_id")


@query(
    "wn3_state_durations",
    with_ctes(
        f"""with {STATE_ROWS} select request_id, cast(seq as int) as seq, status,
        coalesce(next_ms - start_ms, 0) as duration_ms from states""",
        "steps",
    ),
)
def _(spark, d):
    return rq.state_durations(fx.request_states(spark, d))


@query(
    "wn5_prepend_log",
    with_ctes(
        """select request_id, '1900000000000: Removed.' as newest, 3 as n,
        cast(created_ms as varchar) || ': Request received.' as oldest from req""",
        "req",
    ),
)
def _(spark, d):
    logs = rq.prepend_log(F.col("logs"), "Removed.", 1_900_000_000_000)
    rows = fx.request_states(spark, d).select("request_id", logs.alias("logs"))
    return rows.select(
        "request_id", F.col("logs")[0].alias("newest"), F.size("logs").alias("n"), F.element_at("logs", -1).alias("oldest")
    )


@query("wn6_request_start", with_ctes("select request_id, created_ms as start_ms from req", "req"))
def _(spark, d):
    return fx.request_states(spark, d).select("request_id", rq.request_start(F.col("logs")).alias("start_ms"))


@query(
    "wn8_list_requests",
    with_ctes(
        "select request_id, application_id, created_ms as start_ms from req order by created_ms desc, request_id", "req"
    ),
)
def _(spark, d):
    return rq.list_requests(fx.request_states(spark, d)).select("request_id", "application_id", "start_ms")


@query(
    "rq7_apply_lifecycle",
    with_ctes(
        """select request_id, cast(seq as int) as seq, status,
          lag(status) over (partition by request_id order by seq) as previous,
          coalesce(status = 'CREATED' or (lag(status) over (partition by request_id order by seq), status) in (
            ('CREATED', 'SUBMITTED'), ('CREATED', 'REJECTED'), ('SUBMITTED', 'ENFORCED'), ('ENFORCED', 'HEALED'),
            ('HEALED', 'REMOVED')), false) as valid from bent""",
        "steps",
    ).replace(
        " select request_id, cast(seq as int)",
        ", bent as (select * from steps where not (status = 'SUBMITTED' and application_id = 'app2')) "
        "select request_id, cast(seq as int)",
        1,
    ),
)
def _(spark, d):
    # Requests of one application skip SUBMITTED, which is not allowed.
    events = fx.request_events(spark, d)
    bent = events.where(~((F.col("status") == "SUBMITTED") & (F.col("application_id") == "app2")))
    return rq.apply_lifecycle(bent).select("request_id", "seq", "status", "previous", "valid")


# Matching, admission, sharing


MATCH = """select topic, area, sensor_id from (select distinct topic, area from req) r
    join (select sensor_id, topic as s_topic, area as s_area from sens) s
    on (topic = 'ALL' or topic = s_topic) and (area = 'ALL' or area = s_area)"""


@query("jn3_match_requests_to_sensors", with_ctes(MATCH, "req", "sens"))
def _(spark, d):
    return rq.match_requests_to_sensors(fx.requests(spark, d), fx.sensors(spark, d))


@query(
    "jn3_match_any_known_place",
    with_ctes(
        """select topic, area, sensor_id from (select distinct topic, area from req) r
        join (select sensor_id, topic as s_topic from sens) s
        on (topic = 'ALL' or topic = s_topic) and (area = 'ALL' or area in (select area from sens))""",
        "req", "sens",
    ),
)
def _(spark, d):
    compat = rq.Compat(any_known_place=True)
    return rq.match_requests_to_sensors(fx.requests(spark, d), fx.sensors(spark, d), compat)


@query(
    "jn4_admit_requests",
    with_ctes(
        f"""select request_id, case when m.topic is not null then 'SUBMITTED' else 'REJECTED' end as status,
          case when m.topic is not null then 'Sensors are known for (' || r.topic || ' / ' || r.area
            || ')'
          else 'Rejected, as no sensor serves (' || r.topic || ' / ' || r.area || ')' end as log
        from req r left join (select distinct topic, area from ({MATCH})) m on r.topic = m.topic and r.area = m.area""",
        "req", "sens",
    ),
)
def _(spark, d):
    return rq.admit_requests(fx.requests(spark, d), fx.sensors(spark, d)).select("request_id", "status", "log")


SHARED = """shared as (select n.request_id, f.request_id as shared_with from req n left join (
      select *, row_number() over (partition by topic, area, obs_level, sla_level, threshold_min, threshold_max,
        obsrate_max, obsrate_min, priority order by created_ms, request_id) as nr from req where status = 'ENFORCED') f
      on nr = 1 and n.topic = f.topic and n.area = f.area and n.obs_level = f.obs_level and n.sla_level = f.sla_level
      and n.threshold_min is not distinct from f.threshold_min and n.threshold_max is not distinct from f.threshold_max
      and n.obsrate_max is not distinct from f.obsrate_max and n.obsrate_min is not distinct from f.obsrate_min
      and n.priority = f.priority where n.status = 'SUBMITTED')"""


@query("jn5_find_shared_requests", with_ctes(f"with {SHARED} select * from shared", "req"))
def _(spark, d):
    return rq.find_shared_requests(fx.request_table(spark, d))


@query(
    "set3_request_diff",
    with_ctes(
        """select request_id, array_to_string(list_filter([
          case when obs_level <> 'KNOWLEDGE' then 'obs_level' end,
          case when sla_level = 'BEST_EFFORT' then 'interested_in' end,
          case when sla_level = 'BEST_EFFORT' then 'sla_level' end,
          case when priority <> '1-URGENT' then 'custom_params' end], lambda x: x is not null), ';') as changed from req""",
        "req",
    ),
)
def _(spark, d):
    old = fx.request_table(spark, d)
    new = old.withColumns(
        {
            "obs_level": F.lit("KNOWLEDGE"),
            "interested_in": F.array(F.lit("OBS_ACCURACY"), F.lit("OBS_FRESHNESS")),
            "sla_level": F.lit("GUARANTEED"),
            "custom_params": F.create_map(F.lit("priority"), F.lit("1-URGENT")),
            "params": F.map_from_entries(F.reverse(F.map_entries("params"))),
        }
    )
    diff = rq.request_diff(old, new)
    return diff.select("request_id", F.array_join("changed", ";").alias("changed"))


@query(
    "set4_registry_diff",
    with_ctes(
        """select coalesce(a.request_id, b.request_id) as request_id, case when a.request_id is null then 'NEW'
          when b.request_id is null then 'MISSING' else 'CHANGED' end as change
        from (select * from req where order_status <> 'P') a full join (select * from req where order_status <> 'F') b
          using (request_id) where a.request_id is null or b.request_id is null or a.topic = 'ALL'""",
        "req",
    ),
)
def _(spark, d):
    req = fx.requests(spark, d).drop("created_ms")
    old = req.where(F.col("order_status") != "P")
    new = req.where(F.col("order_status") != "F").withColumn(
        "topic", F.when(F.col("topic") == "ALL", F.lit("any")).otherwise(F.col("topic"))
    )
    return rq.registry_diff(old, new, "request_id")


# Stages and topology


STAGES = """stages as (select *, len(listed) as n, unnest(range(len(listed))) as pos,
      unnest(listed) as stage from (select *, list_filter(['ingest',
        case when threshold_min is not null or threshold_max is not null then 'threshold' end,
        case when obsrate_max is not null then 'throttle' end, 'output'], lambda x: x is not null) as listed from req))"""
EDGES = (
    STAGES
    + """, edges as (select request_id, application_id,
      case when pos = 0 then topic when pos = 1 then sel else sink || '_QOO' || cast(pos - 1 as varchar) end as parent,
      case when pos = n - 1 then sink when pos = 0 then sel else sink || '_QOO' || cast(pos as varchar) end as child,
      stage, cast(pos + 1 as int) as level, pos = 0 as is_source, false as is_heal, pos = n - 1 as is_sink
      from (select *, concat(application_id, '_', request_id) as sink, concat(topic, '_', area, '_',
        case obs_level when 'INFORMATION' then 'INFO' when 'KNOWLEDGE' then 'KNOW' else 'RD' end) as sel from stages))"""
)


@query(
    "rq1_request_stages",
    with_ctes(f"with {STAGES} select request_id, cast(pos as int) as position, stage from stages", "req"),
)
def _(spark, d):
    return lifecycle.request_stages(fx.requests(spark, d))


@query("rq2_stage_edges", with_ctes(f"with {EDGES} select * from edges", "req"))
def _(spark, d):
    return lifecycle.stage_edges(fx.requests(spark, d))


@query(
    "rq2_stage_edges_all_topics",
    with_ctes(
        f"""with {EDGES} select e.request_id, e.application_id, coalesce(t.topic, e.parent) as parent, child, stage,
        level, is_source, is_heal, is_sink from edges e left join (select distinct topic from sens) t
        on e.parent = 'ALL'""",
        "req", "sens",
    ),
)
def _(spark, d):
    topics = fx.sensors(spark, d).select("topic").distinct()
    return lifecycle.stage_edges(fx.requests(spark, d), topics)


@query(
    "src8_read_mappings",
    with_ctes(
        f"""with {EDGES} select request_id, application_id, parent, child, stage, level, is_source, is_heal, is_sink
        from edges""",
        "req",
    ),
)
def _(spark, d):
    documents = docs.mapping_documents(lifecycle.stage_edges(fx.requests(spark, d)))
    return docs.parse_mappings(documents).drop("constructed_from")


SHARED_EDGES = EDGES + ", " + SHARED + """, last as (select request_id as shared_with, parent as from_topic from edges
      where is_sink), after as (select e.request_id, application_id,
      case when s.shared_with is null then parent else from_topic end as parent, child, stage,
      case when s.shared_with is null then level else 1 end as level,
      case when s.shared_with is null then is_source else true end as is_source, is_heal, is_sink,
      s.shared_with as constructed_from from edges e left join shared s using (request_id)
      left join last using (shared_with) where s.shared_with is null or is_sink)"""


def _shared(spark, d):
    shared = rq.find_shared_requests(fx.request_table(spark, d))
    return lifecycle.stage_edges(fx.requests(spark, d)), shared


@query("rq3_shared_edges", with_ctes(f"with {SHARED_EDGES} select * from after", "req"))
def _(spark, d):
    return lifecycle.shared_edges(*_shared(spark, d))


# Whoever reads a topic uses the stages that lead to it, up to the sources
USERS = """, uses as (select distinct request_id, child as topic from {edges}
      union select u.request_id, e.parent from uses u join {edges} e on u.topic = e.child),
    users as (select distinct e.parent, e.child, e.stage, u.request_id from {edges} e join uses u on u.topic = e.child)"""


@query(
    "rq4_stage_usage",
    with_ctes(
        f"""with {SHARED_EDGES}{USERS.format(edges="after")}
        select parent, child, stage, count(distinct request_id) as uses from users group by 1, 2, 3""",
        "req", recursive=True,
    ),
)
def _(spark, d):
    return lifecycle.stage_usage(lifecycle.shared_edges(*_shared(spark, d)))


# Each request shares the one before it that asks the same: lines of three
LINES = """lines as (select request_id, lag(request_id) over (partition by topic, area, obs_level, threshold_min, threshold_max,
      obsrate_max order by request_id) as shared_with from req),
    up as (select request_id, shared_with, 1 as steps from lines where shared_with is not null
      union all select u.request_id, l.shared_with, steps + 1 from up u join lines l on u.shared_with = l.request_id
      where l.shared_with is not null),
    roots as (select request_id, arg_max(shared_with, steps) as root from up group by request_id),
    last as (select request_id as root, parent as from_topic from edges where is_sink),
    after as (select e.request_id, application_id, coalesce(from_topic, parent) as parent, child, stage,
      case when root is null then level else 1 end as level, root is not null or is_source as is_source, is_heal, is_sink,
      shared_with as constructed_from from edges e join lines using (request_id) left join roots using (request_id)
      left join last using (root) where root is null or is_sink)"""


def _lines(spark, d):
    req = fx.requests(spark, d)
    equal = Window.partitionBy("topic", "area", "obs_level", "threshold_min", "threshold_max", "obsrate_max")
    shared = req.select("request_id", F.lag("request_id").over(equal.orderBy("request_id")).alias("shared_with"))
    return lifecycle.shared_edges(lifecycle.stage_edges(req), shared)


@query("rq3_shared_edges_in_line", with_ctes(f"with {EDGES}, {LINES} select * from after", "req", recursive=True))
def _(spark, d):
    return _lines(spark, d)


@query(
    "rq4_releasable_shared",
    with_ctes(
        f"""with {EDGES}, {LINES}{USERS.format(edges="after")} select parent, child, stage from users join req using (request_id)
        group by 1, 2, 3 having count(*) filter (where order_status <> 'F') = 0""",
        "req", recursive=True,
    ),
)
def _(spark, d):
    return lifecycle.releasable_stages(_lines(spark, d), fx.requests(spark, d).where(F.col("order_status") == "F"))


@query(
    "rq4_releasable_stages",
    with_ctes(
        f"""with {EDGES} select parent, child, stage from edges join req using (request_id) group by 1, 2, 3
        having count(*) filter (where order_status <> 'F') = 0""",
        "req",
    ),
)
def _(spark, d):
    req = fx.requests(spark, d)
    return lifecycle.releasable_stages(lifecycle.stage_edges(req), req.where(F.col("order_status") == "F"))


def _healed(spark, d):
    req = fx.requests(spark, d)
    heals = req.where(F.col("application_id") == "app4").select("request_id", F.lit("RemedyClone").alias("remedy"))
    return lifecycle.insert_heal_stage(lifecycle.stage_edges(req), heals)


@query(
    "rq5_insert_heal_stage",
    with_ctes(
        f"""with {EDGES}, marked as (select *, is_sink and application_id = 'app4' as heal,
          concat(application_id, '_', request_id, '_RemedyClone') as mid from edges)
        select request_id, application_id, parent, case when heal then mid else child end as child, stage, level,
          is_source, heal as is_heal, is_sink and not heal as is_sink from marked
        union all select request_id, application_id, mid, child, 'RemedyClone', level + 1, false, false, true
          from marked where heal""",
        "req",
    ),
)
def _(spark, d):
    return _healed(spark, d)


@query("rq5_remove_heal_stage", with_ctes(f"with {EDGES} select * from edges", "req"))
def _(spark, d):
    return lifecycle.remove_heal_stage(_healed(spark, d))


@query(
    "rq6_downstream_of",
    with_ctes(
        f"""with {EDGES} select request_id, child as topic, level from edges where level > 1""", "req"
    ),
)
def _(spark, d):
    edges = lifecycle.stage_edges(fx.requests(spark, d))
    starts = edges.where("is_source").select("request_id", F.col("child").alias("topic"))
    return lifecycle.downstream_of(edges, starts)


@query(
    "rq8_dependents",
    with_ctes(
        f"""with {SHARED} select shared_with as request_id, request_id as dependent_request from shared
        where shared_with is not null""",
        "req",
    ),
)
def _(spark, d):
    return lifecycle.dependents(rq.find_shared_requests(fx.request_table(spark, d)))


# Enforcement


LIMIT_MS = 3_600_000


ENFORCED = f"""with chains as (select topic, area, threshold_min, threshold_max, obsrate_max, age_max,
            min(request_id) as chain_id from req group by 1, 2, 3, 4, 5, 6),
          routed as (select o.*, chain_id, obsrate_max, age_max from obs o join sens s on o.producer = s.sensor_id
            join chains c on (c.topic = 'ALL' or (c.topic = o.topic and o.topic = s.topic))
              and (c.area = 'ALL' or c.area = s.area)
            where o.value >= coalesce(threshold_min, '-infinity'::double)
              and o.value <= coalesce(threshold_max, 'infinity'::double)),
          anchors(chain_id, a) as (select chain_id, min(date_ms) from routed where obsrate_max is not null group by 1
            union all select chain_id, (select min(r.date_ms) from routed r where r.chain_id = anchors.chain_id
              and r.date_ms >= a + {LIMIT_MS}) from anchors where a is not null),
          ranked as (select r.*, row_number() over (partition by r.chain_id, x.a order by date_ms, obs_id) as nr
            from (select * from routed where obsrate_max is not null) r asof join
              (select * from anchors where a is not null) x on r.chain_id = x.chain_id and r.date_ms >= x.a),
          passed as (select chain_id, obs_id, producer, date_ms, value, age_max from ranked where nr <= 2
            union all select chain_id, obs_id, producer, date_ms, value, age_max from routed where obsrate_max is null)"""


@query(
    "jn9_enforce_requests",
    with_ctes(
        f"""{ENFORCED}
        select chain_id, obs_id, producer, date_ms, value, {FIXED_ACCURACY} as obs_accuracy,
          cast({AS_OF} - date_ms as double) as obs_freshness from passed left join bounds using (producer)
        where age_max = 'unset' or {AS_OF} - date_ms < 259200000""",
        "obs", "sens", "req", "bounds",
        recursive=True,
    ),
)
def _(spark, d):
    rows = chain.enforce_requests(
        fx.observations(spark, d), fx.requests(spark, d), fx.sensors(spark, d), fx.capabilities(spark, d), fx.AS_OF_MS
    )
    return rows.select(
        "chain_id", "obs_id", "producer", F.unix_millis("date").alias("date_ms"), "value", "obs_accuracy", "obs_freshness"
    )


@query(
    "jn9_chain_members",
    with_ctes(
        """select request_id, min(request_id) over (partition by topic, area, threshold_min, threshold_max, obsrate_max,
        age_max) as chain_id from req""",
        "req",
    ),
)
def _(spark, d):
    return chain.chain_members(fx.requests(spark, d))


SENSOR_NUMBER = "cast(substr(producer, 7) as bigint)"
DELIVERED = f"""{ENFORCED}, delivered as (
    select chain_id, obs_id, producer, date_ms, value, cast({FIXED_ACCURACY} as double) as accuracy, latitude
    from passed left join bounds using (producer) join sens on producer = sensor_id
    where age_max = 'unset' or {AS_OF} - date_ms < 259200000),
  members as (select *, min(request_id) over (partition by topic, area, threshold_min, threshold_max, obsrate_max,
    age_max) as own_chain, sla_level = 'GUARANTEED' as g, obs_level <> 'KNOWLEDGE' as plain from req)
  select request_id, concat(application_id, '_', request_id) as delivery_topic, obs_level, count(*) as n,
    cast(sum(date_ms) as bigint) as produced_sum, cast(sum(floor(value * 1000)) as bigint) as value_sum,
    cast(sum({SENSOR_NUMBER}) as bigint) as producer_sum, count(*) filter (g) as scored,
    cast(sum(case when g and plain then floor(accuracy * 1000) end) as bigint) as accuracy_sum,
    cast(sum(case when g and plain then {AS_OF} - date_ms end) as bigint) as freshness_sum,
    cast(sum(case when obs_level = 'INFORMATION' then cast(latitude as bigint) end) as bigint) as latitude_sum,
    count(*) filter (obs_level = 'KNOWLEDGE') as with_nodes
  from delivered join members on own_chain = chain_id group by request_id, application_id, obs_level"""


@query("jn9_deliver_requests", with_ctes(DELIVERED, "obs", "sens", "req", "bounds", recursive=True))
def _(spark, d):
    """What each request receives at its own level, from the fields of the texts delivered to it."""
    obs, sensors = fx.observations(spark, d), fx.sensors(spark, d)
    wishes = fx.request_states(spark, d).select("request_id", "interested_in")
    req = fx.requests(spark, d).join(wishes, "request_id")
    chains = chain.enforce_requests(obs, req, sensors, fx.capabilities(spark, d), fx.AS_OF_MS)
    nodes = F.col("obs_level") == "KNOWLEDGE"

    def having(text: str):
        return F.contains("message", F.lit(text)).cast("bigint")

    parsed = F.try_parse_json(F.when(~nodes, F.col("message")))  # once for all fields

    def field(path: str, in_nodes: str | None = None):
        plain = F.try_variant_get(parsed, path, "string")
        if in_nodes is None:
            return plain
        return F.when(nodes, F.regexp_extract("message", f'"{in_nodes}":"([^"]*)', 1)).otherwise(plain)

    def thousandths(number):
        return F.floor(number.try_cast("double") * 1000)

    trail = field("$.timestamps", "obsTimestampsValue")
    producer = F.substring_index(field("$.producer", "observedBy"), "sensor", -1)
    totals = {
        "n": F.lit(1).cast("bigint"),
        "produced_sum": F.substring_index(F.substring_index(trail, ";", 1), ":", -1).try_cast("bigint"),
        "value_sum": thousandths(field("$.value", "obsStrValue")),
        "producer_sum": producer.try_cast("bigint"),
        "scored": having("OBS_ACCURACY"),
        "accuracy_sum": thousandths(field("$.qoOAttributeValues.OBS_ACCURACY")),
        "freshness_sum": field("$.qoOAttributeValues.OBS_FRESHNESS").try_cast("double"),
        "latitude_sum": field("$.sensorContext.latitude").try_cast("bigint"),
        "with_nodes": having('"@id"'),
    }
    sent = chain.deliver_requests(chains, req, sensors, fx.AS_OF_MS, totals=totals)
    return sent.withColumn("freshness_sum", F.col("freshness_sum").cast("bigint"))


# One request, from message text to delivered rows


def _run(spark, d, request, **options):
    messages = fx.messages(spark, d)
    return chain.run_request(
        observations.decode_observation(messages), request, fx.sensors(spark, d), fx.capabilities(spark, d), fx.AS_OF_MS, **options
    )


@query(
    "rq0_run_request_with_limit",
    with_ctes(
        """select producer, date_ms, value from (select o.*, row_number() over (partition by date_ms // 3600000
          order by date_ms, producer, value) as nr from obs o join sens on producer = sensor_id) where nr <= 2""",
        "obs", "sens",
    ),
)
def _(spark, d):
    """A request with a limit of its own, put in as a custom stage: windows from the epoch, ties by content."""
    registry = stages.StageRegistry()
    registry.register(
        "hourly",
        lambda df, params: rates.rate_limit(df, int(params["most"]), 3_600_000, tie=["producer", "value"], anchor="epoch"),
        params=(stages.StageParam("most", "Integer", "1"),),
    )
    request = {"topic": "ALL", "location": "ALL", "obs_level": "RAW_DATA", "custom_params": {"most": "2"}}
    rows = _run(spark, d, request, registry=registry, custom=[registry.use("hourly")])
    return rows.select("producer", F.unix_millis("date").alias("date_ms"), "value")


@query(
    "rq0_run_request_first_limit",
    with_ctes(
        """with chosen as (select distinct date_ms from obs join sens on producer = sensor_id),
          anchors(a) as (select min(date_ms) from chosen union all
            select (select min(date_ms) from chosen where date_ms >= a + 3600000) from anchors where a is not null)
        select a as date_ms, 1 as n from anchors where a is not null""",
        "obs", "sens", recursive=True,
    ),
)
def _(spark, d):
    """Every message of a limited request that opens a window: the limit runs without an id column."""
    rows = _run(spark, d, {"topic": "ALL", "location": "ALL", "obs_level": "RAW_DATA", "params": {"obsRate_max": "1/hour"}})
    return rows.groupBy(F.unix_millis("date").alias("date_ms")).agg(F.count(F.lit(1)).cast("int").alias("n"))


@query(
    "rq0_run_request_positive_minimum",
    with_ctes(
        "select o.producer, date_ms, value from obs o join sens on o.producer = sensor_id where value > 0 and value <= 120",
        "obs", "sens",
    ),
)
def _(spark, d):
    request = {"topic": "ALL", "location": "ALL", "obs_level": "RAW_DATA", "params": {"threshold_max": "120.0"}}
    rows = _run(spark, d, request, compat=Compat(positive_default_min=True))
    return rows.select("producer", F.unix_millis("date").alias("date_ms"), "value")


@query(
    "ud1_custom_parameter",
    with_ctes(
        "select o.producer, date_ms, value * 4.0::double as value from obs o join sens on o.producer = sensor_id", "obs", "sens"
    ),
)
def _(spark, d):
    """A stage of the application's own, with the factor that the request sets in its custom parameters."""
    registry = stages.StageRegistry()
    registry.register(
        "scale",
        lambda df, params: df.withColumn("value", F.col("value") * F.lit(float(params["factor"]))),
        params=(stages.StageParam("factor", "Double", "2.0"),),
    )
    request = {"topic": "ALL", "location": "ALL", "obs_level": "RAW_DATA", "custom_params": {"factor": "4.0", "other": "1"}}
    rows = _run(spark, d, request, registry=registry, custom=[registry.use("scale")])
    return rows.select("producer", F.unix_millis("date").alias("date_ms"), "value")


# Stage settings


@query(
    "ud5_stage_settings",
    with_ctes(
        """select request_id, case when threshold_min is not null then '-50.0' else 'unset' end as threshold_min,
          case when threshold_max is not null then '120.0' else 'unset' end as threshold_max,
          coalesce(obsrate_max, 'unset') as obsrate_max, 3 as n from req""",
        "req",
    ),
)
def _(spark, d):
    defaults = {"threshold_min": "unset", "threshold_max": "unset", "obsRate_max": "unset"}
    rows = stages.stage_settings(fx.request_table(spark, d), defaults)
    settings = F.col("settings")
    return rows.select(
        "request_id", settings["threshold_min"].alias("threshold_min"), settings["threshold_max"].alias("threshold_max"),
        settings["obsRate_max"].alias("obsrate_max"), F.size("settings").alias("n"),
    )


@query(
    "ud1_custom_stage",
    with_ctes(
        """select obs_id, topic, producer, date_ms, value * 2.0 as value from obs
        where value >= -50.0 and value * 2.0 <= 300.0""",
        "obs",
    ),
)
def _(spark, d):
    registry = stages.StageRegistry()
    registry.register(
        "scaling",
        lambda df, p: df.withColumn("value", F.col("value") * float(p["factor"])).where(
            F.col("value") <= float(p["most"])
        ),
        params=[stages.StageParam("factor", "Double", "1.0"), stages.StageParam("most", "Double", "300.0", False)],
        adaptable=True,
    )
    custom = registry.use("scaling")
    custom.set_param("factor", "2.0")
    custom.set_param("most", "0.0")
    obs = fx.observations(spark, d)
    for settings in registry.chain({"threshold_min": "-50.0"}, [custom]):
        obs = settings.apply(obs)
    return obs.select("obs_id", "topic", "producer", F.unix_millis("date").alias("date_ms"), "value")


@query(
    "ud2_register_attribute",
    with_ctes(
        """select obs_id, case when min_value is null or isinf(max_value - min_value) then 0.0
        else (value - min_value) / (max_value - min_value) end as obs_rate from obs left join bounds using (producer)""",
        "obs", "bounds",
    ),
)
def _(spark, d):
    registry = enrich.AttributeRegistry()
    width = F.col("max_value") - F.col("min_value")
    registry.register(
        "OBS_RATE",
        lambda df: F.when(width.isNull() | (width == float("inf")), F.lit(0.0)).otherwise(
            (F.col("value") - F.col("min_value")) / width
        ),
        ("value", "min_value", "max_value"),
    )
    obs = enrich.with_capability(fx.observations(spark, d), fx.capabilities(spark, d))
    return enrich.score(obs, ["OBS_RATE"], registry).select("obs_id", "obs_rate")


@query(
    "ud3_register_mechanism",
    with_ctes(
        """select obs_id, producer, date_ms from obs qualify
        lead(date_ms) over (partition by producer order by date_ms, obs_id) - date_ms > 43200000""",
        "obs",
    ),
)
def _(spark, d):
    def before_silence(df, keys, silence_ms):
        rows = df.withColumn("date_ms", epoch_ms(df, "date"))
        led = ordering.with_next(rows, "date_ms", keys, tie=("obs_id",), name="next_ms")
        return led.where(F.col("next_ms") - F.col("date_ms") > silence_ms)

    mechanism = mechanisms.MechanismRegistry().register("before_silence", before_silence)
    rows = mechanism(fx.observations(spark, d), keys=["producer"], silence_ms=43_200_000)
    return rows.select("obs_id", "producer", "date_ms")


@query(
    "set1_topic_union",
    with_ctes(
        "select obs_id, topic, value from obs where (topic = 'view' and value > 0) or topic = 'error'", "obs"
    ),
)
def _(spark, d):
    obs = fx.observations(spark, d).select("obs_id", "topic", "value")
    views = obs.where((F.col("topic") == "view") & (F.col("value") > 0)).drop("topic")
    return union_topics({"view": views, "error": obs.where(F.col("topic") == "error").drop("topic")})


@query(
    "set2_distinct_sensor_places",
    with_ctes("select distinct topic, relative_location, area, latitude, longitude from sens", "sens"),
)
def _(spark, d):
    return fx.sensors(spark, d).select("topic", "relative_location", "area", "latitude", "longitude").distinct()
