"""Cases in which rows were once cut, dropped or gathered in one place."""

import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tidegauge.operators import monitor, ordering, rates, remedies, requests, segments
from tidegauge.plans import chain
from tidegauge.schema import Compat
from tidegauge.sources import fixtures as fx
from tidegauge.sources import requests as docs
from tidegauge.sources import sinks
from tidegauge.sources import triples as nt


def test_limit_from_a_column_keeps_all_that_it_allows(spark):
    rows = spark.createDataFrame([(i, i % 7, 5 if i % 2 else 2) for i in range(200)], "id long, t long, n int")
    kept = rates.rate_limit(rows, F.col("n"), 1000, ts="t", keys=["n"], tie=["id"], anchor="epoch")
    assert sorted(r["n"] for r in kept.collect()) == [2] * 2 + [5] * 5


def test_limit_without_an_id_column(spark):
    rows = spark.createDataFrame([(i % 5, float(i)) for i in range(50)], "t long, value double")
    once = rates.rate_limit(rows, 3, 1000, ts="t", anchor="epoch")
    again = rates.rate_limit(rows.repartition(7), 3, 1000, ts="t", anchor="epoch")
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, again.collect()))
    assert once.count() == 3


def test_a_year_of_silence(spark):
    row = spark.createDataFrame([("a", 0)], "k string, t long")
    year = 365 * 24 * 3600 * 1000
    copies = rates.repeat_last(row, 1000 * 60, year, ts="t", keys=["k"])
    assert copies.agg(F.count(F.lit(1)), F.max("emit_ms")).first()[:] == (365 * 24 * 60 + 1, year)


def test_a_long_shortfall(spark):
    need = spark.createDataFrame([("r", 1.0, 0, 3_000_000_000, "GUARANTEED")], "request_id string, min_per_s double, start_ms long, until_ms long, sla_level string")
    none = spark.createDataFrame([], "request_id string, report_ms long, n long")
    assert monitor.min_rate_violations(none, need).count() == 150_000


def test_windows_summed_before_and_after_routing(spark):
    rnd = random.Random(5)
    reports = spark.createDataFrame(
        [(f"s{rnd.randrange(3)}", rnd.randrange(200_000), "p", rnd.randrange(1, 5)) for _ in range(400)],
        "stage_id string, report_ms long, producer string, n long",
    )
    asked = spark.createDataFrame(
        [(f"r{i}", f"s{i % 3}", rnd.choice([0, 3_000, 12_000, 23_456]), 150_000 + rnd.randrange(40_000)) for i in range(30)],
        "request_id string, stage_id string, start_ms long, until_ms long",
    )
    late = monitor.count_by_window(monitor.reports_to_requests(reports, asked), asked, 10_000)
    whole = late.join(asked, "request_id").where("(window + 1) * 10000 <= until_ms - start_ms").select(*late.columns)
    early = monitor.windows_of_requests(reports, asked, asked, 10_000)
    assert sorted(map(tuple, early.collect())) == sorted(map(tuple, whole.collect()))


@pytest.mark.parametrize("k", [1, 2, 4])
def test_buffer_equals_a_walk(spark, k):
    rnd = random.Random(k)
    rows = [(rnd.choice(["s", "t", None]), f"r{i:03}", rnd.randrange(60) * 1000) for i in range(300)]
    got = monitor.symptom_buffer(
        spark.createDataFrame(rows, "stage_id string, request_id string, symptom_ms long"), symptoms_before_action=k, lifetime_ms=3000
    ).collect()
    want = []
    for stage in ("s", "t", None):
        mine = sorted((t, r) for s, r, t in rows if s == stage)
        want += [(stage, r, t, i >= k - 1 and t - mine[i - k + 1][0] <= 3000) for i, (t, r) in enumerate(mine)]
    assert sorted(map(str, ((r["stage_id"], r["request_id"], r["symptom_ms"], r["act"]) for r in got))) == sorted(map(str, want))


def test_buffer_of_one_hot_stage_is_dealt_over_tasks(spark):
    rows = spark.range(100_000).select(
        F.lit("s").alias("stage_id"), F.concat(F.lit("r"), "id").alias("request_id"), (F.col("id") * 7).alias("symptom_ms")
    )
    acted = monitor.symptom_buffer(rows, lifetime_ms=3000)
    assert acted.where("act").count() == 99_999
    assert "Window [sum" in acted._jdf.queryExecution().optimizedPlan().toString()
    sorted_whole = [x for x in acted._jdf.queryExecution().optimizedPlan().toString().split("\n") if "lag(" in x]
    assert not sorted_whole


def test_stable_requests_equal_a_search(spark):
    rnd = random.Random(9)
    heals = [(rnd.choice("st"), f"r{i}", rnd.randrange(500)) for i in range(120)]
    symptoms = [(rnd.choice("st"), rnd.randrange(500)) for _ in range(40)]
    got = monitor.stable_requests(
        spark.createDataFrame(heals, "stage_id string, request_id string, heal_ms long"),
        spark.createDataFrame(symptoms, "stage_id string, symptom_ms long"),
        observe_ms=13,
    ).collect()
    want = {r for s, r, t in heals if not any(x == s and t < y <= t + 13 for x, y in symptoms)}
    assert {r["request_id"] for r in got} == want


def test_remedy_by_request(spark):
    effects = spark.createDataFrame(
        [
            ("A", "p1", "Integer", "0", "9", "1", "OBS_RATE", "HIGH", "HIGH"),
            ("A", "p1", "Integer", "0", "9", "1", "OBS_FRESHNESS", "HIGH", "HIGH"),
            ("B", "p2", "Integer", "0", "9", "1", "OBS_RATE", "HIGH", "HIGH"),
            ("B", "p2", "Integer", "0", "9", "1", "OBS_ACCURACY", "HIGH", "LOW"),
            ("C", "p3", "Integer", "0", "9", "1", "OBS_RATE", "LOW", "HIGH"),
        ],
        "remedy string, param string, type string, min string, max string, initial string, attribute string, "
        "param_variation string, attribute_variation string",
    )
    asked = spark.createDataFrame(
        [("r1", ["OBS_RATE"]), ("r2", ["OBS_FRESHNESS"]), ("r3", ["OBS_ACCURACY", "OBS_FRESHNESS"]), ("r4", None)],
        "request_id string, interested_in array<string>",
    )
    chosen = remedies.remedy_of_requests(effects, fx.attribute_targets(spark), asked)
    assert {r["request_id"]: r["remedy"] for r in chosen.collect()} == {"r1": "A", "r2": "B", "r3": "C", "r4": "A"}
    symptoms = spark.createDataFrame([(r, t, True) for r in ("r1", "r2", "r9") for t in (0, 60_000)], "request_id string, symptom_ms long, act boolean")
    sla = spark.createDataFrame([("r1", "GUARANTEED"), ("r2", "GUARANTEED"), ("r9", "BEST_EFFORT")], "request_id string, sla_level string")
    got = {(r["request_id"], r["attempt"]): (r["decision"], r["remedy"]) for r in monitor.heal_decisions(symptoms, sla, chosen).collect()}
    assert got[("r1", 1)] == ("HEAL", "A") and got[("r2", 2)] == ("HEAL", "B") and got[("r9", 1)] == ("NO_REMEDY", None)


def test_next_value_needs_whole_numbers(spark):
    with pytest.raises(TypeError):
        ordering.with_next(spark.createDataFrame([(0.25,)], "x double"), "x")


def test_instants_of_a_repeated_hour_are_two_keys(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Europe/Paris")
    try:
        rows = spark.range(2).select(F.timestamp_seconds(F.lit(1_698_537_600) + F.col("id") * 3600).alias("at"))
        assert rows.select(segments.key_text(rows, ["at"]).alias("k")).distinct().count() == 2
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_ids_of_requests_are_stable(spark):
    text = '{"application_id":"a","topic":"t","location":"l"}'
    posted = spark.createDataFrame([(text, 1), (text, 2)], "message string, offset long")
    accepted, _ = docs.submit_requests(posted, 0, position=["offset"])
    once = sorted(r["request_id"] for r in accepted.collect())
    assert once == sorted(r["request_id"] for r in accepted.collect()) and len(set(once)) == 2


def test_latest_observations_with_ties(spark):
    log = spark.createDataFrame([("r", i, 5) for i in range(50)], "request_id string, obs_id long, timestamp_ms long")
    assert [r["obs_id"] for r in requests.latest_observations(log.repartition(5), "r", 3).collect()] == [49, 48, 47]


def test_statements_keep_kind_language_and_type(spark, tmp_path):
    lines = [
        '<http://x/a> <http://x/p> "\\u00e9\\\\u00e9 \\U0001F600"@fr .',
        '_:b1 <http://x/p> "1"^^<http://x/int> . # note',
        "<http://x/a> <http://x/p> _:b1 .",
        '<http://x/a> <http://x/p> "http://x/not-an-iri" .',
        "# comment",
        "",
    ]
    good = spark.createDataFrame([(x,) for x in lines], "value string")
    read = nt.parse_statements(good)
    rows = [tuple(r) for r in read.collect()]
    assert rows[0] == ("http://x/a", "http://x/p", "é\\u00e9 😀", "literal", "fr", None)
    assert rows[1] == ("_:b1", "http://x/p", "1", "literal", None, "http://x/int")
    assert rows[2][2:4] == ("_:b1", "blank") and rows[3][3] == "literal"
    assert [tuple(r) for r in nt.parse_statements(nt.to_ntriples(read)).collect()] == rows
    assert nt.rejected_lines(good).count() == 0
    bad = good.union(spark.createDataFrame([("<http://x/a> broken",)], "value string"))
    assert [r["value"] for r in nt.rejected_lines(bad).collect()] == ["<http://x/a> broken"]
    bad.write.text(f"{tmp_path}/t")
    assert nt.read_triples(spark, f"{tmp_path}/t").count() == 4
    with pytest.raises(PySparkException):
        nt.read_triples(spark, f"{tmp_path}/t", strict=True).collect()


@pytest.mark.parametrize("prefixes", [(), ("sensor1",)])
def test_all_requests_at_once_deliver_what_each_alone_would(spark, small, prefixes):
    obs, sensors, caps = fx.observations(spark, small).cache(), fx.sensors(spark, small).cache(), fx.capabilities(spark, small)
    wishes = fx.request_states(spark, small).select("request_id", "interested_in")
    asked = fx.requests(spark, small).where("obsrate_max is null and request_id like '%7'").join(wishes, "request_id").cache()
    compat = Compat(bypass_prefixes=prefixes)
    together = chain.enforce_requests(obs, asked, sensors, caps, fx.AS_OF_MS, compat=compat)
    sent = chain.deliver_requests(together, asked, sensors, fx.AS_OF_MS).cache()
    chosen = [r for level in fx.REQUEST_LEVELS for r in asked.where(F.col("obs_level") == level).orderBy("request_id").limit(2).collect()]
    for r in chosen:
        params = {n: str(r[c]) for n, c in (("threshold_min", "threshold_min"), ("threshold_max", "threshold_max"), ("age_max", "age_max")) if r[c] is not None}
        request = {"topic": r["topic"], "location": r["area"], "obs_level": r["obs_level"], "interested_in": r["interested_in"], "params": params}
        alone = chain.run_request(obs.drop("ingest_ms"), request, sensors, caps, fx.AS_OF_MS, compat=compat)
        if r["obs_level"] == "KNOWLEDGE":
            texts = alone.select(F.to_json(F.struct("obs")).alias("m"))
        else:
            texts = alone.select(sinks.encode_observation(alone).alias("m"))
        want = sorted(x["m"] for x in texts.collect())
        got = sent.where(F.col("request_id") == r["request_id"])
        assert sorted(x["message"] for x in got.collect()) == want
        assert {x["delivery_topic"] for x in got.collect()} <= {f"{r['application_id']}_{r['request_id']}"}


def test_planning_runs_no_job(spark, small):
    tracker = spark.sparkContext.statusTracker()
    args = fx.observations(spark, small), fx.requests(spark, small), fx.sensors(spark, small), fx.capabilities(spark, small)
    spark.sparkContext.setJobGroup("planning", "planning")
    try:
        chain.enforce_requests(*args, fx.AS_OF_MS)
        assert not tracker.getJobIdsForGroup("planning")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
