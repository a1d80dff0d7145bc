import pytest
from pyspark.sql import functions as F

from tidegauge.functions.trail import first_trail_time
from tidegauge.operators import aggregates, lifecycle, registry, remedies
from tidegauge.operators import requests as rq
from tidegauge.plans import chain, stages
from tidegauge.schema import Compat
from tidegauge.sources import fixtures as fx
from tidegauge.sources import sinks

REMEDIES = [
    ("RemedyClone", "nb_copies", "Integer", "1", "10", "1", "OBS_RATE", "HIGH", "HIGH"),
    ("RemedyClone", "nb_copies", "Integer", "1", "10", "1", "OBS_FRESHNESS", "CONSTANT", "LOW"),
    ("RemedyRepeat", "window_ms", "Integer", "1", "9000", "5000", "OBS_RATE", "LOW", "HIGH"),
    ("RemedyNoisy", "nb_copies_noisy", "Integer", "1", "10", "1", "OBS_RATE", "HIGH", "HIGH"),
    ("RemedyNoisy", "nb_copies_noisy", "Integer", "1", "10", "1", "OBS_ACCURACY", "HIGH", "LOW"),
]
EFFECT = (
    "remedy string, param string, type string, min string, max string, initial string, attribute string, "
    "param_variation string, attribute_variation string"
)


@pytest.fixture
def effects(spark):
    return spark.createDataFrame(REMEDIES, EFFECT)


def test_remedies_that_spare_accuracy(spark, effects):
    targets = fx.attribute_targets(spark)
    got = remedies.remedies_preserving(effects, targets, "OBS_RATE", ["OBS_ACCURACY"])
    assert sorted(r["remedy"] for r in got.collect()) == ["RemedyClone", "RemedyRepeat"]
    everything = remedies.remedies_preserving(effects, targets, "OBS_RATE")
    assert everything.count() == 3
    assert aggregates.first_remedy(got).first()["remedy"] == "RemedyClone"
    assert remedies.remedies_preserving(effects, targets, "OBS_ACCURACY").count() == 0
    assert aggregates.first_remedy(got.where("false")).count() == 0
    with pytest.raises(ValueError):
        remedies.remedies_preserving(effects, targets, "OBS_COLOUR")


def test_remedies_through_triples(spark, effects):
    triples = registry.remedy_triples(effects).unionByName(registry.attribute_triples(fx.attribute_targets(spark)))
    graph = registry.Registry(triples)
    assert {tuple(r) for r in graph.remedy_effects().collect()} == set(REMEDIES)
    assert graph.quality_attributes().count() == 3
    assert {r["param"].split("#")[1]: len(r["has"]) for r in graph.customizable_params().collect()} == {
        "nb_copies": 2, "window_ms": 1, "nb_copies_noisy": 2,
    }


FORM = (
    "sensor_id string, topic string, location string, quantity_kind string, unit string, url string, "
    "interface_type string, interface_description string, min_value string, max_value string"
)


def form(name, **changes):
    row = dict(
        sensor_id=name, topic="qoo:temperature", location="qoo:loc_home", quantity_kind="m3-lite:Temperature",
        unit="m3-lite:DegreeCelsius", url="http://x/" + name, interface_type="http", interface_description="d",
        min_value="-INF", max_value="40",
    )
    return tuple({**row, **changes}.values())


def test_sensor_registration(spark):
    first = spark.createDataFrame([form("a"), form("b"), form("c", unit="")], FORM)
    triples = registry.sensor_triples(first)
    assert triples.count() == 2 * 28
    place = spark.createDataFrame(
        [("home", "home", "town", "1", "2", "3", "0"), ("town", "town", None, "0", "0", "0", "0")],
        "name string, relative_location string, area string, latitude string, longitude string, altitude string, "
        "relative_altitude string",
    )
    triples = triples.unionByName(registry.place_triples(place)).distinct()
    again = registry.register_sensors(triples, spark.createDataFrame([form("a", url="http://y"), form("d"), form("d", url="http://z")], FORM))
    graph = registry.Registry(again)
    urls = {r["sensor"].split("#")[1]: r["url"] for r in graph.sensors().collect()}
    assert urls["a"] == "http://x/a" and set(urls) == {"a", "b", "d"}
    assert graph.sensor("b").count() == 1 and graph.sensor("zz").count() == 0
    assert graph.topics().count() == 1 and graph.topic_endpoints("temperature").count() == 3
    assert graph.places().count() == 1 and graph.places_near("town").count() == 1
    assert graph.sensors_near("town").count() == 3 and graph.sensors_near("home").count() == 0
    caps = graph.sensor_capabilities().first()
    assert caps["min_value"] == float("-inf") and caps["max_value"] == 40.0
    rest = registry.delete_sensors(again, spark.createDataFrame([("a",)], "sensor_id string"))
    assert rest.count() == again.count() - 7
    assert registry.Registry(rest).sensors().count() == 2


def state(status, start, end):
    return (status, start, end)


def test_state_history(spark):
    rows = [("a", [state("CREATED", 1, 5), state("SUBMITTED", 5, 5)]), ("b", [])]
    frame = spark.createDataFrame(rows, "request_id string, states array<struct<status:string,start_date:long,end_date:long>>")
    moved = frame.withColumn("states", rq.advance_state(F.col("states"), "ENFORCED", 9))
    got = {r["request_id"]: [tuple(s) for s in r["states"]] for r in moved.collect()}
    assert got == {
        "a": [("CREATED", 1, 5), ("SUBMITTED", 5, 9), ("ENFORCED", 9, 9)], "b": [("ENFORCED", 9, 9)],
    }
    details = frame.where("request_id = 'a'").select(rq.state_details(F.col("states"), "CREATED")["end_date"])
    assert details.first()[0] == 5
    with pytest.raises(Exception, match="never in state HEALED"):
        frame.select(rq.state_details(F.col("states"), "HEALED")).collect()
    assert frame.select(rq.current_status(F.col("states"))).collect()[1][0] is None
    with pytest.raises(ValueError):
        rq.requests_by_app_status(frame, "x", ["ASLEEP"])


def test_log_text_may_contain_colons(spark):
    logs = F.array(F.lit("9: later: text"), F.lit("5: Object: created at 10:30"))
    assert spark.range(1).select(rq.request_start(logs)).first()[0] == 5


def test_single_request(spark):
    frame = spark.createDataFrame([("a",), ("b",), ("b",)], "request_id string")
    assert rq.single_request(frame, "a").count() == 1
    for name in ("b", "z"):
        with pytest.raises(LookupError):
            rq.single_request(frame, name)


def test_lifecycle(spark):
    rows = [
        ("a", 0, "CREATED", 0, False), ("a", 1, "SUBMITTED", 1, False), ("a", 2, "ENFORCED", 2, False),
        ("a", 3, "REMOVED", 3, True), ("b", 0, "SUBMITTED", 0, False), ("c", 0, "CREATED", 0, False),
        ("c", 1, "REMOVED", 1, True), ("d", 0, "CREATED", 0, False), ("d", 1, "REJECTED", 1, False),
        ("d", 2, "ENFORCED", 2, False),
    ]
    frame = spark.createDataFrame(rows, "request_id string, seq int, status string, start_ms long, user boolean")
    got = {(r["request_id"], r["seq"]): r["valid"] for r in rq.apply_lifecycle(frame, "user").collect()}
    assert [k for k, v in got.items() if not v] == [("b", 0), ("c", 1), ("d", 2)]


def full_request(name, status, created, **changes):
    row = dict(
        request_id=name, topic="t", location="ALL", obs_level="RAW_DATA", interested_in=["OBS_RATE", "OBS_ACCURACY"],
        operator="NONE", sla_level="BEST_EFFORT", params={"a": "1", "b": "2"}, custom_params={"c": "3"},
        status=status, created_ms=created,
    )
    return tuple({**row, **changes}.values())


REQUEST = (
    "request_id string, topic string, location string, obs_level string, interested_in array<string>, operator string, "
    "sla_level string, params map<string,string>, custom_params map<string,string>, status string, created_ms long"
)


def test_sharing(spark):
    rows = [
        full_request("old2", "ENFORCED", 2),
        full_request("old1", "ENFORCED", 1),
        full_request("new1", "SUBMITTED", 3, params={"b": "2", "a": "1"}),
        full_request("new2", "SUBMITTED", 3, interested_in=["OBS_ACCURACY", "OBS_RATE"]),
        full_request("new3", "SUBMITTED", 3, custom_params={}),
        full_request("old3", "ENFORCED", 1, custom_params={}),
    ]
    frame = spark.createDataFrame(rows, REQUEST)
    got = dict(tuple(r) for r in rq.find_shared_requests(frame).collect())
    assert got == {"new1": "old1", "new2": None, "new3": "old3"}
    strict = rq.find_shared_requests(frame, compat=Compat(shared_needs_custom_params=True)).collect()
    assert dict(tuple(r) for r in strict) == {"new1": "old1", "new2": None, "new3": None}


def test_differences(spark):
    old = spark.createDataFrame([full_request("a", "ENFORCED", 1), full_request("b", "ENFORCED", 1)], REQUEST)
    new = spark.createDataFrame(
        [
            full_request("a", "ENFORCED", 1, params={"b": "2", "a": "1"}),
            full_request("b", "ENFORCED", 1, params={"a": "2"}, operator="AVG", interested_in=["OBS_ACCURACY", "OBS_RATE"]),
        ],
        REQUEST,
    )
    got = {r["request_id"]: r["changed"] for r in rq.request_diff(old, new).collect()}
    assert got == {"a": [], "b": ["interested_in", "operator", "params"]}


def test_heal_stage_round_trip(spark, small):
    edges = lifecycle.stage_edges(fx.requests(spark, small))
    heals = edges.where("is_sink and application_id = 'app1'").select("request_id", F.lit("Clone").alias("remedy"))
    healed = lifecycle.insert_heal_stage(edges, heals)
    assert healed.count() == edges.count() + heals.count()
    assert healed.where("is_sink").count() == edges.where("is_sink").count()
    chosen = heals.where("request_id < 'req5'")
    partly = lifecycle.remove_heal_stage(healed, chosen)
    assert partly.where("is_heal").count() == heals.count() - chosen.count()
    back = lifecycle.remove_heal_stage(healed)
    assert back.exceptAll(edges).count() == 0 and edges.exceptAll(back).count() == 0


def test_upsert_keeps_the_last_write(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 1, "y"), ("c", 5, "z")], "request_id string, version int, v string")
    new = spark.createDataFrame(
        [("a", 2, "n", False), ("a", 3, "m", False), ("b", 2, "y", True), ("c", 4, "late", False), ("d", 1, "w", False)],
        "request_id string, version int, v string, deleted boolean",
    )
    assert {tuple(r) for r in sinks.upsert(old, new).collect()} == {("a", 3, "m"), ("c", 5, "z"), ("d", 1, "w")}


def test_one_request_equals_its_chain(spark, small):
    obs, sensors, caps = fx.observations(spark, small), fx.sensors(spark, small), fx.capabilities(spark, small)
    requests = fx.requests(spark, small)
    together = chain.enforce_requests(obs, requests, sensors, caps, fx.AS_OF_MS).collect()
    chains = {r["chain_id"]: r for r in chain.selection_chains(requests).collect()}
    picked = [c for c in chains.values() if c["topic"] in ("ALL", "view") and c["area"] in ("ALL", "ASIA")]
    assert len(picked) >= 4
    for c in picked:
        params = {
            "threshold_min": c["threshold_min"], "threshold_max": c["threshold_max"], "obsRate_max": c["obsrate_max"],
            "age_max": c["age_max"],
        }
        request = {
            "topic": c["topic"], "location": c["area"], "obs_level": "INFORMATION",
            "interested_in": ["OBS_ACCURACY", "OBS_FRESHNESS"],
            "params": {k: str(v) for k, v in params.items() if v is not None},
        }
        allowed = obs
        if c["topic"] != "ALL":
            allowed = obs.where(F.col("topic") == c["topic"])
        alone = chain.run_request(allowed, request, sensors, caps, fx.AS_OF_MS).collect()
        mine = [r for r in together if r["chain_id"] == c["chain_id"]]
        key = lambda r: (r["date"], r["producer"], r["value"])
        assert sorted(map(key, alone)) == sorted(map(key, mine))
        assert all(r["timestamps"].count(";") == 2 for r in alone)


def test_attributes_without_capabilities(spark, small):
    obs, sensors = fx.observations(spark, small), fx.sensors(spark, small)
    nothing = fx.capabilities(spark, small).where("false")
    request = {"topic": "view", "interested_in": ["OBS_FRESHNESS", "OBS_ACCURACY"]}
    rows = chain.run_request(obs, request, sensors, nothing, fx.AS_OF_MS)
    assert all(list(r["qoOAttributeValues"]) == request["interested_in"] for r in rows.collect())
    assert {r["qoOAttributeValues"]["OBS_ACCURACY"] for r in rows.collect()} == {"0.0"}
    compat = Compat(attributes_need_capabilities=True)
    bare = chain.run_request(obs, request, sensors, nothing, fx.AS_OF_MS, compat=compat)
    assert all(r["qoOAttributeValues"] == {} for r in bare.collect())


def test_members_cover_every_request(spark, small):
    requests = fx.requests(spark, small)
    members = chain.chain_members(requests)
    assert members.count() == requests.count()
    delivered = chain.enforce_requests(
        fx.observations(spark, small), requests, fx.sensors(spark, small), fx.capabilities(spark, small), fx.AS_OF_MS
    )
    fanned = chain.fan_out(delivered, members.where("chain_id = 'req0'"))
    assert fanned.count() == delivered.where("chain_id = 'req0'").count() * members.where("chain_id = 'req0'").count()


def test_stage_settings(spark, small):
    reg = stages.StageRegistry()
    reg.register(
        "shift", lambda df, p: df.withColumn("value", F.col("value") + float(p["by"])),
        params=[stages.StageParam("by", "Double", "1.0"), stages.StageParam("fixed", default="x", customizable=False)],
    )
    use = reg.use("shift")
    assert use.set_param("by", "2.5") and not use.set_param("fixed", "y") and not use.set_param("other", "z")
    assert use.values == {"by": "2.5", "fixed": "x"}
    out = use.apply(spark.createDataFrame([(1.0,)], "value double"))
    assert out.first()[0] == 3.5
    use.reset()
    assert use.values["by"] == "1.0"
    assert [r["stage_id"] for r in reg.ids(spark).collect()] == ["shift"]
    described = {r["stage_id"]: r for r in reg.describe(spark, include_builtin=True).collect()}
    assert described["threshold"]["adaptable"] and described["shift"]["customizable"] == ["by"]
    names = [s.stage.stage_id for s in reg.chain({"obsRate_max": "1/s", "threshold_min": "0"}, [use])]
    assert names == ["ingest", "threshold", "throttle", "shift", "output"]
    with pytest.raises(ValueError):
        reg.register("a_b", lambda df, p: df)


def test_as_of_is_an_argument(spark):
    frame = spark.createDataFrame([("produced:5",)], "timestamps string")
    assert frame.select(first_trail_time(F.col("timestamps"))).first()[0] == 5
