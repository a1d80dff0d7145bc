"""Steps that must not be dealt over few tasks because their rows are short."""

from tidegauge.catalog import observations
from tidegauge.operators import lifecycle, registry
from tidegauge.sources import triples
from tidegauge.sources.vocabulary import iri

EDGE = "request_id string, application_id string, parent string, child string, stage string, level int, is_source boolean, is_heal boolean, is_sink boolean"


def test_heals_are_dealt_over_tasks_before_they_are_grouped(spark):
    rows = [(r, "app", "click", f"{r}_1", "ingest", 1, True, False, False) for r in ("a", "b")]
    rows += [(r, "app", f"{r}_1", f"app_{r}", "output", 2, False, False, True) for r in ("a", "b")]
    edges = spark.createDataFrame(rows, EDGE)
    heals = spark.createDataFrame([("a", "RemedyB"), ("a", "RemedyA"), (None, "RemedyC")], "request_id string, remedy string")
    healed = lifecycle.insert_heal_stage(edges, heals)
    assert "RemedyA" in {r.stage for r in healed.collect()}
    assert "REPARTITION_BY_NUM" in healed._jdf.queryExecution().executedPlan().toString()
    undone = lifecycle.remove_heal_stage(healed)
    assert sorted(map(tuple, undone.collect())) == sorted(rows)


def test_triples_are_dealt_before_they_are_compared(spark):
    """No task that makes triples holds them as groups."""
    effects = spark.createDataFrame(
        [(f"R{i % 3}", f"p{i % 3}", "Integer", "0", "9", "1", "OBS_RATE", "HIGH", "LOW") for i in range(6)],
        "remedy string, param string, type string, min string, max string, initial string, attribute string, "
        "param_variation string, attribute_variation string",
    )
    described = registry.remedy_triples(effects)
    assert len(described.collect()) == len({tuple(r) for r in described.collect()}) == 3 * 14
    plan = described._jdf.queryExecution().sparkPlan().toString().splitlines()
    assert [line.split("(")[0].strip(" +-") for line in plan[:2]] == ["HashAggregate", "HashAggregate"]
    assert "Exchange" in plan[2]


def test_statements_are_matched_once(spark):
    """Parsing does not repeat the formula of a line for each of its parts, and literals may have any length."""
    long = "\\n\\\\" * 20_000
    lines = spark.createDataFrame([(f'<http://a/{i}> <http://b> "{long} {i}"@de . # {i}\n',) for i in range(2)], "value string")
    twice = triples.parse_statements(triples.to_ntriples(triples.parse_statements(lines)))
    assert {(r.s, r.o, r.lang) for r in twice.collect()} == {(f"http://a/{i}", "\n\\" * 20_000 + f" {i}", "de") for i in range(2)}
    plan = twice._jdf.queryExecution().optimizedPlan().toString().lower()
    assert plan.count("regexp_replace") == 2 and "regexp_extract(" not in plan


def test_only_topics_read_from_others_are_followed(spark):
    line = [(f"r{i}", f"t{i}", f"t{i + 1}", "stage") for i in range(2 * lifecycle.STEPS)]
    fork = [("a", "x", "m", "s1"), ("b", "y", "m", "s2"), ("c", "z", "y", "s3"), ("b", "m", "out", "s4")]
    edges = spark.createDataFrame(line + fork, "request_id string, parent string, child string, stage string")
    every = {(r.topic, r.upstream) for r in lifecycle.upstream_topics(edges).collect()}
    for ends in (["t3", "m"], [f"t{2 * lifecycle.STEPS}"]):
        starts = spark.createDataFrame([(t,) for t in ends], "topic string")
        found = [(r.topic, r.upstream) for r in lifecycle.upstream_topics(edges, starts=starts).collect()]
        assert sorted(found) == sorted(p for p in every if p[0] in ends)
    users = [(r.request_id, r.stage) for r in lifecycle.stage_users(edges.where("stage <> 'stage'")).collect()]
    assert sorted(users) == [("a", "s1"), ("a", "s2"), ("a", "s3"), ("b", "s1"), ("b", "s2"), ("b", "s3"), ("b", "s4"), ("c", "s3")]


def test_nodes_are_read_as_the_keys_that_they_have(spark):
    text = '{"obs":[{"@id":"a","@type":"t","lat":"1","other":"x","obsStrValue":"2.5","long":null},{"@id":"b"}]}'
    rows = spark.createDataFrame([(1, text), (2, None), (3, '{"obs":[]}')], "obs_id long, text string")
    found = observations._text_statements(rows)
    kept = [("rdf:type", "t", None), ("geo:lat", "1", None), ("qoo:obsStrValue", None, 2.5)]
    assert sorted(map(tuple, found.collect()), key=str) == sorted([(1, "a", iri(p), o, n) for p, o, n in kept], key=str)
