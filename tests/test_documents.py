"""The documented messages, decoded, encoded again and compared field by field."""

import json

import pytest
from pyspark.sql import functions as F

from tidegauge.functions.trail import platform_ms
from tidegauge.operators import enrich, knowledge
from tidegauge.schema import WireNames
from tidegauge.sources import observations as src
from tidegauge.sources import requests as docs
from tidegauge.sources import sinks, triples
from tidegauge.sources.vocabulary import expand, iri, iri_for_prefix, prefix_table, shorten

BASE = WireNames().base_iri
RAW = {
    "date": 1500364730089,
    "value": 4.276,
    "producer": "sensor01",
    "timestamps": "produced:1500364730089;platform_in:1500364730543;platform_out:1500364730664",
    "qoOAttributeValues": {"OBS_ACCURACY": "100.0", "OBS_FRESHNESS": "575.0"},
}
CONTEXT = {
    "latitude": "43.53101809",
    "longitude": "1.40158296",
    "altitude": "152",
    "relativeLocation": "Chullanka - Portet-sur-Garonne",
    "topic": "temperature",
}


def sensor_table(spark):
    return spark.createDataFrame(
        [
            (
                "sensor01", "temperature", CONTEXT["latitude"], CONTEXT["longitude"], "152",
                CONTEXT["relativeLocation"], "0", iri("m3-lite:Temperature"), iri("m3-lite:DegreeCelsius"),
                BASE + "publicLocations",
            )
        ],
        "sensor_id string, topic string, latitude string, longitude string, altitude string, relative_location string, "
        "relative_altitude string, quantity_kind string, unit string, feature string",
    )


def decoded(spark, document):
    frame = spark.createDataFrame([(json.dumps(document),)], "message string")
    return src.decode_observation(frame)


def with_scores(obs, document):
    pairs = [x for kv in document["qoOAttributeValues"].items() for x in map(F.lit, kv)]
    return obs.withColumn("qoOAttributeValues", F.create_map(*pairs))


def test_raw_sample(spark):
    rows = with_scores(decoded(spark, RAW), RAW)
    text = rows.select(sinks.encode_observation(rows, pretty=True)).first()[0]
    assert "\n" in text
    assert json.loads(text) == RAW
    delay = platform_ms(F.col("timestamps"), "platform_in", "platform_out")
    assert rows.select(delay).first()[0] == 121


def test_information_sample(spark):
    document = {**RAW, "sensorContext": CONTEXT}
    rows = enrich.with_sensor_context(with_scores(decoded(spark, RAW), RAW), sensor_table(spark))
    assert json.loads(rows.select(sinks.encode_observation(rows)).first()[0]) == document


def test_unknown_sensor_is_not_available(spark):
    rows = enrich.with_sensor_context(decoded(spark, {**RAW, "producer": "other"}), sensor_table(spark))
    assert set(rows.first()["sensorContext"]) == {"N/A"}


def test_knowledge_sample(spark):
    message = {
        "date": "1500364800147", "value": "9.383", "producer": "sensor01",
        "timestamps": "produced:1500364800147;platform_in:1500364800313;platform_out:1500364800645",
    }
    scores = {"qoOAttributeValues": {"OBS_ACCURACY": "100.0", "OBS_FRESHNESS": "497.0"}}
    rows = enrich.with_sensor_context(
        with_scores(decoded(spark, message), scores), sensor_table(spark), knowledge.SENSOR_EXTRAS
    )
    nodes = json.loads(rows.select(sinks.encode_knowledge(zone="Europe/Paris")).first()[0])["obs"]
    ssn, m3, geo = iri("ssn:"), iri("m3-lite:"), iri("geo:")
    expected = [
        {"@id": BASE + "accuracyKind", "@type": m3 + "Others"},
        {"@id": BASE + "accuracyUnit", "@type": m3 + "Percent"},
        {"@id": BASE + "freshnessKind", "@type": m3 + "Others"},
        {"@id": BASE + "freshnessUnit", "@type": m3 + "Millisecond"},
        {"@id": BASE + "location", "@type": geo + "Point", "alt": "152", "altRelative": "0", "lat": "43.53101809",
         "long": "1.40158296", "relativeLocation": CONTEXT["relativeLocation"]},
        {"@id": BASE + "obs", "@type": ssn + "Observation", "featureOfInterest": BASE + "publicLocations",
         "observationResult": BASE + "sensorOutput", "observedBy": BASE + "sensor01",
         "observedProperty": BASE + "temperature"},
        {"@id": BASE + "obsValue", "@type": ssn + "ObservationValue", "hasQoO": BASE + "qooAttributesList",
         "hasQuantityKind": m3 + "Temperature", "hasUnit": m3 + "DegreeCelsius",
         "obsDateValue": "2017-07-18 10:00:00.147", "obsLevelValue": "KNOWLEDGE", "obsStrValue": "9.383",
         "obsTimestampsValue": message["timestamps"]},
        {"@id": BASE + "qooAttributesList", "@type": "rdf:Seq", "_1": BASE + "qooIntrinsic_OBS_ACCURACY",
         "_2": BASE + "qooIntrinsic_OBS_FRESHNESS"},
        *[
            {"@id": BASE + "qooIntrinsic_" + n, "@type": BASE + "QoOIntrisicQuality",
             "hasQoOValue": BASE + "qooValue_" + n, "isAbout": n}
            for n in ("OBS_ACCURACY", "OBS_FRESHNESS")
        ],
        *[
            {"@id": BASE + "qooValue_" + n, "@type": BASE + "QoOValue", "hasQuantityKind": BASE + s + "Kind",
             "hasUnit": BASE + s + "Unit", "qooStrValue": v}
            for n, s, v in (("OBS_ACCURACY", "accuracy", "100.0"), ("OBS_FRESHNESS", "freshness", "497.0"))
        ],
        {"@id": BASE + "sensor01", "@type": ssn + "Sensor", "location": BASE + "location"},
        {"@id": BASE + "sensorOutput", "@type": ssn + "SensorOutput", "hasValue": BASE + "obsValue"},
    ]
    assert nodes == expected
    assert [list(n) for n in nodes] == [list(n) for n in expected]


def test_text_and_numbers_both_decode_and_bad_ones_are_set_aside(spark):
    rows = [
        ('{"date": "5", "value": "1.5", "producer": "a", "timestamps": "produced:5", "extra": {"x": [1]}}',),
        ('{"date": 5, "value": 1.5, "producer": "a", "timestamps": ""}',),
        ('{"date": "5", "value": "NaN", "producer": "a", "timestamps": "produced:5"}',),
        ('{"date": "5", "value": "1.5", "producer": "a"}',),
        ('{"date": "x", "value": "1.5", "producer": "a", "timestamps": "t"}',),
        ("not json",),
        ("",),
    ]
    frame = spark.createDataFrame(rows, "message string")
    assert src.decode_observation(frame).count() == 3
    assert src.rejected_observations(frame).count() == 4
    with pytest.raises(Exception, match="malformed observation"):
        src.decode_observation(frame, mode="failfast").collect()
    with pytest.raises(ValueError):
        src.decode_observation(frame, mode="other")


def test_constant_message_has_the_documented_size(spark):
    rows = src.synthetic_observations(spark.range(3)).select(F.octet_length("message").alias("n")).collect()
    assert [r["n"] for r in rows] == [len(src.CONSTANT_MESSAGE)] * 3
    sizes = src.synthetic_observations(spark.range(50), sequential=True, random_size=True, size=192)
    drawn = [r[0] for r in sizes.select(F.length("message")).collect()]
    assert max(drawn) <= 192 and len(set(drawn)) > 5


SIMPLE = {"application_id": "testApplication", "topic": "ALL", "location": "ALL", "obs_level": "RAW_DATA"}
FULL = {
    "application_id": "testApplication", "topic": "temperature", "location": "Toulouse", "obs_level": "KNOWLEDGE",
    "qoo": {
        "interested_in": ["OBS_ACCURACY", "OBS_FRESHNESS"],
        "platform_params": {"obsRate_min": "5/s"},
        "sla_level": "GUARANTEED",
    },
}


def test_documented_requests_are_accepted(spark):
    bare = {k: v for k, v in SIMPLE.items() if k != "obs_level"}
    rows = [(json.dumps(r),) for r in (SIMPLE, FULL, bare)]
    accepted, rejects = docs.submit_requests(spark.createDataFrame(rows, "message string"), 7)
    assert rejects.count() == 0
    got = sorted(accepted.collect(), key=lambda r: r["topic"])
    assert [r["sla_level"] for r in got] == ["BEST_EFFORT", "BEST_EFFORT", "GUARANTEED"]
    assert [r["obs_level"] for r in got] == ["RAW_DATA", "RAW_DATA", "KNOWLEDGE"]
    assert got[2]["params"] == {"obsRate_min": "5/s"} and got[2]["interested_in"] == ["OBS_ACCURACY", "OBS_FRESHNESS"]
    assert got[0]["interested_in"] == [] and got[0]["operator"] == "NONE"
    assert got[0]["logs"] == ["7: Request received."]
    assert len({r["request_id"] for r in got}) == 3


def test_malformed_requests_are_rejected(spark):
    bad = [
        "no json",
        json.dumps({**SIMPLE, "obs_level": "OTHER"}),
        json.dumps({**SIMPLE, "qoo": {"sla_level": "MAYBE"}}),
        json.dumps({**SIMPLE, "qoo": {"operator": "SUM"}}),
        json.dumps({**SIMPLE, "qoo": {"interested_in": ["COLOUR"]}}),
        json.dumps({k: v for k, v in SIMPLE.items() if k != "location"}),
    ]
    accepted, rejects = docs.submit_requests(spark.createDataFrame([(b,) for b in bad], "message string"), 7)
    assert accepted.count() == 0
    assert {r["reason"] for r in rejects.collect()} == {
        "no application_id", "unknown obs_level", "unknown sla_level", "unknown operator", "unknown attribute", "no location",
    }


def test_wire_names_can_be_chosen(spark):
    wire = WireNames(params_field="my_params")
    text = json.dumps({**FULL, "qoo": {"my_params": {"age_max": "5 s"}}})
    accepted, _ = docs.submit_requests(spark.createDataFrame([(text,)], "message string"), 7, wire=wire)
    assert accepted.first()["params"] == {"age_max": "5 s"}
    stored = accepted.select(docs.request_document(wire)).first()[0]
    assert json.loads(stored)["qoo"]["my_params"] == {"age_max": "5 s"}


def test_requests_survive_a_json_file(spark, tmp_path):
    accepted, _ = docs.submit_requests(spark.createDataFrame([(json.dumps(FULL),)], "message string"), 7)
    accepted.select(docs.request_document()).write.text(str(tmp_path / "requests"))
    back = docs.read_requests(spark, str(tmp_path / "requests"))
    assert back.drop("states").first() == accepted.drop("states").first()
    assert back.first()["states"][0]["status"] == "CREATED"


def test_ntriples_file(spark, tmp_path):
    rows = [
        ("http://a#s", "http://a#p", "http://a#o"),
        ("http://a#s", "http://a#p", 'quote " slash \\ tab \t line \n end'),
        ("http://a#s", "http://a#p", "literal \\n not a line"),
    ]
    frame = spark.createDataFrame(rows, "s string, p string, o string")
    out = str(tmp_path / "nt")
    triples.to_ntriples(frame).write.text(out)
    extra = spark.createDataFrame(
        [("# comment",), ("",), ("broken <x",), ('_:b1 <http://a#p> "1"^^<http://w3#int> .',), ('<http://a#s> <http://a#q> "hi"@en .',)],
        "value string",
    )
    extra.write.mode("append").text(out)
    got = {tuple(r) for r in triples.read_triples(spark, out).collect()}
    assert got == {*rows, ("_:b1", "http://a#p", "1"), ("http://a#s", "http://a#q", "hi")}


def test_prefixes(spark):
    assert iri_for_prefix("geo", False) + "#" == iri_for_prefix("geo")
    assert iri_for_prefix("none") is None
    assert prefix_table(spark).count() == 8
    frame = spark.createDataFrame([("ssn:Sensor",), ("other:x",)], "c string").withColumn("full", expand(F.col("c")))
    got = [tuple(r) for r in frame.select("full", shorten(F.col("full"))).collect()]
    assert got == [(iri("ssn:Sensor"), "ssn:Sensor"), ("other:x", "other:x")]
