"""The control loop on running streams: a planted shortfall is healed, and all decisions are those of the batch forms."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidegauge.operators import monitor, rates
from tidegauge.streaming.healing import Loop, clone_remedy, next_edges, next_uses, reports_of_versions
from tidegauge.streaming.ordered import use_rocksdb

START = 1_704_067_200_000
CLONE = {"remedy": "clone", "param": "copies", "type": "Integer", "initial": "2", "param_variation": "HIGH"}
EDGES = "request_id string, application_id string, parent string, child string, stage string, level int, is_source boolean, is_heal boolean, is_sink boolean"


@pytest.fixture(scope="module", autouse=True)
def store(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    use_rocksdb(spark)
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "8")


def demands_of(spark):
    rows = [
        ("enough", "app", "s0", "BEST_EFFORT", 0.5, START, START + 600_000),
        ("short", "app", "s0", "GUARANTEED", 1.8, START + 3_000, START + 603_000),
        ("hopeless", "app", "s0", "GUARANTEED", 50.0, START, START + 600_000),
        ("silent", "app", "s9", "BEST_EFFORT", 0.1, START, START + 600_000),
    ]
    return spark.createDataFrame(
        rows, "request_id string, application_id string, stage_id string, sla_level string, min_per_s double, start_ms long, until_ms long"
    )


def edges_of(spark, demands):
    rows = []
    for r in demands.collect():
        rows.append((r.request_id, "app", "in", r.stage_id, "ingest", 0, True, False, False))
        rows.append((r.request_id, "app", r.stage_id, f"out_{r.request_id}", "output", 1, False, False, True))
    return spark.createDataFrame(rows, EDGES)


def batch_decisions(spark, loop, demands):
    """The decisions of the batch operators on everything that was delivered."""
    sent = spark.read.parquet(f"{loop.path}/delivered").drop("batch")
    reports = rates.rate_reports(sent, loop.report_ms, keys=["stage_id"], producer="version", tie=list(loop.tie))
    counts = reports_of_versions(reports, loop.uses(), demands).groupBy("request_id", "report_ms").agg(F.sum("n").alias("n"))
    short = monitor.min_rate_violations(counts, demands, step_ms=loop.step_ms)
    buffered = monitor.symptom_buffer(short.join(demands.select("request_id", "stage_id"), "request_id"), lifetime_ms=loop.lifetime_ms)
    return monitor.heal_decisions(
        buffered, demands, loop.remedy, observe_ms=loop.observe_ms, max_retries=loop.max_retries, lifetime_ms=loop.lifetime_ms
    )


def test_a_shortfall_is_healed_while_the_stream_runs(spark, tmp_path):
    demands = demands_of(spark)
    loop = Loop(spark, f"{tmp_path}/loop", demands, CLONE, {"clone": clone_remedy}, max_retries=2, delay="2 seconds")
    loop.begin(edges_of(spark, demands))
    schema = "obs_id string, stage_id string, date timestamp, value double"
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    for turn in range(4):
        seconds = [(turn * 120 + i, "s0" if i % 40 else "sx") for i in range(120)]
        rows = spark.createDataFrame([(f"o{i}", stage, START + i * 1000, 1.0) for i, stage in seconds], "obs_id string, stage_id string, at long, value double")
        rows = rows.select("obs_id", "stage_id", F.timestamp_millis("at").alias("date"), "value")
        rows.orderBy(F.xxhash64("obs_id")).repartition(2).write.mode("append").parquet(f"{tmp_path}/in")
        loop.turn(stream, f"{tmp_path}/ck")
    decided = loop.decisions().drop("batch").collect()
    last = START + 478_000  # the watermark has passed nothing beyond
    want = [r for r in batch_decisions(spark, loop, demands).collect() if r.decided_ms < last - 2_000]
    assert Counter(map(tuple, decided)) == Counter(map(tuple, want)) and want
    by_request = {}
    for r in sorted(decided, key=lambda r: r.decided_ms):
        by_request.setdefault(r.request_id, []).append((r.decision, r.value))
    assert by_request["short"][0] == ("HEAL", "2") and len(by_request["short"]) < 3
    assert by_request["hopeless"][-1] == ("GIVE_UP", None) and by_request["silent"][-1] == ("GIVE_UP", None)
    assert "enough" not in by_request
    # healed as a stage of its own, between the old one and the sink; the given up one is gone, the other as it was
    edges = {(r.request_id, r.stage, r.parent, r.child) for r in loop.edges().collect()}
    assert {e for e in edges if e[0] == "short"} == {
        ("short", "ingest", "in", "s0"), ("short", "output", "s0", "app_short_clone"), ("short", "clone", "app_short_clone", "out_short"),
    }
    assert {e[0] for e in edges} == {"enough", "short", "silent"} and not any(e[0] == "silent" and e[1] == "clone" for e in edges)
    sent = spark.read.parquet(f"{loop.path}/delivered").where("stage_id = 'app_short_clone'")
    per_row = {r.n for r in sent.groupBy("obs_id").agg(F.count("*").alias("n")).collect()}
    assert per_row and per_row <= {2, 3}
    # nothing more to say about the healed request in its last minutes
    heals = [r.decided_ms for r in decided if r.request_id == "short"]
    assert max(heals) < START + 400_000


def test_uses_and_edges_after_decisions(spark):
    demands = demands_of(spark)
    none = F.lit(None)
    uses = demands.select(
        "request_id", "application_id", F.col("stage_id").alias("base_stage"), "stage_id", none.cast("string").alias("remedy"),
        none.cast("string").alias("value"), F.lit(0).cast("long").alias("from_version"), none.cast("long").alias("until_version"),
    )
    schema = "request_id string, decided_ms long, status string, remedy string, value string"
    decided = spark.createDataFrame(
        [("short", 5, "HEALED", "clone", "2"), ("short", 9, "HEALED", "clone", "3"), ("hopeless", 7, "REMOVED", None, None)], schema
    )
    first = next_uses(uses, decided, 1)
    now = {(r.request_id, r.stage_id, r.value, r.from_version, r.until_version) for r in first.collect()}
    assert now == {
        ("enough", "s0", None, 0, None), ("silent", "s9", None, 0, None), ("short", "s0", None, 0, 1),
        ("short", "app_short_clone", "3", 1, None), ("hopeless", "s0", None, 0, 1),
    }
    back = next_uses(first, spark.createDataFrame([("short", 20, "ENFORCED", None, None)], schema), 2)
    own = {(r.stage_id, r.from_version, r.until_version) for r in back.collect() if r.request_id == "short"}
    assert own == {("s0", 0, 1), ("app_short_clone", 1, 2), ("s0", 2, None)}
    reports = spark.createDataFrame([("s0", v, 10 * v, 1) for v in range(3)], "stage_id string, version long, report_ms long, n long")
    got = {(r.request_id, r.report_ms) for r in reports_of_versions(reports, back, demands).collect()}
    assert got == {("enough", 0), ("enough", 10), ("enough", 20), ("short", 0), ("short", 20), ("hopeless", 0)}
    edges = edges_of(spark, demands)
    healed = next_edges(edges, decided)
    again = next_edges(healed, decided.where("request_id = 'short'"))
    assert Counter(map(tuple, again.collect())) == Counter(map(tuple, healed.collect()))
    undone = next_edges(healed, spark.createDataFrame([("short", 20, "ENFORCED", None, None)], schema))
    assert Counter(map(tuple, undone.collect())) == Counter(map(tuple, edges.where("request_id != 'hopeless'").collect()))
    untouched = next_uses(uses, decided.limit(0), 1)
    assert Counter(map(tuple, untouched.collect())) == Counter(map(tuple, uses.collect()))
