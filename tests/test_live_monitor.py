"""Monitoring and healing on streams give the rows of their batch forms, late and shuffled rows included."""

import random
from collections import Counter

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.test_streaming import arriving, finished, moments
from tidegauge.operators import monitor
from tidegauge.operators.requests import latest_per
from tidegauge.streaming import mechanisms as m
from tidegauge.streaming import runs
from tidegauge.streaming.ordered import OrderedProcessor, use_rocksdb

START = 1_704_067_200_000
REMEDY = "request_id string, since_ms long, remedy string, param string, type string, initial string, param_variation string"


@pytest.fixture(scope="module", autouse=True)
def store(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    use_rocksdb(spark)
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "8")


def symptoms_of(spark, seed=11, n=8):
    rnd, rows = random.Random(seed), []
    for i in range(n):
        at = START
        for _ in range(30):
            at += rnd.choice([7_000, 12_000, 20_000] if i < 4 else [7_000, 20_000, 65_000])
            rows.append((f"r{i}", at, rnd.random() < 0.8, "GUARANTEED" if i % 2 else "BEST_EFFORT"))
    return spark.createDataFrame(rows, "request_id string, symptom_ms long, act boolean, sla_level string")


def changes_of(spark, n=8):
    rows = []
    for i in range(n - 1):  # the last request never has a remedy
        rows.append((f"r{i}", START, "clone", "copies", "Integer", "1", "HIGH"))
        if i % 3 == 0:
            rows.append((f"r{i}", START + 50_000, "repeat", "window", "Integer", "50", "LOW"))
            rows.append((f"r{i}", START + 110_000, "smooth", "mode", "String", "x", "HIGH"))
        if i % 3 == 1:
            rows.append((f"r{i}", START + 40_000, None, None, None, None, None))
            rows.append((f"r{i}", START + 100_000, "clone", "copies", "Integer", "1", "HIGH"))
    return spark.createDataFrame(rows, REMEDY)


def by_state(symptoms, changes, retries, observe=60_000, lifetime=30_000):
    """One request as a state machine that remembers which remedies it tried."""
    tries, tried, until, before, out = 0, Counter(), None, None, []
    for at, act, sla in symptoms:
        if until is not None and at > max(until, before + lifetime):
            tries, tried, until = 0, Counter(), None
        before = at
        if not act or (until is not None and at < until):
            continue
        now = [c for c in changes if c[0] <= at]
        remedy = now[-1][1:] if now and now[-1][1] is not None else None
        if remedy is None or (tries >= retries and tried[remedy[0]]):
            out.append((at, tries + 1, "NO_REMEDY" if remedy is None else "GIVE_UP", "REMOVED" if sla == "GUARANTEED" else "ENFORCED", None, None, None))
            return out
        value = remedy[3] if remedy[2] != "Integer" else str(int(remedy[3]) + {"HIGH": 1, "LOW": -1}[remedy[4]] * tried[remedy[0]])
        tries += 1
        tried[remedy[0]] += 1
        out.append((at, tries, "HEAL", "HEALED", remedy[0], remedy[1], value))
        until = at + observe
    return out


def test_heals_with_changing_remedies(spark, tmp_path):
    retries = 2
    symptoms, changes = symptoms_of(spark), changes_of(spark)
    want = Counter()
    for i in range(8):
        own = sorted((r.symptom_ms, r.act, r.sla_level) for r in symptoms.where(F.col("request_id") == f"r{i}").collect())
        own_changes = sorted((tuple(r)[1:] for r in changes.where(F.col("request_id") == f"r{i}").collect()), key=lambda c: c[0])
        want += Counter((f"r{i}", *row) for row in by_state(own, own_changes, retries))
    requests = symptoms.select("request_id", "sla_level").distinct()
    batch = monitor.heal_decisions(symptoms, requests, changes, max_retries=retries)
    assert Counter(map(tuple, batch.collect())) == want
    assert any(row[2] > retries and row[3] == "HEAL" for row in want)  # a remedy that was new after the last retry
    stream = arriving(spark, moments(symptoms, "symptom_ms", "symptom_time"), f"{tmp_path}/s", parts=2, seed=4, ts="symptom_time")
    changed = arriving(spark, moments(changes, "since_ms", "symptom_time"), f"{tmp_path}/c", parts=2, seed=5, ts="symptom_time")
    got = finished(spark, m.stream_heal_decisions(stream, changed, max_retries=retries, delay="40 days"), str(tmp_path), "heals_changing")
    assert Counter(map(tuple, got)) == want


def test_heals_with_a_remedy_for_each_request(spark, tmp_path):
    symptoms = symptoms_of(spark, 12)
    chosen = changes_of(spark).where(F.col("since_ms") == START).drop("since_ms")
    chosen = chosen.withColumn("remedy", F.when(F.col("request_id") == "r1", F.lit("other")).otherwise(F.col("remedy")))
    stream = arriving(spark, moments(symptoms, "symptom_ms", "symptom_time"), str(tmp_path), parts=2, seed=6, ts="symptom_time")
    got = finished(spark, m.stream_heal_decisions(stream, chosen, max_retries=2, delay="40 days"), str(tmp_path), "heals_own")
    want = monitor.heal_decisions(symptoms, symptoms.select("request_id", "sla_level").distinct(), chosen, max_retries=2)
    assert Counter(map(tuple, got)) == Counter(map(tuple, want.collect()))


def test_silent_requests_raise_symptoms(spark, tmp_path):
    """Requests without any report, with their windows opened by the request table and closed by timers."""
    rnd = random.Random(3)
    demands = [(f"r{i}", rate, START + 500 * i, START + 300_000) for i, rate in enumerate([0.1, 0.5, 1.0, 0.2, 0.0])]
    demand = spark.createDataFrame(demands, "request_id string, min_per_s double, start_ms long, until_ms long")
    counts = [("r1", START + rnd.randint(500, 299_999), rnd.randint(1, 9)) for _ in range(40)]
    count = spark.createDataFrame(counts, "request_id string, report_ms long, n long")
    rows = moments(count.join(demand, "request_id"), "report_ms", "report_time")
    stream = arriving(spark, rows, str(tmp_path), parts=3, seed=2, ts="report_time")
    got = finished(spark, m.stream_min_rate_violations(stream, demands=demand, delay="10 minutes"), str(tmp_path), "silent")
    want = monitor.min_rate_violations(count, demand).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, want))
    assert {r.request_id for r in got} == {"r0", "r1", "r2", "r3"}


def test_windows_of_requests(spark, tmp_path):
    """Several stages and phases; a row behind the delay is dropped and counted."""
    rnd = random.Random(9)
    usage = spark.createDataFrame(
        [("s0", "a"), ("s0", "b"), ("s1", "b"), ("s1", "c"), ("s1", "c"), ("s2", "d")], "stage_id string, request_id string"
    )
    requests = spark.createDataFrame(
        [("a", START, START + 200_000), ("b", START + 3_700, START + 150_000), ("c", START + 13_700, START + 205_000), ("d", START, START + 9_000)],
        "request_id string, start_ms long, until_ms long",
    )
    rows = [(f"s{rnd.randrange(3)}", START + rnd.randrange(220_000), f"p{rnd.randrange(3)}", rnd.randint(1, 5)) for _ in range(400)]
    reports = spark.createDataFrame(rows, "stage_id string, report_ms long, producer string, n long")
    stream = arriving(spark, moments(reports, "report_ms", "report_time"), str(tmp_path), parts=2, seed=1, ts="report_time")
    late = moments(reports.limit(3), "report_ms", "report_time")
    # the row that moves the watermark must be of a stage that is used
    ahead = late.limit(1).withColumns({"stage_id": F.lit("s0"), "report_time": F.timestamp_millis(F.lit(START + 9 * 86_400_000))})
    for frame in (ahead, ahead, late, ahead):
        frame.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    query = (
        m.stream_windows_of_requests(stream, usage, requests, 10_000, delay="10 minutes")
        .writeStream.format("memory").queryName("windows").outputMode("append")
        .option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    )
    query.awaitTermination(240)
    want = monitor.windows_of_requests(reports, usage, requests, 10_000).collect()
    assert Counter(map(tuple, spark.table("windows").collect())) == Counter(map(tuple, want))
    assert runs.late_rows(query) >= 1


def test_stable_requests(spark, tmp_path):
    rnd = random.Random(8)
    heals = [(f"s{i % 4}", f"r{i}", START + rnd.randrange(0, 2_000_000, 1000)) for i in range(60)]
    symptoms = [(f"s{rnd.randrange(4)}", START + rnd.randrange(0, 2_000_000, 1000)) for _ in range(50)]
    symptoms += [("s0", heals[0][2]), ("s1", heals[1][2] + 60_000)]
    heal = spark.createDataFrame(heals, "stage_id string, request_id string, heal_ms long")
    symptom = spark.createDataFrame(symptoms, "stage_id string, symptom_ms long")
    of_heals = arriving(spark, moments(heal, "heal_ms", "at"), f"{tmp_path}/h", parts=2, seed=1, ts="at")
    of_symptoms = arriving(spark, moments(symptom, "symptom_ms", "at"), f"{tmp_path}/s", parts=2, seed=2, ts="at")
    got = finished(spark, m.stream_stable_requests(of_heals, of_symptoms, delay="40 days"), str(tmp_path), "stable")
    want = monitor.stable_requests(heal, symptom).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, want)) and 0 < len(want) < 60


def test_latest_rows_of_each_key(spark, tmp_path):
    rnd = random.Random(7)
    rows = [(f"r{rnd.randrange(5)}", START + rnd.randrange(50) * 1000, rnd.randrange(100), rnd.random()) for _ in range(300)]
    reports = moments(spark.createDataFrame(rows, "request_id string, report_ms long, seq long, freshness double"), "report_ms", "at")
    for part in range(5):
        reports.where(F.col("seq") % 5 == part).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(reports.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    last, held = {}, []

    def remember(batch, number):
        new = {}
        for r in batch.collect():
            new.setdefault(r.request_id, []).append(tuple(r))
        held.extend(len(x) for x in new.values())
        last.update(new)

    recent = m.stream_latest_per(stream, 4, "at", ["request_id"], ["seq", "freshness"])
    writer = recent.writeStream.outputMode("update").foreachBatch(remember).option("checkpointLocation", f"{tmp_path}/ck")
    writer.trigger(availableNow=True).start().awaitTermination(240)
    want = latest_per(reports, 4, "at", ["request_id"], ["seq", "freshness"]).collect()
    assert Counter(x for rows in last.values() for x in rows) == Counter(map(tuple, want))
    assert max(held) == 4 and len(held) > 5


class Kept:
    """State that stands in for a handle's, and counts what is read."""

    def __init__(self):
        self.rows, self.read = {}, 0

    def keys(self):
        return list(self.rows)

    def containsKey(self, key):
        return key in self.rows

    def getValue(self, key):
        self.read += 1
        return self.rows[key]

    def updateValue(self, key, value):
        self.rows[key] = value

    def removeKey(self, key):
        del self.rows[key]


def test_held_rows_are_read_by_time():
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("x", T.LongType()), T.StructField("_ts", T.LongType())])
    processor = OrderedProcessor(None, schema, ["_ts", "x"], ["x"], 100)
    processor.held = Kept()
    rows = [(i, (i * 37) % 5000) for i in range(5000)]
    for begin in range(0, 5000, 500):
        processor._hold(pd.DataFrame(rows[begin : begin + 500], columns=["x", "_ts"]))
    processor.held.read, out = 0, []
    for known in range(50, 5200, 250):
        ready, first = processor._due(known)
        out += [tuple(r) for r in ready.itertuples(index=False)]
        assert first is None or first >= known - known % 100
    assert out == sorted(rows, key=lambda r: (r[1], r[0])) and not processor.held.rows
    assert processor.held.read <= 50 + 21  # each bucket once, and again where time stopped inside it
