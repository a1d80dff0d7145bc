"""Requests, tees and tables that change on running streams, against their batch forms."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tests.test_streaming import LATER, arriving
from tidegauge.plans import chain
from tidegauge.sources import fixtures as fx
from tidegauge.streaming import batches
from tidegauge.streaming.enforce import Enforcement
from tidegauge.streaming.ordered import delay_ms, use_rocksdb


@pytest.fixture(scope="module", autouse=True)
def store(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    use_rocksdb(spark)
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "8")


@pytest.fixture(scope="module")
def obs(spark, small):
    return fx.observations(spark, small).cache()


def test_requests_come_and_go(spark, small, obs, tmp_path):
    """One request joins a chain, one brings a chain of its own, one takes the last of a chain with it and another comes back."""
    asked = [
        ("a1", "ALL", "ALL", None, None, "1/hour", "unset", {0, 1}),
        ("a2", "ALL", "ALL", None, None, "1/hour", "unset", {1, 2, 3, 4, 5}),
        ("b1", "ALL", "ALL", -50.0, 120.0, None, "72 hours", {0, 1, 2, 3, 4, 5}),
        ("c1", "view", "ALL", None, None, "1/hour", "unset", {2, 3, 4, 5}),
        ("d1", "ALL", "ASIA", -50.0, None, "1/hour", "unset", {0, 1, 2, 4, 5}),
        ("e1", "click", "ALL", None, None, None, "unset", {0, 1, 2}),
    ]
    schema = "request_id string, topic string, area string, threshold_min double, threshold_max double, obsrate_max string, age_max string"
    requests = spark.createDataFrame([r[:7] for r in asked], schema).cache()
    sensors, capabilities = fx.sensors(spark, small).cache(), fx.capabilities(spark, small).cache()
    listed = [r[0] for r in asked]
    present = [{r[0] for r in asked if number in r[7]} for number in range(6)]
    stream = arriving(spark, obs, str(tmp_path), parts=5, seed=3)
    files = {}
    calls = []

    def read_requests():
        calls.append(len(calls))
        return requests.where(F.col("request_id").isin(*present[min(calls[-1], 5)]))

    run = Enforcement(spark, f"{tmp_path}/run", delay="40 days")

    def remember(batch, number):
        files[number] = [r.obs_id for r in batch.select("obs_id").collect()]

    stream.writeStream.foreachBatch(remember).option("checkpointLocation", f"{tmp_path}/ck0").trigger(availableNow=True).start().awaitTermination(240)
    run.route(stream, read_requests, lambda: sensors, f"{tmp_path}/ck1").awaitTermination(240)
    run.deliver(obs.schema, lambda: capabilities, lambda f, n: batches.write_once(f, f"{tmp_path}/out", f"batch={n}"), f"{tmp_path}/ck2", fx.AS_OF_MS).awaitTermination(240)
    out = spark.read.option("recursiveFileLookup", "true").parquet(f"{tmp_path}/out").where(F.col("date") < F.lit(LATER)).cache()
    got = Counter((r.spec, r.obs_id, r.obs_accuracy, r.obs_freshness) for r in out.collect())
    assert len(files) == 6 and len(calls) == 6

    members = chain.chain_members(requests)
    specs = requests.withColumn("key", F.sha2(chain.sharing_key(chain.SELECTION), 256)).select("request_id", "key").join(members, "request_id")
    spec_of = {r.request_id: r["key"] for r in specs.collect()}
    want = Counter()
    for spec in set(spec_of.values()):
        own = [r for r in listed if spec_of[r] == spec]
        stretches, run_of = [], []
        for number in range(6):
            if any(r in present[number] for r in own):
                run_of.append(number)
            elif run_of:
                stretches.append(run_of)
                run_of = []
        for stretch in [*stretches, *([run_of] if run_of else [])]:
            ids = [i for number in stretch for i in files[number]]
            rows = chain.enforce_requests(obs.where(F.col("obs_id").isin(ids)), requests.where(F.col("request_id") == own[0]), sensors, capabilities, fx.AS_OF_MS)
            want += Counter((spec, r.obs_id, r.obs_accuracy, r.obs_freshness) for r in rows.collect())
    assert got == want and sum(got.values()) > 0
    limits = Counter(r.spec for r in out.collect())
    assert limits[spec_of["a1"]] < limits[spec_of["b1"]] + limits[spec_of["a1"]] < obs.count()
    # a2 came later than its chain, d1 again later, and a1 and e1 are gone
    per_request = {}
    for r in run.to_requests(out).collect():
        per_request.setdefault(r.request_id, set()).add(r.batch)
    firsts = {"a2": 1, "b1": 0, "c1": 2, "d1": 4}
    assert set(per_request) == set(firsts) and all(min(per_request[r]) >= first for r, first in firsts.items())

    # a batch that is handed over again changes nothing
    before = sorted(batches.Folder(spark, f"{tmp_path}/run/routed").names())
    assert not batches.write_once(obs, f"{tmp_path}/run/routed", before[0])


def test_state_of_a_chain_ends_with_it():
    import pandas as pd

    from tidegauge.streaming.enforce import _limit_by_row

    def frame(*rows):
        return pd.DataFrame(rows, columns=["_ts", "limit_n", "limit_ms", "ends"])

    memory, out, wake = _limit_by_row(None, frame((0, 2, 100, False), (10, 2, 100, False), (20, 2, 100, False)), 50)
    assert out["_ts"].tolist() == [0, 10] and memory["count"] == 2 and wake == 100
    assert _limit_by_row(memory, frame((60, None, None, True)), 70)[0] is None
    memory, out, wake = _limit_by_row(memory, frame((99, 2, 100, False), (100, 1, 50, False), (149, 1, 50, False)), 149)
    assert out["_ts"].tolist() == [100] and wake == 150
    assert _limit_by_row(memory, frame(), 150)[0] is None  # the window is over


def test_tee_reads_its_source_once(spark, obs, tmp_path):
    stream = arriving(spark, obs, str(tmp_path), parts=3)
    reads = spark.sparkContext.accumulator(0)

    def seen(rows):
        for batch in rows:
            reads.add(batch.num_rows)
            yield batch

    outlets = {
        "delivery": lambda rows: rows.select("obs_id", "value"),
        "quality": lambda rows: rows.where("value > 0"),
        "rate": lambda rows: rows.groupBy("producer").agg(F.count(F.lit(1)).alias("n")),
    }
    broken = {**outlets, "quality": lambda rows: rows.withColumn("x", F.raise_error(F.lit("lost")))}
    once = stream.mapInArrow(seen, stream.schema)
    failing = batches.start_tee(once, broken, f"{tmp_path}/out", f"{tmp_path}/ck")
    with pytest.raises(Exception):
        failing.awaitTermination(240)
    assert spark.read.option("recursiveFileLookup", "true").parquet(f"{tmp_path}/out/delivery").count() > 0
    batches.start_tee(once, outlets, f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination(240)
    everything = spark.read.schema(stream.schema).parquet(f"{tmp_path}/in")
    read = {name: spark.read.option("recursiveFileLookup", "true").parquet(f"{tmp_path}/out/{name}") for name in outlets}
    assert Counter(r.obs_id for r in read["delivery"].collect()) == Counter(r.obs_id for r in everything.collect())
    assert read["quality"].count() == everything.where("value > 0").count()
    assert read["rate"].agg(F.sum("n")).first()[0] == everything.count() == reads.value
    assert not [n for n in batches.Folder(spark, f"{tmp_path}/out/_input").names() if n.startswith("batch")]


def test_table_of_a_stream_of_changes(spark, tmp_path):
    rnd = random.Random(5)
    rows = [(f"r{rnd.randrange(20)}", n, rnd.choice(["CREATED", "ENFORCED", "HEALED"]), rnd.random() < 0.2) for n in range(120)]
    schema = "request_id string, at long, status string, removed boolean"
    versions, table = [], {}
    for part in range(4):
        chunk = rows[part * 30 : part * 30 + 30]
        spark.createDataFrame(rnd.sample(chunk, 30), schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        for r in chunk:
            table.pop(r[0], None)
            if not r[3]:
                table[r[0]] = r[:3]
        versions.append(dict(table))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    kept = batches.Snapshots(spark, f"{tmp_path}/table")
    assert kept.read() is None
    batches.start_upserts(stream, f"{tmp_path}/table", ["request_id"], ["at"], f"{tmp_path}/ck", deleted="removed").awaitTermination(240)
    assert kept.manifest() == {"version": 3, "batch": 3}
    assert {r.request_id: tuple(r) for r in kept.read().collect()} == versions[-1]
    old = spark.read.parquet(f"{tmp_path}/table/v=2")
    assert {r.request_id: tuple(r) for r in old.collect()} == versions[2]
    # replays and data without a manifest are harmless
    late = spark.createDataFrame([("r0", 999, "X", False)], schema)
    assert kept.write(batches.merge_changes(kept.read(), late, ["request_id"], ["at"], "removed"), 3) == 3
    late.write.parquet(f"{tmp_path}/table/v=4")
    assert {r.request_id: tuple(r) for r in kept.read().collect()} == versions[-1]
    assert kept.write(batches.merge_changes(kept.read(), late, ["request_id"], ["at"], "removed"), 4) == 4
    assert {r.request_id: r.status for r in kept.read().collect()}["r0"] == "X"
    older = spark.createDataFrame([("r0", 5, "OLD", False), ("r1", 1000, "gone", True)], schema)
    found = {r.request_id: r.status for r in batches.merge_changes(kept.read(), older, ["request_id"], ["at"], "removed").collect()}
    assert found["r0"] == "X" and "r1" not in found


def test_delays():
    assert [delay_ms(x) for x in ("10 minutes", "interval 1 day 2 hours", "3 seconds")] == [600_000, 93_600_000, 3000]

