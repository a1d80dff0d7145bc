"""Streams give the rows of their batch forms, whatever the order within the delay."""

import datetime as dt
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidegauge.functions.clock import epoch_ms
from tidegauge.operators import enrich, monitor, rates
from tidegauge.sources import fixtures as fx
from tidegauge.sources import observations as src
from tidegauge.sources import sinks
from tidegauge.streaming import mechanisms as m
from tidegauge.streaming import runs
from tidegauge.streaming.ordered import use_rocksdb

HOUR = 3_600_000
LATER = dt.datetime(2024, 6, 1)


@pytest.fixture(scope="module", autouse=True)
def store(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    use_rocksdb(spark)
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "8")


@pytest.fixture(scope="module")
def obs(spark, small):
    return fx.observations(spark, small)


def arriving(spark, frame, path, parts=4, seed=None, ts="date"):
    """Files in time order (or shuffled), then a row far ahead that moves the watermark."""
    rows = [r.asDict() for r in frame.orderBy(ts).collect()]
    if seed is not None:
        random.Random(seed).shuffle(rows)
    cut = (len(rows) + parts - 1) // parts
    for i in range(parts):
        chunk = spark.createDataFrame(rows[i * cut : (i + 1) * cut], frame.schema)
        chunk.coalesce(1).write.mode("append").parquet(f"{path}/in")
    last = {**rows[0], ts: LATER}
    for f in frame.schema.fields:
        if f.dataType.typeName() == "string":
            last[f.name] = "heartbeat"
    spark.createDataFrame([last], frame.schema).coalesce(1).write.mode("append").parquet(f"{path}/in")
    return spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")


def finished(spark, frame, path, name):
    query = (
        frame.writeStream.format("memory").queryName(name).outputMode("append")
        .option("checkpointLocation", f"{path}/{name}").trigger(availableNow=True).start()
    )
    query.awaitTermination(240)
    return spark.table(name).collect()


@pytest.mark.parametrize("seed,delay,anchor", [(None, "1 second", "first"), (7, "40 days", "epoch")])
def test_rate_limit(spark, obs, tmp_path, seed, delay, anchor):
    stream = arriving(spark, obs, str(tmp_path), seed=seed)
    options = dict(n=2, period_ms=6 * HOUR, keys=["topic"], anchor=anchor)
    got = finished(spark, m.RATE_LIMIT(stream, delay=delay, **options), str(tmp_path), f"limit_{anchor}")
    expected = m.RATE_LIMIT(obs, **options).collect()
    assert Counter(got) == Counter(expected)


def test_samples(spark, obs, tmp_path):
    stream = arriving(spark, obs, str(tmp_path), seed=3)
    options = dict(period_ms=5 * HOUR, keys=["topic"])
    got = finished(spark, m.SAMPLE(stream, delay="40 days", **options), str(tmp_path), "sample")
    assert Counter(got) == Counter(m.SAMPLE(obs, **options).collect())


def test_rate_reports(spark, obs, tmp_path):
    stream = arriving(spark, obs, str(tmp_path), seed=5)
    options = dict(period_ms=12 * HOUR, keys=["topic"])
    got = finished(spark, m.RATE_REPORTS(stream, delay="40 days", **options), str(tmp_path), "reports")
    expected = m.RATE_REPORTS(obs, **options).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, expected))


def test_repeats(spark, obs, tmp_path):
    stream = arriving(spark, obs, str(tmp_path), parts=3)
    got = finished(
        spark, m.REPEAT(stream, window_ms=24 * HOUR, keys=["producer"], delay="10 days"), str(tmp_path), "repeats"
    )
    known = int(LATER.replace(tzinfo=dt.timezone.utc).timestamp() * 1000) - 10 * 24 * HOUR
    expected = rates.repeat_last(obs, 24 * HOUR, known - 1, keys=["producer"]).collect()

    def plain(rows):
        return Counter((r["obs_id"], r["emit_ms"], r["repeated"]) for r in rows)

    assert plain(got) == plain(expected)


def test_clones_need_no_state(spark, obs, tmp_path):
    stream = arriving(spark, obs, str(tmp_path), parts=1)
    got = finished(spark, m.CLONE(stream, n=2), str(tmp_path), "clones")
    assert len(got) == 2 * (obs.count() + 1)


def moments(frame, ms, name):
    return frame.withColumn(name, F.timestamp_millis(F.col(ms)))


def test_violations_also_in_silence(spark, tmp_path):
    rnd = random.Random(1)
    start = 1_704_067_200_000
    demands = [(f"r{i}", rate, start, start + 300_000) for i, rate in enumerate([0.1, 0.5, 1.0])]
    counts = [(f"r{i}", start + rnd.randint(0, 299_999), rnd.randint(1, 9)) for i in (0, 1) for _ in range(25)]
    demand = spark.createDataFrame(demands, "request_id string, min_per_s double, start_ms long, until_ms long")
    count = spark.createDataFrame(counts, "request_id string, report_ms long, n long")
    beats = demand.select("request_id", F.col("start_ms").alias("report_ms"), F.lit(0).cast("long").alias("n"))
    rows = moments(count.unionByName(beats).join(demand, "request_id"), "report_ms", "report_time")
    stream = arriving(spark, rows, str(tmp_path), parts=3, ts="report_time")
    got = finished(spark, m.stream_min_rate_violations(stream), str(tmp_path), "violations")
    expected = monitor.min_rate_violations(count, demand).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, expected))
    assert any(r["request_id"] == "r2" for r in got)


def test_buffer_and_heals(spark, tmp_path):
    rnd = random.Random(2)
    rows, at = [], {}
    for _ in range(300):
        name = rnd.choice(["a", "b", "c"])
        at[name] = at.get(name, 1_704_067_200_000) + rnd.randint(1_000, 60_000)
        rows.append((name, f"stage_{name}", at[name], "GUARANTEED" if name == "a" else "BEST_EFFORT"))
    symptoms = spark.createDataFrame(rows, "request_id string, stage_id string, symptom_ms long, sla_level string")
    buffered = monitor.symptom_buffer(symptoms)
    timed = moments(symptoms, "symptom_ms", "symptom_time")
    stream = arriving(spark, timed, f"{tmp_path}/b", parts=2, ts="symptom_time")
    got = finished(spark, m.stream_symptom_buffer(stream), f"{tmp_path}/b", "buffer")
    expected = moments(buffered, "symptom_ms", "symptom_time").select(*timed.columns, "act").collect()
    assert Counter(got) == Counter(expected)

    remedy = ("clone", "copies", "Integer", "1", "HIGH")
    names = "remedy string, param string, type string, initial string, param_variation string"
    chosen = spark.createDataFrame([remedy], names)
    acting = moments(buffered, "symptom_ms", "symptom_time")
    stream = arriving(spark, acting, f"{tmp_path}/h", parts=2, ts="symptom_time")
    healed = finished(
        spark, m.stream_heal_decisions(stream, chosen.first().asDict(), max_retries=2), f"{tmp_path}/h", "heals"
    )
    expected = monitor.heal_decisions(buffered, symptoms.select("request_id", "sla_level").distinct(), chosen, max_retries=2)
    assert Counter(map(tuple, healed)) == Counter(map(tuple, expected.collect()))


def test_stateless_chain_on_a_stream(spark, obs, small, tmp_path):
    sensors = fx.sensors(spark, small)
    stream = arriving(spark, obs, str(tmp_path), parts=2)
    rows = enrich.with_sensor_context(stream, sensors)
    got = finished(spark, rows.select("obs_id", "sensorContext.*"), str(tmp_path), "context")
    expected = enrich.with_sensor_context(obs, sensors).select("obs_id", "sensorContext.*")
    assert len(got) == obs.count() + 1
    assert set(expected.collect()) <= set(got)


def test_decode_and_deliver(spark, obs, small, tmp_path):
    fx.messages(spark, small).write.parquet(f"{tmp_path}/msg")
    stream = src.read_observations(
        spark, f"{tmp_path}/msg", streaming=True, schema="obs_id long, topic string, message string", topics=["view", "error"]
    )
    decoded = src.decode_observation(stream)
    named = decoded.withColumn("delivery_topic", F.concat(F.lit("app_"), F.col("topic")))
    query = sinks.stream_delivery(named, f"{tmp_path}/out", f"{tmp_path}/ck")
    query.awaitTermination(120)
    back = spark.read.parquet(f"{tmp_path}/out")
    wanted = obs.where(F.col("topic").isin("view", "error"))
    assert back.count() == wanted.count()
    assert {r[0] for r in back.select("delivery_topic").distinct().collect()} == {"app_view", "app_error"}
    sinks.write_delivery(named_batch(obs), f"{tmp_path}/batch")
    assert spark.read.parquet(f"{tmp_path}/batch").count() == obs.count()


def named_batch(obs):
    return obs.withColumn("delivery_topic", F.concat(F.lit("app_"), F.col("topic")))


def test_live_context_and_parameters(spark, obs, tmp_path):
    stream = arriving(spark, obs, str(tmp_path), parts=2)
    calls, seen = [], []

    def sensors():
        calls.append(1)
        place = f"place{len(calls)}"
        return obs.select(F.col("producer").alias("sensor_id"), F.lit(place).alias("relative_location")).distinct()

    def write(frame, batch):
        seen.append((batch, {r[0] for r in frame.select("sensorContext.relativeLocation").distinct().collect()}))

    runs.with_live_context(stream, sensors, write, f"{tmp_path}/live").awaitTermination(240)
    assert [s for _, s in seen[:2]] == [{"place1"}, {"place2"}]

    limits, kept = iter(["0.0", "100.0", "100.0"]), []
    runs.with_live_parameters(
        stream,
        lambda: {"most": next(limits)},
        lambda df, p: df.where(F.col("value") <= float(p["most"])),
        lambda df, b: kept.append(df.agg(F.max("value")).first()[0]),
        f"{tmp_path}/params",
    ).awaitTermination(240)
    assert kept[0] <= 0.0 < kept[1] <= 100.0


def test_three_outlets(spark, obs, tmp_path):
    stream = arriving(spark, obs, str(tmp_path), parts=2)
    frames = {
        "delivery": stream,
        "quality": m.SAMPLE(stream, period_ms=12 * HOUR, delay="1 hour"),
        "rate": m.RATE_REPORTS(stream, period_ms=12 * HOUR, delay="1 hour"),
    }
    for query in runs.start_outlets(frames, f"{tmp_path}/out", f"{tmp_path}/ck").values():
        query.awaitTermination(240)
    batch = rates.tee(obs, 12 * HOUR, 12 * HOUR)
    for name, extra in (("delivery", 1), ("quality", 0), ("rate", 0)):
        assert spark.read.parquet(f"{tmp_path}/out/{name}").count() == batch[name].count() + extra


def test_checkpoint_folder(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        assert runs.checkpoint_root(spark, "/x") == named
    else:
        assert runs.checkpoint_root(spark, "/x") == "/x"
        with pytest.raises(ValueError):
            runs.checkpoint_root(spark)


def test_mechanisms_can_be_added(spark, obs):
    reg = m.MechanismRegistry()
    added = reg.register("head", lambda df, ms: df.where(epoch_ms(df, "date") < ms))
    assert reg["head"] is added and added(obs, ms=fx.AS_OF_MS).count() == obs.count()
    with pytest.raises(ValueError):
        added(spark.readStream.format("rate").load(), ms=0)


def test_late_rows_are_counted(spark, obs, tmp_path):
    """Rows far behind the watermark are dropped, and the query says how many."""
    late = obs.orderBy("date").limit(5)
    late_rows = [r.asDict() for r in late.collect()]
    stream = arriving(spark, obs, str(tmp_path))
    spark.createDataFrame(late_rows, obs.schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    limited = m.RATE_LIMIT(stream, delay="1 second", n=2, period_ms=6 * HOUR, keys=["topic"], anchor="first")
    query = (
        limited.writeStream.format("memory").queryName("late").outputMode("append")
        .option("checkpointLocation", f"{tmp_path}/late").trigger(availableNow=True).start()
    )
    query.awaitTermination(240)
    assert runs.late_rows(query) >= 5
