"""Topics as numbered messages: appended once, read once, from any offset."""

import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidegauge.sources import fixtures as fx
from tidegauge.sources.observations import read_observations
from tidegauge.streaming import topics


@pytest.fixture(scope="module")
def sent(spark, small):
    rows = fx.messages(spark, small).select("obs_id", "topic", "message")
    return rows.withColumn("topic", F.when(F.col("topic") == "view", "a b/ü=1%").otherwise(F.col("topic"))).cache()


def batch(sent, number, of=4):
    return sent.where(F.pmod(F.xxhash64("obs_id"), F.lit(of)) == number)


def counted(rows):
    return Counter((r.topic, r.message) for r in rows)


def whole(rows):
    """Offsets of every topic have no gap and no number twice."""
    by_topic = {}
    for r in rows:
        by_topic.setdefault(r.topic, []).append(r.offset)
    return all(sorted(own) == list(range(min(own), min(own) + len(own))) for own in by_topic.values())


def run(frame, path, name):
    """One run over what is there; files, so that a restarted stream adds to them."""
    query = frame.writeStream.format("parquet").option("path", f"{path}/{name}").option("checkpointLocation", f"{path}/ck-{name}")
    query.trigger(availableNow=True).start().awaitTermination(240)
    return frame.sparkSession.read.parquet(f"{path}/{name}").collect()


def test_batches_are_appended_once(spark, sent, tmp_path):
    path = str(tmp_path)
    unnamed = spark.createDataFrame([(None, "x")], "topic string, message string")
    assert topics.append_messages(batch(sent, 0).select("topic", "message").unionByName(unnamed), path, "0")
    assert topics.append_messages(batch(sent, 1), path, "1")
    assert not topics.append_messages(batch(sent, 1), path, "1")
    rows = topics.read_topics(spark, path).collect()
    assert counted(rows) == counted(batch(sent, 0).unionByName(batch(sent, 1)).collect()) and whole(rows)
    one = read_observations(spark, path, fmt="topics", topics=["a b/ü=1%"]).collect()
    assert one and {r.topic for r in one} == {"a b/ü=1%"}
    later = topics.read_topics(spark, path, ["click"], starting={"click": 7}).collect()
    with pytest.raises(Exception, match="no such offset"):
        topics.read_topics(spark, f"file:{path}", starting={"click": 10**9}).collect()
    assert min(r.offset for r in later) == 7 and len(later) == sum(r.topic == "click" for r in rows) - 7


def test_an_empty_log_has_no_rows(spark, tmp_path):
    assert topics.read_topics(spark, f"{tmp_path}/none").count() == 0
    nothing = spark.createDataFrame([], "topic string, message string")
    assert topics.append_messages(nothing, str(tmp_path), "0")
    assert topics.read_topics(spark, str(tmp_path)).count() == 0


def test_a_restarted_stream_reads_each_message_once(spark, sent, tmp_path):
    path = f"{tmp_path}/log"
    stream = read_observations(spark, path, fmt="topics", streaming=True)
    for number in range(4):
        topics.append_messages(batch(sent, number), path, str(number))
        rows = run(stream, tmp_path, "out")
        so_far = sent.where(F.pmod(F.xxhash64("obs_id"), F.lit(4)) <= number)
        assert counted(rows) == counted(so_far.collect()) and whole(rows)
    assert len(run(stream, tmp_path, "out")) == len(rows)


def test_latest_leaves_out_what_was_there(spark, sent, tmp_path):
    path = f"{tmp_path}/log"
    topics.append_messages(batch(sent, 0).where("topic <> 'click'"), path, "0")
    stream = topics.read_topics(spark, path, starting="latest", streaming=True)
    query = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck")
    running = query.trigger(processingTime="0 seconds").start()
    try:
        deadline = time.time() + 60
        while not (tmp_path / "ck" / "sources").exists() and not running.lastProgress and time.time() < deadline:
            time.sleep(0.2)
        topics.append_messages(batch(sent, 1), path, "1")
        want = counted(batch(sent, 1).collect())
        got = Counter()
        while got != want and time.time() < deadline and running.isActive:
            time.sleep(0.5)
            if (tmp_path / "out" / "_spark_metadata").exists():
                got = counted(spark.read.schema(topics.SCHEMA).parquet(f"{tmp_path}/out").collect())
    finally:
        running.stop()
    assert got == want


def test_limited_batches_take_their_share_and_go_on_after_a_restart(spark, sent, tmp_path):
    path = f"{tmp_path}/log"
    for number in range(2):
        topics.append_messages(batch(sent, number, 8), path, str(number))
    want = counted(batch(sent, 0, 8).unionByName(batch(sent, 1, 8)).collect())
    stream = topics.read_topics(spark, path, most=100, positions=f"{tmp_path}/at", streaming=True)
    sizes, rows = [], []
    while len(rows) < sum(want.values()) and len(sizes) < 20:
        before = len(rows)
        rows = run(stream, tmp_path, "out")
        sizes.append(len(rows) - before)
    assert counted(rows) == want and whole(rows)
    assert all(0 < size <= 105 for size in sizes) and len(sizes) > 1
    with pytest.raises(Exception, match="positions"):
        run(topics.read_topics(spark, path, most=1, streaming=True), tmp_path, "other")


def test_shares():
    assert topics.admitted({"a": 5}, {"a": 105, "b": 900}, 100) == {"a": 15, "b": 90}
    assert topics.admitted({}, {"a": 1, "b": 1_000_000}, 10) == {"a": 1, "b": 9}
    assert topics.admitted({"a": 3}, {"a": 3, "b": 2}, 10) == {"a": 3, "b": 2}
