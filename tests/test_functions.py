import math

import pytest
from pyspark.sql import functions as F

from tidegauge.functions import naming, params, quality, trail
from tidegauge.operators import enrich, filters
from tidegauge.schema import Compat

INF = float("inf")
NAN = float("nan")


def one(spark, column, **values):
    frame = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()] or [F.lit(0)])
    return frame.select(column.alias("x")).first()["x"]


def scored(spark, rows, **options):
    frame = spark.createDataFrame(rows, "value double, lo double, hi double")
    got = frame.select(quality.accuracy(F.col("value"), F.col("lo"), F.col("hi"), **options).alias("a")).collect()
    return [r["a"] for r in got]


def test_accuracy_in_range_is_100_and_a_fraction_outside(spark):
    rows = [(5.0, 0.0, 10.0), (0.0, 0.0, 10.0), (10.0, 0.0, 10.0), (12.0, 0.0, 10.0), (-4.0, 0.0, 10.0)]
    assert scored(spark, rows) == [100.0, 100.0, 100.0, 0.8, 0.6]


def test_accuracy_one_width_away_is_zero(spark):
    assert scored(spark, [(20.0, 0.0, 10.0), (-10.0, 0.0, 10.0), (7.0, 5.0, 5.0)]) == [0.0, 0.0, 0.0]


def test_accuracy_percent_scale(spark):
    assert scored(spark, [(12.0, 0.0, 10.0)], scale="percent") == [80.0]
    with pytest.raises(ValueError):
        quality.accuracy(F.col("a"), F.col("b"), F.col("c"), scale="other")


def test_accuracy_of_nan(spark):
    assert scored(spark, [(NAN, 0.0, 10.0)]) == [None]
    assert scored(spark, [(NAN, 0.0, 10.0)], compat=Compat(nan_is_accurate=True)) == [1.0]


def test_accuracy_without_bounds_is_zero(spark):
    assert scored(spark, [(1.0, None, 10.0), (1.0, 0.0, None), (NAN, None, None)]) == [0.0, 0.0, 0.0]


def test_accuracy_with_infinite_bounds(spark):
    assert scored(spark, [(-1e9, -INF, 10.0), (11.0, -INF, 10.0), (5.0, 0.0, INF), (-5.0, 0.0, INF)]) == [
        100.0, 0.0, 100.0, 0.0,
    ]


def test_bounds(spark):
    assert one(spark, quality.parse_bound(F.lit("-INF"))) == -INF
    assert one(spark, quality.parse_bound(F.lit("+INF"))) == INF
    assert one(spark, quality.parse_bound(F.lit("-12.5"))) == -12.5
    assert one(spark, quality.parse_bound(F.lit("far"))) is None
    low = one(spark, quality.parse_bound(F.lit("-INF"), Compat(float_infinity=True)))
    assert 0 < low < 1e-44
    # With the compat bound a negative value is out of range.
    assert scored(spark, [(-1.0, low, 10.0)]) == [pytest.approx(0.9)]


def test_stamps(spark):
    assert one(spark, trail.append_stamp(F.lit(""), "in", 5)) == "in:5"
    assert one(spark, trail.append_stamp(F.lit(None).cast("string"), "in", 5)) == "in:5"
    assert one(spark, trail.append_stamp(F.lit("produced:1"), "in", 5)) == "produced:1;in:5"


def test_trail_with_repeated_steps(spark):
    text = F.lit("produced:1;in:5;in:9")
    assert one(spark, trail.trail_time(text, "in")) == 9
    assert one(spark, trail.trail_time(text, "out")) is None
    assert one(spark, trail.first_trail_time(text)) == 1
    assert one(spark, trail.first_trail_time(F.lit(""))) is None
    assert one(spark, trail.end_to_end_ms(text, 11)) == 10
    assert one(spark, trail.platform_ms(text, "produced", "in")) == 8


@pytest.mark.parametrize(
    "text,ms", [("150 ms", 150), ("2 s", 2000), ("3 min", 180_000), ("3 mins", 180_000), ("1 hour", 3_600_000),
                ("24 hours", 86_400_000), ("unset", None), (None, None)]
)
def test_ages(spark, text, ms):
    assert params.parse_age(text) == ms
    assert one(spark, params.age_ms(F.lit(text).cast("string"))) == ms


@pytest.mark.parametrize("text", ["150ms", "x ms", "1 day", "5/s", ""])
def test_malformed_ages(spark, text):
    with pytest.raises(ValueError):
        params.parse_age(text)
    assert one(spark, params.age_ms(F.lit(text))) is None


@pytest.mark.parametrize("text,rate", [("5/s", (5, 1000)), ("2/min", (2, 60_000)), ("2/mins", (2, 60_000)),
                                       ("7/hour", (7, 3_600_000)), ("7/hours", (7, 3_600_000))])
def test_rates(spark, text, rate):
    assert params.parse_rate(text) == rate
    assert tuple(one(spark, params.rate(F.lit(text)))) == rate


@pytest.mark.parametrize("text", ["5", "a/s", "5/day", "5 s"])
def test_malformed_rates(spark, text):
    with pytest.raises(ValueError):
        params.parse_rate(text)
    assert one(spark, params.rate(F.lit(text))) is None


def test_names(spark):
    assert one(spark, naming.local_name(F.lit("http://a/b#c"))) == "c"
    assert one(spark, naming.local_name(F.lit("abc"))) == ""
    assert one(spark, naming.selection_topic(F.lit("temperature"), F.lit("ALL"), F.lit("INFORMATION"))) == "temperature_ALL_INFO"
    assert one(spark, naming.level_abbrev(F.lit("other"))) == "RD"
    assert one(spark, naming.quality_topic(F.lit("a"), F.lit("r"), 1)) == "a_r_QOO1"


def test_padded_messages(spark):
    text = one(spark, naming.pad_message("t", 0, F.lit(12), 60))
    assert text == "Topic:t:ThreadID:0:MessageID:0000000012:".ljust(60, "x")
    assert one(spark, naming.pad_message("t", 0, F.lit(12), 10)) == "Topic:t:ThreadID:0:MessageID:0000000012:"


def test_maps(spark):
    values = F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2"), F.lit("c"), F.lit("2"))
    assert one(spark, quality.get_attribute(values, "a")) == "1"
    assert one(spark, quality.get_attribute(values, "z")) == ""
    assert one(spark, quality.key_by_value(values, "2")) == "b"
    assert one(spark, quality.key_by_value(values, "9")) is None


def test_threshold_defaults_and_nan(spark):
    obs = spark.createDataFrame([(v,) for v in (-5.0, 0.0, 3.0, 10.0, NAN)], "value double")

    def kept(*args, **kw):
        return [r["value"] for r in filters.filter_threshold(obs, *args, **kw).collect()]

    assert kept() == [-5.0, 0.0, 3.0, 10.0]
    assert kept(None, 3.0) == [-5.0, 0.0, 3.0]
    assert kept(0.0, 3.0) == [0.0, 3.0]
    assert kept(None, 10.0, compat=Compat(positive_default_min=True)) == [3.0, 10.0]


def test_age_is_strict_and_unset_keeps_all(spark):
    obs = spark.createDataFrame([("produced:100;in:190",), ("produced:150",), ("produced:151",)], "timestamps string")
    assert filters.filter_age(obs, "50 ms", 200).count() == 1
    assert filters.filter_age(obs, "unset", 200).count() == 3
    assert filters.filter_age(obs, F.lit(None).cast("bigint"), 200).count() == 3


def test_bypass_prefixes(spark):
    obs = spark.createDataFrame([("a",), ("b",), ("weather_1",), (None,)], "producer string")
    assert {r[0] for r in filters.allow_sensors(obs, "a;c").collect()} == {"a"}
    assert {r[0] for r in filters.allow_sensors(obs, "a", ["weather_"]).collect()} == {"a", "weather_1"}
    table = spark.createDataFrame([("b",), ("b",)], "sensor_id string")
    assert [r[0] for r in filters.allow_sensors(obs, table).collect()] == ["b"]
    assert {r[0] for r in filters.allow_sensors(obs, table, ["weather_"]).collect()} == {"b", "weather_1"}


def test_attributes_in_wish_order_and_unknown_names(spark):
    full = F.create_map(F.lit("OBS_ACCURACY"), F.lit("1"), F.lit("OBS_FRESHNESS"), F.lit("2"))
    got = one(spark, filters.select_attributes(full, "OBS_FRESHNESS;OBS_ACCURACY"))
    assert list(got.items()) == [("OBS_FRESHNESS", "2"), ("OBS_ACCURACY", "1")]
    assert one(spark, filters.select_attributes(full, "")) == {}
    with pytest.raises(ValueError):
        filters.select_attributes(full, ["OBS_COLOUR"])
    with pytest.raises(Exception, match="OBS_COLOUR"):
        one(spark, filters.select_attributes(full, F.array(F.lit("OBS_COLOUR"))))


def test_capability_rows_overwrite_each_other(spark):
    obs = spark.createDataFrame([("a", 5.0), ("b", 5.0), ("x", 5.0)], "producer string, value double")
    caps = spark.createDataFrame(
        [("a", "0", "1", 1), ("a", "0", "9", 2), ("b", "-INF", "+INF", 1)],
        "sensor_id string, min_value string, max_value string, version int",
    )
    got = {r["producer"]: (r["min_value"], r["max_value"]) for r in enrich.with_capability(obs, caps, "version").collect()}
    assert got == {"a": (0.0, 9.0), "b": (-INF, INF), "x": (None, None)}


def test_user_attribute(spark):
    registry = enrich.AttributeRegistry()
    registry.register("OBS_RATE", lambda df: F.col("value") / F.col("max_value"), ("max_value",))
    obs = spark.createDataFrame([(5.0, 10.0)], "value double, max_value double")
    assert enrich.score(obs, ["OBS_RATE"], registry).first()["obs_rate"] == 0.5
    with pytest.raises(ValueError, match="max_value"):
        enrich.score(obs.drop("max_value"), ["OBS_RATE"], registry)


def test_freshness_is_a_double(spark):
    age = one(spark, quality.freshness(F.lit(100).cast("bigint"), 250))
    assert age == 150.0 and isinstance(age, float) and not math.isnan(age)
