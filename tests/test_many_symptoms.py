"""Symptoms of one instant: only the first few of each batch of rows are ranked."""

import random

from tidegauge.operators import monitor


def test_buffer_of_many_symptoms_of_one_instant(spark):
    rng = random.Random(6)
    rows = [(s, t, f"r{rng.randrange(400)}" if rng.random() > 0.01 else None) for s in ("x", "y", None) for t in (10, 20, 50, None) for _ in range(300)]
    rows += [("z", 5, "a"), ("z", 5, "a"), ("z", 5, "b"), ("z", 5, "c"), ("w", 1, None), ("w", 1, "a")]
    symptoms = spark.createDataFrame(rows, "stage_id string, symptom_ms long, request_id string").repartition(5)
    for needed in (2, 3, 5):
        found = monitor.symptom_buffer(symptoms, symptoms_before_action=needed, lifetime_ms=15)
        want = []
        for s, t, r in rows:
            earlier = sum(1 for a, b, _ in rows if a == s and None not in (b, t) and t - 15 <= b < t)
            place = len({c or "" for a, b, c in rows if (a, b) == (s, t) and (c or "") < (r or "")})
            want.append((s, t, r, t is not None and earlier + min(place, needed - 1) >= needed - 1))
        assert sorted(map(str, found.collect())) == sorted(str(x) for x in spark.createDataFrame(want, "stage_id string, symptom_ms long, request_id string, act boolean").collect())


def test_few_symptoms_of_a_batch_are_ranked(spark):
    rows = spark.range(0, 40_000, 1, 2).selectExpr("'x' as stage_id", "1L as symptom_ms", "cast(id as string) as request_id")
    assert monitor._first_of_batches(rows, 2, 2).count() <= 2 * 40_000 // 1000 + 4
