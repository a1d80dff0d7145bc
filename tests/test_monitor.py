import random

import pytest

from tidegauge.operators import monitor
from tidegauge.schema import Compat

REMEDY = "remedy string, param string, type string, initial string, param_variation string"


def demand_frame(spark, rows):
    return spark.createDataFrame(
        rows, "request_id string, min_per_s double, start_ms long, until_ms long, sla_level string"
    )


def by_ticks(counts, need, start, until, step, k, consecutive):
    """Window by window, silent ones included."""
    out, short, window = [], 0, 0
    while start + (window + 1) * step <= until:
        low, high = start + window * step, start + (window + 1) * step
        n = sum(c for t, c in counts if low <= t < high)
        if n < need:
            short += 1
            if short >= k:
                out.append((window, high))
                short = 0
        elif consecutive:
            short = 0
        window += 1
    return out


@pytest.mark.parametrize("consecutive", [False, True])
@pytest.mark.parametrize("k", [1, 2, 3])
def test_violations_equal_a_walk_over_all_windows(spark, k, consecutive):
    rnd = random.Random(k)
    demands, counts, expected = [], [], {}
    for i in range(12):
        name, rate = f"r{i}", rnd.choice([0.1, 0.5, 1.0, 0.0])
        start, until = rnd.randint(0, 30_000), rnd.randint(100_000, 400_000)
        mine = [(rnd.randint(0, 400_000), rnd.randint(1, 12)) for _ in range(rnd.choice([0, 3, 40]))]
        demands.append((name, rate, start, until, "GUARANTEED"))
        counts += [(name, t, n) for t, n in mine]
        if rate > 0:
            expected[name] = by_ticks(mine, rate * 10, start, until, 10_000, k, consecutive)
    frame = spark.createDataFrame(counts, "request_id string, report_ms long, n long")
    got = monitor.min_rate_violations(
        frame, demand_frame(spark, demands), events_before_symptom=k, consecutive=consecutive
    ).collect()
    found = {name: [] for name in expected}
    for r in got:
        found[r["request_id"]].append((r["window"], r["symptom_ms"]))
    assert {n: sorted(v) for n, v in found.items()} == expected


def test_minimum_rates(spark):
    rows = [("a", "60/min", None), ("b", "5/s", "9/s"), ("c", None, None), ("d", "odd", None)]
    req = spark.createDataFrame(rows, "request_id string, obsrate_min string, obsrate_max string")
    assert [tuple(r) for r in monitor.minimum_rates(req).collect()] == [("a", 1.0)]
    compat = monitor.minimum_rates(req, Compat(per_second_minimum=True)).collect()
    assert [tuple(r) for r in compat] == [("a", 60.0)]


def test_buffer_needs_unexpired_symptoms(spark):
    rows = [("s", "r", t) for t in (0, 10_000, 50_000, 60_000, 89_000)]
    frame = spark.createDataFrame(rows, "stage_id string, request_id string, symptom_ms long")

    def acting(n):
        got = monitor.symptom_buffer(frame, symptoms_before_action=n).where("act").collect()
        return sorted(r["symptom_ms"] for r in got)

    assert acting(1) == [0, 10_000, 50_000, 60_000, 89_000]
    assert acting(2) == [10_000, 60_000, 89_000]
    assert acting(3) == []


def heal_by_state(symptoms, sla, remedy, observe, retries, lifetime):
    """One request as a state machine: symptoms (ms, act) in order."""
    tries, until, before, out = 0, None, None, []
    for at, act in symptoms:
        if until is not None and at > max(until, before + lifetime):
            tries, until = 0, None
        before = at
        if not act or (until is not None and at < until):
            continue
        if remedy is None or tries == retries:
            out.append((at, tries + 1, "NO_REMEDY" if remedy is None else "GIVE_UP",
                        "REMOVED" if sla == "GUARANTEED" else "ENFORCED", None))
            return out
        tries += 1
        value = remedy[3]
        if remedy[2] == "Integer":
            value = str(int(value) + {"HIGH": 1, "LOW": -1}.get(remedy[4], 0) * (tries - 1))
        out.append((at, tries, "HEAL", "HEALED", value))
        until = at + observe
    return out


@pytest.mark.parametrize(
    "remedy",
    [None, ("clone", "copies", "Integer", "1", "HIGH"), ("window", "ms", "Integer", "50", "LOW"),
     ("mode", "name", "String", "x", "HIGH"), ("same", "n", "Integer", "5", "CONSTANT")],
)
def test_heal_decisions_equal_a_state_machine(spark, remedy):
    rnd = random.Random(3)
    requests, rows, expected = [], [], {}
    for i in range(40):
        name, sla = f"r{i}", rnd.choice(["GUARANTEED", "BEST_EFFORT"])
        mean = rnd.choice([5_000, 15_000, 45_000])
        at, mine = 0, []
        for _ in range(rnd.randint(0, 60)):
            at += rnd.randint(1_000, 2 * mean)
            mine.append((at, rnd.random() < 0.7))
        requests.append((name, sla))
        rows += [(name, t, a) for t, a in mine]
        expected[name] = heal_by_state(mine, sla, remedy, 60_000, 3, 30_000)
    symptoms = spark.createDataFrame(rows, "request_id string, symptom_ms long, act boolean")
    got = monitor.heal_decisions(
        symptoms,
        spark.createDataFrame(requests, "request_id string, sla_level string"),
        spark.createDataFrame([remedy] if remedy else [], REMEDY),
        max_retries=3,
    ).collect()
    found = {name: [] for name in expected}
    for r in got:
        found[r["request_id"]].append((r["decided_ms"], r["attempt"], r["decision"], r["status"], r["value"]))
    assert {n: sorted(v) for n, v in found.items()} == expected
    if remedy:
        assert any(r["decision"] == "GIVE_UP" for r in got) and any(r["attempt"] == 3 for r in got)


def test_stable_requests(spark):
    heals = spark.createDataFrame(
        [("s", "a", 0), ("s", "b", 100_000), ("t", "c", 0), ("u", "d", 0)], "stage_id string, request_id string, heal_ms long"
    )
    symptoms = spark.createDataFrame(
        [("s", 0), ("s", 60_000), ("s", 100_000), ("s", 170_000), ("t", 60_001)], "stage_id string, symptom_ms long"
    )
    got = monitor.stable_requests(heals, symptoms).collect()
    assert sorted((r["request_id"], r["stable_ms"]) for r in got) == [("b", 160_000), ("c", 60_000), ("d", 60_000)]
    later = monitor.stable_requests(heals, symptoms, as_of_ms=100_000).collect()
    assert sorted(r["request_id"] for r in later) == ["c", "d"]


def test_reports_reach_every_request_of_a_stage(spark):
    reports = spark.createDataFrame(
        [("p", 1, "x", 2), ("p", 1, "y", 3), ("q", 1, "x", 7)], "stage_id string, report_ms long, producer string, n long"
    )
    usage = spark.createDataFrame([("p", "a"), ("p", "b"), ("q", "b")], "stage_id string, request_id string")
    got = {r["request_id"]: r["n"] for r in monitor.reports_to_requests(reports, usage).collect()}
    assert got == {"a": 5, "b": 12}
