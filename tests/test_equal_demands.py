"""Requests of equal demands are routed, counted and judged once, and each gets what it would get alone."""

from collections import Counter

import pytest

from tidegauge.catalog import rates
from tidegauge.catalog.base import QUERIES
from tidegauge.operators import monitor

SHAPE = "request_id string, stage_id string, min_per_s double, start_ms long, until_ms long"
ROWS = [
    ("a", "x", 0.5, 0, 60_000), ("b", "x", 0.5, 0, 60_000), ("c", "x", 0.9, 0, 60_000), ("d", "y", 0.5, 3_000, 50_000),
    # one id twice, on two stages, and with equal rows
    ("e", "x", 0.5, 0, 60_000), ("e", "y", 0.5, 0, 60_000), ("f", "y", 0.5, 0, 60_000), ("f", "x", 0.5, 0, 60_000),
    ("g", "x", 0.5, 0, 60_000), ("g", "x", 0.5, 0, 60_000), (None, "x", 0.5, 0, 60_000), ("h", None, 0.5, 0, 60_000),
]


def _rows(df):
    return Counter(tuple(r) for r in df.select(*sorted(df.columns)).collect())


def test_groups_give_what_each_request_gets(spark):
    requests = spark.createDataFrame(ROWS, SHAPE)
    times = [(s, t, "p", 1 + t % 3) for s, every in (("x", 1_000), ("y", 7_000)) for t in range(0, 61_000, every) if t % 9_000 < 6_000]
    reports = spark.createDataFrame(times, "stage_id string, report_ms long, producer string, n long")
    groups, members = monitor.equal_demands(requests)
    together = {r.group_id: set() for r in members.collect()}
    for r in members.collect():
        together[r.group_id].add(r.request_id)
    assert sorted(sorted(g) for g in together.values()) == [["a", "b"], ["c"], ["d"], ["e", "f"], ["g"], ["h"]]

    known = requests.where("request_id is not null")
    routed = monitor.reports_to_requests(reports, groups)
    assert _rows(monitor.for_members(routed, members)) == _rows(monitor.reports_to_requests(reports, known))
    counts = monitor.windows_of_requests(reports, groups, groups, 5_000)
    alone = monitor.windows_of_requests(reports, known, known, 5_000)
    assert _rows(monitor.for_members(counts, members)) == _rows(alone)
    for consecutive in (False, True):
        found = monitor.window_violations(counts, groups, step_ms=5_000, consecutive=consecutive)
        want = monitor.window_violations(alone, known, step_ms=5_000, consecutive=consecutive)
        assert _rows(monitor.for_members(found, members)) == _rows(want)


@pytest.mark.parametrize(
    "name, operator",
    [
        ("st11_count_by_hour", "windows_of_requests"), ("st7_violations_by_hour", "window_violations"),
        ("jn8_reports_of_seconds", "reports_to_requests"), ("st11_count_from_reports", "count_by_window"),
        ("st8_symptom_buffer", "window_violations"),
    ],
)
def test_reports_meet_each_demand_once(spark, small, monkeypatch, name, operator):
    """What reports are joined with grows with the different demands, not with the requests."""
    seen, whole = [], getattr(monitor, operator)

    def watched(rows, requests, *args, **options):
        seen.append(requests)
        return whole(rows, requests, *args, **options)

    monkeypatch.setattr(monitor, operator, watched)
    QUERIES[name](spark, small)
    demands = rates._demands(spark, small)
    different = demands.select("stage_id", "min_per_s").distinct().count()
    assert different < demands.count()
    assert [r.count() for r in seen] == [different]
