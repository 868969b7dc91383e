"""Keyed differences and drift between snapshots."""

import re
from collections import Counter

from plumbline.operators import diff


def test_keyed_diff(spark):
    before = spark.createDataFrame([(1, "a", ""), (2, "b", "x"), (3, None, "y"), (4, "d", "z")], "k int, v string, w string")
    after = spark.createDataFrame([(1, "a", None), (2, "b", "x"), (3, "c", "q"), (5, "e", "z")], "k int, v string, w string")
    changes = diff.keyed_diff(before, after, ["k"])
    got = {r.k: (r.kind, [tuple(c) for c in r.changes]) for r in changes.collect()}
    assert got == {
        1: ("changed", [("w", "", None)]),
        3: ("changed", [("v", None, "c"), ("w", "y", "q")]),
        4: ("removed", []),
        5: ("added", []),
    }
    assert tuple(diff.diff_summary(changes).first()) == (1, 1, 2)
    assert diff.keyed_diff(before, before, ["k"]).collect() == []


def test_keyed_diff_with_a_field_on_one_side(spark):
    before = spark.createDataFrame([(1, "a")], "k int, v string")
    after = spark.createDataFrame([(1, "a", 7)], "k int, v string, extra int")
    (row,) = diff.keyed_diff(before, after, ["k"]).collect()
    assert [tuple(c) for c in row.changes] == [("extra", None, "7")]


def snapshots(spark, *tables):
    return [spark.createDataFrame(t, "k string, v string") for t in tables]


def drift(spark, base, expected, observed):
    frame = diff.snapshot_drift(*snapshots(spark, base, expected, observed), ["k"])
    return frame, diff.drift_status(frame).first()


def test_aligned_when_targets_changed_as_expected(spark):
    new = [("a", "2"), ("b", "1")]
    _, status = drift(spark, [("a", "1"), ("b", "1")], new, new)
    assert tuple(status) == (1, 1, 0, 0, "ALIGNED")


def test_stale_missing_and_extra_need_review(spark):
    base = [("a", "1"), ("b", "1")]
    _, stale = drift(spark, base, [("a", "2"), ("b", "1")], base)
    assert tuple(stale) == (1, 0, 1, 0, "MANUAL_REVIEW_REQUIRED")
    _, missing = drift(spark, base, base, base[:1])
    assert tuple(missing) == (0, 1, 1, 1, "MANUAL_REVIEW_REQUIRED")
    frame, extra = drift(spark, base, base, base + [("c", "1")])
    assert tuple(extra) == (0, 1, 1, 1, "MANUAL_REVIEW_REQUIRED")
    assert [r.k for r in frame.collect()] == ["c"]


def test_object_status(spark):
    schema = "k int, d string, m string"
    source = spark.createDataFrame([(1, "x", "p"), (2, "x", "p"), (3, "x", "p"), (4, "x", None)], schema)
    target = spark.createDataFrame([(1, "x", "p"), (2, "y", "q"), (3, "x", "q"), (5, "x", "p")], schema)
    got = {r.k: r.status for r in diff.object_status(source, target, ["k"], ["d"], ["m"]).collect()}
    assert got == {
        1: "MATCH",
        2: "DEFINITION_DRIFT",
        3: "METADATA_DRIFT",
        4: "MISSING_IN_TARGET",
        5: "MISSING_IN_SOURCE",
    }


def test_omitted_and_extra(spark):
    one = spark.createDataFrame([(1,), (2,)], "k int")
    two = spark.createDataFrame([(2,), (3,)], "k int")
    assert sorted((r.k, r.side) for r in diff.omitted_and_extra(one, two, ["k"]).collect()) == [(1, "omitted"), (3, "extra")]


def test_omitted_and_extra_in_parts_of_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(diff, "PART_ROWS", 100)
    one = [*range(1000), 5, 5, 999, None, None]
    two = [*range(10, 990), *range(2000, 2020), *range(2000, 2020), *[2000] * 500, None, None]
    frames = [spark.createDataFrame([(k,) for k in rows], "k long") for rows in (one, two)]
    sides = [(set(one) - set(two) | {None}, one), (set(two) - set(one) | {None}, two)]
    for once in (False, True):
        found = diff.omitted_and_extra(*frames, ["k"], extra_once=once)
        omitted, extra = (Counter(k for k in rows if k in open_) for open_, rows in sides)
        want = [(k, "omitted") for k in omitted.elements()] + [(k, "extra") for k in (set(extra) if once else extra.elements())]
        assert Counter((r.k, r.side) for r in found.collect()) == Counter(want)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "Broadcast" not in plan
        parts = -(-(len(one) + len(two)) // 100)
        assert set(re.findall(r"hashpartitioning\(k#\d+L?, (\d+)\)", plan)) == {str(parts)}
