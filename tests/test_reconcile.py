"""Comparison rules, with the boundary cases."""

import pytest
from pyspark.sql import functions as F

from plumbline.operators import reconcile as r


def verdicts(spark, cases, value_type="DECIMAL"):
    frame = spark.createDataFrame(
        [(i, a, b) for i, (a, b, _) in enumerate(cases)], "i int, a string, b string"
    )
    got = frame.select("i", r.texts_match(F.lit(value_type), F.col("a"), F.col("b")).alias("m"))
    return [row.m for row in got.orderBy("i").collect()]


def test_texts_match(spark):
    cases = [
        ("1", "1", True),
        ("1", "1.0", True),
        ("0.1", "0.1000000005", True),
        ("0.1", "0.100000002", False),
        ("1000000000.0", "1000000000.5", True),
        ("1000000000", "1000000001", False),
        ("123456789012345678901234567890", "123456789012345678901234567891", False),
        ("123456789012345678901234567890", "123456789012345678901234567890", True),
        (None, None, True),
        (None, "0", False),
        ("0", None, False),
        ("NaN", "NaN", False),
        ("Infinity", "Infinity", False),
        ("true", "true", False),
    ]
    assert verdicts(spark, cases) == [want for *_, want in cases]


def test_integer_label_wants_integers(spark):
    cases = [("5", "5", True), ("5", "5.0", False), ("5.0", "5.0", False), (None, None, True)]
    assert verdicts(spark, cases, "INTEGER") == [want for *_, want in cases]


def test_cells_and_summary(spark):
    left = spark.createDataFrame([("m", None, 1.0), ("m", "a", None), ("m", "b", 2.0), ("n", "a", 1.0)], "metric string, k string, value double")
    right = spark.createDataFrame([("m", None, 1.0), ("m", "a", None), ("m", "c", 2.0), ("o", "a", 1.0)], "metric string, k string, value double")
    cells = r.compare_cells(left, right, ["metric", "k"])
    got = {(c.metric, c.k): c.verdict for c in cells.collect()}
    assert got == {
        ("m", None): "MATCH",
        ("m", "a"): "MATCH",
        ("m", "b"): "ONLY_LEFT",
        ("m", "c"): "ONLY_RIGHT",
        ("n", "a"): "ONLY_LEFT",
        ("o", "a"): "ONLY_RIGHT",
    }
    status = {s.metric: (s.cells, s.mismatches, s.status) for s in r.summarise_cells(cells, ["metric"]).collect()}
    assert status == {"m": (4, 2, "FAILED"), "n": (1, 1, "NOT_AVAILABLE"), "o": (1, 1, "NOT_AVAILABLE")}


def test_status_roll_up(spark):
    required = r.expected_pairs(spark, {"a": ["S1", "S2"], "b": ["S1", "S2"], "c": ["S1"]})
    observed = spark.createDataFrame(
        [("a", "S1", "PASSED"), ("a", "S2", "FAILED"), ("b", "S1", "PASSED"), ("c", "S1", "PASSED")],
        "metric string, slice string, status string",
    )
    covered = r.slice_coverage(required, observed)
    assert {(c.metric, c.slice): c.status for c in covered.collect()}["b", "S2"] == "NOT_AVAILABLE"
    rolled = {s.metric: s.status for s in r.roll_up_status(covered).collect()}
    assert rolled == {"a": "FAILED", "b": "NOT_AVAILABLE", "c": "PASSED"}


def test_duplicates_and_missing_groupings(spark):
    rows = spark.createDataFrame([("x", None), ("x", None), ("y", 1)], "k string, n int")
    got = r.duplicate_coordinates(rows, ["k", "n"]).collect()
    assert [tuple(g) for g in got] == [("x", None, 2)]
    declared = spark.createDataFrame([("x",), ("z",)], "k string")
    assert [g.k for g in r.missing_groupings(rows, declared, ["k"]).collect()] == ["z"]


def test_fingerprint_ignores_order_and_sees_copies(spark):
    rows = [("g", 1, "a"), ("g", 2, "b"), ("h", 1, None)]
    schema = "g string, n int, t string"
    one = r.fingerprint(spark.createDataFrame(rows, schema), ["g"], ["n", "t"])
    two = r.fingerprint(spark.createDataFrame(rows[::-1], schema), ["g"], ["n", "t"])
    assert r.stale(one, two, ["g"]).collect() == []
    copied = r.fingerprint(spark.createDataFrame(rows + rows[:1], schema), ["g"], ["n", "t"])
    assert [s.g for s in r.stale(copied, one, ["g"]).collect()] == ["g"]
    gone = r.fingerprint(spark.createDataFrame(rows[:2], schema), ["g"], ["n", "t"])
    assert [s.g for s in r.stale(gone, one, ["g"]).collect()] == ["h"]


def test_three_way(spark):
    schema = "k string, value double"
    source = spark.createDataFrame([("ok", 1.0), ("third", 1.0), ("bad", 1.0), ("alone", 1.0)], schema)
    repository = spark.createDataFrame([("ok", 1.0), ("third", 1.0), ("bad", 2.0)], schema)
    third = spark.createDataFrame([("third", 3.0), ("bad", 2.0), ("only", 1.0)], schema)
    got = {s.k: s.status for s in r.three_way(source, repository, third, ["k"]).collect()}
    assert got == {
        "ok": "PASSED",
        "third": "FAILED",
        "bad": "FAILED",
        "alone": "NOT_AVAILABLE",
        "only": "NOT_AVAILABLE",
    }


def test_evidence_records(spark):
    import json

    from plumbline.sources.evidence import read_evidence

    def side(values):
        rows = [{"coordinates": {"T.C": k}, "value": v} for k, v in (values or {}).items()]
        return {
            "status": "AVAILABLE" if rows else "NOT_AVAILABLE",
            "complete": bool(rows),
            "result_sha256": None,
            "rows": rows,
        }

    def record(name, kind, left, right):
        return (json.dumps({"source_measure": name, "slice": "S", "value_type": kind, "source": side(left), "target": side(right)}),)

    docs = [
        record("same", "DECIMAL", {"a": 0.1, "b": None}, {"a": 0.1000000005, "b": None}),
        record("big", "DECIMAL", {"a": 10**9}, {"a": 10**9 + 1}),
        record("missing", "INTEGER", {"a": 1, "b": 2}, {"a": 1}),
        record("none", "INTEGER", {"a": 1}, None),
    ]
    endpoints = read_evidence(spark.createDataFrame(docs, "j string"), "j")
    cells = r.compare_evidence(endpoints)
    got = {s.source_measure: (s.mismatches, s.status) for s in r.evidence_status(endpoints, cells).collect()}
    assert got == {
        "same": (0, "PASSED"),
        "big": (1, "FAILED"),
        "missing": (1, "FAILED"),
        "none": (None, "NOT_AVAILABLE"),
    }


def test_overall_needs_one_row(spark):
    frame = spark.createDataFrame([("a", "OVERALL"), ("b", "OVERALL"), ("b", "OVERALL"), ("c", "X")], "metric string, slice string")
    got = {x.metric: x.overall_rows for x in r.overall_errors(frame, ["metric"]).collect()}
    assert got == {"b": 2, "c": 0}
