"""Evidence is refused before it is compared, with every reason."""

import hashlib
import json

import pytest

from plumbline.operators.reconcile import gated_evidence
from plumbline.sources.evidence import altered_endpoints, evidence_cells, read_evidence


def canonical(value):
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def side(rows, rows_only=False, **changes):
    out = {"status": "AVAILABLE" if rows else "NOT_AVAILABLE", "complete": bool(rows), "result_sha256": None, "rows": rows}
    if rows:
        text = canonical(rows) if rows_only else canonical({k: out[k] for k in ("complete", "rows", "status")}) + "\n"
        out["result_sha256"] = hashlib.sha256(text.encode()).hexdigest()
    return {**out, **changes}


def cells(**values):
    return [{"coordinates": {"T.C": k}, "value": v} for k, v in values.items()]


TWICE = cells(a=1) + cells(a=1)
CASES = {
    "same": ("INTEGER", side(cells(a=1, b=None)), side(cells(b=None, a=1)), 0, "", "PASSED"),
    "close": ("decimal", side(cells(a=0.5, é=1.0)), side(cells(a=0.5000000001, é=1)), 0, "", "PASSED"),
    "close and large": ("DECIMAL", side(cells(a=1e15)), side(cells(a=10**15 + 1)), 0, "", "PASSED"),
    "large": ("DECIMAL", side(cells(a=10**15)), side(cells(a=10**15 + 1)), 1, "", "FAILED"),
    "differs": ("DECIMAL", side(cells(a=1, b=2.5)), side(cells(a=2, c=1)), 3, "", "FAILED"),
    "absent": ("INTEGER", side(cells(a=1)), side([]), None, "", "NOT_AVAILABLE"),
    "twice": ("INTEGER", side(TWICE), side(cells(a=1)), None, "DUPLICATE", "REFUSED"),
    "twice alone": ("INTEGER", side(TWICE), side([]), None, "DUPLICATE", "REFUSED"),
    "point": ("INTEGER", side(cells(a=1.0)), side(cells(a=1)), None, "TYPE", "REFUSED"),
    "point beside blank": ("INTEGER", side(cells(a=1.5)), side(cells(a=None)), 1, "", "FAILED"),
    "point alone": ("INTEGER", side(cells(a=1, b=1.5)), side(cells(a=1)), 1, "", "FAILED"),
    "altered": ("INTEGER", side(cells(a=1), result_sha256="0"), side(cells(a=1)), None, "HASH", "REFUSED"),
    "no hash": ("INTEGER", side(cells(a=1)), side(cells(a=1), result_sha256=None), None, "HASH", "REFUSED"),
    "hash of nothing": ("INTEGER", side(cells(a=1)), side([], result_sha256="0"), None, "AVAILABILITY", "REFUSED"),
    "partial": ("INTEGER", side(cells(a=1)), side([], status="AVAILABLE", complete=True), None, "AVAILABILITY,HASH", "REFUSED"),
    "label": ("MONEY", side(cells(a=1)), side(cells(a=1)), None, "LABEL", "REFUSED"),
    "truth": ("INTEGER", side(cells(a=True)), side(cells(a=1)), None, "ROW", "REFUSED"),
    "text": ("DECIMAL", side(cells(a="1")), side(cells(a=1)), None, "ROW", "REFUSED"),
    "more": ("INTEGER", side([{**cells(a=1)[0], "x": 1}]), side(cells(a=1)), None, "ROW", "REFUSED"),
    "no coordinates": ("INTEGER", side([{"coordinates": [1], "value": 1}]), side(cells(a=1)), None, "ROW", "REFUSED"),
}


def endpoints(spark, cases):
    docs = [
        (json.dumps({"source_measure": name, "slice": "S", "value_type": kind, "source": a, "target": b}, ensure_ascii=False),)
        for name, (kind, a, b, *_) in cases.items()
    ]
    return read_evidence(spark.createDataFrame(docs, "j string"), "j")


@pytest.fixture(scope="module")
def verdicts(spark):
    return {r.source_measure: (r.mismatches, r.faults, r.status) for r in gated_evidence(endpoints(spark, CASES)).collect()}


@pytest.mark.parametrize("name", CASES)
def test_gate(verdicts, name):
    assert verdicts[name] == CASES[name][3:]


def test_hash_of_the_rows_alone(spark):
    rows = cells(a=1.0, b=0.25, c=3)
    case = {"x": ("DECIMAL", side(rows, True), side(rows, False))}
    assert [r.side for r in altered_endpoints(endpoints(spark, case), rows_only=True).collect()] == ["target"]
    assert [r.side for r in altered_endpoints(endpoints(spark, case)).collect()] == ["source"]
    assert gated_evidence(endpoints(spark, case), rows_only=True).first().faults == "HASH"


def test_kinds(spark):
    rows = cells(a=1, b=1.0, c=1.5, d=None, e=True, f="1", g=12345678901234567890, h=1e300)
    got = {r.coordinates[-3]: r.kind for r in evidence_cells(endpoints(spark, {"x": ("DECIMAL", side(rows), side([]))})).collect()}
    assert got == {"a": "INTEGER", "b": "DECIMAL", "c": "DECIMAL", "d": "BLANK", "e": "OTHER", "f": "OTHER", "g": "INTEGER", "h": "DECIMAL"}


def test_a_record_given_twice_is_refused(spark):
    case = endpoints(spark, {"x": ("INTEGER", side(cells(a=1)), side(cells(a=1)))})
    got = gated_evidence(case.unionByName(case)).first()
    assert (got.faults, got.status) == ("AVAILABILITY,DUPLICATE", "REFUSED")


def test_nothing(spark):
    assert gated_evidence(endpoints(spark, {"x": CASES["same"]}).limit(0)).count() == 0
