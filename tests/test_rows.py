"""Row functions, sources and sinks."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions import durations, flags, formats, names
from plumbline.sources import evidence, sinks
from plumbline.sources.csv import read_csv
from plumbline.sources.spine import day_spine


def apply(spark, values, fn, kind="string"):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.o for r in frame.select("i", fn(F.col("v")).alias("o")).orderBy("i").collect()]


def test_durations(spark):
    cases = {
        "1:02:03": 3723,
        "01:02:03": 3723,
        "02:03": 123,
        "2:03": 123,
        " 10:00:00 ": 36000,
        "0:00:00": 0,
        "123:59:59": 446399,
        "1:60:00": None,
        "1:00:60": None,
        "60:00": None,
        "1:2:3": None,
        "": None,
        "abc": None,
        "-1:00": None,
        "1:00:00:00": None,
        "12": None,
        None: None,
        "12345:00:00": 44442000,
        "99999999999:00:00": 359999999996400,
        "9" * 30 + ":00:00": None,
    }
    assert apply(spark, list(cases), durations.to_seconds) == list(cases.values())


def test_flags(spark):
    frame = spark.createDataFrame([(True, None), (None, None), (False, True), (True, True)], "a boolean, b boolean")
    got = frame.select(flags.layer_count(F.col("a"), F.col("b")).alias("n"), flags.any_flag(F.col("a"), F.col("b")).alias("y"))
    assert [tuple(r) for r in got.collect()] == [(1, True), (0, False), (1, True), (2, True)]
    band = lambda c: flags.band(c, [(0.2, "mid"), (0.5, "high")], "low")
    assert apply(spark, [0.1, 0.2, 0.5, None], band, "double") == ["low", "mid", "high", None]


def test_formats(spark):
    assert apply(spark, [1234.5], lambda c: formats.display(c, "decimal_2"), "double") == ["1,234.50"]
    assert apply(spark, [1234567], lambda c: formats.display(c, "whole_number"), "long") == ["1234567"]
    assert apply(spark, [0.1234, 12.0, None], lambda c: formats.display(c, "percentage_1_decimal"), "double") == ["12.3%", "1200.0%", None]


def test_names(spark):
    values = ["# Events", "Bike Time (KM/H)", "__x__", "a.b-C", "", "é"]
    assert apply(spark, values, names.identifier_form) == ["EVENTS", "BIKE_TIME_KM_H", "X", "A_B_C", "", ""]
    assert apply(spark, values, names.compact_form) == ["events", "biketimekmh", "x", "abc", "", ""]


def test_stable_id_is_the_hash_of_canonical_json(spark):
    frame = spark.createDataFrame([("a\"b\\é", 7, None, True, 1.5)], "t string, n int, z string, b boolean, d double")
    got = frame.select(names.stable_id("fnd_", *map(F.col, frame.columns)).alias("i")).first().i
    text = json.dumps(list(frame.first()), ensure_ascii=False, sort_keys=True, separators=(",", ":")) + "\n"
    assert got == "fnd_" + hashlib.sha256(text.encode()).hexdigest()[:16]


def test_signature_does_not_depend_on_field_order(spark):
    frame = spark.createDataFrame([("x", None)], "a string, b string")
    one = names.signature({"a": F.col("a"), "b": F.col("b")})
    two = names.signature({"b": F.col("b"), "a": F.col("a")})
    row = frame.select(one.alias("one"), two.alias("two")).first()
    want = json.dumps({"a": "x", "b": None}, sort_keys=True, separators=(",", ":")) + "\n"
    assert row.one == row.two == hashlib.sha256(want.encode()).hexdigest()


def test_csv(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_text('id,amount,ok,name\n1,12.50,TRUE,"a, b"\n2,,false,\n')
    schema = T.StructType(
        [
            T.StructField("id", T.LongType()),
            T.StructField("amount", T.DecimalType(38, 18)),
            T.StructField("ok", T.BooleanType()),
            T.StructField("name", T.StringType()),
        ]
    )
    rows = read_csv(spark, str(path), schema).collect()
    assert [(r.id, r.amount and float(r.amount), r.ok, r.name) for r in rows] == [(1, 12.5, True, "a, b"), (2, None, False, None)]
    path.write_text("id,amount,ok,name\nx,1,true,a\n")
    with pytest.raises(Exception):
        read_csv(spark, str(path), schema).collect()


def document(**sides):
    record = {"source_measure": "m", "slice": "S", "value_type": "decimal"}
    for side in ("source", "target"):
        rows = sides.get(side)
        record[side] = {
            "status": "AVAILABLE" if rows else "NOT_AVAILABLE",
            "complete": bool(rows),
            "result_sha256": None,
            "rows": rows or [],
        }
    return json.dumps(record)


def test_evidence_keeps_types_apart(spark):
    rows = [
        {"coordinates": {"T.B": 1, "T.A": "x"}, "value": 1},
        {"coordinates": {"T.B": "1", "T.A": "x"}, "value": 1.5},
        {"coordinates": {"T.B": True, "T.A": None}, "value": None},
        {"coordinates": {}, "value": 12345678901234567890},
    ]
    frame = spark.createDataFrame([(document(source=rows),)], "j string")
    got = evidence.evidence_rows(evidence.read_evidence(frame, "j")).collect()
    assert {(r.side, r.coordinates, r.value) for r in got} == {
        ("source", '{"T.A":"x","T.B":1}', "1"),
        ("source", '{"T.A":"x","T.B":"1"}', "1.5"),
        ("source", '{"T.A":null,"T.B":true}', None),
        ("source", "{}", "12345678901234567890"),
    }
    assert {r.value_type for r in got} == {"DECIMAL"}


def test_contradictory_availability_is_reported(spark):
    good = document(source=[{"coordinates": {}, "value": 1}])
    empty = json.loads(good)
    empty["source"]["rows"] = []
    partial = json.loads(good)
    partial["source"]["complete"] = False
    docs = [(good,), (json.dumps(empty),), (json.dumps(partial),)]
    endpoints = evidence.read_evidence(spark.createDataFrame(docs, "j string"), "j")
    bad = evidence.availability_errors(endpoints).collect()
    assert len(bad) == 2 and {r.side for r in bad} == {"source"}


def test_spine(spark):
    frame = spark.createDataFrame([("2024-02-28",), ("2024-03-01",), (None,)], "d string").withColumn("d", F.to_date("d"))
    assert [str(r.date_day) for r in day_spine(frame, "d").collect()] == ["2024-02-28", "2024-02-29", "2024-03-01"]


def test_sinks(spark, tmp_path):
    long = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "metric string, value double")
    sinks.write_results(long, str(tmp_path / "r"))
    assert sorted(p.name for p in (tmp_path / "r").glob("metric=*")) == ["metric=a", "metric=b"]
    sinks.write_findings(long, str(tmp_path / "f"), "json")
    assert spark.read.json(str(tmp_path / "f")).count() == 2
    with pytest.raises(Exception):
        sinks.write_results(long, str(tmp_path / "r"))


def test_altered_evidence_is_found(spark):
    rows = [{"coordinates": {"T.B": 1, "T.A": "é"}, "value": 1.25}, {"coordinates": {}, "value": None}]

    def digest(value, end):
        text = json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":")) + end
        return hashlib.sha256(text.encode()).hexdigest()

    whole = digest({"complete": True, "rows": rows, "status": "AVAILABLE"}, "\n")
    bare = digest(rows, "")
    docs = []
    for left, right in ((whole, bare), (bare, whole)):
        record = json.loads(document(source=rows, target=rows))
        record["source"]["result_sha256"], record["target"]["result_sha256"] = left, right
        docs.append((json.dumps(record, ensure_ascii=False),))
    for doc, bad in zip(docs, ("target", "source")):
        endpoints = evidence.read_evidence(spark.createDataFrame([doc], "j string"), "j")
        assert [r.side for r in evidence.altered_endpoints(endpoints).collect()] == [bad]
        other = {"target": "source", "source": "target"}[bad]
        assert [r.side for r in evidence.altered_endpoints(endpoints, rows_only=True).collect()] == [other]


def test_cell_errors(spark):
    rows = [{"coordinates": {"k": i}, "value": v} for i, v in enumerate([1, 1.5, None, True, "1", [1]])]
    frame = spark.createDataFrame([(document(source=rows),)], "j string")
    cells = evidence.evidence_rows(evidence.read_evidence(frame, "j"))
    assert {r.coordinates for r in evidence.cell_errors(cells).collect()} == {'{"k":3}', '{"k":4}', '{"k":5}'}
