"""The negative controls of the corpus are found in the data."""

from pyspark.sql import functions as F

from plumbline import Model, Relationship, Table, query
from plumbline.operators import profile
from plumbline.star import star


def test_wrong_unit_is_flagged(spark, sf):
    results = query(star(spark, sf), ["b_total", "b_hours", "nc_b_hours_by_60"], by=["region.r_name"])
    assert all(r.unit_ok for r in profile.unit_check(results, "b_hours", "b_total", 3600).collect())
    assert not any(r.unit_ok for r in profile.unit_check(results, "nc_b_hours_by_60", "b_total", 3600).collect())


def test_summed_identifier_is_flagged(spark, sf):
    orders = star(spark, sf).table("orders").frame
    got = {r.column: r.identifier for r in profile.identifier_profile(orders, ["o_custkey", "part_a"]).collect()}
    assert got["o_custkey"]


def test_summed_ratio_is_flagged(spark, sf):
    lines = star(spark, sf).table("lineitem").frame
    got = {r.column: r.ratio_summed for r in profile.non_additive_ratio(lines, ["l_discount", "l_quantity"]).collect()}
    assert got == {"l_discount": True, "l_quantity": False}


def test_wrong_population_is_flagged(spark, sf):
    orders = star(spark, sf).table("orders").frame
    review, valid = F.col("is_review") == 1, F.col("is_valid")
    assert profile.outside_population(orders, [], review, valid).first().outside_rows > 0
    assert profile.outside_population(orders, [], review & valid, valid).first().outside_rows == 0


def test_fan_out_is_flagged(spark, sf):
    both = query(star(spark, sf), ["b_total", "nc_fanned_b"])
    assert not profile.same_value(both, "b_total", "nc_fanned_b").first().same


def test_relationship_profile(spark):
    fact = spark.createDataFrame([(1,), (1,), (2,), (9,), (None,)], "k int")
    dim = spark.createDataFrame([(1,), (2,), (2,), (3,), (None,)], "k int")
    model = Model([Table("f", fact), Table("d", dim)], [Relationship("r", "f", "d", (("k", "k"),))])
    row = profile.relationship_profile(model).first()
    assert (row.many_rows, row.one_rows) == (5, 5)
    assert (row.duplicate_one_keys, row.orphan_keys, row.orphan_rows, row.blank_rows) == (1, 1, 1, 1)
    assert row.cardinality == "many_to_many"


def test_text_profile(spark):
    frame = spark.createDataFrame([("1", "ten"), ("2.5", "20"), (None, None)], "a string, b string")
    got = {r.column: (r.rows, r.not_numeric, r.additive) for r in profile.text_numeric_profile(frame, ["a", "b"]).collect()}
    assert got == {"a": (2, 0, True), "b": (2, 1, False)}


def test_unique_not_null(spark):
    frame = spark.createDataFrame([(1, None), (1, "x"), (None, "y"), (None, "z")], "a int, b string")
    got = {(r.test, r.column): r.failures for r in profile.unique_not_null(frame, ["a", "b"], ["a", "b"]).collect()}
    assert got == {("unique", "a"): 1, ("unique", "b"): 0, ("not_null", "a"): 2, ("not_null", "b"): 1}


def test_findings_are_counted_once_worst_first(spark):
    frame = spark.createDataFrame(
        [("1", "INFO", "C"), ("2", "BLOCKER", "B"), ("2", "BLOCKER", "B"), ("3", "BLOCKER", "A")],
        "finding_id string, severity string, code string",
    )
    got = [(r.severity, r.code, r.findings) for r in profile.findings_summary(frame).collect()]
    assert got == [("BLOCKER", "A", 1), ("BLOCKER", "B", 1), ("INFO", "C", 1)]
