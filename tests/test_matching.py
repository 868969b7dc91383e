"""Matching is strict: collisions stop it, near misses do not match."""

from plumbline.operators import matching


def test_cascade(spark):
    sources = spark.createDataFrame(
        [(1, "Bike Time"), (2, "bike-time"), (3, "Run Time"), (4, "Exact"), (5, "Twice"), (6, "Declared"),
         (7, "Both"), (8, "Nothing"), (9, "Form Twice")],
        "source_id int, name string",
    )
    targets = spark.createDataFrame(
        [(10, "BIKE_TIME", None), (30, "RUN_TIME", None), (40, "exact", None), (50, "TWICE", None),
         (51, "twice", None), (60, "anything", "DECLARED"), (61, "Declared", None), (70, "t1", "both"),
         (71, "t2", "Both"), (80, "Nothin", None), (90, "form_twice", None), (91, "Form-Twice", None)],
        "target_id int, name string, declared string",
    )
    got = {r.source_id: (r.target_id, r.method, r.reason) for r in matching.match_cascade(sources, targets).collect()}
    assert got == {
        1: (None, "AMBIGUOUS", "SOURCE_NORMALIZATION_COLLISION"),
        2: (None, "AMBIGUOUS", "SOURCE_NORMALIZATION_COLLISION"),
        3: (30, "UNIQUE_IDENTIFIER_NORMALIZATION", None),
        4: (40, "EXACT_NAME", None),
        5: (None, "AMBIGUOUS", "DUPLICATE_EXACT_TARGET"),
        6: (60, "EXPLICIT_MAPPING", None),
        7: (None, "AMBIGUOUS", "DUPLICATE_EXPLICIT_TARGET"),
        8: (None, "NO_MATCH", None),
        9: (None, "AMBIGUOUS", "TARGET_NORMALIZATION_COLLISION"),
    }


def test_signature_lookup(spark):
    items = spark.createDataFrame([(1, "s1"), (2, "s2"), (3, "s3")], "item int, signature string")
    rules = spark.createDataFrame([("s1", "r1"), ("s2", "r2"), ("s2", "r3")], "signature string, rule_id string")
    got = {r.item: (r.rule_id, r.outcome) for r in matching.signature_lookup(items, rules).collect()}
    assert got == {
        1: ("r1", "REVIEW_RULE_SUGGESTED"),
        2: (None, "AMBIGUOUS_REVIEW_RULE"),
        3: (None, "NO_EXACT_REVIEW_RULE"),
    }
