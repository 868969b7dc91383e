"""Reconciliation, differences and drift."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline import metric_slices, query
from plumbline.operators import diff, reconcile, treediff
from plumbline.queries.registry import case
from plumbline.queries.rows import SLICES
from plumbline.sources.tables import read_table
from plumbline.star import derive_results, star

# The second system of these queries: b_total per customer by its own route,
# one off where the balance is negative, absent above 9000.
_OTHER = """l AS (SELECT o_custkey, sum(part_b)::DOUBLE AS b FROM o GROUP BY 1),
    r AS (SELECT c_custkey AS o_custkey, CASE WHEN c_acctbal < 0 THEN b + 1 ELSE b * (1 + 1e-12::DOUBLE) END AS b
      FROM l JOIN customer ON c_custkey = o_custkey WHERE c_acctbal <= 9000)"""


def _other_route(spark, path):
    orders = derive_results(read_table(spark, path, "orders"))
    balances = read_table(spark, path, "customer").where("c_acctbal <= 9000")
    sums = orders.groupBy("o_custkey").agg(F.sum("part_b").cast("double").alias("b"))
    value = F.when(F.col("c_acctbal") < 0, F.col("b") + 1).otherwise(F.col("b") * (1 + 1e-12))
    return sums.join(balances, F.col("c_custkey") == F.col("o_custkey")).select(
        "o_custkey", value.alias("value")
    )


def _engine_route(spark, path):
    frame = query(star(spark, path), ["b_total"], by=["orders.o_custkey"])
    return frame.withColumnRenamed("b_total", "value")


@case(
    "reconcile_full_outer",
    "WITH $RESULTS, " + _OTHER + """
    SELECT o_custkey, l.b AS left_value, r.b AS right_value,
      CASE WHEN r.o_custkey IS NULL THEN 'ONLY_LEFT' WHEN l.o_custkey IS NULL THEN 'ONLY_RIGHT'
        WHEN l.b IS NULL AND r.b IS NULL THEN 'MATCH' WHEN l.b IS NULL OR r.b IS NULL THEN 'DIFFERENT'
        WHEN abs(l.b - r.b) <= greatest(1e-9, 1e-9 * greatest(abs(l.b), abs(r.b))) THEN 'MATCH'
        ELSE 'DIFFERENT' END AS verdict
    FROM l FULL JOIN r USING (o_custkey)""",
)
def reconcile_full_outer(spark, path):
    return reconcile.compare_cells(
        _engine_route(spark, path), _other_route(spark, path), ["o_custkey"]
    )


@case(
    "reconcile_tolerance",
    """WITH t AS (SELECT event_id, event_type, value, CAST(floor(value) AS BIGINT) AS whole FROM events)
    SELECT event_id, CASE event_type WHEN 'click' THEN true WHEN 'view' THEN true WHEN 'error' THEN false
      WHEN 'signup' THEN false ELSE value < 0 END AS matches FROM t""",
)
def reconcile_tolerance(spark, path):
    # Same text; half a tolerance apart; large integers one apart; blank
    # against a value; far apart.
    kind, value = F.col("event_type"), F.col("value")
    big = (F.floor(value) + F.lit(10**15)).cast("string")
    left = F.when(kind == "error", big).otherwise(value.cast("string"))
    right = (
        F.when(kind == "click", value.cast("string"))
        .when(kind == "view", (value + 5e-10).cast("string"))
        .when(kind == "error", (F.floor(value) + F.lit(10**15 + 1)).cast("string"))
        .when(kind == "purchase", (value + 0.01).cast("string"))
    )
    matches = reconcile.texts_match(F.lit("DECIMAL"), left, right)
    return read_table(spark, path, "events").select("event_id", matches.alias("matches"))


@case(
    "duplicate_coordinates",
    """SELECT l_orderkey, l_linenumber, count(*) AS copies FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1""",
)
def duplicate_coordinates(spark, path):
    lines = read_table(spark, path, "lineitem")
    return reconcile.duplicate_coordinates(lines, ["l_orderkey", "l_linenumber"])


@case(
    "grouping_set_completeness",
    """WITH m AS (SELECT unnest(['result_rows', 'b_total']) AS metric)
    SELECT metric, 'COUNTRY' AS slice, 1 AS grouping FROM m WHERE (SELECT count(*) FROM orders) > 0
    UNION ALL SELECT 'b_total', 'STATUS', 0 WHERE (SELECT count(*) FROM orders) > 0""",
)
def grouping_set_completeness(spark, path):
    names = ["result_rows", "b_total"]
    long = metric_slices(star(spark, path), names, SLICES)
    # Evidence that lacks a subtotal level, and one slice for one metric.
    partial = long.where(
        ~((F.col("slice") == "COUNTRY") & (F.col("grouping") == 1))
        & ~((F.col("slice") == "STATUS") & (F.col("metric") == "b_total"))
    )
    declared = [(n, s, i) for n in names for s, sets in SLICES.items() for i in range(len(sets))]
    expected = spark.createDataFrame(declared, "metric string, slice string, grouping int")
    return reconcile.missing_groupings(partial, expected, ["metric", "slice", "grouping"])


@case(
    "slice_coverage",
    """WITH $GEO, n AS (SELECT (SELECT count(DISTINCT o_orderstatus) FROM g) AS st,
      (SELECT count(DISTINCT n_name) FROM g) AS na, (SELECT count(DISTINCT r_name) FROM g) AS re,
      (SELECT count(DISTINCT n_name) FROM g WHERE r_name = 'ASIA') AS asia),
    p AS (SELECT 'result_rows' AS metric, 'OVERALL' AS slice, 1 AS cells, 0 AS mismatches FROM n
      UNION ALL SELECT 'result_rows', 'STATUS', st, 0 FROM n
      UNION ALL SELECT 'result_rows', 'COUNTRY', na + re + 1, 0 FROM n
      UNION ALL SELECT 'b_total', 'OVERALL', 1, 0 FROM n UNION ALL SELECT 'b_total', 'STATUS', st, 0 FROM n
      UNION ALL SELECT 'b_total', 'COUNTRY', na + re + 1, asia + 1 FROM n
      UNION ALL SELECT 'valid_rate', 'OVERALL', 1, 0 FROM n
      UNION ALL SELECT 'valid_rate', 'COUNTRY', na + re + 1, 0 FROM n),
    s AS (SELECT metric, slice, CASE WHEN mismatches > 0 THEN 'FAILED' ELSE 'PASSED' END AS status,
        cells, mismatches FROM p
      UNION ALL SELECT 'valid_rate', 'STATUS', 'NOT_AVAILABLE', NULL, NULL)
    SELECT metric, slice, status, cells, mismatches, CASE metric WHEN 'result_rows' THEN 'PASSED'
      WHEN 'b_total' THEN 'FAILED' ELSE 'NOT_AVAILABLE' END AS metric_status FROM s""",
)
def slice_coverage(spark, path):
    names = ["result_rows", "b_total", "valid_rate"]
    long = metric_slices(star(spark, path), names, SLICES)
    asia = F.col("coordinates").contains("ASIA") & (F.col("metric") == "b_total")
    skipped = (F.col("metric") == "valid_rate") & (F.col("slice") == "STATUS")
    off = asia.cast("int")
    other = long.withColumns({"value": F.col("value") + off, "whole": F.col("whole") + off}).where(~skipped)
    keys = ["metric", "slice", "grouping", "coordinates"]
    compared = reconcile.summarise_cells(
        reconcile.compare_cells(long.where(~skipped), other, keys), ["metric", "slice"]
    )
    required = reconcile.expected_pairs(spark, {n: tuple(SLICES) for n in names})
    covered = reconcile.slice_coverage(required, compared)
    status = reconcile.roll_up_status(covered).select(
        "metric", F.col("status").alias("metric_status")
    )
    counts = compared.select("metric", "slice", "cells", "mismatches")
    return covered.join(counts, ["metric", "slice"], "left").join(status, "metric")


@case(
    "result_fingerprint",
    """SELECT o_orderstatus, count(*) AS rows, bool_or(o_orderstatus = 'F' AND o_totalprice > 1000) AS stale
    FROM orders GROUP BY 1""",
)
def result_fingerprint(spark, path):
    orders = read_table(spark, path, "orders")
    columns = ["o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority"]
    altered = orders.withColumn(
        "o_totalprice",
        F.when(
            (F.col("o_orderstatus") == "F") & (F.col("o_totalprice") > 1000), F.col("o_totalprice") + 1
        ).otherwise(F.col("o_totalprice")),
    )
    now = reconcile.fingerprint(altered, ["o_orderstatus"], columns)
    recorded = reconcile.fingerprint(orders, ["o_orderstatus"], columns)
    outdated = reconcile.stale(now, recorded, ["o_orderstatus"]).withColumn("stale", F.lit(True))
    return now.join(outdated, "o_orderstatus", "left").select(
        "o_orderstatus", "rows", F.coalesce("stale", F.lit(False)).alias("stale")
    )


@case(
    "reconcile_three_way",
    "WITH $RESULTS, " + _OTHER + """,
    t AS (SELECT o_custkey, CASE WHEN c_mktsegment = 'MACHINERY' THEN b - 2 ELSE b END AS b
      FROM l JOIN customer ON c_custkey = o_custkey WHERE c_mktsegment <> 'BUILDING')
    SELECT o_custkey, l.b AS source, r.b AS repository, t.b AS third,
      CASE WHEN r.o_custkey IS NULL THEN 'NOT_AVAILABLE'
        WHEN (l.b IS NULL AND r.b IS NULL OR
          abs(l.b - r.b) <= greatest(1e-9, 1e-9 * greatest(abs(l.b), abs(r.b))))
          AND (t.o_custkey IS NULL OR t.b IS NULL AND r.b IS NULL OR
          abs(t.b - r.b) <= greatest(1e-9, 1e-9 * greatest(abs(t.b), abs(r.b)))) THEN 'PASSED'
        ELSE 'FAILED' END AS status
    FROM l LEFT JOIN r USING (o_custkey) LEFT JOIN t USING (o_custkey)""",
)
def reconcile_three_way(spark, path):
    source = _engine_route(spark, path)
    segments = read_table(spark, path, "customer").where("c_mktsegment <> 'BUILDING'")
    value = F.col("value").cast("double")
    third = source.join(segments, F.col("c_custkey") == F.col("o_custkey")).select(
        "o_custkey",
        F.when(F.col("c_mktsegment") == "MACHINERY", value - 2).otherwise(value).alias("value"),
    )
    return reconcile.three_way(source, _other_route(spark, path), third, ["o_custkey"])


_AFTER = """a AS (SELECT o_orderkey, o_custkey,
        CASE WHEN o_orderpriority = '1-URGENT' THEN NULL ELSE o_orderstatus END AS o_orderstatus,
        CASE WHEN o_orderpriority = '3-MEDIUM' AND o_orderstatus = 'O' THEN o_totalprice + 1
          ELSE o_totalprice END AS o_totalprice
      FROM orders WHERE NOT (o_orderstatus = 'P' AND o_orderpriority = '5-LOW')
      UNION ALL SELECT -o_orderkey - 1, o_custkey, o_orderstatus, o_totalprice FROM orders
        WHERE o_orderpriority = '2-HIGH' AND o_orderstatus = 'F')"""


def _before_and_after(spark, path):
    columns = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"]
    orders = read_table(spark, path, "orders")
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    after = orders.where(~((status == "P") & (priority == "5-LOW"))).select(
        "o_orderkey",
        "o_custkey",
        F.when(priority != "1-URGENT", status).alias("o_orderstatus"),
        F.when((priority == "3-MEDIUM") & (status == "O"), F.col("o_totalprice") + 1)
        .otherwise(F.col("o_totalprice"))
        .alias("o_totalprice"),
    )
    added = orders.where((priority == "2-HIGH") & (status == "F")).select(
        (-F.col("o_orderkey") - 1).alias("o_orderkey"), *columns[1:]
    )
    return orders.select(*columns), after.unionByName(added)


@case(
    "keyed_diff",
    "WITH " + _AFTER + """
    SELECT o_orderkey, CASE WHEN b.o_custkey IS NULL THEN 'added' WHEN a.o_custkey IS NULL THEN 'removed'
        ELSE 'changed' END AS kind,
      CASE WHEN b.o_custkey IS NULL OR a.o_custkey IS NULL THEN ''
        ELSE concat_ws(',', CASE WHEN a.o_orderstatus IS DISTINCT FROM b.o_orderstatus
          THEN 'o_orderstatus:' || coalesce(b.o_orderstatus, '-') || '>' || coalesce(a.o_orderstatus, '-') END,
          CASE WHEN a.o_totalprice IS DISTINCT FROM b.o_totalprice THEN 'o_totalprice' END) END AS changes
    FROM orders b FULL JOIN a USING (o_orderkey)
    WHERE a.o_custkey IS NULL OR b.o_custkey IS NULL OR a.o_orderstatus IS DISTINCT FROM b.o_orderstatus
      OR a.o_totalprice IS DISTINCT FROM b.o_totalprice""",
)
def keyed_diff(spark, path):
    changes = diff.keyed_diff(*_before_and_after(spark, path), ["o_orderkey"])
    text = F.transform(
        "changes",
        lambda c: F.when(
            c["field"] == "o_orderstatus",
            F.concat(
                c["field"],
                F.lit(":"),
                F.coalesce(c["before"], F.lit("-")),
                F.lit(">"),
                F.coalesce(c["after"], F.lit("-")),
            ),
        ).otherwise(c["field"]),
    )
    return changes.select("o_orderkey", "kind", F.concat_ws(",", text).alias("changes"))


@case(
    "keyed_diff_summary",
    "WITH " + _AFTER + """
    SELECT count(*) FILTER (WHERE b.o_custkey IS NULL) AS additions,
      count(*) FILTER (WHERE a.o_custkey IS NULL) AS removals,
      count(*) FILTER (WHERE a.o_custkey IS NOT NULL AND b.o_custkey IS NOT NULL
        AND (a.o_orderstatus IS DISTINCT FROM b.o_orderstatus
        OR a.o_totalprice IS DISTINCT FROM b.o_totalprice)) AS changes
    FROM orders b FULL JOIN a USING (o_orderkey)""",
)
def keyed_diff_summary(spark, path):
    return diff.diff_summary(diff.keyed_diff(*_before_and_after(spark, path), ["o_orderkey"]))


_REPRICED = """a AS (SELECT o_orderkey, o_custkey, o_orderstatus,
        CASE WHEN o_orderkey % 1009 = 3 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice
      FROM orders WHERE o_orderkey % 2003 <> 5
      UNION ALL SELECT -o_orderkey - 1, o_custkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 1511 = 7)"""


@case(
    "tree_diff",
    "WITH " + _REPRICED + """
    SELECT o_orderkey, CASE WHEN b.o_custkey IS NULL THEN 'added' WHEN a.o_custkey IS NULL THEN 'removed'
        ELSE 'changed' END AS kind,
      CASE WHEN b.o_custkey IS NULL OR a.o_custkey IS NULL THEN '' ELSE 'o_totalprice' END AS changes
    FROM orders b FULL JOIN a USING (o_orderkey)
    WHERE a.o_custkey IS NULL OR b.o_custkey IS NULL OR a.o_totalprice IS DISTINCT FROM b.o_totalprice""",
)
def tree_diff(spark, path):
    columns = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"]
    orders = read_table(spark, path, "orders").select(*columns)
    key, price = F.col("o_orderkey"), F.col("o_totalprice")
    repriced = orders.where(key % 2003 != 5).withColumn("o_totalprice", F.when(key % 1009 == 3, price + 1).otherwise(price))
    added = orders.where(key % 1511 == 7).withColumn("o_orderkey", -key - 1)
    changes = treediff.tree_diff(orders, repriced.unionByName(added), ["o_orderkey"])
    fields = F.transform("changes", lambda c: c["field"])
    return changes.select("o_orderkey", "kind", F.concat_ws(",", fields).alias("changes"))


def _snapshots(spark, path):
    base = read_table(spark, path, "customer")
    segment, balance = F.col("c_mktsegment"), F.col("c_acctbal")
    expected = base.withColumn(
        "c_mktsegment", F.when(segment == "MACHINERY", "MACHINES").otherwise(segment)
    )
    observed = expected.where("c_acctbal <= 9900").withColumn(
        "c_name",
        F.when((segment == "FURNITURE") & (balance < 0), F.upper("c_name")).otherwise(F.col("c_name")),
    )
    return base, expected, observed


_DRIFT = """d AS (SELECT c_custkey, c_mktsegment = 'MACHINERY' AS expected_change,
      c_mktsegment = 'MACHINERY' OR c_acctbal > 9900 OR (c_mktsegment = 'FURNITURE' AND c_acctbal < 0)
        AS actual_change,
      c_acctbal > 9900 OR (c_mktsegment = 'FURNITURE' AND c_acctbal < 0) AS misaligned,
      (c_acctbal > 9900 OR (c_mktsegment = 'FURNITURE' AND c_acctbal < 0)) AND c_mktsegment <> 'MACHINERY'
        AS unrelated FROM customer)"""


@case(
    "snapshot_drift",
    "WITH " + _DRIFT + " SELECT * FROM d WHERE expected_change OR actual_change OR misaligned",
)
def snapshot_drift(spark, path):
    return diff.snapshot_drift(*_snapshots(spark, path), ["c_custkey"])


@case(
    "snapshot_drift_status",
    "WITH " + _DRIFT + """ SELECT count(*) FILTER (WHERE expected_change) AS expected_changes,
    count(*) FILTER (WHERE actual_change) AS actual_changes,
    count(*) FILTER (WHERE misaligned OR unrelated) AS unexpected_changes,
    count(*) FILTER (WHERE unrelated) AS unrelated_changes,
    CASE WHEN count(*) FILTER (WHERE misaligned OR unrelated) = 0 THEN 'ALIGNED'
      ELSE 'MANUAL_REVIEW_REQUIRED' END AS status FROM d""",
)
def snapshot_drift_status(spark, path):
    return diff.drift_status(diff.snapshot_drift(*_snapshots(spark, path), ["c_custkey"]))


@case(
    "object_status",
    """SELECT p_partkey, CASE WHEN p_size = 1 THEN 'MISSING_IN_TARGET' WHEN p_type = 'PROMO' THEN 'DEFINITION_DRIFT'
      WHEN p_size > 40 THEN 'METADATA_DRIFT' ELSE 'MATCH' END AS status FROM part
    UNION ALL SELECT -p_partkey - 1, 'MISSING_IN_SOURCE' FROM part WHERE p_size = 2""",
)
def object_status(spark, path):
    source = read_table(spark, path, "part")
    target = source.where("p_size <> 1").select(
        "p_partkey",
        F.when(F.col("p_size") > 40, F.upper("p_name")).otherwise(F.col("p_name")).alias("p_name"),
        "p_brand",
        F.when(F.col("p_type") == "PROMO", "PROMOTED").otherwise(F.col("p_type")).alias("p_type"),
        "p_retailprice",
    )
    extra = source.where("p_size = 2").select(
        (-F.col("p_partkey") - 1).alias("p_partkey"), "p_name", "p_brand", "p_type", "p_retailprice"
    )
    return diff.object_status(
        source, target.unionByName(extra), ["p_partkey"], ["p_type", "p_retailprice"], ["p_name", "p_brand"]
    )
