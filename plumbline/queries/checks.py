"""Checks that find unsafe definitions in the data."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline import metrics as m
from plumbline import query
from plumbline.functions.names import parts_hash
from plumbline.metrics import Expr
from plumbline.model import Model, Relationship, Table
from plumbline.operators import lineage, profile
from plumbline.plans.compose import joined_rows
from plumbline.queries.registry import case, rounded
from plumbline.sources.tables import read_table
from plumbline.star import RELATIONSHIPS, derive_results, star

REGION = "region.r_name"
PRIORITY = "orders.o_orderpriority"


@case(
    "relationship_profile",
    """WITH lo AS (SELECT l_orderkey AS k, count(*) AS n FROM lineitem GROUP BY 1),
    od AS (SELECT o_orderkey AS k, count(*) AS n FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1),
    oc AS (SELECT nullif(o_custkey, 0) AS k, count(*) AS n FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1),
    cu AS (SELECT c_custkey AS k, count(*) AS n FROM (SELECT * FROM customer
      UNION ALL SELECT * FROM customer WHERE c_mktsegment = 'BUILDING') GROUP BY 1),
    p AS (SELECT 'lineitem_orders' AS relationship, lo.k AS mk, lo.n AS mn, od.n AS n1
        FROM lo FULL JOIN od ON lo.k = od.k
      UNION ALL SELECT 'orders_customer', oc.k, oc.n, cu.n FROM oc FULL JOIN cu ON oc.k = cu.k)
    SELECT relationship, CAST(sum(mn) AS BIGINT) AS many_rows, CAST(sum(n1) AS BIGINT) AS one_rows,
      count(*) FILTER (WHERE n1 > 1) AS duplicate_one_keys,
      count(*) FILTER (WHERE mk IS NOT NULL AND mn > 0 AND n1 IS NULL) AS orphan_keys,
      CAST(coalesce(sum(mn) FILTER (WHERE mk IS NOT NULL AND n1 IS NULL), 0) AS BIGINT) AS orphan_rows,
      CAST(coalesce(sum(mn) FILTER (WHERE mk IS NULL), 0) AS BIGINT) AS blank_rows,
      count(*) FILTER (WHERE mn > 1) AS repeated_many_keys,
      CASE WHEN count(*) FILTER (WHERE n1 > 1) > 0 THEN 'many_to_many'
        WHEN count(*) FILTER (WHERE mn > 1) > 0 THEN 'many_to_one' ELSE 'one_to_one' END AS cardinality
    FROM p GROUP BY 1""",
)
def relationship_profile(spark, path):
    customer = read_table(spark, path, "customer")
    orders = (
        read_table(spark, path, "orders")
        .where("o_orderstatus <> 'P'")
        .withColumn("o_custkey", F.nullif("o_custkey", F.lit(0)))
    )
    doubled = customer.union(customer.where("c_mktsegment = 'BUILDING'"))
    model = Model(
        [
            Table("lineitem", read_table(spark, path, "lineitem")),
            Table("orders", orders),
            Table("customer", doubled),
        ],
        [
            Relationship("lineitem_orders", "lineitem", "orders", (("l_orderkey", "o_orderkey"),)),
            Relationship("orders_customer", "orders", "customer", (("o_custkey", "c_custkey"),)),
        ],
    )
    return profile.relationship_profile(model)


def _star_profile_sql() -> str:
    keys = {r.name: (r.many, r.one, *r.on[0]) for r in RELATIONSHIPS}
    parts = " UNION ALL ".join(
        f"""SELECT '{name}' AS relationship, m.k AS mk, m.n AS mn, i.n AS n1
        FROM (SELECT {a} AS k, count(*) AS n FROM {many} GROUP BY 1) m
        FULL JOIN (SELECT {b} AS k, count(*) AS n FROM {one} GROUP BY 1) i ON m.k = i.k"""
        for name, (many, one, a, b) in keys.items()
    )
    return f"""WITH p AS ({parts})
    SELECT relationship, CAST(sum(mn) AS BIGINT) AS many_rows, CAST(sum(n1) AS BIGINT) AS one_rows,
      count(*) FILTER (WHERE n1 > 1) AS duplicate_one_keys,
      count(*) FILTER (WHERE mk IS NOT NULL AND mn > 0 AND n1 IS NULL) AS orphan_keys,
      CAST(coalesce(sum(mn) FILTER (WHERE mk IS NOT NULL AND n1 IS NULL), 0) AS BIGINT) AS orphan_rows,
      CAST(coalesce(sum(mn) FILTER (WHERE mk IS NULL), 0) AS BIGINT) AS blank_rows,
      count(*) FILTER (WHERE mn > 1) AS repeated_many_keys,
      CASE WHEN count(*) FILTER (WHERE n1 > 1) > 0 THEN 'many_to_many'
        WHEN count(*) FILTER (WHERE mn > 1) > 0 THEN 'many_to_one' ELSE 'one_to_one' END AS cardinality
    FROM p GROUP BY 1"""


@case("relationship_profile_star", _star_profile_sql())
def relationship_profile_star(spark, path):
    """All relationships of the supplied star, as they are."""
    return profile.relationship_profile(star(spark, path))


@case(
    "identifier_profile",
    """WITH p AS (SELECT 'o_orderkey' AS "column", count(*) AS rows, count(DISTINCT o_orderkey) AS d FROM orders
      UNION ALL SELECT 'o_custkey', count(*), count(DISTINCT o_custkey) FROM orders
      UNION ALL SELECT 'o_totalprice', count(*), count(DISTINCT o_totalprice) FROM orders
      UNION ALL SELECT 'o_orderdate', count(*), count(DISTINCT o_orderdate) FROM orders)
    SELECT "column", rows, d AS distinct_values, round(d::DOUBLE / rows, 6) AS distinct_ratio,
      "column" LIKE '%key' OR d::DOUBLE / rows >= 0.99::DOUBLE AS identifier FROM p""",
)
def identifier_profile(spark, path):
    columns = ["o_orderkey", "o_custkey", "o_totalprice", "o_orderdate"]
    return rounded(profile.identifier_profile(read_table(spark, path, "orders"), columns))


@case(
    "text_numeric_profile",
    """WITH e AS (SELECT value::VARCHAR AS value_text, event_type,
      CASE WHEN event_type = 'view' THEN 'n/a' ELSE event_id::VARCHAR END AS mixed FROM events),
    p AS (SELECT 'value_text' AS "column", count(value_text) AS rows,
        count(*) FILTER (WHERE TRY_CAST(value_text AS DOUBLE) IS NULL) AS not_numeric FROM e
      UNION ALL SELECT 'event_type', count(event_type),
        count(*) FILTER (WHERE TRY_CAST(event_type AS DOUBLE) IS NULL) FROM e
      UNION ALL SELECT 'mixed', count(mixed), count(*) FILTER (WHERE TRY_CAST(mixed AS DOUBLE) IS NULL) FROM e)
    SELECT *, rows > 0 AND not_numeric = 0 AS additive FROM p""",
)
def text_numeric_profile(spark, path):
    events = read_table(spark, path, "events").select(
        F.col("value").cast("string").alias("value_text"),
        "event_type",
        F.when(F.col("event_type") == "view", "n/a")
        .otherwise(F.col("event_id").cast("string"))
        .alias("mixed"),
    )
    return profile.text_numeric_profile(events, ["value_text", "event_type", "mixed"])


@case(
    "unit_ratio_check",
    """WITH $GEO SELECT n_name, CAST(sum(part_b) AS BIGINT) AS b_total, true AS hours_ok, false AS nc_ok
    FROM g GROUP BY 1""",
)
def unit_ratio_check(spark, path):
    wanted = ["b_total", "b_hours", "nc_b_hours_by_60"]
    frame = query(star(spark, path), wanted, by=["nation.n_name"])
    right = profile.unit_check(frame, "b_hours", "b_total", 3600).withColumnRenamed("unit_ok", "hours_ok")
    both = profile.unit_check(right, "nc_b_hours_by_60", "b_total", 3600)
    return both.select("n_name", "b_total", "hours_ok", F.col("unit_ok").alias("nc_ok"))


@case(
    "non_additive_ratio",
    """WITH p AS (SELECT 'l_discount' AS "column", min(l_discount) AS low, max(l_discount) AS high,
        sum(l_discount) AS t FROM lineitem
      UNION ALL SELECT 'l_tax', min(l_tax), max(l_tax), sum(l_tax) FROM lineitem
      UNION ALL SELECT 'l_quantity', min(l_quantity), max(l_quantity), sum(l_quantity) FROM lineitem)
    SELECT "column", low, high, round(t, 4) AS total, low >= 0 AND high <= 1 AND t > 1 AS ratio_summed FROM p""",
)
def non_additive_ratio(spark, path):
    columns = ["l_discount", "l_tax", "l_quantity"]
    return rounded(profile.non_additive_ratio(read_table(spark, path, "lineitem"), columns), 4)


@case(
    "population_subset",
    """WITH $GEO SELECT r_name, count(*) FILTER (WHERE is_review = 1) AS numerator_rows,
    count(*) FILTER (WHERE is_valid) AS denominator_rows,
    count(*) FILTER (WHERE is_review = 1 AND NOT is_valid) AS outside_rows FROM g GROUP BY 1""",
)
def population_subset(spark, path):
    fields = [REGION, "orders.is_review", "orders.is_valid"]
    rows = joined_rows(star(spark, path), "orders", fields)
    return profile.outside_population(
        rows, ["r_name"], F.col("is_review") == 1, F.col("is_valid")
    )


@case(
    "denominator_grain",
    """WITH $SPLITS, a AS (SELECT r_name, count(*) AS n FROM g GROUP BY 1),
    b AS (SELECT r_name, count(*) AS s, count(DISTINCT l_orderkey) AS d FROM s GROUP BY 1)
    SELECT r_name, round(d::DOUBLE / n, 6) AS parent_grain, round(d::DOUBLE / s, 6) AS child_grain,
      false AS same FROM a JOIN b USING (r_name)""",
)
def denominator_grain(spark, path):
    wanted = {
        "parent_grain": m.ratio("results_with_splits", "result_rows"),
        "child_grain": m.ratio("results_with_splits", "split_rows"),
    }
    both = query(star(spark, path), wanted, by=[REGION])
    return rounded(profile.same_value(both, "parent_grain", "child_grain"))


@case(
    "blank_risk",
    """WITH $RESULTS SELECT o_orderpriority,
    count(DISTINCT closed_status) AS distinct_without, count(DISTINCT closed_status) + 1 AS distinct_with,
    CAST(sum(part_a + part_b) AS BIGINT) AS strict_sum,
    CAST(sum(coalesce(part_a, 0) + coalesce(part_b, 0)) AS BIGINT) AS blank_sum,
    false AS distinct_same, coalesce(sum(part_a + part_b)
      = sum(coalesce(part_a, 0) + coalesce(part_b, 0)), false) AS sum_same
    FROM o GROUP BY 1""",
)
def blank_risk(spark, path):
    from plumbline.functions.blanks import blank_add

    pair = ("orders.part_a", "orders.part_b")
    seen = Expr(("orders.closed_status",), lambda c: c.isNotNull())
    wanted = {
        "distinct_without": m.distinct_count("orders.closed_status", where=(seen,)),
        "distinct_with": m.distinct_count("orders.closed_status"),
        "strict_sum": m.total(Expr(pair, lambda a, b: a + b)),
        "blank_sum": m.total(Expr(pair, blank_add)),
    }
    frame = query(star(spark, path), wanted, by=[PRIORITY])
    frame = profile.same_value(frame, "distinct_without", "distinct_with", "distinct_same")
    return profile.same_value(frame, "strict_sum", "blank_sum", "sum_same")


@case(
    "dq_unique_not_null",
    """WITH o2 AS (SELECT o_orderkey, o_custkey, nullif(o_orderstatus, 'P') AS closed_status FROM orders)
    SELECT 'unique' AS test, 'o_orderkey' AS "column", count(*) AS failures FROM (
      SELECT o_orderkey FROM o2 GROUP BY 1 HAVING count(*) > 1)
    UNION ALL SELECT 'unique', 'o_custkey', count(*) FROM (
      SELECT o_custkey FROM o2 GROUP BY 1 HAVING count(*) > 1)
    UNION ALL SELECT 'not_null', 'o_orderkey', count(*) FILTER (WHERE o_orderkey IS NULL) FROM o2
    UNION ALL SELECT 'not_null', 'closed_status', count(*) FILTER (WHERE closed_status IS NULL) FROM o2""",
)
def dq_unique_not_null(spark, path):
    orders = derive_results(read_table(spark, path, "orders"))
    return profile.unique_not_null(
        orders, ["o_orderkey", "o_custkey"], ["o_orderkey", "closed_status"]
    )


@case(
    "exclusion_proof",
    """WITH $RESULTS SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus IN ('O', 'P')) AS excluded_rows,
    count(*) FILTER (WHERE is_closed AND o_orderstatus IN ('O', 'P')) AS violations,
    count(*) FILTER (WHERE is_closed AND o_orderstatus IN ('O', 'P')) = 0 AS proven, 'is_closed' AS flag
    FROM o GROUP BY 1 UNION ALL
    SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus IN ('O', 'P')), 0, true, 'is_valid'
    FROM o GROUP BY 1""",
)
def exclusion_proof(spark, path):
    orders = derive_results(read_table(spark, path, "orders"))
    excluded = F.col("o_orderstatus").isin("O", "P")
    proofs = [
        profile.exclusion_proof(orders, F.col(flag), excluded, ["o_orderpriority"]).withColumn(
            "flag", F.lit(flag)
        )
        for flag in ("is_closed", "is_valid")
    ]
    return proofs[0].unionByName(proofs[1])


def _turns(spark, path):
    """Turns as nodes; each depends on the turn before, the first on the last."""
    turns = read_table(spark, path, "conversations").select(
        F.concat_ws(":", "conv_id", "turn").alias("node"), "conv_id", "turn", "text"
    )
    previous = turns.where("turn > 0").select(
        F.col("node").alias("src"), F.concat_ws(":", "conv_id", F.col("turn") - 1).alias("dst")
    )
    return turns, previous


def _rings(turns):
    """The first turn of a conversation of five and more depends on the last."""
    last = turns.groupBy("conv_id").agg(F.max("turn").alias("last")).where("last > 3")
    return last.select(F.concat_ws(":", "conv_id", F.lit(0)).alias("src"), F.concat_ws(":", "conv_id", "last").alias("dst"))


@case(
    "edge_closure",
    """WITH RECURSIVE e AS (SELECT conv_id || ':' || turn AS src, conv_id || ':' || (turn - 1) AS dst
        FROM conversations WHERE turn > 0
      UNION SELECT conv_id || ':0', conv_id || ':' || max(turn) FROM conversations
        GROUP BY conv_id HAVING max(turn) > 3),
    c AS (SELECT conv_id || ':0' AS start, dst AS node, 1 AS hops FROM conversations
        JOIN e ON src = conv_id || ':0' WHERE turn = 0
      UNION SELECT start, dst, hops + 1 FROM c JOIN e ON c.node = e.src WHERE node <> start)
    SELECT start, node, min(hops) AS hops FROM c GROUP BY 1, 2""",
)
def edge_closure(spark, path):
    turns, previous = _turns(spark, path)
    starts = turns.where("turn = 0").select(F.col("node").alias("start"))
    return lineage.closure(previous.union(_rings(turns)), starts)


@case(
    "risk_propagation",
    """WITH t AS (SELECT conv_id, turn, length(text) > 900 AS bad FROM conversations),
    w AS (SELECT *, bool_or(bad) OVER (PARTITION BY conv_id ORDER BY turn
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS above FROM t)
    SELECT conv_id || ':' || turn AS node,
      CASE WHEN bad THEN 'CONFIRMED_INCORRECT' WHEN above THEN 'MANUAL_REVIEW_REQUIRED'
        ELSE 'STRUCTURALLY_EQUIVALENT' END AS status,
      CASE WHEN NOT bad AND above THEN 'TRANSITIVE_DEPENDENCY_RISK' END AS reason FROM w""",
)
def risk_propagation(spark, path):
    turns, previous = _turns(spark, path)
    sound, risky = "STRUCTURALLY_EQUIVALENT", "MANUAL_REVIEW_REQUIRED"
    status = F.when(F.length("text") > 900, "CONFIRMED_INCORRECT").otherwise(sound)
    nodes = turns.select("node", status.alias("status"))
    return lineage.propagate_risk(nodes, previous, sound, risky)


@case(
    "edge_dependents",
    """SELECT conv_id || ':0' AS start, conv_id || ':' || turn AS node, CAST(turn AS INTEGER) AS hops
    FROM conversations WHERE turn > 0""",
)
def edge_dependents(spark, path):
    turns, previous = _turns(spark, path)
    return lineage.dependents(previous, turns.where("turn = 0").select(F.col("node").alias("start")))


@case(
    "cycle_report",
    """WITH r AS (SELECT conv_id FROM conversations GROUP BY 1 HAVING max(turn) > 3)
    SELECT conv_id || ':' || turn AS node, min(conv_id || ':' || turn) OVER w AS component, count(*) OVER w AS size
    FROM conversations JOIN r USING (conv_id) WINDOW w AS (PARTITION BY conv_id)""",
)
def cycle_report(spark, path):
    turns, previous = _turns(spark, path)
    return lineage.cycles(previous.union(_rings(turns)))


_RISK_STATES = """WITH t AS (SELECT *, length(text) > 1100 AS bad, conv_id % 5 = 0 AS kept,
      CASE WHEN length(text) % 7 = 0 THEN 'NAME_MATCH' ELSE 'EXACT_MAPPING' END AS resolution,
      CASE WHEN length(text) % 11 = 0 THEN 'UNSUPPORTED' ELSE 'AUTO_CONVERT' END AS automation0 FROM conversations),
    w AS (SELECT *, coalesce(bool_or(bad) OVER v, false) AS above FROM t
      WINDOW v AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    x AS (SELECT *, CASE WHEN bad THEN 'CONFIRMED_INCORRECT' WHEN above THEN 'MANUAL_REVIEW_REQUIRED'
        ELSE 'STRUCTURALLY_EQUIVALENT' END AS status,
      CASE WHEN above AND NOT bad AND NOT kept THEN 'MANUAL_REVIEW_REQUIRED' ELSE automation0 END AS automation1,
      NOT above AND coalesce(bool_or(NOT bad AND NOT above AND (resolution <> 'EXACT_MAPPING' OR automation0 <> 'AUTO_CONVERT'))
        OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS hit FROM w),
    s AS (SELECT *, hit AND automation1 = 'AUTO_CONVERT' AS pushed,
      CASE WHEN hit AND automation1 = 'AUTO_CONVERT' THEN 'MANUAL_REVIEW_REQUIRED' ELSE automation1 END AS automation FROM x)"""


def _risk_states(spark, path):
    turns, previous = _turns(spark, path)
    length = F.length("text")
    nodes = turns.select(
        "node",
        F.when(length > 1100, "CONFIRMED_INCORRECT").otherwise("STRUCTURALLY_EQUIVALENT").alias("status"),
        F.when(length % 7 == 0, "NAME_MATCH").otherwise("EXACT_MAPPING").alias("resolution"),
        F.when(length % 11 == 0, "UNSUPPORTED").otherwise("AUTO_CONVERT").alias("automation"),
        (F.col("conv_id") % 5 == 0).alias("kept"),
    )
    found = lineage.propagate_risks(
        nodes, previous, "STRUCTURALLY_EQUIVALENT", "MANUAL_REVIEW_REQUIRED", "EXACT_MAPPING", "AUTO_CONVERT"
    )
    return found, previous


@case(
    "risk_chains",
    _RISK_STATES + """ SELECT conv_id || ':' || turn AS node, status, resolution, automation,
      concat_ws(',', CASE WHEN above AND NOT bad THEN 'TRANSITIVE_DEPENDENCY_RISK' END,
        CASE WHEN pushed THEN 'TRANSITIVE_DEPENDENCY_AUTOMATION_RISK' END) AS reasons FROM s""",
)
def risk_chains(spark, path):
    found, _ = _risk_states(spark, path)
    return found.withColumn("reasons", F.concat_ws(",", "reasons"))


@case(
    "risk_dependencies",
    _RISK_STATES + """ SELECT conv_id || ':' || b.turn AS node, conv_id || ':' || a.turn AS dependency,
      CASE WHEN a.status <> 'STRUCTURALLY_EQUIVALENT' THEN a.status ELSE a.resolution || ':' || a.automation END AS risk
    FROM s a JOIN s b USING (conv_id) WHERE b.turn = a.turn + 1 AND (a.status <> 'STRUCTURALLY_EQUIVALENT'
      OR a.resolution <> 'EXACT_MAPPING' OR a.automation <> 'AUTO_CONVERT')""",
)
def risk_dependencies(spark, path):
    found, previous = _risk_states(spark, path)
    return lineage.dependency_risks(found, previous, "STRUCTURALLY_EQUIVALENT", "EXACT_MAPPING", "AUTO_CONVERT")


@case(
    "findings_summary",
    """SELECT 'BLOCKER' AS severity, 'RESULT_WITHOUT_SPLITS' AS code, count(*) AS findings, 1::BIGINT AS severity_rank
    FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)
    UNION ALL SELECT 'ERROR', 'DUPLICATE_COORDINATE', count(*), 2 FROM (
      SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1)
    UNION ALL SELECT 'WARNING', 'NEGATIVE_BALANCE', count(*), 3 FROM customer WHERE c_acctbal < 0
    UNION ALL SELECT 'INFO', 'OPEN_RESULT', count(*), 4 FROM orders WHERE o_orderstatus = 'O'""",
)
def findings_summary(spark, path):
    def finding(rows, severity, code, *key):
        return rows.select(
            parts_hash(F.lit(code), *map(F.col, key)).alias("finding_hash"),
            F.lit(severity).alias("severity"),
            F.lit(code).alias("code"),
        )

    orders, lines = read_table(spark, path, "orders"), read_table(spark, path, "lineitem")
    customer = read_table(spark, path, "customer")
    without = orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left_anti")
    repeated = lines.groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n")).where("n > 1")
    found = [
        finding(without, "BLOCKER", "RESULT_WITHOUT_SPLITS", "o_orderkey"),
        finding(repeated, "ERROR", "DUPLICATE_COORDINATE", "l_orderkey", "l_linenumber"),
        finding(customer.where("c_acctbal < 0"), "WARNING", "NEGATIVE_BALANCE", "c_custkey"),
        # A second check that reports some of the same findings: one of each remains.
        finding(customer.where("c_acctbal < -500"), "WARNING", "NEGATIVE_BALANCE", "c_custkey"),
        finding(orders.where("o_orderstatus = 'O'"), "INFO", "OPEN_RESULT", "o_orderkey"),
    ]
    every = found[0]
    for one in found[1:]:
        every = every.unionByName(one)
    return profile.findings_summary(every, "finding_hash")
