"""Relationships between tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline import metrics as m
from plumbline import query
from plumbline.functions.names import signature
from plumbline.metrics import Calculate, Predicate
from plumbline.operators import diff, matching, windows
from plumbline.queries.registry import case, rounded
from plumbline.sources.tables import read_table
from plumbline.star import star


@case(
    "slice_by_dimension",
    """WITH $GEO SELECT c_mktsegment, count(*) AS result_rows,
    count(*) FILTER (WHERE is_valid) AS valid_rows,
    round(count(*) FILTER (WHERE is_valid)::DOUBLE / count(*), 6) AS valid_rate,
    round(avg(part_b), 6) AS b_average FROM g GROUP BY 1""",
)
def slice_by_dimension(spark, path):
    wanted = ["result_rows", "valid_rows", "valid_rate", "b_average"]
    return rounded(query(star(spark, path), wanted, by=["customer.c_mktsegment"]))


@case(
    "slice_snowflake_chain",
    """WITH $GEO SELECT r_name, n_name, count(*) AS result_rows, count(DISTINCT o_custkey) AS events
    FROM g GROUP BY 1, 2""",
)
def slice_snowflake_chain(spark, path):
    return query(star(spark, path), ["result_rows", "events"], by=["region.r_name", "nation.n_name"])


@case(
    "split_by_parent_dim",
    """WITH $SPLITS SELECT n_name, c_mktsegment, count(*) AS split_rows, sum(l_quantity) AS split_quantity,
    count(DISTINCT l_orderkey) AS results_with_splits FROM s GROUP BY 1, 2""",
)
def split_by_parent_dim(spark, path):
    wanted = ["split_rows", "split_quantity", "results_with_splits"]
    return query(star(spark, path), wanted, by=["nation.n_name", "customer.c_mktsegment"])


@case(
    "unreachable_dim_repeat",
    """WITH $RESULTS SELECT l_returnflag, (SELECT count(*) FROM orders) AS result_rows,
    (SELECT round(count(*) FILTER (WHERE is_valid)::DOUBLE / count(*), 6) FROM o) AS valid_rate
    FROM lineitem GROUP BY 1""",
)
def unreachable_dim_repeat(spark, path):
    frame = query(star(spark, path), ["result_rows", "valid_rate"], by=["lineitem.l_returnflag"])
    return rounded(frame)


@case(
    "bidirectional_semi",
    """SELECT r_name, count(*) AS customers, count(*) FILTER (WHERE c_custkey IN (
      SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT')) AS urgent
    FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey
    LEFT JOIN region ON n_regionkey = r_regionkey GROUP BY 1""",
)
def bidirectional_semi(spark, path):
    urgent = Calculate(
        m.count("customer"),
        (Predicate("orders.o_orderstatus", "F"), Predicate("orders.o_orderpriority", "1-URGENT")),
    )
    wanted = {"customers": m.count("customer"), "urgent": urgent}
    return query(star(spark, path), wanted, by=["region.r_name"])


@case(
    "bidirectional_group",
    """SELECT o_orderstatus, c_mktsegment, count(DISTINCT c_custkey) AS customers
    FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2""",
)
def bidirectional_group(spark, path):
    # Customers seen in each status: the orders filter them through a two-way link.
    by = ["orders.o_orderstatus", "customer.c_mktsegment"]
    return query(star(spark, path), {"customers": m.count("customer")}, by=by)


@case(
    "alternate_relationship",
    """WITH $SPLITS, a AS (SELECT n_name, count(*) AS by_customer FROM s GROUP BY 1),
    b AS (SELECT n_name, count(*) AS by_supplier FROM lineitem LEFT JOIN supplier ON l_suppkey = s_suppkey
      LEFT JOIN nation ON s_nationkey = n_nationkey GROUP BY 1)
    SELECT n_name, coalesce(by_customer, 0) AS by_customer, coalesce(by_supplier, 0) AS by_supplier
    FROM a FULL JOIN b USING (n_name)""",
)
def alternate_relationship(spark, path):
    wanted = {
        "by_customer": "split_rows",
        "by_supplier": Calculate("split_rows", use=("supplier_nation",)),
    }
    return query(star(spark, path), wanted, by=["nation.n_name"])


@case(
    "treatas_semi_delta",
    """WITH $SPLITS, a AS (SELECT n_name, sum(l_quantity) AS q FROM s GROUP BY 1),
    b AS (SELECT n_name, CAST(sum(part_a) + coalesce(sum(part_b), 0) + sum(part_c)
      + coalesce(sum(part_d), 0) + sum(part_e) AS BIGINT) AS r
      FROM g WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem) GROUP BY 1)
    SELECT n_name, round(q - r, 2) AS split_delta FROM a LEFT JOIN b USING (n_name)""",
)
def treatas_semi_delta(spark, path):
    return rounded(query(star(spark, path), ["split_delta"], by=["nation.n_name"]), 2)


@case(
    "parent_mismatch_rows",
    """SELECT l_returnflag, count(*) FILTER (WHERE year(l_shipdate) <> year(o_orderdate)) AS mismatch_rows
    FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey GROUP BY 1""",
)
def parent_mismatch_rows(spark, path):
    return query(star(spark, path), ["mismatch_rows"], by=["lineitem.l_returnflag"])


@case(
    "drill_across_ratio",
    """WITH $SPLITS, a AS (SELECT n_name, count(*) AS n FROM g GROUP BY 1),
    b AS (SELECT n_name, count(DISTINCT l_orderkey) AS d FROM s GROUP BY 1),
    k AS (SELECT n_name, l_orderkey FROM s GROUP BY 1, 2
      HAVING count(*) = 5 AND count(DISTINCT l_linenumber) = 5),
    c AS (SELECT n_name, count(*) AS k FROM k GROUP BY 1)
    SELECT n_name, round(coalesce(d, 0)::DOUBLE / n, 6) AS split_coverage,
      round(coalesce(k, 0)::DOUBLE / n, 6) AS complete_coverage
    FROM a LEFT JOIN b USING (n_name) LEFT JOIN c USING (n_name)""",
)
def drill_across_ratio(spark, path):
    wanted = ["split_coverage", "complete_coverage"]
    return rounded(query(star(spark, path), wanted, by=["nation.n_name"]))


@case(
    "role_row_filter",
    """WITH $GEO SELECT n_name, count(*) AS result_rows, count(*) FILTER (WHERE is_valid) AS valid_rows,
    0::BIGINT AS europe_rows FROM g WHERE r_name = 'ASIA' GROUP BY 1""",
)
def role_row_filter(spark, path):
    # The role's filter stands even where a metric replaces the same field.
    wanted = {
        "result_rows": "result_rows",
        "valid_rows": "valid_rows",
        "europe_rows": m.filtered_count("orders", Predicate("region.r_name", "EUROPE")),
    }
    return query(star(spark, path), wanted, by=["nation.n_name"], role="asia")


@case(
    "same_period_last_year",
    """WITH d AS (SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS result_rows,
      max(o_totalprice) AS price_max FROM orders GROUP BY 1)
    SELECT d.day, d.result_rows, d.price_max, p.result_rows AS result_rows_last_year,
      p.price_max AS price_max_last_year
    FROM d LEFT JOIN d p ON p.day = d.day - INTERVAL 1 YEAR""",
)
def same_period_last_year(spark, path):
    wanted = {"result_rows": "result_rows", "price_max": m.maximum("orders.o_totalprice")}
    days = query(star(spark, path), wanted, by=["orders.day"])
    return windows.same_period_last_year(days, "day", [], ["result_rows", "price_max"])


def _match_inputs(spark, path):
    customers = read_table(spark, path, "customer")
    sources = customers.select(F.col("c_custkey").alias("source_id"), F.col("c_name").alias("name"))
    segment = F.col("c_mktsegment")
    spaced = F.regexp_replace("c_name", "#", " - ")
    targets = customers.where(segment != "AUTOMOBILE").select(
        F.col("c_custkey").alias("target_id"),
        F.when(segment == "HOUSEHOLD", F.concat(F.lit("Renamed "), F.col("c_custkey")))
        .when(segment == "MACHINERY", spaced)
        .otherwise(F.lower("c_name"))
        .alias("name"),
        F.when(segment == "HOUSEHOLD", F.upper("c_name")).alias("declared"),
    )
    doubled = customers.where(segment == "FURNITURE").select(
        (-F.col("c_custkey") - 1).alias("target_id"),
        F.upper("c_name").alias("name"),
        F.lit(None).cast("string").alias("declared"),
    )
    return sources, targets.unionByName(doubled)


@case(
    "match_cascade",
    """WITH src AS (SELECT c_custkey AS source_id, c_name AS name,
      upper(trim(regexp_replace(c_name, '[^A-Za-z0-9]+', '_', 'g'), '_')) AS form FROM customer),
    t0 AS (SELECT c_custkey AS target_id, CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 'Renamed ' || c_custkey
        WHEN 'MACHINERY' THEN replace(c_name, '#', ' - ') ELSE lower(c_name) END AS name,
        CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN upper(c_name) END AS declared
      FROM customer WHERE c_mktsegment <> 'AUTOMOBILE'
      UNION ALL SELECT -c_custkey - 1, upper(c_name), NULL FROM customer WHERE c_mktsegment = 'FURNITURE'),
    t AS (SELECT *, upper(trim(regexp_replace(name, '[^A-Za-z0-9]+', '_', 'g'), '_')) AS form FROM t0),
    e AS (SELECT lower(declared) AS k, count(*) AS n, min(target_id) AS t FROM t
      WHERE declared IS NOT NULL GROUP BY 1),
    x AS (SELECT lower(name) AS k, count(*) AS n, min(target_id) AS t FROM t GROUP BY 1),
    f AS (SELECT form AS k, count(*) AS n, min(target_id) AS t FROM t GROUP BY 1),
    fs AS (SELECT form AS k, count(*) AS n FROM src GROUP BY 1)
    SELECT source_id, name,
      CASE WHEN e.n = 1 THEN e.t WHEN e.n > 1 THEN NULL WHEN x.n = 1 THEN x.t WHEN x.n > 1 THEN NULL
        WHEN fs.n > 1 THEN NULL WHEN f.n = 1 THEN f.t END AS target_id,
      CASE WHEN e.n = 1 THEN 'EXPLICIT_MAPPING' WHEN e.n > 1 THEN 'AMBIGUOUS' WHEN x.n = 1 THEN 'EXACT_NAME'
        WHEN x.n > 1 OR fs.n > 1 THEN 'AMBIGUOUS' WHEN f.n = 1 THEN 'UNIQUE_IDENTIFIER_NORMALIZATION'
        WHEN f.n > 1 THEN 'AMBIGUOUS' ELSE 'NO_MATCH' END AS method,
      CASE WHEN e.n = 1 THEN NULL WHEN e.n > 1 THEN 'DUPLICATE_EXPLICIT_TARGET' WHEN x.n = 1 THEN NULL
        WHEN x.n > 1 THEN 'DUPLICATE_EXACT_TARGET' WHEN fs.n > 1 THEN 'SOURCE_NORMALIZATION_COLLISION'
        WHEN f.n > 1 THEN 'TARGET_NORMALIZATION_COLLISION' END AS reason
    FROM src LEFT JOIN e ON e.k = lower(name) LEFT JOIN x ON x.k = lower(name)
    LEFT JOIN f ON f.k = src.form LEFT JOIN fs ON fs.k = src.form""",
)
def match_cascade(spark, path):
    return matching.match_cascade(*_match_inputs(spark, path))


@case(
    "omitted_and_extra",
    """WITH t AS (SELECT DISTINCT l_orderkey + 100 AS k FROM lineitem)
    SELECT o_orderkey AS k, 'omitted' AS side FROM orders WHERE o_orderkey NOT IN (SELECT k FROM t)
    UNION ALL SELECT k, 'extra' FROM t WHERE k NOT IN (SELECT o_orderkey FROM orders)""",
)
def omitted_and_extra(spark, path):
    source = read_table(spark, path, "orders").select(F.col("o_orderkey").alias("k"))
    target = read_table(spark, path, "lineitem").select((F.col("l_orderkey") + 100).alias("k"))
    return diff.omitted_and_extra(source, target, ["k"], extra_once=True)


@case(
    "signature_lookup",
    """WITH r AS (SELECT p_brand, p_type, count(*) AS n, min(p_partkey) AS rule_id FROM part
      WHERE p_size >= 49 GROUP BY 1, 2)
    SELECT p_partkey, CASE WHEN n = 1 THEN rule_id END AS rule_id,
      CASE WHEN n IS NULL THEN 'NO_EXACT_REVIEW_RULE' WHEN n > 1 THEN 'AMBIGUOUS_REVIEW_RULE'
        ELSE 'REVIEW_RULE_SUGGESTED' END AS outcome
    FROM part LEFT JOIN r USING (p_brand, p_type)""",
)
def signature_lookup(spark, path):
    part = read_table(spark, path, "part")
    signed = part.withColumn(
        "signature", signature({"brand": F.col("p_brand"), "type": F.col("p_type")})
    )
    rules = signed.where("p_size >= 49").select("signature", F.col("p_partkey").alias("rule_id"))
    items = signed.select("p_partkey", "signature")
    return matching.signature_lookup(items, rules).select("p_partkey", "rule_id", "outcome")


@case(
    "obt_build",
    """WITH $GEO SELECT o_orderkey, day, o_orderstatus, o_orderpriority, part_a, part_b, is_valid, is_closed,
    c_mktsegment, n_name, r_name FROM g""",
)
def obt_build(spark, path):
    from plumbline.sources.wide import wide_table

    orders = ("o_orderkey", "day", "o_orderstatus", "o_orderpriority", "part_a", "part_b", "is_valid", "is_closed")
    fields = [f"orders.{c}" for c in orders]
    fields += ["customer.c_name", "customer.c_mktsegment", "nation.n_name", "region.r_name"]
    return wide_table(star(spark, path), "orders", fields, exclude=["customer.c_name"])
