"""Rules that show only on blanks, orphans, name clashes and large integers; the rows are derived."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline import Model, Relationship, Table, query
from plumbline import metrics as m
from plumbline.functions import durations
from plumbline.metrics import Calculate, Expr, Predicate
from plumbline.operators import matching, reconcile
from plumbline.queries.registry import case
from plumbline.sources.tables import read_table


@case(
    "reconcile_exact_integers",
    """WITH l AS (SELECT o_custkey, count(*) + 10000000000 AS n FROM orders GROUP BY 1)
    SELECT o_custkey, n AS left_value, CAST(n + CASE WHEN o_custkey % 3 = 0 THEN 5 ELSE 0 END AS BIGINT) AS right_value,
      CASE WHEN n = n + CASE WHEN o_custkey % 3 = 0 THEN 5 ELSE 0 END THEN 'MATCH' ELSE 'DIFFERENT' END AS verdict FROM l""",
)
def reconcile_exact_integers(spark, path):
    # Five in ten thousand million is within the tolerance of decimals.
    counts = read_table(spark, path, "orders").groupBy("o_custkey").agg((F.count("*") + F.lit(10**10)).alias("value"))
    off = F.when(F.col("o_custkey") % 3 == 0, 5).otherwise(0)
    return reconcile.compare_cells(counts, counts.withColumn("value", F.col("value") + off), ["o_custkey"])


@case(
    "fingerprint_moved_blanks",
    """SELECT o_orderstatus, count(*) AS rows, o_orderstatus = 'F' AS stale FROM orders GROUP BY 1""",
)
def fingerprint_moved_blanks(spark, path):
    key, closed = F.col("o_custkey"), F.col("o_orderstatus") == "F"
    orders = read_table(spark, path, "orders")
    before = orders.select("o_orderstatus", key.alias("a"), F.lit(None).cast("bigint").alias("b"))
    after = orders.select("o_orderstatus", F.when(~closed, key).alias("a"), F.when(closed, key).alias("b"))
    prints = [reconcile.fingerprint(f, ["o_orderstatus"], ["a", "b"]) for f in (after, before)]
    outdated = reconcile.stale(*prints, ["o_orderstatus"]).withColumn("stale", F.lit(True))
    return prints[0].join(outdated, "o_orderstatus", "left").select(
        "o_orderstatus", "rows", F.coalesce("stale", F.lit(False)).alias("stale")
    )


def _with_blanks(spark, path, lost="false"):
    """Line items, and orders with a blank status and partly blank prices; orders that are `lost` are not there."""
    orders = read_table(spark, path, "orders").where(f"NOT ({lost})").select(
        "o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority",
        F.nullif("o_orderstatus", F.lit("P")).alias("status"),
        F.when(F.col("o_orderstatus") != "F", F.floor("o_totalprice")).alias("open_price"),
        F.when(F.col("o_orderstatus") != "O", F.floor("o_totalprice")).alias("closed_price"),
    )
    lines = read_table(spark, path, "lineitem").select("l_orderkey", "l_shipdate", "l_returnflag", "l_quantity")
    return Model(
        [Table("lines", lines), Table("orders", orders, ("o_orderkey",), large=True)],
        [Relationship("lines_orders", "lines", "orders", (("l_orderkey", "o_orderkey"),))],
    )


@case(
    "orphan_mismatch_rows",
    """SELECT l_returnflag, count(*) FILTER (WHERE year(l_shipdate) IS DISTINCT FROM year(o.o_orderdate)) AS mismatches
    FROM lineitem LEFT JOIN (SELECT * FROM orders WHERE o_orderpriority <> '5-LOW') o ON l_orderkey = o_orderkey GROUP BY 1""",
)
def orphan_mismatch_rows(spark, path):
    differs = Expr(("lines.l_shipdate", "orders.o_orderdate"), lambda a, b: ~F.year(a).eqNullSafe(F.year(b)))
    model = _with_blanks(spark, path, lost="o_orderpriority = '5-LOW'")
    return query(model, {"mismatches": m.count("lines", where=(differs,))}, by=["lines.l_returnflag"])


@case(
    "unequal_with_blank",
    """SELECT o_orderpriority, count(*) FILTER (WHERE nullif(o_orderstatus, 'P') IS DISTINCT FROM 'F') AS not_f
    FROM orders GROUP BY 1""",
)
def unequal_with_blank(spark, path):
    metric = Calculate(m.count("orders"), (Predicate("orders.status", "F", op="ne"),))
    return query(_with_blanks(spark, path), {"not_f": metric}, by=["orders.o_orderpriority"])


@case(
    "subtract_with_blank",
    """WITH s AS (SELECT o_custkey,
        CAST(sum(CASE WHEN o_orderstatus <> 'F' THEN floor(o_totalprice) END) AS BIGINT) AS a,
        CAST(sum(CASE WHEN o_orderstatus <> 'O' THEN floor(o_totalprice) END) AS BIGINT) AS b
      FROM orders GROUP BY 1)
    SELECT o_custkey, coalesce(a, 0) - coalesce(b, 0) AS delta FROM s WHERE a IS NOT NULL OR b IS NOT NULL""",
)
def subtract_with_blank(spark, path):
    metric = m.subtract(m.total("orders.open_price"), m.total("orders.closed_price"))
    return query(_with_blanks(spark, path), {"delta": metric}, by=["orders.o_custkey"])


@case(
    "match_blank_names",
    """WITH s AS (SELECT p_partkey, CASE WHEN p_size > 5 THEN p_name || ' ' || p_partkey WHEN p_size > 3 THEN '--' END AS name FROM part)
    SELECT p_partkey AS source_id, CASE WHEN name LIKE '%-%' AND length(name) < 3 OR name IS NULL THEN NULL ELSE p_partkey END AS target_id,
      CASE WHEN name IS NULL THEN 'NO_MATCH' WHEN name = '--' THEN
        CASE WHEN (SELECT count(*) FROM s WHERE name = '--') > 1 THEN 'AMBIGUOUS' ELSE 'EXACT_NAME' END ELSE 'EXACT_NAME' END AS method
    FROM s""",
)
def match_blank_names(spark, path):
    size = F.col("p_size")
    name = F.when(size > 5, F.concat_ws(" ", "p_name", F.col("p_partkey").cast("string"))).when(size > 3, "--")
    parts = read_table(spark, path, "part").select(F.col("p_partkey").alias("source_id"), name.alias("name"))
    targets = parts.select(F.col("source_id").alias("target_id"), "name", F.lit(None).cast("string").alias("declared"))
    return matching.match_cascade(parts, targets).select("source_id", "target_id", "method")


@case(
    "eligible_rules",
    """WITH r AS (SELECT p_brand AS signature, count(*) AS hits, min(p_partkey) AS rule FROM part
      WHERE p_size <= 25 AND p_type <> 'PROMO' GROUP BY 1)
    SELECT p.p_partkey AS item_id, CASE WHEN p_size % 7 = 0 THEN 'REVIEW_SIGNATURE_NOT_EXACT' WHEN hits IS NULL THEN 'NO_EXACT_REVIEW_RULE'
        WHEN hits > 1 THEN 'AMBIGUOUS_REVIEW_RULE' ELSE 'REVIEW_RULE_SUGGESTED' END AS outcome,
      CASE WHEN p_size % 7 <> 0 AND hits = 1 THEN rule END AS rule_id
    FROM part p LEFT JOIN r ON p.p_brand = r.signature""",
)
def eligible_rules(spark, path):
    parts = read_table(spark, path, "part")
    rules = parts.select(
        F.col("p_partkey").alias("rule_id"),
        F.col("p_brand").alias("signature"),
        F.when(F.col("p_size") <= 25, "ACCEPTED").otherwise("PROPOSED").alias("status"),
        F.when(F.col("p_type") != "PROMO", "CURRENT").otherwise("SUPERSEDED").alias("supersession_status"),
    )
    supplied = F.when(F.col("p_size") % 7 != 0, F.col("p_brand"))
    items = parts.select(F.col("p_partkey").alias("item_id"), F.col("p_brand").alias("signature"), supplied.alias("supplied"))
    return matching.signature_lookup(items, rules).select("item_id", "outcome", "rule_id")


@case(
    "long_durations",
    """SELECT event_id, (event_id + 12345) * 3600 + 62 AS seconds FROM events""",
)
def long_durations(spark, path):
    hours = (F.col("event_id") + 12345).cast("string")
    text = F.concat(hours, F.lit(":01:02"))
    return read_table(spark, path, "events").select("event_id", durations.to_seconds(text).alias("seconds"))


def _named(spark, path):
    nation, region = read_table(spark, path, "nation"), read_table(spark, path, "region")
    return Model(
        [
            Table("customer", read_table(spark, path, "customer")),
            Table("nation", nation.withColumnRenamed("n_name", "name"), ("n_nationkey",)),
            Table("region", region.withColumnRenamed("r_name", "name"), ("r_regionkey",)),
        ],
        [
            Relationship("customer_nation", "customer", "nation", (("c_nationkey", "n_nationkey"),)),
            Relationship("nation_region", "nation", "region", (("n_regionkey", "r_regionkey"),)),
        ],
    )


@case(
    "equal_column_names",
    """SELECT n_name AS nation__name, r_name AS region__name, count(*) AS customers
    FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2""",
)
def equal_column_names(spark, path):
    return query(_named(spark, path), {"customers": m.count("customer")}, by=["nation.name", "region.name"])


@case(
    "expression_filter",
    """SELECT r_name AS name, count(*) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey
    JOIN region ON n_regionkey = r_regionkey WHERE c_acctbal < 0 OR n_name LIKE 'A%' GROUP BY 1""",
)
def expression_filter(spark, path):
    either = Expr(("customer.c_acctbal", "nation.name"), lambda balance, name: (balance < 0) | name.startswith("A"))
    return query(_named(spark, path), {"customers": m.count("customer")}, by=["region.name"], filters=[either])
