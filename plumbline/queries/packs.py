"""The whole corpus overall and per slice."""

from __future__ import annotations

from plumbline import query
from plumbline.queries.registry import case, rounded
from plumbline.star import CANONICAL, METRICS, star

CORPUS = [name for name in METRICS if name not in CANONICAL]

_ORDER_METRICS = """count(*) AS result_rows, count(DISTINCT o_custkey) AS events,
      CAST(sum(part_a) AS BIGINT) AS a_total, CAST(sum(part_b) AS BIGINT) AS b_total,
      CAST(sum(part_c) AS BIGINT) AS c_total,
      CAST(coalesce(sum(part_d), 0) + sum(part_e) AS BIGINT) AS transition_total,
      count(*) FILTER (WHERE is_closed) AS closed_rows, count(*) FILTER (WHERE is_valid) AS valid_rows,
      count(*) FILTER (WHERE is_review = 1) AS review_rows,
      count(*) FILTER (WHERE is_valid AND is_review = 1) AS reviewed_valid_rows,
      count(*) FILTER (WHERE is_closed AND c_mktsegment = 'BUILDING') AS pro_closed_rows,
      avg(part_b) AS b_average, min(part_b) AS b_min, max(part_b) AS b_max,
      quantile_cont((part_a + part_b + part_c)::DOUBLE, 0.5)
        FILTER (WHERE is_valid AND part_b IS NOT NULL) AS abc_median,
      quantile_cont((part_a + part_b + part_c)::DOUBLE, 0.9)
        FILTER (WHERE is_valid AND part_b IS NOT NULL) AS abc_p90,
      CASE WHEN count(*) FILTER (WHERE is_valid AND part_b IS NOT NULL) >= 2 THEN
        stddev_pop(part_a + part_b + part_c) FILTER (WHERE is_valid AND part_b IS NOT NULL) END AS abc_stddev,
      sum(c_acctbal) FILTER (WHERE part_b > 0) AS nominal_total,
      CAST(sum(o_custkey) AS BIGINT) AS nc_event_id_total"""


@case(
    "agg_overall",
    "WITH $SPLITS, a AS (SELECT " + _ORDER_METRICS + """ FROM g),
    b AS (SELECT count(*) AS split_rows, sum(l_quantity) AS split_quantity,
      count(DISTINCT l_orderkey) AS results_with_splits, sum(l_discount) AS nc_discount_total,
      CAST(sum(part_b) AS BIGINT) AS nc_fanned_b,
      count(*) FILTER (WHERE year(l_shipdate) <> year(o_orderdate)) AS mismatch_rows,
      count(DISTINCT l_returnflag) AS flags FROM s),
    e AS (SELECT avg(v::DOUBLE / n) AS event_mean_rate FROM (SELECT count(*) AS n,
      count(*) FILTER (WHERE is_valid) AS v FROM o GROUP BY o_custkey)),
    t AS (SELECT sum(v) FILTER (WHERE place <= 3)::DOUBLE / sum(v) AS top3_share FROM (
      SELECT count(*) FILTER (WHERE is_valid) AS v, row_number() OVER (
        ORDER BY count(*) FILTER (WHERE is_valid) DESC, o_custkey) AS place FROM o GROUP BY o_custkey)),
    k AS (SELECT count(*) AS complete_splits FROM (SELECT l_orderkey FROM lineitem GROUP BY 1
      HAVING count(*) = 5 AND count(DISTINCT l_linenumber) = 5)),
    d AS (SELECT CAST(sum(part_a) + sum(part_b) + sum(part_c) + sum(part_d) + sum(part_e) AS BIGINT) AS r
      FROM o WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem))
    SELECT result_rows, split_rows, split_quantity, results_with_splits, events, a_total, b_total, c_total,
      transition_total, a_total + b_total + c_total + transition_total AS recorded_total, closed_rows,
      valid_rows, review_rows, reviewed_valid_rows, pro_closed_rows,
      round(closed_rows::DOUBLE / result_rows, 6) AS closed_rate,
      round(valid_rows::DOUBLE / result_rows, 6) AS valid_rate,
      round(reviewed_valid_rows::DOUBLE / valid_rows, 6) AS review_rate,
      round(results_with_splits::DOUBLE / result_rows, 6) AS split_coverage, round(b_average, 6) AS b_average,
      b_min, b_max, round(abc_median, 6) AS abc_median, round(abc_p90, 6) AS abc_p90,
      round(abc_stddev, 4) AS abc_stddev, round(c_total / 3600.0::DOUBLE, 6) AS c_hours,
      round(b_total / 3600.0::DOUBLE, 6) AS b_hours, round(a_total / 3600.0::DOUBLE, 6) AS a_hours,
      round(nominal_total, 2) AS nominal_total,
      round(nominal_total / ((SELECT sum(part_b) FILTER (WHERE part_b > 0) FROM o) / 3600.0::DOUBLE), 6)
        AS weighted_speed,
      1.0::DOUBLE AS priority_share, NULL::BIGINT AS priority_rank, round(event_mean_rate, 6) AS event_mean_rate,
      1.0::DOUBLE AS geo_share, CASE WHEN flags = 1 THEN a_total END AS selected_part,
      round(top3_share, 6) AS top3_share, complete_splits,
      round(complete_splits::DOUBLE / result_rows, 6) AS complete_coverage, mismatch_rows,
      round(split_quantity - r, 2) AS split_delta, round(b_total / 60.0::DOUBLE, 6) AS nc_b_hours_by_60,
      nc_event_id_total, round(nc_discount_total, 2) AS nc_discount_total,
      round(review_rows::DOUBLE / valid_rows, 6) AS nc_review_rate,
      round(valid_rows::DOUBLE / result_rows, 6) AS nc_valid_rate, nc_fanned_b
    FROM a, b, e, t, k, d""",
)
def agg_overall(spark, path):
    frame = query(star(spark, path), CORPUS)
    return rounded(frame, abc_stddev=4, nominal_total=2, split_delta=2, nc_discount_total=2)


@case(
    "pack_distance",
    "WITH $GEO, a AS (SELECT o_orderpriority, " + _ORDER_METRICS + """ FROM g GROUP BY 1)
    SELECT o_orderpriority, result_rows, valid_rows, round(valid_rows::DOUBLE / result_rows, 6) AS valid_rate,
      round(b_average, 6) AS b_average, b_min, b_max, round(abc_median, 6) AS abc_median,
      round(abc_p90, 6) AS abc_p90, round(nominal_total, 2) AS nominal_total,
      round(nominal_total / (b_total / 3600.0::DOUBLE), 6) AS weighted_speed,
      round(valid_rows::DOUBLE / sum(valid_rows) OVER (), 6) AS priority_share,
      dense_rank() OVER (ORDER BY valid_rows DESC) AS priority_rank FROM a ORDER BY 1""",
)
def pack_distance(spark, path):
    wanted = [
        "result_rows", "valid_rows", "valid_rate", "b_average", "b_min", "b_max", "abc_median", "abc_p90",
        "nominal_total", "weighted_speed", "priority_share", "priority_rank",
    ]
    frame = query(star(spark, path), wanted, by=["orders.o_orderpriority"])
    return rounded(frame, nominal_total=2).orderBy("o_orderpriority")


@case(
    "pack_status",
    "WITH $GEO, a AS (SELECT o_orderstatus, " + _ORDER_METRICS + """ FROM g GROUP BY 1)
    SELECT o_orderstatus, result_rows, closed_rows, valid_rows, reviewed_valid_rows,
      round(closed_rows::DOUBLE / result_rows, 6) AS closed_rate,
      round(valid_rows::DOUBLE / result_rows, 6) AS valid_rate,
      CASE WHEN valid_rows > 0 THEN round(reviewed_valid_rows::DOUBLE / valid_rows, 6) END AS review_rate,
      round(abc_stddev, 4) AS abc_stddev FROM a ORDER BY 1""",
)
def pack_status(spark, path):
    wanted = [
        "result_rows", "closed_rows", "valid_rows", "reviewed_valid_rows", "closed_rate", "valid_rate",
        "review_rate", "abc_stddev",
    ]
    frame = query(star(spark, path), wanted, by=["orders.o_orderstatus"])
    return rounded(frame, abc_stddev=4).orderBy("o_orderstatus")


@case(
    "pack_event",
    """WITH $SPLITS, a AS (SELECT r_name, n_name, c_custkey, c_name, count(*) AS result_rows,
      count(*) FILTER (WHERE is_valid) AS valid_rows FROM g GROUP BY 1, 2, 3, 4),
    b AS (SELECT c_custkey, count(*) FILTER (WHERE year(l_shipdate) <> year(o_orderdate)) AS mismatch_rows
      FROM s GROUP BY 1),
    p AS (SELECT *, row_number() OVER (PARTITION BY n_name ORDER BY valid_rows DESC, c_custkey) AS place FROM a),
    t AS (SELECT n_name, sum(valid_rows) AS v,
      sum(valid_rows) FILTER (WHERE place <= 3) AS top FROM p GROUP BY 1)
    SELECT a.r_name, a.n_name, a.c_custkey, a.c_name, result_rows, valid_rows,
      round(valid_rows::DOUBLE / result_rows, 6) AS valid_rate,
      round(valid_rows::DOUBLE / result_rows, 6) AS event_mean_rate,
      CASE WHEN v > 0 THEN round(valid_rows::DOUBLE / v, 6) END AS geo_share,
      CASE WHEN v > 0 THEN round(top::DOUBLE / v, 6) END AS top3_share,
      coalesce(mismatch_rows, 0) AS mismatch_rows
    FROM a LEFT JOIN t USING (n_name) LEFT JOIN b USING (c_custkey)""",
)
def pack_event(spark, path):
    wanted = [
        "result_rows", "valid_rows", "valid_rate", "event_mean_rate", "geo_share", "top3_share", "mismatch_rows",
    ]
    by = ["region.r_name", "nation.n_name", "customer.c_custkey", "customer.c_name"]
    return rounded(query(star(spark, path), wanted, by=by))


@case(
    "pack_country",
    """WITH $GEO, r AS (SELECT r_name, n_name, grouping(r_name, n_name) AS grouping_id,
      count(*) AS result_rows, count(*) FILTER (WHERE is_valid) AS valid_rows
      FROM g GROUP BY ROLLUP (r_name, n_name))
    SELECT r_name, n_name, grouping_id, result_rows, valid_rows, round(valid_rows::DOUBLE / (
      CASE grouping_id WHEN 0 THEN sum(valid_rows) OVER (PARTITION BY r_name, grouping_id)
      ELSE sum(valid_rows) OVER (PARTITION BY grouping_id) END), 6) AS geo_share
    FROM r ORDER BY r_name, n_name""",
)
def pack_country(spark, path):
    wanted = ["result_rows", "valid_rows", "geo_share"]
    frame = query(star(spark, path), wanted, by=["region.r_name", "nation.n_name"], rollup=True)
    return rounded(frame).orderBy("r_name", "n_name")


@case(
    "pack_division",
    "WITH $GEO, a AS (SELECT c_mktsegment, c_mktsegment = 'BUILDING' AS is_pro, " + _ORDER_METRICS + """
      FROM g GROUP BY 1, 2)
    SELECT c_mktsegment, is_pro, result_rows, closed_rows, pro_closed_rows, valid_rows,
      round(closed_rows::DOUBLE / result_rows, 6) AS closed_rate FROM a ORDER BY 1""",
)
def pack_division(spark, path):
    wanted = ["result_rows", "closed_rows", "pro_closed_rows", "valid_rows", "closed_rate"]
    frame = query(star(spark, path), wanted, by=["customer.c_mktsegment", "customer.is_pro"])
    return rounded(frame).orderBy("c_mktsegment")


@case(
    "pack_age_group",
    "WITH $GEO, a AS (SELECT n_name, " + _ORDER_METRICS + """ FROM g GROUP BY 1)
    SELECT n_name, result_rows, closed_rows, valid_rows,
      CASE WHEN valid_rows > 0 THEN round(reviewed_valid_rows::DOUBLE / valid_rows, 6) END AS review_rate,
      round(nominal_total / (b_total / 3600.0::DOUBLE), 6) AS weighted_speed FROM a ORDER BY 1""",
)
def pack_age_group(spark, path):
    wanted = ["result_rows", "closed_rows", "valid_rows", "review_rate", "weighted_speed"]
    return rounded(query(star(spark, path), wanted, by=["nation.n_name"])).orderBy("n_name")


@case(
    "pack_leg",
    """WITH $SPLITS, t AS (SELECT CAST(sum(part_a) AS BIGINT) AS a FROM o)
    SELECT l_linenumber, count(*) AS split_rows, sum(l_quantity) AS split_quantity,
      count(DISTINCT l_orderkey) AS results_with_splits,
      CASE WHEN count(DISTINCT l_returnflag) = 1 AND min(l_returnflag) = 'A' THEN (SELECT a FROM t) END
        AS selected_part,
      NULL::DOUBLE AS complete_splits, NULL::DOUBLE AS complete_coverage,
      count(*) FILTER (WHERE year(l_shipdate) <> year(o_orderdate)) AS mismatch_rows,
      NULL::DOUBLE AS split_delta, CAST(sum(part_b) AS BIGINT) AS nc_fanned_b
    FROM s GROUP BY 1 ORDER BY 1""",
)
def pack_leg(spark, path):
    wanted = [
        "split_rows", "split_quantity", "results_with_splits", "selected_part", "complete_splits",
        "complete_coverage", "mismatch_rows", "split_delta", "nc_fanned_b",
    ]
    return rounded(query(star(spark, path), wanted, by=["lineitem.l_linenumber"])).orderBy("l_linenumber")


@case(
    "pack_canonical",
    """WITH $RESULTS, a AS (SELECT year, count(*) AS all_rows, count(*) FILTER (WHERE is_closed) AS finishers,
      count(*) FILTER (WHERE is_valid) AS valid_finishers, count(*) FILTER (WHERE is_review = 1) AS any_review_rows,
      count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS urgent_rows,
      count(*) FILTER (WHERE o_orderpriority = '5-LOW') AS low_rows,
      round(quantile_cont(o_totalprice, 0.5), 4) AS median_price,
      round(quantile_cont(part_a::DOUBLE, 0.5), 4) AS median_a,
      round(quantile_cont(part_b::DOUBLE, 0.5), 4) AS median_b,
      round(quantile_cont(part_c::DOUBLE, 0.5), 4) AS median_c FROM o GROUP BY 1)
    SELECT *, round(any_review_rows::DOUBLE / valid_finishers, 6) AS review_flag_rate,
      round(urgent_rows::DOUBLE / valid_finishers, 6) AS urgent_rate,
      round(low_rows::DOUBLE / valid_finishers, 6) AS low_rate FROM a""",
)
def pack_canonical(spark, path):
    medians = dict.fromkeys(["median_price", "median_a", "median_b", "median_c"], 4)
    return rounded(query(star(spark, path), list(CANONICAL), by=["orders.year"]), **medians)
