"""Aggregation patterns."""

from __future__ import annotations

from plumbline import metrics as m
from plumbline import query
from plumbline.metrics import Calculate, Expr, Predicate
from plumbline.operators.profile import same_value
from plumbline.queries.registry import case, rounded
from plumbline.star import VALID, star

REGION = "region.r_name"
NATION = "nation.n_name"
STATUS = "orders.o_orderstatus"
PRIORITY = "orders.o_orderpriority"
SEGMENT = "customer.c_mktsegment"
CUSTOMER = "customer.c_custkey"


@case(
    "agg_count",
    """SELECT o_orderstatus, count(*) AS result_rows FROM orders GROUP BY 1""",
)
def agg_count(spark, path):
    return query(star(spark, path), ["result_rows"], by=[STATUS])


@case(
    "agg_column_count",
    """WITH $GEO SELECT r_name, count(closed_status) AS known_status, count(part_b) AS known_b
    FROM g GROUP BY 1""",
)
def agg_column_count(spark, path):
    counts = {
        "known_status": m.column_count("orders.closed_status"),
        "known_b": m.column_count("orders.part_b"),
    }
    return query(star(spark, path), counts, by=[REGION])


@case(
    "agg_sum",
    """WITH $SPLITS SELECT c_mktsegment, sum(l_quantity) AS split_quantity
    FROM s GROUP BY 1""",
)
def agg_sum(spark, path):
    return query(star(spark, path), ["split_quantity"], by=[SEGMENT])


@case(
    "agg_avg_min_max",
    """WITH $RESULTS SELECT o_orderpriority, round(avg(part_b), 6) AS b_average,
    min(part_b) AS b_min, max(part_b) AS b_max FROM o GROUP BY 1""",
)
def agg_avg_min_max(spark, path):
    return rounded(query(star(spark, path), ["b_average", "b_min", "b_max"], by=[PRIORITY]))


@case(
    "agg_distinct_blank",
    """WITH $GEO SELECT r_name,
    count(DISTINCT closed_status) + max(CASE WHEN closed_status IS NULL THEN 1 ELSE 0 END) AS statuses,
    count(DISTINCT o_custkey) AS events FROM g GROUP BY 1""",
)
def agg_distinct_blank(spark, path):
    wanted = {"statuses": m.distinct_count("orders.closed_status"), "events": "events"}
    return query(star(spark, path), wanted, by=[REGION])


@case(
    "scaled_sum",
    """WITH $RESULTS SELECT o_orderpriority, round(sum(part_b) / 3600.0::DOUBLE, 6) AS b_hours,
    round(sum(part_a) / 60.0::DOUBLE, 6) AS a_minutes FROM o GROUP BY 1""",
)
def scaled_sum(spark, path):
    wanted = {
        "b_hours": m.scaled(m.total("orders.part_b"), 3600),
        "a_minutes": m.scaled(m.total("orders.part_a"), 60),
    }
    return rounded(query(star(spark, path), wanted, by=[PRIORITY]))


@case(
    "sum_addition",
    """WITH $RESULTS SELECT o_orderstatus, o_orderpriority,
    CAST(coalesce(sum(part_d), 0) + coalesce(sum(part_e), 0) AS BIGINT) AS transition_total,
    CAST(CASE WHEN count(part_b) = 0 AND count(part_d) = 0 THEN NULL
      ELSE coalesce(sum(part_b), 0) + coalesce(sum(part_d), 0) END AS BIGINT) AS gaps_total
    FROM o GROUP BY 1, 2""",
)
def sum_addition(spark, path):
    wanted = {
        "transition_total": "transition_total",
        "gaps_total": m.add(m.total("orders.part_b"), m.total("orders.part_d")),
    }
    return query(star(spark, path), wanted, by=[STATUS, PRIORITY])


@case(
    "metric_addition",
    """WITH $RESULTS SELECT o_orderpriority, CAST(sum(part_a) + coalesce(sum(part_b), 0) + sum(part_c)
    + coalesce(sum(part_d), 0) + sum(part_e) AS BIGINT) AS recorded_total FROM o GROUP BY 1""",
)
def metric_addition(spark, path):
    return query(star(spark, path), ["recorded_total"], by=[PRIORITY])


@case(
    "scaled_metric",
    """WITH $GEO SELECT r_name, round(sum(part_a) / 3600.0::DOUBLE, 6) AS a_hours,
    round(sum(part_b) / 3600.0::DOUBLE, 6) AS b_hours,
    round(sum(part_c) / 3600.0::DOUBLE, 6) AS c_hours FROM g GROUP BY 1""",
)
def scaled_metric(spark, path):
    return rounded(query(star(spark, path), ["a_hours", "b_hours", "c_hours"], by=[REGION]))


@case(
    "filtered_count_replace",
    """WITH a AS (SELECT o_orderstatus, o_orderpriority, count(*) AS result_rows FROM orders GROUP BY 1, 2),
    f AS (SELECT o_orderpriority, count(*) AS f_rows FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)
    SELECT o_orderstatus, o_orderpriority, result_rows, coalesce(f_rows, 0) AS f_rows
    FROM a LEFT JOIN f USING (o_orderpriority)""",
)
def filtered_count_replace(spark, path):
    wanted = {
        "result_rows": "result_rows",
        "f_rows": m.filtered_count("orders", Predicate(STATUS, "F")),
    }
    return query(star(spark, path), wanted, by=[STATUS, PRIORITY])


@case(
    "filtered_count_replace_only",
    """SELECT o_orderstatus, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS f_rows
    FROM orders GROUP BY 1""",
)
def filtered_count_replace_only(spark, path):
    wanted = {"f_rows": m.filtered_count("orders", Predicate(STATUS, "F"))}
    return query(star(spark, path), wanted, by=[STATUS])


@case(
    "filtered_count_keep",
    """SELECT o_orderstatus, count(*) FILTER (WHERE o_orderstatus = 'F') AS f_rows
    FROM orders GROUP BY 1""",
)
def filtered_count_keep(spark, path):
    wanted = {"f_rows": m.filtered_count("orders", Predicate(STATUS, "F", keep=True))}
    return query(star(spark, path), wanted, by=[STATUS])


@case(
    "filtered_count_multi",
    """WITH $GEO SELECT r_name,
    count(*) FILTER (WHERE is_valid AND is_review = 1) AS reviewed_valid_rows,
    count(*) FILTER (WHERE is_valid AND part_a = 1000 AND o_orderpriority <> '5-LOW') AS typed_rows
    FROM g GROUP BY 1""",
)
def filtered_count_multi(spark, path):
    typed = m.filtered_count(
        "orders",
        VALID,
        Predicate("orders.part_a", 1000, keep=True),
        Predicate(PRIORITY, "5-LOW", op="ne", keep=True),
    )
    wanted = {"reviewed_valid_rows": "reviewed_valid_rows", "typed_rows": typed}
    return query(star(spark, path), wanted, by=[REGION])


@case(
    "filtered_count_related",
    """WITH $GEO SELECT r_name,
    count(*) FILTER (WHERE is_closed AND c_mktsegment = 'BUILDING') AS pro_closed_rows
    FROM g GROUP BY 1""",
)
def filtered_count_related(spark, path):
    return query(star(spark, path), ["pro_closed_rows"], by=[REGION])


@case(
    "nested_calculate",
    """WITH $GEO SELECT r_name,
    count(*) FILTER (WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT') AS both_filters,
    count(*) FILTER (WHERE o_orderstatus = 'F') AS inner_wins FROM g GROUP BY 1""",
)
def nested_calculate(spark, path):
    inner = m.filtered_count("orders", Predicate(STATUS, "F"))
    wanted = {
        "both_filters": Calculate(inner, (Predicate(PRIORITY, "1-URGENT"),)),
        "inner_wins": Calculate(inner, (Predicate(STATUS, "O"),)),
    }
    return query(star(spark, path), wanted, by=[REGION])


@case(
    "ratio_metric",
    """WITH $GEO SELECT c_custkey, CASE WHEN count(*) FILTER (WHERE is_valid) = 0 THEN NULL ELSE
    round(count(*) FILTER (WHERE is_valid AND is_review = 1)::DOUBLE
      / count(*) FILTER (WHERE is_valid), 6) END AS review_rate,
    round(count(*) FILTER (WHERE is_closed)::DOUBLE / count(*), 6) AS closed_rate
    FROM g GROUP BY 1""",
)
def ratio_metric(spark, path):
    return rounded(query(star(spark, path), ["review_rate", "closed_rate"], by=[CUSTOMER]))


@case(
    "agg_median",
    """SELECT o_orderstatus, round(quantile_cont(o_totalprice, 0.5), 4) AS price_median
    FROM orders GROUP BY 1""",
)
def agg_median(spark, path):
    wanted = {"price_median": m.median("orders.o_totalprice")}
    return rounded(query(star(spark, path), wanted, by=[STATUS]), 4)


@case(
    "median_filtered",
    """WITH $GEO SELECT r_name, round(quantile_cont((part_a + part_b + part_c)::DOUBLE, 0.5)
      FILTER (WHERE is_valid AND part_b IS NOT NULL), 4) AS abc_median FROM g GROUP BY 1""",
)
def median_filtered(spark, path):
    return rounded(query(star(spark, path), ["abc_median"], by=[REGION]), 4)


@case(
    "percentile_inc",
    """WITH $GEO SELECT n_name, round(quantile_cont((part_a + part_b + part_c)::DOUBLE, 0.9)
      FILTER (WHERE is_valid AND part_b IS NOT NULL), 4) AS abc_p90,
    round(quantile_cont((part_a + part_b + part_c)::DOUBLE, 0.25)
      FILTER (WHERE is_valid AND part_b IS NOT NULL), 4) AS abc_p25 FROM g GROUP BY 1""",
)
def percentile_inc(spark, path):
    from plumbline.star import ABC, COMPLETE

    wanted = {"abc_p90": "abc_p90", "abc_p25": m.percentile(ABC, 0.25, where=COMPLETE)}
    return rounded(query(star(spark, path), wanted, by=[NATION]), 4)


@case(
    "stddev_pop_guard",
    """WITH $GEO SELECT c_custkey,
    CASE WHEN count(*) FILTER (WHERE is_valid AND part_b IS NOT NULL) >= 2 THEN
      round(stddev_pop(part_a + part_b + part_c) FILTER (WHERE is_valid AND part_b IS NOT NULL), 4)
    END AS abc_stddev FROM g GROUP BY 1""",
)
def stddev_pop_guard(spark, path):
    return rounded(query(star(spark, path), ["abc_stddev"], by=[CUSTOMER]), 4)


@case(
    "sumx_related",
    """WITH $SPLITS, x AS (SELECT c_mktsegment, CAST(sum(p_size) AS BIGINT) AS size_total FROM s GROUP BY 1),
    y AS (SELECT c_mktsegment, round(sum(c_acctbal) FILTER (WHERE part_b > 0), 2) AS nominal_total
      FROM g GROUP BY 1)
    SELECT c_mktsegment, nominal_total, size_total FROM x FULL JOIN y USING (c_mktsegment)""",
)
def sumx_related(spark, path):
    wanted = {
        "nominal_total": "nominal_total",
        "size_total": m.total("part.p_size", table="lineitem"),
    }
    return rounded(query(star(spark, path), wanted, by=[SEGMENT]), 2)


@case(
    "weighted_ratio_shared_pop",
    """WITH $GEO SELECT r_name, round(sum(c_acctbal) FILTER (WHERE part_b > 0)
      / (sum(part_b) FILTER (WHERE part_b > 0) / 3600.0::DOUBLE), 6) AS weighted_speed
    FROM g GROUP BY 1""",
)
def weighted_ratio_shared_pop(spark, path):
    return rounded(query(star(spark, path), ["weighted_speed"], by=[REGION]))


@case(
    "avg_of_group_rates",
    """WITH $GEO, k AS (SELECT r_name, o_custkey,
      count(*) FILTER (WHERE is_valid)::DOUBLE / count(*) AS rate FROM g GROUP BY 1, 2)
    SELECT r_name, round(avg(rate), 6) AS event_mean_rate FROM k GROUP BY 1""",
)
def avg_of_group_rates(spark, path):
    return rounded(query(star(spark, path), ["event_mean_rate"], by=[REGION]))


@case(
    "complete_groups",
    """WITH $SPLITS, k AS (SELECT r_name, l_orderkey, count(*) AS n, count(DISTINCT l_linenumber) AS legs
      FROM s GROUP BY 1, 2)
    SELECT r_name, count(*) FILTER (WHERE n = 5 AND legs = 5) AS complete_splits FROM k GROUP BY 1""",
)
def complete_groups(spark, path):
    return query(star(spark, path), ["complete_splits"], by=[REGION])


@case(
    "fanout_control",
    """WITH $SPLITS, a AS (SELECT r_name, CAST(sum(part_b) AS BIGINT) AS b_total FROM g GROUP BY 1),
    b AS (SELECT r_name, CAST(sum(part_b) AS BIGINT) AS nc_fanned_b FROM s GROUP BY 1)
    SELECT r_name, b_total, nc_fanned_b, b_total = nc_fanned_b AS same FROM a FULL JOIN b USING (r_name)""",
)
def fanout_control(spark, path):
    both = query(star(spark, path), ["b_total", "nc_fanned_b"], by=[REGION])
    return same_value(both, "b_total", "nc_fanned_b")


@case(
    "bool_encoding_filter",
    """SELECT lang, count(*) AS labelled, count(*) FILTER (WHERE quality = 1) AS good,
    count(*) FILTER (WHERE quality = 1 AND toxic = 0) AS good_and_clean
    FROM labels LEFT JOIN documents USING (doc_id) GROUP BY 1""",
)
def bool_encoding_filter(spark, path):
    from plumbline.model import Model, Relationship, Table
    from plumbline.sources.tables import read_table

    labels = Table("labels", read_table(spark, path, "labels"), ("doc_id",), frozenset({"quality", "toxic"}))
    documents = Table("documents", read_table(spark, path, "documents"), ("doc_id",))
    link = Relationship("labels_documents", "labels", "documents", (("doc_id", "doc_id"),))
    good = Predicate("labels.quality", True, keep=True)
    clean = Predicate("labels.toxic", False, keep=True)
    wanted = {
        "labelled": m.count("labels"),
        "good": m.filtered_count("labels", good),
        "good_and_clean": m.filtered_count("labels", good, clean),
    }
    return query(Model([labels, documents], [link]), wanted, by=["documents.lang"])


BANDS = ((0.3, "HIGH"), (0.27, "MEDIUM"))


@case(
    "leg_context_rate",
    """WITH $SPLITS, k AS (SELECT n_name, c_mktsegment, l_returnflag, count(*) AS valid_leg_rows,
      count(*) FILTER (WHERE l_discount >= 0.08::DOUBLE) AS hard_rows FROM s GROUP BY 1, 2, 3)
    SELECT *, round(hard_rows::DOUBLE / valid_leg_rows, 6) AS hard_rate,
      CASE WHEN hard_rows::DOUBLE / valid_leg_rows >= 0.3::DOUBLE THEN 'HIGH'
        WHEN hard_rows::DOUBLE / valid_leg_rows >= 0.27::DOUBLE THEN 'MEDIUM' ELSE 'LOW' END AS context_band,
      hard_rows::DOUBLE / valid_leg_rows >= 0.3::DOUBLE AS context_flag FROM k""",
)
def leg_context_rate(spark, path):
    from pyspark.sql import functions as F

    from plumbline.functions.flags import band

    hard = m.count("lineitem", where=(Predicate("lineitem.l_discount", 0.08, op="ge"),))
    wanted = {"valid_leg_rows": "split_rows", "hard_rows": hard, "hard_rate": m.ratio(hard, "split_rows")}
    rates = query(star(spark, path), wanted, by=[NATION, SEGMENT, "lineitem.l_returnflag"])
    return rounded(
        rates.withColumns(
            {
                "context_band": band(F.col("hard_rate"), BANDS, "LOW"),
                "context_flag": F.col("hard_rate") >= BANDS[0][0],
            }
        )
    )


@case(
    "only_value",
    """WITH $GEO SELECT c_custkey,
    CASE WHEN count(DISTINCT o_orderstatus) = 1 THEN min(o_orderstatus) END AS the_status
    FROM g GROUP BY 1""",
)
def only_value(spark, path):
    return query(star(spark, path), {"the_status": m.only_value(STATUS)}, by=[CUSTOMER])
