"""Context shifts, ranks, rollups and time."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from plumbline import metrics as m
from plumbline import query
from plumbline.metrics import Calculate, Predicate
from plumbline.operators import ordered, todate, windows
from plumbline.queries.registry import case, rounded
from plumbline.sources.spine import day_spine
from plumbline.sources.tables import read_table
from plumbline.star import star

REGION, NATION, CUSTOMER = "region.r_name", "nation.n_name", "customer.c_custkey"
PRIORITY = "orders.o_orderpriority"
TOP_PRIORITIES = Predicate(PRIORITY, ("1-URGENT", "2-HIGH", "3-MEDIUM"), op="in")


@case(
    "share_of_visible",
    """WITH $GEO, k AS (SELECT r_name, o_orderpriority, count(*) FILTER (WHERE is_valid) AS valid_rows,
      count(DISTINCT o_custkey) AS events FROM g
      WHERE o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM') GROUP BY 1, 2),
    t AS (SELECT r_name, count(*) FILTER (WHERE is_valid) AS v, count(DISTINCT o_custkey) AS e FROM g
      WHERE o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM') GROUP BY 1)
    SELECT r_name, o_orderpriority, round(valid_rows::DOUBLE / v, 6) AS priority_share,
      round(events::DOUBLE / e, 6) AS event_share FROM k JOIN t USING (r_name)""",
)
def share_of_visible(spark, path):
    wanted = {
        "priority_share": "priority_share",
        "event_share": m.share_of_visible("events", PRIORITY),
    }
    model = star(spark, path)
    return rounded(query(model, wanted, by=[REGION, PRIORITY], filters=[TOP_PRIORITIES]))


@case(
    "share_of_all",
    """WITH $GEO, k AS (SELECT r_name, o_orderpriority, count(*) FILTER (WHERE is_valid) AS v FROM g
      WHERE o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM') GROUP BY 1, 2),
    t AS (SELECT r_name, count(*) FILTER (WHERE is_valid) AS tv FROM g GROUP BY 1)
    SELECT r_name, o_orderpriority, round(v::DOUBLE / tv, 6) AS share_of_region,
      round(v::DOUBLE / (SELECT count(*) FILTER (WHERE is_valid) FROM o), 6) AS share_of_world,
      (SELECT count(*) FROM o) AS all_rows
    FROM k JOIN t USING (r_name)""",
)
def share_of_all(spark, path):
    wanted = {
        "share_of_region": m.share_of_all("valid_rows", PRIORITY),
        "share_of_world": m.share_of_all("valid_rows", PRIORITY, REGION),
        "all_rows": Calculate("result_rows", clear_except=("orders.day",)),
    }
    model = star(spark, path)
    return rounded(query(model, wanted, by=[REGION, PRIORITY], filters=[TOP_PRIORITIES]))


@case(
    "rank_dense",
    """WITH $GEO, k AS (SELECT r_name, c_custkey, count(*) FILTER (WHERE is_valid) AS valid_rows
      FROM g GROUP BY 1, 2)
    SELECT *, dense_rank() OVER (PARTITION BY r_name ORDER BY valid_rows DESC) AS place FROM k""",
)
def rank_dense(spark, path):
    wanted = {"valid_rows": "valid_rows", "place": m.Rank("valid_rows", CUSTOMER)}
    return query(star(spark, path), wanted, by=[REGION, CUSTOMER])


@case(
    "topn_share",
    """WITH $GEO, k AS (SELECT n_name, c_custkey, count(*) FILTER (WHERE is_valid) AS v FROM g GROUP BY 1, 2),
    p AS (SELECT *, row_number() OVER (PARTITION BY n_name ORDER BY v DESC, c_custkey) AS place FROM k)
    SELECT n_name, CASE WHEN sum(v) > 0 THEN
      round(sum(v) FILTER (WHERE place <= 3)::DOUBLE / sum(v), 6) END AS top3_share FROM p GROUP BY 1""",
)
def topn_share(spark, path):
    return rounded(query(star(spark, path), ["top3_share"], by=[NATION]))


@case(
    "topn_overall",
    """SELECT o_custkey, count(*) AS result_rows FROM orders GROUP BY 1
    ORDER BY result_rows DESC, o_custkey LIMIT 10""",
)
def topn_overall(spark, path):
    per_event = query(star(spark, path), ["result_rows"], by=["orders.o_custkey"])
    return windows.top_n(per_event, "result_rows", "o_custkey", 10)


@case(
    "parent_share_hierarchy",
    """WITH $GEO, r AS (SELECT r_name, n_name, c_custkey, grouping(r_name, n_name, c_custkey) AS grouping_id,
      count(*) FILTER (WHERE is_valid) AS valid_rows FROM g GROUP BY ROLLUP (r_name, n_name, c_custkey))
    SELECT a.r_name, a.n_name, a.c_custkey, a.grouping_id, a.valid_rows,
      CASE WHEN p.valid_rows > 0 THEN round(a.valid_rows::DOUBLE / p.valid_rows, 6) END AS parent_share
    FROM r a JOIN r p
      ON p.grouping_id = CASE a.grouping_id WHEN 0 THEN 1 WHEN 1 THEN 3 ELSE 7 END
      AND p.r_name IS NOT DISTINCT FROM CASE WHEN a.grouping_id < 3 THEN a.r_name END
      AND p.n_name IS NOT DISTINCT FROM CASE WHEN a.grouping_id < 1 THEN a.n_name END""",
)
def parent_share_hierarchy(spark, path):
    rolled = query(star(spark, path), ["valid_rows"], by=[REGION, NATION, CUSTOMER], rollup=True)
    levels = ["r_name", "n_name", "c_custkey"]
    return rounded(windows.parent_share(rolled, levels, "valid_rows", "parent_share"))


@case(
    "rollup_subtotals",
    """WITH $GEO SELECT r_name, n_name, grouping(r_name, n_name) AS grouping_id,
    grouping(r_name) = 1 AS is_region_subtotal, grouping(n_name) = 1 AS is_nation_subtotal,
    count(*) AS result_rows, count(DISTINCT o_custkey) AS events,
    round(count(*) FILTER (WHERE is_valid)::DOUBLE / count(*), 6) AS valid_rate
    FROM g GROUP BY ROLLUP (r_name, n_name) ORDER BY r_name, n_name""",
)
def rollup_subtotals(spark, path):
    rolled = query(
        star(spark, path), ["result_rows", "events", "valid_rate"], by=[REGION, NATION], rollup=True
    )
    flagged = rolled.select(
        "r_name",
        "n_name",
        "grouping_id",
        (F.col("grouping_id") >= 2).alias("is_region_subtotal"),
        (F.col("grouping_id") >= 1).alias("is_nation_subtotal"),
        "result_rows",
        "events",
        "valid_rate",
    )
    return rounded(flagged).orderBy("r_name", "n_name")


@case(
    "rollup_median",
    """WITH $GEO SELECT r_name, n_name, grouping(r_name, n_name) AS grouping_id, count(*) AS result_rows,
    round(quantile_cont((part_a + part_b + part_c)::DOUBLE, 0.5)
      FILTER (WHERE is_valid AND part_b IS NOT NULL), 4) AS abc_median
    FROM g GROUP BY ROLLUP (r_name, n_name)""",
)
def rollup_median(spark, path):
    wanted = ["result_rows", "abc_median"]
    return rounded(query(star(spark, path), wanted, by=[REGION, NATION], rollup=True), 4)


@case(
    "calc_item_ytd",
    """WITH $RESULTS, d AS (SELECT o_orderpriority, day, count(*) AS n,
      count(*) FILTER (WHERE is_valid) AS v, sum(part_a) AS a, max(part_a) AS x FROM o GROUP BY 1, 2)
    SELECT o_orderpriority, day, n AS result_rows,
      CAST(sum(n) OVER w AS BIGINT) AS rows_ytd, round(sum(v) OVER w::DOUBLE / sum(n) OVER w, 6) AS rate_ytd,
      round(sum(a) OVER w::DOUBLE / sum(n) OVER w, 6) AS a_mean_ytd, max(x) OVER w AS a_max_ytd
    FROM d WINDOW w AS (PARTITION BY o_orderpriority, year(day) ORDER BY day)""",
)
def calc_item_ytd(spark, path):
    model = star(spark, path)
    to_date = lambda metric: m.year_to_date(metric, "orders.day", model)
    wanted = {
        "result_rows": "result_rows",
        "rows_ytd": to_date("result_rows"),
        "rate_ytd": to_date("valid_rate"),
        "a_mean_ytd": to_date(m.average("orders.part_a")),
        "a_max_ytd": to_date(m.maximum("orders.part_a")),
    }
    return rounded(query(model, wanted, by=[PRIORITY, "orders.day"]))


@case(
    "calc_item_ytd_filtered",
    """WITH $RESULTS, d AS (SELECT o_orderpriority, day, count(*) AS n FROM o GROUP BY 1, 2),
    y AS (SELECT *, CAST(sum(n) OVER (PARTITION BY o_orderpriority, year(day) ORDER BY day) AS BIGINT) AS rows_ytd FROM d)
    SELECT o_orderpriority, day, n AS result_rows, rows_ytd FROM y WHERE day >= DATE '1996-06-01'""",
)
def calc_item_ytd_filtered(spark, path):
    """A filter on the day picks rows; the year is still summed from its first day."""
    model = star(spark, path)
    wanted = {"result_rows": "result_rows", "rows_ytd": m.year_to_date("result_rows", "orders.day", model)}
    since = Predicate("orders.day", datetime.date(1996, 6, 1), op="ge")
    return query(model, wanted, by=[PRIORITY, "orders.day"], filters=[since])


@case(
    "customers_to_date",
    """WITH $GEO, k AS (SELECT DISTINCT r_name, day, o_custkey FROM g),
    f AS (SELECT r_name, o_custkey, min(day) AS day FROM k GROUP BY r_name, year(day), o_custkey),
    n AS (SELECT r_name, day, count(*) AS n FROM f GROUP BY 1, 2),
    d AS (SELECT DISTINCT r_name, day FROM k),
    t AS (SELECT d.r_name, d.day, CAST(sum(coalesce(n, 0)) OVER (PARTITION BY d.r_name, year(d.day) ORDER BY d.day) AS BIGINT) AS customers_ytd
      FROM d LEFT JOIN n ON n.r_name IS NOT DISTINCT FROM d.r_name AND n.day = d.day)
    SELECT r_name, day AS period, customers_ytd, 'day' AS grain FROM t WHERE day >= DATE '1996-06-01'
    UNION ALL SELECT r_name, CAST(date_trunc('month', day) AS DATE), max(customers_ytd), 'month' FROM t GROUP BY 1, 2
    UNION ALL SELECT r_name, CAST(date_trunc('year', day) AS DATE), max(customers_ytd), 'year' FROM t GROUP BY 1, 2""",
)
def customers_to_date(spark, path):
    """Distinct customers of the year so far: by day under a filter on the day, by month and by year."""
    from plumbline.plans.compose import joined_rows

    rows = joined_rows(star(spark, path), "orders", ["region.r_name", "orders.day", "orders.o_custkey"])
    grains = {
        g: todate.distinct_to_date(rows, ["r_name"], "day", "o_custkey", "customers_ytd", g).withColumn("grain", F.lit(g))
        for g in ("day", "month", "year")
    }
    return grains["day"].where("period >= DATE '1996-06-01'").unionByName(grains["month"]).unionByName(grains["year"])


@case(
    "median_to_date",
    """WITH $RESULTS, q AS (SELECT o_orderpriority, day,
      quantile_cont(part_b, 0.5) OVER w AS median_ytd, quantile_cont(part_b, 0.9) OVER w AS p90_ytd FROM o
      WHERE part_b IS NOT NULL WINDOW w AS (PARTITION BY o_orderpriority, year(day) ORDER BY day))
    SELECT DISTINCT o_orderpriority, day AS period, round(median_ytd, 6) AS median_ytd, round(p90_ytd, 6) AS p90_ytd FROM q""",
)
def median_to_date(spark, path):
    from plumbline.plans.compose import joined_rows

    rows = joined_rows(star(spark, path), "orders", ["orders.o_orderpriority", "orders.day", "orders.part_b"])
    points = {"median_ytd": 0.5, "p90_ytd": 0.9}
    return rounded(todate.percentiles_to_date(rows, ["o_orderpriority"], "day", "part_b", points))


@case(
    "time_spine_fill",
    """WITH d AS (SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS n FROM orders
      WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F' GROUP BY 1),
    s AS (SELECT CAST(unnest(generate_series((SELECT min(CAST(o_orderdate AS DATE)) FROM orders),
      (SELECT max(CAST(o_orderdate AS DATE)) FROM orders), INTERVAL 1 DAY)) AS DATE) AS day)
    SELECT day, coalesce(n, 0) AS reviewed_valid_rows FROM s LEFT JOIN d USING (day)""",
)
def time_spine_fill(spark, path):
    reviewed = [Predicate(PRIORITY, "1-URGENT"), Predicate("orders.o_orderstatus", "F")]
    days = query(
        star(spark, path), {"reviewed_valid_rows": "result_rows"}, by=["orders.day"], filters=reviewed
    )
    spine = day_spine(read_table(spark, path, "orders"), "o_orderdate", "day")
    return windows.fill_days(days, spine, "day", ["reviewed_valid_rows"])


@case(
    "selected_leg_switch",
    """WITH $RESULTS, t AS (SELECT CAST(sum(part_a) AS BIGINT) AS a, CAST(sum(part_b) AS BIGINT) AS b,
      CAST(sum(part_c) AS BIGINT) AS c FROM o)
    SELECT l_returnflag, count(*) AS split_rows,
      CASE l_returnflag WHEN 'A' THEN a WHEN 'N' THEN b WHEN 'R' THEN c END AS selected_part
    FROM lineitem, t GROUP BY l_returnflag, a, b, c""",
)
def selected_leg_switch(spark, path):
    return query(star(spark, path), ["split_rows", "selected_part"], by=["lineitem.l_returnflag"])


@case(
    "within_group_percentile",
    """WITH $GEO, p AS (SELECT o_orderkey, n_name, c_mktsegment,
      CASE WHEN part_a IS NOT NULL THEN percent_rank() OVER (
        PARTITION BY n_name, c_mktsegment, part_a IS NULL ORDER BY part_a DESC) END AS a,
      CASE WHEN part_b IS NOT NULL THEN percent_rank() OVER (
        PARTITION BY n_name, c_mktsegment, part_b IS NULL ORDER BY part_b DESC) END AS b,
      CASE WHEN part_d IS NOT NULL THEN percent_rank() OVER (
        PARTITION BY n_name, c_mktsegment, part_d IS NULL ORDER BY part_d DESC) END AS d FROM g)
    SELECT o_orderkey, n_name, c_mktsegment, round(a, 6) AS part_a_rel, round(b, 6) AS part_b_rel,
      round(d, 6) AS part_d_rel, CASE WHEN a IS NOT NULL AND b IS NOT NULL AND d IS NOT NULL THEN
        round(greatest(a, b, d) - least(a, b, d), 6) END AS spread_rel FROM p""",
)
def within_group_percentile(spark, path):
    from plumbline.plans.compose import joined_rows

    parts = ["part_a", "part_b", "part_d"]
    fields = ["orders.o_orderkey", NATION, "customer.c_mktsegment", *(f"orders.{p}" for p in parts)]
    frame = joined_rows(star(spark, path), "orders", fields)
    frame = ordered.relative_positions(
        frame, ["n_name", "c_mktsegment"], {p: f"{p}_rel" for p in parts}
    )
    rel = [f"{p}_rel" for p in parts]
    complete = F.col(rel[0]).isNotNull() & F.col(rel[1]).isNotNull() & F.col(rel[2]).isNotNull()
    spread = F.when(complete, F.greatest(*rel) - F.least(*rel))
    frame = frame.select("o_orderkey", "n_name", "c_mktsegment", *rel, spread.alias("spread_rel"))
    return rounded(frame)


@case(
    "filter_state",
    """WITH $GEO SELECT r_name, count(*) AS result_rows, true AS region_in_scope, false AS nation_in_scope,
    true AS status_filtered, true AS customer_cross_filtered, false AS split_cross_filters_part
    FROM g WHERE o_orderstatus = 'F' GROUP BY 1""",
)
def filter_state(spark, path):
    model = star(spark, path)
    flag = lambda test: m.Scoped(lambda s: m.Derived((), lambda: F.lit(bool(test(s)))))
    wanted = {
        "result_rows": "result_rows",
        "region_in_scope": flag(lambda s: s.in_scope(REGION)),
        "nation_in_scope": flag(lambda s: s.in_scope(NATION)),
        "status_filtered": flag(lambda s: s.is_filtered("orders.o_orderstatus")),
        "customer_cross_filtered": flag(lambda s: s.is_cross_filtered(model, CUSTOMER)),
        "split_cross_filters_part": flag(lambda s: s.is_cross_filtered(model, "part.p_size")),
    }
    valid = Predicate("orders.o_orderstatus", "F")
    return query(model, wanted, by=[REGION], filters=[valid])
