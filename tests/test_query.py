"""Context rules on small tables with blanks, orphans and inactive links."""

import pytest
from pyspark.sql import functions as F

from plumbline import Model, ModelError, Relationship, Table, metric_slices, query
from plumbline import metrics as m
from plumbline.metrics import Calculate, Expr, Predicate


def rows_of(frame, *keys):
    return {tuple(r[k] for k in keys): r for r in frame.collect()}


# -- the three small fixtures ------------------------------------------------


def test_supported_fixture(spark):
    fact = spark.createDataFrame(
        [(1, 10, 100, 12.5, 1), (2, 10, 100, 7.5, 1), (3, 11, 101, 20.0, 0), (4, None, 101, 5.0, 1)],
        "result_id long, athlete_id long, event_id long, amount double, is_valid int",
    )
    model = Model([Table("f", fact, ("result_id",), frozenset({"is_valid"}))])
    model.metrics.update(
        total=m.total("f.amount"),
        athletes=m.column_count("f.athlete_id"),
        distinct=m.distinct_count("f.athlete_id"),
        valid=m.filtered_count("f", Predicate("f.is_valid", True)),
        rate=m.ratio("valid", "athletes"),
    )
    row = query(model, list(model.metrics)).first()
    assert tuple(row) == (45.0, 3, 3, 3, 1.0)


@pytest.fixture
def traps(spark):
    fact = spark.createDataFrame(
        [
            (1, 3600, 1001, 0.5, "ten", 1, 10, 11),
            (2, 1800, 1002, 0.8, "twenty", 1, 10, 12),
            (3, 900, 1003, 0.2, "thirty", 0, 11, 10),
        ],
        "row_id long, duration_seconds long, numeric_id long, success_rate double, total_measure string, "
        "is_valid int, dimension_id long, alternate_dimension_id long",
    )
    dim = spark.createDataFrame([(10, "x"), (11, "y"), (12, "z")], "dimension_id long, label string")
    return Model(
        [Table("f", fact, ("row_id",), frozenset({"is_valid"})), Table("d", dim, ("dimension_id",))],
        [
            Relationship("active", "f", "d", (("dimension_id", "dimension_id"),), both=True),
            Relationship("other", "f", "d", (("alternate_dimension_id", "dimension_id"),), active=False),
        ],
    )


def test_inactive_relationship_only_on_request(traps):
    wanted = {"rows": m.count("f"), "other": Calculate(m.count("f"), use=("other",))}
    got = rows_of(query(traps, wanted, by=["d.label"]), "label")
    assert {k[0]: (r.rows, r.other) for k, r in got.items()} == {"x": (2, 1), "y": (1, 1), "z": (0, 1)}


def test_many_side_filters_the_one_side_when_marked(traps):
    members = Calculate(m.count("d"), (Predicate("f.is_valid", True),))
    assert query(traps, {"n": members}).first().n == 1
    one_way = Model(traps.tables.values(), [Relationship("active", "f", "d", (("dimension_id", "dimension_id"),))])
    assert query(one_way, {"n": members}).first().n == 3


def test_grouping_by_the_many_side_when_marked(traps):
    members = {"n": m.count("d")}
    got = rows_of(query(traps, members, by=["f.is_valid"]), "is_valid")
    assert {k[0]: r.n for k, r in got.items()} == {1: 1, 0: 1}
    got = rows_of(query(traps, members, by=["f.is_valid", "d.label"], filters=[Predicate("f.row_id", 1)]), "is_valid", "label")
    assert {k: r.n for k, r in got.items()} == {(1, "x"): 1}


def test_iterator_and_nested_filters_fixture(spark):
    fact = spark.createDataFrame(
        [(1, 10.0, 20260101, 20250101), (2, 20.0, 20260102, 20250102)],
        "row_id long, value double, date_id long, alternate_date_id long",
    )
    model = Model([Table("f", fact, ("row_id",))])
    nested = Calculate(
        m.filtered_count("f", Predicate("f.row_id", 1)), (Predicate("f.date_id", 10),)
    )
    row = query(
        model,
        {
            "total": m.total("f.value"),
            "nested": nested,
            "level1": m.ratio(m.count("f"), m.total("f.value")),
        },
    ).first()
    assert (row.total, row.nested, row.level1) == (30.0, 0, pytest.approx(2 / 30))


# -- a star with blanks and orphans ------------------------------------------


@pytest.fixture(scope="module", params=[False, True], ids=["small", "large"])
def shop(spark, request):
    sales = spark.createDataFrame(
        [
            (1, "a", 10, "x", 5.0),
            (2, "a", 10, "y", None),
            (3, "b", 20, "x", 7.0),
            (4, None, 20, "x", 1.0),
            (5, "gone", 30, None, 2.0),
        ],
        "id int, item string, day int, flag string, amount double",
    )
    items = spark.createDataFrame([("a", "toys"), ("b", "food"), ("unused", "food")], "item string, kind string")
    refunds = spark.createDataFrame([("a", 1), ("a", 2), ("unused", 4)], "item string, n int")
    return Model(
        [Table("sales", sales, ("id",)), Table("items", items, ("item",), large=request.param), Table("refunds", refunds)],
        [
            Relationship("sales_items", "sales", "items", (("item", "item"),)),
            Relationship("refunds_items", "refunds", "items", (("item", "item"),)),
        ],
    )


def test_blank_and_orphan_keys_form_one_blank_member(shop):
    got = rows_of(query(shop, {"n": m.count("sales"), "t": m.total("sales.amount")}, by=["items.kind"]), "kind")
    assert {k[0]: (r.n, r.t) for k, r in got.items()} == {
        "toys": (2, 5.0),
        "food": (1, 7.0),
        None: (2, 3.0),
    }


def test_facts_meet_on_all_coordinates(shop):
    wanted = {"n": m.count("sales"), "r": m.total("refunds.n"), "q": m.ratio(m.total("refunds.n"), m.count("sales"))}
    got = rows_of(query(shop, wanted, by=["items.kind"]), "kind")
    assert {k[0]: (r.n, r.r, r.q) for k, r in got.items()} == {
        "toys": (2, 3, 1.5),
        "food": (1, 4, 4.0),
        None: (2, None, None),
    }


def test_replace_against_keep(shop):
    wanted = {
        "keep": m.filtered_count("sales", Predicate("sales.flag", "x", keep=True)),
        "replace": m.filtered_count("sales", Predicate("sales.flag", "x")),
    }
    got = rows_of(query(shop, wanted, by=["sales.flag"]), "flag")
    assert {k[0]: (r.keep, r.replace) for k, r in got.items()} == {"x": (3, 3), "y": (0, 3), None: (0, 3)}
    outer = query(shop, wanted, filters=[Predicate("sales.flag", "y")]).first()
    assert tuple(outer) == (0, 3)


def test_zero_as_blank(shop):
    wanted = {"keep": m.filtered_count("sales", Predicate("sales.flag", "x", keep=True))}
    got = rows_of(query(shop, wanted, by=["sales.flag"], zero_as_blank=True), "flag")
    assert {k[0]: r.keep for k, r in got.items()} == {"x": 3, "y": None, None: None}


def test_blank_arithmetic(shop):
    none = m.total("sales.amount", where=(Predicate("sales.flag", "nothing"),))
    row = query(
        shop,
        {
            "all_blank": m.add(none, none),
            "part_blank": m.add(none, m.count("sales")),
            "by_zero": m.ratio(m.count("sales"), m.filtered_count("sales", Predicate("sales.flag", "nothing"))),
            "sum_of_none": none,
        },
    ).first()
    assert tuple(row) == (None, 5.0, None, None)


def test_distinct_count_counts_blank_once(shop):
    row = query(shop, {"d": m.distinct_count("sales.item"), "c": m.column_count("sales.item")}).first()
    assert tuple(row) == (4, 4)


def test_stddev_needs_two_rows(shop):
    got = rows_of(query(shop, {"s": m.stddev_pop("sales.amount")}, by=["sales.day"]), "day")
    assert got[(30,)].s is None
    assert got[(20,)].s == 3.0


def test_unreachable_column_repeats_the_total(shop):
    got = query(shop, {"s": m.count("sales")}, by=["refunds.n"]).collect()
    assert sorted(tuple(r) for r in got) == [(1, 5), (2, 5), (4, 5)]


def test_only_value_and_switch(shop):
    pick = m.switch(m.only_value("sales.flag"), {"x": m.count("sales"), "y": m.total("sales.amount")})
    got = rows_of(query(shop, {"v": pick, "o": m.only_value("sales.flag")}, by=["sales.day"]), "day")
    assert {k[0]: (r.v, r.o) for k, r in got.items()} == {10: (None, None), 20: (2.0, "x"), 30: (None, None)}


def test_rollup_tells_blank_member_from_subtotal(shop):
    got = query(shop, {"n": m.count("sales")}, by=["items.kind", "sales.flag"], rollup=True)
    table = {(r.kind, r.flag, r.grouping_id): r.n for r in got.collect()}
    assert table[None, None, 3] == 5
    assert table[None, None, 1] == 2
    assert table[None, None, 0] == 1
    assert table["toys", None, 1] == 2


def test_rollup_of_statistics_matches_each_level(shop):
    wanted = {
        "median": m.median("sales.amount"),
        "share": m.share_of_visible(m.count("sales"), "sales.flag"),
        "rank": m.Rank(m.count("sales"), "sales.flag"),
    }
    by = ["items.kind", "sales.flag"]
    rolled = {(r.kind, r.flag, r.grouping_id): r for r in query(shop, wanted, by=by, rollup=True).collect()}
    for depth, gid in ((2, 0), (1, 1), (0, 3)):
        level = query(shop, wanted, by=by[:depth]).collect()
        assert len(level) == sum(k[2] == gid for k in rolled)
        for row in level:
            key = tuple(row[c] if i < depth else None for i, c in enumerate(("kind", "flag")))
            got = rolled[(*key, gid)]
            assert (got.median, got.share, got["rank"]) == (row.median, row.share, row["rank"])


def test_shares_add_up(shop):
    share = m.share_of_visible(m.count("sales"), "sales.flag")
    got = query(shop, {"s": share}, by=["items.kind", "sales.flag"])
    sums = got.groupBy("kind").agg(F.sum("s").alias("s")).collect()
    assert [round(r.s, 9) for r in sums] == [1.0] * 3


def test_role_cannot_be_replaced(shop):
    model = Model(shop.tables.values(), shop.relationships, roles={"toys": (Predicate("items.kind", "toys"),)})
    wanted = {"n": m.count("sales"), "food": m.filtered_count("sales", Predicate("items.kind", "food"))}
    assert tuple(query(model, wanted, role="toys").first()) == (2, 0)


def test_visible_keys_restrict_another_table(shop):
    kept = Calculate(m.count("sales"), treat_as=("refunds.item", "sales.item"))
    assert query(shop, {"n": kept}).first().n == 2


def test_composite_relationship(spark):
    fact = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (None, "a")], "x int, y string")
    dim = spark.createDataFrame([(1, "a", "p"), (1, "b", "q"), (2, "a", "p")], "x int, y string, z string")
    model = Model([Table("f", fact), Table("d", dim, ("x", "y"))], [Relationship("r", "f", "d", (("x", "x"), ("y", "y")))])
    got = rows_of(query(model, {"n": m.count("f")}, by=["d.z"]), "z")
    assert {k[0]: r.n for k, r in got.items()} == {"p": 2, "q": 1, None: 1}


def test_masks_on_parents_survive_the_reduction(shop):
    wanted = {
        "n": m.count("sales", where=(Predicate("items.kind", "toys"), Predicate("sales.flag", "x"))),
        "a": m.average("sales.amount", where=(Predicate("items.kind", "food"),)),
        "lo": m.minimum("sales.amount"),
    }
    got = rows_of(query(shop, wanted, by=["items.kind"]), "kind")
    assert {k[0]: (r.n, r.a, r.lo) for k, r in got.items()} == {
        "toys": (1, None, 5.0),
        "food": (0, 7.0, 7.0),
        None: (0, None, 1.0),
    }


@pytest.mark.parametrize("large", [False, True])
def test_chain_of_parents_gives_the_same_with_and_without_reduction(spark, large):
    lines = [(i, i % 17 if i % 17 < 15 else None, i % 3, float(i % 7) if i % 5 else None) for i in range(400)]
    fact = spark.createDataFrame(lines, "id int, o int, f int, v double")
    orders = spark.createDataFrame([(i, i % 5 if i % 4 else None, "p" if i % 2 else "q") for i in range(14)], "o int, c int, s string")
    people = spark.createDataFrame([(i, i % 2) for i in range(4)], "c int, n int")
    places = spark.createDataFrame([(0, "x"), (1, "y")], "n int, name string")
    model = Model(
        [Table("fact", fact), Table("orders", orders, large=large), Table("people", people, large=large), Table("places", places)],
        [
            Relationship("1", "fact", "orders", (("o", "o"),)),
            Relationship("2", "orders", "people", (("c", "c"),)),
            Relationship("3", "people", "places", (("n", "n"),)),
        ],
    )
    keep = lambda f, v: Predicate(f, v, keep=True)
    wanted = {
        "n": m.count("fact"),
        "n_q": m.filtered_count("fact", keep("orders.s", "q")),
        "n_x": m.filtered_count("fact", keep("places.name", "x"), keep("fact.f", 1)),
        "total": m.total("fact.v"),
        "a": m.average("fact.v"),
        "lo": m.minimum("fact.v"),
        "hi": m.maximum("fact.v"),
        "keys": m.distinct_count("fact.o"),
        "one": m.only_value("fact.f"),
    }
    o2c = {i: i % 5 if i % 4 else None for i in range(14)}
    for by, filters in ((("places.name",), []), (("orders.s", "places.name"), []), (("places.name",), [Predicate("orders.s", "p")])):
        got = query(model, wanted, by=by, filters=filters, rollup=True).collect()

        def place(o):
            c = o2c.get(o)
            return {0: "x", 1: "y", 2: "x", 3: "y"}.get(c)

        def status(o):
            return None if o is None or o >= 14 else "p" if o % 2 else "q"

        rows = [r for r in lines if not filters or status(r[1]) == "p"]
        for row in got:
            mine = [
                r for r in rows
                if (row.grouping_id & 1 or place(r[1]) == row["name"])
                and (len(by) == 1 or row.grouping_id & 2 or status(r[1]) == row.s)
            ]
            values = [r[3] for r in mine if r[3] is not None]
            assert row.n == len(mine)
            assert row.n_q == sum(status(r[1]) == "q" for r in mine)
            assert row.n_x == sum(place(r[1]) == "x" and r[2] == 1 for r in mine)
            assert row.total == sum(values)
            assert row.a == pytest.approx(sum(values) / len(values))
            assert (row.lo, row.hi) == (min(values), max(values))
            assert row["keys"] == len({r[1] for r in mine})
            assert row.one is None


def test_branching_parents_give_the_same_with_and_without_reduction(spark):
    fact = spark.createDataFrame([(i % 11, float(i)) for i in range(100)], "o int, v double")
    orders = spark.createDataFrame([(i, i % 4, i % 3) for i in range(10)], "o int, c int, h int")
    people = spark.createDataFrame([(i, i % 2) for i in range(4)], "c int, n int")
    shops = spark.createDataFrame([(i, f"s{i}") for i in range(3)], "h int, label string")
    places = spark.createDataFrame([(0, "x"), (1, "y")], "n int, name string")
    results = []
    for large in (False, True):
        frames = {"fact": fact, "orders": orders, "people": people, "shops": shops, "places": places}
        model = Model(
            [Table(n, f, large=large) for n, f in frames.items()],
            [
                Relationship("1", "fact", "orders", (("o", "o"),)),
                Relationship("2", "orders", "people", (("c", "c"),)),
                Relationship("3", "orders", "shops", (("h", "h"),)),
                Relationship("4", "people", "places", (("n", "n"),)),
            ],
        )
        wanted = {"n": m.count("fact"), "v": m.total("fact.v")}
        got = query(model, wanted, by=["places.name", "shops.label"]).collect()
        results.append(sorted(map(repr, got)))
    assert results[0] == results[1]
    assert len(results[0]) == 7


def test_average_over_keys_and_groups_meeting(shop):
    rate = m.ratio(m.filtered_count("sales", Predicate("sales.flag", "x", keep=True)), m.count("sales"))
    wanted = {
        "mean": m.average_over("sales", "sales.day", m.count("sales"), rate),
        "pairs": m.groups_meeting("sales", "sales.day", {"rows": m.count("sales")}, lambda rows: rows == 2),
    }
    row = query(shop, wanted).first()
    assert row.mean == pytest.approx((0.5 + 1 + 0) / 3)
    assert row.pairs == 2


def test_top_share_breaks_ties_by_key(shop):
    top = m.top_share("sales", "sales.day", m.count("sales"), 1)
    assert query(shop, {"t": top}).first().t == pytest.approx(2 / 5)


def test_rank_is_blank_outside_its_scope(shop):
    rank = {"r": m.Rank(m.count("sales"), "sales.flag")}
    assert query(shop, rank).first().r is None
    got = rows_of(query(shop, rank, by=["sales.flag"]), "flag")
    assert {k[0]: r.r for k, r in got.items()} == {"x": 1, "y": 2, None: 2}


def test_year_to_date_restarts_each_year(spark):
    days = [("2020-12-30", 1.0), ("2020-12-31", 2.0), ("2021-01-02", 5.0)]
    fact = spark.createDataFrame(days, "d string, v double").withColumn("d", F.to_date("d"))
    model = Model([Table("f", fact)], metrics={"v": m.total("f.v"), "mean": m.average("f.v")})
    wanted = {n: m.year_to_date(n, "f.d", model) for n in ("v", "mean")}
    got = sorted(query(model, wanted, by=["f.d"]).collect())
    assert [(r.v, r.mean) for r in got] == [(1.0, 1.0), (3.0, 1.5), (5.0, 5.0)]
    with pytest.raises(ModelError):
        m.year_to_date(m.distinct_count("f.v"), "f.d")
    with pytest.raises(ModelError):
        query(model, wanted)


def test_leap_day_last_year(spark):
    from plumbline.operators.windows import same_period_last_year

    frame = spark.createDataFrame(
        [("1999-02-28", 1), ("2000-02-28", 2), ("2000-02-29", 3), ("2001-02-28", 4)], "d string, n int"
    ).withColumn("d", F.to_date("d"))
    got = sorted(same_period_last_year(frame, "d", [], ["n"]).collect())
    assert [r.n_last_year for r in got] == [None, 1, 1, 2]


# -- errors ------------------------------------------------------------------


def test_metric_cycle(shop):
    model = Model(shop.tables.values(), metrics={"a": m.add("b", "b"), "b": m.scaled("a", 2)})
    with pytest.raises(ModelError, match="cycle"):
        query(model, ["a"])


def test_unknown_names(shop):
    with pytest.raises(ModelError, match="unknown metric"):
        query(shop, ["nothing"])
    with pytest.raises(ModelError, match="unknown table"):
        Model([], [Relationship("r", "x", "y", (("a", "b"),))])
    with pytest.raises(ModelError, match="cannot be reached"):
        query(shop, {"x": m.total("refunds.n", table="sales")})


def test_two_active_routes_are_refused(traps):
    both = Model(
        traps.tables.values(),
        [
            Relationship("one", "f", "d", (("dimension_id", "dimension_id"),)),
            Relationship("two", "f", "d", (("alternate_dimension_id", "dimension_id"),)),
        ],
    )
    with pytest.raises(ModelError, match="two active routes"):
        query(both, {"n": m.count("f")}, by=["d.label"])


def test_patterns_check_their_arguments(shop):
    for divisor in (0, -1, True, "x"):
        with pytest.raises(ModelError):
            m.scaled(m.count("sales"), divisor)
    with pytest.raises(ModelError):
        m.add(m.count("sales"))
    with pytest.raises(ModelError, match="not a boolean"):
        query(shop, {"n": m.filtered_count("sales", Predicate("sales.day", True))})


def test_slices_in_long_form(shop):
    model = Model(shop.tables.values(), shop.relationships, {"n": m.count("sales"), "r": m.total("refunds.n")})
    slices = {"ALL": [()], "KIND": [("items.kind",), ()]}
    got = {
        (r.metric, r.slice, r.grouping, r.coordinates): r.value
        for r in metric_slices(model, ["n", "r"], slices, {"n": ("ALL", "KIND"), "r": ("KIND",)}).collect()
    }
    assert got["n", "ALL", 0, "{}"] == 5
    assert got["n", "KIND", 1, "{}"] == 5
    assert got["n", "KIND", 0, '{"items.kind":null}'] == 2
    assert got["r", "KIND", 0, '{"items.kind":"food"}'] == 4
    assert ("r", "ALL", 0, "{}") not in got


def test_row_expressions_join_what_they_need(shop):
    food = Expr(("items.kind", "sales.amount"), lambda k, a: F.when(k == "food", a * 2))
    assert query(shop, {"t": m.total(food, table="sales")}).first().t == 14.0


def test_distinct_parent_keys_are_counted_from_the_reduced_fact(shop):
    x = Predicate("sales.flag", "x", keep=True)
    wanted = {
        "items": m.distinct_count("sales.item"),
        "items_x": Calculate(m.distinct_count("sales.item"), (x,)),
        "toys": Calculate(m.distinct_count("sales.item"), (Predicate("items.kind", "toys", keep=True),)),
    }
    got = rows_of(query(shop, wanted, by=["items.kind"], rollup=True), "kind", "grouping_id")
    assert {k: (r["items"], r.items_x, r.toys) for k, r in got.items()} == {
        ("toys", 0): (1, 1, 1),
        ("food", 0): (1, 1, 0),
        (None, 0): (2, 1, 0),
        (None, 1): (4, 3, 1),
    }
    # Grouped by a column of the fact itself, keys repeat between groups.
    got = rows_of(query(shop, wanted, by=["items.kind", "sales.flag"], rollup=True), "kind", "flag", "grouping_id")
    assert got["toys", None, 1]["items"] == 1 and got[None, None, 3]["items"] == 4
