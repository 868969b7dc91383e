"""Binding of the supplied star tables to a model, with its metric corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from plumbline import metrics as m
from plumbline.model import Model, Relationship, Table
from plumbline.metrics import Calculate, Expr, Predicate
from plumbline.sources.tables import read_table

KEYS = {
    "region": ("r_regionkey",),
    "nation": ("n_nationkey",),
    "customer": ("c_custkey",),
    "supplier": ("s_suppkey",),
    "part": ("p_partkey",),
    "orders": ("o_orderkey",),
    "lineitem": (),
}

RELATIONSHIPS = (
    Relationship("lineitem_orders", "lineitem", "orders", (("l_orderkey", "o_orderkey"),)),
    Relationship("lineitem_part", "lineitem", "part", (("l_partkey", "p_partkey"),)),
    Relationship("lineitem_supplier", "lineitem", "supplier", (("l_suppkey", "s_suppkey"),)),
    Relationship("orders_customer", "orders", "customer", (("o_custkey", "c_custkey"),), both=True),
    Relationship("customer_nation", "customer", "nation", (("c_nationkey", "n_nationkey"),)),
    Relationship("nation_region", "nation", "region", (("n_regionkey", "r_regionkey"),)),
    Relationship(
        "supplier_nation", "supplier", "nation", (("s_nationkey", "n_nationkey"),), active=False
    ),
)


def derive_results(orders: DataFrame) -> DataFrame:
    """Orders with the parts, flags and day that the metrics work on."""
    price = F.col("o_totalprice")
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    return orders.withColumns(
        {
            "day": F.col("o_orderdate").cast("date"),
            "year": F.year("o_orderdate"),
            "part_a": F.floor(price * 0.1),
            "part_b": F.when(priority != "5-LOW", F.floor(price * 0.5)),
            "part_c": F.floor(price * 0.3),
            "part_d": F.when(status != "P", F.floor(price * 0.04)),
            "part_e": F.floor(price * 0.06),
            "closed_status": F.nullif(status, F.lit("P")),
            "is_closed": status != "O",
            "is_valid": status == "F",
            # Stored as 0 / 1 on purpose.
            "is_review": (priority == "1-URGENT").cast("int"),
        }
    )


def star(spark: SparkSession, path: str) -> Model:
    frames = {name: read_table(spark, path, name) for name in KEYS}
    frames["orders"] = derive_results(frames["orders"])
    frames["customer"] = frames["customer"].withColumn(
        "is_pro", F.col("c_mktsegment") == "BUILDING"
    )
    flags = {"orders": frozenset({"is_review"})}
    tables = [
        Table(n, f, KEYS[n], flags.get(n, frozenset()), large=n not in ("nation", "region"))
        for n, f in frames.items()
    ]
    roles = {"asia": (Predicate("region.r_name", "ASIA"),)}
    return Model(tables, RELATIONSHIPS, METRICS, roles)


VALID = Predicate("orders.is_valid", True, keep=True)
REVIEW = Predicate("orders.is_review", True, keep=True)
CLOSED = Predicate("orders.is_closed", True, keep=True)
PRO = Predicate("customer.is_pro", True, keep=True)

COMPLETE = (
    Predicate("orders.is_valid", True),
    Predicate("orders.part_a", op="not_null"),
    Predicate("orders.part_b", op="not_null"),
    Predicate("orders.part_c", op="not_null"),
)
ABC = Expr(("orders.part_a", "orders.part_b", "orders.part_c"), lambda a, b, c: a + b + c)
TIMED = (Predicate("orders.part_b", 0, op="gt"),)
MISMATCH = Expr(
    ("lineitem.l_shipdate", "orders.o_orderdate"),
    # An orphan has no order year, which differs from any year.
    lambda ship, ordered: ~F.year(ship).eqNullSafe(F.year(ordered)),
)
EVENT = ("customer.c_custkey", "customer.c_name")


def _whole_split_only(metric):
    """Blank as soon as the split leg is filtered or grouped."""
    return m.Scoped(lambda s: m.blank() if s.is_filtered("lineitem.l_linenumber") else metric)


# The corpus, in order. Numbers that count negative controls start at 41.
METRICS = {
    "result_rows": m.count("orders"),
    "split_rows": m.count("lineitem"),
    "split_quantity": m.total("lineitem.l_quantity"),
    "results_with_splits": m.distinct_count("lineitem.l_orderkey"),
    "events": m.distinct_count("orders.o_custkey"),
    "a_total": m.total("orders.part_a"),
    "b_total": m.total("orders.part_b"),
    "c_total": m.total("orders.part_c"),
    "transition_total": m.add(m.total("orders.part_d"), m.total("orders.part_e")),
    "recorded_total": m.add("a_total", "b_total", "c_total", "transition_total"),
    "closed_rows": m.filtered_count("orders", CLOSED),
    "valid_rows": m.filtered_count("orders", VALID),
    "review_rows": m.filtered_count("orders", REVIEW),
    "reviewed_valid_rows": m.filtered_count("orders", VALID, REVIEW),
    "pro_closed_rows": Calculate("closed_rows", (PRO,)),
    "closed_rate": m.ratio("closed_rows", "result_rows"),
    "valid_rate": m.ratio("valid_rows", "result_rows"),
    "review_rate": m.ratio("reviewed_valid_rows", "valid_rows"),
    "split_coverage": m.ratio("results_with_splits", "result_rows"),
    "b_average": m.average("orders.part_b"),
    "b_min": m.minimum("orders.part_b"),
    "b_max": m.maximum("orders.part_b"),
    "abc_median": m.median(ABC, where=COMPLETE),
    "abc_p90": m.percentile(ABC, 0.9, where=COMPLETE),
    "abc_stddev": m.stddev_pop(ABC, where=COMPLETE),
    "c_hours": m.scaled("c_total", 3600),
    "b_hours": m.scaled("b_total", 3600),
    "a_hours": m.scaled("a_total", 3600),
    "nominal_total": m.total("customer.c_acctbal", table="orders", where=TIMED),
    "weighted_speed": m.ratio(
        "nominal_total", m.scaled(m.total("orders.part_b", where=TIMED), 3600)
    ),
    "priority_share": m.share_of_visible("valid_rows", "orders.o_orderpriority"),
    "priority_rank": m.Rank("valid_rows", "orders.o_orderpriority"),
    "event_mean_rate": m.average_over("orders", "orders.o_custkey", "result_rows", "valid_rate"),
    "geo_share": m.parent_share(
        "valid_rows", ("region.r_name",), ("nation.n_name",), EVENT
    ),
    "selected_part": m.switch(
        m.only_value("lineitem.l_returnflag"),
        {"A": "a_total", "N": "b_total", "R": "c_total"},
    ),
    "top3_share": m.top_share("orders", "customer.c_custkey", "valid_rows", 3, lift=EVENT),
    "complete_splits": _whole_split_only(
        m.groups_meeting(
            "lineitem",
            "lineitem.l_orderkey",
            {"rows": "split_rows", "legs": m.distinct_count("lineitem.l_linenumber")},
            lambda rows, legs: (rows == 5) & (legs == 5),
        )
    ),
    "complete_coverage": m.ratio("complete_splits", "result_rows"),
    "mismatch_rows": m.count("lineitem", where=(MISMATCH,)),
    "split_delta": _whole_split_only(
        m.subtract(
            "split_quantity",
            Calculate("recorded_total", treat_as=("lineitem.l_orderkey", "orders.o_orderkey")),
        )
    ),
    "nc_b_hours_by_60": m.scaled("b_total", 60),
    "nc_event_id_total": m.total("orders.o_custkey"),
    "nc_discount_total": m.total("lineitem.l_discount"),
    "nc_review_rate": m.ratio("review_rows", "valid_rows"),
    "nc_valid_rate": "valid_rate",
    "nc_fanned_b": m.total("orders.part_b", table="lineitem"),
}

# The smaller canonical set: plain filters, rates over valid rows, medians.
_FLAGGED = {
    "finishers": Predicate("orders.is_closed", True),
    "valid_finishers": Predicate("orders.is_valid", True),
    "any_review_rows": Predicate("orders.is_review", True),
    "urgent_rows": Predicate("orders.o_orderpriority", "1-URGENT"),
    "low_rows": Predicate("orders.o_orderpriority", "5-LOW"),
}
CANONICAL = {
    "all_rows": m.count("orders"),
    **{name: m.filtered_count("orders", test) for name, test in _FLAGGED.items()},
    "review_flag_rate": m.ratio("any_review_rows", "valid_finishers"),
    "urgent_rate": m.ratio("urgent_rows", "valid_finishers"),
    "low_rate": m.ratio("low_rows", "valid_finishers"),
    "median_price": m.median("orders.o_totalprice"),
    "median_a": m.median("orders.part_a"),
    "median_b": m.median("orders.part_b"),
    "median_c": m.median("orders.part_c"),
}
METRICS |= CANONICAL
