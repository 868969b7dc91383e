"""Metric patterns.

A metric is a small immutable tree. Leaves aggregate one table; inner nodes
combine metrics or change the filter context they are evaluated in.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, functions as F
from pyspark.sql import types as T

from plumbline.functions.blanks import blank_add, safe_divide
from plumbline.model import Model, ModelError, internal, split_field

_OPS = {
    "eq": lambda c, v: c == v,
    # Blank differs from every value; "eq" with 0, FALSE or "" does not take blank for it.
    "ne": lambda c, v: ~c.eqNullSafe(v),
    "gt": lambda c, v: c > v,
    "ge": lambda c, v: c >= v,
    "lt": lambda c, v: c < v,
    "le": lambda c, v: c <= v,
}


@dataclass(frozen=True)
class Predicate:
    """Typed test on one field. ``keep`` intersects with outer filters on the
    same field; without it the predicate replaces them."""

    field: str
    value: object = None
    op: str = "eq"
    keep: bool = False

    @property
    def fields(self) -> tuple[str, ...]:
        return (self.field,)

    def column(self, model: Model) -> Column:
        col = F.col(internal(self.field))
        if self.op == "is_null":
            return col.isNull()
        if self.op == "not_null":
            return col.isNotNull()
        if self.op == "in":
            return col.isin(*self.value)
        table, name = split_field(self.field)
        source = model.table(table)
        stored_as_bool = isinstance(source.frame.schema[name].dataType, T.BooleanType)
        value = self.value
        if isinstance(value, bool) and not stored_as_bool:
            if name not in source.flags:
                raise ModelError(f"{self.field} is not a boolean column")
            value = int(value)
        elif stored_as_bool and not isinstance(value, bool) and value in (0, 1):
            value = bool(value)
        return _OPS[self.op](col, F.lit(value))


@dataclass(frozen=True)
class Expr:
    """Row expression: ``fn`` receives one Column per field."""

    fields: tuple[str, ...]
    fn: Callable[..., Column] = field(default=lambda c: c)

    def column(self, model: Model | None = None) -> Column:
        return self.fn(*(F.col(internal(f)) for f in self.fields))


def col(name: str) -> Expr:
    return _COLUMNS.setdefault(name, Expr((name,)))


# One object per plain column, so that equal leaves compare equal.
_COLUMNS: dict[str, Expr] = {}


@dataclass(frozen=True)
class Agg:
    """Aggregate over the visible rows of ``table``.

    ``kind`` is one of count, column_count, sum, average, min, max,
    distinct_count, stddev_pop, percentile, only_value. ``where`` narrows the
    rows and never widens the context.
    """

    kind: str
    table: str
    expr: Expr | None = None
    where: tuple[Predicate | Expr, ...] = ()
    p: float | None = None


@dataclass(frozen=True)
class Calculate:
    """Evaluate ``inner`` in a changed context.

    ``lift`` drops grouping on the fields but keeps outer filters;
    ``clear`` drops grouping and filters, and ``clear_except`` does so for
    every field not listed; ``use`` switches on inactive relationships;
    ``treat_as`` is (source field, target field): only target rows whose key
    is visible in the source table count.
    """

    inner: object
    filters: tuple[Predicate, ...] = ()
    lift: tuple[str, ...] = ()
    clear: tuple[str, ...] = ()
    clear_except: tuple[str, ...] | None = None
    use: tuple[str, ...] = ()
    treat_as: tuple[str, str] | None = None


@dataclass(frozen=True)
class Derived:
    """Projection over the values of other metrics."""

    parts: tuple[object, ...]
    fn: Callable[..., Column]


@dataclass(frozen=True)
class Scoped:
    """Metric chosen while planning from the state of the context."""

    choose: Callable[["Scope"], object]


@dataclass(frozen=True)
class OverKeys:
    """Evaluate ``parts`` per ``key`` inside each group, then reduce.

    ``reduce(frame, group_columns, key_column)`` returns one row per group
    with a column named ``value``.
    """

    table: str
    key: str
    parts: tuple[tuple[str, object], ...]
    reduce: Callable
    lift: tuple[str, ...] = ()


@dataclass(frozen=True)
class Rank:
    """Dense descending rank over ``field``; blank when it is not grouped."""

    inner: object
    field: str


@dataclass(frozen=True)
class Running:
    """Running value of an additive leaf from the start of the year."""

    inner: object
    date: str


@dataclass(frozen=True)
class Scope:
    by: tuple[str, ...]
    filters: tuple[Predicate, ...]

    def in_scope(self, name: str) -> bool:
        return name in self.by

    def is_filtered(self, name: str) -> bool:
        return name in self.by or any(name in p.fields for p in self.filters)

    def is_cross_filtered(self, model: Model, name: str) -> bool:
        """Some grouping or filter can reach the table that holds the field."""
        table = split_field(name)[0]
        reach = model.paths(table)
        sources = {split_field(f)[0] for f in (*self.by, *(f for p in self.filters for f in p.fields))}
        return any(s in reach or model.reverse_path(table, s) for s in sources)


# -- the named patterns ------------------------------------------------------


def count(table, where=()):
    return Agg("count", table, None, tuple(where))


def column_count(field):
    return Agg("column_count", split_field(field)[0], col(field))


def _over(kind):
    def build(target, table=None, where=(), p=None):
        expr = col(target) if isinstance(target, str) else target
        return Agg(kind, table or split_field(expr.fields[0])[0], expr, tuple(where), p)

    return build


total = _over("sum")
average = _over("average")
minimum = _over("min")
maximum = _over("max")
distinct_count = _over("distinct_count")
stddev_pop = _over("stddev_pop")
only_value = _over("only_value")


def percentile(target, p, table=None, where=()):
    return _over("percentile")(target, table, where, p)


def median(target, table=None, where=()):
    return percentile(target, 0.5, table, where)


def filtered_count(table, *filters):
    return Calculate(count(table), tuple(filters))


def scaled(metric, divisor):
    if not isinstance(divisor, (int, float)) or isinstance(divisor, bool) or divisor <= 0:
        raise ModelError("divisor must be a positive number")
    return Derived((metric,), lambda m: m / F.lit(float(divisor)))


def add(*metrics):
    if len(metrics) < 2:
        raise ModelError("an addition needs at least two parts")
    return Derived(tuple(metrics), blank_add)


def subtract(left, right):
    """A blank side counts as zero, unless both are blank."""
    return Derived((left, right), lambda a, b: blank_add(a, -b))


def ratio(numerator, denominator):
    return Derived((numerator, denominator), safe_divide)


def switch(selector, cases: dict, default=None):
    """Pick the metric whose label equals the value of ``selector``."""
    labels = tuple(cases)

    def pick(chosen, *values):
        branches = zip(labels, values)
        label, value = next(branches)
        out = F.when(chosen == F.lit(label), value)
        for label, value in branches:
            out = out.when(chosen == F.lit(label), value)
        return out if default is None else out.otherwise(default)

    return Derived((selector, *cases.values()), pick)


def blank():
    return Derived((), lambda: F.lit(None).cast("double"))


def share_of_visible(metric, *fields):
    return ratio(metric, Calculate(metric, lift=fields))


def share_of_all(metric, *fields):
    return ratio(metric, Calculate(metric, clear=fields))


def parent_share(metric, *levels: tuple[str, ...]):
    """Share of the parent; ``levels`` runs from the top to the leaf and each
    level lists the fields that identify a member."""

    def choose(scope: Scope):
        for level in reversed(levels):
            if scope.in_scope(level[-1]):
                return share_of_visible(metric, *level)
        return share_of_visible(metric, *levels[0])

    return Scoped(choose)


def groups_meeting(table, key, parts: dict, test):
    """Count of keys whose part values pass ``test(**columns)``."""

    def reduce_(frame, by, _key):
        hit = test(**{name: F.col(name) for name in parts})
        return frame.groupBy(*by).agg(F.count_if(hit).alias("value"))

    return OverKeys(table, key, tuple(parts.items()), reduce_)


def average_over(table, key, rows, rate):
    """Mean of a per-key rate over the keys that have rows."""

    def reduce_(frame, by, _key):
        return frame.groupBy(*by).agg(F.avg(F.when(F.col("rows") > 0, F.col("rate"))).alias("value"))

    return OverKeys(table, key, (("rows", rows), ("rate", rate)), reduce_)


def top_share(table, key, metric, n, lift=()):
    """Share of the total held by the ``n`` best keys, ties by key ascending."""
    from plumbline.operators.windows import top_n_share

    def reduce_(frame, by, key_name):
        return top_n_share(frame, by, key_name, "v", n)

    return OverKeys(table, key, (("v", metric),), reduce_, tuple(lift))


def year_to_date(metric, date, model: Model | None = None):
    """Calculation item: any metric built from additive leaves, to date."""
    if isinstance(metric, str):
        if model is None:
            raise ModelError("a metric name needs its model")
        return year_to_date(model.metric(metric), date, model)
    if isinstance(metric, Derived):
        return Derived(tuple(year_to_date(p, date, model) for p in metric.parts), metric.fn)
    leaf = metric
    while isinstance(leaf, Calculate):
        leaf = leaf.inner
    if not isinstance(leaf, Agg):
        raise ModelError("year to date needs a metric built from table aggregates")
    if leaf.kind == "average":
        wrap = lambda kind: reduce(
            lambda inner, c: Calculate(inner, c.filters, c.lift, c.clear, c.clear_except, c.use, c.treat_as),
            _chain(metric),
            Agg(kind, leaf.table, leaf.expr, leaf.where),
        )
        return ratio(Running(wrap("sum"), date), Running(wrap("column_count"), date))
    if leaf.kind not in {"count", "column_count", "sum", "min", "max"}:
        raise ModelError(f"{leaf.kind} cannot be accumulated from daily values")
    return Running(metric, date)


def _chain(metric):
    out = []
    while isinstance(metric, Calculate):
        out.append(metric)
        metric = metric.inner
    return reversed(out)
