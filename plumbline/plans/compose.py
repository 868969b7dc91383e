"""Turns metrics plus a filter context into DataFrame plans.

Leaves that look at the same rows (same table, grouping, relationships and
restrictions) share one scan, one set of joins and one aggregation. Facts are
aggregated before they meet, so no value is multiplied by a join between them.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql import types as T

from plumbline import metrics as m
from plumbline.functions.blanks import distinct_with_blank
from plumbline.model import Model, ModelError, internal, outputs, split_field
from plumbline.operators import ordered
from plumbline.operators.attach import attach, merge


Sets = Sequence[tuple[str, ...]]


@dataclass(frozen=True)
class Context:
    by: tuple[str, ...]
    filters: tuple[m.Predicate, ...] = ()
    fixed: tuple[m.Predicate, ...] = ()
    # Filters set by the query itself, as opposed to by a metric.
    outer: frozenset[m.Predicate] = frozenset()
    use: frozenset[str] = frozenset()
    treat_as: frozenset[tuple[str, str]] = frozenset()

    def scope(self) -> m.Scope:
        return m.Scope(self.by, self.filters)

    def without(self, fields: Iterable[str], drop_filters: bool) -> "Context":
        fields = set(fields)
        kept = tuple(p for p in self.filters if not (drop_filters and fields & {*p.fields}))
        return replace(self, by=tuple(b for b in self.by if b not in fields), filters=kept)

    def under(self, change: m.Calculate) -> "Context":
        ctx = self.without(change.lift, drop_filters=False)
        cleared = set(change.clear)
        if change.clear_except is not None:
            fields = {*ctx.by, *(f for p in ctx.filters for f in p.fields)}
            cleared |= fields - set(change.clear_except)
        ctx = ctx.without(cleared, drop_filters=True)
        # A row expression always narrows what is there.
        replaced = {f for p in change.filters if not getattr(p, "keep", True) for f in p.fields}
        ctx = ctx.without(replaced, drop_filters=True)
        treat = {change.treat_as} if change.treat_as else set()
        return replace(
            ctx,
            filters=ctx.filters + change.filters,
            use=ctx.use | set(change.use),
            treat_as=ctx.treat_as | treat,
        )


@dataclass(frozen=True)
class Leaf:
    """One aggregate with everything that decides which rows it sees."""

    agg: m.Agg
    by: tuple[str, ...]
    filters: frozenset[m.Predicate]
    outer: frozenset[m.Predicate]
    use: frozenset[str]
    # Per restricting table: link path back to the fact and its predicates.
    restrict: frozenset
    treat_as: frozenset

    @property
    def mask(self) -> frozenset:
        return self.filters | frozenset(self.agg.where)

    @property
    def group(self):
        """Leaves with an equal group share one plan."""
        rows = (self.agg.table, self.by, self.use, self.restrict, self.treat_as)
        if self.agg.kind == "percentile":
            return (*rows, "percentile")
        return rows


@dataclass(frozen=True)
class Shrink:
    """How to reduce a table before it meets its parents."""

    keys: list[str]
    aggregates: list[Column]
    # Columns of the table and its parents that the last step still needs.
    kept: set[str]
    # Partial counts that only tell whether the key has visible rows.
    ones: list[str]
    # Aggregates that merge the partial results; None if they cannot be merged.
    merges: list[Column] | None


@dataclass
class _Plan:
    model: Model
    leaves: dict[Leaf, str] = field(default_factory=dict)
    nested: dict[tuple, str] = field(default_factory=dict)
    running: set[str] = field(default_factory=set)

    # -- from metric tree to leaf columns -----------------------------------

    def column(self, metric, ctx: Context, names: tuple[str, ...] = ()) -> Column:
        if isinstance(metric, str):
            if metric in names:
                raise ModelError("metric cycle: " + " -> ".join((*names, metric)))
            return self.column(self.model.metric(metric), ctx, (*names, metric))
        if isinstance(metric, m.Agg):
            return F.col(self.leaf(metric, ctx))
        if isinstance(metric, m.Calculate):
            return self.column(metric.inner, ctx.under(metric), names)
        if isinstance(metric, m.Derived):
            return metric.fn(*(self.column(p, ctx, names) for p in metric.parts))
        if isinstance(metric, m.Scoped):
            return self.column(metric.choose(ctx.scope()), ctx, names)
        if isinstance(metric, m.Running):
            # The year is summed from its first day; the date filter then picks rows.
            self.running.add(metric.date)
            whole_years = tuple(p for p in ctx.filters if p.fields != (metric.date,))
            value = self.column(metric.inner, replace(ctx, filters=whole_years), names)
            others = [internal(b) for b in ctx.by if b != metric.date]
            if metric.date not in ctx.by:
                raise ModelError("a running value needs its date in the grouping")
            window = (
                Window.partitionBy(*others, F.year(internal(metric.date)))
                .orderBy(internal(metric.date))
                .rowsBetween(Window.unboundedPreceding, Window.currentRow)
            )
            inner = metric.inner
            while not isinstance(inner, m.Agg):
                inner = self.model.metric(inner) if isinstance(inner, str) else inner.inner
            merge_days = {"min": F.min, "max": F.max}.get(inner.kind, F.sum)
            return merge_days(value).over(window)
        if isinstance(metric, m.OverKeys):
            ctx = ctx.without(metric.lift, drop_filters=False)
            reach = self.model.paths(metric.table, ctx.use)
            by = tuple(b for b in ctx.by if split_field(b)[0] in reach)
            return F.col(self.nested.setdefault((metric, replace(ctx, by=by)), f"k{len(self.nested)}"))
        if isinstance(metric, m.Rank):
            raise ModelError("a rank can only be asked for at the top of a query")
        raise ModelError(f"not a metric: {metric!r}")

    def leaf(self, agg: m.Agg, ctx: Context) -> str:
        reach = self.model.paths(agg.table, ctx.use)
        by = tuple(
            b for b in ctx.by
            if split_field(b)[0] in reach
            or self.model.reverse_path(agg.table, split_field(b)[0], ctx.use)
        )
        filters, outer, back = set(), set(), {}
        for p in (*ctx.filters, *ctx.fixed):
            tables = _tables(p)
            if tables <= set(reach):
                (outer if p in ctx.outer or p in ctx.fixed else filters).add(p)
                continue
            if len(tables) > 1:  # an expression acts where all its tables are visible
                continue
            (table,) = tables
            path = self.model.reverse_path(agg.table, table, ctx.use)
            if path:
                back.setdefault((table, path), set()).add(p)
        restrict = frozenset((table, path, frozenset(ps)) for (table, path), ps in back.items())
        treat = frozenset((pair, self._visible(pair, ctx)) for pair in ctx.treat_as)
        leaf = Leaf(agg, by, frozenset(filters), frozenset(outer), ctx.use, restrict, treat)
        return self.leaves.setdefault(leaf, f"m{len(self.leaves)}")

    def _visible(self, pair, ctx: Context) -> frozenset[m.Predicate]:
        reach = self.model.paths(split_field(pair[0])[0], ctx.use)
        return frozenset(
            p for p in (*ctx.filters, *ctx.fixed) if _tables(p) <= set(reach)
        )

    # -- rows ---------------------------------------------------------------

    def rows(
        self,
        table: str,
        fields: Iterable[str],
        predicates,
        use=frozenset(),
        restrict=(),
        treat_as=(),
        shrink: Shrink | None = None,
    ) -> DataFrame:
        """The table joined to just the parents that the fields live in.

        With ``shrink`` the visible rows are reduced before the first parent is
        joined, and again before each later parent that is large.
        """
        predicates = sorted(predicates, key=_order)
        wanted: dict[str, set[str]] = {table: set()}
        links = []
        paths = self.model.paths(table, use)
        targets = [pair[1] for pair, _ in treat_as]
        targets += [f"{table}.{c}" for _, path, _ in restrict for _, c in path[-1].on]
        children: dict[tuple, list[str]] = {}
        for name in (*fields, *targets, *(f for p in predicates for f in p.fields)):
            owner, column = split_field(name)
            if owner not in paths:
                path = self.model.reverse_path(table, owner, use)
                if not path:
                    raise ModelError(f"{name} cannot be reached from {table}")
                children.setdefault((owner, path), []).append(name)
                wanted[table] |= {b for _, b in path[-1].on}
                continue
            wanted.setdefault(owner, set()).add(column)
            for rel in paths[owner]:
                if rel not in links:
                    links.append(rel)
                for many, one in rel.on:
                    wanted.setdefault(rel.many, set()).add(many)
                    wanted.setdefault(rel.one, set()).add(one)
        if any(split_field(t)[0] != table for t in targets):
            raise ModelError(f"visible keys can only be applied to columns of {table}")
        own = [p for p in predicates if _tables(p) <= {table}]
        frame = self._project(table, wanted[table])
        if own:
            frame = frame.where(reduce(and_, [p.column(self.model) for p in own]))
        for other, path, tests in restrict:
            last = path[-1]
            keys = [f"{last.many}.{a}" for a, _ in last.on]
            frame = self._keep_visible(
                frame, other, keys, [f"{table}.{b}" for _, b in last.on], tests, use
            )
        for (owner, path), names in children.items():
            frame = self._spread(frame, table, owner, path, names, restrict, use)
        for (source, target), tests in treat_as:
            frame = self._keep_visible(frame, split_field(source)[0], [source], [target], tests, use)
        if shrink:
            frame = frame.groupBy(*shrink.keys).agg(*shrink.aggregates)
            for name in shrink.ones:
                frame = frame.withColumn(name, (F.col(name) > 0).cast("bigint"))
        links = sorted(links, key=lambda r: len(paths[r.one]))
        rest = [p for p in predicates if p not in own]
        kept = {internal(f) for p in rest for f in p.fields} | (shrink.kept if shrink else set())
        for i, rel in enumerate(links):
            met = {table, *(r.one for r in links[:i])}
            only_way = [r for r in links[i:] if r.many in met] == [rel]
            if shrink and shrink.merges and i and only_way and self.model.table(rel.one).large:
                keys = [f"{rel.many}__{a}" for a, _ in rel.on]
                keys += [c for c in frame.columns if c in kept and c not in keys]
                frame = frame.groupBy(*keys).agg(*shrink.merges)
            test = reduce(
                and_,
                [F.col(f"{rel.many}__{a}") == F.col(f"{rel.one}__{b}") for a, b in rel.on],
            )
            frame = frame.join(self._project(rel.one, wanted[rel.one]), test, "left")
        if rest:
            frame = frame.where(reduce(and_, [p.column(self.model) for p in rest]))
        return frame

    def _spread(self, frame, table, owner, path, names, restrict, use) -> DataFrame:
        """Rows once per member of a child column they are linked to."""
        on = path[-1]
        tests = {p for other, way, ps in restrict if (other, way) == (owner, path) for p in ps}
        keys = [f"{on.many}.{a}" for a, _ in on.on]
        linked = self.rows(owner, [*names, *keys], tests, use)
        linked = linked.select(
            *dict.fromkeys(internal(n) for n in names),
            *(F.col(internal(k)).alias(f"__c{i}") for i, k in enumerate(keys)),
        ).distinct()
        test = reduce(
            and_, [F.col(f"{table}__{b}") == F.col(f"__c{i}") for i, (_, b) in enumerate(on.on)]
        )
        return frame.join(linked, test, "inner")

    def _keep_visible(self, frame, table, sources, targets, tests, use) -> DataFrame:
        names = [f"__s{i}" for i in range(len(sources))]
        keys = (
            self.rows(table, sources, tests, use)
            .select(*(F.col(internal(s)).alias(n) for s, n in zip(sources, names)))
            .distinct()
        )
        test = reduce(and_, [F.col(internal(t)) == F.col(n) for t, n in zip(targets, names)])
        return frame.join(keys, test, "left_semi")

    def _project(self, table: str, columns: set[str]) -> DataFrame:
        frame = self.model.table(table).frame
        if not columns:
            # Rows are counted and nothing else, so the scan reads no column.
            return frame.select()
        return frame.select(*(F.col(c).alias(f"{table}__{c}") for c in sorted(columns)))

    # -- aggregation --------------------------------------------------------

    def aggregate(self, leaves: Sequence[Leaf], sets: Sets | None) -> DataFrame:
        first = leaves[0]
        shared = frozenset.intersection(*(leaf.outer for leaf in leaves))
        if not first.by or first.agg.kind == "percentile":
            # Nobody asks for coordinates that only the filter leaves empty.
            shared = frozenset.intersection(*(leaf.outer | leaf.mask for leaf in leaves))
        fields = list(first.by)
        for leaf in leaves:
            fields += [f for p in (leaf.outer | leaf.mask) for f in p.fields]
            fields += leaf.agg.expr.fields if leaf.agg.expr else ()
        keys = [internal(b) for b in first.by]
        sources = (first.use, first.restrict, first.treat_as)
        if first.agg.kind == "percentile":
            frame = self.rows(first.agg.table, fields, shared, *sources)
            return self._percentiles(frame, leaves, shared, sets)

        masks = {leaf: (leaf.outer | leaf.mask) - shared for leaf in leaves}
        shrink = self._shrink(leaves, masks, fields, sets)
        if shrink is None:
            frame = self.rows(first.agg.table, fields, shared, *sources)
            outs = [
                self._whole(leaf.agg, masks[leaf]).alias(self.leaves[leaf]) for leaf in leaves
            ]
        else:
            shrink, later, ones = shrink
            frame = self.rows(first.agg.table, fields, shared, *sources, shrink=shrink)
            outs = [
                self._merged(ones.get(leaf, leaf.agg), self.leaves[leaf], later[leaf]).alias(
                    self.leaves[leaf]
                )
                for leaf in leaves
            ]
        if sets:
            groupings = [[internal(b) for b in one] for one in sets]
            return frame.groupingSets(groupings, *keys).agg(
                F.grouping_id().alias("grouping_id"), *outs
            )
        return frame.groupBy(*keys).agg(*outs)

    def _percentiles(self, frame, leaves, shared, sets: Sets | None) -> DataFrame:
        """All percentiles of one set of rows: the values are stacked, so that
        several expressions take one scan and one ordering."""
        keys = [internal(b) for b in leaves[0].by]
        inputs: dict[tuple, int] = {}
        for leaf in leaves:
            inputs.setdefault((leaf.agg.expr, (leaf.outer | leaf.mask) - shared), len(inputs))
        points = {self.leaves[leaf]: leaf.agg.p for leaf in leaves}
        if len(inputs) == 1:
            # A mask that all leaves have is shared and already applied.
            (expr, _), = inputs
            rows = frame.select(*keys, expr.column(self.model).alias("__value"))
            if sets:
                rows = _expand(rows, leaves[0].by, sets)
                keys = [*keys, "grouping_id"]
            return ordered.percentiles(rows, keys, "__value", points)
        values = []
        for (expr, mask), which in inputs.items():
            value, seen = expr.column(self.model), self._seen(mask)
            value = value if seen is None else F.when(seen, value)
            values.append(F.struct(F.lit(which).alias("__which"), value.alias("__value")))
        rows = frame.select(*keys, F.explode(F.array(*values)).alias("__in"))
        rows = rows.select(*keys, "__in.*").where(F.col("__value").isNotNull())
        if sets:
            rows = _expand(rows, leaves[0].by, sets)
            keys = [*keys, "grouping_id"]
        found = ordered.percentiles(rows, [*keys, "__which"], "__value", points)
        outs = []
        for leaf in leaves:
            name, which = self.leaves[leaf], inputs[leaf.agg.expr, (leaf.outer | leaf.mask) - shared]
            outs.append(F.max(F.when(F.col("__which") == which, F.col(name))).alias(name))
        return found.groupBy(*keys).agg(*outs)

    def _shrink(self, leaves, masks, fields, sets):
        """Reduce the fact to one row per parent key before joining parents.

        The join then moves partial results instead of fact rows, and a parent
        that owns a large part of the fact is a few rows. Possible when the
        values come from the fact alone, all parents hang on one key, and the
        aggregates can be merged or the key itself is part of the grouping.
        """
        first = leaves[0]
        fact = first.agg.table
        paths = self.model.paths(fact, first.use)
        parents = {split_field(f)[0] for f in fields} - {fact}
        hops = {paths[t][0] if t in paths else None for t in parents}
        if len(hops) != 1 or None in hops or not self.model.table(next(iter(hops)).one).large:
            return None
        parent_keys = [f"{fact}__{a}" for a, _ in next(iter(hops)).on]
        own_by = [internal(b) for b in first.by if split_field(b)[0] == fact]
        own_keys = list(dict.fromkeys([*own_by, *parent_keys]))
        one_row_each = not sets and set(parent_keys) <= set(own_by)
        for leaf in leaves:
            values = {split_field(f)[0] for f in leaf.agg.expr.fields} if leaf.agg.expr else set()
            if values - {fact} or any(len(_tables(p)) > 1 for p in masks[leaf]):
                return None
            on_fact = all(_tables(p) <= {fact} for p in masks[leaf])
            if leaf.agg.kind in _MERGEABLE or one_row_each and on_fact:
                continue
            if leaf.agg.kind != "distinct_count" or not self._counts_key(leaf.agg, own_keys):
                return None
        partials, merges, later, ones = [], [], {}, {}
        for leaf in leaves:
            here = frozenset(p for p in masks[leaf] if _tables(p) <= {fact})
            later[leaf] = masks[leaf] - here
            agg, name = leaf.agg, self.leaves[leaf]
            if agg.kind == "distinct_count" and self._counts_key(agg, own_keys):
                agg = ones[leaf] = replace(agg, kind="count")
            for suffix, kind in _PARTS.get(agg.kind, {"": agg.kind}).items():
                partials.append(self._whole(replace(agg, kind=kind), here).alias(name + suffix))
                merges.append(_MERGES.get(kind, F.sum)(name + suffix).alias(name + suffix))
        # Masks on parents still need their columns after the reduction.
        kept = {internal(f) for mask in later.values() for p in mask for f in p.fields}
        kept |= {internal(b) for b in first.by}
        names = [self.leaves[leaf] for leaf in ones]
        shrink = Shrink(own_keys, partials, kept, names, None if one_row_each else merges)
        return shrink, later, ones

    @staticmethod
    def _counts_key(agg: m.Agg, own_keys: Sequence[str]) -> bool:
        """The distinct values asked for are the rows of the reduced fact."""
        plain = agg.expr is m.col(agg.expr.fields[0])
        return plain and own_keys == [internal(agg.expr.fields[0])]

    def _seen(self, mask) -> Column | None:
        tests = [p.column(self.model) for p in sorted(mask, key=_order)]
        return reduce(and_, tests) if tests else None

    def _merged(self, agg: m.Agg, name: str, mask: frozenset) -> Column:
        seen = self._seen(mask)

        def part(suffix="", merge=F.sum):
            column = F.col(name + suffix)
            return merge(column if seen is None else F.when(seen, column))

        if agg.kind in ("count", "column_count"):
            return F.coalesce(part(), F.lit(0))
        if agg.kind == "average":
            return F.try_divide(part().cast("double"), part("__n").cast("double"))
        if agg.kind == "only_value":
            low = part(merge=F.min)
            same = (part("__blanks") == 0) & (low == part("__high", F.max))
            return F.when(same, low)
        # A kind that cannot be merged is here as the only row of its group.
        return part(merge=F.sum if agg.kind == "sum" else _MERGES.get(agg.kind, F.max))

    def _whole(self, agg: m.Agg, mask: frozenset) -> Column:
        seen = self._seen(mask)
        value = agg.expr.column(self.model) if agg.expr else None
        if agg.kind == "count":
            return F.count("*") if seen is None else F.count_if(seen)
        if agg.kind == "distinct_count":
            return distinct_with_blank(value, seen)
        visible = value if seen is None else F.when(seen, value)
        if agg.kind == "stddev_pop":
            size = F.count("*") if seen is None else F.count_if(seen)
            return F.when(size >= 2, F.stddev_pop(visible))
        if agg.kind == "blanks":
            return F.count_if(value.isNull() if seen is None else seen & value.isNull())
        if agg.kind == "only_value":
            low = F.min(visible)
            blanks = self._whole(replace(agg, kind="blanks"), mask)
            return F.when((blanks == 0) & (low == F.max(visible)), low)
        plain = {
            "column_count": F.count,
            "sum": F.sum,
            "average": F.avg,
            "min": F.min,
            "max": F.max,
        }
        return plain[agg.kind](visible)

    def over_keys(self, node: m.OverKeys, ctx: Context, name: str) -> DataFrame:
        """Per-key values first, then one row per group."""
        inner = replace(ctx, by=(*(b for b in ctx.by if b != node.key), node.key))
        frame = self.__class__(self.model).run(dict(node.parts), inner)
        keys = [internal(b) for b in ctx.by]
        out = node.reduce(frame, keys, internal(node.key))
        return out.withColumnRenamed("value", name)

    # -- whole query --------------------------------------------------------

    def run(self, named: Mapping[str, object], ctx: Context, sets: Sets | None = None) -> DataFrame:
        outs = [self.column(metric, ctx).alias(name) for name, metric in named.items()]
        groups: dict[tuple, list[Leaf]] = {}
        for leaf in self.leaves:
            groups.setdefault(leaf.group, []).append(leaf)
        pieces = [(leaves[0].by, self.aggregate(leaves, sets)) for leaves in groups.values()]
        pieces += [(c.by, self.over_keys(node, c, name)) for (node, c), name in self.nested.items()]

        keys = [internal(b) for b in ctx.by] + (["grouping_id"] if sets else [])
        whole = [frame for by, frame in pieces if by == ctx.by]
        if not whole and ctx.by:
            whole = [self.coordinates(ctx)]
        frame = whole[0] if whole else self.one_row()
        for other in whole[1:]:
            frame = merge(frame, other, keys)
        for by, other in pieces:
            if by != ctx.by:
                frame = attach(frame, other, [internal(b) for b in by])
        counts = [n for leaf, n in self.leaves.items() if leaf.agg.kind in _COUNTS]
        if counts and len(pieces) > 1:
            frame = frame.fillna(0, subset=counts)
        return frame.select(*keys, *outs)

    def coordinates(self, ctx: Context) -> DataFrame:
        """Visible members when every metric ignores part of the grouping."""
        tables = dict.fromkeys([*(leaf.agg.table for leaf in self.leaves), *self.model.tables])
        for table in tables:
            reach = self.model.paths(table, ctx.use)
            if all(split_field(b)[0] in reach for b in ctx.by):
                tests = [p for p in (*ctx.filters, *ctx.fixed) if _tables(p) <= set(reach)]
                return self.rows(table, ctx.by, tests, ctx.use).select(*map(internal, ctx.by)).distinct()
        raise ModelError("no table reaches all grouping columns")

    def one_row(self) -> DataFrame:
        any_table = next(iter(self.model.tables.values())).frame
        return any_table.sparkSession.range(1).select()


# Kinds whose values over parts of a group give the value over the group.
_MERGEABLE = {"count", "column_count", "sum", "average", "min", "max", "only_value"}
# What to keep per part of a group, where it is not the value itself.
_PARTS = {
    "average": {"": "sum", "__n": "column_count"},
    "only_value": {"": "min", "__high": "max", "__blanks": "blanks"},
}
# How parts are merged, where it is not by adding them up.
_MERGES = {"min": F.min, "max": F.max}
_COUNTS = {"count", "column_count", "distinct_count"}


def _tables(p) -> set[str]:
    return {split_field(f)[0] for f in p.fields}


def _order(p) -> tuple:
    """Fixed order of predicates, so that equal contexts give equal plans."""
    if isinstance(p, m.Predicate):
        return (p.field, p.op, repr(p.value), p.keep)
    return (",".join(p.fields), "", "", False)


def _needs_levels(model: Model, metric) -> bool:
    """Metrics whose value cannot come out of one rollup aggregation."""
    if isinstance(metric, str):
        return _needs_levels(model, model.metric(metric))
    if isinstance(metric, m.Agg):
        return False
    if isinstance(metric, m.Derived):
        return any(_needs_levels(model, p) for p in metric.parts)
    if isinstance(metric, m.Calculate):
        changes = (
            metric.lift or metric.clear or metric.clear_except is not None
            or any(not p.keep for p in metric.filters)
        )
        return bool(changes) or _needs_levels(model, metric.inner)
    return True


def joined_rows(
    model: Model, table: str, fields: Sequence[str], filters: Sequence[m.Predicate] = ()
) -> DataFrame:
    """Rows of a table with fields of the tables it points to."""
    rows = _Plan(model).rows(table, fields, filters)
    names = outputs(fields)
    return rows.select(*(F.col(internal(f)).alias(names[f]) for f in fields))


def query(
    model: Model,
    metrics: Sequence[str] | Mapping[str, object],
    by: Sequence[str] = (),
    filters: Sequence[m.Predicate] = (),
    rollup: bool = False,
    sets: Sets | None = None,
    role: str | None = None,
    zero_as_blank: bool = False,
) -> DataFrame:
    """Compute metrics per member of ``by`` under ``filters``.

    With ``rollup`` the subtotals of every prefix of ``by`` are added; ``sets``
    lists other groupings. Rows are told apart by ``grouping_id``. ``role``
    applies the row filters of a role, which no metric can replace.
    """
    named = dict(metrics) if isinstance(metrics, Mapping) else {n: n for n in metrics}
    ctx = Context(
        by=tuple(by),
        filters=tuple(filters),
        fixed=tuple(model.roles[role]) if role else (),
        outer=frozenset(filters),
    )
    if rollup:
        if not by:
            raise ModelError("a rollup needs grouping columns")
        sets = [ctx.by[:depth] for depth in range(len(ctx.by), -1, -1)]
    ranks = {n: r for n, r in named.items() if isinstance(_resolved(model, r), m.Rank)}
    values = {n: v for n, v in named.items() if n not in ranks}
    values |= {f"__rank_{n}": _resolved(model, r).inner for n, r in ranks.items()}
    if sets:
        frame = _grouping_sets(model, values, ctx, tuple(map(tuple, sets)), ranks)
    else:
        plan = _Plan(model)
        frame = plan.run(values, ctx)
        for p in ctx.filters:
            if len(p.fields) == 1 and p.fields[0] in plan.running:
                frame = frame.where(p.column(model))
        frame = _ranked(model, frame, ctx, ranks)
    counts = [n for n, v in named.items() if _is_count(model, v)]
    return frame.select(
        *(F.col(internal(b)).alias(name) for b, name in outputs(by).items()),
        *(["grouping_id"] if sets else []),
        *(
            (F.nullif(F.col(n), F.lit(0)) if zero_as_blank and n in counts else F.col(n)).alias(n)
            for n in named
        ),
    )


def _resolved(model: Model, metric):
    return model.metric(metric) if isinstance(metric, str) else metric


def _is_count(model: Model, metric) -> bool:
    metric = _resolved(model, metric)
    while isinstance(metric, m.Calculate):
        metric = _resolved(model, metric.inner)
    return isinstance(metric, m.Agg) and metric.kind in _COUNTS


def _ranked(model, frame, ctx, ranks) -> DataFrame:
    for name, metric in ranks.items():
        field_ = _resolved(model, metric).field
        if field_ not in ctx.by:
            frame = frame.withColumn(name, F.lit(None).cast("bigint"))
            continue
        keys = [internal(b) for b in ctx.by if b != field_]
        frame = ordered.dense_rank(frame, keys, f"__rank_{name}", name)
    return frame.drop(*(f"__rank_{n}" for n in ranks))


def grouping_id(by: Sequence[str], grouping: Sequence[str]) -> int:
    """Bit per column of ``by``, first column highest, set when left out."""
    return sum(
        2 ** (len(by) - 1 - i) for i, name in enumerate(by) if name not in grouping
    )


def _expand(frame: DataFrame, by: Sequence[str], sets: Sets) -> DataFrame:
    """Every row once per grouping, left-out columns blank."""
    copies = [
        F.struct(
            *(F.when(F.lit(b in one), F.col(internal(b))).alias(internal(b)) for b in by),
            F.lit(grouping_id(by, one)).cast("bigint").alias("grouping_id"),
        )
        for one in sets
    ]
    others = [c for c in frame.columns if c not in map(internal, by)]
    spread = frame.select(*others, F.explode(F.array(*copies)).alias("__copy"))
    return spread.select("__copy.*", *others)


def _one_pass(model, values, ctx: Context) -> dict[str, object]:
    """Metrics that a single aggregation over grouping sets can produce."""

    def fits(metric) -> bool:
        if _needs_levels(model, metric):
            return False
        probe = _Plan(model)
        probe.column(metric, ctx)
        return all(leaf.by == ctx.by for leaf in probe.leaves)

    return {n: v for n, v in values.items() if not n.startswith("__rank_") and fits(v)}


def _grouping_sets(model, values, ctx, sets: Sets, ranks) -> DataFrame:
    keys = [internal(b) for b in ctx.by]
    single = _one_pass(model, values, ctx)
    levelled = {n: v for n, v in values.items() if n not in single}
    frames = []
    if single:
        frames.append(_Plan(model).run(single, ctx, sets))
    if levelled:
        types = {
            b: model.table(split_field(b)[0]).frame.schema[split_field(b)[1]].dataType
            for b in ctx.by
        }
        levels = []
        for one in sets:
            level = replace(ctx, by=one)
            frame = _ranked(model, _Plan(model).run(levelled, level), level, ranks)
            levels.append(
                frame.select(
                    *(
                        F.col(internal(b)) if b in one else F.lit(None).cast(types[b]).alias(internal(b))
                        for b in ctx.by
                    ),
                    F.lit(grouping_id(ctx.by, one)).cast("bigint").alias("grouping_id"),
                    *(c for c in frame.columns if c not in keys),
                )
            )
        frames.append(reduce(DataFrame.unionByName, levels))
    frame = frames[0]
    for other in frames[1:]:
        frame = merge(frame, other, [*keys, "grouping_id"])
    return frame


def _long_value(frame: DataFrame, metric: str) -> Column:
    kind = frame.schema[metric].dataType
    exact = isinstance(kind, T.IntegralType) or (isinstance(kind, T.DecimalType) and kind.scale == 0)
    whole = F.col(metric) if exact else F.lit(None)
    return F.struct(
        F.lit(metric).alias("metric"),
        F.col(metric).cast("double").alias("value"),
        whole.cast("decimal(38,0)").alias("whole"),
    )


def metric_slices(
    model: Model,
    metrics: Sequence[str],
    slices: Mapping[str, Sequence[Sequence[str]]],
    required: Mapping[str, Sequence[str]] | None = None,
) -> DataFrame:
    """Every metric over every slice in long form.

    A slice is a list of groupings. ``coordinates`` is a JSON object with the
    fields of the grouping in name order; ``grouping`` is its position in the
    slice. All groupings are computed together as grouping sets, and
    ``required`` narrows the slices kept per metric. ``whole`` repeats the value
    exactly where the metric is an integer, and is blank elsewhere.
    """
    uses: dict[tuple[str, ...], list[tuple[str, int]]] = {}
    for name, groupings in slices.items():
        for position, grouping in enumerate(groupings):
            uses.setdefault(tuple(sorted(grouping)), []).append((name, position))
    by = tuple(sorted({f for grouping in uses for f in grouping}))
    if by:
        frame = query(model, metrics, by=by, sets=list(uses))
    else:
        frame = query(model, metrics).withColumn("grouping_id", F.lit(0))
    text, places = F, F
    for grouping, names in uses.items():
        here = F.col("grouping_id") == grouping_id(by, grouping)
        names_of = outputs(by)
        pairs = [F.col(names_of[f]).alias(f) for f in grouping]
        json = F.to_json(F.struct(*pairs), {"ignoreNullFields": "false"}) if pairs else F.lit("{}")
        spots = F.array(
            *(F.struct(F.lit(n).alias("slice"), F.lit(p).alias("grouping")) for n, p in names)
        )
        text, places = text.when(here, json), places.when(here, spots)
    long = frame.select(
        text.alias("coordinates"),
        F.explode(places).alias("spot"),
        F.array(*(_long_value(frame, n) for n in metrics)).alias("cells"),
    ).select("spot.slice", "spot.grouping", "coordinates", F.explode("cells").alias("cell"))
    long = long.select("slice", "grouping", "coordinates", "cell.*")
    if required is not None:
        wanted = [
            (F.col("metric") == n) & F.col("slice").isin(*required.get(n, ())) for n in metrics
        ]
        long = long.where(reduce(lambda a, b: a | b, wanted))
    return long
