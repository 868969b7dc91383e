"""Logical model: tables, relationships, and the registry of metrics.

A model only describes data; nothing is read until a query is planned.
Fields are written ``"table.column"`` everywhere.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame


class ModelError(ValueError):
    """The model or a query over it is not well defined."""


def split_field(name: str) -> tuple[str, str]:
    table, _, column = name.partition(".")
    if not table or not column:
        raise ModelError(f"field must be written table.column: {name!r}")
    return table, column


def internal(name: str) -> str:
    """Column name of a field inside a joined frame."""
    table, column = split_field(name)
    return f"{table}__{column}"


def outputs(names: Iterable[str]) -> dict[str, str]:
    """Column names of fields in a query result: the column's own name, with the
    table in front where two tables' columns share one."""
    names = list(dict.fromkeys(names))
    own = [split_field(n)[1] for n in names]
    return {n: internal(n) if own.count(c) > 1 else c for n, c in zip(names, own, strict=True)}


@dataclass(frozen=True)
class Table:
    name: str
    frame: DataFrame = field(compare=False, repr=False)
    key: tuple[str, ...] = ()
    # Columns that store FALSE / TRUE as 0 / 1.
    flags: frozenset[str] = frozenset()
    # Too large to broadcast: rows are reduced to its key before they meet it.
    large: bool = False


@dataclass(frozen=True)
class Relationship:
    """Many-to-one link; ``on`` pairs many-side with one-side columns."""

    name: str
    many: str
    one: str
    on: tuple[tuple[str, str], ...]
    active: bool = True
    both: bool = False


class Model:
    def __init__(
        self,
        tables: Iterable[Table],
        relationships: Iterable[Relationship] = (),
        metrics: Mapping[str, object] | None = None,
        roles: Mapping[str, tuple] | None = None,
    ):
        self.tables = {t.name: t for t in tables}
        self.relationships = tuple(relationships)
        self.metrics = dict(metrics or {})
        self.roles = dict(roles or {})
        for rel in self.relationships:
            for name in (rel.many, rel.one):
                if name not in self.tables:
                    raise ModelError(f"relationship {rel.name} names unknown table {name}")

    def table(self, name: str) -> Table:
        if name not in self.tables:
            raise ModelError(f"unknown table {name}")
        return self.tables[name]

    def metric(self, name: str):
        if name not in self.metrics:
            raise ModelError(f"unknown metric {name}")
        return self.metrics[name]

    def links(self, use: frozenset[str] = frozenset()) -> tuple[Relationship, ...]:
        """Relationships in force when those named in ``use`` are switched on.

        Switching one on turns off the other active routes into its one-side
        table, so a filter still has a single way to travel.
        """
        known = {rel.name for rel in self.relationships}
        if use - known:
            raise ModelError(f"unknown relationships: {sorted(use - known)}")
        taken = {rel.one for rel in self.relationships if rel.name in use}
        return tuple(
            rel
            for rel in self.relationships
            if rel.name in use or (rel.active and rel.one not in taken)
        )

    def paths(self, table: str, use: frozenset[str] = frozenset()) -> dict[str, tuple[Relationship, ...]]:
        """Every table that filters ``table``, with the links leading to it."""
        self.table(table)
        found: dict[str, tuple[Relationship, ...]] = {table: ()}
        queue = deque([table])
        while queue:
            here = queue.popleft()
            for rel in self.links(use):
                if rel.many != here:
                    continue
                if rel.one in found:
                    raise ModelError(f"two active routes from {table} to {rel.one}")
                found[rel.one] = found[here] + (rel,)
                queue.append(rel.one)
        return found

    def reverse_path(self, table: str, other: str, use: frozenset[str] = frozenset()) -> tuple[Relationship, ...]:
        """Links from ``other`` up to ``table`` if all of them filter both ways."""
        path = self.paths(other, use).get(table, ())
        return path if path and all(rel.both for rel in path) else ()
