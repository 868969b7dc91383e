"""Queries over the supplied tables."""

from plumbline.queries import aggregates, blank_rules, checks, contexts, joins, packs, reconciling, rows
from plumbline.queries.registry import CASES

__all__ = ["CASES"]
