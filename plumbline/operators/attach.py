"""Null-safe joins between results of different grain."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, functions as F


def _renamed(right: DataFrame, keys: Sequence[str]) -> DataFrame:
    return right.select(
        *(F.col(k).alias(f"__r_{k}") for k in keys),
        *(c for c in right.columns if c not in keys),
    )


def _same(keys: Sequence[str]):
    return reduce(and_, [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys])


def attach(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join that treats blank keys as equal.

    With no keys ``right`` is one row and its values become scalar subqueries.
    """
    if not keys:
        row = right.select(F.struct(*right.columns).alias("row")).scalar()
        return (
            left.withColumn("__row", row)
            .select(*left.columns, *(F.col("__row")[c].alias(c) for c in right.columns))
        )
    joined = left.join(_renamed(right, keys), _same(keys), "left")
    return joined.drop(*(f"__r_{k}" for k in keys))


def merge(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Full outer join on blank-equal keys, keys coalesced."""
    if not keys:
        return attach(left, right, ())
    joined = left.join(_renamed(right, keys), _same(keys), "full_outer")
    return joined.select(
        *(F.coalesce(F.col(k), F.col(f"__r_{k}")).alias(k) for k in keys),
        *(c for c in left.columns if c not in keys),
        *(c for c in right.columns if c not in keys),
    )


def align(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Full outer match that also tells which sides have the key."""
    marked = merge(
        left.withColumn("in_left", F.lit(True)),
        right.withColumn("in_right", F.lit(True)),
        keys,
    )
    return marked.fillna(False, subset=["in_left", "in_right"])
