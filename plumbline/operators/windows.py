"""Operators over aggregated results: shares, top-N, parents, time shifts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from plumbline.functions.blanks import safe_divide
from plumbline.operators.attach import attach


def top_n_share(frame: DataFrame, by: Sequence[str], key: str, value: str, n: int) -> DataFrame:
    """Share of the group's total held by its ``n`` largest members; ties go
    to the smaller key."""
    by = list(by)
    order = (F.col(value).desc_nulls_last(), F.col(key).asc())
    if by:
        place = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
        best = frame.withColumn("__place", place).where(F.col("__place") <= n)
    else:
        best = frame.orderBy(*order).limit(n)
    best = best.groupBy(*by).agg(F.sum(value).alias("__top"))
    whole = frame.groupBy(*by).agg(F.sum(value).alias("__all"))
    return attach(whole, best, by).select(
        *by, safe_divide(F.col("__top"), F.col("__all")).alias("value")
    )


def top_n(frame: DataFrame, value: str, tie: str, n: int) -> DataFrame:
    return frame.orderBy(F.col(value).desc_nulls_last(), F.col(tie).asc()).limit(n)


def parent_share(
    rolled: DataFrame, levels: Sequence[str], value: str, name: str
) -> DataFrame:
    """Share of each rollup row in its parent row.

    ``rolled`` is a rollup over ``levels`` with its ``grouping_id``. The parent
    of a row drops its deepest present level; the grand total is its own.
    """
    depth = len(levels)
    # grouping_id of the rollup that keeps the first k levels.
    ids = [2 ** (depth - k) - 1 for k in range(depth + 1)]
    up = F.lit(ids[0])
    for k in range(depth, 0, -1):
        up = F.when(F.col("grouping_id") == ids[k], ids[k - 1]).otherwise(up)
    keys = [f"__p_{level}" for level in levels]
    children = rolled.withColumn("__p_gid", up)
    for k, level in enumerate(levels, start=1):
        children = children.withColumn(
            f"__p_{level}", F.when(F.col("grouping_id") < ids[k], F.col(level))
        )
    # Leaves are nobody's parent; without them this side is small.
    parents = rolled.where("grouping_id > 0").select(
        F.col("grouping_id").alias("__p_gid"),
        *(F.col(level).alias(f"__p_{level}") for level in levels),
        F.col(value).alias("__parent"),
    )
    return (
        attach(children, parents, ["__p_gid", *keys])
        .withColumn(name, safe_divide(F.col(value), F.col("__parent")))
        .drop("__p_gid", "__parent", *keys)
    )


def same_period_last_year(
    frame: DataFrame, date: str, keys: Sequence[str], values: Sequence[str], suffix: str = "_last_year"
) -> DataFrame:
    """Add the values of the row one year earlier; ``frame`` is already at the
    grain of ``date`` and ``keys``."""
    earlier = frame.select(
        F.col(date).alias("__then"), *keys, *(F.col(v).alias(v + suffix) for v in values)
    )
    shifted = frame.withColumn("__then", F.add_months(F.col(date), -12))
    return attach(shifted, earlier, ["__then", *keys]).drop("__then")


def fill_days(frame: DataFrame, days: DataFrame, date: str, values: Sequence[str]) -> DataFrame:
    """One row per day of the spine, zero where nothing happened."""
    return attach(days, frame, [date]).fillna(0, subset=list(values))
