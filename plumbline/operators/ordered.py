"""Exact order statistics that never gather one group in one task.

``percentile()`` and unbounded window ranks hold a whole group in a single
task. Here a group is first reduced to its distinct values with counts; groups
with many distinct values are then cut at sketched quantiles into ranges, each
range is ordered on its own, and range totals supply the offsets. The sketch
only decides where to cut, so the counts stay exact.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from plumbline.operators.attach import attach

# 2 ** STEPS ranges for a group above SPLIT_ABOVE distinct values.
STEPS = 10
SPLIT_ABOVE = 1_000_000
# Ten times finer than a range.
ACCURACY = 10 * 2**STEPS


def _cut_points(value: str) -> Column:
    # One text literal keeps the plan small.
    points = ",".join(str(i / 2**STEPS) for i in range(1, 2**STEPS))
    return F.expr(
        f"percentile_approx(`{value}`, cast(split('{points}', ',') as array<double>), {ACCURACY})"
    )


def _range_of(frame: DataFrame, value: str) -> DataFrame:
    """Add the range number of ``value`` by halving over the cut points.

    Each step refers to the one before, which keeps the search in generated
    code. Without cut points everything is in range 0.
    """
    steps = ["0 AS __r0"]
    for i, step in enumerate(2**k for k in reversed(range(STEPS))):
        up = f"`{value}` >= get(__cuts, __r{i} + {step - 1})"
        steps.append(f"__r{i} + if({up}, {step}, 0) AS __r{i + 1}")
    placed = frame.selectExpr("*", *steps, f"__r{STEPS} AS __range")
    return placed.select(*frame.columns, "__range")


def _keyed(frame: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Pack the keys into one struct: it is never blank itself and blanks
    inside it are equal, so grouping, joins and windows on it share one
    partitioning."""
    if not keys:
        return frame, []
    others = [c for c in frame.columns if c not in keys]
    return frame.select(F.struct(*keys).alias("__key"), *others), ["__key"]


def _join(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    return left.join(right, list(on), "left") if on else attach(left, right, ())


def _ordered(rows: DataFrame, key: list[str], value: str, split_above: int) -> DataFrame:
    counts = rows.where(F.col(value).isNotNull()).groupBy(*key, value).agg(F.count("*").alias("n"))
    groups = counts.groupBy(*key).agg(
        F.sum("n").alias("total"),
        F.when(F.count("*") > split_above, _cut_points(value)).alias("__cuts"),
    )
    placed = (
        _range_of(_join(counts, groups, key), value)
        .withColumn("__split", F.col("__cuts").isNotNull())
        .drop("__cuts")
        .repartition(*key, "__range")
    )
    # Only groups that were cut need offsets: at most 2 ** STEPS rows per key.
    earlier = Window.partitionBy(*key).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = (
        placed.where("__split")
        .groupBy(*key, "__range")
        .agg(F.sum("n").alias("__size"))
        .withColumn("__offset", F.sum("__size").over(earlier))
        .drop("__size")
    )
    upto = (
        Window.partitionBy(*key, "__range")
        .orderBy(value)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    before = F.coalesce("__offset", F.lit(0)) + F.sum("n").over(upto) - F.col("n")
    return (
        _join(placed, ranges, [*key, "__range"])
        .withColumn("before", before)
        .select(*key, value, "n", "before", "total")
    )


def _opened(frame: DataFrame, keys: Sequence[str]) -> DataFrame:
    others = [c for c in frame.columns if c != "__key"]
    return frame.select(*(F.col("__key")[k].alias(k) for k in keys), *others)


def ordered_counts(
    rows: DataFrame, keys: Sequence[str], value: str, split_above: int = SPLIT_ABOVE
) -> DataFrame:
    """Per key and distinct value: ``n`` rows, ``before`` rows with a smaller
    value, and ``total`` rows of the key. Blank values are left out."""
    keyed, key = _keyed(rows.select(*keys, value), keys)
    return _opened(_ordered(keyed, key, value, split_above), keys)


def percentiles(
    rows: DataFrame,
    keys: Sequence[str],
    value: str,
    points: Mapping[str, float],
    split_above: int = SPLIT_ABOVE,
) -> DataFrame:
    """Inclusive percentiles, linear between neighbours, one column per point."""
    keyed, key = _keyed(rows.select(*keys, value), keys)
    counts = _ordered(keyed, key, value, split_above)
    last = F.col("total") - 1
    aggs, outs = [], []
    for name, p in points.items():
        low, high = F.floor(last * F.lit(p)), F.ceil(last * F.lit(p))
        for side, rank in (("low", low), ("high", high)):
            hit = (F.col("before") <= rank) & (rank < F.col("before") + F.col("n"))
            aggs.append(F.max(F.when(hit, F.col(value).cast("double"))).alias(f"__{side}_{name}"))
        low_v, high_v = F.col(f"__low_{name}"), F.col(f"__high_{name}")
        spot = (F.col("__total") - 1) * F.lit(p)
        outs.append((low_v + (high_v - low_v) * (spot - F.floor(spot))).alias(name))
    found = counts.groupBy(*key).agg(F.max("total").alias("__total"), *aggs)
    return _opened(found.select(*key, *outs), keys)


def dense_rank(
    frame: DataFrame,
    keys: Sequence[str],
    value: str,
    name: str,
    descending: bool = True,
    split_above: int = SPLIT_ABOVE,
) -> DataFrame:
    """Dense rank of ``value`` inside the keys; a blank value has no rank."""
    counts = ordered_counts(frame.select(*keys, value).distinct(), keys, value, split_above)
    rank: Column = F.col("total") - F.col("before") if descending else F.col("before") + 1
    ranks = counts.select(*keys, value, rank.alias(name))
    return attach(frame, ranks, [*keys, value])


def relative_positions(
    rows: DataFrame,
    keys: Sequence[str],
    names: Mapping[str, str],
    split_above: int = SPLIT_ABOVE,
) -> DataFrame:
    """Per value column, the share of the other rows of the key that have a
    larger value: the lowest value scores 1 and the highest 0. ``names`` maps
    value columns to result columns."""
    keyed, key = _keyed(rows, keys)
    out = keyed
    # A blank value has no position: such rows are spread, not sent to one task.
    spread = F.pmod(F.xxhash64(*keyed.columns), F.lit(1024))
    for value, name in names.items():
        counts = _ordered(keyed.select(*key, value), key, value, split_above)
        larger = F.col("total") - F.col("before") - F.col("n")
        share = F.when(F.col("total") > 1, larger / (F.col("total") - 1)).otherwise(0.0)
        placed = counts.select(*key, value, share.alias(name), F.lit(0).cast("bigint").alias("__spread"))
        out = out.withColumn("__spread", F.when(F.col(value).isNull(), spread).otherwise(0))
        out = _join(out, placed, [*key, value, "__spread"]).drop("__spread")
    return _opened(out, keys).select(*rows.columns, *names.values())
