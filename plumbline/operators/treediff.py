"""Keyed differences of large tables that are mostly equal.

Both tables are summed up as fingerprints of ranges of the first key; ranges that differ are cut finer, level by
level, and only the rows of ranges that still differ are joined. A level reads only the ranges that are open (a filter
that reaches the scan), and shuffles one row for each range a task meets: little where files are clustered by the key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from plumbline.operators.diff import keyed_diff

#: Ranges of one level; as many rows reach the driver at most.
RANGES = 1 << 14
#: Intervals that a level reads; the smallest gaps between open ranges are read with them.
INTERVALS = 32
#: A range of so few rows is not cut again.
FINE = 16
LEVELS = 6
_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def _hashed(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(1 << 62))


def _span(frames: Sequence[DataFrame]) -> tuple[int | None, int | None]:
    both = frames[0].unionAll(frames[1])
    return tuple(both.agg(F.min("__at"), F.max("__at")).first())


def _placed(frames: Sequence[DataFrame], key: str) -> list[DataFrame] | None:
    """Both tables with the key's place on a line of integers; None where their keys are not of one type."""
    kinds = [f.schema[key].dataType for f in frames]
    whole = all(isinstance(k, _WHOLE) for k in kinds)
    if not whole and kinds[0] != kinds[1]:
        return None
    key = F.col(key)
    if whole or isinstance(kinds[0], T.DateType):
        place = key.cast("long") if whole else F.unix_date(key).cast("long")
        at = [f.withColumn("__at", place) for f in frames]
        low, high = _span([f.select("__at") for f in at])
        if low is None or high - low < 1 << 62:
            return at
    return [f.withColumn("__at", F.when(key.isNotNull(), _hashed(key))) for f in frames]


def _range_of(intervals: Sequence[tuple[int, int]]) -> Column:
    """Number of the range a place falls in; -1 outside the intervals, blank for a blank place."""
    total = sum(high - low + 1 for low, high in intervals)
    width = -(-total // (RANGES - len(intervals)))
    at, first = F.col("__at"), 0
    number = F.when(at.isNotNull(), F.lit(-1).cast("long"))
    for low, high in intervals:
        step = F.floor((at - F.lit(low)) / F.lit(width)) if width > 1 else at - F.lit(low)
        number = F.when(at.between(low, high), step.cast("long") + F.lit(first)).otherwise(number)
        first += (high - low) // width + 1
    return number


def _inside(intervals: Sequence[tuple[int, int]]) -> Column:
    out = F.lit(False)
    for low, high in intervals:
        out = out | F.col("__at").between(low, high)
    return out


def _merged(ranges: Sequence[tuple[int, int]]) -> list[tuple[int, int]]:
    """At most INTERVALS intervals that hold all ranges, parted at the largest gaps."""
    ranges = sorted(ranges)
    gaps = sorted(range(1, len(ranges)), key=lambda i: ranges[i - 1][1] - ranges[i][0])[: INTERVALS - 1]
    cuts = [0, *sorted(gaps), len(ranges)]
    return [(ranges[a][0], ranges[b - 1][1]) for a, b in zip(cuts, cuts[1:], strict=False)]


def open_rows(before: DataFrame, after: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """The rows of both tables in ranges of the first key that differ, and those with a blank first key.

    Rows that exist on one side only, or differ in any column, are among them; equal ones can be. A column that one
    side lacks counts as blank there. Fingerprints are the row count and sums of two hashes of the row.
    """
    columns = sorted(set(before.columns) | set(after.columns))
    frames = _placed([before, after], keys[0])
    if frames is None:
        return before, after
    span = _span([f.select("__at") for f in frames])
    if span[0] is None:
        return before, after

    def marks(frame: DataFrame, sign: int, intervals: list[tuple[int, int]]) -> DataFrame:
        values = [F.col(c) if c in frame.columns else F.lit(None) for c in columns]
        values += [v.isNull() for v in values]
        hashes = [F.xxhash64(*seed, *values).cast("decimal(38,0)") * F.lit(sign) for seed in ((), (F.lit(1),))]
        return frame.where(_inside(intervals)).select(
            _range_of(intervals).alias("range"), "__at", F.lit(sign).alias("sign"), *(h.cast("decimal(38,0)").alias(f"h{k}") for k, h in enumerate(hashes))
        )

    intervals, rest, kept = [span], None, None
    for _ in range(LEVELS):
        both = marks(frames[0], 1, intervals).unionAll(marks(frames[1], -1, intervals))
        sums = both.groupBy("range").agg(
            F.sum("sign").alias("sign"), F.sum("h0").alias("h0"), F.sum("h1").alias("h1"),
            F.min("__at").alias("low"), F.max("__at").alias("high"), F.count("*").alias("rows"),
        )
        found = sums.where("sign <> 0 or h0 <> 0 or h1 <> 0").select("range", "low", "high", "rows").collect()
        rows = sum(r["rows"] for r in found)
        if rest is not None and rows >= rest:
            break
        numbers = [r["range"] for r in found]
        kept = F.col("__at").isNull()
        if found:
            # Two conditions without a common part, so that the first reaches the scan.
            kept = (kept | _inside(_merged([(r["low"], r["high"]) for r in found]))) & F.coalesce(_range_of(intervals).isin(numbers), F.lit(True))
        fine = rows <= FINE * len(found) or all(r["low"] == r["high"] for r in found)
        if fine or (rest is not None and 2 * rows > rest):
            break
        rest, intervals = rows, _merged([(r["low"], r["high"]) for r in found])
    return frames[0].where(kept).drop("__at"), frames[1].where(kept).drop("__at")


def tree_diff(before: DataFrame, after: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows of ``keyed_diff``, with only ranges of keys that differ joined.

    Jobs run when this is called: one for the span of whole keys and one a level. Changes that are spread evenly over
    a table leave no range equal once there are more of them than ranges; then all rows are joined, after one level.
    """
    return keyed_diff(*open_rows(before, after, keys), keys)
