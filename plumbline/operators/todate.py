"""Year to date of values that do not add up: distinct counts, medians and percentiles.

A period is a day, month or year by its first day. What is given for a period
covers its year up to the end of the period, for every period in which the group
has rows. A filter on the date belongs on the result, so that the year is still
counted from its first day.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from plumbline.operators.lineage import cut_lineage
from plumbline.operators.ordered import SPLIT_ABOVE, ordered_counts

# Parts into which every round cuts the values that are still possible.
BASE = 32


def first_day(date: str, grain: str) -> Column:
    if grain not in ("day", "month", "year"):
        raise ValueError(f"no such grain: {grain}")
    return F.to_date(date) if grain == "day" else F.trunc(date, grain)


def _placed(rows: DataFrame, by: Sequence[str], date: str, value: str, grain: str) -> DataFrame:
    """Group (a struct, never blank itself), year, period and value; rows without a date are left out."""
    group = F.struct(*(F.col(b) for b in by)) if by else F.struct(F.lit(0).alias("all"))
    return rows.where(F.col(date).isNotNull()).select(
        group.alias("group"), F.year(date).alias("year"), first_day(date, grain).alias("period"), F.col(value).alias("value")
    )


def _upto(*keys: str) -> Window:
    return Window.partitionBy(*keys).orderBy("period").rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _opened(frame: DataFrame, by: Sequence[str], *others: str) -> DataFrame:
    return frame.select(*(F.col("group")[b].alias(b) for b in by), *others)


def distinct_to_date(rows: DataFrame, by: Sequence[str], date: str, value: str, name: str, grain: str = "day") -> DataFrame:
    """``by``, ``period`` and ``name``: distinct values of the year so far; blank counts as one value.

    A value counts in the period of its first row in the year, so the counts of
    first rows can be summed over the periods, at most 366 of a group and year.
    """
    seen = _placed(rows, by, date, value, grain).distinct()
    firsts = seen.groupBy("group", "year", "value").agg(F.min("period").alias("period"))
    new = firsts.groupBy("group", "year", "period").agg(F.count(F.lit(1)).alias("new"))
    # Periods in which nothing is new have a result too.
    every = new.unionByName(seen.groupBy("group", "year", "period").agg(F.lit(0).cast("bigint").alias("new")))
    counts = every.groupBy("group", "year", "period").agg(F.sum("new").alias("new"))
    return _opened(counts.withColumn(name, F.sum("new").over(_upto("group", "year"))), by, "period", name)


def percentiles_to_date(
    rows: DataFrame,
    by: Sequence[str],
    date: str,
    value: str,
    points: Mapping[str, float],
    grain: str = "day",
    split_above: int = SPLIT_ABOVE,
) -> DataFrame:
    """``by``, ``period`` and one inclusive percentile for each of ``points``, of the year so far.

    Rows are reduced to counts per period and value, and values get their place
    in the order of the group's year. All periods then look for their values at
    once: a round counts, for each part of the places that are still possible,
    the rows up to each period, and each period goes on in the part that holds
    its rank. Counts of a part merge over the periods; no group is held in one task.
    Blank values are left out; groups without any have no row.
    """
    rows = _placed(rows, by, date, value, grain).where("value IS NOT NULL")
    counts = cut_lineage(rows.groupBy("group", "year", "period", "value").agg(F.count(F.lit(1)).alias("n")))
    places = ordered_counts(counts.select("group", "year", "value").distinct(), ["group", "year"], "value", split_above)
    places = cut_lineage(places.select("group", "year", "value", F.col("before").alias("place")))
    coded = cut_lineage(counts.join(places, ["group", "year", "value"]).select("group", "year", "period", "place", "n"))
    most = places.agg(F.max("place")).first()[0]

    totals = coded.groupBy("group", "year", "period").agg(F.sum("n").alias("n"))
    totals = totals.withColumn("last", F.sum("n").over(_upto("group", "year")) - 1).drop("n")
    ranks = [f(F.col("last") * F.lit(float(p))).cast("bigint") + 1 for p in points.values() for f in (F.floor, F.ceil)]
    asks = totals.select("group", "year", "period", "last", F.posexplode(F.array(*ranks)).alias("ask", "rank"))
    asks = cut_lineage(asks.withColumn("part", F.lit(0).cast("bigint")))

    size = 1
    while size * BASE <= (most or 0):
        size *= BASE
    while size:
        asks = cut_lineage(_narrowed(coded, asks, size))
        size //= BASE

    found = asks.join(places.withColumnRenamed("place", "part"), ["group", "year", "part"])
    side = lambda k: F.max(F.when(F.col("ask") == k, F.col("value").cast("double")))
    sides = [side(k).alias(f"s{k}") for k in range(2 * len(points))]
    found = found.groupBy("group", "year", "period").agg(F.max("last").alias("last"), *sides)
    spot = lambda p: F.col("last") * F.lit(float(p)) - F.floor(F.col("last") * F.lit(float(p)))
    low = [F.col(f"s{2 * k}") for k in range(len(points))]
    values = [(low[k] + (F.col(f"s{2 * k + 1}") - low[k]) * spot(p)).alias(name) for k, (name, p) in enumerate(points.items())]
    return _opened(found.select("group", "period", *values), by, "period", *points)


def _narrowed(coded: DataFrame, asks: DataFrame, size: int) -> DataFrame:
    """The asks with their part cut into BASE parts of ``size`` places: the one that holds the rank, and the rank in it."""
    keys = ["group", "year", "period", "part", "digit"]
    held = coded.select(
        "group", "year", "period", F.floor(F.col("place") / (size * BASE)).alias("part"),
        (F.floor(F.col("place") / size) % BASE).alias("digit"), "n", F.lit(False).alias("asked"),
    )
    used = asks.select("group", "year", "part").distinct()
    wanted = asks.select("group", "year", "period", "part").distinct()
    digits = F.sequence(F.lit(0).cast("bigint"), F.lit(BASE - 1).cast("bigint"))
    wanted = wanted.select("*", F.explode(digits).alias("digit"), F.lit(0).cast("bigint").alias("n"), F.lit(True).alias("asked"))
    both = held.join(used, ["group", "year", "part"], "left_semi").unionByName(wanted)
    both = both.groupBy(*keys).agg(F.sum("n").alias("n"), F.max("asked").alias("asked"))
    upto = both.withColumn("n", F.sum("n").over(_upto("group", "year", "part", "digit"))).where("asked").drop("asked")
    order = Window.partitionBy(*keys[:-1]).orderBy("digit").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = upto.withColumn("end", F.sum("n").over(order))
    chosen = asks.join(upto, keys[:-1]).where("rank <= end AND rank > end - n")
    return chosen.select("group", "year", "period", "last", "ask", (F.col("rank") - F.col("end") + F.col("n")).alias("rank"), (F.col("part") * BASE + F.col("digit")).alias("part"))
