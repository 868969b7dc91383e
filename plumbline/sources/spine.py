"""Day spine between the first and last date of a column."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def day_spine(rows: DataFrame, date: str, name: str = "date_day") -> DataFrame:
    span = rows.agg(F.min(date).cast("date").alias("first"), F.max(date).cast("date").alias("last"))
    days = F.sequence("first", "last", F.expr("interval 1 day"))
    return span.select(F.explode(days).alias(name))
