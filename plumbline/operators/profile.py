"""Checks of tables and metrics that find unsafe definitions in the data."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from plumbline.model import Model
from plumbline.operators.reconcile import numbers_match, values_match


def relationship_profile(model: Model, names: Sequence[str] | None = None) -> DataFrame:
    """Per relationship: duplicated keys on the one side, orphan and blank keys
    on the many side, and whether it is many-to-one in the data.

    Each side is reduced to one row per key before the sides meet, so a hot
    key costs no more than any other.
    """
    parts = []
    for rel in model.relationships:
        if names is not None and rel.name not in names:
            continue
        keys = [f"k{i}" for i in range(len(rel.on))]
        many = model.table(rel.many).frame.select(
            *(F.col(a).alias(k) for (a, _), k in zip(rel.on, keys))
        )
        one = model.table(rel.one).frame.select(
            *(F.col(b).alias(k) for (_, b), k in zip(rel.on, keys))
        )
        many = many.groupBy(*keys).agg(F.count("*").alias("many_rows"))
        one = one.groupBy(*keys).agg(F.count("*").alias("one_rows"))
        both = many.join(one, keys, "full_outer")
        blank = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
        used = F.coalesce("many_rows", F.lit(0))
        held = F.coalesce("one_rows", F.lit(0))
        parts.append(
            both.agg(
                F.lit(rel.name).alias("relationship"),
                F.coalesce(F.sum("many_rows"), F.lit(0)).alias("many_rows"),
                F.coalesce(F.sum("one_rows"), F.lit(0)).alias("one_rows"),
                F.count_if(held > 1).alias("duplicate_one_keys"),
                F.count_if(~blank & (used > 0) & (held == 0)).alias("orphan_keys"),
                F.coalesce(F.sum(F.when(~blank & (held == 0), used)), F.lit(0)).alias("orphan_rows"),
                F.coalesce(F.sum(F.when(blank, used)), F.lit(0)).alias("blank_rows"),
                F.count_if(used > 1).alias("repeated_many_keys"),
            ).withColumn(
                "cardinality",
                F.when(F.col("duplicate_one_keys") > 0, "many_to_many")
                .when(F.col("repeated_many_keys") > 0, "many_to_one")
                .otherwise("one_to_one"),
            )
        )
    return reduce(DataFrame.unionByName, parts)


def _long_profile(frame: DataFrame, measures: Mapping[str, Mapping[str, Column]]) -> DataFrame:
    """One row per column from a single aggregation over the table."""
    aggs = [
        F.struct(
            F.lit(column).alias("column"), *(v.alias(n) for n, v in outs.items())
        ).alias(f"c{i}")
        for i, (column, outs) in enumerate(measures.items())
    ]
    names = [f"c{i}" for i in range(len(aggs))]
    return frame.agg(*aggs).select(F.explode(F.array(*names)).alias("p")).select("p.*")


# Endings of column names that mark identifiers.
KEY_NAME = r"(?i)(^|_)id$|key$"


def identifier_profile(frame: DataFrame, columns: Sequence[str], threshold: float = 0.99) -> DataFrame:
    """Numeric columns that identify rows or parents and must not be summed.

    Each column is first reduced to its distinct values, one column at a time.
    """
    parts = []
    for column in columns:
        per_value = frame.groupBy(column).agg(F.count("*").alias("__n"))
        parts.append(
            per_value.agg(
                F.lit(column).alias("column"),
                F.sum("__n").alias("rows"),
                F.count(column).alias("distinct_values"),
            )
        )
    every = reduce(DataFrame.unionByName, parts)
    ratio = F.try_divide(F.col("distinct_values").cast("double"), F.col("rows").cast("double"))
    named = F.col("column").rlike(KEY_NAME)
    return every.withColumn("distinct_ratio", ratio).withColumn(
        "identifier", named | (ratio >= threshold)
    )


def text_numeric_profile(frame: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Text columns and how many of their values are not numbers."""
    return _long_profile(
        frame,
        {
            c: {
                "rows": F.count(c),
                "not_numeric": F.count_if(F.col(c).isNotNull() & F.col(c).try_cast("double").isNull()),
            }
            for c in columns
        },
    ).withColumn("additive", (F.col("rows") > 0) & (F.col("not_numeric") == 0))


def non_additive_ratio(frame: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns that stay within [0, 1] row by row while their sum does not."""
    profile = _long_profile(
        frame,
        {
            c: {
                "low": F.min(c).cast("double"),
                "high": F.max(c).cast("double"),
                "total": F.sum(c).cast("double"),
            }
            for c in columns
        },
    )
    return profile.withColumn(
        "ratio_summed", (F.col("low") >= 0) & (F.col("high") <= 1) & (F.col("total") > 1)
    )


def unit_check(results: DataFrame, converted: str, base: str, divisor: float) -> DataFrame:
    """Does the converted metric equal the base metric over the divisor?"""
    return results.withColumn(
        "unit_ok", numbers_match(F.col(converted).cast("double"), F.col(base) / F.lit(float(divisor)))
    )


def outside_population(rows: DataFrame, by: Sequence[str], numerator: Column, denominator: Column) -> DataFrame:
    """Numerator rows that the denominator does not contain."""
    return rows.groupBy(*by).agg(
        F.count_if(numerator).alias("numerator_rows"),
        F.count_if(denominator).alias("denominator_rows"),
        F.count_if(numerator & ~F.coalesce(denominator, F.lit(False))).alias("outside_rows"),
    )


def same_value(results: DataFrame, left: str, right: str, name: str = "same") -> DataFrame:
    kinds = [results.schema[c].dataType for c in (left, right)]
    return results.withColumn(name, values_match(F.col(left), F.col(right), *kinds))


def unique_not_null(frame: DataFrame, unique: Sequence[str], not_null: Sequence[str]) -> DataFrame:
    """Failing rows per data test."""
    parts = []
    for column in unique:
        copies = (
            frame.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("__n"))
        )
        parts.append(
            copies.agg(
                F.lit("unique").alias("test"),
                F.lit(column).alias("column"),
                F.count_if(F.col("__n") > 1).alias("failures"),
            )
        )
    nulls = _long_profile(frame, {c: {"failures": F.count_if(F.col(c).isNull())} for c in not_null})
    parts.append(nulls.select(F.lit("not_null").alias("test"), "column", "failures"))
    return reduce(DataFrame.unionByName, parts)


def exclusion_proof(rows: DataFrame, flag: Column, excluded: Column, by: Sequence[str] = ()) -> DataFrame:
    """The flag is proven to exclude rows if it holds for none of them."""
    broken = F.count_if(flag & excluded)
    return rows.groupBy(*by).agg(
        F.count_if(excluded).alias("excluded_rows"),
        broken.alias("violations"),
        (broken == 0).alias("proven"),
    )


# Severities from worst to mildest.
SEVERITIES = ("BLOCKER", "ERROR", "WARNING", "INFO")


def findings_summary(findings: DataFrame, identity: str = "finding_id") -> DataFrame:
    """Counts by severity and code without repeated findings, worst first.

    ``identity`` tells findings apart: give a full hash, not the short display id.
    """
    rank = F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("severity"))
    return (
        findings.dropDuplicates(["code", identity])
        .groupBy("severity", "code")
        .agg(F.count("*").alias("findings"))
        .withColumn("severity_rank", rank)
        .orderBy("severity_rank", "code")
    )
