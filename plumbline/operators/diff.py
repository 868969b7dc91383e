"""Differences between keyed tables and between snapshots."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F

from plumbline.operators.attach import align

#: Rows of both tables that one task compares.
PART_ROWS = 1_000_000


def row_hash(columns: Sequence[str]) -> Column:
    """Hash of the row that tells a blank from an empty text."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


def _as_text(column: Column) -> Column:
    return column.cast("string")


def keyed_diff(before: DataFrame, after: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Added, removed and changed rows by key. ``changes`` lists the fields
    that differ with both values; unchanged rows are left out."""
    fields = sorted(set(before.columns) | set(after.columns) - set(keys))
    fields = [f for f in fields if f not in keys]
    old = before.select(*keys, *(_field(before, f, "b_") for f in fields))
    new = after.select(*keys, *(_field(after, f, "a_") for f in fields))
    both = align(old, new, keys)
    differs = {f: ~F.col(f"b_{f}").eqNullSafe(F.col(f"a_{f}")) for f in fields}
    in_both = F.col("in_left") & F.col("in_right")
    kind = (
        F.when(~F.col("in_left"), "added")
        .when(~F.col("in_right"), "removed")
        .when(reduce(or_, differs.values()), "changed")
    )
    entries = F.array_compact(
        F.array(
            *(
                F.when(
                    in_both & differs[f],
                    F.struct(
                        F.lit(f).alias("field"),
                        _as_text(F.col(f"b_{f}")).alias("before"),
                        _as_text(F.col(f"a_{f}")).alias("after"),
                    ),
                )
                for f in fields
            )
        )
    )
    return both.select(*keys, kind.alias("kind"), entries.alias("changes")).where("kind is not null")


def _field(frame: DataFrame, name: str, prefix: str) -> Column:
    value = F.col(name) if name in frame.columns else F.lit(None)
    return value.alias(prefix + name)


def diff_summary(diff: DataFrame) -> DataFrame:
    return diff.agg(
        *(
            F.count_if(F.col("kind") == kind).alias(name)
            for kind, name in (("added", "additions"), ("removed", "removals"), ("changed", "changes"))
        )
    )


def snapshot_drift(
    baseline: DataFrame, expected: DataFrame, observed: DataFrame, keys: Sequence[str]
) -> DataFrame:
    """Three snapshots of one set of objects.

    ``expected_change``: meant to change; ``actual_change``: did change;
    ``misaligned``: not what was expected; ``unrelated``: changed although no
    change was meant.
    """
    sides = {"b": baseline, "e": expected, "o": observed}
    hashed = [
        f.select(*keys, row_hash([c for c in f.columns if c not in keys]).alias(n))
        for n, f in sides.items()
    ]
    both = align(
        align(hashed[0], hashed[1], keys).drop("in_left", "in_right"), hashed[2], keys
    )
    expected_change = ~F.col("b").eqNullSafe(F.col("e"))
    actual_change = ~F.col("b").eqNullSafe(F.col("o"))
    misaligned = ~F.col("e").eqNullSafe(F.col("o"))
    return both.select(
        *keys,
        expected_change.alias("expected_change"),
        actual_change.alias("actual_change"),
        misaligned.alias("misaligned"),
        (actual_change & ~expected_change).alias("unrelated"),
    ).where("expected_change or actual_change or misaligned")


def drift_status(drift: DataFrame) -> DataFrame:
    bad = F.count_if(F.col("misaligned") | F.col("unrelated"))
    return drift.agg(
        F.count_if("expected_change").alias("expected_changes"),
        F.count_if("actual_change").alias("actual_changes"),
        bad.alias("unexpected_changes"),
        F.count_if("unrelated").alias("unrelated_changes"),
        F.when(bad == 0, "ALIGNED").otherwise("MANUAL_REVIEW_REQUIRED").alias("status"),
    )


def object_status(
    source: DataFrame,
    target: DataFrame,
    keys: Sequence[str],
    definition: Sequence[str],
    metadata: Sequence[str],
) -> DataFrame:
    """Match, metadata drift, definition drift, or missing on one side."""
    hashed = [
        f.select(*keys, row_hash(definition).alias(f"d{i}"), row_hash(metadata).alias(f"m{i}"))
        for i, f in enumerate((source, target))
    ]
    status = (
        F.when(~F.col("in_right"), "MISSING_IN_TARGET")
        .when(~F.col("in_left"), "MISSING_IN_SOURCE")
        .when(F.col("d0") != F.col("d1"), "DEFINITION_DRIFT")
        .when(F.col("m0") != F.col("m1"), "METADATA_DRIFT")
        .otherwise("MATCH")
    )
    return align(*hashed, keys).select(*keys, status.alias("status"))


def omitted_and_extra(source: DataFrame, target: DataFrame, keys: Sequence[str], extra_once: bool = False) -> DataFrame:
    """Rows of ``source`` whose key ``target`` lacks, and the reverse; a blank key is never found.

    Both are counted and dealt by key into parts of about ``PART_ROWS`` rows before keys are made distinct, so what a
    task holds does not grow with the tables. With ``extra_once`` each extra key is one row, however often it occurs.
    """
    keys = list(keys)
    source, target = source.select(*keys), target.select(*keys)
    parts = max(source.sparkSession.sparkContext.defaultParallelism, -(-(source.count() + target.count()) // PART_ROWS))
    source, target = (f.repartition(parts, *keys) for f in (source, target))
    # Without the hint a table of keys that Spark takes for small would be sent to every task.
    omitted = source.join(target.distinct().hint("merge"), keys, "left_anti")
    extra = (target.distinct() if extra_once else target).join(source.distinct().hint("merge"), keys, "left_anti")
    return omitted.withColumn("side", F.lit("omitted")).unionByName(
        extra.withColumn("side", F.lit("extra"))
    )
