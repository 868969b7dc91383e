"""Differences by fingerprints of key ranges."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from plumbline.operators import diff, treediff


def rows_of(frame, keys):
    return sorted(repr((*(r[k] for k in keys), r.kind, [tuple(c) for c in r.changes])) for r in frame.collect())


def same(before, after, keys=("k",)):
    got = rows_of(treediff.tree_diff(before, after, list(keys)), keys)
    assert got == rows_of(diff.keyed_diff(before, after, list(keys)), keys)
    return got


def wide(spark, n):
    return spark.range(n).select(F.col("id").alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("v"), (F.col("id") * 7 % 13).alias("w"))


def test_one_changed_row_in_a_thousand_reads_few_rows(spark):
    before = wide(spark, 200_000)
    after = before.where("k % 2003 <> 5").withColumn("w", F.when(F.col("k") % 1009 == 3, F.lit(None)).otherwise(F.col("w")))
    after = after.unionByName(before.where("k % 4001 = 9").withColumn("k", -F.col("k") - 1))
    opened = treediff.open_rows(before, after, ["k"])
    assert sum(f.count() for f in opened) <= 0.05 * 2 * before.count()
    assert len(same(before, after)) > 300


def test_clustered_changes_leave_one_stretch(spark):
    before = wide(spark, 500_000)
    after = before.withColumn("w", F.when(F.col("k").between(123_456, 123_999), F.lit(-1)).otherwise(F.col("w")))
    opened = treediff.open_rows(before, after, ["k"])
    assert all(544 <= f.count() <= 600 for f in opened)
    assert len(same(before, after)) == 544


def test_keys_far_apart_and_of_the_whole_range(spark):
    keys = [-(1 << 63), -1, 0, 1, 2, 3, (1 << 63) - 1]
    before = spark.createDataFrame([(k, "a") for k in keys], "k long, v string")
    after = spark.createDataFrame([(k, "b" if k == 2 else "a") for k in keys], "k long, v string")
    assert len(same(before, after)) == 1
    outlier = wide(spark, 100_000).withColumn("k", F.when(F.col("k") == 0, F.lit(1 << 60)).otherwise(F.col("k")))
    moved = outlier.withColumn("w", F.when(F.col("k") == 77, F.lit(99)).otherwise(F.col("w")))
    assert treediff.open_rows(outlier, moved, ["k"])[0].count() <= 64
    assert len(same(outlier, moved)) == 1


@pytest.mark.parametrize("kind", ["int", "date", "string", "double"])
def test_random_tables_equal_the_plain_difference(spark, kind):
    rng = random.Random(kind)
    make = {"int": int, "date": lambda k: datetime.date(2020, 1, 1) + datetime.timedelta(k), "string": str, "double": float}[kind]
    old = {k: (rng.choice(["", None, "x"]), rng.choice([None, 1])) for k in rng.sample(range(400), 200)}
    new = {k: v if rng.random() < 0.9 else (None, 1) for k, v in old.items() if rng.random() < 0.95} | {k: ("n", 2) for k in range(400, 405)}
    table = lambda rows: spark.createDataFrame([(make(k), *v) for k, v in rows.items()] + [(None, "z", len(rows))], f"k {kind}, v string, w int")
    assert same(table(old), table(new))


def test_equal_empty_and_unlike_tables(spark):
    table = wide(spark, 1000)
    assert same(table, table) == []
    assert len(same(table, table.limit(0))) == len(same(table.limit(0), table)) == 1000
    assert same(table.limit(0), table.limit(0)) == []
    assert len(same(table, table.withColumn("extra", F.lit(1)))) == 1000
    assert same(table, table.withColumn("k", F.col("k").cast("int"))) == []
    one = spark.createDataFrame([("1", "a", 1), ("1", "b", 2)], "k string, j string, v int")
    two = spark.createDataFrame([("1", "a", 1), ("1", "b", 3)], "k string, j string, v int")
    assert len(same(one, two, ("k", "j"))) == 1


def test_open_ranges_reach_the_scan(spark, tmp_path):
    wide(spark, 100_000).repartitionByRange(8, "k").sortWithinPartitions("k").write.parquet(f"{tmp_path}/t")
    before = spark.read.parquet(f"{tmp_path}/t")
    after = before.withColumn("v", F.when(F.col("k") == 500, F.lit("?")).otherwise(F.col("v")))
    opened = treediff.open_rows(before, after, ["k"])[0]
    plan = opened._jdf.queryExecution().executedPlan().toString()
    assert opened.count() <= 16 and "GreaterThanOrEqual(k," in plan
