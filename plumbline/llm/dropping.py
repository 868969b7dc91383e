"""Leaving out rows by id without moving the texts of the others."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.blocked_bloom import build_bloom


def possibly_in(ids: DataFrame, key: Column) -> Column:
    """False only where the key is not among the ids, by a Bloom filter of bounded size."""
    bloom = ids.sparkSession.sparkContext.broadcast(build_bloom(ids.select(F.xxhash64(ids.columns[0]))))

    @F.pandas_udf("boolean")
    def test(hashes: pd.Series) -> pd.Series:
        return pd.Series(bloom.value.might_hold(hashes.to_numpy()))

    return test(F.xxhash64(key))


def without(docs: DataFrame, ids: DataFrame, id: str = "doc_id") -> DataFrame:
    """The rows whose id is not in `ids` (one column). Rows without an id stay.

    Only rows that a Bloom filter of the ids lets through are joined with them; all others pass where they are.
    """
    ids = ids.select(F.col(ids.columns[0]).alias("dropped")).where("dropped is not null").distinct()
    marked = docs.withColumn("possible", possibly_in(ids, F.col(id)))
    rest = marked.where("possible").drop("possible").join(ids, F.col(id) == F.col("dropped"), "left_anti")
    return marked.where("not possible").drop("possible").unionByName(rest)


def one_of_each(docs: DataFrame, ids: DataFrame, id: str = "doc_id") -> DataFrame:
    """All rows, but of the rows with one of the given ids only the least, compared column by column."""
    ids = ids.select(F.col(ids.columns[0]).alias("repeated")).where("repeated is not null").distinct()
    marked = docs.withColumn("possible", possibly_in(ids, F.col(id)))
    some = marked.where("possible").drop("possible")
    same = F.col(id) == F.col("repeated")
    others = some.join(ids, same, "left_anti")
    least = some.join(ids, same, "left_semi").groupBy(id).agg(F.min(F.struct(*docs.columns)).alias("row")).select("row.*")
    return marked.where("not possible").drop("possible").unionByName(others).unionByName(least)
