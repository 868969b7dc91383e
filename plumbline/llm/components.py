"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.shared import saved


def components(edges: DataFrame, folder: str, name: str) -> DataFrame:
    """(node, root) for every node of the edges' two columns; root is the least node it is connected with.

    A node's links are never gathered: each step takes the least neighbour by partial aggregation and joins it back,
    and every round is written to the shared folder. Rounds end when the links no longer change.
    """
    a, b = (F.col(f"`{c}`") for c in edges.columns)
    links = saved(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), folder, f"{name}-0")
    mark, round_ = _mark(links), 0
    while mark[0]:
        round_ += 1
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = saved(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), folder, f"{name}-{round_}")
        last, mark = mark, _mark(links)
        if mark == last:
            break
    nodes = links.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _mark(links: DataFrame) -> tuple:
    """Row count and an order-free checksum."""
    return tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
