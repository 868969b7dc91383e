"""Registered queries, each with the SQL that must give the same result."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Case:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


CASES: dict[str, Case] = {}

# The derived columns of ``plumbline.star.derive_results``.
RESULTS = """o AS (
  SELECT *, CAST(o_orderdate AS DATE) AS day, CAST(year(o_orderdate) AS INTEGER) AS year,
    CAST(floor(o_totalprice * 0.1::DOUBLE) AS BIGINT) AS part_a,
    CASE WHEN o_orderpriority <> '5-LOW'
      THEN CAST(floor(o_totalprice * 0.5::DOUBLE) AS BIGINT) END AS part_b,
    CAST(floor(o_totalprice * 0.3::DOUBLE) AS BIGINT) AS part_c,
    CASE WHEN o_orderstatus <> 'P'
      THEN CAST(floor(o_totalprice * 0.04::DOUBLE) AS BIGINT) END AS part_d,
    CAST(floor(o_totalprice * 0.06::DOUBLE) AS BIGINT) AS part_e,
    nullif(o_orderstatus, 'P') AS closed_status,
    o_orderstatus <> 'O' AS is_closed,
    o_orderstatus = 'F' AS is_valid,
    CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END AS is_review
  FROM orders)"""

# Orders with their customer, nation and region.
GEO = RESULTS + """, g AS (
  SELECT * FROM o LEFT JOIN customer ON o_custkey = c_custkey
  LEFT JOIN nation ON c_nationkey = n_nationkey
  LEFT JOIN region ON n_regionkey = r_regionkey)"""

# Line items with all of that, and the part.
SPLITS = GEO + """, s AS (
  SELECT * FROM lineitem LEFT JOIN g ON l_orderkey = o_orderkey
  LEFT JOIN part ON l_partkey = p_partkey)"""


def case(name: str, sql: str | None = None):
    if sql is not None:
        sql = sql.replace("$RESULTS", RESULTS).replace("$GEO", GEO).replace("$SPLITS", SPLITS)

    def add(run):
        if name in CASES:
            raise ValueError(f"query {name} is registered twice")
        CASES[name] = Case(run, sql)
        return run

    return add


def rounded(frame: DataFrame, digits: int = 6, **special: int) -> DataFrame:
    """Round every double, so that the order of additions does not show."""
    return frame.select(
        *(
            F.round(f.name, special.get(f.name, digits)).alias(f.name)
            if isinstance(f.dataType, T.DoubleType)
            else F.col(f.name)
            for f in frame.schema
        )
    )
