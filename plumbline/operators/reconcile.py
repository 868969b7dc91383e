"""Reconciliation of result sets, coordinate by coordinate."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from plumbline.operators.attach import align, attach
from plumbline.sources.evidence import altered, contradictory, evidence_cells, evidence_rows

# Fixed tolerance of decimal values, absolute and relative.
TOLERANCE = 1e-9
PASSED, FAILED, NOT_AVAILABLE = "PASSED", "FAILED", "NOT_AVAILABLE"
REFUSED = "REFUSED"


def numbers_match(left: Column, right: Column) -> Column:
    """Doubles within tolerance; two blanks match, one does not; a value that
    is not finite never matches."""
    gap = F.abs(left - right)
    scale = F.greatest(F.abs(left), F.abs(right))
    close = gap <= F.greatest(F.lit(TOLERANCE), scale * F.lit(TOLERANCE))
    return (
        F.when(left.isNull() | right.isNull(), left.isNull() & right.isNull())
        .when(_finite(left) & _finite(right), close)
        .otherwise(False)
    )


def _finite(value: Column) -> Column:
    return ~F.isnan(value) & (F.abs(value) != F.lit(float("inf")))


def is_whole(kind: T.DataType) -> bool:
    return isinstance(kind, T.IntegralType) or (isinstance(kind, T.DecimalType) and kind.scale == 0)


def values_match(left: Column, right: Column, left_type: T.DataType, right_type: T.DataType) -> Column:
    """Typed numbers: two integers compare exactly, anything else within tolerance."""
    if is_whole(left_type) and is_whole(right_type):
        return left.eqNullSafe(right)
    return numbers_match(left.cast("double"), right.cast("double"))


def texts_match(value_type: Column, left: Column, right: Column) -> Column:
    """Numbers given as JSON text. Two integers compare exactly even under a
    decimal label; under an integer label anything else is no match."""
    whole = r"^-?\d+$"
    integers = left.rlike(whole) & right.rlike(whole)
    exact = left.try_cast("decimal(38,0)") == right.try_cast("decimal(38,0)")
    decimals = numbers_match(left.try_cast("double"), right.try_cast("double"))
    numeric = left.try_cast("double").isNotNull() & right.try_cast("double").isNotNull()
    return (
        F.when(left.isNull() | right.isNull(), left.isNull() & right.isNull())
        .when(integers, F.coalesce(exact, left == right))
        .when(value_type == "INTEGER", False)
        .otherwise(numeric & decimals)
    )


def compare_cells(
    left: DataFrame, right: DataFrame, keys: Sequence[str], value: str = "value", whole: str = "whole"
) -> DataFrame:
    """Full outer match of two result sets with one verdict per coordinate:
    MATCH, DIFFERENT, ONLY_LEFT or ONLY_RIGHT.

    Integer columns compare exactly. Where both sides have a column ``whole``,
    as long results do, it decides for the rows where either side fills it.
    """
    typed = whole in left.columns and whole in right.columns
    sides = []
    for side, frame in (("left", left), ("right", right)):
        extra = [F.col(whole).alias(f"__{side}_whole")] if typed else []
        sides.append(frame.select(*keys, F.col(value).alias(f"{side}_value"), *extra))
    both = align(*sides, keys)
    kinds = [frame.schema[value].dataType for frame in (left, right)]
    matches = values_match(F.col("left_value"), F.col("right_value"), *kinds)
    if typed:
        ours, theirs = F.col("__left_whole"), F.col("__right_whole")
        matches = F.when(ours.isNotNull() | theirs.isNotNull(), ours.eqNullSafe(theirs)).otherwise(matches)
    verdict = (
        F.when(~F.col("in_right"), "ONLY_LEFT")
        .when(~F.col("in_left"), "ONLY_RIGHT")
        .when(matches, "MATCH")
        .otherwise("DIFFERENT")
    )
    if not all(map(is_whole, kinds)):
        both = both.withColumns({f"{s}_value": F.col(f"{s}_value").cast("double") for s in ("left", "right")})
    return both.select(*keys, "left_value", "right_value", verdict.alias("verdict"))


def summarise_cells(cells: DataFrame, group: Sequence[str]) -> DataFrame:
    """Status per group: NOT_AVAILABLE when a side has no cell at all, FAILED
    with one mismatch, else PASSED. The mismatching coordinates stay rows of
    ``cells``; only counts are gathered."""
    bad = F.count_if(F.col("verdict") != "MATCH")
    left = F.count_if(F.col("verdict") != "ONLY_RIGHT")
    right = F.count_if(F.col("verdict") != "ONLY_LEFT")
    return cells.groupBy(*group).agg(
        F.count("*").alias("cells"),
        bad.alias("mismatches"),
        F.when((left == 0) | (right == 0), NOT_AVAILABLE)
        .when(bad > 0, FAILED)
        .otherwise(PASSED)
        .alias("status"),
    )


def duplicate_coordinates(results: DataFrame, keys: Sequence[str]) -> DataFrame:
    return results.groupBy(*keys).agg(F.count("*").alias("copies")).where("copies > 1")


def overall_errors(results: DataFrame, group: Sequence[str], overall: str = "OVERALL") -> DataFrame:
    """Groups whose overall slice does not hold exactly one row."""
    rows = F.count_if(F.col("slice") == overall)
    return results.groupBy(*group).agg(rows.alias("overall_rows")).where("overall_rows <> 1")


def compare_evidence(endpoints: DataFrame, left: str = "source", right: str = "target") -> DataFrame:
    """Verdict per coordinate of nested result evidence, values as text."""
    cells = evidence_rows(endpoints)
    keys = ["source_measure", "slice", "coordinates"]
    sides = [
        cells.where(F.col("side") == side).select(
            *keys, F.col("value").alias(f"v{i}"), F.col("value_type").alias(f"t{i}")
        )
        for i, side in enumerate((left, right))
    ]
    both = align(*sides, keys)
    verdict = (
        F.when(~F.col("in_right"), "ONLY_LEFT")
        .when(~F.col("in_left"), "ONLY_RIGHT")
        .when(texts_match(F.col("t0"), F.col("v0"), F.col("v1")), "MATCH")
        .otherwise("DIFFERENT")
    )
    return both.select(*keys, verdict.alias("verdict"))


def evidence_status(endpoints: DataFrame, cells: DataFrame) -> DataFrame:
    """Status per record: NOT_AVAILABLE unless both sides are there, FAILED
    with one mismatch, else PASSED."""
    keys = ["source_measure", "slice"]
    there = endpoints.groupBy(*keys).agg(
        (F.count_if((F.col("status") == "AVAILABLE") & F.col("complete")) == F.count("*")).alias("__both")
    )
    counts = cells.groupBy(*keys).agg(F.count_if(F.col("verdict") != "MATCH").alias("mismatches"))
    status = (
        F.when(~F.col("__both"), NOT_AVAILABLE).when(F.col("mismatches") > 0, FAILED).otherwise(PASSED)
    )
    joined = attach(there, counts, keys)
    return joined.select(
        *keys, F.when(F.col("__both"), F.col("mismatches")).alias("mismatches"), status.alias("status")
    )


def gated_evidence(
    endpoints: DataFrame, left: str = "source", right: str = "target", rows_only: bool = False
) -> DataFrame:
    """Status per record, faulty evidence refused before it is compared.

    ``faults`` lists, in this order and comma-joined, what makes a record
    REFUSED: AVAILABILITY (status, completeness, rows and hash contradict each
    other, or a side is not there once), HASH (the recorded one is not that of
    the rows), LABEL (neither INTEGER nor DECIMAL), ROW (a row that is not made
    of coordinates and a number or blank), DUPLICATE (a coordinate twice on one
    side), TYPE (a value with a point under an INTEGER label, where the other
    side has a value too). Records that have no fault are NOT_AVAILABLE, FAILED
    or PASSED. Cells meet by one aggregation per coordinate, without a join.
    """
    record = ["source_measure", "slice"]
    hash_left = (F.col("status") == "NOT_AVAILABLE") & F.col("result_sha256").isNotNull()
    sides = F.count_if(F.col("side") == left), F.count_if(F.col("side") == right)
    known = F.coalesce(F.col("value_type").isin("INTEGER", "DECIMAL"), F.lit(False))
    there = endpoints.groupBy(*record).agg(
        (F.bool_or(contradictory() | F.coalesce(hash_left, F.lit(False))) | (sides[0] != 1) | (sides[1] != 1)).alias("AVAILABILITY"),
        F.bool_or(altered(rows_only)).alias("HASH"),
        (F.bool_or(~known) | (F.count_distinct("value_type") > 1)).alias("LABEL"),
        F.bool_and(F.coalesce((F.col("status") == "AVAILABLE") & F.col("complete"), F.lit(False))).alias("__both"),
    )
    mine, theirs = F.col("side") == left, F.col("side") == right
    pick = lambda column, side: F.max(F.when(side, F.col(column)))
    # A whole number with a point is no integer, so it is compared within tolerance.
    point = (F.col("kind") == "DECIMAL") & F.col("value").rlike(r"^-?\d+$")
    cells = evidence_cells(endpoints).withColumn("value", F.when(point, F.concat("value", F.lit(".0"))).otherwise(F.col("value")))
    at = cells.groupBy(*record, "coordinates").agg(
        F.count_if(mine).alias("n0"),
        F.count_if(theirs).alias("n1"),
        pick("value", mine).alias("v0"),
        pick("value", theirs).alias("v1"),
        F.max("value_type").alias("t"),
        F.bool_or(F.col("kind") == "OTHER").alias("odd"),
        F.bool_or(F.col("kind") == "DECIMAL").alias("point"),
    )
    both = (F.col("n0") > 0) & (F.col("n1") > 0)
    wrong = F.col("v0").isNotNull() & F.col("v1").isNotNull() & both & (F.col("t") == "INTEGER") & F.col("point")
    counts = at.groupBy(*record).agg(
        F.count_if(~both | ~texts_match(F.col("t"), F.col("v0"), F.col("v1"))).alias("mismatches"),
        F.bool_or("odd").alias("ROW"),
        F.bool_or((F.col("n0") > 1) | (F.col("n1") > 1)).alias("DUPLICATE"),
        F.bool_or(wrong).alias("TYPE"),
    )
    names = ("AVAILABILITY", "HASH", "LABEL", "ROW", "DUPLICATE", "TYPE")
    joined = attach(there, counts, record)
    joined = joined.withColumn("faults", F.concat_ws(",", *(F.when(F.col(n), n) for n in names)))
    status = (
        F.when(F.col("faults") != "", REFUSED)
        .when(~F.col("__both"), NOT_AVAILABLE)
        .when(F.col("mismatches") > 0, FAILED)
        .otherwise(PASSED)
    )
    compared = (F.col("faults") == "") & F.col("__both")
    return joined.select(*record, F.when(compared, F.col("mismatches")).alias("mismatches"), "faults", status.alias("status"))


def missing_groupings(observed: DataFrame, expected: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Declared grouping sets that no result row shows."""
    seen = observed.select(*keys).distinct()
    return expected.join(seen, list(keys), "left_anti")


def slice_coverage(required: DataFrame, observed: DataFrame) -> DataFrame:
    """Status per required (metric, slice); one that was not seen is
    NOT_AVAILABLE."""
    seen = observed.select("metric", "slice", F.col("status").alias("__seen"))
    return (
        attach(required, seen, ["metric", "slice"])
        .withColumn("status", F.coalesce("__seen", F.lit(NOT_AVAILABLE)))
        .drop("__seen")
    )


def roll_up_status(per_slice: DataFrame, group: Sequence[str] = ("metric",)) -> DataFrame:
    """Any failure fails; passing needs every slice to pass."""
    status = (
        F.when(F.count_if(F.col("status") == FAILED) > 0, FAILED)
        .when(F.count_if(F.col("status") != PASSED) == 0, PASSED)
        .otherwise(NOT_AVAILABLE)
    )
    return per_slice.groupBy(*group).agg(F.count("*").alias("slices"), status.alias("status"))


def fingerprint(results: DataFrame, group: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Row count and order-free sum of row hashes; equal results have equal
    fingerprints, and duplicates count. The hash skips blanks, so which
    columns are blank is hashed too."""
    row = F.xxhash64(*columns, *(F.col(c).isNull() for c in columns)).cast("decimal(38,0)")
    return results.groupBy(*group).agg(
        F.count("*").alias("rows"), F.sum(row).cast("string").alias("hash_sum")
    )


def stale(current: DataFrame, recorded: DataFrame, group: Sequence[str]) -> DataFrame:
    """Groups whose recorded fingerprint is gone or no longer matches."""
    old = recorded.select(*group, F.col("rows").alias("__rows"), F.col("hash_sum").alias("__hash"))
    both = align(current, old, list(group))
    same = (F.col("rows") == F.col("__rows")) & (F.col("hash_sum") == F.col("__hash"))
    return both.where(~F.coalesce(same, F.lit(False))).select(*group)


def three_way(
    source: DataFrame, repository: DataFrame, third: DataFrame, keys: Sequence[str], value: str = "value"
) -> DataFrame:
    """Source against repository, and the third system where it has a value.

    Missing source or repository values make a coordinate NOT_AVAILABLE. Three
    integer columns compare exactly.
    """
    sides = {"source": source, "repository": repository, "third": third}
    exact = all(is_whole(f.schema[value].dataType) for f in sides.values())
    frames = [
        f.select(
            *keys,
            (F.col(value) if exact else F.col(value).cast("double")).alias(n),
            F.lit(True).alias(f"has_{n}"),
        )
        for n, f in sides.items()
    ]
    match = Column.eqNullSafe if exact else numbers_match
    both = align(align(frames[0], frames[1], keys).drop("in_left", "in_right"), frames[2], keys)
    available = F.coalesce(F.col("has_source") & F.col("has_repository"), F.lit(False))
    agrees = match(F.col("source"), F.col("repository")) & (
        F.col("has_third").isNull() | match(F.col("third"), F.col("repository"))
    )
    status = F.when(~available, NOT_AVAILABLE).when(agrees, PASSED).otherwise(FAILED)
    return both.select(*keys, *sides, status.alias("status"))


def expected_pairs(spark, required: Mapping[str, Sequence[str]]) -> DataFrame:
    rows = [(metric, name) for metric, names in required.items() for name in names]
    return spark.createDataFrame(rows, "metric string, slice string")
