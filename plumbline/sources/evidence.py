"""Nested result evidence: records that carry two sets of result rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

_ENDPOINT = T.StructType(
    [
        T.StructField("status", T.StringType()),
        T.StructField("complete", T.BooleanType()),
        T.StructField("result_sha256", T.StringType()),
        T.StructField("rows", T.ArrayType(T.VariantType())),
    ]
)


def evidence_schema(left: str, right: str) -> T.StructType:
    return T.StructType(
        [
            T.StructField("source_measure", T.StringType()),
            T.StructField("slice", T.StringType()),
            T.StructField("value_type", T.StringType()),
            T.StructField(left, _ENDPOINT),
            T.StructField(right, _ENDPOINT),
        ]
    )


def read_evidence(documents: DataFrame, text: str, left: str = "source", right: str = "target") -> DataFrame:
    """One row per record and side, its result rows still nested."""
    records = documents.select(
        F.from_json(text, evidence_schema(left, right), {"mode": "FAILFAST"}).alias("r")
    )
    sides = F.array(
        *(F.struct(F.lit(s).alias("side"), F.col(f"r.{s}").alias("e")) for s in (left, right))
    )
    return records.select(
        "r.source_measure", "r.slice", F.upper("r.value_type").alias("value_type"), F.explode(sides).alias("s")
    ).select(
        "source_measure",
        "slice",
        "value_type",
        "s.side",
        F.upper("s.e.status").alias("status"),
        F.col("s.e.complete").alias("complete"),
        F.col("s.e.result_sha256").alias("result_sha256"),
        F.col("s.e.rows").alias("rows"),
    )


def evidence_rows(endpoints: DataFrame) -> DataFrame:
    """One row per result cell of every available endpoint.

    ``coordinates`` is JSON with sorted keys and typed values, ``value`` the
    number as text, so 1, 1.0 and "1" stay apart.
    """
    return evidence_cells(endpoints).drop("kind")


def evidence_cells(endpoints: DataFrame) -> DataFrame:
    """The rows of ``evidence_rows`` with the ``kind`` of each value.

    INTEGER, DECIMAL and BLANK are valid; OTHER is anything else, or a row that
    is not made of coordinates and a value. 1.0 is DECIMAL though its text is
    1. Whole numbers of 19 digits and more count as INTEGER.
    """
    cells = endpoints.where((F.col("status") == "AVAILABLE") & F.col("complete")).select(
        "source_measure", "slice", "value_type", "side", F.explode("rows").alias("cell")
    )
    value = F.to_json(_value(F.col("cell")))
    return cells.select(
        "source_measure",
        "slice",
        "value_type",
        "side",
        F.to_json(_coordinates(F.col("cell"))).alias("coordinates"),
        F.when(value != "null", value).alias("value"),
        F.when(_is_row(F.col("cell")), _kind(F.col("cell"))).otherwise("OTHER").alias("kind"),
    )


def _value(row: Column) -> Column:
    return F.variant_get(row, "$.value", "variant")


def _coordinates(row: Column) -> Column:
    return F.variant_get(row, "$.coordinates", "variant")


def _is_row(row: Column) -> Column:
    """Whether a row has these two members and no other."""
    kind = F.schema_of_variant(row)
    two = kind.rlike("^OBJECT<coordinates: OBJECT<.*>, value: [^:]*>$")
    return two & F.schema_of_variant(_coordinates(row)).startswith("OBJECT<")


def _kind(row: Column) -> Column:
    kind = F.schema_of_variant(_value(row))
    return (
        F.when(kind.isNull() | (kind == "VOID"), "BLANK")
        .when((kind == "BIGINT") | kind.rlike(r"^DECIMAL\((19|[23]\d),0\)$"), "INTEGER")
        .when((kind == "DOUBLE") | kind.startswith("DECIMAL"), "DECIMAL")
        .otherwise("OTHER")
    )


def availability_errors(endpoints: DataFrame) -> DataFrame:
    """Endpoints whose status, completeness and rows contradict each other."""
    return endpoints.where(contradictory()).drop("rows")


def contradictory() -> Column:
    empty = F.coalesce(F.size("rows"), F.lit(0)) <= 0
    ok = ((F.col("status") == "AVAILABLE") & F.col("complete") & ~empty) | (
        (F.col("status") == "NOT_AVAILABLE") & ~F.col("complete") & empty
    )
    return ~F.coalesce(ok, F.lit(False))


def altered_endpoints(endpoints: DataFrame, rows_only: bool = False) -> DataFrame:
    """Available endpoints whose recorded hash is not the one of their rows.

    The hash is the SHA-256 of canonical JSON, over the rows alone or over the
    whole endpoint with a line end. Values from 1e16 on or below 1e-4 that are
    not integers, and coordinates that are, like 1.0, whole numbers with a
    point, have no canonical form here and count as altered.
    """
    return endpoints.where(altered(rows_only)).drop("rows")


def altered(rows_only: bool = False) -> Column:
    """Whether an available endpoint has another hash than its rows."""
    rows = F.concat(F.lit("["), F.concat_ws(",", F.transform("rows", _row_text)), F.lit("]"))
    if rows_only:
        text = rows
    else:
        text = F.concat(
            F.lit('{"complete":'),
            F.col("complete").cast("string"),
            F.lit(',"rows":'),
            rows,
            F.lit(',"status":"'),
            F.col("status"),
            F.lit('"}\n'),
        )
    same = F.sha2(text, 256) == F.col("result_sha256")
    return F.coalesce(F.col("status") == "AVAILABLE", F.lit(False)) & ~F.coalesce(same, F.lit(False))


def _row_text(row: Column) -> Column:
    """A row as canonical JSON; whole decimals keep their point."""
    value = F.to_json(_value(row))
    whole = (_kind(row) == "DECIMAL") & value.rlike(r"^-?\d+$")
    text = F.concat(
        F.lit('{"coordinates":'), F.to_json(_coordinates(row)), F.lit(',"value":'), value, F.when(whole, ".0").otherwise(""), F.lit("}")
    )
    return F.when(_is_row(row), text).otherwise(F.to_json(row))


def cell_errors(cells: DataFrame) -> DataFrame:
    """Cells whose value is neither a number nor blank."""
    return cells.where(F.col("value").isNotNull() & ~F.col("value").rlike(r"^-?[0-9]"))
