"""CSV rows with typed cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import types as T


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Headed CSV; an empty cell is blank, true / false in any case is boolean.

    Cells that do not fit their declared type fail the read: the file is
    declared, not guessed.
    """
    text = T.StructType([T.StructField(f.name, T.StringType()) for f in schema])
    raw = (
        spark.read.schema(text)
        .option("header", True)
        .option("enforceSchema", False)
        .option("nullValue", "")
        .option("mode", "FAILFAST")
        .csv(path)
    )
    return raw.select(*(_cell(F.col(f.name), f.dataType).alias(f.name) for f in schema))


def _cell(cell: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.BooleanType):
        word = F.lower(F.btrim(cell))
        # Other words that a cast would take for a boolean fail like any misfit.
        return F.when(word.isin("true", "false"), word == "true").when(
            word.isNotNull(), F.raise_error(F.concat(F.lit("not a boolean: "), cell)).cast(kind)
        )
    return cell.cast(kind)
