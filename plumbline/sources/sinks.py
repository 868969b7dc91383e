"""Writers for result sets and findings."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_results(long: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Long metric results, one folder per metric."""
    long.write.mode(mode).partitionBy("metric").parquet(path)


def write_findings(findings: DataFrame, path: str, format: str = "parquet", mode: str = "errorifexists") -> None:
    findings.write.mode(mode).format(format).save(path)
