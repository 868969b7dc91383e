"""Tables and files that all executors see."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new folder name under `spark.checkpoint.dir`; a local session without that setting uses a temporary one."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="plumbline-")
    return f"{base.rstrip('/')}/llm-{uuid.uuid4().hex}"


def saved(frame: DataFrame, folder: str, name: str) -> DataFrame:
    """The rows, written as Parquet and read again: later jobs start from files that outlive executors."""
    frame.write.parquet(f"{folder}/{name}")
    return frame.sparkSession.read.schema(frame.schema).parquet(f"{folder}/{name}")


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Sends at most so many rows at once to a Python worker, so that long texts fit beside everything else."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
