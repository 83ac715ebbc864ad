"""Add requests from files or a stream of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from mnemospark.schemas import REQUEST


def read_requests(spark: SparkSession, path: str, format: str = "json", stream: bool = False) -> DataFrame:
    """Request rows in the fixed schema; columns that files lack are null, others are not read."""
    reader = spark.readStream if stream else spark.read
    return reader.schema(REQUEST).format(format).load(path)
