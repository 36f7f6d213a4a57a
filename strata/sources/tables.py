"""Archive tables as Parquet: the storage in which archives stay on a cluster."""

from __future__ import annotations

from pyspark.sql import SparkSession

from strata.operators.encode import TABLES, Archives


def write(archives: Archives, path: str, mode: str = "errorifexists") -> None:
    """One folder for each table; payloads are a column that queries on the
    table of contents needn't read."""
    for table in TABLES:
        getattr(archives, table).write.mode(mode).parquet(f"{path}/{table}")


def read(spark: SparkSession, path: str) -> Archives:
    return Archives(*(spark.read.parquet(f"{path}/{table}") for table in TABLES))
