"""Inputs as rows (file_id, content)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.spark import read_table, spread


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Whole files; the path is the id.

    Spark's reader passes over empty files; they come from its list of files, which
    the driver holds in any case to plan a scan.  Paths alone are compared with it.
    """
    read = spark.read.format("binaryFile").load(path)
    listed = spark.createDataFrame([(f,) for f in read.inputFiles()], "file_id string")
    listed = listed.select(F.regexp_replace("file_id", "^([a-z0-9]+):///", "$1:/").alias("file_id"))
    empty = listed.join(read.select(F.col("path").alias("file_id")), "file_id", "left_anti").withColumn("content", F.lit(b""))
    return read.select(F.col("path").alias("file_id"), "content").unionByName(empty)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"), "text"), "file_id").select("file_id", F.encode("text", "UTF-8").alias("content"))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(read_table(spark, sf_dir, "pages").select(F.col("page_id").alias("file_id"), "html"), "file_id").select("file_id", F.encode("html", "UTF-8").alias("content"))


def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("file_id"), F.encode("text", "UTF-8").alias("content"))


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns of a conversation, one after the other."""
    rows = read_table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("turns"))
    text = F.array_join(F.transform("turns", lambda t: t["text"]), "\n")
    return rows.select(F.col("conv_id").alias("file_id"), F.encode(text, "UTF-8").alias("content"))


@F.arrow_udf(T.BinaryType())
def float_bytes(vectors):
    """Little-endian 32-bit floats, one after the other."""
    import pyarrow as pa

    return pa.array([v.values.to_numpy(zero_copy_only=False).astype("<f4").tobytes() if v.is_valid else None for v in vectors], pa.binary())


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("file_id"), float_bytes("embedding").alias("content"))
