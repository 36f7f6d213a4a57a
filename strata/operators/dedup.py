"""Exact duplicates of chunks and files.

``scope`` says how far a chunk counts as a repeat: "file" compares the chunks of
one file, "corpus" those of all files in (file_id, offset) order.  Only keys and
sizes move; the bytes of a chunk are joined back to the rows that need them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.functions import fixed_values as V
from strata.functions.identity import file_checksum


def _keys(scope: str) -> list[str]:
    if scope not in ("file", "corpus"):
        raise ValueError(f"unknown scope {scope!r} (use 'file' or 'corpus')")
    return ["file_id", "chunk_id"] if scope == "file" else ["chunk_id"]


def first_place(scope: str) -> Column:
    return F.min(F.struct("file_id", "offset"))


def marked(cut: DataFrame, scope: str = "file") -> DataFrame:
    """``cut`` with ``is_new``: whether a row is the first of its chunk.

    A pre-aggregated minimum joined back, so a chunk that very many files share
    is no window of its own.
    """
    keys = _keys(scope)
    first = cut.groupBy(*keys).agg(first_place(scope).alias("_first"))
    return cut.join(first, keys).withColumn("is_new", F.struct("file_id", "offset") == F.col("_first")).drop("_first")


def store(cut: DataFrame) -> DataFrame:
    """The unique chunks of each file: index by first occurrence, length, first
    offset and ref_count."""
    rows = cut.groupBy("file_id", "chunk_id").agg(F.count(F.lit(1)).alias("ref_count"), F.min("offset").alias("first_offset"), F.min("length").alias("length"))
    order = Window.partitionBy("file_id").orderBy("first_offset")
    return rows.withColumn("index", (F.row_number().over(order) - 1).cast("long"))


def get(stored: DataFrame, chunk: str) -> DataFrame:
    return stored.filter(F.col("chunk_id") == chunk)


def get_by_index(stored: DataFrame, index: int) -> DataFrame:
    return stored.filter(F.col("index") == index)


def is_empty(stored: DataFrame) -> bool:
    return stored.isEmpty()


def in_order(stored: DataFrame) -> DataFrame:
    """The unique chunks by file and index, sorted over the whole table."""
    return stored.sort("file_id", "index")


def contained(cut: DataFrame, known: DataFrame) -> DataFrame:
    """Rows whose chunk is known."""
    return cut.join(known.select("chunk_id").distinct(), "chunk_id", "left_semi")


def missing(cut: DataFrame, known: DataFrame) -> DataFrame:
    """Rows whose chunk isn't known; decoding needs this to be empty."""
    return cut.join(known.select("chunk_id").distinct(), "chunk_id", "left_anti")


def file_stats(files: DataFrame, cut: DataFrame, lossless: bool = True) -> DataFrame:
    """Counts and bytes of each file's chunks, its share of repeated bytes and
    the way it will be stored: empty, single or chunked."""
    of_chunk = cut.groupBy("file_id", "chunk_id").agg(F.count(F.lit(1)).alias("n"), F.min("length").alias("length"))
    of_file = of_chunk.groupBy("file_id").agg(F.sum("n").alias("chunk_count"), F.count(F.lit(1)).alias("unique_chunks"), F.sum(F.col("n") * F.col("length")).alias("total_bytes"), F.sum((F.col("n") - 1) * F.col("length")).alias("duplicate_bytes"))
    rows = files.select("file_id").join(of_file, "file_id", "left").na.fill(0, ["chunk_count", "unique_chunks", "total_bytes", "duplicate_bytes"])
    share = F.when(F.col("total_bytes") > 0, F.col("duplicate_bytes").cast("double") / F.col("total_bytes")).otherwise(F.lit(0.0))
    single = share < F.lit(V.DEDUP_THRESHOLD) if lossless else F.lit(False)
    path = F.when(F.col("total_bytes") == 0, "empty").when(single, "single").otherwise("chunked")
    return rows.select("file_id", "chunk_count", "unique_chunks", (F.col("chunk_count") - F.col("unique_chunks")).alias("duplicate_chunks"), "total_bytes", "duplicate_bytes", share.alias("dedup_fraction"), path.alias("path"))


def duplicate_files(files: DataFrame) -> DataFrame:
    """Contents that several files have: checksum, first file and copies."""
    rows = files.select("file_id", file_checksum(F.col("content")).alias("checksum"))
    return rows.groupBy("checksum").agg(F.count(F.lit(1)).alias("copies"), F.min("file_id").alias("first_file")).filter("copies > 1")


def ratio(original: Column, compressed: Column) -> Column:
    return F.when(compressed == 0, F.lit(0.0)).otherwise(original.cast("double") / compressed)
