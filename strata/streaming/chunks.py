"""Chunk deduplication of files as they arrive, with Structured Streaming.

Each micro-batch is chunked; chunks that no earlier batch brought are stored, and
every occurrence goes to the file map.  What is known is the stored table itself,
so the state is as durable as the table, and a batch that is run again after a
failure replaces what it wrote the first time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from strata.operators.chunking import ChunkParams, chunks

STORED = "chunk_id string, length long, data binary, batch long"


def ingest(batch: DataFrame, number: int, path: str, params: ChunkParams = ChunkParams()) -> None:
    """One micro-batch of (file_id, content) into ``path``."""
    spark = batch.sparkSession
    cut = chunks(batch, params).persist()
    store, places = f"{path}/store", f"{path}/file_map"
    known = stored(spark, path).filter(F.col("batch") != number).select("chunk_id")
    new = cut.groupBy("chunk_id").agg(F.first("length").alias("length"), F.first("data").alias("data")).join(known, "chunk_id", "left_anti")
    new.write.mode("overwrite").parquet(f"{store}/batch={number}")
    cut.select("file_id", "seq", "offset", "length", "chunk_id").write.mode("overwrite").parquet(f"{places}/batch={number}")
    cut.unpersist()


def stored(spark: SparkSession, path: str) -> DataFrame:
    """The unique chunks so far; none before the first batch."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(f"{path}/store")
    if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], STORED)
    return spark.read.schema(STORED).parquet(f"{path}/store")


def start(files: DataFrame, path: str, params: ChunkParams = ChunkParams(), available_now: bool = True) -> StreamingQuery:
    """Run ``ingest`` on a streaming DataFrame (file_id, content)."""
    writer = files.writeStream.foreachBatch(lambda batch, n: ingest(batch, n, path, params)).option("checkpointLocation", f"{path}/checkpoint")
    return (writer.trigger(availableNow=True) if available_now else writer).start()
