"""Session settings and tables that cut lineage.

Results of long or repeated plans go to the folder that the cluster names in
``spark.checkpoint.dir``, so that a lost executor costs a re-read and not a
re-run.  Where the setting is missing and the master is local (tests, a laptop) a
folder under /tmp takes its place; on a cluster that is an error.  What a single scan yields is kept on the executors' disks instead:
if one is lost, its part of the scan runs again.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Only where driver and executors are one process.
FALLBACK_DIR = "/tmp/checkpoints/strata"


def local_session(cores: int | str = 8, memory: str = "8g", partitions: int = 8) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("strata")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and intermediate tables."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (named or FALLBACK_DIR).rstrip("/")


def materialize(df: DataFrame, name: str, tasks: int | None = None, row_group: int = 128 << 20) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    By default it is written by as many tasks as the cluster has cores at most,
    so that many nearly empty partitions don't become as many files; ``tasks``
    sets another number, 0 leaves the partitions as they are.  The files go when
    the JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    few = df if tasks == 0 else df.coalesce(tasks or spark.sparkContext.defaultParallelism)
    with _shuffles_removed(spark):
        few.write.option("parquet.block.size", row_group).parquet(path)
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def _shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """What a write has shuffled leaves the disks when it ends, not when the driver
    next collects garbage."""
    before = spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)


def kept(df: DataFrame) -> DataFrame:
    """Keep what a scan yields on the executors' disks, to read it again."""
    return df.persist(StorageLevel.DISK_ONLY)


def discard(df: DataFrame) -> None:
    """Delete what ``materialize`` wrote, once nothing reads it any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        place = jvm.org.apache.hadoop.fs.Path(folder)
        place.getFileSystem(conf).delete(place, True)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows over all cores, where the input has fewer partitions than the cluster
    has cores (a small file that can't be split); any other input stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *keys) if df.rdd.getNumPartitions() < cores else df


def columns_of(df: DataFrame) -> list[Column]:
    """The columns of ``df``, whatever signs their names hold."""
    return [F.col(f"`{c}`") for c in df.columns]


def row_key(df: DataFrame) -> list[Column]:
    """Two hashes of all columns (128 bits) that stand for a row; rows that are
    equal in all columns share them."""
    columns = columns_of(df)
    flags = [c.isNull() for c in columns]
    return [F.xxhash64(*columns, *flags), F.xxhash64(F.lit(1), *flags, *columns)]


#: Batches in the Parquet reader and on the way to Python.  The defaults (4096
#: rows; 10,000 rows or 64 MB) make large buffers where a row is a whole text.
TEXT_BATCHES = {
    "spark.sql.parquet.columnarReaderBatchSize": "512",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1024",
    "spark.sql.execution.arrow.maxBytesPerBatch": "8m",
}


def for_texts(spark: SparkSession) -> SparkSession:
    """The session with batches that suit tables of whole texts, where the caller
    hasn't set them."""
    own = spark.conf.getAll
    for key, value in TEXT_BATCHES.items():
        if key not in own:
            spark.conf.set(key, value)
    return spark


def read_table(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def read_texts(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table whose rows are whole texts."""
    return read_table(for_texts(spark), sf_dir, table)
