"""Command line: compress, decompress, inspect, verify and bench.

    python -m strata.cli compress PATH [-o FOLDER] [-m lossless|lossy] [-l fast|default|best] ...

PATH may name many files; each becomes an archive of its own.
"""

from __future__ import annotations

import argparse
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.errors import InvalidArchive, StrataError
from strata.functions import fixed_values as V
from strata.operators import decode, encode
from strata.operators.dedup import ratio
from strata.sources import archive_file
from strata.sources.files import read_files
from strata.spark import kept


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="strata")
    sub = top.add_subparsers(dest="command", required=True)
    c = sub.add_parser("compress", aliases=["c"])
    c.add_argument("input")
    c.add_argument("-o", "--output")
    c.add_argument("-m", "--mode", default="lossless", choices=["lossless", "lossy"])
    c.add_argument("-l", "--level", default="default", choices=list(V.ZSTD_LEVEL))
    c.add_argument("--fidelity", type=float, default=0.95)
    c.add_argument("--stratum-threshold", type=int, default=2)
    c.add_argument("--manifest", action="store_true")
    c.add_argument("--certificates", action="store_true")
    c.add_argument("--verify", action="store_true")
    d = sub.add_parser("decompress", aliases=["d"])
    d.add_argument("input")
    d.add_argument("-o", "--output")
    d.add_argument("--verify", action="store_true", help="write nothing if an archive is damaged")
    i = sub.add_parser("inspect", aliases=["i"])
    i.add_argument("archive")
    i.add_argument("--chunks", action="store_true")
    i.add_argument("--manifest", action="store_true")
    v = sub.add_parser("verify", aliases=["v"])
    v.add_argument("archive")
    b = sub.add_parser("bench", aliases=["b"])
    b.add_argument("input")
    for s in (c, d, i, v, b):
        s.add_argument("-v", "--verbose", action="store_true")
    return top


def config(args: argparse.Namespace) -> encode.CompressConfig:
    return encode.CompressConfig(mode=args.mode, level=args.level, stratum_threshold=args.stratum_threshold, min_fidelity=args.fidelity, emit_manifest=args.manifest, emit_certificates=args.certificates, verify_on_compress=args.verify)


def bench(files: DataFrame) -> DataFrame:
    """Size, ratio and seconds of each level."""
    spark, rows = files.sparkSession, []
    for level in V.ZSTD_LEVEL:
        began = time.time()
        made = encode.compress(files, encode.CompressConfig(level=level))
        original, packed = made.stats.agg(F.sum("original_size"), F.sum("compressed_size")).first()
        packing, began = time.time() - began, time.time()
        decode.decompress(made).select(F.sum(F.octet_length("content"))).collect()
        rows.append((level, original or 0, packed or 0, packing, time.time() - began))
        made.release()
    out = spark.createDataFrame(rows, "level string, original long, compressed long, compress_s double, decompress_s double")
    return out.withColumn("ratio", ratio(F.col("original"), F.col("compressed")))


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("strata").getOrCreate()
    show = lambda df: df.show(1000, truncate=False)
    try:
        if args.command in ("compress", "c"):
            made = encode.compress(read_files(spark, args.input), config(args))
            archive_file.write_archives(made, args.output or args.input + V.EXTENSION)
            show(made.stats.withColumn("ratio", ratio(F.col("original_size"), F.col("compressed_size"))))
            made.release()
        elif args.command in ("decompress", "d"):
            out = kept(decode.decompress(archive_file.read_archives(spark, args.input)))
            bad = out.filter(~F.col("status").isin("ok", "skipped_lossy")).select("file_id", "status").first()
            if bad and args.verify:
                raise InvalidArchive(f"{bad['file_id']}: {bad['status']}")
            stem = args.input.removesuffix("/")
            folder = args.output or (stem.removesuffix(V.EXTENSION) if stem.endswith(V.EXTENSION) else stem + ".out")
            name = F.regexp_replace(F.regexp_extract("file_id", "[^/]*$", 0), f"\\{V.EXTENSION}$", "")
            names = out.withColumn("file_id", F.coalesce(F.try_url_decode(name), name))
            archive_file.write_files(names, folder)
            show(out.groupBy("status", "is_lossy").agg(F.count(F.lit(1)).alias("files"), F.sum(F.octet_length("content")).alias("original_size"), F.sum("chunks").alias("chunks")))
            out.unpersist()
        elif args.command in ("inspect", "i"):
            read = archive_file.read_archives(spark, args.archive)
            show(read.manifests if args.manifest else decode.inspect(read))
            if args.chunks and not args.manifest:
                show(decode.inspect_chunks(read))
        elif args.command in ("verify", "v"):
            out = decode.verify(archive_file.read_archives(spark, args.archive))
            show(out)
            return int(out.filter(~F.col("status").isin("ok", "skipped_lossy")).count() > 0)
        else:
            show(bench(read_files(spark, args.input)))
    except StrataError as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
