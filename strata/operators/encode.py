"""Compression as a data flow: files to the tables of an archive.

    files -> chunks -> repeats, classes, near-duplicates -> codec -> tables

Every file takes one of three ways: empty, one frame for the whole file, or
chunks with a shared dictionary.  The result is a set of tables that hold one
archive for each file.

Scale: chunks move by file and chunk id; the bytes of a unique chunk are encoded
where its row is.  The near-duplicate search is left out of the plan at level
``fast``.  Tables that several others are made from are kept on the executors'
disks.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.functions import fixed_values as V
from strata.functions.histogram import BINS, profiled, summary
from strata.functions.identity import chunk_id, file_checksum, short, urn
from strata.operators import codecs
from strata.operators.chunking import ChunkParams, chunks
from strata.operators.dedup import file_stats
from strata.operators.similarity import best_bases, numbered
from strata.spark import kept


@dataclass(frozen=True)
class CompressConfig:
    """``mode`` is lossless or lossy; ``min_fidelity`` is accepted and has no
    effect on the result, which states the fidelity it reached."""

    mode: str = "lossless"
    level: str = "default"
    chunk_params: ChunkParams = field(default_factory=ChunkParams)
    stratum_threshold: int = 2
    min_fidelity: float = 0.95
    emit_manifest: bool = False
    emit_certificates: bool = False
    verify_on_compress: bool = False

    def __post_init__(self):
        if self.mode not in ("lossless", "lossy"):
            raise ValueError(f"{self.mode!r} is no mode; choose lossless or lossy")
        if self.level not in V.ZSTD_LEVEL:
            raise ValueError(f"{self.level!r} is no level; choose one of {', '.join(V.ZSTD_LEVEL)}")

    @property
    def lossy(self) -> bool:
        return self.mode == "lossy"


TABLES = ("archives", "toc", "file_map", "dictionaries", "derivations", "manifests", "stats")


@dataclass(frozen=True)
class Archives:
    """Tables with one archive for each file_id."""

    archives: DataFrame
    toc: DataFrame
    file_map: DataFrame
    dictionaries: DataFrame
    derivations: DataFrame
    manifests: DataFrame
    stats: DataFrame
    held: tuple[DataFrame, ...] = field(default=(), repr=False, compare=False)

    def named(self, file_id: Column) -> Archives:
        """The same archives under other ids, which must stay different."""
        return Archives(*(getattr(self, t).withColumn("file_id", file_id) for t in TABLES), self.held)

    def release(self) -> None:
        """Free what the tables are made from on the executors' disks, once they
        have been written."""
        for df in self.held:
            df.unpersist()


def standard_route(kind: Column, level: str) -> tuple[Column, Column]:
    """(codec, zstd level) by class, before anything is encoded."""
    other = "Lz4" if level == "fast" else "Zstd"
    codec = F.when(kind == V.RANDOM, "Lz4").when(kind == V.SPARSE, "Zstd").otherwise(other)
    return codec, F.when(kind == V.SPARSE, V.SPARSE_LEVEL).otherwise(V.ZSTD_LEVEL[level])


def route(kind: Column, has_base: Column, config: CompressConfig) -> tuple[Column, Column]:
    """(codec, zstd level) of a unique chunk: a near-duplicate is a delta in any
    mode; structured and dense chunks of a lossy archive are quantized."""
    codec, level = standard_route(kind, config.level)
    if config.lossy:
        quantize = kind.isin(V.STRUCTURED, V.DENSE)
        codec, level = F.when(quantize, "Quantized").otherwise(codec), F.when(quantize, V.QUANTIZED_LEVEL).otherwise(level)
    return F.when(has_base, "Delta").otherwise(codec), F.when(has_base, V.ZSTD_LEVEL[config.level]).otherwise(level)


def _encode(threshold: int):
    """Adds (tag, payload) to (..., codec, level, data, dictionary, base).  A row
    without a codec brings the dictionary of the rows behind it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dictionary = None
        for b in batches:
            at = {n: b.schema.get_field_index(n) for n in ("codec", "level", "data", "dictionary", "base")}
            codec_of, level_of = (b.column(at[n]).to_pylist() for n in ("codec", "level"))
            tags, payloads, rows = [], [], []
            for i, (codec, level) in enumerate(zip(codec_of, level_of, strict=True)):
                if codec is None:
                    dictionary = b.column(at["dictionary"])[i].as_py()
                    continue
                tag, data, base = codecs.TAGS[codec], b.column(at["data"])[i].as_py(), b.column(at["base"])[i].as_py()
                payload = codecs.encode_bytes(tag, data, level=level, dictionary=dictionary, base=base, threshold=threshold)
                if codec not in ("Delta", "Quantized") and len(payload) >= len(data):
                    tag, payload = codecs.TAGS["Identity"], data
                rows.append(i)
                tags.append(tag)
                payloads.append(payload)
            keep = [i for i, n in enumerate(b.schema.names) if n not in at]
            names = [b.schema.names[i] for i in keep]
            chosen = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(i).take(chosen) for i in keep), pa.array(tags, pa.int32()), pa.array(payloads, pa.binary())], names=[*names, "tag", "payload"])

    return run


def encoded_rows(rows: DataFrame, threshold: int = 2, dictionaries: DataFrame | None = None) -> DataFrame:
    """``rows`` encoded; each file's dictionary goes to its task once, ahead of the
    file's chunks."""
    spent = {"codec", "level", "data", "dictionary", "base"}
    fields = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes if n not in spent)
    rows = rows.withColumn("dictionary", F.lit(None).cast("binary"))
    if dictionaries is not None:
        first = dictionaries.select("file_id", F.lit(-1).cast("long").alias("useq"), "dictionary")
        rows = rows.unionByName(first, allowMissingColumns=True).repartition("file_id").sortWithinPartitions("file_id", "useq")
    return rows.mapInArrow(_encode(threshold), f"{fields}, tag int, payload binary")


def class_name(kind: Column, base: Column, fidelity: Column) -> Column:
    """The class as certificates spell it."""
    number = F.when(fidelity == F.lit(1.0), "1.0").otherwise(fidelity.cast("string"))
    near = F.concat(F.lit("NearDuplicate { base: ChunkId("), short(base), F.lit("), fidelity: "), number, F.lit(" }"))
    return F.when(base.isNotNull(), near).otherwise(kind)


def unique_chunks(cut: DataFrame, config: CompressConfig) -> DataFrame:
    """Each file's unique chunks with class, base and its bytes, and route."""
    unique = numbered(cut)
    rows = profiled(unique)
    if config.level == "fast":
        none = F.lit(None)
        rows = rows.withColumns({"base_chunk_id": none.cast("string"), "fidelity": none.cast("double"), "base": none.cast("binary")})
    else:
        found = best_bases(unique).select("file_id", "useq", "base_chunk_id", "base_useq", "fidelity")
        originals = unique.select("file_id", F.col("useq").alias("base_useq"), F.col("data").alias("base"))
        rows = rows.join(found.join(originals, ["file_id", "base_useq"]).drop("base_useq"), ["file_id", "useq"], "left")
    codec, level = route(F.col("class"), F.col("base_chunk_id").isNotNull(), config)
    return rows.withColumn("codec", codec).withColumn("level", level)


def compress(files: DataFrame, config: CompressConfig = CompressConfig()) -> Archives:
    """Archive every row of (file_id, content); a null content is an empty file."""
    files = files.select("file_id", F.coalesce(F.col("content").cast("binary"), F.lit(b"")).alias("content"))
    cut = kept(chunks(files, config.chunk_params))
    plans = file_stats(files, cut, not config.lossy)
    by_path = kept(files.join(plans, "file_id"))
    whole = F.octet_length("content").cast("long")
    base = by_path.select("file_id", "path", whole.alias("original_size"), file_checksum(F.col("content")).alias("checksum"), "chunk_count", "unique_chunks", "duplicate_chunks")

    single = by_path.filter("path = 'single'").select("file_id", F.lit("Zstd").alias("codec"), F.lit(V.ZSTD_LEVEL[config.level]).alias("level"), F.col("content").alias("data"), F.lit(None).cast("binary").alias("base"))
    frames = kept(encoded_rows(single, config.stratum_threshold))

    chunked = by_path.filter("path = 'chunked'").select("file_id", codecs.dictionary(F.col("content")).alias("dictionary"))
    dictionaries = kept(chunked)
    occurrences = cut.join(dictionaries.select("file_id"), "file_id", "left_semi")
    rows = unique_chunks(occurrences, config).select("file_id", "useq", "chunk_id", "length", "class", *BINS, "base_chunk_id", "fidelity", "codec", "level", "data", "base")
    coded = kept(encoded_rows(rows, config.stratum_threshold, dictionaries))

    size = F.octet_length("payload").cast("long")
    prefix = coded.join(dictionaries.select("file_id", (F.lit(V.HEADER_BYTES + 4) + F.octet_length("dictionary")).cast("long").alias("start")), "file_id")
    running = F.sum(size).over(Window.partitionBy("file_id").orderBy("useq").rowsBetween(Window.unboundedPreceding, 0)) - size
    toc = prefix.select(
        "file_id", "useq", "chunk_id", "tag", (F.col("start") + running).alias("data_offset"), size.alias("compressed_size"), F.col("length").alias("original_size"),
        "base_chunk_id", summary().alias("stratum_summary"), "class", "fidelity", "payload",
    )
    of_single = frames.select("file_id", F.lit(0).cast("long").alias("useq"), F.lit(None).cast("string").alias("chunk_id"), "tag", F.lit(V.HEADER_BYTES).cast("long").alias("data_offset"), size.alias("compressed_size"), F.lit(None).cast("long").alias("original_size"), F.lit(None).cast("string").alias("base_chunk_id"), F.lit(None).cast("array<int>").alias("stratum_summary"), F.lit(None).cast("string").alias("class"), F.lit(None).cast("double").alias("fidelity"), "payload")
    file_map = occurrences.select("file_id", "seq", F.col("offset").alias("file_offset"), "chunk_id", "length")

    derivations = certificates(coded, config) if config.emit_certificates else None
    flags = (
        F.when(F.col("path") == "empty", V.HAS_MANIFEST if config.emit_manifest else 0)
        .when(F.col("path") == "single", V.SINGLE_STREAM)
        .otherwise(V.HAS_DICTIONARY | (V.LOSSY if config.lossy else 0) | (V.HAS_MANIFEST if config.emit_manifest else 0) | (V.HAS_CERTIFICATES if config.emit_certificates else 0))
    )
    sums = toc.unionByName(of_single).groupBy("file_id").agg(F.sum("compressed_size").alias("payload_bytes"), F.sum(F.when(F.col("base_chunk_id").isNotNull(), 91).otherwise(59)).alias("toc_bytes"), F.count("base_chunk_id").alias("delta_chunks"), F.max(F.when(F.col("chunk_id").isNull(), F.col("tag"))).alias("single_tag"))
    headers = base.join(sums, "file_id", "left").join(dictionaries.select("file_id", F.octet_length("dictionary").cast("long").alias("dictionary_bytes")), "file_id", "left")
    many = F.col("path") == "chunked"
    toc_offset = F.when(many, F.lit(V.HEADER_BYTES + 4) + F.col("dictionary_bytes") + F.col("payload_bytes")).when(F.col("path") == "empty", V.HEADER_BYTES).otherwise(0)
    archives = headers.select(
        "file_id", "path", F.lit(V.VERSION).alias("version"), flags.cast("long").alias("flags"), "original_size",
        F.when(many, F.col("unique_chunks")).when(F.col("path") == "single", 1).otherwise(0).cast("long").alias("chunk_count"),
        F.when(many, F.col("chunk_count")).when(F.col("path") == "single", F.col("single_tag")).otherwise(0).cast("long").alias("file_map_count"),
        toc_offset.cast("long").alias("toc_offset"), F.when(many, toc_offset + F.col("toc_bytes")).when(F.col("path") == "empty", V.HEADER_BYTES).otherwise(0).cast("long").alias("file_map_offset"),
        "checksum",
    )
    manifests = manifest(archives, derivations) if config.emit_manifest else files.select("file_id", F.lit("").alias("manifest")).filter("false")
    map_bytes = F.when(many, F.col("chunk_count") * 44).otherwise(0)
    body = F.coalesce("payload_bytes", F.lit(0)) + F.when(many, F.col("toc_bytes") + 4 + F.col("dictionary_bytes")).otherwise(0) + map_bytes
    sized = headers.join(manifests.select("file_id", (F.octet_length("manifest") + 4).alias("manifest_bytes")), "file_id", "left")
    compressed = F.lit(V.HEADER_BYTES) + body + F.coalesce("manifest_bytes", F.lit(0))
    single_path = F.col("path") == "single"
    stats = sized.select(
        "file_id", "original_size", F.when(F.col("path") == "empty", F.lit(0)).otherwise(compressed).cast("long").alias("compressed_size"),
        F.when(single_path, 1).otherwise(F.col("chunk_count")).cast("long").alias("chunk_count"), F.when(single_path, 1).otherwise(F.col("unique_chunks")).cast("long").alias("unique_chunks"),
        F.when(single_path, 0).otherwise(F.col("duplicate_chunks")).cast("long").alias("duplicate_chunks"), F.coalesce("delta_chunks", F.lit(0)).alias("delta_chunks"),
    )
    none = coded.select("file_id").filter("false")
    out = Archives(archives, toc.unionByName(of_single), file_map, dictionaries, derivations if derivations is not None else none, manifests, stats, (cut, by_path, frames, dictionaries, coded))
    if config.verify_on_compress and not config.lossy:
        from strata.operators.decode import assert_verified

        assert_verified(out)
    return out


def certificates(coded: DataFrame, config: CompressConfig) -> DataFrame:
    """One certificate for each unique chunk of the chunked files."""
    backend, size = codecs.name_of(F.col("tag")), F.octet_length("payload").cast("long")
    source, result = urn(F.col("chunk_id")), F.concat(F.lit(V.COMPRESSED_URN), chunk_id(F.col("payload")))
    told = F.concat_ws("|", source, backend, result, F.col("length").cast("string"), size.cast("string"))
    return coded.select(
        "file_id", "useq", F.concat(F.lit(V.DERIVATION_URN), F.substring(F.sha2(told, 256), 1, 16)).alias("derivation_id"), source.alias("original_chunk_id"), result.alias("compressed_chunk_id"),
        backend.alias("backend"), F.col("length").alias("original_size"), size.alias("compressed_size"), F.array(*BINS).alias("stratum_histogram"),
        class_name(F.col("class"), F.col("base_chunk_id"), F.col("fidelity")).alias("classification"), F.lit(V.LOSSY_FIDELITY if config.lossy else V.LOSSLESS_FIDELITY).alias("fidelity"),
    )


def certificate_json(prefix: str = "") -> Column:
    """A certificate as a JSON-LD node, keys in order."""
    c = lambda n: F.col(prefix + n)
    return F.struct(
        c("derivation_id").alias("@id"), F.lit("derivation:Derivation").alias("@type"), c("backend").alias("derivation:backend"), c("classification").alias("derivation:classification"),
        c("compressed_size").alias("derivation:compressedSize"), c("original_size").alias("derivation:originalSize"), c("compressed_chunk_id").alias("derivation:result"),
        c("original_chunk_id").alias("derivation:source"), c("fidelity").alias("observable:fidelity"), c("stratum_histogram").alias("observable:stratumHistogram"),
    )


def manifest(archives: DataFrame, derivations: DataFrame | None) -> DataFrame:
    """(file_id, manifest): the graph of each chunked archive and its
    certificates, as JSON."""
    proof = F.to_json(F.struct(
        F.concat(F.lit(V.ARCHIVE_URN), short(F.col("checksum"))).alias("@id"), F.lit("proof:CoherenceProof").alias("@type"), F.col("chunk_count").alias("proof:chunkCount"),
        F.col("file_map_count").alias("proof:fileMapCount"), (F.col("flags").bitwiseAND(F.lit(V.LOSSY)) != 0).alias("proof:lossy"), F.col("original_size").alias("proof:originalSize"),
        (F.col("flags").bitwiseAND(F.lit(V.VERIFIED)) != 0).alias("proof:verified"),
    ))
    rows = archives.filter("path = 'chunked'").select("file_id", proof.alias("proof"))
    if derivations is None:
        nodes = F.col("proof")
    else:
        told = derivations.select("file_id", F.struct("useq", F.to_json(certificate_json()).alias("node")).alias("n")).groupBy("file_id").agg(F.sort_array(F.collect_list("n")).alias("nodes"))
        rows = rows.join(told, "file_id", "left")
        nodes = F.concat_ws(",", F.col("proof"), F.transform("nodes", lambda n: n["node"]))
    context = F.to_json(F.struct(*(F.lit(v).alias(k) for k, v in sorted(V.CONTEXT.items()))))
    return rows.select("file_id", pretty(F.concat(F.lit('{"@context":'), context, F.lit(',"@graph":['), nodes, F.lit("]}"))).alias("manifest"))


@F.arrow_udf(T.StringType())
def pretty(told: pa.Array) -> pa.Array:
    """JSON with a line for each key, two blanks a level."""
    return pa.array([json.dumps(json.loads(x), indent=2, ensure_ascii=False) for x in told.to_pylist()], pa.string())
