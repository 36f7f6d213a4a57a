"""Archive files: the tables of an archive as one byte string, and back.

A file holds an 88-byte header, the dictionary, the payloads, the table of
contents, the file map and the manifest.  Reading goes through Spark's binary
file source and so from any store; writing through a Python data source.
"""

from __future__ import annotations

import re
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from strata.errors import InvalidArchive
from strata.functions import fixed_values as V
from strata.operators.codecs import tag_name
from strata.operators.encode import Archives
from strata.spark import kept

HEAD = struct.Struct("<8sHIQIIQQQ32s2x")
TOC_HEAD, TOC_TAIL, MAP_ENTRY, LENGTH = struct.Struct("<32sBQIIB"), 9, struct.Struct("<Q32sI"), struct.Struct("<I")


@dataclass
class Header:
    flags: int
    original_size: int
    chunk_count: int
    file_map_count: int
    toc_offset: int
    file_map_offset: int
    manifest_offset: int
    checksum: bytes
    version: int = V.VERSION

    def pack(self) -> bytes:
        return HEAD.pack(V.MAGIC, self.version, self.flags, self.original_size, self.chunk_count, self.file_map_count, self.toc_offset, self.file_map_offset, self.manifest_offset, self.checksum)

    @classmethod
    def unpack(cls, raw: bytes) -> Header:
        if len(raw) < V.HEADER_BYTES:
            raise InvalidArchive(f"{len(raw)} bytes are too few for a header")
        magic, version, *rest = HEAD.unpack_from(raw)
        if magic != V.MAGIC:
            raise InvalidArchive("wrong magic number")
        if version != V.VERSION:
            raise InvalidArchive(f"unsupported version {version}")
        return cls(*rest, version=version)

    def has(self, flag: int) -> bool:
        return bool(self.flags & flag)


def build(head: Header, toc: list[tuple], file_map: list[tuple], dictionary: bytes | None, manifest: bytes | None) -> bytes:
    """toc: (chunk_id, tag, original_size, base or None, payload); file_map:
    (file_offset, chunk_id, length).  Offsets and counts are set here."""
    if head.has(V.SINGLE_STREAM):
        return head.pack() + toc[0][4]
    parts = [LENGTH.pack(len(dictionary)) + dictionary] if dictionary is not None else []
    at = V.HEADER_BYTES + sum(map(len, parts))
    entries = []
    for chunk, tag, size, base, payload in toc:
        parts.append(payload)
        entries.append(TOC_HEAD.pack(bytes.fromhex(chunk), tag, at, len(payload), size, base is not None) + (bytes.fromhex(base) if base else b"") + bytes(TOC_TAIL))
        at += len(payload)
    head.toc_offset, head.chunk_count = at, len(entries)
    at += sum(map(len, entries))
    head.file_map_offset, head.file_map_count = at, len(file_map)
    entries += [MAP_ENTRY.pack(offset, bytes.fromhex(chunk), length) for offset, chunk, length in file_map]
    at += MAP_ENTRY.size * len(file_map)
    if manifest is not None:
        head.manifest_offset, head.flags = at, head.flags | V.HAS_MANIFEST
        entries.append(LENGTH.pack(len(manifest)) + manifest)
    return head.pack() + b"".join(parts) + b"".join(entries)


def parse(raw: bytes) -> tuple[Header, list[tuple], list[tuple], bytes | None, str | None]:
    """The reverse of ``build``; toc entries carry their data offset too."""
    head = Header.unpack(raw)
    if head.has(V.SINGLE_STREAM):
        return head, [(None, head.file_map_count, head.original_size, None, raw[V.HEADER_BYTES :], V.HEADER_BYTES)], [], None, None
    dictionary = manifest = None
    if head.has(V.HAS_DICTIONARY):
        (n,) = LENGTH.unpack_from(raw, V.HEADER_BYTES)
        dictionary = raw[V.HEADER_BYTES + 4 : V.HEADER_BYTES + 4 + n]
    toc, at = [], head.toc_offset
    try:
        for _ in range(head.chunk_count):
            chunk, tag, offset, packed, size, has_base = TOC_HEAD.unpack_from(raw, at)
            tag_name(tag)
            at += TOC_HEAD.size
            base = raw[at : at + 32].hex() if has_base == 1 else None
            at += (32 if has_base == 1 else 0) + TOC_TAIL
            toc.append((chunk.hex(), tag, size, base, raw[offset : offset + packed], offset))
        file_map = [(o, c.hex(), n) for o, c, n in (MAP_ENTRY.unpack_from(raw, head.file_map_offset + MAP_ENTRY.size * i) for i in range(head.file_map_count))]
        if head.has(V.HAS_MANIFEST) and head.manifest_offset:
            (n,) = LENGTH.unpack_from(raw, head.manifest_offset)
            manifest = raw[head.manifest_offset + 4 : head.manifest_offset + 4 + n].decode("utf-8")
    except (struct.error, UnicodeDecodeError) as e:
        raise InvalidArchive(str(e)) from e
    return head, toc, file_map, dictionary, manifest


def to_files(archives: Archives) -> DataFrame:
    """(file_id, archive): each archive as the bytes of its file."""
    toc = archives.toc.groupBy("file_id").agg(F.sort_array(F.collect_list(F.struct("useq", "chunk_id", "tag", F.coalesce("original_size", F.lit(0).cast("long")).alias("size"), "base_chunk_id", "payload"))).alias("toc"))
    file_map = archives.file_map.groupBy("file_id").agg(F.sort_array(F.collect_list(F.struct("file_offset", "chunk_id", "length"))).alias("file_map"))
    rows = archives.archives.join(toc, "file_id", "left").join(file_map, "file_id", "left").join(archives.dictionaries, "file_id", "left").join(archives.manifests, "file_id", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in b.select([n for n in b.schema.names if n != "file_id"]).to_pylist():
                head = Header(r["flags"], r["original_size"], r["chunk_count"], r["file_map_count"], 0, 0, 0, bytes.fromhex(r["checksum"]))
                entries = [(t["chunk_id"], t["tag"], t["size"], t["base_chunk_id"], t["payload"]) for t in r["toc"] or []]
                places = [(m["file_offset"], m["chunk_id"], m["length"]) for m in r["file_map"] or []]
                told = r["manifest"].encode() if r["manifest"] is not None and r["path"] == "chunked" else None
                out.append(build(head, entries, places, r["dictionary"], told))
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index("file_id")), pa.array(out, pa.binary())], names=["file_id", "archive"])

    return rows.mapInArrow(run, f"file_id {dict(rows.dtypes)['file_id']}, archive binary")


def from_files(files: DataFrame) -> Archives:
    """Archive tables of rows (file_id, archive)."""
    kind = dict(files.dtypes)["file_id"]
    toc_type = "array<struct<chunk_id:string,tag:int,original_size:bigint,base_chunk_id:string,payload:binary,data_offset:bigint>>"
    map_type = "array<struct<file_offset:bigint,chunk_id:string,length:bigint>>"
    schema = f"file_id {kind}, version int, flags bigint, original_size bigint, chunk_count bigint, file_map_count bigint, toc_offset bigint, file_map_offset bigint, checksum string, toc {toc_type}, file_map {map_type}, dictionary binary, manifest string"
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for file_id, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                head, toc, file_map, dictionary, manifest = parse(raw)
                keys = ("chunk_id", "tag", "original_size", "base_chunk_id", "payload", "data_offset")
                rows.append({
                    "file_id": file_id, "version": head.version, "flags": head.flags, "original_size": head.original_size, "chunk_count": head.chunk_count, "file_map_count": head.file_map_count,
                    "toc_offset": head.toc_offset, "file_map_offset": head.file_map_offset, "checksum": head.checksum.hex(), "toc": [dict(zip(keys, t, strict=True)) for t in toc],
                    "file_map": [dict(zip(("file_offset", "chunk_id", "length"), m, strict=True)) for m in file_map], "dictionary": dictionary, "manifest": manifest,
                })
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    read = kept(files.select("file_id", "archive").mapInArrow(run, schema))
    path = F.when(F.col("flags").bitwiseAND(F.lit(V.SINGLE_STREAM)) != 0, "single").when(F.col("original_size") == 0, "empty").otherwise("chunked")
    heads = read.select("file_id", path.alias("path"), "version", "flags", "original_size", "chunk_count", "file_map_count", "toc_offset", "file_map_offset", "checksum")
    toc = read.select("file_id", F.posexplode("toc").alias("useq", "t")).select("file_id", F.col("useq").cast("long").alias("useq"), "t.chunk_id", "t.tag", "t.data_offset", F.octet_length("t.payload").cast("long").alias("compressed_size"), "t.original_size", "t.base_chunk_id", "t.payload")
    file_map = read.select("file_id", F.posexplode("file_map").alias("seq", "m")).select("file_id", F.col("seq").cast("long").alias("seq"), "m.file_offset", "m.chunk_id", "m.length")
    dictionaries = read.filter("dictionary IS NOT NULL").select("file_id", "dictionary")
    manifests = read.filter("manifest IS NOT NULL").select("file_id", "manifest")
    return Archives(heads, toc, file_map, dictionaries, read.select("file_id").filter("false"), manifests, heads.select("file_id").filter("false"), (read,))


def read_archives(spark: SparkSession, path: str) -> Archives:
    """Archive files from any store that Spark reads."""
    return from_files(spark.read.format("binaryFile").load(path).select(F.col("path").alias("file_id"), F.col("content").alias("archive")))


def file_name(file_id: str) -> str:
    """A name of its own for each id: signs other than letters, digits, points,
    minus and underscores stand as their UTF-8 bytes, like %2F for a slash."""
    name = quote(file_id, safe="")
    return "%2E" + name[1:] if name.startswith(".") else name or "%"


class _Writer(DataSourceWriter):
    def __init__(self, folder: str, extension: str):
        self.folder, self.extension = folder, extension

    def _store(self) -> tuple[fs.FileSystem, str]:
        if "://" not in self.folder and not self.folder.startswith("file:"):
            return fs.LocalFileSystem(), self.folder
        return fs.FileSystem.from_uri(re.sub("^file:/(?!/)", "file:///", self.folder))

    def write(self, rows) -> WriterCommitMessage:
        store, folder = self._store()
        store.create_dir(folder, recursive=True)
        for row in rows:
            name = file_name(str(row["file_id"]))
            part = f"{folder}/.{name}.{uuid.uuid4().hex}.part"
            with store.open_output_stream(part) as f:
                f.write(row["content"])
            store.move(part, f"{folder}/{name}{self.extension}")
        return WriterCommitMessage()


class WholeFiles(DataSource):
    """Sink: a file for each row (file_id, content) in a folder that all executors
    reach: a shared mount, or a store that Arrow has a file system for (hdfs, s3,
    gs, abfs).  The option ``extension`` goes behind a file's name."""

    @classmethod
    def name(cls) -> str:
        return "strata_files"

    def schema(self) -> str:
        return "file_id string, content binary"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"], self.options.get("extension", ""))


def write_files(rows: DataFrame, folder: str, extension: str = "") -> None:
    """A file for each row of (file_id, content)."""
    rows.sparkSession.dataSource.register(WholeFiles)
    rows.select(F.col("file_id").cast("string").alias("file_id"), "content").write.format("strata_files").option("extension", extension).mode("append").save(folder)


def write_archives(archives: Archives, folder: str) -> None:
    write_files(to_files(archives).withColumnRenamed("archive", "content"), folder, V.EXTENSION)
