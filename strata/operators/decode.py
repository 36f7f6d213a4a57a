"""Decompression and verification of archive tables.

The rows of a file come together once, sorted: its dictionary, the chunks that
stand for themselves, the deltas in the order of the table of contents, and the
map.  One pass over them decodes the chunks and puts the file together; a delta's
base, which may be a delta, always comes before it, so a chain of any length takes
no further pass.  In a lossy archive a delta was taken against the original base
and is decoded against what became of it; the bits that base lost show up in the
delta's chunk.

Scale: one shuffle, in which every payload moves once and the dictionary once a
file.  A task holds the unique chunks of one file, which fit where the file does.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.errors import IntegrityFailure, InvalidArchive
from strata.functions import fixed_values as V
from strata.functions.identity import chunk_id
from strata.operators import codecs
from strata.operators.dedup import ratio
from strata.operators.encode import Archives

DELTA, REFERENCE = codecs.TAGS["Delta"], codecs.TAGS["Reference"]
HEAD, PLAIN, LINKED, MAP = range(4)
#: Bytes of decoded content that go back to the engine at once.
SHIPPED = 8 << 20


class _File:
    """The chunks of one file and what has been put together of it."""

    def __init__(self, file_id, whole: bool):
        self.file_id, self.whole, self.dictionary = file_id, whole, None
        self.chunks: dict[str, bytes] = {}
        self.content, self.mapped, self.beyond = bytearray(), 0, False

    def head(self, size: int, dictionary: bytes | None) -> None:
        self.dictionary = dictionary
        if self.whole:
            self.content = bytearray(size)

    def decode(self, chunk: str, tag: int, payload: bytes, size: int, base: str | None) -> bytes:
        if tag == DELTA and base not in self.chunks:
            raise InvalidArchive(f"file {self.file_id}: chunk {chunk} was stored against {base}, which isn't there")
        data = codecs.decode_bytes(tag, payload, size, dictionary=self.dictionary, base=self.chunks.get(base))
        self.chunks[chunk] = data
        return data

    def place(self, chunk: str, length: int, offset: int) -> None:
        data = self.chunks.get(chunk)
        self.mapped += 1
        if data is None or length > len(data) or offset + length > len(self.content):
            self.beyond = True
        else:
            self.content[offset : offset + length] = data[:length]


ROW = ("kind", "place", "chunk_id", "tag", "size", "base", "blob")


def _rows(archives: Archives, whole: bool) -> DataFrame:
    """What decoding needs of each chunked archive, sorted as it is needed."""

    def typed(kind: Column, place: Column, chunk=None, tag=None, size=None, base=None, blob=None) -> list[Column]:
        given = [(kind, "int"), (place, "long"), (chunk, "string"), (tag, "int"), (size, "long"), (base, "string"), (blob, "binary")]
        return [F.col("file_id"), *((F.lit(None) if c is None else c).cast(t).alias(n) for (c, t), n in zip(given, ROW, strict=True))]

    heads = archives.dictionaries.select("file_id", F.lit(0).alias("original_size"), "dictionary")
    if whole:
        heads = archives.archives.filter("path = 'chunked'").select("file_id", "original_size").join(heads.drop("original_size"), "file_id", "left")
    rows = heads.select(*typed(F.lit(HEAD), F.lit(0), size=F.col("original_size"), blob=F.col("dictionary")))
    toc = archives.toc.filter(F.col("chunk_id").isNotNull() & (F.col("tag") != REFERENCE))
    kind = F.when(F.col("tag") == DELTA, LINKED).otherwise(PLAIN)
    rows = rows.unionByName(toc.select(*typed(kind, F.col("useq"), F.col("chunk_id"), F.col("tag"), F.col("original_size"), F.col("base_chunk_id"), F.col("payload"))))
    if whole:
        rows = rows.unionByName(archives.file_map.select(*typed(F.lit(MAP), F.col("file_offset"), F.col("chunk_id"), size=F.col("length"))))
    return rows.repartition("file_id").sortWithinPartitions("file_id", "kind", "place")


def _walk(batches: Iterator[pa.RecordBatch], whole: bool) -> Iterator[tuple[_File, str | None, bytes | None]]:
    """(file, chunk id, data) for each chunk and (file, None, None) at the end of
    each file."""
    file = None
    for b in batches:
        ids, *columns = (b.column(i) for i in range(b.num_columns))
        blob = columns.pop()
        for i, (file_id, kind, place, chunk, tag, size, base) in enumerate(zip(ids.to_pylist(), *(c.to_pylist() for c in columns), strict=True)):
            if file is None or file_id != file.file_id:
                if file is not None:
                    yield file, None, None
                file = _File(file_id, whole)
            if kind == HEAD:
                file.head(size, blob[i].as_py())
            elif kind == MAP:
                file.place(chunk, size, place)
            else:
                yield file, chunk, file.decode(chunk, tag, blob[i].as_py(), size, base)
    if file is not None:
        yield file, None, None


def check_bases(archives: Archives) -> None:
    """Every delta's base must come before it; no payload is read for that."""
    toc = archives.toc.filter(F.col("chunk_id").isNotNull()).select("file_id", "useq", "tag", "chunk_id", "base_chunk_id")
    bases = toc.select("file_id", F.col("chunk_id").alias("base_chunk_id"), F.col("useq").alias("base_useq"))
    deltas = toc.filter(F.col("tag") == DELTA).drop("tag")
    lost = deltas.join(bases, ["file_id", "base_chunk_id"], "left").filter(F.col("base_useq").isNull() | (F.col("base_useq") >= F.col("useq"))).first()
    if lost:
        raise InvalidArchive(f"file {lost['file_id']}: the base {lost['base_chunk_id']} of a delta isn't there before it")


def _shipped(rows: DataFrame, whole: bool, schema: str, made) -> DataFrame:
    """A row ``made`` from each step of ``_walk`` that yields one, in batches."""
    names = [f.split()[0] for f in schema.split(", ")]
    kinds = {"string": pa.string(), "binary": pa.binary(), "long": pa.int64(), "boolean": pa.bool_()}
    rest = [kinds[f.split()[1]] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, held, size = None, [], 0

        def seen() -> Iterator[pa.RecordBatch]:
            nonlocal kind
            for b in batches:
                kind = b.schema.field(0).type
                yield b

        def record() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), [kind, *rest], strict=True)], names=["file_id", *names])

        for file, chunk, data in _walk(seen(), whole):
            if (row := made(file, chunk, data)) is not None:
                held.append((file.file_id, *row))
                size += sum(len(x) for x in row if isinstance(x, bytes))
                if size > SHIPPED:
                    yield record()
                    held, size = [], 0
        if held:
            yield record()

    return rows.mapInArrow(run, f"file_id {rows.schema['file_id'].dataType.simpleString()}, {schema}")


def decode_chunks(archives: Archives) -> DataFrame:
    """(file_id, chunk_id, data) of every chunk of the chunked archives."""
    check_bases(archives)
    return _shipped(_rows(archives, False), False, "chunk_id string, data binary", lambda file, chunk, data: None if chunk is None else (chunk, data))


def reassemble(archives: Archives) -> DataFrame:
    """(file_id, content, chunks, out_of_bounds) of the chunked archives; what the
    map leaves out is zero."""
    check_bases(archives)
    made = lambda file, chunk, _: (bytes(file.content), file.mapped, file.beyond) if chunk is None else None
    return _shipped(_rows(archives, True), True, "content binary, chunks long, out_of_bounds boolean", made)


def _frames(archives: Archives) -> DataFrame:
    """(file_id, content) of the archives that are one frame."""

    @F.arrow_udf("binary")
    def run(tag: pa.Array, payload: pa.Array, size: pa.Array) -> pa.Array:
        return pa.array([codecs.decode_bytes(t.as_py(), p.as_py(), n.as_py()) for t, p, n in zip(tag, payload, size, strict=True)], pa.binary())

    singles = archives.toc.filter(F.col("chunk_id").isNull()).select("file_id", "tag", "payload")
    heads = archives.archives.filter("path = 'single'").select("file_id", "original_size")
    return singles.join(heads, "file_id").select("file_id", run("tag", "payload", "original_size").alias("content"))


def decompress(archives: Archives) -> DataFrame:
    """(file_id, content, chunks, is_lossy, status) of every archive.

    status is ok, skipped_lossy (lossy archives can't be checked), or what is
    wrong: out_of_bounds, or checksum.
    """
    heads = archives.archives.select("file_id", "path", "original_size", "checksum", (F.col("flags").bitwiseAND(F.lit(V.LOSSY)) != 0).alias("is_lossy"))
    one = _frames(archives).select("file_id", "content", F.lit(1).cast("long").alias("chunks"), F.lit(False).alias("out_of_bounds"))
    both = one.unionByName(reassemble(archives))
    rows = heads.join(both, "file_id", "left")
    content = F.coalesce("content", F.lit(b""))
    status = (
        F.when(F.col("out_of_bounds"), "out_of_bounds")
        .when(F.col("is_lossy") & (F.col("path") != "empty"), "skipped_lossy")
        .when(chunk_id(content) != F.col("checksum"), "checksum")
        .otherwise("ok")
    )
    return rows.select("file_id", content.alias("content"), F.coalesce("chunks", F.lit(0)).cast("long").alias("chunks"), "is_lossy", status.alias("status"))


def verify(archives: Archives) -> DataFrame:
    """(file_id, status) of every archive."""
    return decompress(archives).select("file_id", "status")


def verify_chunk(data: Column, expected: Column) -> Column:
    return chunk_id(data).eqNullSafe(expected)


def bad_chunks(archives: Archives) -> DataFrame:
    """Decoded chunks of lossless archives whose address isn't their own."""
    lossless = archives.archives.filter(F.col("flags").bitwiseAND(F.lit(V.LOSSY)) == 0).select("file_id")
    rows = decode_chunks(archives).join(lossless, "file_id", "left_semi")
    return rows.select("file_id", "chunk_id", chunk_id(F.col("data")).alias("actual")).filter("chunk_id != actual")


def assert_verified(archives: Archives) -> None:
    bad = bad_chunks(archives).first()
    if bad:
        raise IntegrityFailure(bad["chunk_id"], bad["actual"])
    wrong = verify(archives).filter(~F.col("status").isin("ok", "skipped_lossy")).first()
    if wrong:
        raise InvalidArchive(f"{wrong['file_id']}: {wrong['status']}")


def inspect(archives: Archives) -> DataFrame:
    """What the headers say; no payload is read."""
    flag = lambda f: (F.col("flags").bitwiseAND(F.lit(f)) != 0)
    return archives.archives.select("file_id", "version", "original_size", flag(V.LOSSY).alias("is_lossy"), flag(V.HAS_MANIFEST).alias("has_manifest"), flag(V.SINGLE_STREAM).alias("is_single_stream"), "chunk_count", "file_map_count")


def find_entry(archives: Archives, chunk: str) -> DataFrame:
    """The entries of one chunk in the tables of contents."""
    return archives.toc.filter(F.col("chunk_id") == chunk)


def find_entries(archives: Archives, wanted: DataFrame) -> DataFrame:
    """The entries of all chunks in ``wanted`` (chunk_id)."""
    return archives.toc.join(wanted, "chunk_id", "left_semi")


def inspect_chunks(archives: Archives) -> DataFrame:
    """The table of contents with the ratio of each chunk."""
    return archives.toc.filter(F.col("chunk_id").isNotNull()).select("file_id", "useq", "chunk_id", codecs.name_of(F.col("tag")).alias("backend"), "original_size", "compressed_size", ratio(F.col("original_size"), F.col("compressed_size")).alias("ratio"))
