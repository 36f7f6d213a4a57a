"""Content-defined chunking: files to rows of chunks.

A chunk ends behind a byte where the low bits of a rolling hash are all zero, but
not before the smallest and not after the largest size.  Those bits depend on the
last few bytes only, so the hash of all positions is computed at once for a whole
batch of files, and only the choice of ends is made chunk by chunk.  The hash
starts afresh at the first position where a chunk may end; the positions right
behind it see fewer bytes and are looked at one by one.

Scale: chunking is a scan; a file is one row and is cut where it is read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.functions import fixed_values as V
from strata.functions.identity import chunk_id


@dataclass(frozen=True)
class ChunkParams:
    smallest: int = V.CHUNK_MIN
    target: int = V.CHUNK_TARGET
    largest: int = V.CHUNK_MAX

    @property
    def bits(self) -> int:
        """Low bits of the hash that must be zero: log2 of the target, up."""
        return max(self.target - 1, 0).bit_length()


#: Sizes that give short texts several chunks.
SMALL = ChunkParams(64, 256, 1024)


def gear(bits: int = 64) -> list[int]:
    """The 256 numbers of the rolling hash, cut to their low bits."""
    out, x, word = [], V.GEAR_SEED, (1 << 64) - 1
    a, b, c = V.GEAR_SHIFTS
    for _ in range(256):
        x ^= x << a & word
        x ^= x >> b
        x ^= x << c & word
        out.append(x & ((1 << bits) - 1))
    return out


def rolling(data: np.ndarray, bits: int) -> np.ndarray:
    """The low bits of the hash of the last ``bits`` bytes, at every position.

    Doubling: the hash of 2w bytes is that of the last w plus that of the w
    before, shifted by w.  What is shifted beyond ``bits`` doesn't count.
    """
    if not bits:
        return np.zeros(len(data), dtype=np.uint64)
    mask = np.uint64((1 << bits) - 1)
    sums, width = np.array(gear(bits), dtype=np.uint64)[data], 1
    while width < bits:
        longer = sums.copy()
        longer[width:] += sums[:-width] << np.uint64(width)
        sums, width = longer & mask, 2 * width
    return sums


def ends(data: np.ndarray, params: ChunkParams, hashes: np.ndarray | None = None) -> list[int]:
    """Where the chunks of one file end."""
    n, bits = len(data), params.bits
    mask = (1 << bits) - 1
    full = hashes if hashes is not None else rolling(data, bits)
    zero = np.flatnonzero(full == 0)
    table = gear(bits)
    out, start = [], 0
    while start < n:
        stop = min(n, start + params.largest)
        scan = min(start + params.smallest, n)
        cut, h, p = 0, 0, scan
        while p < stop and p - scan < max(bits - 1, 0):
            h = (h << 1) + table[data[p]] & mask
            p += 1
            if not h:
                cut = p
                break
        if not cut and p < stop:
            k = int(np.searchsorted(zero, p))
            if k < len(zero) and zero[k] < stop:
                cut = int(zero[k]) + 1
        start = cut or stop
        out.append(start)
    return out


def chunks(files: DataFrame, params: ChunkParams = ChunkParams(), id_col: str = "file_id", content_col: str = "content", data: bool = True) -> DataFrame:
    """(file_id, seq, offset, length, chunk_id, data), one row for each chunk.

    A null or empty content has no chunks.  Without ``data`` chunks are hashed where
    they are cut and their bytes stay there.
    """
    bits = params.bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column(1).cast(pa.large_binary()).fill_null(b"")
            at = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
            raw = column.buffers()[2]
            whole = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, np.uint8)
            owner, seq, begin, stop = [], [], [], []
            for i, (a, z) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
                cuts = ends(whole[a:z], params, rolling(whole[a:z], bits))
                owner += [i] * len(cuts)
                seq += range(len(cuts))
                begin += [0, *cuts[:-1]] if cuts else []
                stop += cuts
            cut_out = (whole[at[i] + a : at[i] + z] for i, a, z in zip(owner, begin, stop, strict=True))
            last = pa.array([x.tobytes() for x in cut_out], pa.binary()) if data else pa.array([hashlib.sha256(x).hexdigest() for x in cut_out], pa.string())
            ids = b.column(0).take(pa.array(owner, pa.int64()))
            arrays = [ids, pa.array(seq, pa.int64()), pa.array(begin, pa.int64()), pa.array(np.subtract(stop, begin), pa.int64()) if stop else pa.array([], pa.int64()), last]
            yield pa.RecordBatch.from_arrays(arrays, names=["file_id", "seq", "offset", "length", "data" if data else "chunk_id"])

    kind = files.select(id_col).dtypes[0][1]
    rows = files.select(F.col(id_col).alias("file_id"), F.col(content_col).cast("binary").alias("content"))
    cut = rows.mapInArrow(run, f"file_id {kind}, seq long, offset long, length long, {'data binary' if data else 'chunk_id string'}")
    if not data:
        return cut
    return cut.select("file_id", "seq", "offset", "length", chunk_id(F.col("data")).alias("chunk_id"), "data")


def ends_native(content: Column, params: ChunkParams) -> Column:
    """The ends as an array, by a fold over the bytes, without Python.

    A slow path for clusters without Python workers; the results are the same.
    """
    bits, mask = params.bits, (1 << params.bits) - 1
    table = F.array(*(F.lit(g).cast("long") for g in gear(bits)))
    n = F.octet_length(content)
    start = F.struct(F.lit(0).alias("start"), F.lit(0).cast("long").alias("h"), F.array().cast("array<int>").alias("ends"))

    def step(acc: Column, p: Column) -> Column:
        scanned = p - acc["start"] >= params.smallest
        byte = F.conv(F.hex(F.substring(content, p + 1, 1)), 16, 10).cast("int")
        h = F.when(scanned, (acc["h"] * 2 + F.element_at(table, byte + 1)).bitwiseAND(F.lit(mask))).otherwise(F.lit(0).cast("long"))
        cut = (scanned & (h == 0)) | (p + 1 - acc["start"] >= params.largest) | (p + 1 == n)
        return F.struct(
            F.when(cut, p + 1).otherwise(acc["start"]).alias("start"),
            F.when(cut, F.lit(0).cast("long")).otherwise(h).alias("h"),
            F.when(cut, F.concat(acc["ends"], F.array(p + 1))).otherwise(acc["ends"]).alias("ends"),
        )

    positions = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(positions, start, step, lambda acc: acc["ends"])


def coverage(cut: DataFrame, files: DataFrame, id_col: str = "file_id", content_col: str = "content") -> DataFrame:
    """(file_id, n_bytes, covered, contiguous) of every file."""
    order = Window.partitionBy("file_id").orderBy("seq")
    gap = F.col("offset") != F.coalesce(F.lag(F.col("offset") + F.col("length")).over(order), F.lit(0))
    found = cut.select("file_id", "length", gap.alias("gap")).groupBy("file_id").agg(F.sum("length").alias("covered"), F.max("gap").alias("gaps"))
    rows = files.select(F.col(id_col).alias("file_id"), F.coalesce(F.octet_length(F.col(content_col).cast("binary")), F.lit(0)).cast("long").alias("n_bytes"))
    return rows.join(found, "file_id", "left").select("file_id", "n_bytes", F.coalesce("covered", F.lit(0)).alias("covered"), (~F.coalesce("gaps", F.lit(False))).alias("contiguous"))
