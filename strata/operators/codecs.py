"""Codecs as functions on bytes, registered by tag, and the columns that use them.

A codec is a pair of functions; ``register`` adds one.  Encoders may return more
bytes than they got: what becomes of that is the routing's business.
"""

from __future__ import annotations

import struct
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column
from pyspark.sql import functions as F

from strata.errors import DecompressError, UnsupportedBackend
from strata.functions import fixed_values as V
from strata.functions.histogram import BIT_COUNT

TAGS = dict(V.BACKENDS)
NAMES = {tag: name for name, tag in TAGS.items()}


def tag_name(tag: int) -> str:
    if tag not in NAMES:
        raise UnsupportedBackend(tag)
    return NAMES[tag]


@lru_cache(maxsize=8)
def _compressor(level: int, dictionary: bytes | None) -> zstandard.ZstdCompressor:
    if not dictionary:
        return zstandard.ZstdCompressor(level=level)
    prepared = zstandard.ZstdCompressionDict(dictionary)
    prepared.precompute_compress(level=level)
    return zstandard.ZstdCompressor(dict_data=prepared)


@lru_cache(maxsize=8)
def _decompressor(dictionary: bytes | None) -> zstandard.ZstdDecompressor:
    return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)


def zstd(data: bytes, level: int = 3, dictionary: bytes | None = None) -> bytes:
    return _compressor(level, dictionary or None).compress(data)


def unzstd(data: bytes, size: int, dictionary: bytes | None = None) -> bytes:
    try:
        return _decompressor(dictionary or None).decompress(data, max_output_size=max(size, 1))
    except zstandard.ZstdError as e:
        raise DecompressError(str(e)) from e


def lz4(data: bytes) -> bytes:
    """The size as four bytes, lowest first, then one LZ4 block."""
    return struct.pack("<I", len(data)) + pa.Codec("lz4_raw").compress(data, asbytes=True) if data else struct.pack("<I", 0) + b"\x00"


def unlz4(data: bytes) -> bytes:
    if len(data) < 4:
        raise DecompressError("an LZ4 block needs its size in four bytes")
    (size,) = struct.unpack_from("<I", data)
    return pa.Codec("lz4_raw").decompress(data[4:], decompressed_size=size, asbytes=True) if size else b""


def xor_bytes(a: bytes, b: bytes) -> bytes:
    """Byte by byte, as far as the shorter goes."""
    n = min(len(a), len(b))
    return (np.frombuffer(a, np.uint8, n) ^ np.frombuffer(b, np.uint8, n)).tobytes() if n else b""


def delta(data: bytes, base: bytes, level: int = 3) -> bytes:
    if len(data) != len(base):
        raise DecompressError(f"delta of {len(data)} bytes against a base of {len(base)}")
    return zstd(xor_bytes(data, base), level)


def undelta(data: bytes, base: bytes, size: int) -> bytes:
    residual = unzstd(data, size)
    if len(residual) != len(base):
        raise DecompressError(f"residual of {len(residual)} bytes against a base of {len(base)}")
    return xor_bytes(residual, base)


def quantizer(threshold: int, cleared: int = V.CLEARED_BITS) -> np.ndarray:
    """What becomes of each byte: those with few bits lose their lowest ones."""
    if not 0 <= cleared <= 7:
        raise ValueError(f"between 0 and 7 bits can be cleared, not {cleared}")
    at = np.arange(256, dtype=np.uint8)
    return np.where(BIT_COUNT <= threshold, at & np.uint8(0xFF << cleared & 0xFF), at).astype(np.uint8)


def quantize_bytes(data: bytes, threshold: int, cleared: int = V.CLEARED_BITS) -> bytes:
    return quantizer(threshold, cleared)[np.frombuffer(data, np.uint8)].tobytes() if data else b""


Encoder, Decoder = Callable[[bytes, dict], bytes], Callable[[bytes, int, dict], bytes]
REGISTRY: dict[int, tuple[Encoder, Decoder]] = {
    TAGS["Identity"]: (lambda d, o: d, lambda d, n, o: d),
    TAGS["Zstd"]: (lambda d, o: zstd(d, o.get("level", 3), o.get("dictionary")), lambda d, n, o: unzstd(d, n, o.get("dictionary"))),
    TAGS["Lz4"]: (lambda d, o: lz4(d), lambda d, n, o: unlz4(d)),
    TAGS["Delta"]: (lambda d, o: delta(d, o["base"], o.get("level", 3)), lambda d, n, o: undelta(d, o["base"], n)),
    TAGS["Quantized"]: (lambda d, o: zstd(quantize_bytes(d, o.get("threshold", 2)), V.QUANTIZED_LEVEL), lambda d, n, o: unzstd(d, n)),
}


def register(name: str, tag: int, encode: Encoder, decode: Decoder) -> None:
    """Make a codec of one's own known under a free tag."""
    if tag in NAMES:
        raise ValueError(f"tag {tag} is taken by {NAMES[tag]}")
    TAGS[name], NAMES[tag], REGISTRY[tag] = tag, name, (encode, decode)


def encode_bytes(tag: int, data: bytes, **options) -> bytes:
    if tag not in REGISTRY:
        raise UnsupportedBackend(tag)
    return REGISTRY[tag][0](data, options)


def decode_bytes(tag: int, data: bytes, size: int, **options) -> bytes:
    if tag not in REGISTRY:
        raise UnsupportedBackend(tag)
    return REGISTRY[tag][1](data, size, options)


def name_of(tag: Column) -> Column:
    """The name of each tag; an unknown one is an error."""
    names = F.create_map(*(x for name, number in TAGS.items() for x in (F.lit(number), F.lit(name))))
    return F.coalesce(names[tag], F.raise_error(F.concat(F.lit("no codec has the tag "), tag.cast("string"))))


def xored(a: Column, b: Column) -> Column:
    """Two binary columns byte by byte, as far as the shorter goes."""

    @F.arrow_udf("binary")
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([xor_bytes(x.as_py(), y.as_py()) if x.is_valid and y.is_valid else None for x, y in zip(a, b, strict=True)], pa.binary())

    return run(a, b)


def _bytes(x: pa.Scalar) -> bytes | None:
    return x.as_py()


def encoded(name: str, data: Column, level: int = 3, other: Column | None = None) -> Column:
    """``data`` under a codec; ``other`` is the dictionary or the base."""
    tag, key = TAGS[name], "base" if name == "Delta" else "dictionary"

    @F.arrow_udf("binary")
    def run(data: pa.Array, other: pa.Array) -> pa.Array:
        return pa.array([None if not d.is_valid else encode_bytes(tag, _bytes(d), level=level, **{key: _bytes(o)}) for d, o in zip(data, other, strict=True)], pa.binary())

    return run(data, other if other is not None else F.lit(None).cast("binary"))


def decoded(name: str, data: Column, size: Column, other: Column | None = None) -> Column:
    tag, key = TAGS[name], "base" if name == "Delta" else "dictionary"

    @F.arrow_udf("binary")
    def run(data: pa.Array, size: pa.Array, other: pa.Array) -> pa.Array:
        return pa.array([None if not d.is_valid else decode_bytes(tag, _bytes(d), n.as_py(), **{key: _bytes(o)}) for d, n, o in zip(data, size, other, strict=True)], pa.binary())

    return run(data, size.cast("long"), other if other is not None else F.lit(None).cast("binary"))


def quantized(data: Column, threshold: int, cleared: int = V.CLEARED_BITS) -> Column:
    table = quantizer(threshold, cleared)

    @F.arrow_udf("binary")
    def run(data: pa.Array) -> pa.Array:
        return pa.array([table[np.frombuffer(d.as_buffer(), np.uint8)].tobytes() if d.is_valid else None for d in data], pa.binary())

    return run(data)


def dictionary(content: Column) -> Column:
    """A whole small content, or samples at even distances of a large one."""
    n = F.octet_length(content)
    step = F.floor(n / V.DICTIONARY_SAMPLES).cast("int")
    samples = F.concat(*(F.substring(content, step * i + 1, F.lit(V.DICTIONARY_SAMPLE)) for i in range(V.DICTIONARY_SAMPLES)))
    return F.when(n <= V.DICTIONARY_MAX, content).otherwise(samples)
