"""Hamming distance of byte strings of equal length, and what it says of them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.functions.histogram import BIT_COUNT


def distance(a: bytes, b: bytes) -> int:
    x = np.bitwise_xor(np.frombuffer(a, dtype=np.uint8), np.frombuffer(b, dtype=np.uint8))
    return int(BIT_COUNT[x].sum(dtype=np.int64))


def share(bits: int, length: int) -> float:
    """1 for equal strings, 0 where every bit differs, 1 for empty ones."""
    return 1.0 - bits / (8 * length) if length else 1.0


@F.arrow_udf(T.LongType())
def hamming(a: pa.Array, b: pa.Array) -> pa.Array:
    """Bits that differ; an error if the lengths do."""
    out = []
    for x, y in zip(a, b, strict=True):
        if not x.is_valid or not y.is_valid:
            out.append(None)
            continue
        left, right = x.as_py(), y.as_py()
        if len(left) != len(right):
            raise ValueError(f"byte strings of {len(left)} and {len(right)} bytes can't be correlated")
        out.append(distance(left, right))
    return pa.array(out, pa.int64())


def fidelity(bits: Column, length: Column) -> Column:
    return F.when(length == 0, F.lit(1.0)).otherwise(F.lit(1.0) - bits.cast("double") / (length * 8))


def correlate(a: Column, b: Column) -> list[Column]:
    bits, length = hamming(a, b), F.octet_length(a).cast("long")
    return [bits.alias("hamming"), (length * 8).alias("max_bits"), fidelity(bits, length).alias("fidelity")]
