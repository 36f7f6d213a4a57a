"""Array views of Arrow text columns, shared by the operators that run in Python.

Everything works on the UTF-8 buffers of a whole batch at once.  White space is
the six ASCII characters 0x09-0x0D and 0x20, which is also what bytes.split()
splits on.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
SPACE_BYTES = b"\t\n\x0b\x0c\r "


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string column; a null counts as the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or at[-1] == at[0]:
        return at - at[0], np.zeros(0, dtype=np.uint8)
    return at - at[0], np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]]


def texts(column: pa.Array) -> list[bytes]:
    """Each text as UTF-8 bytes; a null counts as the empty text."""
    at, data = utf8(column)
    whole = data.tobytes()
    return [whole[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def free_name(df: DataFrame, name: str) -> str:
    """A name that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def release() -> None:
    """Free what a stage that made tokens has left in this Python worker."""
    if tokens := sys.modules.get("strata.llm.tokens"):
        tokens.release()


def per_text(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many flags are set in each text."""
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[at[1:]] - total[at[:-1]]


def word_counts(column: pa.Array) -> np.ndarray:
    """Words (runs of other than white space) of each text."""
    at, data = utf8(column)
    if not len(data):
        return np.zeros(len(at) - 1, dtype=np.int64)
    inside = ~SPACE[data]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    firsts = at[:-1][at[:-1] < at[1:]]
    starts[firsts] = inside[firsts]
    return per_text(starts, at)
