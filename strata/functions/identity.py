"""Content addresses of byte strings and the ways to write them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strata.functions.fixed_values import BRAILLE_IRI, CHUNK_URN

_LATIN = "".join(map(chr, range(256)))
_BRAILLE = "".join(chr(0x2800 + i) for i in range(256))


def chunk_id(data: Column) -> Column:
    """SHA-256 in lower-case hexadecimal; the key of every table of chunks."""
    return F.sha2(data.cast("binary"), 256)


file_checksum = chunk_id


def short(chunk: Column) -> Column:
    return F.substring(chunk, 1, 16)


def urn(chunk: Column) -> Column:
    return F.concat(F.lit(CHUNK_URN), short(chunk))


def debug(chunk: Column) -> Column:
    return F.concat(F.lit("ChunkId("), short(chunk), F.lit(")"))


def braille_iri(chunk: Column) -> Column:
    """One Braille sign for each byte of the address."""
    signs = F.translate(F.decode(F.unhex(chunk), "ISO-8859-1"), _LATIN, _BRAILLE)
    return F.concat(F.lit(BRAILLE_IRI), signs)


def to_bytes(chunk: Column) -> Column:
    return F.unhex(chunk)


def from_bytes(raw: Column) -> Column:
    return F.lower(F.hex(raw))
