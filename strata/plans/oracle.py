"""The same results in SQL, for an engine that shares nothing with Spark.

Chunk ends come from a recursive query over the chunks of each file: every
position carries a mask that says after how many bytes its rolling hash would be
zero, and each step takes the first position that fits the chunk begun last.
"""

from __future__ import annotations

from math import comb

from strata.functions import fixed_values as V
from strata.operators.chunking import ChunkParams, gear

FILES = {
    "documents": "SELECT doc_id AS file_id, encode(text) AS content FROM documents",
    "pages": "SELECT page_id AS file_id, encode(html) AS content FROM pages",
    "benchmark": "SELECT item_id AS file_id, encode(text) AS content FROM benchmark",
    "conversations": "SELECT conv_id AS file_id, encode(string_agg(text, chr(10) ORDER BY turn, text)) AS content FROM conversations GROUP BY conv_id",
}


def byte_rows(name: str, files: str) -> str:
    """CTEs {name}_files and {name}_bytes (file_id, p, x)."""
    return f"""
{name}_files AS (SELECT file_id, content, octet_length(content) AS n, hex(content) AS h FROM ({files})),
{name}_pairs AS (SELECT file_id, unnest(range(n)) AS p, unnest(regexp_extract_all(h, '..')) AS t FROM {name}_files),
{name}_bytes AS (SELECT file_id, p, CAST('0x' || t AS INTEGER) AS x FROM {name}_pairs)"""


def chunk_rows(name: str, files: str, params: ChunkParams) -> str:
    """CTEs that end in {name} (file_id, seq, offset_, length, chunk_id, h)."""
    bits, mask = params.bits, (1 << params.bits) - 1
    table = "[" + ", ".join(map(str, gear(bits))) + "]"
    sums = [f"(lag(g, {k}) OVER w << {k})" if k else "g" for k in range(bits)]
    zero = " + ".join(f"CASE WHEN (({' + '.join(sums[:m])}) & {mask}) = 0 THEN {1 << m} ELSE 0 END" for m in range(1, bits + 1))
    cut = f"""coalesce(list_filter(c.z, lambda e: e.p >= {{s}} + {params.smallest} AND e.p < least(f.n, {{s}} + {params.largest})
  AND ((e.m >> CAST(least(e.p - ({{s}} + {params.smallest}) + 1, {bits}) AS INTEGER)) & 1) = 1)[1].p + 1, least(f.n, {{s}} + {params.largest}))"""
    return f"""{byte_rows(name, files)},
{name}_gear AS (SELECT file_id, p, CAST({table}[x + 1] AS BIGINT) AS g FROM {name}_bytes),
{name}_mask AS (SELECT file_id, p, {zero} AS m FROM {name}_gear WINDOW w AS (PARTITION BY file_id ORDER BY p)),
{name}_zero AS (SELECT file_id, list({{'p': p, 'm': CAST(m AS BIGINT)}} ORDER BY p) AS z FROM {name}_mask WHERE m > 0 GROUP BY file_id),
{name}_cuts AS (
  SELECT f.file_id, CAST(0 AS BIGINT) AS seq, CAST(0 AS BIGINT) AS a, CAST({cut.format(s="0")} AS BIGINT) AS b
  FROM {name}_files f LEFT JOIN {name}_zero c ON f.file_id = c.file_id WHERE f.n > 0
  UNION ALL
  SELECT k.file_id, k.seq + 1, k.b, CAST({cut.format(s="k.b")} AS BIGINT)
  FROM {name}_cuts k JOIN {name}_files f ON k.file_id = f.file_id LEFT JOIN {name}_zero c ON k.file_id = c.file_id WHERE k.b < f.n),
{name} AS (SELECT k.file_id, k.seq, k.a AS offset_, k.b - k.a AS length, substr(f.h, 2 * k.a + 1, 2 * (k.b - k.a)) AS h,
  sha256(unhex(substr(f.h, 2 * k.a + 1, 2 * (k.b - k.a)))) AS chunk_id FROM {name}_cuts k JOIN {name}_files f ON k.file_id = f.file_id)"""


def histogram_rows(name: str, keys: str = "file_id") -> str:
    """SELECT of b0..b8 and n from {name}_bytes."""
    bins = ", ".join(f"CAST(count(*) FILTER (bit_count(CAST(x AS SMALLINT)) = {k}) AS BIGINT) AS b{k}" for k in range(9))
    return f"SELECT {keys}, {bins}, CAST(count(*) AS BIGINT) AS n FROM {name}_bytes GROUP BY {keys}"


def number(x: float) -> str:
    return f"CAST({x!r} AS DOUBLE)"


MEAN = "CASE WHEN n = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(" + " + ".join(f"b{k} * {k}" for k in range(9)) + " AS DOUBLE) / n END"
VARIANCE = "CASE WHEN n = 0 THEN CAST(0 AS DOUBLE) ELSE (" + " + ".join(f"({number(float(k))} - mean) * ({number(float(k))} - mean) * CAST(b{k} AS DOUBLE)" for k in range(9)) + ") / n END"
EXTREME = "CASE WHEN n = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(b0 + b8 AS DOUBLE) / n END"
_EXPECTED = [number(comb(8, k) / 256) for k in range(9)]
CHI = "CASE WHEN n = 0 THEN CAST(0 AS DOUBLE) ELSE " + " + ".join(f"(CAST(b{k} AS DOUBLE) / n - {e}) * (CAST(b{k} AS DOUBLE) / n - {e}) / {e}" for k, e in enumerate(_EXPECTED)) + " END"
CLASS = f"""CASE WHEN n = 0 THEN '{V.SPARSE}' WHEN extreme > {number(V.SPARSE_ABOVE)} THEN '{V.SPARSE}' WHEN chi < {number(V.RANDOM_BELOW)} THEN '{V.RANDOM}'
  WHEN mean >= {number(V.STRUCTURED_MEAN[0])} AND mean <= {number(V.STRUCTURED_MEAN[1])} AND variance < {number(V.STRUCTURED_VARIANCE)} THEN '{V.STRUCTURED}' ELSE '{V.DENSE}' END"""


def profile_rows(name: str, keys: str = "file_id") -> str:
    """CTE {name}_profile with mean, variance, extreme, chi and class."""
    return f"""
{name}_hist AS ({histogram_rows(name, keys)}),
{name}_m AS (SELECT *, {MEAN} AS mean, {EXTREME} AS extreme, {CHI} AS chi FROM {name}_hist),
{name}_v AS (SELECT *, {VARIANCE} AS variance FROM {name}_m),
{name}_profile AS (SELECT *, {CLASS} AS class FROM {name}_v)"""


def hamming(a: str, b: str) -> str:
    """Differing bits of two hexadecimal strings of equal length."""
    nibble = "strpos('0123456789ABCDEF', substr({}, CAST(i AS INTEGER), 1)) - 1"
    return f"list_sum(list_transform(range(1, length({a}) + 1), lambda i: bit_count(xor(CAST({nibble.format(a)} AS INTEGER), CAST({nibble.format(b)} AS INTEGER)))))"
