"""Queries by name, with the same results in SQL.

Chunk queries use small chunk sizes, so that texts of a few kB have several.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strata.functions import fixed_values as V
from strata.functions import histogram, identity, ring
from strata.functions.correlation import correlate
from strata.operators import chunking, codecs, decode, dedup, encode, similarity
from strata.operators.chunking import SMALL, ChunkParams
from strata.plans import oracle as O
from strata.sources import archive_file, files
from strata.spark import materialize, read_table, shared_dir

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


def _cut(spark: SparkSession, d: str, source=files.documents, params: ChunkParams = SMALL) -> DataFrame:
    return chunking.chunks(source(spark, d), params)


def _keys(spark: SparkSession, d: str, source=files.documents, params: ChunkParams = SMALL) -> DataFrame:
    """Chunks without their bytes."""
    return chunking.chunks(source(spark, d), params, data=False)


def _with(*ctes: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(c.strip() for c in ctes)


DOCS = O.chunk_rows("c", O.FILES["documents"], SMALL)
PAGES = O.chunk_rows("c", O.FILES["pages"], SMALL)
TWINS = O.chunk_rows("c", "SELECT page_id AS file_id, encode(html || chr(10) || replace(html, '<p>', '<q>')) AS content FROM pages", SMALL)


def twins(spark: SparkSession, d: str) -> DataFrame:
    """Pages, each followed by a copy in which some bytes differ: files with many
    repeated and near-duplicate chunks."""
    rows = files.pages(spark, d).withColumn("html", F.decode("content", "UTF-8"))
    return rows.select("file_id", F.encode(F.concat("html", F.lit("\n"), F.replace("html", F.lit("<p>"), F.lit("<q>"))), "UTF-8").alias("content"))


# --- scalar functions --------------------------------------------------------


@query("ring_ops", """SELECT x, y, (256 - x) & 255 AS neg, 255 - x AS bnot, xor(x, y) AS xor_, x & y AS band, x | y AS bor, (x + 1) & 255 AS succ, (x + 255) & 255 AS pred
FROM (SELECT i % 256 AS x, i // 256 AS y FROM (SELECT CAST(range AS INTEGER) AS i FROM range(65536)))""")
def ring_ops(spark: SparkSession, d: str) -> DataFrame:
    x, y = F.col("x"), F.col("y")
    pairs = spark.range(65536).select((F.col("id") % 256).cast("int").alias("x"), F.floor(F.col("id") / 256).cast("int").alias("y"))
    return pairs.select(x, y, ring.neg(x).alias("neg"), ring.bnot(x).alias("bnot"), ring.xor(x, y).alias("xor_"), ring.band(x, y).alias("band"), ring.bor(x, y).alias("bor"), ring.succ(x).alias("succ"), ring.pred(x).alias("pred"))


@query("byte_triad", """SELECT x AS datum, CAST(bit_count(x) AS INTEGER) AS stratum, array_to_string(list_transform(range(8), lambda i: CASE WHEN (x >> CAST(i AS INTEGER)) & 1 = 1 THEN '1' ELSE '0' END), '') AS spectrum,
array_to_string(list_filter(range(8), lambda i: (x >> CAST(i AS INTEGER)) & 1 = 1), ',') AS positions FROM (SELECT CAST(range AS INTEGER) AS x FROM range(256))""")
def byte_triad(spark: SparkSession, d: str) -> DataFrame:
    x = F.col("id").cast("int")
    t = ring.triad(x)
    bits = F.array_join(F.transform(t["spectrum"], lambda b: b.cast("int").cast("string")), "")
    return spark.range(256).select(t["datum"].alias("datum"), t["stratum"].alias("stratum"), bits.alias("spectrum"), F.array_join(ring.set_positions(x).cast("array<string>"), ",").alias("positions"))


@query("chunk_identity", f"""SELECT doc_id, h AS hex, '{V.CHUNK_URN}' || h[:16] AS urn, 'ChunkId(' || h[:16] || ')' AS debug, h[:16] AS display,
'{V.BRAILLE_IRI}' || array_to_string(list_transform(range(32), lambda i: chr(CAST(10240 + 16 * (strpos('0123456789abcdef', substr(h, CAST(2 * i + 1 AS INTEGER), 1)) - 1) + strpos('0123456789abcdef', substr(h, CAST(2 * i + 2 AS INTEGER), 1)) - 1 AS INTEGER))), '') AS iri,
h AS round_trip FROM (SELECT doc_id, sha256(text) AS h FROM documents)""")
def chunk_identity(spark: SparkSession, d: str) -> DataFrame:
    h = F.col("h")
    rows = read_table(spark, d, "documents").select("doc_id", identity.chunk_id(F.col("text")).alias("h"))
    return rows.select("doc_id", h.alias("hex"), identity.urn(h).alias("urn"), identity.debug(h).alias("debug"), identity.short(h).alias("display"), identity.braille_iri(h).alias("iri"), identity.from_bytes(identity.to_bytes(h)).alias("round_trip"))


@query("file_checksum", "SELECT page_id AS file_id, sha256(html) AS checksum FROM pages UNION ALL SELECT doc_id, sha256(text) FROM documents")
def file_checksum(spark: SparkSession, d: str) -> DataFrame:
    rows = files.pages(spark, d).unionByName(files.documents(spark, d))
    return rows.select("file_id", identity.file_checksum(F.col("content")).alias("checksum"))


# --- histograms and classes ----------------------------------------------------

_HIST = O.byte_rows("c", O.FILES["documents"])
_PROFILE = O.profile_rows("c")


@query("stratum_histogram", _with(_HIST) + O.histogram_rows("c").replace("SELECT", " SELECT", 1))
def stratum_histogram(spark: SparkSession, d: str) -> DataFrame:
    return histogram.with_bins(files.documents(spark, d), "content").select("file_id", *histogram.BINS, F.octet_length("content").cast("long").alias("n"))


@query("stratum_histogram_native", _with(O.byte_rows("c", O.FILES["pages"])) + O.histogram_rows("c").replace("SELECT", " SELECT", 1))
def stratum_histogram_native(spark: SparkSession, d: str) -> DataFrame:
    """The same counts without Python."""
    content = F.col("content")
    return files.pages(spark, d).select("file_id", *histogram.bins(content), F.octet_length(content).cast("long").alias("n"))


@query("stratum_moments", _with(_HIST, _PROFILE) + " SELECT file_id, mean, variance, extreme AS extreme_density, CAST(b4 AS DOUBLE) / n AS density4, "
       + "concat_ws(',', " + ", ".join(f"CAST(CAST(least(255, floor(CAST(b{k} AS DOUBLE) / n * CAST(255 AS DOUBLE))) AS INTEGER) AS VARCHAR)" for k in range(9)) + ") AS summary FROM c_profile")
def stratum_moments(spark: SparkSession, d: str) -> DataFrame:
    n, m = F.col("_n"), F.col("_mean")
    rows = histogram.measured(files.documents(spark, d), "content")
    return rows.select("file_id", m.alias("mean"), histogram.variance(n, m).alias("variance"), histogram.extreme_density(n).alias("extreme_density"), histogram.density(4, n).alias("density4"), F.array_join(histogram.summary(n).cast("array<string>"), ",").alias("summary"))


@query("chi_square", _with(_HIST, _PROFILE) + " SELECT file_id, chi AS chi_square FROM c_profile")
def chi_square(spark: SparkSession, d: str) -> DataFrame:
    return histogram.measured(files.documents(spark, d), "content").select("file_id", histogram.chi_square(F.col("_n")).alias("chi_square"))


@query("classify_chunks", _with(PAGES, "c_u AS (SELECT DISTINCT chunk_id, h FROM c)", "u_files AS (SELECT chunk_id, h, length(h) // 2 AS n FROM c_u)", "u_pos AS (SELECT chunk_id, h, unnest(range(n)) AS p FROM u_files)",
       "u_bytes AS (SELECT chunk_id, 16 * (strpos('0123456789ABCDEF', substr(h, 2 * p + 1, 1)) - 1) + strpos('0123456789ABCDEF', substr(h, 2 * p + 2, 1)) - 1 AS x FROM u_pos)", O.profile_rows("u", "chunk_id"))
       + " SELECT chunk_id, class FROM u_profile")
def classify_chunks(spark: SparkSession, d: str) -> DataFrame:
    unique = _cut(spark, d, files.pages).select("chunk_id", "data").dropDuplicates(["chunk_id"])
    return histogram.profiled(unique).select("chunk_id", "class")


# a float's four bytes, as bits; bytes with as many set bits stand for them
_FLOATS = """e_all AS (SELECT vec_id AS file_id, CAST(CAST(CAST(unnest(embedding) AS FLOAT) AS BIT) AS VARCHAR) AS bits FROM embeddings),
e_bytes AS (SELECT file_id, (1 << length(replace(substr(bits, CAST(8 * k + 1 AS INTEGER), 8), '0', ''))) - 1 AS x FROM e_all, (SELECT range AS k FROM range(4)))"""


@query("classify_embeddings", _with(_FLOATS, O.profile_rows("e")) + " SELECT file_id, " + ", ".join(f"b{k}" for k in range(9)) + ", class FROM e_profile")
def classify_embeddings(spark: SparkSession, d: str) -> DataFrame:
    return histogram.profiled(files.embeddings(spark, d), "content").select("file_id", *histogram.BINS, "class")


# --- chunks --------------------------------------------------------------------

_CHUNKS = " SELECT file_id, seq, offset_ AS \"offset\", length, chunk_id FROM c"


@query("cdc_chunks", _with(DOCS) + _CHUNKS)
def cdc_chunks(spark: SparkSession, d: str) -> DataFrame:
    return _keys(spark, d)


@query("cdc_chunks_pages", _with(PAGES) + _CHUNKS)
def cdc_chunks_pages(spark: SparkSession, d: str) -> DataFrame:
    return _keys(spark, d, files.pages)


@query("cdc_chunks_default", _with(O.chunk_rows("c", O.FILES["documents"], ChunkParams())) + _CHUNKS)
def cdc_chunks_default(spark: SparkSession, d: str) -> DataFrame:
    return _keys(spark, d, params=ChunkParams())


@query("chunk_coverage", "SELECT doc_id AS file_id, octet_length(encode(text)) AS n_bytes, octet_length(encode(text)) AS covered, true AS contiguous FROM documents")
def chunk_coverage(spark: SparkSession, d: str) -> DataFrame:
    return chunking.coverage(_keys(spark, d), files.documents(spark, d))


@query("chunk_store", _with(DOCS) + """ SELECT file_id, chunk_id, count(*) AS ref_count, min(offset_) AS first_offset, min(length) AS length,
row_number() OVER (PARTITION BY file_id ORDER BY min(offset_)) - 1 AS "index" FROM c GROUP BY file_id, chunk_id""")
def chunk_store(spark: SparkSession, d: str) -> DataFrame:
    return dedup.store(_keys(spark, d))


@query("store_lookup", _with(DOCS, "s AS (SELECT file_id, chunk_id, count(*) AS ref_count, row_number() OVER (PARTITION BY file_id ORDER BY min(offset_)) - 1 AS i FROM c GROUP BY file_id, chunk_id)")
       + " SELECT file_id, chunk_id, ref_count FROM s WHERE i = 1")
def store_lookup(spark: SparkSession, d: str) -> DataFrame:
    return dedup.get_by_index(dedup.store(_keys(spark, d)), 1).select("file_id", "chunk_id", "ref_count")


@query("store_iter", _with(DOCS, "s AS (SELECT file_id, chunk_id, min(offset_) AS a FROM c GROUP BY file_id, chunk_id)")
       + " SELECT file_id, sha256(string_agg(chunk_id, ',' ORDER BY a)) AS in_order, count(*) AS chunks, false AS is_empty FROM s GROUP BY file_id")
def store_iter(spark: SparkSession, d: str) -> DataFrame:
    """The unique chunks of each file in the order of iteration."""
    stored = dedup.store(_keys(spark, d))
    rows = dedup.in_order(stored).select("file_id", F.struct(F.monotonically_increasing_id().alias("place"), "chunk_id").alias("p"))
    listed = rows.groupBy("file_id").agg(F.sort_array(F.collect_list("p")).alias("ps"))
    return listed.select("file_id", F.sha2(F.array_join(F.transform("ps", lambda p: p["chunk_id"]), ","), 256).alias("in_order"), F.size("ps").cast("long").alias("chunks"), F.lit(dedup.is_empty(stored)).alias("is_empty"))


@query("first_occurrences", _with(DOCS) + " SELECT file_id, seq, chunk_id, row_number() OVER (PARTITION BY chunk_id ORDER BY file_id, offset_) = 1 AS is_new FROM c")
def first_occurrences(spark: SparkSession, d: str) -> DataFrame:
    return dedup.marked(_keys(spark, d), "corpus").select("file_id", "seq", "chunk_id", "is_new")


_STATS = """of_chunk AS (SELECT file_id, chunk_id, count(*) AS n, min(length) AS length FROM c GROUP BY file_id, chunk_id),
of_file AS (SELECT file_id, CAST(sum(n) AS BIGINT) AS chunk_count, count(*) AS unique_chunks, CAST(sum(n * length) AS BIGINT) AS total_bytes, CAST(sum((n - 1) * length) AS BIGINT) AS duplicate_bytes FROM of_chunk GROUP BY file_id)"""


@query("path_choice", _with(DOCS, _STATS) + f""" SELECT file_id, chunk_count, unique_chunks, chunk_count - unique_chunks AS duplicate_chunks, total_bytes, duplicate_bytes,
CAST(duplicate_bytes AS DOUBLE) / total_bytes AS dedup_fraction, CASE WHEN CAST(duplicate_bytes AS DOUBLE) / total_bytes < {O.number(V.DEDUP_THRESHOLD)} THEN 'single' ELSE 'chunked' END AS path FROM of_file""")
def path_choice(spark: SparkSession, d: str) -> DataFrame:
    return dedup.file_stats(files.documents(spark, d), _keys(spark, d))


@query("duplicate_files", "SELECT sha256(text) AS checksum, count(*) AS copies, min(doc_id) AS first_file FROM documents GROUP BY sha256(text) HAVING count(*) > 1")
def duplicate_files(spark: SparkSession, d: str) -> DataFrame:
    return dedup.duplicate_files(files.documents(spark, d))


_BENCH = O.chunk_rows("b", O.FILES["benchmark"], SMALL)


@query("known_chunks", _with(DOCS, _BENCH) + " SELECT file_id, seq, chunk_id FROM c WHERE EXISTS (SELECT 1 FROM b WHERE b.chunk_id = c.chunk_id)")
def known_chunks(spark: SparkSession, d: str) -> DataFrame:
    return dedup.contained(_keys(spark, d), _keys(spark, d, files.benchmark)).select("file_id", "seq", "chunk_id")


@query("missing_chunks", _with(DOCS, _BENCH) + " SELECT file_id, seq, chunk_id FROM c WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.chunk_id = c.chunk_id)")
def missing_chunks(spark: SparkSession, d: str) -> DataFrame:
    return dedup.missing(_keys(spark, d), _keys(spark, d, files.benchmark)).select("file_id", "seq", "chunk_id")


# --- similarity ------------------------------------------------------------------


def _unique_sql(scope: str) -> str:
    if scope == "file":
        return "u AS (SELECT file_id, chunk_id, length, h, row_number() OVER (PARTITION BY file_id ORDER BY offset_) - 1 AS useq FROM (SELECT *, row_number() OVER (PARTITION BY file_id, chunk_id ORDER BY offset_) AS nth FROM c) WHERE nth = 1)"
    return "u AS (SELECT file_id, chunk_id, length, h, row_number() OVER (ORDER BY file_id, offset_) - 1 AS useq FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY file_id, offset_) AS nth FROM c) WHERE nth = 1)"


def _pairs_sql(scope: str) -> str:
    same = "a.file_id = b.file_id AND" if scope == "file" else ""
    return f"""p AS (SELECT a.file_id, a.useq, a.chunk_id, b.chunk_id AS base_chunk_id, b.useq AS base_useq, a.length, {O.hamming("a.h", "b.h")} AS hamming,
{O.hamming("a.h[:128]", "b.h[:128]")} AS head FROM u a JOIN u b ON {same} a.length = b.length AND b.useq BETWEEN a.useq - {V.WINDOW} AND a.useq - 1),
q AS (SELECT *, CAST(1 AS DOUBLE) - CAST(hamming AS DOUBLE) / (8 * length) AS fidelity, CAST(1 AS DOUBLE) - CAST(head AS DOUBLE) / (8 * least(length, {V.PREFIX})) AS first_look FROM p)"""


_BEST = f"""r AS (SELECT *, row_number() OVER (PARTITION BY file_id, useq ORDER BY fidelity DESC, base_useq) AS nth FROM q WHERE first_look >= {O.number(V.FIDELITY)} * {O.number(V.PREFIX_PART)})
 SELECT file_id, useq, chunk_id, base_chunk_id, CAST(hamming AS BIGINT) AS hamming, fidelity FROM r WHERE nth = 1 AND fidelity >= {O.number(V.FIDELITY)}"""


@query("near_duplicates", _with(TWINS, _unique_sql("file"), _pairs_sql("file"), _BEST))
def near_duplicates(spark: SparkSession, d: str) -> DataFrame:
    unique = similarity.numbered(_cut(spark, d, twins))
    return similarity.best_bases(unique).select("file_id", "useq", "chunk_id", "base_chunk_id", "hamming", "fidelity")


@query("near_duplicates_corpus", _with(PAGES, _unique_sql("corpus"), _pairs_sql("corpus"), _BEST))
def near_duplicates_corpus(spark: SparkSession, d: str) -> DataFrame:
    unique = similarity.numbered(_cut(spark, d, files.pages), "corpus")
    return similarity.best_bases(unique).select("file_id", "useq", "chunk_id", "base_chunk_id", "hamming", "fidelity")


@query("near_duplicates_loose", _with(PAGES, _unique_sql("corpus"), _pairs_sql("corpus"), _BEST.replace(O.number(V.FIDELITY), O.number(0.6))))
def near_duplicates_loose(spark: SparkSession, d: str) -> DataFrame:
    """With a threshold of one's own."""
    unique = similarity.numbered(_cut(spark, d, files.pages), "corpus")
    return similarity.best_bases(unique, 0.6).select("file_id", "useq", "chunk_id", "base_chunk_id", "hamming", "fidelity")


@query("candidate_pairs", _with(PAGES, _unique_sql("corpus"), _pairs_sql("corpus")) + " SELECT file_id, useq, base_useq, CAST(hamming AS BIGINT) AS hamming, 8 * length AS max_bits, fidelity FROM q")
def candidate_pairs(spark: SparkSession, d: str) -> DataFrame:
    unique = similarity.numbered(_cut(spark, d, files.pages), "corpus")
    return similarity.best_bases(unique, everything=True).select("file_id", "useq", "base_useq", "hamming", "max_bits", "fidelity")


_DOC_BYTES = O.byte_rows("c", O.FILES["documents"])


@query("pair_correlation", _with(_DOC_BYTES, "s AS (SELECT file_id, CAST(sum(bit_count(CAST(xor(x, 97) AS SMALLINT))) AS BIGINT) AS hamming, CAST(8 * count(*) AS BIGINT) AS max_bits FROM c_bytes GROUP BY file_id)")
       + " SELECT file_id, hamming, max_bits, CAST(1 AS DOUBLE) - CAST(hamming AS DOUBLE) / max_bits AS fidelity FROM s")
def pair_correlation(spark: SparkSession, d: str) -> DataFrame:
    """Every text with as many letters a."""
    rows = files.documents(spark, d).withColumn("other", F.encode(F.repeat(F.lit("a"), F.octet_length("content")), "UTF-8"))
    return rows.select("file_id", *correlate(F.col("content"), F.col("other")))


# --- codecs and routing ------------------------------------------------------------


@query("quantize_bytes", _with(O.byte_rows("c", O.FILES["pages"]), "q AS (SELECT file_id, p, CASE WHEN bit_count(CAST(x AS SMALLINT)) <= 3 THEN x & 252 ELSE x END AS y FROM c_bytes)")
       + " SELECT file_id, sha256(unhex(string_agg(printf('%02X', CAST(y AS INTEGER)), '' ORDER BY p))) AS checksum FROM q GROUP BY file_id")
def quantize_bytes(spark: SparkSession, d: str) -> DataFrame:
    return files.pages(spark, d).select("file_id", identity.chunk_id(codecs.quantized(F.col("content"), 3)).alias("checksum"))


_HEXED = "string_agg(printf('%02X', CAST(y AS INTEGER)), '' ORDER BY p)"


@query("xor_bytes", _with(_DOC_BYTES, "d AS (SELECT file_id, sha256(content) AS digest FROM c_files)", "q AS (SELECT file_id, p, xor(x, ascii(substr(digest, CAST(p + 1 AS INTEGER), 1))) AS y FROM c_bytes JOIN d USING (file_id) WHERE p < 64)")
       + f" SELECT file_id, {_HEXED} AS xored FROM q GROUP BY file_id")
def xor_bytes(spark: SparkSession, d: str) -> DataFrame:
    """Every text with the 64 letters of its digest: as far as the shorter goes."""
    content = F.col("content")
    return files.documents(spark, d).select("file_id", F.hex(codecs.xored(content, F.encode(identity.chunk_id(content), "UTF-8"))).alias("xored"))


@query("delta_residual", _with(_DOC_BYTES, "q AS (SELECT file_id, p, xor(x, 97) AS y FROM c_bytes)") + f" SELECT file_id, sha256(unhex({_HEXED})) AS checksum FROM q GROUP BY file_id")
def delta_residual(spark: SparkSession, d: str) -> DataFrame:
    """What a delta holds: every text against as many letters a."""
    base = F.encode(F.repeat(F.lit("a"), F.octet_length("content")), "UTF-8")
    packed = files.documents(spark, d).select("file_id", "content", codecs.encoded("Delta", F.col("content"), 3, base).alias("packed"))
    return packed.select("file_id", identity.chunk_id(codecs.decoded("Zstd", F.col("packed"), F.octet_length("content"))).alias("checksum"))


def _quantized_sql(x: str, most: int) -> str:
    return f"CASE WHEN bit_count(CAST({x} AS SMALLINT)) <= {most} THEN {x} & 252 ELSE {x} END"


@query("round_trip_quantized", _with(_DOC_BYTES, f"q AS (SELECT file_id, p, {_quantized_sql('x', 2)} AS y FROM c_bytes)") + f" SELECT file_id, sha256(unhex({_HEXED})) AS checksum FROM q GROUP BY file_id")
def round_trip_quantized(spark: SparkSession, d: str) -> DataFrame:
    """Quantized, packed and unpacked: the bits that were cleared stay so."""
    packed = files.documents(spark, d).select("file_id", "content", codecs.encoded("Quantized", F.col("content")).alias("packed"))
    return packed.select("file_id", identity.chunk_id(codecs.decoded("Quantized", F.col("packed"), F.octet_length("content"))).alias("checksum"))


@query("lossy_delta", _with(_DOC_BYTES, f"t AS (SELECT file_id, p, x, CASE WHEN x = 101 THEN 97 ELSE x END AS t, {_quantized_sql('x', 3)} AS z FROM c_bytes)", "q AS (SELECT file_id, p, xor(xor(t, x), z) AS y FROM t)")
       + f" SELECT file_id, sha256(unhex({_HEXED})) AS checksum FROM q GROUP BY file_id")
def lossy_delta(spark: SparkSession, d: str) -> DataFrame:
    """Deltas against the text, decoded against what quantizing made of it."""
    text, target = F.col("content"), F.encode(F.translate(F.decode("content", "UTF-8"), "e", "a"), "UTF-8")
    rows = files.documents(spark, d).select("file_id", "content", codecs.encoded("Delta", target, 3, text).alias("packed"), codecs.quantized(text, 3).alias("left"))
    return rows.select("file_id", identity.chunk_id(codecs.decoded("Delta", F.col("packed"), F.octet_length("content"), F.col("left"))).alias("checksum"))


@query("backend_tags", "SELECT * FROM (VALUES (0, 'Identity'), (1, 'Zstd'), (2, 'Lz4'), (3, 'Delta'), (4, 'Quantized'), (5, 'Reference')) AS t(tag, name)")
def backend_tags(spark: SparkSession, d: str) -> DataFrame:
    tag = F.col("id").cast("int")
    return spark.range(6).select(tag.alias("tag"), codecs.name_of(tag).alias("name"))


@query("ratios", "SELECT file_id, CASE WHEN k = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(n AS DOUBLE) / k END AS ratio FROM (SELECT doc_id AS file_id, octet_length(encode(text)) AS n, octet_length(encode(text)) % 7 AS k FROM documents)")
def ratios(spark: SparkSession, d: str) -> DataFrame:
    n = F.octet_length("content")
    return files.documents(spark, d).select("file_id", dedup.ratio(n, n % 7).alias("ratio"))


def _round_trip(name: str) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        rows = files.documents(spark, d).select("file_id", "content", codecs.dictionary(F.col("content")).alias("dictionary"), F.encode(F.repeat(F.lit("a"), F.octet_length("content")), "UTF-8").alias("base"))
        other = {"Delta": F.col("base"), "Zstd+dictionary": F.col("dictionary")}.get(name)
        codec = name.split("+")[0]
        packed = rows.select("file_id", "content", "dictionary", "base", codecs.encoded(codec, F.col("content"), 3, other).alias("packed"))
        return packed.select("file_id", identity.file_checksum(codecs.decoded(codec, F.col("packed"), F.octet_length("content"), other)).alias("checksum"))

    return run


for _name in ("Identity", "Zstd", "Zstd+dictionary", "Lz4", "Delta"):
    query(f"round_trip_{_name.lower().replace('+', '_')}", "SELECT doc_id AS file_id, sha256(text) AS checksum FROM documents")(_round_trip(_name))


@query("dictionary_sample", f"""SELECT file_id, CASE WHEN n <= {V.DICTIONARY_MAX} THEN sha256(content) ELSE sha256(unhex({" || ".join(f"substr(h, 2 * {i} * (n // 16) + 1, {2 * V.DICTIONARY_SAMPLE})" for i in range(16))})) END AS checksum
FROM (SELECT 0 AS file_id, content, hex(content) AS h, octet_length(content) AS n FROM (SELECT encode(string_agg(text, chr(10) ORDER BY doc_id)) AS content FROM documents)
UNION ALL SELECT doc_id + 1, encode(text), hex(encode(text)), octet_length(encode(text)) FROM documents)""")
def dictionary_sample(spark: SparkSession, d: str) -> DataFrame:
    docs = read_table(spark, d, "documents")
    whole = _joined_samples(docs).select(F.lit(0).cast("long").alias("file_id"), identity.chunk_id(F.col("content")).alias("checksum"))
    rows = docs.select((F.col("doc_id") + 1).alias("file_id"), identity.chunk_id(codecs.dictionary(F.encode("text", "UTF-8"))).alias("checksum"))
    return whole.unionByName(rows)


def _joined_samples(docs: DataFrame) -> DataFrame:
    """content: the dictionary of all texts joined by newlines, in the order of doc_id.

    The joined texts are never made: places are running sums of lengths, and only
    the bytes of the samples (64 KiB) come together.
    """
    ordered = docs.filter(F.col("text").isNotNull()).repartitionByRange("doc_id", "text").sortWithinPartitions("doc_id", "text")
    texts = materialize(ordered.select(F.monotonically_increasing_id().alias("place"), F.concat(F.encode("text", "UTF-8"), F.encode(F.lit("\n"), "UTF-8")).alias("line")), "lines", 0)
    sizes = texts.select("place", F.shiftright("place", 33).alias("part"), F.octet_length("line").cast("long").alias("n"))
    of_part = sizes.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect()
    before = dict(zip((r["part"] for r in of_part), accumulate((r["n"] for r in of_part), initial=0), strict=False))
    total = max(0, sum(r["n"] for r in of_part) - 1)
    step = total // V.DICTIONARY_SAMPLES
    wanted = [(0, total)] if total <= V.DICTIONARY_MAX else [(step * i, min(step * i + V.DICTIONARY_SAMPLE, total)) for i in range(V.DICTIONARY_SAMPLES)]
    parts = docs.sparkSession.createDataFrame(list(before.items()), "part long, first long")
    within = Window.partitionBy("part").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    at = sizes.withColumn("so_far", F.coalesce(F.sum("n").over(within), F.lit(0))).join(F.broadcast(parts), "part").select("place", "n", (F.col("first") + F.col("so_far")).alias("at"))
    ranges = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(a).cast("long").alias("a"), F.lit(z).cast("long").alias("z")) for k, (a, z) in enumerate(wanted)))
    hit = at.select("place", "at", "n", F.explode(F.filter(ranges, lambda r: (r["a"] < F.col("at") + F.col("n")) & (r["z"] > F.col("at")))).alias("r"))
    start = F.greatest(F.col("r.a") - F.col("at"), F.lit(0))
    cut = F.substring("line", (start + 1).cast("int"), (F.least(F.col("r.z") - F.col("at"), F.col("n")) - start).cast("int"))
    pieces = texts.join(F.broadcast(hit), "place").select(F.struct(F.col("r.k"), "at", F.hex(cut).alias("piece")).alias("p"))
    return pieces.agg(F.unhex(F.array_join(F.transform(F.sort_array(F.collect_list("p")), lambda p: p["piece"]), "")).alias("content"))


@query("standard_route", f"""SELECT class, level, CASE WHEN class = '{V.RANDOM}' THEN 'Lz4' WHEN class = '{V.SPARSE}' THEN 'Zstd' WHEN level = 'fast' THEN 'Lz4' ELSE 'Zstd' END AS codec,
CASE WHEN class = '{V.SPARSE}' THEN 19 WHEN level = 'fast' THEN 1 WHEN level = 'default' THEN 3 ELSE 19 END AS zstd_level
FROM (SELECT unnest(['{V.SPARSE}', '{V.STRUCTURED}', '{V.DENSE}', '{V.RANDOM}']) AS class), (SELECT unnest(['fast', 'default', 'best']) AS level)""")
def standard_route(spark: SparkSession, d: str) -> DataFrame:
    kinds = spark.createDataFrame([(k,) for k in (V.SPARSE, V.STRUCTURED, V.DENSE, V.RANDOM)], "class string")
    out = None
    for level in V.ZSTD_LEVEL:
        codec, number = encode.standard_route(F.col("class"), level)
        rows = kinds.select("class", F.lit(level).alias("level"), codec.alias("codec"), number.alias("zstd_level"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query("standard_guard", "SELECT file_id, kind, level, CASE WHEN kind = 'digest' THEN 'Identity' WHEN level = 'fast' THEN 'Lz4' ELSE 'Zstd' END AS backend FROM (SELECT doc_id AS file_id FROM documents), (SELECT unnest(['digest', 'letters']) AS kind), (SELECT unnest(['fast', 'default', 'best']) AS level)")
def standard_guard(spark: SparkSession, d: str) -> DataFrame:
    """The standard codec of chunks that it can't make smaller (32 bytes of a
    digest) and of some that it can (a thousand equal letters)."""
    text = F.col("content")
    kinds = F.array(F.struct(F.lit("digest").alias("kind"), F.unhex(identity.chunk_id(text)).alias("data")), F.struct(F.lit("letters").alias("kind"), F.encode(F.repeat(F.lit("a"), 1000), "UTF-8").alias("data")))
    rows = histogram.profiled(files.documents(spark, d).select("file_id", F.explode(kinds).alias("k")).select("file_id", "k.*")).select("file_id", "kind", "class", "data")
    out = None
    for name in V.ZSTD_LEVEL:
        codec, number = encode.standard_route(F.col("class"), name)
        made = encode.encoded_rows(rows.select("file_id", "kind", codec.alias("codec"), number.alias("level"), "data", F.lit(None).cast("binary").alias("base")))
        made = made.select("file_id", "kind", F.lit(name).alias("level"), codecs.name_of(F.col("tag")).alias("backend"))
        out = made if out is None else out.unionByName(made)
    return out


# --- archives ------------------------------------------------------------------------


def _archives(spark: SparkSession, d: str, source=files.documents, **options) -> encode.Archives:
    return encode.compress(source(spark, d), encode.CompressConfig(chunk_params=SMALL, **options))


_SINGLE = f"CAST(duplicate_bytes AS DOUBLE) / total_bytes < {O.number(V.DEDUP_THRESHOLD)} AS single"
_DELTAS = "best AS (" + _BEST[_BEST.index("SELECT file_id, useq, chunk_id, base") :] + ")"
_CLOSE = _BEST[: _BEST.index("SELECT file_id, useq, chunk_id, base")].rstrip()


@query("compress_stats", _with(PAGES, _STATS, _unique_sql("file"), _pairs_sql("file"), _CLOSE, _DELTAS, "k AS (SELECT file_id, count(*) AS deltas FROM best GROUP BY file_id)")
       + f""" SELECT f.file_id, total_bytes AS original_size, CASE WHEN single THEN 1 ELSE chunk_count END AS chunk_count, CASE WHEN single THEN 1 ELSE unique_chunks END AS unique_chunks,
CASE WHEN single THEN 0 ELSE chunk_count - unique_chunks END AS duplicate_chunks, CASE WHEN single THEN 0 ELSE coalesce(deltas, 0) END AS delta_chunks, true AS is_the_file_s_size
FROM (SELECT *, {_SINGLE} FROM of_file) f LEFT JOIN k ON f.file_id = k.file_id""")  # fmt: skip
def compress_stats(spark: SparkSession, d: str) -> DataFrame:
    """Sizes depend on the codecs' versions; they are held against the files."""
    made = _archives(spark, d, files.pages, emit_manifest=True)
    sizes = archive_file.to_files(made).select("file_id", F.octet_length("archive").alias("of_file"))
    holds = F.col("compressed_size") == F.col("of_file")
    return made.stats.join(sizes, "file_id").select("file_id", "original_size", "chunk_count", "unique_chunks", "duplicate_chunks", "delta_chunks", holds.alias("is_the_file_s_size"))


@query("toc_offsets", _with(PAGES, _STATS, _unique_sql("file"), f"w AS (SELECT *, {_SINGLE} FROM of_file)") + f""" SELECT u.file_id, useq, CASE WHEN useq = 0 THEN least(total_bytes, {V.DICTIONARY_MAX}) + {V.HEADER_BYTES + 4} ELSE 0 END AS gap
FROM u JOIN w ON u.file_id = w.file_id WHERE NOT single UNION ALL SELECT file_id, 0, {V.HEADER_BYTES} FROM w WHERE single""")
def toc_offsets(spark: SparkSession, d: str) -> DataFrame:
    """Where payloads begin: behind header and dictionary, and without gaps."""
    toc = _archives(spark, d, files.pages).toc
    order = Window.partitionBy("file_id").orderBy("useq")
    before = F.lag(F.col("data_offset") + F.col("compressed_size")).over(order)
    return toc.select("file_id", "useq", (F.col("data_offset") - F.coalesce(before, F.lit(0))).alias("gap"))


@query("toc_lookup", _with(TWINS, _STATS, _unique_sql("file"), f"w AS (SELECT *, {_SINGLE} FROM of_file)", "e AS (SELECT u.file_id, useq, chunk_id, CAST(u.length AS BIGINT) AS original_size FROM u JOIN w ON u.file_id = w.file_id WHERE NOT single)")
       + " SELECT * FROM e WHERE chunk_id IN (SELECT chunk_id FROM e ORDER BY chunk_id LIMIT 1) UNION SELECT * FROM e WHERE chunk_id IN (SELECT min(chunk_id) FROM e GROUP BY file_id)")
def toc_lookup(spark: SparkSession, d: str) -> DataFrame:
    """The entries of each file's smallest chunk id, looked up in the tables of contents."""
    made = _archives(spark, d, twins)
    wanted = made.toc.groupBy("file_id").agg(F.min("chunk_id").alias("chunk_id")).select("chunk_id").distinct()
    return decode.find_entries(made, wanted).select("file_id", "useq", "chunk_id", "original_size")


def _restored(source, level: str) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        out = decode.decompress(_archives(spark, d, source, level=level))
        return out.select("file_id", identity.file_checksum(F.col("content")).alias("checksum"), "status")

    return run


for _level in V.ZSTD_LEVEL:
    query(f"restore_pages_{_level}", "SELECT page_id AS file_id, sha256(html) AS checksum, 'ok' AS status FROM pages")(_restored(files.pages, _level))
query("restore_twins", "SELECT page_id AS file_id, sha256(html || chr(10) || replace(html, '<p>', '<q>')) AS checksum, 'ok' AS status FROM pages")(_restored(twins, "default"))
query("restore_documents", "SELECT doc_id AS file_id, sha256(text) AS checksum, 'ok' AS status FROM documents")(_restored(files.documents, "default"))


@query("restore_conversations", "SELECT conv_id AS file_id, sha256(string_agg(text, chr(10) ORDER BY turn, text)) AS checksum, 'ok' AS status FROM conversations GROUP BY conv_id")
def restore_conversations(spark: SparkSession, d: str) -> DataFrame:
    return _restored(files.conversations, "default")(spark, d)


@query("restore_archive_files", "SELECT page_id AS file_id, sha256(html) AS checksum, 'ok' AS status FROM pages")
def restore_archive_files(spark: SparkSession, d: str) -> DataFrame:
    """Through the bytes of archive files and back."""
    made = archive_file.to_files(_archives(spark, d, files.pages, emit_manifest=True, emit_certificates=True))
    out = decode.decompress(archive_file.from_files(made))
    return out.select("file_id", identity.file_checksum(F.col("content")).alias("checksum"), "status")


@query("delta_chunks", _with(TWINS, _STATS, _unique_sql("file"), _pairs_sql("file"), _BEST.replace(" SELECT file_id, useq, chunk_id, base_chunk_id, CAST(hamming AS BIGINT) AS hamming, fidelity FROM r", " SELECT r.file_id, r.chunk_id, r.chunk_id AS checksum FROM r JOIN of_file f ON r.file_id = f.file_id")
       .replace("WHERE nth = 1 AND", f"WHERE CAST(f.duplicate_bytes AS DOUBLE) / f.total_bytes >= {O.number(V.DEDUP_THRESHOLD)} AND nth = 1 AND")))
def delta_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks stored as deltas, decoded along their chains."""
    made = _archives(spark, d, twins)
    deltas = made.toc.filter(F.col("tag") == codecs.TAGS["Delta"]).select("file_id", "chunk_id")
    return decode.decode_chunks(made).join(deltas, ["file_id", "chunk_id"], "left_semi").select("file_id", "chunk_id", identity.chunk_id(F.col("data")).alias("checksum"))


# class and bytes of each chunk of pages
_CLASSES = ("c_u AS (SELECT DISTINCT chunk_id, h FROM c)", "u_files AS (SELECT chunk_id, h, length(h) // 2 AS n FROM c_u)", "u_pos AS (SELECT chunk_id, h, unnest(range(n)) AS p FROM u_files)",
            "u_bytes AS (SELECT chunk_id, p, 16 * (strpos('0123456789ABCDEF', substr(h, 2 * p + 1, 1)) - 1) + strpos('0123456789ABCDEF', substr(h, 2 * p + 2, 1)) - 1 AS x FROM u_pos)", O.profile_rows("u", "chunk_id"))


@query("restore_lossy", _with(PAGES, *_CLASSES, f"q AS (SELECT b.chunk_id, p, CASE WHEN class IN ('{V.STRUCTURED}', '{V.DENSE}') THEN {_quantized_sql('x', 2)} ELSE x END AS y FROM u_bytes b JOIN u_profile k ON b.chunk_id = k.chunk_id)", f"z AS (SELECT chunk_id, {_HEXED} AS h FROM q GROUP BY chunk_id)")
       + " SELECT c.file_id, sha256(unhex(string_agg(z.h, '' ORDER BY offset_))) AS checksum, 'skipped_lossy' AS status FROM c JOIN z ON c.chunk_id = z.chunk_id GROUP BY c.file_id")
def restore_lossy(spark: SparkSession, d: str) -> DataFrame:
    """Lossy archives give back quantized bytes, and say that they can't be checked."""
    out = decode.decompress(_archives(spark, d, files.pages, mode="lossy", level="fast"))
    return out.select("file_id", identity.file_checksum(F.col("content")).alias("checksum"), "status")


_DOC_KINDS = f"w AS (SELECT *, {_SINGLE} FROM of_file)"


@query("bad_chunks", _with(DOCS, _STATS, _unique_sql("file"), _DOC_KINDS) + " SELECT u.file_id, chunk_id, sha256('damaged ' || chunk_id) AS actual FROM u JOIN w ON u.file_id = w.file_id WHERE NOT single AND useq % 3 = 1")
def bad_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Every third chunk holds other bytes than its address says."""
    made = _archives(spark, d, level="fast")
    hit = F.col("chunk_id").isNotNull() & (F.col("useq") % 3 == 1)
    other = F.encode(F.concat(F.lit("damaged "), "chunk_id"), "UTF-8")
    toc = made.toc.withColumns({"payload": F.when(hit, other).otherwise(F.col("payload")), "tag": F.when(hit, codecs.TAGS["Identity"]).otherwise(F.col("tag"))})
    return decode.bad_chunks(replace(made, toc=toc))


@query("verify_damaged", _with(DOCS, _STATS, _DOC_KINDS) + " SELECT file_id, CASE WHEN NOT single AND file_id % 3 = 0 THEN 'out_of_bounds' WHEN file_id % 3 = 1 THEN 'checksum' ELSE 'ok' END AS status FROM w")
def verify_damaged(spark: SparkSession, d: str) -> DataFrame:
    """Maps that reach beyond their chunks, and checksums of other contents."""
    made = _archives(spark, d, level="fast")
    file_map = made.file_map.withColumn("length", F.col("length") + F.when(F.col("file_id") % 3 == 0, 1).otherwise(0))
    heads = made.archives.withColumn("checksum", F.when(F.col("file_id") % 3 == 1, F.sha2(F.lit("other"), 256)).otherwise(F.col("checksum")))
    return decode.verify(replace(made, file_map=file_map, archives=heads))


@query("restore_empty", f"""SELECT doc_id AS file_id, CASE WHEN doc_id % 3 = 0 THEN 'empty' ELSE 'single' END AS path, CASE WHEN doc_id % 3 = 0 THEN 0 ELSE octet_length(encode(left(text, 40))) END AS original_size,
CASE WHEN doc_id % 3 = 0 THEN 0 ELSE 1 END AS chunk_count, CASE WHEN doc_id % 3 = 0 THEN 0 ELSE {V.SINGLE_STREAM} END AS flags, CASE WHEN doc_id % 3 = 0 THEN {V.HEADER_BYTES} END AS empty_bytes,
CASE WHEN doc_id % 3 = 0 THEN sha256('') ELSE sha256(left(text, 40)) END AS checksum, 'ok' AS status FROM documents""")
def restore_empty(spark: SparkSession, d: str) -> DataFrame:
    """Empty files among short ones, as archive files and back."""
    docs = read_table(spark, d, "documents")
    short = docs.select(F.col("doc_id").alias("file_id"), F.when(F.col("doc_id") % 3 == 0, F.encode(F.lit(""), "UTF-8")).otherwise(F.encode(F.substring("text", 1, 40), "UTF-8")).alias("content"))
    made = archive_file.to_files(encode.compress(short))
    back = archive_file.from_files(made)
    heads = back.archives.select("file_id", "path", "original_size", "chunk_count", "flags")
    size = made.select("file_id", F.octet_length("archive").alias("n"))
    out = decode.decompress(back).select("file_id", identity.file_checksum(F.col("content")).alias("checksum"), "status")
    return heads.join(size, "file_id").join(out, "file_id").select("file_id", "path", "original_size", "chunk_count", "flags", F.when(F.col("path") == "empty", F.col("n")).alias("empty_bytes"), "checksum", "status")


@query("scan_files", "SELECT page_id AS file_id, sha256(html) AS checksum, 'ok' AS status FROM pages")
def scan_files(spark: SparkSession, d: str) -> DataFrame:
    """Pages written as files, read whole, archived as files and restored."""
    folder = f"{shared_dir(spark)}/files-{uuid.uuid4().hex}"
    archive_file.write_files(files.pages(spark, d), folder)
    made = encode.compress(files.read_files(spark, folder), encode.CompressConfig(chunk_params=SMALL))
    archive_file.write_archives(made.named(F.regexp_extract("file_id", "[^/]*$", 0)), f"{folder}-archives")
    out = decode.decompress(archive_file.read_archives(spark, f"{folder}-archives"))
    page = F.regexp_extract("file_id", f"([^/]*)\\{V.EXTENSION}$", 1).cast("long")
    return out.select(page.alias("file_id"), identity.file_checksum(F.col("content")).alias("checksum"), "status")


@query("inspect", _with(PAGES, _STATS) + f""" SELECT file_id, 1 AS version, total_bytes AS original_size, false AS is_lossy, NOT single AS has_manifest, single AS is_single_stream,
CASE WHEN single THEN 1 ELSE unique_chunks END AS chunk_count FROM (SELECT *, CAST(duplicate_bytes AS DOUBLE) / total_bytes < {O.number(V.DEDUP_THRESHOLD)} AS single FROM of_file)""")
def inspect(spark: SparkSession, d: str) -> DataFrame:
    return decode.inspect(_archives(spark, d, files.pages, emit_manifest=True)).drop("file_map_count")


_ROUTE = f"CASE WHEN n.base_chunk_id IS NOT NULL THEN 'Delta' WHEN class IN ('{V.STRUCTURED}', '{V.DENSE}') THEN 'Quantized' ELSE 'standard' END"
_LOSSY = (PAGES, _unique_sql("file"), _pairs_sql("file"), _CLOSE, "n AS (" + _BEST[_BEST.index("SELECT file_id, useq, chunk_id, base") :] + ")", *_CLASSES)
_ROUTED = "u LEFT JOIN n ON u.file_id = n.file_id AND u.useq = n.useq JOIN u_profile k ON u.chunk_id = k.chunk_id"


def _routed(backend: Column) -> Column:
    return F.when(backend.isin("Delta", "Quantized"), backend).otherwise("standard")


@query("inspect_chunks", _with(*_LOSSY) + f" SELECT u.file_id, u.useq, u.chunk_id, {_ROUTE} AS backend, u.length AS original_size, true AS ratio_holds FROM {_ROUTED}")
def inspect_chunks(spark: SparkSession, d: str) -> DataFrame:
    """A delta goes before quantizing, and that before the standard codecs."""
    rows = decode.inspect_chunks(_archives(spark, d, files.pages, mode="lossy"))
    holds = F.abs(F.col("ratio") * F.col("compressed_size") - F.col("original_size")) < 1e-6
    return rows.select("file_id", "useq", "chunk_id", _routed(F.col("backend")).alias("backend"), "original_size", holds.alias("ratio_holds"))


_CERT = f"'{V.CHUNK_URN}' || chunk_id[:16] || '|Identity|{V.COMPRESSED_URN}' || chunk_id || '|' || length || '|' || length"


@query("certificate_ids", _with(PAGES, _unique_sql("file")) + f" SELECT file_id, useq, '{V.DERIVATION_URN}' || sha256({_CERT})[:16] AS derivation_id FROM u")
def certificate_ids(spark: SparkSession, d: str) -> DataFrame:
    """Certificates of chunks stored as they are."""
    unique = similarity.numbered(_cut(spark, d, files.pages))
    none = F.lit(None)
    rows = histogram.profiled(unique).withColumns({"tag": F.lit(codecs.TAGS["Identity"]), "payload": F.col("data"), "base_chunk_id": none.cast("string"), "fidelity": none.cast("double")})
    return encode.certificates(rows, encode.CompressConfig()).select("file_id", "useq", "derivation_id")


_NEAR = "'NearDuplicate { base: ChunkId(' || n.base_chunk_id[:16] || '), fidelity: ' || CAST(n.fidelity AS VARCHAR) || ' }'"


@query("manifest_nodes", _with(*_LOSSY, "t AS (SELECT file_id, count(*) AS occurrences, CAST(sum(length) AS BIGINT) AS total FROM c GROUP BY file_id)", "g AS (SELECT file_id, count(*) AS kinds FROM u GROUP BY file_id)")
       + f""" SELECT u.file_id, CAST(u.useq + 1 AS BIGINT) AS node, 'derivation:Derivation' AS type, '{V.CHUNK_URN}' || u.chunk_id[:16] AS source, CASE WHEN n.base_chunk_id IS NULL THEN class ELSE {_NEAR} END AS classification,
{_ROUTE} AS backend, CAST(u.length AS BIGINT) AS size, '[' || concat_ws(',', {", ".join(f"CAST(b{k} AS VARCHAR)" for k in range(9))}) || ']' AS counts, '{V.LOSSY_FIDELITY}' AS told FROM {_ROUTED}
UNION ALL SELECT f.file_id, 0, 'proof:CoherenceProof', '{V.ARCHIVE_URN}' || sha256(content)[:16], NULL, NULL, total, CAST(kinds AS VARCHAR) || '/' || CAST(occurrences AS VARCHAR), 'true/false' FROM c_files f JOIN t ON f.file_id = t.file_id JOIN g ON f.file_id = g.file_id""")  # fmt: skip
def manifest_nodes(spark: SparkSession, d: str) -> DataFrame:
    """The nodes of the manifests that archive files hold.  What depends on the
    codecs' versions is left out: addresses of payloads and what contains them."""
    made = _archives(spark, d, files.pages, mode="lossy", emit_manifest=True, emit_certificates=True)
    manifests = archive_file.from_files(archive_file.to_files(made)).manifests
    graph = F.from_json("manifest", "struct<`@graph`: array<map<string, string>>>")["@graph"]
    rows = manifests.select("file_id", F.posexplode(graph).alias("node", "m"))
    m = lambda key: F.col("m")[key]
    proof = m("@type") == "proof:CoherenceProof"
    return rows.select(
        "file_id", F.col("node").cast("long").alias("node"), m("@type").alias("type"), F.when(proof, m("@id")).otherwise(m("derivation:source")).alias("source"), m("derivation:classification").alias("classification"),
        F.when(~proof, _routed(m("derivation:backend"))).alias("backend"), F.when(proof, m("proof:originalSize")).otherwise(m("derivation:originalSize")).cast("long").alias("size"),
        F.when(proof, F.concat_ws("/", m("proof:chunkCount"), m("proof:fileMapCount"))).otherwise(F.regexp_replace(m("observable:stratumHistogram"), r"\s", "")).alias("counts"),
        F.when(proof, F.concat_ws("/", m("proof:lossy"), m("proof:verified"))).otherwise(m("observable:fidelity")).alias("told"),
    )
