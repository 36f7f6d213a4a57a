from __future__ import annotations

import hashlib
import json
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strata.errors import DecompressError, InvalidArchive, UnsupportedBackend
from strata.functions import fixed_values as V
from strata.operators import codecs, decode, encode
from strata.operators.chunking import ChunkParams
from strata.operators.encode import CompressConfig
from strata.sources import archive_file, tables

SMALL = ChunkParams(64, 256, 1024)


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=2000), st.binary(min_size=8, max_size=300))
def test_codecs_round_trip(data, dictionary):
    for name in ("Identity", "Zstd", "Lz4"):
        tag = codecs.TAGS[name]
        assert codecs.decode_bytes(tag, codecs.encode_bytes(tag, data), len(data)) == data
    zstd = codecs.TAGS["Zstd"]
    assert codecs.decode_bytes(zstd, codecs.encode_bytes(zstd, data, dictionary=dictionary), len(data), dictionary=dictionary) == data
    base = bytes(len(data))
    delta = codecs.TAGS["Delta"]
    assert codecs.decode_bytes(delta, codecs.encode_bytes(delta, data, base=base), len(data), base=base) == data


def test_codec_bounds_and_errors():
    assert len(codecs.zstd(b"\x2a" * 10_000)) < 1000
    assert len(codecs.delta(b"x" * 10_000, b"x" * 10_000)) < 100
    assert codecs.quantize_bytes(b"\x03\xff\x01\x80", 2, 2) == b"\x00\xff\x00\x80"
    assert codecs.xor_bytes(b"\x01\x02\x03", b"\x01\x01") == b"\x00\x03"
    with pytest.raises(ValueError):
        codecs.quantizer(2, 8)
    with pytest.raises(DecompressError):
        codecs.delta(b"a", b"ab")
    with pytest.raises(DecompressError):
        codecs.unzstd(b"nonsense", 5)
    with pytest.raises(UnsupportedBackend):
        codecs.tag_name(77)
    codecs.register("Reverse", 200, lambda d, o: d[::-1], lambda d, n, o: d[::-1])
    try:
        assert codecs.decode_bytes(200, codecs.encode_bytes(200, b"abc"), 3) == b"abc"
        with pytest.raises(ValueError, match="taken"):
            codecs.register("Other", 200, None, None)
    finally:
        del codecs.REGISTRY[200], codecs.NAMES[200], codecs.TAGS["Reverse"]


def test_dictionary(spark):
    big = bytes(random.Random(1).randrange(256) for _ in range(200_000))
    df = spark.createDataFrame([(bytearray(big),), (bytearray(b"short"),)], "c binary")
    got = [bytes(r[0]) for r in df.select(codecs.dictionary(F.col("c"))).collect()]
    step = len(big) // 16
    assert got == [b"".join(big[i * step : i * step + 4096] for i in range(16)), b"short"]


@pytest.fixture(scope="module")
def contents():
    rng = random.Random(7)
    noise = bytes(rng.randrange(256) for _ in range(1500))
    words = b" ".join(rng.choice([b"alpha", b"beta", b"gamma", b"delta"]) for _ in range(700))
    near = bytearray(noise * 2)
    near[2000] ^= 1
    return {1: b"", 2: b"tiny", 3: words, 4: noise * 3, 5: bytes(9000), 6: noise + bytes(near) + noise, 7: None}


@pytest.fixture(scope="module")
def files(spark, contents):
    return spark.createDataFrame([(i, bytearray(c) if c is not None else None) for i, c in contents.items()], "file_id long, content binary")


@pytest.mark.parametrize("level", ["fast", "default", "best"])
def test_lossless_round_trip(spark, files, contents, level):
    made = encode.compress(files, CompressConfig(level=level, chunk_params=SMALL, emit_manifest=True, emit_certificates=True, verify_on_compress=True))
    for archives in (made, archive_file.from_files(archive_file.to_files(made))):
        out = {r["file_id"]: (bytes(r["content"]), r["status"]) for r in decode.decompress(archives).collect()}
        assert out == {i: (c or b"", "ok") for i, c in contents.items()}
    heads = {r["file_id"]: r for r in made.archives.collect()}
    assert heads[1]["path"] == "empty" and heads[2]["path"] == "single" and heads[4]["path"] == "chunked"
    assert heads[4]["flags"] == V.HAS_DICTIONARY | V.HAS_MANIFEST | V.HAS_CERTIFICATES and heads[2]["flags"] == V.SINGLE_STREAM
    sizes = {r["file_id"]: r["n"] for r in archive_file.to_files(made).select("file_id", F.octet_length("archive").alias("n")).collect()}
    for r in made.stats.collect():
        assert r["compressed_size"] == (0 if heads[r["file_id"]]["path"] == "empty" else sizes[r["file_id"]])
    assert sizes[1] == 88
    told = {r["file_id"]: json.loads(r["manifest"]) for r in made.manifests.collect()}
    assert len(told[4]["@graph"]) == 1 + heads[4]["chunk_count"] and told[4]["@graph"][0]["proof:verified"] is False
    assert told[4]["@graph"][0]["@id"].endswith(hashlib.sha256(contents[4]).hexdigest()[:16])


def test_lossy(spark, contents, files):
    made = encode.compress(files, CompressConfig(mode="lossy", chunk_params=SMALL))
    out = {r["file_id"]: r for r in decode.decompress(made).collect()}
    assert {r["status"] for i, r in out.items() if contents[i]} == {"skipped_lossy"}
    assert all(len(out[i]["content"]) == len(c or b"") for i, c in contents.items())
    assert made.archives.filter("path = 'single'").count() == 0


def test_lossy_delta_keeps_the_error_of_its_base(spark):
    """The delta was taken against the original base and is decoded against the
    quantized one."""
    from pyspark.sql import Row

    base, target = b"\x03" * 100, b"\x07" * 10 + b"\x03" * 90
    ids = [hashlib.sha256(x).hexdigest() for x in (base, target)]
    quantized, delta = codecs.encode_bytes(4, base, threshold=2), codecs.encode_bytes(3, target, base=base)
    toc = spark.createDataFrame([Row(1, 0, ids[0], 4, bytearray(quantized), 100, None), Row(1, 1, ids[1], 3, bytearray(delta), 100, ids[0])], "file_id long, useq long, chunk_id string, tag int, payload binary, original_size long, base_chunk_id string")
    empty = spark.createDataFrame([], "file_id long, dictionary binary")
    archives = encode.Archives(None, toc, None, empty, None, None, None)
    got = {r["chunk_id"]: bytes(r["data"]) for r in decode.decode_chunks(archives).collect()}
    assert got == {ids[0]: bytes(100), ids[1]: b"\x04" * 10 + bytes(90)}
    lost = encode.Archives(None, toc.filter("useq = 1"), None, empty, None, None, None)
    with pytest.raises(InvalidArchive, match="base"):
        decode.decode_chunks(lost)


def test_long_chains_take_no_further_jobs(spark):
    """A thousand chunks, each a delta of the one before: one pass over the rows."""
    from pyspark.sql import Row

    rng = random.Random(3)
    data = [bytes(rng.randrange(256) for _ in range(80))]
    for i in range(1, 1000):
        data.append(data[-1][: i % 80] + bytes([(data[-1][i % 80] + 1) % 256]) + data[-1][i % 80 + 1 :])
    ids = [hashlib.sha256(x).hexdigest() for x in data]
    rows = [Row(1, i, c, 3 if i else 0, bytearray(codecs.encode_bytes(3, d, base=data[i - 1]) if i else d), 80, ids[i - 1] if i else None) for i, (c, d) in enumerate(zip(ids, data, strict=True))]
    toc = spark.createDataFrame(rows, "file_id long, useq long, chunk_id string, tag int, payload binary, original_size long, base_chunk_id string").repartition(7)
    empty = spark.createDataFrame([], "file_id long, dictionary binary")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("chain", "chain")
    got = {r["chunk_id"]: bytes(r["data"]) for r in decode.decode_chunks(encode.Archives(None, toc, None, empty, None, None, None)).collect()}
    jobs = len(tracker.getJobIdsForGroup("chain"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert got == dict(zip(ids, data, strict=True)) and jobs < 15
    late = toc.withColumn("useq", -F.col("useq"))
    with pytest.raises(InvalidArchive, match="base"):
        decode.decode_chunks(encode.Archives(None, late, None, empty, None, None, None))


def test_names_of_files_stay_apart(spark, tmp_path):
    names = ["a/b", "a_b", "a b", "./a", "..", "a%2Fb", "ü", "é.txt", ""]
    rows = spark.createDataFrame([(n, bytearray(n.encode())) for n in names], "file_id string, content binary")
    archive_file.write_files(rows, str(tmp_path / "out"))
    found = {p.name: p.read_bytes().decode() for p in (tmp_path / "out").iterdir()}
    assert sorted(found.values()) == sorted(names) and {archive_file.file_name(n) for n in names} == set(found)


def test_shared_folder_must_be_named_on_a_cluster(spark):
    from strata.spark import shared_dir

    class Conf:
        def __init__(self, named):
            self.named = named

        def get(self, key, default=None):
            return self.named if key == "spark.checkpoint.dir" else default

    class Session:
        def __init__(self, master, named):
            self.conf = Conf(named)
            self.sparkContext = type("Context", (), {"master": master})

    assert shared_dir(Session("yarn", "hdfs:///x/")) == "hdfs:///x"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Session("yarn", None))


def test_damage_is_found(spark, files):
    made = encode.compress(files.filter("file_id = 4"), CompressConfig(chunk_params=SMALL))
    wrong = made.file_map.withColumn("length", F.col("length") + 5)
    assert decode.verify(encode.Archives(**{**made.__dict__, "file_map": wrong})).first()["status"] == "out_of_bounds"
    other = made.archives.withColumn("checksum", F.lit("00"))
    assert decode.verify(encode.Archives(**{**made.__dict__, "archives": other})).first()["status"] == "checksum"


def test_archive_errors():
    head = archive_file.Header(0, 0, 0, 0, 88, 88, 0, bytes(32))
    assert len(head.pack()) == 88 and archive_file.Header.unpack(head.pack()) == head
    for bad, why in ((b"x" * 88, "magic"), (b"short", "few"), (V.MAGIC + b"\x09" + head.pack()[9:], "version")):
        with pytest.raises(InvalidArchive, match=why):
            archive_file.parse(bad)
    truncated = archive_file.Header(0, 9, 3, 0, 88, 88, 0, bytes(32)).pack()
    with pytest.raises(InvalidArchive):
        archive_file.parse(truncated)


def test_storage(spark, files, contents, tmp_path):
    made = encode.compress(files, CompressConfig(chunk_params=SMALL, emit_certificates=True))
    tables.write(made, str(tmp_path / "tables"))
    back = tables.read(spark, str(tmp_path / "tables"))
    assert {r["status"] for r in decode.verify(back).collect()} == {"ok"}
    assert back.derivations.count() == made.toc.filter("chunk_id is not null").count()
    archive_file.write_archives(made, str(tmp_path / "files"))
    names = sorted(p.name for p in (tmp_path / "files").iterdir())
    assert names == [f"{i}{V.EXTENSION}" for i in sorted(contents)]
    read = archive_file.read_archives(spark, str(tmp_path / "files"))
    assert {r["status"] for r in decode.verify(read).collect()} == {"ok"}
    assert decode.inspect(read).filter("is_single_stream").count() == decode.inspect(made).filter("is_single_stream").count()


def test_bad_options():
    with pytest.raises(ValueError, match="mode"):
        CompressConfig(mode="odd")
    with pytest.raises(ValueError, match="level"):
        CompressConfig(level="odd")
