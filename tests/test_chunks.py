from __future__ import annotations

import hashlib
import random
import struct

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strata.operators import chunking, dedup, similarity
from strata.operators.chunking import SMALL, ChunkParams


def lcg(n: int) -> bytes:
    x, out = 12345, bytearray()
    for _ in range(n):
        x = (x * 1103515245 + 12345) & 0x7FFFFFFF
        out.append(x >> 16 & 255)
    return bytes(out)


def slow_ends(data: bytes, p: ChunkParams) -> list[int]:
    """Byte by byte."""
    table, mask, out, start = chunking.gear(), (1 << p.bits) - 1, [], 0
    while start < len(data):
        stop, h = min(len(data), start + p.largest), 0
        cut = stop
        for at in range(min(start + p.smallest, len(data)), stop):
            h = (h << 1) + table[data[at]] & (1 << 64) - 1
            if not h & mask:
                cut = at + 1
                break
        out.append(cut)
        start = cut
    return out


def lengths(data: bytes, p: ChunkParams) -> list[int]:
    return np.diff([0, *chunking.ends(np.frombuffer(data, np.uint8), p)]).tolist()


def test_gear_table():
    g = chunking.gear()
    assert [f"{x:016x}" for x in (*g[:4], g[255])] == ["8c10cc68e1903e93", "43424ce7e7d2da2e", "103002a1efda341a", "fe0ccf3391efc6f2", "9cca7c7361a3e09d"]
    assert hashlib.sha256(struct.pack("<256Q", *g)).hexdigest().startswith("dc7b3555175fb021")


def test_golden_lengths():
    pattern = bytes((i * 37 + 13) % 256 for i in range(100_000))
    assert lengths(pattern, ChunkParams()) == [65536, 34464]
    assert lengths(bytes(5000), ChunkParams(100, 500, 1000)) == [1000] * 5
    data = lcg(200_000)
    assert lengths(data, ChunkParams()) == [30898, 13282, 14548, 22761, 30488, 14178, 6563, 44643, 22639]
    assert lengths(data[:2000], SMALL) == [282, 317, 74, 91, 571, 249, 416]
    assert lengths(data[:60_000] * 2, ChunkParams()) == [30898, 13282, 14548, 32170, 13282, 14548, 1272]


def test_target_bits():
    assert [ChunkParams(1, t, 9).bits for t in (1, 2, 500, 16384, 16385)] == [0, 1, 9, 14, 15]


@settings(max_examples=150, deadline=None)
@given(st.binary(max_size=700), st.sampled_from([ChunkParams(3, 8, 40), ChunkParams(1, 16, 64), SMALL, ChunkParams(5, 1, 9), ChunkParams(8, 64, 8)]))
def test_ends_match_the_plain_loop(data, params):
    assert chunking.ends(np.frombuffer(data, np.uint8), params) == slow_ends(data, params)


@pytest.fixture(scope="module")
def sample(spark):
    rng = random.Random(4)
    one = bytes(rng.randrange(4) for _ in range(3000))
    rows = [(1, one), (2, one + b"tail"), (3, b""), (4, None), (5, bytes(2000)), (6, lcg(1500) * 2)]
    return spark.createDataFrame([(i, bytearray(d) if d is not None else None) for i, d in rows], "file_id long, content binary"), dict(rows)


def test_chunks_cover_and_agree_with_the_fold(spark, sample):
    df, rows = sample
    cut = chunking.chunks(df, SMALL)
    found = {i: [] for i in rows}
    for r in cut.orderBy("file_id", "seq").collect():
        assert r["chunk_id"] == hashlib.sha256(bytes(r["data"])).hexdigest() and r["length"] == len(r["data"])
        found[r["file_id"]].append(bytes(r["data"]))
    assert {i: b"".join(v) for i, v in found.items()} == {i: d or b"" for i, d in rows.items()}
    assert all(r["contiguous"] and r["covered"] == r["n_bytes"] for r in chunking.coverage(cut, df).collect())
    native = df.filter("content is not null and file_id != 2").select("file_id", chunking.ends_native(F.col("content"), SMALL).alias("e")).collect()
    for r in native:
        assert r["e"] == np.cumsum([len(x) for x in found[r["file_id"]]]).tolist()


def test_store_and_stats(spark, sample):
    df, _ = sample
    cut = chunking.chunks(df, SMALL).persist()
    stored = dedup.store(cut)
    assert stored.agg(F.sum("ref_count")).first()[0] == cut.count()
    zeros = stored.filter("file_id = 5").collect()
    assert len(zeros) == 2 and {r["ref_count"] for r in zeros} == {1}
    assert dedup.get_by_index(stored, 0).count() == 4
    some = zeros[0]["chunk_id"]
    assert dedup.get(stored, some).count() == 1
    known = cut.filter("file_id = 1")
    assert dedup.contained(cut, known).count() + dedup.missing(cut, known).count() == cut.count()
    assert dedup.missing(known, cut).count() == 0
    stats = {r["file_id"]: r for r in dedup.file_stats(df, cut).collect()}
    assert stats[3]["path"] == stats[4]["path"] == "empty" and stats[1]["path"] == "single"
    assert stats[6]["path"] == "chunked" and stats[6]["duplicate_chunks"] > 0
    first = dedup.marked(cut, "corpus").filter("is_new").count()
    assert first == cut.select("chunk_id").distinct().count()
    with pytest.raises(ValueError, match="scope"):
        dedup.marked(cut, "planet")


def test_near_duplicates(spark):
    base = bytes([0x2A]) * 1000
    near = bytes([0x2B]) * 10 + base[10:]
    rows = [("same", 0, base), ("same", 1, near), ("far", 0, bytes(1000)), ("far", 1, b"\xff" * 1000), ("short", 0, b"ab")]
    df = spark.createDataFrame([(f, hashlib.sha256(d).hexdigest(), bytearray(d), len(d), s, f) for f, s, d in rows], "file_id string, chunk_id string, data binary, length long, useq long, space string")
    found = similarity.best_bases(df).collect()
    assert [(r["file_id"], r["useq"], r["base_useq"], r["hamming"], r["fidelity"]) for r in found] == [("same", 1, 0, 10, 0.99875)]
    assert similarity.best_bases(df, everything=True).count() == 2


def test_near_duplicates_across_stretches(spark, monkeypatch):
    """Windows reach over the ends of stretches; the best and earliest wins."""
    rng = random.Random(9)
    chunks = []
    for i in range(300):
        d = bytearray(b"\x11" * 64 if i % 3 else bytes(rng.randrange(256) for _ in range(64)))
        d[i % 64] ^= 1 << i % 3
        chunks.append(bytes(d))
    expected = {}
    for i, d in enumerate(chunks):
        best = None
        for j in range(max(0, i - 64), i):
            bits = sum((x ^ y).bit_count() for x, y in zip(d, chunks[j], strict=True))
            f = 1 - bits / 512
            if f >= 0.85 * 0.9 and (best is None or f > best[1]):
                best = (j, f)
        if best and best[1] >= 0.85:
            expected[i] = best
    monkeypatch.setattr(similarity, "STRETCH", 100)
    df = spark.createDataFrame([(1, f"{i}", bytearray(d), 64, i, "x") for i, d in enumerate(chunks)], "file_id long, chunk_id string, data binary, length long, useq long, space string")
    assert {r["useq"]: (r["base_useq"], r["fidelity"]) for r in similarity.best_bases(df).collect()} == expected
