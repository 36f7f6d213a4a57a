from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from strata.llm import suffixes


def brute(rows: list[tuple], k: int = 50) -> list[tuple]:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256), null ids first."""
    held: dict[bytes, tuple] = {}
    key = lambda i: (i is not None, i or 0)
    raw = [(i, (t or "").encode()) for i, t in rows]
    for i, b in raw:
        for p in range(len(b) - k + 1):
            w = b[p : p + k]
            if w not in held or key(i) < held[w]:
                held[w] = key(i)
    out = []
    for i, b in raw:
        gone = bytearray(len(b))
        for p in range(len(b) - k + 1):
            if held[b[p : p + k]] < key(i):
                gone[p : p + k] = b"\1" * k
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for p in range(len(b)) if gone[p] and (not p or not gone[p - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def corpus() -> list[tuple]:
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgé") for _ in range(rng.randrange(1, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage, other = prose(30), prose(14)
    rows = [(i, prose(rng.randrange(0, 60))) for i in range(40)]
    rows += [(100 + i, f"{prose(5)} {passage[i % 7:]} {prose(9)}") for i in range(12)]
    rows += [(200 + i, f"{other} {prose(3)} {other[rng.randrange(9):]}") for i in range(6)]
    rows += [(300, "a" * 400), (301, "a" * 120), (302, "ab" * 200), (303, "b" + "ab" * 60), (304, "a" * 49)]
    whole = prose(50)
    rows += [(400 + i, whole) for i in range(9)]
    rows += [(500, None), (501, ""), (502, "short"), (None, passage + "x"), (7, passage), (7, passage)]
    return rows


@pytest.mark.parametrize("size,block", [(1 << 19, 1 << 20), (97, 700)])
def test_against_brute_force(spark, monkeypatch, size, block):
    """With blocks and slices of usual and of tiny sizes."""
    monkeypatch.setattr(suffixes, "SLICE", size)
    monkeypatch.setattr(suffixes, "BLOCK_BYTES", block)
    monkeypatch.setattr(suffixes, "OWNER_BYTES", 4000)
    rows = corpus()
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, block long, kind string").repartition(5)
    found = sorted((tuple(r) for r in suffixes.repeated(df).collect()), key=repr)
    assert found == brute(rows)


def test_many_partitions_have_blocks_of_their_own(spark):
    rows = [(i, f"{i} " * 40 + "the same passage in every document, long enough to count as repeated") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(30)
    assert sorted((tuple(r) for r in suffixes.repeated(df).collect()), key=repr) == brute(rows)


def test_empty_table(spark):
    assert suffixes.repeated(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@pytest.mark.parametrize("long", [[], [(90, "a passage that two documents hold and that is long enough " * 2), (91, "a passage that two documents hold and that is long enough " * 2)]])
def test_texts_below_the_threshold(spark, long):
    """Partitions without a single window, alone and next to others."""
    rows = [(i, (None, "", "short", "x" * 49)[i % 4]) for i in range(24)] + long
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6, "doc_id")
    assert sorted((tuple(r) for r in suffixes.repeated(df).collect()), key=repr) == brute(rows)


def test_a_threshold_below_the_first_length(spark):
    with pytest.raises(ValueError):
        suffixes.repeated(spark.createDataFrame([], "doc_id long, text string"), 10)


def test_ranks_stand_for_strings():
    data = np.frombuffer(b"abcdefgh" * 30 + b"abcdefgX" * 9, dtype=np.uint8)
    for n in (16, 32, 42, 50):
        rank = suffixes.ranks(data, n)
        by = {}
        for p, r in enumerate(rank.tolist()):
            assert by.setdefault(r, data[p : p + n].tobytes()) == data[p : p + n].tobytes()
        assert len(by) == len({data[p : p + n].tobytes() for p in range(len(rank))})
        assert suffixes.smallest(rank, 5).tolist() == [min(rank[i : i + 5]) for i in range(len(rank) - 4)]


def test_runs_in_small_slices(monkeypatch):
    """Every window is in one run, whose rank is the smallest of its own."""
    rng = random.Random(8)
    texts = [bytes(rng.choice(b"abc") for _ in range(rng.randrange(0, 300))) for _ in range(9)] + [b"z" * 400]
    at = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    block = suffixes.Texts(np.arange(len(texts)), np.zeros(len(texts), np.int64), at, np.frombuffer(b"".join(texts), np.uint8))
    for size in (1 << 20, 64):
        monkeypatch.setattr(suffixes, "SLICE", size)
        for length in (16, 32, 42, 50):
            runs = suffixes.Runs(block, length, 50)
            seen = []
            for a, z, owner, rank in zip(runs.begin.tolist(), runs.end.tolist(), runs.owner.tolist(), runs.rank.tolist(), strict=True):
                for p in range(a, z + 1):
                    seen.append(p)
                    window = block.data[p : p + 50]
                    assert at[owner] <= p and p + 50 <= at[owner + 1]
                    assert rank == suffixes.ranks(window, length).min()
            assert seen == [p for i, t in enumerate(texts) for p in range(at[i], at[i] + len(t) - 49)]
