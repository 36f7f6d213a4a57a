from __future__ import annotations

import random
import time
import tracemalloc
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strata.llm import packing, token_counts
from strata.llm.tokens import Plain, encoder, vocabulary_path

PATH = vocabulary_path()
ODD = ["", "   \n", "don't WON'T we're ''s 'S '' 'll'd", "Ünï <|endoftext|> x<|startoftext|>y", "Σας ΟΔΟΣ İstanbul", "áé ﬁ ½ 12³", "\x00\x1f\x85\xa0 x", "日本語 한국어", "“q” ‘z’ —–…", "x_y 1234 12a34b", "<| x |>", "é é"]


def library(text: str) -> list[int]:
    return encoder(PATH).library.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text("aAéÉß'sStTdD<|>!?.,0 9\n\t“ǅ́", max_size=40)))
def test_ids_equal_the_library(text):
    raw = text.encode("utf-8", "ignore")
    text = raw.decode()
    assert np.frombuffer(encoder(PATH).ids([raw])[0], "<u4").tolist() == library(text)
    assert sum(encoder(PATH).counts([raw])[0]) == len(library(text))


def test_odd_texts_at_once():
    got = encoder(PATH).ids([t.encode() for t in ODD])
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [library(t) for t in ODD]


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghijé") for _ in range(rng.randrange(1, 12)))
    texts = [*ODD, None, *(" ".join(word() for _ in range(rng.randrange(1, 40))) for _ in range(30)), " ".join(word() for _ in range(3000)), "x" * 5000]
    texts += texts[:3]
    rows = [(i if i != 4 else None, t, 0, "n") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, rest string").repartition(3), rows


def test_counts_and_budgets(spark, docs):
    df, rows = docs
    found = sorted((tuple(r) for r in token_counts.count_tokens(df, PATH, 20).collect()), key=repr)
    expected = []
    for i, t, *_ in rows:
        t = t or ""
        n = len(library(t))
        fit = len(t) if n <= 20 else max(p for p in range(min(len(t), 2000)) if len(library(t[:p])) <= 20)
        expected.append((i, len(t.encode()), n, n > 20, fit))
    assert found == sorted(expected, key=repr)


def test_every_prefix(spark, docs):
    df, rows = docs
    short = {i: t or "" for i, t, *_ in rows if len(t or "") < 200 and i is not None}
    found = {r["doc_id"]: r["prefix_tokens"] for r in token_counts.prefix_counts(df.filter("doc_id is not null"), PATH).collect()}
    for i, t in short.items():
        assert found[i] == [len(library(t[:p])) for p in range(len(t) + 1)], t


LONG = "abcdefgh" * 9 + "é" * 70 + "Überlänge12<|x|>'re'll" + "theinandtothe" * 9 + "日本語のテキスト" * 12 + "İΣ" * 9 + "!?" * 70 + "'s"


@pytest.mark.parametrize("text", [LONG, "Qm9v" * 40 + LONG[::-1], "e\u0301" * 50, "か\u3099" * 40, "||<|endoftext|>" * 9, "\u1112\u1161\u11ab" * 30, "x" * 300, "สวัสดี" * 20])
def test_prefixes_of_long_pieces(text):
    assert token_counts.Prefixes(encoder(PATH)).inside(text) == [len(library(text[:i])) for i in range(1, len(text) + 1)]


@pytest.mark.parametrize("sign", ["q3Zk", "日本語文", "="])
def test_long_pieces_take_little_memory(sign):
    """A piece of 20,000 characters: its prefixes alone would be 200 MB."""
    rng = random.Random(4)
    text = "".join(rng.choice(sign) for _ in range(20_000))
    prefixes = token_counts.Prefixes(encoder(PATH))
    tracemalloc.start()
    found = prefixes.inside(text)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 50 << 20
    assert [found[i - 1] for i in (1, 70, 999, 20_000)] == [len(library(text[:i])) for i in (1, 70, 999, 20_000)]


@pytest.mark.parametrize("sign", ["abcdefghijklmnopqrstuvwxyz", "theinagro", "aé!1'st", "q3ZkLm0p+/", "日本語文か", "'sreld"])
def test_pieces_of_200_signs(sign):
    rng = random.Random(sign)
    prefixes = token_counts.Prefixes(encoder(PATH))
    for _ in range(4):
        text = "".join(rng.choices(sign, k=200))
        assert prefixes.inside(text) == [len(library(text[:i])) for i in range(1, 201)], text


@pytest.mark.parametrize("sign", ["abcdefghijklmnopqrstuvwxyz", "q3ZkLm0p+/", "x"])
def test_a_megabyte_without_white_space(sign):
    """The budget is looked up in little memory, and no further than it reaches."""
    text = "".join(random.Random(7).choices(sign, k=1 << 20))
    prefixes, n = token_counts.Prefixes(encoder(PATH)), len(library(text))
    began = time.time()
    tracemalloc.start()
    fit = token_counts.longest_within(text.encode(), [text.encode()], [0, n], 2048, prefixes)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100 << 20 and time.time() - began < 60
    assert len(library(text[:fit])) <= 2048 and all(len(library(text[: fit + i])) > 2048 for i in range(1, 40))


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert token_counts.count_tokens(none, PATH).collect() == [] and token_counts.prefix_counts(none, PATH).collect() == []


def test_very_long_text(spark):
    text = "the quick brown fox jumps over it. " * 60_000
    rows = spark.createDataFrame([(1, text), (2, "x" * 300_000)], "doc_id long, text string")
    found = {r["doc_id"]: r for r in token_counts.count_tokens(rows, PATH).collect()}
    assert found[1]["n_tokens"] == len(library(text)) and found[1]["n_bytes"] == len(text) and found[1]["over_limit"]
    assert found[2]["n_tokens"] == len(library("x" * 300_000))
    assert len(library(text[: found[1]["fit_chars"]])) == 2048 and len(library("x" * found[2]["fit_chars"])) == 2048


def check_plan(counts: dict[int, int], capacity: int = 2048) -> float:
    places = packing.Places(packing.make_plan(counts, capacity))
    held: dict[int, list] = {}
    for length, n in counts.items():
        for rank in range(n):
            pieces = places.of(length, rank)
            assert [p[0] for p in pieces] == [sum(q[1] for q in pieces[:i]) for i in range(len(pieces))]
            assert sum(p[1] for p in pieces) == length
            assert all(p[0] % packing.GRID == 0 for p in pieces)
            for _, size, sequence, offset in pieces:
                held.setdefault(sequence, []).append((offset, size))
    for pieces in held.values():
        at = 0
        for offset, size in sorted(pieces):
            assert offset == at
            at += size
        assert at <= capacity
    assert set(held) == set(range(places.sequences))
    return 1 - sum(k * n for k, n in counts.items()) / max(1, capacity * places.sequences)


def test_plans():
    rng = random.Random(5)
    wide: dict[int, int] = {}
    for _ in range(20_000):
        k = rng.randrange(1, 2048)
        wide[k] = wide.get(k, 0) + 1
    assert check_plan(wide) < 0.002
    assert check_plan({700: 5000, 3: 10}) < 0.02
    assert check_plan({300: 4000} | {k: 2 for k in range(900, 1100)}) < 0.02
    assert check_plan({}) == 1.0 and check_plan({5: 1}) > 0.9
    assert check_plan({2047: 9, 1: 3}) < 0.001


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 63), st.integers(1, 6), max_size=9), st.integers(1, 64))
def test_fill_is_closest(counts, room):
    got = packing.fill({k: v for k, v in counts.items() if k <= room}, room)
    sums = {0}
    for k, v in counts.items():
        sums |= {s + k * i for s in sums for i in range(v + 1) if s + k * i <= room}
    assert sum(k * n for k, n in got.items()) == max(sums)
    assert all(n <= counts[k] for k, n in got.items())


def test_checksums_of_suffixes():
    rng = random.Random(1)
    for _ in range(100):
        a, b = rng.randbytes(rng.randrange(99)), rng.randbytes(rng.randrange(99))
        assert packing.suffix_checksum(zlib.crc32(a + b), zlib.crc32(a), len(b)) == zlib.crc32(b)


@pytest.mark.parametrize("capacity", [64, 2048])
def test_packed_pieces(spark, docs, capacity):
    """Every id is in one piece, and pieces fill sequences without a gap."""
    df, rows = docs
    found = packing.pack(df, PATH, capacity).collect()
    expected: dict = {}
    for i, t, *_ in rows:
        ids = [*library(t or ""), packing.END_ID]
        expected.setdefault(i, []).append(ids)
    sequences: dict[int, list] = {}
    by_doc: dict = {}
    for r in found:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        by_doc.setdefault(r["doc_id"], []).append((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
    for i, texts in expected.items():
        total = sum(len(t) for t in texts)
        assert sum(p[1] for p in by_doc[i]) == total
        for start, length, crc, tokens in by_doc[i]:
            assert any(len(t) == tokens and zlib.crc32(np.array(t[start : start + length], "<u4").tobytes()) == crc for t in texts)
    assert sum(n for p in sequences.values() for _, n in p) <= capacity * len(sequences)
    assert packing.pack(df.limit(0), PATH).collect() == []


def test_ten_thousand_equal_rows(spark):
    """No group of rows grows with the copies of one row."""
    rows = spark.range(10_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("a few words").alias("text"))
    found = packing.pack(rows, PATH, 64)
    by_sequence: dict = {}
    for r in found.collect():
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert sum(len(p) for p in by_sequence.values()) >= 10_000
    assert sum(n for p in by_sequence.values() for _, n in p) == 10_000 * (len(library("a few words")) + 1)
    assert all(sum(n for _, n in sorted(p)[:i]) == sorted(p)[i][0] for p in by_sequence.values() for i in range(len(p)))


def test_plain_texts_in_arrays():
    """Contractions, signs, digits and Latin letters, cut as the library does, also
    when the table is begun anew."""
    rng = random.Random(9)
    signs = ["'s", "'t", "'re", "'ve", "'m", "'ll", "'d", "'", "''", "!'s", "S", "RE", "ll", "Ll", "éÀ", "ß", "Ö", "ÿ", "«", "»", "¿", "–", "”", "…", "12", "7", " ", "  ", "\n", "\t", "\x0b", "word", "Don", "_", "<", "|>", "~"]
    texts = ["".join(rng.choices(signs, k=rng.randrange(0, 30))) for _ in range(600)]
    texts += ["", " ", "'", "x'", "it's", "'s" * 9, "we'll've", "a'b'c", "'12's", "Æ'S"]
    enc = encoder(PATH)
    plain = Plain(enc._encode_runs, bits=14, most=200)
    for at in range(0, len(texts), 61):
        part = [t.encode() for t in texts[at : at + 61]]
        got = plain.ids(part)
        assert [np.frombuffer(g, "<u4").tolist() for g in got] == [library(t) for t in texts[at : at + 61]]
        for raw, table in zip(part, plain.tables(part), strict=True):
            assert table.tolist() == [sum(len(library(p.decode())) for p in raw.split()[:k]) for k in range(len(raw.split()) + 1)]
