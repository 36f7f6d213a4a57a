"""Repeated byte strings across documents, by distributed prefix doubling.

The rank of a position at length h stands for the h bytes from there on: equal
ranks, equal bytes.  Ranks double: the rank at 2h is made from the pair of the
ranks at h of the position and of the position h further on.  Classical suffix
sorting names ranks by sorting all pairs; here a rank is a hash of the pair, and
what is sorted across documents are ranks at growing lengths, each time only of
the positions that were not unique before, until a position is unique or the
length reaches the threshold.

Not every position has to be sorted.  A window (a string of the threshold's
length) holds threshold - h + 1 strings of length h; the smallest of their ranks
stands for the window at that length.  Equal windows have equal smallest ranks,
so a window whose smallest rank occurs in one document only is unique.  Neighbour
windows mostly share it, so runs of windows are sorted as one.  From the second
length on a run also carries a hash of all its bytes: where all runs with a
smallest rank are equal throughout the corpus, the smallest document that holds
one is the first for each of their windows.  Where they differ, the windows go on
to the next length; at the threshold each window stands for itself (128 bits).

Scale: texts are cut into blocks once; a block sends each distinct rank once, so
a passage that a third of the documents hold costs one entry a block, and owners
of rank ranges answer blocks with a byte an entry.  Entries are sorted, delta-
coded and compressed.  After the first length only the surviving bytes go on.
All tables between the rounds lie in the shared folder.

Cases: a null text counts as empty.  Documents with equal ids don't take from
each other; a null id comes before all others.  Texts below the threshold stay.
Rows that repeat give a row each.  An empty table gives an empty result.  Other
columns are not read.
"""

from __future__ import annotations

import hashlib
import math
import struct
import uuid
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm.textops import utf8
from strata.spark import discard, materialize, read_texts

THRESHOLD = 50
#: Lengths at which ranks are sorted; the first is a power of two.
LENGTHS = (16, 32, 42)
BLOCK_BYTES, SLICE, OWNER_BYTES, TASK_BYTES = 1 << 20, 1 << 19, 8 << 20, 32 << 20
NULL_ID = -(1 << 63)
UNIQUE, SETTLED, OPEN = 0, 1, 2

_rng = np.random.default_rng(50)
BYTE = _rng.integers(1 << 63, size=(2, 256), dtype=np.uint64) << np.uint64(1) | np.uint64(1)
STEP = _rng.integers(1 << 63, size=(2, 64), dtype=np.uint64) << np.uint64(1) | np.uint64(1)


ARRAY = struct.Struct("<3sBqq")


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of numbers as bytes: for each its type, dimensions, rows and columns,
    then its numbers, all compressed."""
    parts = []
    for x in arrays:
        x = np.ascontiguousarray(x)
        rows, columns = (*x.shape, 1, 1)[:2]
        parts += [ARRAY.pack(x.dtype.str.encode(), x.ndim, rows, columns), x.tobytes()]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def unpack(blob: bytes) -> tuple[np.ndarray, ...]:
    raw, at, out = zstandard.ZstdDecompressor().decompress(blob), 0, []
    while at < len(raw):
        kind, dimensions, rows, columns = ARRAY.unpack_from(raw, at)
        x = np.frombuffer(raw, np.dtype(kind.decode()), rows * columns, at + ARRAY.size)
        out.append(x.reshape((rows, columns)[:dimensions]))
        at += ARRAY.size + x.nbytes
    return tuple(out)


def planes(x: np.ndarray, sorted_: bool = False) -> np.ndarray:
    """64-bit numbers as byte planes, of their differences if sorted."""
    x = x.view(np.uint64)
    return np.ascontiguousarray((np.diff(x, prepend=np.uint64(0)) if sorted_ else x).view(np.uint8).reshape(-1, 8).T)


def numbers(p: np.ndarray, sorted_: bool = False) -> np.ndarray:
    x = np.ascontiguousarray(p.T).reshape(-1).view(np.uint64)
    return np.cumsum(x, dtype=np.uint64) if sorted_ else x


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ x >> np.uint64(32)


# --- ranks --------------------------------------------------------------------


def ranks(data: np.ndarray, length: int, which: int = 0) -> np.ndarray:
    """The rank at ``length`` of each position that has so many bytes left."""
    rank, width, step = BYTE[which][data], 1, 0
    while width < length:
        ahead = min(width, length - width)
        rank = rank[: len(rank) - ahead] * STEP[which][step] + rank[ahead:]
        width, step = width + ahead, step + 1
    return rank


def smallest(rank: np.ndarray, span: int) -> np.ndarray:
    """The smallest of each ``span`` consecutive ranks."""
    width = 1
    while width < span:
        ahead = min(width, span - width)
        rank = np.minimum(rank[: len(rank) - ahead], rank[ahead:])
        width += ahead
    return rank


class Texts:
    """Stretches of documents: bytes, where each begins, and whose it is."""

    def __init__(self, doc: np.ndarray, start: np.ndarray, at: np.ndarray, data: np.ndarray):
        self.doc, self.start, self.at, self.data = doc, start, at, data

    def windows(self, threshold: int) -> np.ndarray:
        """Which positions begin a window within their stretch."""
        size = np.diff(self.at)
        fit = size >= threshold
        edges = np.zeros(len(self.data) + 1, dtype=np.int8)
        edges[self.at[:-1][fit]] += 1
        edges[self.at[1:][fit] - threshold + 1] -= 1
        return np.cumsum(edges[:-1], dtype=np.int8).astype(bool)


class Runs:
    """Runs of windows with the same smallest rank."""

    def __init__(self, texts: Texts, length: int, threshold: int):
        begins, ends, ranked, whole = [], [], [], []
        usable, span = texts.windows(threshold), threshold - length + 1
        for a in range(0, len(texts.data), SLICE):
            here = np.flatnonzero(usable[a : a + SLICE])
            if not len(here):
                continue
            data = texts.data[a : a + SLICE + threshold - 1]
            low = smallest(ranks(data, length), span)[here]
            new = np.ones(len(here), dtype=bool)
            new[1:] = (np.diff(here) != 1) | (low[1:] != low[:-1])
            first = np.flatnonzero(new)
            if span < threshold - LENGTHS[0] + 1:
                # so that the first and the last window cover a run
                place = np.arange(len(here)) - np.repeat(first, np.diff(first, append=len(here)))
                first = np.flatnonzero(place % span == 0)
            last = np.append(first[1:], len(here)) - 1
            begins.append(a + here[first])
            ends.append(a + here[last])
            ranked.append(low[first])
            if length > LENGTHS[0]:
                full = ranks(data, threshold, 1)
                whole.append(mix(full[here[first]]) * np.uint64(3) + mix(full[here[last]] + (here[last] - here[first]).astype(np.uint64)))
        empty = np.zeros(0, np.int64)
        self.begin, self.end = (np.concatenate(x) if x else empty for x in (begins, ends))
        self.rank = np.concatenate(ranked) if ranked else empty.view(np.uint64)
        self.whole = np.concatenate(whole) if whole else np.zeros(len(self.rank), np.uint64)
        self.owner = np.searchsorted(texts.at, self.begin, side="right") - 1


class Entries:
    """A block's distinct (rank, whole), by owner, and the runs of each."""

    def __init__(self, runs: Runs, ids: np.ndarray, owners: int):
        bucket = mix(runs.rank) % np.uint64(owners)
        order = np.lexsort((runs.whole, runs.rank, bucket))
        bucket, rank, whole, doc = bucket[order], runs.rank[order], runs.whole[order], ids[order]
        new = np.ones(len(order), dtype=bool)
        new[1:] = (rank[1:] != rank[:-1]) | (whole[1:] != whole[:-1])
        at = np.flatnonzero(new)
        self.of_run = np.empty(len(order), dtype=np.int64)
        self.of_run[order] = np.cumsum(new) - 1
        self.bucket, self.rank, self.whole = bucket[at].astype(np.int64), rank[at], whole[at]
        self.low = np.minimum.reduceat(doc, at) if len(at) else doc
        self.high = np.maximum.reduceat(doc, at) if len(at) else doc

    def parts(self) -> Iterator[tuple[int, slice]]:
        at = np.flatnonzero(np.diff(self.bucket, prepend=-1))
        for a, b in pairwise([*at.tolist(), len(self.bucket)]):
            yield int(self.bucket[a]), slice(a, b)


def answer(rank: np.ndarray, whole: np.ndarray, low: np.ndarray, high: np.ndarray, final: bool) -> tuple[np.ndarray, np.ndarray]:
    """For each entry: UNIQUE, SETTLED (with the first document) or OPEN."""
    order = np.lexsort((whole, rank))
    r, w = rank[order], whole[order]
    new_rank = np.ones(len(r), dtype=bool)
    new_rank[1:] = r[1:] != r[:-1]
    new_whole = new_rank.copy()
    new_whole[1:] |= w[1:] != w[:-1]
    group = new_whole if final else new_rank
    at = np.flatnonzero(group)
    index = np.cumsum(group) - 1
    first, last = np.minimum.reduceat(low[order], at), np.maximum.reduceat(high[order], at)
    kinds = np.add.reduceat(new_whole.astype(np.int64), at)
    state = np.where(first == last, UNIQUE, np.where(kinds == 1, SETTLED, OPEN)).astype(np.uint8)
    out, lowest = np.empty(len(r), dtype=np.uint8), np.empty(len(r), dtype=np.int64)
    out[order], lowest[order] = state[index], first[index]
    return out, lowest


# --- rounds -------------------------------------------------------------------

TABLE = "block long, kind int, owner long, blob binary"
TEXT, SPANS, REPLY = 0, 1, 2


def _record(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
    block, kind, owner, blob = zip(*rows, strict=True) if rows else ((),) * 4
    return pa.RecordBatch.from_arrays([pa.array(block, pa.int64()), pa.array(kind, pa.int32()), pa.array(owner, pa.int64()), pa.array(blob, pa.binary())], names=["block", "kind", "owner", "blob"])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, int, bytes]]:
    for b in batches:
        block, kind, owner = (b.column(i).to_pylist() for i in range(3))
        for i in range(b.num_rows):
            yield block[i], kind[i], owner[i], b.column(3)[i].as_py()


def blocks(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The texts in blocks of about BLOCK_BYTES, a longer text alone.

    Their numbers are drawn at random: the table is written before it is read,
    so each block has one number whatever runs again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[np.ndarray] = []
        absent: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        data: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            own = np.concatenate(ids)
            at = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
            return _record([(uuid.uuid4().int >> 65, TEXT, 0, pack(own, np.zeros(len(own), np.int64), at, np.concatenate(data), np.arange(len(own)), np.concatenate(absent)))])

        for b in batches:
            doc, null = b.column(0).fill_null(NULL_ID).to_numpy(), b.column(0).is_null().to_numpy(zero_copy_only=False)
            at, raw = utf8(b.column(1))
            a = 0
            while a < b.num_rows:
                room = BLOCK_BYTES - sum(len(x) for x in data)
                to = max(a + (not ids), int(np.searchsorted(at, at[a] + room, side="right")) - 1)
                if to > a:
                    ids.append(doc[a:to])
                    absent.append(null[a:to])
                    sizes.append(np.diff(at[a : to + 1]))
                    data.append(raw[at[a] : at[to]].copy())
                    a = to
                if a < b.num_rows:
                    yield flush()
                    ids, absent, sizes, data = [], [], [], []
        if ids:
            yield flush()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return materialize(rows.mapInArrow(run, TABLE), "blocks", 0, 16 << 20)


def _ask(length: int, threshold: int, owners: int):
    """Requests of each block, to the owners of its ranks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, _, _, blob in _rows(batches):
            doc, start, at, data, *_ = unpack(blob)
            runs = Runs(Texts(doc, start, at, data), length, threshold)
            e = Entries(runs, doc[runs.owner], owners)
            out = []
            for bucket, part in e.parts():
                if length == LENGTHS[0]:
                    told = (planes(e.rank[part], True), np.packbits(e.low[part] != e.high[part]))
                else:
                    base = e.low[part].min()
                    told = (planes(e.rank[part], True), e.whole[part], base, planes(e.low[part] - base), planes(e.high[part] - e.low[part]))
                out.append((block, REPLY, bucket, pack(*told)))
            yield _record(out)

    return run


def _reply(length: int, threshold: int):
    """Answers of each owner, to the blocks that asked."""

    def serve(owner: int, asked: list[tuple[int, bytes]]) -> list[tuple[int, int, int, bytes]]:
        told = [unpack(blob) for _, blob in asked]
        rank = [numbers(t[0], True) for t in told]
        ends = np.cumsum([len(r) for r in rank])
        if length == LENGTHS[0]:
            several = np.concatenate([np.unpackbits(t[1])[: len(r)] for t, r in zip(told, rank, strict=True)])
            low = np.repeat(np.arange(len(rank)) * 2, np.diff(ends, prepend=0))
            state, _ = answer(np.concatenate(rank), np.zeros(ends[-1], np.uint64), low, low + several, False)
            state = [np.packbits(s != UNIQUE) for s in np.split(state, ends[:-1])]
            return [(block, REPLY, owner, pack(s)) for (block, _), s in zip(asked, state, strict=True)]
        low = [numbers(t[3]).view(np.int64) + t[2] for t in told]
        high = [numbers(t[4]).view(np.int64) + x for t, x in zip(told, low, strict=True)]
        state, first = answer(np.concatenate(rank), np.concatenate([t[1] for t in told]), np.concatenate(low), np.concatenate(high), length == threshold)
        out = []
        for (block, _), s, f in zip(asked, np.split(state, ends[:-1]), np.split(first, ends[:-1]), strict=True):
            settled = f[s == SETTLED]
            base = settled.min() if len(settled) else np.int64(0)
            out.append((block, REPLY, owner, pack(s, base, planes(settled - base))))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, asked = None, []
        for block, _, owner, blob in _rows(batches):
            if owner != now and asked:
                yield _record(serve(now, asked))
                asked = []
            now = owner
            asked.append((block, blob))
        if asked:
            yield _record(serve(now, asked))

    return run


def _settle(length: int, threshold: int, owners: int):
    """Per block: the spans that the answers settle, the bytes still open."""

    def one(block: int, blob: bytes, replies: dict[int, bytes]) -> list[tuple[int, int, int, bytes]]:
        doc, start, at, data, place, *_ = unpack(blob)
        texts = Texts(doc, start, at, data)
        runs = Runs(texts, length, threshold)
        e = Entries(runs, doc[runs.owner], owners)
        state, first = np.zeros(len(e.rank), np.uint8), np.zeros(len(e.rank), np.int64)
        for bucket, part in e.parts():
            told = unpack(replies[bucket])
            if length == LENGTHS[0]:
                state[part] = np.unpackbits(told[0])[: part.stop - part.start] * OPEN
            else:
                state[part] = told[0]
                lowest = np.zeros(part.stop - part.start, np.int64)
                lowest[told[0] == SETTLED] = numbers(told[2]).view(np.int64) + told[1]
                first[part] = lowest
        state, first = state[e.of_run], first[e.of_run]
        out = []
        gone = np.flatnonzero((state == SETTLED) & (first < doc[runs.owner]))
        if len(gone):
            own = runs.owner[gone]
            shift = start[own] - at[own]
            out.append((block, SPANS, 0, pack(place[own], runs.begin[gone] + shift, runs.end[gone] + shift + threshold)))
        left = np.flatnonzero(state == OPEN)
        if len(left):
            begin, end, own = runs.begin[left], runs.end[left], runs.owner[left]
            new = np.ones(len(left), dtype=bool)
            new[1:] = (begin[1:] != end[:-1] + 1) | (own[1:] != own[:-1])
            a = np.flatnonzero(new)
            begin, end, own = begin[a], end[np.append(a[1:], len(left)) - 1] + threshold, own[a]
            cut = np.concatenate([[0], np.cumsum(end - begin)])
            index = np.arange(cut[-1]) + np.repeat(begin - cut[:-1], end - begin)
            out.append((block, TEXT, 0, pack(doc[own], start[own] + begin - at[own], cut, data[index], place[own])))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, text, replies = None, None, {}
        for block, kind, owner, blob in _rows(batches):
            if block != now:
                if text is not None:
                    yield _record(one(now, text, replies))
                now, text, replies = block, None, {}
            if kind == TEXT:
                text = blob
            else:
                replies[owner] = blob
        if text is not None:
            yield _record(one(now, text, replies))

    return run


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Remove the spans of each block's documents."""

    def one(blob: bytes, spans: list[bytes]) -> pa.RecordBatch:
        doc, _, at, data, _, null = unpack(blob)
        cover = np.zeros(len(data) + 1, dtype=np.int32)
        for s in spans:
            place, begin, end = unpack(s)
            np.add.at(cover, at[place] + begin, 1)
            np.add.at(cover, at[place] + end, -1)
        gone = np.cumsum(cover[:-1]) > 0
        total = np.concatenate([[0], np.cumsum(gone)])
        opens = gone.copy()
        opens[1:] &= ~gone[:-1]
        firsts = at[:-1][at[:-1] < at[1:]]
        opens[firsts] = gone[firsts]
        starts = np.concatenate([[0], np.cumsum(opens)])
        kept, left = data[~gone].tobytes(), at - total[at]
        digest = [hashlib.sha256(kept[a:b]).hexdigest() for a, b in zip(left[:-1].tolist(), left[1:].tolist(), strict=True)]
        arrays = [pa.array(doc, mask=null), pa.array(np.diff(at)), pa.array(np.diff(total[at])), pa.array(np.diff(starts[at])), pa.array(digest, pa.string())]
        return pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    now, text, spans = None, None, []
    for block, kind, _, blob in _rows(batches):
        if block != now:
            if text is not None:
                yield one(text, spans)
            now, text, spans = block, None, []
        if kind == TEXT:
            text = blob
        else:
            spans.append(blob)
    if text is not None:
        yield one(text, spans)


def repeated(docs: DataFrame, threshold: int = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every document."""
    if threshold < LENGTHS[0] + 1:
        raise ValueError(f"the threshold must exceed {LENGTHS[0]} bytes")
    spark = docs.sparkSession
    whole = blocks(docs, id_col, text_col)
    total = whole.agg(F.sum(F.length("blob"))).first()[0] or 0
    owners = max(1, math.ceil(2.5 * total / OWNER_BYTES))
    tasks = max(spark.sparkContext.defaultParallelism, math.ceil(2.5 * total / TASK_BYTES))
    spread = lambda df, key: df.repartition(tasks, key).sortWithinPartitions(key, "kind", "owner")
    texts, spans = whole, None
    for length in [n for n in LENGTHS if n < threshold] + [threshold]:
        asked = texts.mapInArrow(_ask(length, threshold, owners), TABLE).repartition(tasks, "owner").sortWithinPartitions("owner", "block")
        replies = materialize(asked.mapInArrow(_reply(length, threshold), TABLE), "replies", 0)
        after = materialize(spread(texts.unionByName(replies), "block").mapInArrow(_settle(length, threshold, owners), TABLE), "settled", 0)
        discard(replies)
        settled = after.filter(F.col("kind") == SPANS)
        spans = settled if spans is None else spans.unionByName(settled)
        texts = after.filter(F.col("kind") == TEXT)
    both = whole.unionByName(spans)
    return spread(both, "block").mapInArrow(_finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: bytes of every document that repeat a smaller document's."""
    return repeated(read_texts(spark, sf_dir, "documents"))


ORACLE = """
WITH f AS (SELECT doc_id, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
u AS (SELECT doc_id, unnest(range(greatest(n - 49, 0))) AS p, unnest(list_transform(range(greatest(n - 49, 0)), lambda i: b[i + 1:i + 50])) AS s FROM f),
m AS (SELECT s, min(doc_id) AS first_id FROM u GROUP BY s HAVING min(doc_id) <> max(doc_id)),
c AS (SELECT u.doc_id, u.p FROM u JOIN m ON u.s = m.s WHERE u.doc_id > m.first_id),
g AS (SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 50 THEN 0 ELSE 1 END AS new FROM c),
r AS (SELECT doc_id, p, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM g),
s AS (SELECT doc_id, min(p) AS a, max(p) + 50 AS z FROM r GROUP BY doc_id, run),
k AS (SELECT doc_id, a, z, lag(z, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS before FROM s),
t AS (SELECT k.doc_id, sum(z - a) AS removed, count(*) AS spans, max(z) AS last, string_agg(hex(f.b[before + 1:a]), '' ORDER BY a) AS head FROM k JOIN f ON k.doc_id = f.doc_id GROUP BY k.doc_id)
SELECT f.doc_id, CAST(f.n AS BIGINT) AS n_bytes, CAST(coalesce(t.removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(t.spans, 0) AS BIGINT) AS n_spans,
CASE WHEN t.doc_id IS NULL THEN sha256(f.b) ELSE sha256(unhex(t.head || hex(f.b[t.last + 1:f.n]))) END AS kept_sha256
FROM f LEFT JOIN t ON f.doc_id = t.doc_id
"""
