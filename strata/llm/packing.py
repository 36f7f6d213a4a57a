"""Packing token sequences by minimum bin slack.

A document of T tokens fills floor(T / capacity) sequences by itself; what
remains, 1 to capacity-1 tokens, is an item.  Items of equal length stand for
each other, so the search works on the counts by length: fewer than ``capacity``
numbers, however many documents there are.  For the longest length left, a
subset-sum table in the bits of one integer says which sums the other lengths
reach within their counts; the sum closest to the capacity is traced back to a
multiset of lengths.  That multiset is a pattern, used as often as its lengths
last.  A length that no multiset brings within ``MAX_SLACK`` of the capacity is
set aside.  The lengths set aside run on from sequence to sequence, cut at
multiples of ``GRID`` tokens; the last sequences take what is left.

Scale: texts are encoded in the scan, which leaves a few numbers a document.
The plan is made on the driver from the counts by length and has a bound that
doesn't depend on the data: every pattern uses up a length.  A document finds
its place from its rank among the items of its length, which is a count before
its group of rows plus a rank in the group.  Groups are dealt by a number that each
row gets in the scan, so a length that a third of the documents have, or one row
that repeats very often, is spread like any other.  Checksums are taken in the scan for
whole sequences, the remainder and each grid step of it; the checksum of any
piece follows from these, and no token ids move.

Cases: a null text counts as empty: one end token.  A very long text fills
sequences of its own and leaves one remainder.  Rows that repeat are packed each;
which of them takes which place is settled by their numbers.  An empty table packs
into nothing.  Other columns are not read, whatever their names.
"""

from __future__ import annotations

import math
import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strata.llm.textops import texts
from strata.llm.tokens import encoder, vocabulary_path
from strata.spark import materialize, read_texts

CAPACITY, END_ID, GRID, MAX_SLACK, GROUP, BLOCK = 2048, 1, 32, 2, 1024, 4096
#: Sequences and items of the longest run of equal lengths that is tried.
RUN, RUN_ITEMS = 64, 4096

ITEM = "doc_id long, doc_tokens long, whole_crc array<long>, rest int, rest_crc array<long>"
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


# --- checksums -------------------------------------------------------------


def suffix_checksum(whole: int, prefix: int, length: int) -> int:
    """crc32(b) from crc32(a + b), crc32(a) and len(b).

    Checksums are linear: that of a + b is that of b and, added bit by bit, that of
    a carried on over as many zero bytes as b has.
    """
    return whole ^ zlib.crc32(bytes(length), prefix ^ 0xFFFFFFFF) ^ 0xFFFFFFFF


# --- the plan, from counts by length -----------------------------------------


def fill(counts: dict[int, int], room: int) -> Counter:
    """The multiset within ``counts`` whose sum is closest to ``room``."""
    mask, reached, steps = (1 << room + 1) - 1, 1, []
    for length in sorted(counts, reverse=True):
        left = min(counts[length], room // length)
        many = 1
        while left > 0:
            take = min(many, left)
            steps.append((length, take, reached))
            reached |= reached << length * take & mask
            left -= take
            many *= 2
        if reached >> room & 1:
            break
    goal, chosen = reached.bit_length() - 1, Counter()
    for length, take, before in reversed(steps):
        if not before >> goal & 1:
            goal -= length * take
            chosen[length] += take
    return chosen


def make_plan(counts: dict[int, int], capacity: int = CAPACITY, max_slack: int = MAX_SLACK, grid: int = GRID) -> list[dict]:
    """Templates: {"uses": {length: items}, "times", "sequences", "slots"}.

    slots[length][k] lists the pieces of the k-th item of that length in one
    use of the template: (start, length, sequence, offset).
    """
    left, aside, plan = {k: v for k, v in counts.items() if v > 0}, {}, []
    while left:
        longest = max(left)
        others = {k: v - (k == longest) for k, v in left.items() if v - (k == longest) > 0 and k <= capacity - longest}
        chosen = fill(others, capacity - longest)
        chosen[longest] += 1
        if capacity - sum(k * n for k, n in chosen.items()) > max_slack:
            aside[longest] = left.pop(longest)
            continue
        times = min(left[k] // n for k, n in chosen.items())
        at, slots = 0, {}
        for k in sorted(chosen, reverse=True):
            slots[k] = [[(0, k, 0, at + i * k)] for i in range(chosen[k])]
            at += chosen[k] * k
        plan.append({"uses": dict(chosen), "times": times, "sequences": 1, "slots": slots})
        for k, n in chosen.items():
            left[k] -= n * times
            if not left[k]:
                del left[k]
    rest: list[int] = []
    for length in sorted(aside, reverse=True):
        template = _run_on([length] * _fullest(length, capacity, grid), capacity, grid)
        times = aside[length] // template["uses"][length]
        if times:
            plan.append(template | {"times": times})
        rest += [length] * (aside[length] - times * template["uses"][length])
    if rest:
        plan.append(_run_on(rest, capacity, grid) | {"times": 1})
    return plan


def _fullest(length: int, capacity: int, grid: int) -> int:
    """How many items of a length, one after the other, leave least room."""
    best, fill, sequences, at = 1, 0.0, 1, 0
    for k in range(1, min(RUN_ITEMS, RUN * capacity // length) + 1):
        need = length
        while need > capacity - at:
            need -= (capacity - at) // grid * grid
            sequences, at = sequences + 1, 0
        at += need
        if k * length / (sequences * capacity) > fill:
            best, fill = k, k * length / (sequences * capacity)
        if at == capacity:
            break
    return best


def _run_on(lengths: list[int], capacity: int, grid: int) -> dict:
    """Items one after the other; one that doesn't fit is cut on the grid."""
    sequence, at, slots = 0, 0, {}
    for length in lengths:
        pieces, start = [], 0
        while start < length:
            room, need = capacity - at, length - start
            take = need if need <= room else room // grid * grid
            if take:
                pieces.append((start, take, sequence, at))
            start, at = start + take, at + take
            if start < length or at == capacity:
                sequence, at = sequence + 1, 0
        slots.setdefault(length, []).append(pieces)
    return {"uses": {k: len(v) for k, v in slots.items()}, "sequences": sequence + (at > 0), "slots": slots}


class Places:
    """Where the item with a given rank among those of its length goes."""

    def __init__(self, plan: list[dict]):
        self.plan, self.starts, self.which, self.base = plan, {}, {}, []
        at, taken = 0, Counter()
        for i, t in enumerate(plan):
            self.base.append(at)
            at += t["sequences"] * t["times"]
            for length, n in t["uses"].items():
                self.starts.setdefault(length, []).append(taken[length])
                self.which.setdefault(length, []).append(i)
                taken[length] += n * t["times"]
        self.sequences = at

    def of(self, length: int, rank: int) -> list[tuple[int, int, int, int]]:
        """(start, length, sequence_id, offset) of each piece."""
        k = bisect_right(self.starts[length], rank) - 1
        i = self.which[length][k]
        t = self.plan[i]
        use, slot = divmod(rank - self.starts[length][k], t["uses"][length])
        first = self.base[i] + use * t["sequences"]
        return [(a, n, first + s, o) for a, n, s, o in t["slots"][length][slot]]


# --- Spark ---------------------------------------------------------------------


def items(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, grid: int = GRID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token count and checksums of each document, encoded in the scan.

    rest_crc[k] is the checksum of the remainder's first (k + 1) * grid ids,
    the last one that of the whole remainder.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(path), end_id.to_bytes(4, "little")
        for b in batches:
            tokens, whole, rests, rest_crcs = [], [], [], []
            for ids in enc.ids(texts(b.column(1))):
                ids += end
                n = len(ids) // 4
                cut = n - n % capacity
                tokens.append(n)
                whole.append([zlib.crc32(ids[4 * a : 4 * (a + capacity)]) for a in range(0, cut, capacity)])
                rests.append(n - cut)
                crc, steps = 0, []
                for a in range(cut, n, grid):
                    crc = zlib.crc32(ids[4 * a : 4 * min(a + grid, n)], crc)
                    steps.append(crc)
                rest_crcs.append(steps)
            longs = pa.list_(pa.int64())
            arrays = [b.column(0), pa.array(tokens, pa.int64()), pa.array(whole, longs), pa.array(rests, pa.int32()), pa.array(rest_crcs, longs)]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "doc_tokens", "whole_crc", "rest", "rest_crc"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, ITEM)


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, max_slack: int = MAX_SLACK, grid: int = GRID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents with their places in sequences."""
    # written, so that a row keeps its number whatever runs again
    found = materialize(items(docs, path, capacity, end_id, grid, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "items", 0, 16 << 20)
    groups = max(1, math.ceil(found.count() / GROUP))
    found = found.withColumn("g", F.pmod(F.xxhash64("row"), F.lit(groups)))
    by_group = found.groupBy("rest", "g").agg(F.count(F.lit(1)).alias("n"))
    counts = {r["rest"]: r["n"] for r in by_group.groupBy("rest").agg(F.sum("n").alias("n")).collect() if r["rest"]}
    places = Places(make_plan(counts, capacity, max_slack, grid))
    # counts before each group: within blocks of groups, and before each block
    block = F.floor(F.col("g") / BLOCK)
    by_block = by_group.groupBy("rest", block.alias("block")).agg(F.sum("n").alias("n"))
    ahead = by_block.select("rest", "block", (F.sum("n").over(Window.partitionBy("rest").orderBy("block")) - F.col("n")).alias("ahead"))
    within = F.sum("n").over(Window.partitionBy("rest", "block").orderBy("g")) - F.col("n")
    before = by_group.withColumn("block", block).select("rest", "g", "block", within.alias("within")).join(ahead, ["rest", "block"]).select("rest", "g", (F.col("ahead") + F.col("within")).alias("before"))
    equal = Window.partitionBy("rest", "g").orderBy("row")
    n_whole = F.size("whole_crc").cast("long")
    in_group = Window.partitionBy("g").orderBy("rest", "row").rowsBetween(Window.unboundedPreceding, -1)
    # sequences that a document fills by itself are numbered within its group, 2**32 to a group
    first = F.lit(places.sequences) + F.shiftleft(F.col("g").cast("long"), 32) + F.coalesce(F.sum(n_whole).over(in_group), F.lit(0))
    ranked = found.repartition("g").select("*", (F.row_number().over(equal) - 1).alias("in_equal"), first.alias("first"))
    rows = ranked.join(before, ["rest", "g"]).select("doc_id", "doc_tokens", "whole_crc", "rest", "rest_crc", (F.col("before") + F.col("in_equal")).alias("rank"), "first")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for doc_id, tokens, whole, rest, crcs, rank, first in zip(*(b.column(i).to_pylist() for i in range(7)), strict=True):
                for k, crc in enumerate(whole):
                    out.append((doc_id, k * capacity, capacity, crc, tokens, first + k, 0))
                if rest:
                    cut = tokens - rest
                    for start, n, sequence, offset in places.of(rest, rank):
                        to = start + n
                        crc = crcs[-1] if to == rest else crcs[to // grid - 1]
                        if start:
                            crc = suffix_checksum(crc, crcs[start // grid - 1], 4 * n)
                        out.append((doc_id, cut + start, n, crc, tokens, sequence, offset))
            columns = list(zip(*out, strict=True)) if out else [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return rows.mapInArrow(place, PIECE)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: places of the pieces of every document."""
    return pack(read_texts(spark, sf_dir, "documents"), vocabulary_path())
