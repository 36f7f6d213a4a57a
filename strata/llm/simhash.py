"""SimHash near-duplicates, searched with BK-trees.

A text's fingerprint has a bit for each bit that is set in over half of its
shingle hashes.  Fingerprints within ``RADIUS`` bits are linked; the components
of those links are the groups of near-duplicates.

Two fingerprints that differ in at most 3 bits agree in some blocks of a fixed
cut of the 64 bits, so each fingerprint goes into a shard for every choice of
blocks that may agree.  Each shard gets a BK-tree: children are keyed by their
Hamming distance to the parent, and a search follows only the edges within the
radius of the distance at hand.  This finds every pair; no shard is too large,
as large ones are cut into pairs of blocks (see ``blocks``).  Every link is found
along tree edges, also in shards of two.  A tree goes to the one task that searches
it, where its shard's rows are, and not to all by broadcast: together the trees are
as large as the set of fingerprints, which would have to pass through the driver.

Scale: texts are hashed in the scan.  Equal fingerprints are merged before the
search, so copies cost nothing.  The number of blocks follows the number of
fingerprints: shards stay small, and every choice is exact.

Cases: a null text, like one without words, has fingerprint zero and is linked
like any other; a text of one or two words is one shingle.  Rows that repeat get
a row each; a null doc_id takes part, and its component is named by the smallest
doc_id that isn't null.  Very long texts are hashed whole.  Empty tables give empty
results.  Other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm.blocks import in_groups, paired
from strata.llm.components import components
from strata.llm.textops import release, texts
from strata.spark import materialize, read_texts

SHINGLE, RADIUS, HASH_SEED = 3, 3, 42
#: Blocks that the bits are cut into, while there are at most so many fingerprints.
CUTS = ((4, 1 << 22), (5, 1 << 28), (6, None))


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Bits set in over half the hashes of the lower-case word shingles."""
    words = text.lower().split()
    if not words:
        return 0
    grams = [b" ".join(x) for x in zip(*(words[i:] for i in range(shingle)), strict=False)] or [b" ".join(words)]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(g, HASH_SEED) for g in grams], dtype=">u8")
    total = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        total += np.unpackbits(part.view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, keys: list[Column] = ()) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long) and any further long ``keys``."""
    names = [f"key{i}" for i in range(len(keys))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for b in batches:
            fps = np.array([fingerprint(t, shingle) for t in texts(b.column(1))], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps), *b.columns[2:]], names=["doc_id", "fp", *names])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *(k.alias(n) for k, n in zip(keys, names, strict=True)))
    return rows.mapInArrow(run, ", ".join(["doc_id long", "fp long", *(f"{n} long" for n in names)]))


class BKTree:
    """Children keyed by their Hamming distance to the parent."""

    def __init__(self):
        self.codes: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, code: int) -> None:
        self.codes.append(code)
        self.children.append({})
        new = len(self.codes) - 1
        if not new:
            return
        at = 0
        while True:
            d = (code ^ self.codes[at]).bit_count()
            if (to := self.children[at].get(d)) is None:
                self.children[at][d] = new
                return
            at = to

    def within(self, code: int, radius: int) -> list[int]:
        """Positions of the codes within the radius, by following only edges
        whose distance differs from the one at hand by at most the radius."""
        if not self.codes:
            return []
        found, todo = [], [0]
        codes, children = self.codes, self.children
        while todo:
            at = todo.pop()
            d = (code ^ codes[at]).bit_count()
            if d <= radius:
                found.append(at)
            for edge, to in children[at].items():
                if -radius <= edge - d <= radius:
                    todo.append(to)
        return found


def _search(codes: list[int], first: int, radius: int) -> list[tuple[int, int]]:
    """Spanning edges of the links among codes, or, if ``first`` is less than
    their number, between codes[:first] and the others."""
    parent = list(range(len(codes)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    tree, edges = BKTree(), []
    for i, code in enumerate(codes):
        inside = i < first
        if not inside or first == len(codes):
            for j in tree.within(code, radius):
                a, b = root(i), root(j)
                if a != b:
                    parent[a] = b
                    edges.append((i, j))
        if inside:
            tree.add(code)
    return edges


def _compare(radius: int):
    def run(rows: pa.Table, starts: list[int]) -> Iterator[pa.RecordBatch]:
        fps, block, lo, hi = (rows.column(c).to_numpy() for c in ("fp", "block", "lo", "hi"))
        codes = fps.view(np.uint64).tolist()
        edges: list[tuple[int, int]] = []
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            if lo[a] != hi[a] and block[a] == block[b - 1]:
                continue
            if b - a > 1:
                first = int(np.searchsorted(block[a:b], block[a], side="right"))
                edges += [(a + i, a + j) for i, j in _search(codes[a:b], first, radius)]
        at = np.array(edges, dtype=np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(fps[at[:, 0]]), pa.array(fps[at[:, 1]])], names=["a", "b"])

    return run


def shards(n: int, radius: int = RADIUS, bits: int = 64) -> list[Column]:
    """The shard keys of fp for a table of n fingerprints."""
    cut = next(c for c, most in CUTS if most is None or n <= most)
    edges = [round(i * bits / cut) for i in range(cut + 1)]
    keys = []
    for k, chosen in enumerate(combinations(range(cut), cut - radius)):
        key = F.lit(k).cast("long")
        for c in chosen:
            width = edges[c + 1] - edges[c]
            part = F.shiftrightunsigned("fp", edges[c]).bitwiseAND(F.lit((1 << width) - 1))
            key = F.shiftleft(key, width).bitwiseOR(part)
        keys.append(key)
    return keys


def groups(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``fps`` with root, the smallest fingerprint that links reach, and
    component_id, the smallest doc_id there."""
    if radius != RADIUS:
        raise ValueError(f"the cuts of the bits are made for a radius of {RADIUS}")
    merged = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "fingerprints")
    keyed = merged.select("fp", F.explode(F.array(*shards(merged.count(), radius))).alias("shard"))
    edges = in_groups(paired(keyed, ["shard"], "fp"), ["shard"], "fp", _compare(radius), "a long, b long")
    found = components(edges)
    rooted = merged.join(found, merged["fp"] == found["node"], "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    named = materialize(rooted, "rooted")
    ids = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    by_fp = named.join(ids, "root").select(F.col("fp").alias("of_fp"), "root", "component_id")
    return fps.join(by_fp, F.col("fp") == F.col("of_fp")).drop("of_fp")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: fingerprint and component of every document."""
    fps = materialize(fingerprints(read_texts(spark, sf_dir, "documents")), "prints", 0)
    return groups(fps).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
