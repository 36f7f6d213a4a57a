"""Near-duplicate vectors by cross-polytope hashing.

A hash rotates the vector by three rounds of random signs and a fast Hadamard
transform and takes the coordinate of largest magnitude, with its sign: the
nearest corner of a cross-polytope.  A table concatenates several hashes; each
vector goes into the buckets of its ``PROBES`` nearest corners in every hash, so
that pairs meet even where one hash tips over.  Pairs that meet are verified by
their cosine in double precision.  The number of hashes in a table follows
the number of vectors under a label, so that buckets stay small, and the number of
tables follows from the chance, found by simulation at the threshold, that a pair
meets in one: a pair right at the threshold is missed with a chance of ``MISSED``
at most.

What goes into the buckets isn't the vector but its id, its corners and a sketch:
on which side of ``PLANES`` random planes it lies.  A pair is looked at in the first
bucket where it meets, which both vectors' corners tell, and is a candidate if its
sketches differ in no more bits than a pair at the threshold does but for a chance
of ``UNLIKE``.  Candidates go to their vectors, which decide by their cosine in
double precision, once for links and components alike.

Scale: equal vectors are merged first and count as often as they occur.  Buckets
with more members than a block are dealt into pairs of blocks (see ``blocks``).  A
pair of blocks in which candidates are more than ``DENSE`` times its members
returns none of them: its members' vectors are fetched once and compared there, and
only counts and spanning edges leave the task.

Cases: vectors that are null, empty, zero or hold null or non-finite components
link with nothing, nor do rows with a null label or id, nor vectors of different
lengths.  Very large and very small components are scaled before they are squared.
Labels may be of any type that can be compared.  Rows that repeat are vectors of
their own, linked with each other; ties at the threshold link.  Empty tables give
empty results.  Other columns are not read, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm.blocks import dealt, in_groups, spanning
from strata.llm.components import components
from strata.spark import materialize, read_texts

THRESHOLD, PROBES, MISSED, SEED = 0.93, 2, 5e-4, 5
#: Vectors that a bucket should hold, and the fewest hashes in a table.
FILL, LEAST_HASHES = 512, 1
PLANES, UNLIKE, DENSE = 256, 1e-9, 8


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the last axis, a power of two long."""
    n, width = x.shape[-1], 1
    while width < n:
        pairs = x.reshape(*x.shape[:-1], n // (2 * width), 2, width)
        x = np.stack([pairs[..., 0, :] + pairs[..., 1, :], pairs[..., 0, :] - pairs[..., 1, :]], axis=-2).reshape(x.shape)
        width *= 2
    return x


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one, without over- or underflow on the way."""
    x = x / np.maximum(np.abs(x).max(1, keepdims=True), 5e-324)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def sketches(x: np.ndarray, planes: int = PLANES, seed: int = SEED) -> np.ndarray:
    """(rows, planes / 8): the sides of random planes, as packed bits."""
    normals = np.random.default_rng([seed, x.shape[1], planes]).normal(size=(x.shape[1], planes))
    return np.packbits(unit(x) @ normals > 0, axis=1)


def most_unlike(threshold: float, planes: int = PLANES, chance: float = UNLIKE) -> int:
    """Bits in which the sketches of a pair at the threshold may differ; more have
    a smaller chance than the given one."""
    p = math.acos(min(1.0, max(-1.0, threshold))) / math.pi
    tail, k = 1.0, -1
    while tail > chance and k < planes:
        k += 1
        tail -= math.comb(planes, k) * p**k * (1 - p) ** (planes - k)
    return k


def corners(x: np.ndarray, hashes: int, probes: int = PROBES, seed: int = SEED) -> np.ndarray:
    """(rows, hashes, probes): the nearest corners in each hash, nearest first."""
    size = 1 << max(1, (x.shape[1] - 1).bit_length())
    padded = np.zeros((len(x), size))
    padded[:, : x.shape[1]] = unit(x)
    out = np.empty((len(x), hashes, probes), dtype=np.int64)
    for h in range(hashes):
        signs = np.random.default_rng([seed, h]).choice([-1.0, 1.0], (3, size))
        y = padded
        for s in signs:
            y = hadamard(y * s) / math.sqrt(size)
        magnitude = np.abs(y)
        for p in range(probes):
            at = magnitude.argmax(1)
            out[:, h, p] = 2 * at + (np.take_along_axis(y, at[:, None], 1)[:, 0] > 0)
            np.put_along_axis(magnitude, at[:, None], -1.0, 1)
    return out


@dataclass(frozen=True)
class Tables:
    hashes: int
    count: int
    threshold: float

    @staticmethod
    def kind(dim: int) -> str:
        """The type that holds the corners of vectors of a length."""
        return "<u1" if dim <= 64 else "<u2" if dim <= 1 << 14 else "<u4"

    def codes(self, x: np.ndarray) -> np.ndarray:
        """(rows, tables, hashes, probes)."""
        return corners(x, self.hashes * self.count).reshape(len(x), self.count, self.hashes, PROBES)


def choose(n: int, dim: int, threshold: float = THRESHOLD, missed: float = MISSED, fill: int = FILL) -> Tables:
    """Hashes in a table and tables for n vectors."""
    size = 1 << max(1, (dim - 1).bit_length())
    hashes = LEAST_HASHES
    while n * PROBES**hashes / (2 * size) ** hashes > fill and hashes < 6:
        hashes += 1
    rng = np.random.default_rng(SEED)
    x, y = (rng.normal(size=(4096, dim)) for _ in range(2))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y -= (x * y).sum(1, keepdims=True) * x
    y /= np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-300)
    a, b = (corners(v, 4) for v in (x, threshold * x + math.sqrt(1 - threshold**2) * y))
    meet = float((a[..., :, None] == b[..., None, :]).any((2, 3)).mean()) ** hashes
    return Tables(hashes, 1 if meet >= 1 else max(1, math.ceil(math.log(missed) / math.log(1 - meet))), threshold)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def _bucket(label: np.ndarray, dim: int, table: int, chosen: np.ndarray) -> np.ndarray:
    """Keys of rows' buckets; chosen: (rows, hashes)."""
    key = _mix(_mix(label.astype(np.int64).view(np.uint64) + np.uint64(1)) ^ np.uint64(dim << 16 | table))
    for h in range(chosen.shape[1]):
        key = _mix(key ^ chosen[:, h].view(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    return key.view(np.int64)


MEMBER = "bucket long, tab int, dim int, rep long, probe int, codes binary, sketch binary"
KEYS = ["bucket", "tab", "dim"]


def _hashed(tables: Tables):
    """(bucket, tab, dim, rep, probe, codes, sketch) once for every bucket of each
    (rep, label, vector); probe says which choice of corners the bucket is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                b = whole.slice(at, 2048)
                sizes = np.diff(b.column(2).offsets.to_numpy())
                for dim in np.unique(sizes).tolist():
                    own = b.filter(pa.array(sizes == dim))
                    x = own.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64)
                    label, codes = own.column(1).to_numpy(zero_copy_only=False), tables.codes(x)
                    packed = pa.array([r.tobytes() for r in codes.astype(tables.kind(dim))], pa.binary())
                    sketch = pa.array([r.tobytes() for r in sketches(x)], pa.binary())
                    for t in range(tables.count):
                        for p, probe in enumerate(np.ndindex(*(PROBES,) * tables.hashes)):
                            chosen = np.stack([codes[:, t, h, k] for h, k in enumerate(probe)], axis=1)
                            place = [pa.array(np.full(len(x), n, dtype=np.int32)) for n in (t, dim, p)]
                            arrays = [pa.array(_bucket(label, dim, t, chosen)), *place[:2], own.column(0), place[2], packed, sketch]
                            yield pa.RecordBatch.from_arrays(arrays, names=[*KEYS, "rep", "probe", "codes", "sketch"])

    return run


def _first_meeting(a: np.ndarray, b: np.ndarray, table: int, here: np.ndarray) -> np.ndarray:
    """Which pairs meet in no table before this one, and in no earlier bucket of
    it.  a, b: (pairs, tables, hashes, probes); here: the corners of this bucket."""
    new = np.ones(len(a), dtype=bool)
    for t in range(table):
        meets = np.ones(len(a), dtype=bool)
        for h in range(a.shape[2]):
            meets &= (a[:, t, h, :, None] == b[:, t, h, None, :]).any((1, 2))
        new &= ~meets
    most = np.iinfo(a.dtype).max
    shared = np.where((a[:, table, :, :, None] == b[:, table, :, None, :]).any(3), a[:, table], most)
    return new & (shared.min(2) == here).all(1)


class _Group:
    """The members of one pair of blocks: sketches, corners, and which block."""

    def __init__(self, tables: Tables, rows: pa.Table, a: int, b: int):
        column = lambda name: rows.column(name)[a:b]
        self.table, self.dim = column("tab")[0].as_py(), column("dim")[0].as_py()
        self.codes = np.frombuffer(b"".join(column("codes").to_pylist()), dtype=tables.kind(self.dim)).reshape(b - a, tables.count, tables.hashes, PROBES)
        self.sides = np.unpackbits(np.frombuffer(b"".join(column("sketch").to_pylist()), dtype=np.uint8).reshape(b - a, -1), axis=1).astype(np.float32) * 2 - 1
        probe = np.array(list(np.ndindex(*(PROBES,) * tables.hashes)))[column("probe").to_numpy()]
        self.here = np.take_along_axis(self.codes[:, self.table], probe[:, :, None], 2)[:, :, 0]
        block = column("block").to_numpy()
        self.apart = block[:, None] != block[None] if column("lo")[0].as_py() != column("hi")[0].as_py() else None

    def candidates(self, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs that meet here first and whose sketches are alike."""
        planes = self.sides.shape[1]
        alike = np.triu(self.sides @ self.sides.T >= planes - 2 * most, 1)
        if self.apart is not None:
            alike &= self.apart
        u, v = np.nonzero(alike)
        for at in range(0, len(u), 1 << 15):
            i, j = u[at : at + (1 << 15)], v[at : at + (1 << 15)]
            new = _first_meeting(self.codes[i], self.codes[j], self.table, self.here[i])
            if new.any():
                yield i[new], j[new]


def _sift(tables: Tables, most: int, dense: int):
    """Candidate pairs (a, b) of each group, or where they are many, the group."""

    def run(rows: pa.Table, starts: list[int]) -> Iterator[pa.RecordBatch]:
        rep, lo, hi = (rows.column(c).to_numpy() for c in ("rep", "lo", "hi"))
        keys = [rows.column(c).to_numpy() for c in KEYS]
        pairs, groups = [], []
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            if b - a < 2:
                continue
            held, n = [], 0
            for i, j in _Group(tables, rows, a, b).candidates(most):
                held.append((rep[a + i], rep[a + j]))
                n += len(i)
                if n > dense * (b - a):
                    break
            if n > dense * (b - a):
                groups.append((*(int(k[a]) for k in keys), int(lo[a]), int(hi[a])))
            else:
                pairs += held
        left, right = (np.concatenate([p[k] for p in pairs]) if pairs else np.zeros(0, np.int64) for k in (0, 1))
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
        columns = list(zip(*groups, strict=True)) if groups else [()] * 5
        made = [pa.concat_arrays([pa.nulls(len(left), k), pa.array(c, k)]) for c, k in zip(columns, kinds, strict=True)]
        ends = [pa.concat_arrays([pa.array(x), pa.nulls(len(groups), pa.int64())]) for x in (left, right)]
        yield pa.RecordBatch.from_arrays([*ends, *made], names=["a", "b", *KEYS, "lo", "hi"])

    return run


FOUND = "rep long, links long, other long"


def _compare(tables: Tables, most: int):
    """Links and spanning edges of whole groups, from their vectors."""

    def run(rows: pa.Table, starts: list[int]) -> Iterator[pa.RecordBatch]:
        rep, n, label = (rows.column(c).to_numpy() for c in ("rep", "n", "label"))
        links = np.zeros(rows.num_rows, dtype=np.int64)
        edges: list[tuple[int, int]] = []
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            x = unit(np.array(rows.column("v")[a:b].to_pylist(), dtype=np.float64))
            close = (x @ x.T >= tables.threshold) & (label[a:b][:, None] == label[a:b][None])
            linked = np.zeros_like(close)
            for i, j in _Group(tables, rows, a, b).candidates(most):
                linked[i, j] = close[i, j]
            linked |= linked.T
            links[a:b] += linked @ n[a:b]
            edges += [(a + u, a + v) for u, v in spanning(linked)]
        some = np.flatnonzero(links)
        e = np.array(edges, dtype=np.int64).reshape(-1, 2)
        ids = np.concatenate([rep[some], rep[e[:, 0]]])
        to = pa.concat_arrays([pa.nulls(len(some), pa.int64()), pa.array(rep[e[:, 1]], pa.int64())])
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(np.concatenate([links[some], np.zeros(len(e), np.int64)])), to], names=["rep", "links", "other"])

    return run


def _verify(threshold: float):
    """The links of candidate pairs (a, b, na, nb, va, vb)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ends = [b.column(k).to_numpy() for k in range(4)]
            size = np.diff(b.column(4).offsets.to_numpy())
            for dim in np.unique(size).tolist():
                own = size == dim
                x, y = (unit(b.column(k).filter(pa.array(own)).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64)) for k in (4, 5))
                close = (x * y).sum(1) >= threshold
                left, right, n, m = (e[own][close] for e in ends)
                none = pa.nulls(len(right), pa.int64())
                to = pa.concat_arrays([pa.array(right, pa.int64()), none])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([left, right])), pa.array(np.concatenate([m, n])), to], names=["rep", "links", "other"])

    return run


def linked(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD, dense: int = DENSE) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row."""
    fine = "size(v) > 0 AND NOT exists(v, x -> x IS NULL OR isnan(x) OR abs(x) = double('Infinity')) AND exists(v, x -> x != 0)"
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("of_label"), F.col(vec_col).alias("v"))
    rows = rows.withColumn("fine", F.coalesce(F.expr(fine), F.lit(False)) & F.col("vec_id").isNotNull() & F.col("of_label").isNotNull())
    # 128 bits of a vector and its label stand for both, 64 bits for the label alone
    rows = rows.select("vec_id", "v", "fine", F.xxhash64("of_label").alias("label"), F.xxhash64("of_label", "v").alias("h1"), F.xxhash64("v", "of_label", F.lit(1)).alias("h2"))
    merged = materialize(rows.filter("fine").groupBy("h1", "h2").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n"), F.first("label").alias("label"), F.first("v").alias("v")), "vectors")
    by_label = merged.groupBy("label").agg(F.count(F.lit(1)).cast("double").alias("n"), F.max(F.size("v")).alias("dim"))
    usual, dim = by_label.agg(F.sum(F.col("n") * F.col("n")) / F.sum("n"), F.max("dim")).first()
    tables, most = choose(math.ceil(usual or 0), dim or 1, threshold), most_unlike(threshold)
    members = dealt(merged.select("rep", "label", "v").mapInArrow(_hashed(tables), MEMBER), KEYS, "rep")
    sifted = materialize(in_groups(members, KEYS, "rep", _sift(tables, most, dense), "a long, b long, bucket long, tab int, dim int, lo long, hi long"), "sifted", 0)
    ends = [merged.select(F.col("rep").alias(k), F.col("n").alias(f"n{k}"), F.col("label").alias(f"label{k}"), F.col("v").alias(f"v{k}")) for k in "ab"]
    pairs = sifted.filter("a IS NOT NULL").select("a", "b").join(ends[0], "a").join(ends[1], "b").filter("labela = labelb").select("a", "b", "na", "nb", "va", "vb")
    full = sifted.filter("a IS NULL").select(*KEYS, "lo", "hi")
    whole = members.join(full, [*KEYS, "lo", "hi"], "left_semi").join(merged.select("rep", "n", "label", "v"), "rep")
    found = pairs.mapInArrow(_verify(threshold), FOUND).unionByName(in_groups(whole, KEYS, "rep", _compare(tables, most), FOUND))
    found = materialize(found, "found", 0)
    roots = components(found.filter("other IS NOT NULL").select(F.col("rep").alias("a"), F.col("other").alias("b")))
    others = found.groupBy("rep").agg(F.sum("links").alias("links"))
    by_vector = merged.select("h1", "h2", "rep", "n").join(others, "rep", "left").join(roots, F.col("rep") == F.col("node"), "left")
    by_vector = by_vector.select(F.col("h1").alias("k1"), F.col("h2").alias("k2"), (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.coalesce("root", "rep").alias("component"))
    out = rows.select("vec_id", "fine", "h1", "h2").join(by_vector, F.col("fine") & (F.col("h1") == F.col("k1")) & (F.col("h2") == F.col("k2")), "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: links and component of every vector."""
    return linked(read_texts(spark, sf_dir, "embeddings"))
