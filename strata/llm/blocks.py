"""Comparing the members of each bucket with each other, whatever its size.

A bucket with more than ``BLOCK`` members is dealt into blocks, and every pair
of its blocks becomes a group of its own, so a bucket that holds a third of all
rows is compared by many tasks of the same bounded size.  Groups hand back
counts and spanning edges, never their pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.spark import materialize

BLOCK = 512


def paired(rows: DataFrame, keys: list[str], member: str, block: int = BLOCK) -> DataFrame:
    """``rows`` with columns lo, hi and block: the pair of blocks it takes part
    in and the block it comes from.  Buckets (``keys``) of one are left out."""
    counts = materialize(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("bucket_size")).filter("bucket_size > 1"), "buckets")
    n = F.ceil(F.col("bucket_size") / block)
    own = F.pmod(F.xxhash64(member), n)
    placed = rows.join(counts, keys).select(*rows.columns, own.alias("block"), F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("other"))
    return placed.select(*rows.columns, F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block")


def dealt(rows: DataFrame, keys: list[str], member: str, block: int = BLOCK) -> DataFrame:
    """Like ``paired``, but ``rows`` move only once: just the sizes of buckets with
    more than a block are joined to them, and buckets of one stay."""
    large = materialize(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("bucket_size")).filter(F.col("bucket_size") > block), "buckets")
    n = F.coalesce(F.ceil(F.col("bucket_size") / block), F.lit(1))
    own = F.pmod(F.xxhash64(member), n)
    placed = rows.join(large, keys, "left").select(*rows.columns, own.alias("block"), F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("other"))
    return placed.select(*rows.columns, F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block")


def in_groups(rows: DataFrame, keys: list[str], member: str, compare: Callable[[pa.Table, list[int]], list[pa.RecordBatch]], schema: str) -> DataFrame:
    """``compare`` over rows of ``paired``.

    It gets rows of whole groups, sorted by group, block and member, and where
    each group starts (with the end of the last).
    """
    group = [*keys, "lo", "hi"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            whole = pa.Table.from_batches(held)
            starts = _starts(whole, group)
            if len(starts) > 1:
                yield from compare(whole.slice(0, starts[-1]).combine_chunks(), starts)
                held = whole.slice(starts[-1]).combine_chunks().to_batches()
        if held:
            whole = pa.Table.from_batches(held)
            yield from compare(whole.combine_chunks(), [*_starts(whole, group), whole.num_rows])

    return rows.repartition(*group).sortWithinPartitions(*group, "block", member).mapInArrow(run, schema)


def _starts(rows: pa.Table, group: list[str]) -> list[int]:
    change = np.zeros(rows.num_rows, dtype=bool)
    change[0] = True
    for name in group:
        x = rows.column(name).to_numpy()
        change[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(change).tolist()


def spanning(linked: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the graph with this symmetric matrix."""
    seen, edges = np.zeros(len(linked), dtype=bool), []
    for root in np.flatnonzero(linked.any(1)).tolist():
        if seen[root]:
            continue
        seen[root], queue = True, [root]
        while queue:
            u = queue.pop()
            new = np.flatnonzero(linked[u] & ~seen)
            seen[new] = True
            edges += [(u, v) for v in new.tolist()]
            queue += new.tolist()
    return edges
