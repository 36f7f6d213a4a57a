"""Connected components of an edge table by large-star and small-star rounds.

Each round links the neighbours of every node to the smallest of them.  Rounds
only ever take the minimum of a node's neighbours, which is pre-aggregated, so
a node with very many edges costs no task more than its share; the joins carry
nothing but ids and can be split by the engine where a node is hot.  The number
of rounds grows with the logarithm of the graph's size.  Edges are written to
the shared folder after each round.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.spark import discard, materialize


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A star for each component of a partition's edges, a batch at a time."""
    for b in batches:
        parent: dict[int, int] = {}

        def root(x: int, parent: dict[int, int] = parent) -> int:
            top = x
            while (up := parent.setdefault(top, top)) != top:
                top = up
            while parent[x] != top:
                parent[x], x = top, parent[x]
            return top

        for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            a, c = root(u), root(v)
            if a != c:
                parent[max(a, c)] = min(a, c)
        star = [(x, r) for x in parent if (r := root(x)) != x]
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in star], pa.int64()), pa.array([x[1] for x in star], pa.int64())], names=["a", "b"])


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("of"), F.least("a", "m").alias("m"))
    joined = both.filter("b > a").join(least, F.col("a") == F.col("of"))
    return joined.select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """edges with a > b."""
    least = edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("of"), "m")
    joined = edges.join(least, F.col("a") == F.col("of")).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b")
    return joined.unionByName(least.select(F.col("of").alias("a"), F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node with an edge that isn't its own root.

    ``edges`` has two long columns; direction, repeats and loops don't matter.
    The root is the smallest node of the component.
    """
    a, b = edges.columns
    rows = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).filter("a != b")
    now = materialize(rows.mapInArrow(_contract, "a long, b long").distinct(), "stars")
    sign = None
    while True:
        new = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if tuple(new) == sign or not new[0]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        sign = tuple(new)
        after = materialize(_small_star(_large_star(now)), "stars")
        discard(now)
        now = after
