"""Mixing sources to target weights by pivotal dependent rounding.

Every source gets a target number of words; a document's expected number of
copies is its source's target over its source's size.  The whole part of that
number is taken at once.  The fractional parts are rounded by the pivotal
method: two documents of a source trade probability, in words, so that the
expected words of the source stay as they are, until one of the two is at 0 or
1; the other goes on to the next document.  Groups of documents dealt by hash
leave one undecided document per source each, and a tree of further rounds
over those residuals leaves one document per source, which a coin decides.
So a source's taken words miss its target by less than one document.

Scale: words are counted in the scan; after that only (id, hash, size) rows
move.  No step needs the rows of a source together, so one source may hold any
share of the rows.  A group has about ``GROUP`` rows and a node of the tree
``FAN_IN`` residuals a source.  Reruns agree: groups, order within a group and
random numbers depend on the rows alone, not on their partitions.

Cases: a null text counts 0 words and, like every document without words, is
never taken; a null source is a source of its own, ordered last.  Rows that
repeat in all columns are rounded together and their copies dealt evenly; a tie
between two documents is settled by a random number that follows from their group.
Words of very long texts are counted whole, and such a document is still one item.
Empty tables give empty results.  Columns that aren't named are ignored here;
``mixed`` carries all columns of its input.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm.textops import free_name, word_counts
from strata.spark import columns_of, materialize, read_texts, row_key

WEIGHTS, SHARE, MOST_COPIES, SEED = (5, 2, 1), 1.0, 3, 2024
GROUP, FAN_IN = 512, 64
TINY = 1e-9

UNIT = "doc_id long, r1 long, r2 long, source string, size long, n_rows long, source_size long, target double, whole long, part double, node long, up boolean"


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, r1 and r2 (hashes of all columns), source, size in words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(word_counts(b.column(4)))], names=["doc_id", "r1", "r2", "source", "size"])

    r1, r2 = row_key(docs)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), r1.alias("r1"), r2.alias("r2"), F.col(source_col).cast("string").alias("source"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(count, "doc_id long, r1 long, r2 long, source string, size long")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST_COPIES) -> DataFrame:
    """(source, source_size) with a target each.

    Weights repeat over the sources in code point order, null last.  A target
    is the source's part of ``share`` of all words, ``most`` times the source's
    size at most; what that cuts off goes to the others by weight.  The level
    that all uncut targets share is found by a few sums over the sources.
    """
    spark = sources.sparkSession
    ordered = sources.sort(F.col("source").asc_nulls_last()).rdd.zipWithIndex()
    weighed = spark.createDataFrame(ordered.map(lambda x: (x[0]["source"], x[0]["source_size"], float(weights[x[1] % len(weights)]))), "source string, source_size long, weight double")
    weighed = materialize(weighed, "weights")
    cap = F.col("source_size") * F.lit(float(most))
    total = (weighed.agg(F.sum("source_size")).first()[0] or 0) * share
    level, cut = 0.0, -1
    while True:
        capped = cap <= F.lit(level) * F.col("weight") if cut >= 0 else F.lit(False)
        n, fixed, open_weight = weighed.agg(F.count(F.when(capped, 1)), F.sum(F.when(capped, cap)), F.sum(F.when(~capped, F.col("weight")))).first()
        if n == cut or not open_weight:
            break
        level, cut = (total - (fixed or 0.0)) / open_weight, n
    return weighed.select("source", "source_size", F.least(cap, F.lit(level) * F.col("weight")).alias("target") if open_weight else cap.alias("target"))


def _trade(rows: list[dict], seed: str) -> tuple[list[dict], dict | None]:
    """Round the rows' fractional parts against each other; at most one stays."""
    rng, held = random.Random(seed), None
    done = []
    for row in rows:
        if held is None:
            held = row
        else:
            a, b = held, row
            sa, sb = a["size"] * 1.0, b["size"] * 1.0
            up = min((1 - a["part"]) * sa, b["part"] * sb)
            down = min(a["part"] * sa, (1 - b["part"]) * sb)
            move = up if rng.random() * (up + down) < down else -down
            a["part"] += move / sa
            b["part"] -= move / sb
            held = None
            for x in (a, b):
                if x["part"] < TINY or x["part"] > 1 - TINY:
                    x["up"], x["part"] = x["part"] > 0.5, 0.0
                    done.append(x)
                else:
                    held = x
    return done, held


def _round(seed: int, level: int, last: bool):
    """mapInArrow over rows sorted by (node, source): one group after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, key, group = None, None, []

        def finish() -> list[dict]:
            live = [r for r in group if r["part"] >= TINY]
            still = [r | {"up": False, "part": 0.0} for r in group if r["part"] < TINY]
            done, held = _trade(live, f"{seed}/{level}/{key}")
            if held is not None and last:
                held["up"], held["part"] = random.Random(f"{seed}/coin/{key}").random() < held["part"], 0.0
            return still + done + ([held] if held is not None else [])

        out: list[dict] = []
        for b in batches:
            schema = b.schema
            for row in b.to_pylist():
                if (k := (row["node"], row["source"])) != key:
                    if group:
                        out += finish()
                    key, group = k, []
                group.append(row)
            if len(out) >= 5_000:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
                out = []
        if group:
            out += finish()
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return run


def copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST_COPIES, seed: int = SEED) -> DataFrame:
    """How often each document is taken.

    One row for each distinct row of ``docs``: doc_id, r1 and r2 (hashes of all
    its columns), source, size, n_rows (how often it stands in ``docs``),
    source_size, target and total (copies of all those rows together).
    """
    units = materialize(sized(docs, id_col, text_col, source_col).groupBy("doc_id", "r1", "r2", "source", "size").agg(F.count(F.lit(1)).alias("n_rows")), "units")
    groups = max(1, math.ceil(units.count() / GROUP))
    sources = targets(units.groupBy("source").agg(F.sum(F.col("size") * F.col("n_rows")).alias("source_size")), weights, share, most).withColumnRenamed("source", "of_source")
    expected = F.when(F.col("size") > 0, F.col("target") / F.col("source_size") * F.col("n_rows")).otherwise(F.lit(0.0))
    whole = F.least(F.floor(expected + F.lit(TINY)), F.col("n_rows") * most)
    rows = units.join(sources, F.col("source").eqNullSafe(F.col("of_source"))).select(
        "doc_id", "r1", "r2", "source", "size", "n_rows", "source_size", "target", whole.cast("long").alias("whole"), F.greatest(expected - whole, F.lit(0.0)).alias("part"),
        F.pmod(F.xxhash64("r1", "r2"), F.lit(groups)).alias("node"), F.lit(None).cast("boolean").alias("up"),
    )
    decided, level = None, 0
    while True:
        ordered = rows.repartition("node", "source").sortWithinPartitions("node", "source", "doc_id", "r1", "r2")
        rows = materialize(ordered.mapInArrow(_round(seed, level, groups == 1), UNIT), f"rounded{level}")
        done = rows.filter(F.col("up").isNotNull())
        decided = done if decided is None else decided.unionByName(done)
        if groups == 1:
            break
        groups, level = math.ceil(groups / FAN_IN), level + 1
        rows = rows.filter(F.col("up").isNull()).withColumn("node", F.floor(F.col("node") / FAN_IN))
    return decided.select("doc_id", "r1", "r2", "source", "size", "n_rows", "source_size", "target", (F.col("whole") + F.col("up").cast("long")).alias("total"))


def per_row(total: Column, n_rows: Column, index: Column) -> Column:
    """The copies of the index-th of n_rows equal rows."""
    return F.floor(total / n_rows) + (index < total % n_rows).cast("long")


def unfolded(rows: DataFrame, n: str, name: str, part: int = 4096) -> DataFrame:
    """Each row ``n`` times, with a number from 0 on in ``name``; a row that stands
    for very many is dealt out in parts."""
    first = free_name(rows, "_first")
    few = rows.filter(F.col(n) <= part).withColumn(name, F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1)))
    many = rows.filter(F.col(n) > part).withColumn(first, F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1, F.lit(part).cast("long"))))
    many = many.repartition(F.col(first)).withColumn(name, F.explode(F.sequence(F.col(first), F.least(F.col(first) + part, F.col(n)) - 1))).drop(first)
    return few.union(many)


def marked_rows(docs: DataFrame, keys: DataFrame, k1: str, k2: str, rows: str) -> tuple[DataFrame, DataFrame]:
    """``docs`` with the columns of ``keys``, which has a row for each chosen row
    key: the rows that stand alone, and of those that repeat one each.

    ``rows`` names the column of ``keys`` that says how often a row stands in
    ``docs``.  Texts are dealt once, but not sorted: the keys make the hash table.
    """
    r1, r2 = row_key(docs)
    joined = docs.select("*", r1.alias(k1), r2.alias(k2)).join(keys.hint("shuffle_hash"), [k1, k2])
    return joined.filter(F.col(rows) == 1), joined.filter(F.col(rows) > 1).dropDuplicates([k1, k2])


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The documents, each as often as it is taken, with their own columns."""
    k1, k2, total, copy, rows = (free_name(docs, n) for n in ("_r1", "_r2", "_total", "_copy", "_rows"))
    taken = copies(docs, **options).filter(F.col("total") > 0).select(F.col("r1").alias(k1), F.col("r2").alias(k2), F.col("total").alias(total), F.col("n_rows").alias(rows))
    alone, several = marked_rows(docs, taken, k1, k2, rows)
    return alone.withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), F.col(total)))).select(*columns_of(docs)).union(unfolded(several, total, copy).select(*columns_of(docs)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: words that the mix takes of every document."""
    docs = read_texts(spark, sf_dir, "documents").select("doc_id", "text", "source")
    rows = unfolded(copies(docs), "n_rows", "row")
    taken = F.col("size") * per_row(F.col("total"), F.col("n_rows"), F.col("row"))
    return rows.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"))
