"""A corpus pipeline: language, lines, near-duplicates, mix, sequences.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm import langid, linededup, mixing, packing, simhash
from strata.llm.textops import free_name
from strata.llm.tokens import vocabulary_path
from strata.spark import columns_of, for_texts, materialize, read_texts, row_key


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language model rejects go: those without a letter, and
    those whose score is below its threshold."""
    for_texts(spark)
    model = langid.learned(docs)
    name, score = free_name(docs, "_lang_pred"), free_name(docs, "_lang_score")
    found = langid.identify(docs, model, name=name, score=score)
    return found.filter((F.col(name) != langid.UNKNOWN) & (F.col(score) >= F.lit(model.threshold))).select(*columns_of(docs))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated three-line windows go from the texts, and n_chars follows."""
    for_texts(spark)
    out = linededup.dedup(docs)
    return out.select(*(F.length("text").cast("long").alias("n_chars") if name == "n_chars" else c for name, c in zip(docs.columns, columns_of(docs), strict=True)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group stays: the one with the smallest id,
    and of equal ids the row with the smallest hash.

    Groups are op10's: 3-word shingles, links within 3 bits.  Most near copies at
    a 5-word Jaccard similarity of 0.8 are further apart and stay (see README).
    """
    for_texts(spark)
    each = materialize(simhash.fingerprints(docs, keys=row_key(docs)), "prints", 0)
    # rows that are equal in all columns share their key
    fps = each.groupBy("doc_id", "fp", "key0", "key1").agg(F.count(F.lit(1)).alias("n"))
    first = simhash.groups(fps).groupBy("root").agg(F.min(F.struct("doc_id", "key0", "key1", "n")).alias("m"))
    k1, k2, n = (free_name(docs, name) for name in ("_r1", "_r2", "_rows"))
    first = first.select(F.col("m.key0").alias(k1), F.col("m.key1").alias(k2), F.col("m.n").alias(n))
    alone, several = mixing.marked_rows(docs, first, k1, k2, n)
    return alone.union(several).select(*columns_of(docs))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix of sources takes it."""
    for_texts(spark)
    return mixing.mixed(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed into sequences."""
    for_texts(spark)
    return packing.pack(docs, vocabulary_path())


STAGES = [
    ("language", language),
    ("lines", lines),
    ("near_duplicates", near_duplicates),
    ("mix", mix),
    ("sequences", sequences),
]

#: Hashes over several bits, rounding by random numbers and packing aren't SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again for the next."""
    docs = read_texts(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name, 0)
    return STAGES[-1][1](spark, docs, sf_dir)
