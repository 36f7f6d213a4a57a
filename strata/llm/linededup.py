"""Line dedup by overlapping three-line windows, in DataFrame functions alone.

Every run of three consecutive lines of a text is hashed (128 bits).  Of each
window that stands in the corpus more than once, the first occurrence stays, by
document and position; the others are removed.  Covered positions are merged:
a line goes if any removed window covers it.

Scale: windows are hashed in the scan; what moves is two hashes, a document key
and a position a window.  Repeated windows are found with a pre-aggregated
minimum, so a window that a third of the documents hold is one row a task, and
joined back to their occurrences, which the engine can split where one is hot.
A document's removed positions are as many as its lines at most; its text is
rebuilt from slices between them, in time that grows with the lines.

Cases: a null text stays null and has no lines; texts of fewer than three lines
have no window and stay.  Windows of blank lines only don't count.  A window may
repeat within its own document.  Documents with equal ids are ordered by the
hash of their row; rows equal in all columns stand for each other, so none of
them is later than the other.  A null id comes before all others.  An empty
table gives an empty result.  All columns are carried, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm.textops import free_name
from strata.spark import columns_of, read_texts, row_key

WINDOW = 3
SPACE = " \t\n\x0b\x0c\r"


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def windows(docs: DataFrame, id_col: str, text_col: str, size: int = WINDOW) -> DataFrame:
    """(id, r1, r2, pos, h1, h2) of every window with ink."""
    r1, r2 = row_key(docs)
    lines = docs.select(F.col(id_col).alias("id"), r1.alias("r1"), r2.alias("r2"), lines_of(F.col(text_col)).alias("lines"))
    hashed = lines.filter(F.size("lines") >= size).select(
        "id", "r1", "r2",
        F.transform("lines", lambda x: F.xxhash64(x)).alias("a"),
        F.transform("lines", lambda x: F.xxhash64(F.lit(1), x)).alias("b"),
        F.transform("lines", lambda x: F.ltrim(x, F.lit(SPACE)) != "").alias("ink"),
    )

    def at(i: Column) -> Column:
        steps = [i + k for k in range(size)]
        some = F.lit(False)
        for s in steps:
            some = some | F.get("ink", s)
        return F.struct(i.alias("pos"), F.xxhash64(*(F.get("a", s) for s in steps)).alias("h1"), F.xxhash64(*(F.get("b", s) for s in steps)).alias("h2"), some.alias("some"))

    each = hashed.select("id", "r1", "r2", F.explode(F.transform(F.sequence(F.lit(0), F.size("a") - size), at)).alias("w"))
    return each.filter("w.some").select("id", "r1", "r2", "w.pos", "w.h1", "w.h2")


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WINDOW) -> DataFrame:
    """(r1, r2, starts): the sorted positions of a document's windows that
    stand earlier in the corpus."""
    found = windows(docs, id_col, text_col, size)
    place = F.struct("id", "r1", "r2", "pos")
    first = found.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("h1", "h2", "first")
    later = found.join(first, ["h1", "h2"]).filter(place > F.col("first"))
    return later.groupBy("r1", "r2").agg(F.sort_array(F.collect_set("pos")).alias("starts"))


def between(lines: Column, starts: Column, size: int = WINDOW) -> Column:
    """The lines that no window at ``starts`` covers."""
    last = F.size(starts) - 1

    def gap(k: Column) -> Column:
        after = F.get(starts, k) + size
        until = F.when(k < last, F.get(starts, k + 1)).otherwise(F.size(lines))
        return F.slice(lines, after + 1, F.greatest(until - after, F.lit(0)))

    head = F.slice(lines, F.lit(1), F.get(starts, F.lit(0)))
    return F.flatten(F.concat(F.array(head), F.transform(F.sequence(F.lit(0), last), gap)))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WINDOW, n_lines: str | None = None, n_removed: str | None = None) -> DataFrame:
    """``docs`` with repeated lines gone from the text; the numbers of lines and
    of removed lines in the columns named, if any."""
    k1, k2, starts, lines, kept = (free_name(docs, n) for n in ("_r1", "_r2", "_starts", "_lines", "_kept"))
    found = repeats(docs, id_col, text_col, size).select(F.col("r1").alias(k1), F.col("r2").alias(k2), F.col("starts").alias(starts))
    r1, r2 = row_key(docs)
    # texts are dealt, but not sorted: the positions make the hash table
    joined = docs.select("*", r1.alias(k1), r2.alias(k2)).join(found.hint("shuffle_hash"), [k1, k2], "left")
    split = joined.withColumn(lines, lines_of(F.col(text_col))).withColumn(kept, F.when(F.col(starts).isNotNull(), between(F.col(lines), F.col(starts), size)))
    text = F.when(F.col(kept).isNull(), F.col(text_col)).otherwise(F.array_join(kept, "\n"))
    columns = [text.alias(c) if c == text_col else own for c, own in zip(docs.columns, columns_of(docs), strict=True)]
    total = F.coalesce(F.size(lines), F.lit(0)).cast("long")
    if n_lines:
        columns.append(F.when(F.col(text_col).isNull(), F.lit(0).cast("long")).otherwise(total).alias(n_lines))
    if n_removed:
        columns.append(F.coalesce(F.size(lines) - F.size(kept), F.lit(0)).cast("long").alias(n_removed))
    return split.select(*columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: lines, removed lines and the digest of what stays of every document."""
    docs = read_texts(spark, sf_dir, "documents").select("doc_id", "text")
    out = dedup(docs, n_lines="n_lines", n_removed="n_removed")
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents),
w AS (SELECT doc_id, lines, unnest(range(0, len(lines) - 2)) AS pos FROM l),
k AS (SELECT doc_id, pos, lines[pos + 1] || chr(10) || lines[pos + 2] || chr(10) || lines[pos + 3] AS win FROM w),
r AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY win ORDER BY doc_id, pos) AS nth
      FROM k WHERE regexp_matches(win, '[^\x20\x09-\x0D]')),
c AS (SELECT DISTINCT doc_id, unnest([pos, pos + 1, pos + 2]) AS pos FROM r WHERE nth > 1),
e AS (SELECT doc_id, lines, unnest(range(0, len(lines))) AS pos FROM l),
s AS (SELECT e.doc_id, e.pos, e.lines[e.pos + 1] AS line FROM e LEFT JOIN c ON e.doc_id = c.doc_id AND e.pos = c.pos WHERE c.pos IS NULL),
t AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS kept, count(*) AS n FROM s GROUP BY doc_id)
SELECT l.doc_id, CAST(coalesce(len(l.lines), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(l.lines), 0) - coalesce(t.n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(t.kept, '')) AS kept_sha256
FROM l LEFT JOIN t ON l.doc_id = t.doc_id
"""
