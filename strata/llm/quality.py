"""Quality rules: an isolation forest on rule statistics.

The scan turns every whole text into a few statistics: the counts that the
fixed rules use, and shares made of all of them: symbols a word, upper case among
letters, distinct words against the text's length, repeated lines, repeated words,
and characters a word.  A forest of random splits is grown on a bounded sample of
those shares; rows that few splits isolate have short paths and a high score.

Rare is not poor: most texts repeat no line, so a clean one that does is isolated at
once.  The labelled rows therefore say how often a split looks at a share: as often
as it tells rows labelled poor from rows labelled good (the area under its curve,
either way, and ``LEAST_WEIGHT``).  They also set the score above which a document
is dropped: the cut that separates both kinds best, among those that drop at most
``CLEAN_LOSS`` of the good rows.  Without both kinds all shares weigh the same and
only the fixed rules decide.

Scale: one scan, whose statistics are kept; the sample is the
``SAMPLE`` rows with the smallest hashes, and so are the ``LABELLED`` rows that the
weights come from.  The labelled rows are counted by score in ``STEPS`` steps, and
every row is scored in place.

Cases: a null or empty text has no words and fails the fixed rules.  Labels of
unknown or null documents, and null labels, count for nothing; of several labels
of a document the largest counts.  Rows that repeat are scored each, and equal
scores get equal verdicts.  Very long texts are measured whole.  Empty tables give
empty results.  Other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm.textops import SPACE_BYTES, texts
from strata.spark import kept, read_texts

TREES, SUBSAMPLE, DEPTH, SEED = 128, 256, 8, 7
SAMPLE, LABELLED, STEPS, CLEAN_LOSS, LEAST_WEIGHT = 16_384, 16_384, 4096, 0.001, 0.02
SYMBOLS = b"#*$%&|<>"
LEAST_WORDS, MOST_REPEATED, WINDOW = 20, 30, 8

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
SHARES = ["symbols_per_word", "upper_share", "distinct_share", "dup_line_share", "repeat_share", "chars_per_word"]
#: Distinct words of ordinary prose grow about as its length to this power.
GROWTH = 0.9


def _kinds() -> np.ndarray:
    """Rows: space, continuation byte, symbol, upper case, letter."""
    at = np.arange(256)
    upper = (at >= 65) & (at <= 90)
    letter = upper | (at >= 97) & (at <= 122) | (at >= 192)
    return np.stack([np.isin(at, list(SPACE_BYTES)), (at & 0xC0) == 0x80, np.isin(at, list(SYMBOLS)), upper, letter]).astype(np.int64)


KINDS = _kinds()


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside windows that stand in the text twice or more.

    Windows are ranked by doubling: equal ranks of two halves, equal ranks of
    the whole, so equality is exact.
    """
    if len(words) <= window:
        return 0
    number: dict[bytes, int] = {}
    rank = np.array([number.setdefault(w, len(number)) for w in words], dtype=np.int64)
    if len(number) == len(words):
        return 0
    width = 1
    while width < window:
        step = min(width, window - width)
        key = rank[:-step] * (len(words) + 1) + rank[step:]
        distinct, rank = np.unique(key, return_inverse=True)
        if len(distinct) == len(key):
            return 0
        width += step
    often = np.bincount(rank)[rank] > 1
    edges = np.zeros(len(words) + 1, dtype=np.int64)
    edges[: len(often)] += often
    edges[window : window + len(often)] -= often
    return int((np.cumsum(edges)[:-1] > 0).sum())


def measure(text: bytes) -> tuple:
    """COUNTS, then SHARES."""
    words = text.split()
    n = len(words)
    if not n:
        return (0,) * len(COUNTS) + (0.0,) * len(SHARES)
    space, inner, symbols, upper, letters = (KINDS @ np.bincount(np.frombuffer(text, dtype=np.uint8), minlength=256)).tolist()
    lines = [x for x in text.split(b"\n") if x.strip(SPACE_BYTES)]
    chars, dup_lines, repeats = len(text) - space - inner, len(lines) - len(set(lines)), repeated_words(words)
    shares = (symbols / n, upper / max(letters, 1), len(set(words)) / n**GROWTH, dup_lines / max(len(lines), 1), repeats / n, chars / n)
    return (n, chars, symbols, dup_lines, repeats, *shares)


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the counts of the fixed rules and the array ``shares``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [measure(t) for t in texts(b.column(1))]
            counts = list(zip(*[x[: len(COUNTS)] for x in found], strict=True)) or [()] * len(COUNTS)
            shares = pa.array([x[len(COUNTS) :] for x in found], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in counts), shares], names=["doc_id", *COUNTS, "shares"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", shares array<double>")


class Forest:
    """Trees of random splits, kept as complete binary trees in arrays.  A split
    looks at a column with a chance in proportion to its weight."""

    def __init__(self, rows: np.ndarray, trees: int = TREES, subsample: int = SUBSAMPLE, depth: int = DEPTH, seed: int = SEED, weights: np.ndarray | None = None):
        rng = np.random.default_rng(seed)
        self.weights = np.ones(rows.shape[1]) if weights is None else weights
        nodes = 2 ** (depth + 1) - 1
        self.depth, self.size = depth, min(subsample, len(rows))
        self.feature = np.zeros((trees, nodes), dtype=np.int64)
        self.split = np.full((trees, nodes), np.inf)
        self.path = np.zeros((trees, nodes))
        for t in range(trees):
            self._grow(t, 0, 0, rows[rng.choice(len(rows), self.size, replace=False)], rng)

    @staticmethod
    def usual(n: int) -> float:
        """Mean path length of a search tree over n rows."""
        return 2 * (np.log(n - 1) + np.euler_gamma) - 2 * (n - 1) / n if n > 2 else float(n == 2)

    def _grow(self, tree: int, node: int, depth: int, rows: np.ndarray, rng: np.random.Generator) -> None:
        spread = np.flatnonzero(rows.max(0) > rows.min(0)) if len(rows) else []
        if depth == self.depth or len(rows) < 2 or not len(spread):
            length, level = depth + self.usual(len(rows)), [node]
            for _ in range(self.depth - depth + 1):
                self.path[tree, level] = length
                level = [c for x in level for c in (2 * x + 1, 2 * x + 2)]
            return
        f = rng.choice(spread, p=self.weights[spread] / self.weights[spread].sum())
        cut = rng.uniform(rows[:, f].min(), rows[:, f].max())
        self.feature[tree, node], self.split[tree, node] = f, cut
        low = rows[:, f] < cut
        self._grow(tree, 2 * node + 1, depth + 1, rows[low], rng)
        self._grow(tree, 2 * node + 2, depth + 1, rows[~low], rng)

    def score(self, rows: np.ndarray) -> np.ndarray:
        """0 to 1; the shorter the paths, the higher."""
        total, each = np.zeros(len(rows)), np.arange(len(rows))
        for feature, split, path in zip(self.feature, self.split, self.path, strict=True):
            node = np.zeros(len(rows), dtype=np.int64)
            for _ in range(self.depth):
                node = 2 * node + 2 - (rows[each, feature[node]] < split[node])
            total += path[node]
        return 2.0 ** (-total / len(self.feature) / max(self.usual(self.size), 1e-9))


def scored(stats: DataFrame, forest: Forest) -> DataFrame:
    """``stats`` with the score of every row."""
    names = ["doc_id", *COUNTS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.column(len(names)).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(SHARES))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], pa.array(forest.score(rows))], names=[*names, "score"])

    return stats.select(*names, "shares").mapInArrow(run, ", ".join(f"{c} long" for c in names) + ", score double")


def base_failed():
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def _known(labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """(doc_id, good), once for each labelled document."""
    return labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("good")).dropna().groupBy("doc_id").agg(F.max("good").alias("good"))


def separation(poor: np.ndarray, good: np.ndarray) -> np.ndarray:
    """How well each column tells the rows apart: 0 not at all, 1 entirely."""
    both, n, m = np.concatenate([poor, good]), len(poor), len(good)
    out = np.zeros(both.shape[1])
    for k in range(both.shape[1]):
        _, place, times = np.unique(both[:, k], return_inverse=True, return_counts=True)
        rank = (np.cumsum(times) - (times - 1) / 2)[place]
        out[k] = abs(2 * (rank[:n].sum() - n * (n + 1) / 2) / (n * m) - 1)
    return out


def weights(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", most: int = LABELLED, least: float = LEAST_WEIGHT) -> np.ndarray:
    """The weight of each share, from labelled rows that pass the fixed rules."""
    rows = stats.filter(~base_failed()).join(_known(labels, id_col, label_col), "doc_id")
    told = rows.orderBy(F.xxhash64("doc_id", *COUNTS), "doc_id").limit(most).select("shares", "good").toArrow()
    shares, good = np.array(told.column(0).to_pylist()).reshape(-1, len(SHARES)), np.array(told.column(1).to_pylist(), dtype=np.int64) > 0
    if not len(good) or good.all() or not good.any():
        return np.ones(len(SHARES))
    return separation(shares[~good], shares[good]) + least


def calibrate(rows: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", clean_loss: float = CLEAN_LOSS) -> float:
    """The score above which a row is dropped.

    Rows that the fixed rules drop take no part.  Counts by score step and label
    are all that reaches the driver.
    """
    steps = rows.filter(~base_failed()).join(_known(labels, id_col, label_col), "doc_id").groupBy(F.floor(F.col("score") * STEPS).alias("step"), (F.col("good") > 0).alias("good")).count().collect()
    good, poor = np.zeros(STEPS + 2), np.zeros(STEPS + 2)
    for r in steps:
        (good if r["good"] else poor)[r["step"]] += r["count"]
    if not good.sum() or not poor.sum():
        return 1.0
    lost = 1 - np.cumsum(good) / good.sum()
    caught = 1 - np.cumsum(poor) / poor.sum()
    worth = np.where(lost <= clean_loss, caught - lost, -1.0)
    best = int(np.flatnonzero(worth == worth.max())[-1])
    return (best + 1) / STEPS


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts, base_failed, score and kept of every document."""
    stats = kept(statistics(docs, id_col, text_col))
    sample = stats.filter("n_words > 0").orderBy(F.xxhash64("doc_id", *COUNTS), "doc_id").limit(SAMPLE).select("shares").toArrow()
    if not sample.num_rows:
        return stats.select("doc_id", *COUNTS, base_failed().alias("base_failed"), F.lit(1.0).alias("score"), F.lit(False).alias("kept"))
    rows = scored(stats, Forest(np.array(sample.column(0).to_pylist()), weights=weights(stats, labels, id_col)))
    cut = calibrate(rows, labels, id_col)
    return rows.select("doc_id", *COUNTS, base_failed().alias("base_failed"), "score", (~base_failed() & (F.col("score") < F.lit(cut))).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: quality counts and verdict of every document."""
    found = judge(read_texts(spark, sf_dir, "documents"), read_texts(spark, sf_dir, "labels"))
    return found.select("doc_id", *COUNTS, "base_failed", "kept", "score")
