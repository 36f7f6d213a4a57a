"""Language identification by averaged hashed subword embeddings.

A text is the mean of the embeddings of its subwords: byte n-grams of lower-case
words with their boundaries, hashed into ``BUCKETS`` rows.  A linear softmax on
the mean gives the languages.  Both are trained together by stochastic gradient
descent in numpy.  Once trained, embedding times softmax weights is one small
table, so a text's logits are the mean of its subwords' rows of that table.

A temperature and a rejection threshold are fitted on training rows kept aside:
the score is the calibrated probability of the predicted language, and a text is
rejected if it has no letter or its score is below the threshold.  The threshold is
calibrated on both kinds: it rejects ``STRANGE_REJECTED`` of texts whose letters
have been put in another order, which are words of no language, or as many as it
can while it rejects at most ``CLEAN_REJECTED`` of the known rows.

Scale: the trainer sees at most about ``SAMPLE`` labelled documents, the same
number from each language and every distinct text once, as sparse counts of at most
``MOST`` subwords that the executors make.  Prediction is one scan; a task holds the
table (``BUCKETS`` x languages).

Cases: a null text, and one without a letter, is ``und`` with score 0; a null
language teaches nothing.  Without any labelled document every text is ``und``.
Of languages with equal scores the first by name is taken.  Very long texts are read
whole, in parts.  Rows that repeat are predicted each.  Other columns are not read
by the model, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.llm.textops import release, texts
from strata.spark import read_texts

BUCKETS, SIZES, DIM = 1 << 14, (2, 3, 4), 16
SAMPLE, ASIDE, EPOCHS, RATE, SEED = 4_000, 5, 6, 4.0, 11
#: Share of known texts that may be rejected, and of strange ones that should be.
CLEAN_REJECTED, STRANGE_REJECTED = 0.001, 0.95
#: Subwords of a text, its most frequent ones, that training looks at.
MOST = 4096
UNKNOWN = "und"
#: Bytes of text that are cut into subwords at a time.
PART = 1 << 18

ASCII_LETTER = regex.compile(rb"[A-Za-z]")
LETTER = regex.compile(r"\p{L}")

_at = np.arange(256)
#: Lower-case letters and bytes of longer characters stay, all else is a boundary.
FOLD = np.where((_at >= 65) & (_at <= 90), _at + 32, np.where((_at >= 97) & (_at <= 122) | (_at >= 128), _at, 0)).astype(np.uint32)


def has_letter(text: bytes) -> bool:
    return bool(ASCII_LETTER.search(text)) or not text.isascii() and bool(LETTER.search(text.decode("utf-8")))


def subwords(part: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(text index, bucket) of every subword of these texts.

    An n-gram may begin or end at a word boundary but not run over one.
    """
    joined = b"\n" + b"\n".join(part) + b"\n"
    folded = FOLD[np.frombuffer(joined, dtype=np.uint8)]
    lengths = np.array([len(t) + 1 for t in part], dtype=np.int64)
    owner = np.repeat(np.arange(len(part), dtype=np.int64), lengths)
    edge = np.concatenate([[0], np.cumsum(folded == 0)])
    index, bucket = [], []
    for n in SIZES:
        if len(folded) < n:
            continue
        last = len(folded) - n + 1
        code = np.full(last, n * 2654435761 & 0xFFFFFFFF, dtype=np.uint32)
        for k in range(n):
            code = (code ^ folded[k : k + last]) * np.uint32(16777619)
            code ^= code >> np.uint32(15)
        inside = edge[n - 1 : n - 1 + last] == edge[1 : 1 + last]
        if n == 2:  # two boundaries with nothing between them
            inside &= (folded[:last] != 0) | (folded[1 : 1 + last] != 0)
        keep = np.flatnonzero(inside & (np.arange(last) < len(owner)))
        index.append(owner[keep])
        bucket.append((code[keep] % np.uint32(BUCKETS)).astype(np.int64))
    return np.concatenate(index or [np.zeros(0, np.int64)]), np.concatenate(bucket or [np.zeros(0, np.int64)])


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    threshold: float

    def predict(self, raw: list[bytes]) -> tuple[list[str], np.ndarray]:
        """Language and score of each text."""
        logits, counts = np.zeros((len(raw), len(self.languages))), np.zeros(len(raw))
        at = 0
        while at < len(raw):
            size, to = 0, at
            while to < len(raw) and (to == at or size + len(raw[to]) < PART):
                size += len(raw[to])
                to += 1
            index, bucket = subwords(raw[at:to])
            counts[at:to] += np.bincount(index, minlength=to - at)
            for k in range(len(self.languages)):
                logits[at:to, k] += np.bincount(index, weights=self.table[bucket, k], minlength=to - at)
            at = to
        if not self.languages:
            return [UNKNOWN] * len(raw), np.zeros(len(raw))
        chance = softmax((logits / np.maximum(counts, 1)[:, None] + self.bias) / self.temperature)
        seen = np.array([has_letter(t) for t in raw], dtype=bool)
        names = [self.languages[k] if s else UNKNOWN for k, s in zip(chance.argmax(1), seen, strict=True)]
        return names, np.where(seen, chance.max(1, initial=0.0), 0.0)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True, initial=-np.inf))
    return e / e.sum(1, keepdims=True)


def scrambled(text: bytes) -> bytes:
    """The text with its letters in another order: words of no language."""
    signs = np.array(list(text.decode("utf-8", "replace")))
    letters = np.flatnonzero(np.char.isalpha(signs)) if len(signs) else np.zeros(0, np.int64)
    signs[letters] = signs[np.random.default_rng(zlib.crc32(text)).permutation(letters)]
    return "".join(signs.tolist()).encode("utf-8")


def counted(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Its most frequent subwords, in order, and how often each stands there."""
    bucket, n = np.unique(subwords([text])[1], return_counts=True)
    if len(bucket) > MOST:
        chosen = np.sort(np.argsort(-n, kind="stable")[:MOST])
        bucket, n = bucket[chosen], n[chosen]
    return bucket.astype(np.int16), n.astype(np.float32)


def counts_of(rows: DataFrame) -> DataFrame:
    """(lang, buckets, counts) of (lang, text), and with a null language those of
    one in ``ASIDE`` texts, scrambled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = texts(b.column(1))
            found = [(lang, *counted(t)) for lang, t in zip(b.column(0).to_pylist(), raw, strict=True)]
            found += [(None, *counted(scrambled(t))) for t in raw if not zlib.crc32(t) % ASIDE]
            for lang, bucket, n in found:
                arrays = [pa.array([lang], pa.string()), pa.array([bucket], pa.list_(pa.int16())), pa.array([n], pa.list_(pa.float32()))]
                yield pa.RecordBatch.from_arrays(arrays, names=["lang", "buckets", "counts"])

    return rows.mapInArrow(run, "lang string, buckets array<short>, counts array<float>")


def train(languages: list[str], known: list[int], buckets: list[np.ndarray], counts: list[np.ndarray], strange: list[tuple[np.ndarray, np.ndarray]] = (), dim: int = DIM, epochs: int = EPOCHS, rate: float = RATE, seed: int = SEED) -> Model:
    """Stochastic gradient descent on the rows, every ``ASIDE``-th kept aside.

    The threshold rejects ``STRANGE_REJECTED`` of the strange rows (buckets and
    counts), or as many as it can without rejecting more than ``CLEAN_REJECTED`` of
    the rows kept aside.
    """
    rng = np.random.default_rng(seed)
    embed = rng.normal(0, 1 / dim, (BUCKETS, dim))
    weight, bias = np.zeros((dim, len(languages))), np.zeros(len(languages))
    shares = [c.astype(float) / max(c.sum(), 1) for c in counts]
    fit = [i for i in range(len(known)) if i % ASIDE and len(buckets[i])]
    aside = [i for i in range(len(known)) if not i % ASIDE and len(buckets[i])]
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for i in rng.permutation(fit):
            mean = shares[i] @ embed[buckets[i]]
            error = softmax((mean @ weight + bias)[None])[0]
            error[known[i]] -= 1
            back = weight @ error
            weight -= step * 0.1 * np.outer(mean, error)
            bias -= step * 0.01 * error
            embed[buckets[i]] -= step * np.outer(shares[i], back)
    table = embed @ weight
    model = Model(languages, table, bias, 1.0, 0.0)
    if aside:
        logits = np.array([shares[i] @ table[buckets[i]] + bias for i in aside])
        truth = np.array([known[i] for i in aside])
        grid = np.geomspace(0.05, 20, 61)
        loss = [-np.log(np.maximum(softmax(logits / t)[np.arange(len(aside)), truth], 1e-12)).mean() for t in grid]
        model.temperature = float(grid[int(np.argmin(loss))])
        score = softmax(logits / model.temperature).max(1)
        model.threshold = float(np.quantile(score, CLEAN_REJECTED, method="lower"))
        other = np.array([n / max(n.sum(), 1) @ table[b] + bias for b, n in strange if len(b)]).reshape(-1, len(languages))
        if len(other):
            unlike = softmax(other / model.temperature).max(1)
            model.threshold = min(model.threshold, float(np.quantile(unlike, STRANGE_REJECTED, method="higher")))
    return model


def learn(rows: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from rows (lang, text), null languages left out.

    Of each language the texts with the smallest hashes are taken, about
    sample / languages of them; a text that many rows share counts once.
    """
    rows = rows.filter(F.col("lang").isNotNull()).withColumn("_key", F.pmod(F.xxhash64("text"), F.lit(1 << 30)))
    sizes = {r["lang"]: max(1, r["n"]) for r in rows.groupBy("lang").agg(F.approx_count_distinct("_key", 0.02).alias("n")).collect()}
    if not sizes:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros(0), 1.0, 0.0)
    each = sample / len(sizes)
    limit = F.create_map(*(x for lang, n in sorted(sizes.items()) for x in (F.lit(lang), F.lit(int(min(1.0, each / n) * (1 << 30))))))
    chosen = rows.filter(F.col("_key") < limit[F.col("lang")]).select("lang", "text").distinct()
    found = counts_of(chosen).toArrow()
    languages = sorted(sizes)
    buckets, counts = ([x.values.to_numpy(zero_copy_only=False) for x in found.column(i)] for i in (1, 2))
    told = found.column(0).to_pylist()
    strange = [(b, n) for lang, b, n in zip(told, buckets, counts, strict=True) if lang is None]
    buckets, counts = ([x for lang, x in zip(told, xs, strict=True) if lang is not None] for xs in (buckets, counts))
    known = [languages.index(x) for x in told if x is not None]
    # an order that doesn't depend on partitions
    order = sorted(range(len(known)), key=lambda i: (known[i], len(buckets[i]), float(counts[i].sum()), buckets[i].tobytes(), counts[i].tobytes()))
    mixed = np.random.default_rng(SEED).permutation(order).tolist() if order else []
    return train(languages, [known[i] for i in mixed], [buckets[i] for i in mixed], [counts[i] for i in mixed], strange)


def identify(docs: DataFrame, model: Model, text_col: str = "text", name: str = "lang_pred", score: str = "score") -> DataFrame:
    """``docs`` with the language and its score in two columns behind the others."""
    columns = docs.columns
    at = columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for b in batches:
            names, scores = model.predict(texts(b.column(at)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*columns, name, score])

    out = T.StructType([*docs.schema.fields, T.StructField(name, T.StringType()), T.StructField(score, T.DoubleType())])
    # mapInArrow takes a point in a name for a field of a struct
    return docs.toDF(*(f"c{i}" for i in range(len(columns)))).mapInArrow(run, out)


def held_out(id_col: str = "doc_id") -> Column:
    return F.crc32(F.col(id_col).cast("string")) % 4 == 2


def learned(docs: DataFrame) -> Model:
    """A model from the documents that aren't held out."""
    rows = docs.filter(~F.coalesce(held_out(), F.lit(False))).select("lang", "text")
    return learn(rows)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: predicted language of every document."""
    docs = read_texts(spark, sf_dir, "documents")
    model = learned(docs)
    rows = identify(docs.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "text"), model)
    return rows.select("doc_id", "held_out", "lang_pred", "score", (F.col("score") < F.lit(model.threshold)).alias("rejected"))
