"""Token counts of every prefix, so that budgets need no second encoding.

For a text cut into white-space-separated pieces w0, w1, ... the table is filled
from left to right: the count at the end of a piece is the count before it plus
the piece's own, and inside a piece the table goes on by pre-token and by byte.
Of all tokens that end at a byte, the last of the prefix's own is the one that its
merges leave beside the last token before it, so its count is one more than the
count there (``Merges``).  No prefix is encoded again, and time and memory are
linear in the piece.  Counts at piece ends never fall, so the longest prefix within
a budget is found by bisection and a look inside one piece, of which no more is
looked at than the budget's tokens can cover.

Scale: one scan, no shuffle.  ``prefix_counts`` returns one integer for each
code point and is meant for texts that will be cut at several budgets;
``count_tokens`` keeps the table of piece ends only while it is needed.

Cases: a null text counts as empty: no tokens, and a table of one zero.  An
input without rows gives none.  Very long texts are counted whole; so are long texts
without white space.  Other columns of the input are not read, whatever their
names; rows that repeat are counted each.
"""

from __future__ import annotations

import json
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm.textops import texts
from strata.llm.tokens import Encoder, encoder, vocabulary_path
from strata.spark import read_texts

BUDGET = 2048


class Merges:
    """Token counts of the prefixes of one pre-token, from the file's merges."""

    MOST = 300_000

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        self.suffix = model["end_of_word_suffix"]
        self.vocab = model["vocab"]
        self.rank = {tuple(m.split(" ")) if isinstance(m, str) else tuple(m): i for i, m in enumerate(model["merges"])}
        self.longest = max(len(t.removesuffix(self.suffix)) for t in self.vocab)
        self.beside: dict[tuple[str, str, bool], bool] = {}

    def _merged(self, parts: list[str]) -> list[str]:
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.rank.get((parts[i], parts[i + 1]), len(self.rank)))
            if (parts[best], parts[best + 1]) not in self.rank:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def _stays(self, left: str, right: str, last: bool) -> bool:
        """Whether the merges of left + right end in these two tokens."""
        key = (left, right, last)
        if (found := self.beside.get(key)) is None:
            if len(self.beside) > self.MOST:
                self.beside = {}
            end = self.suffix if last else ""
            symbols = [*left, *right]
            symbols[-1] += end
            found = self.beside[key] = self._merged(symbols) == ([left, right + end] if left else [right + end])
        return found

    def _token(self, symbols: str, to: int, tokens: list[str], last: bool) -> str:
        end = self.suffix if last else ""
        for n in range(min(self.longest, to), 0, -1):
            token = symbols[to - n : to]
            if token + end in self.vocab and self._stays(tokens[to - n], token, last):
                return token
        raise ValueError("no token ends here")

    def counts(self, symbols: str) -> list[int]:
        """Tokens of symbols[:1], symbols[:2], ..., each as a whole word."""
        tokens, inner, out = [""], [0], []
        for to in range(1, len(symbols) + 1):
            out.append(inner[to - len(self._token(symbols, to, tokens, True))] + 1)
            token = self._token(symbols, to, tokens, False)
            tokens.append(token)
            inner.append(inner[to - len(token)] + 1)
        return out


class Prefixes:
    """Counts of the prefixes of pieces; those of short pieces are remembered.

    Where a piece isn't in normal form or holds a special token, or the file is of
    another kind, its prefixes are encoded in small batches: little memory, but time
    that grows with the square of the piece.
    """

    MOST, LONG, BATCH = 50_000, 64, 1 << 22

    def __init__(self, enc: Encoder):
        self.enc, self.known, self._merges = enc, {}, None

    @property
    def merges(self) -> Merges:
        self._merges = self._merges or Merges(self.enc.path)
        return self._merges

    def inside(self, piece: str, most: int | None = None) -> list[int]:
        """Tokens of piece[:1], piece[:2], ..., piece; with ``most``, at least those
        that don't exceed it."""
        if most is not None and self.enc.ends is not None:
            piece = piece[: most * self.merges.longest + 1]
        if (found := self.known.get(piece)) is None:
            found = self._table(piece) if self.enc.ends is not None else None
            found = self._each(piece) if found is None else found
            if len(piece) <= self.LONG:
                if len(self.known) > self.MOST:
                    self.known = {}
                self.known[piece] = found
        return found

    def _each(self, piece: str) -> list[int]:
        out: list[int] = []
        step = max(1, self.BATCH // len(piece))
        for at in range(1, len(piece) + 1, step):
            part = [piece[:i] for i in range(at, min(at + step, len(piece) + 1))]
            out += [len(x.ids) for x in self.enc.library.encode_batch_fast(part, add_special_tokens=False)]
        return out

    def _table(self, piece: str) -> list[int] | None:
        library = self.enc.library
        if any(t.content in piece for t in library.get_added_tokens_decoder().values()):
            return None
        # then each prefix is in normal form too
        if not unicodedata.is_normalized("NFC", piece):
            return None
        each = {c: library.normalizer.normalize_str(c) for c in set(piece)}
        text = library.normalizer.normalize_str(piece)
        if "".join(each[c] for c in piece) != text:
            return None
        of_char, before = [], 0
        for symbols, (a, z) in library.pre_tokenizer.pre_tokenize_str(text):
            run = text[a:z]
            if run[0] == "'" and z - a <= 3:
                # a prefix of a contraction is cut otherwise
                counts = self._each(run)
            else:
                by_symbol = self.merges.counts(symbols)
                counts = [by_symbol[n - 1] for n in accumulate(len(c.encode("utf-8")) for c in run)]
            if len(of_char) != a:
                return None
            of_char += [before + n for n in counts]
            before = of_char[-1]
        if len(of_char) != len(text) or before != len(library.encode(piece, add_special_tokens=False).ids):
            return None
        return [of_char[n - 1] for n in accumulate(len(each[c]) for c in piece)]


def table(text: str, pieces: list[bytes], counts: list[int], prefixes: Prefixes) -> list[int]:
    """Tokens of text[:0], text[:1], ..., text."""
    out, at, before = [0], 0, 0
    for piece, n in zip(pieces, counts, strict=True):
        p = piece.decode("utf-8")
        to = text.index(p, at)
        out += [before] * (to - at)
        out += [before + x for x in prefixes.inside(p)]
        at, before = to + len(p), before + n
    return out + [before] * (len(text) - at)


def longest_within(text: bytes, pieces: list[bytes], ends: list[int], budget: int, prefixes: Prefixes) -> int:
    """Code points of the longest prefix with at most ``budget`` tokens.

    ends[i] is the count after i pieces.  Behind the last piece that fits, white
    space is free and the next piece may fit in part.
    """
    fit = bisect_right(ends, budget) - 1
    if fit == len(pieces):
        return len(text.decode("utf-8"))
    at = 0
    for p in pieces[:fit]:
        at = text.index(p, at) + len(p)
    at = text.index(pieces[fit], at)
    inner = prefixes.inside(pieces[fit].decode("utf-8"), budget - ends[fit])
    part = max((i + 1 for i, n in enumerate(inner) if ends[fit] + n <= budget), default=0)
    return len(text[:at].decode("utf-8")) + part


def prefix_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and prefix_tokens: the count of each prefix, by code points."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        prefixes = Prefixes(enc)
        for b in batches:
            raw = texts(b.column(1))
            found, at = [], 0
            for split, known in enc.batches(raw):
                for pieces in split:
                    found.append(table(raw[at].decode("utf-8"), pieces, [len(known[p]) >> 2 for p in pieces], prefixes))
                    at += 1
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(pa.int32()))], names=["doc_id", "prefix_tokens"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, prefix_tokens array<int>")


def count_tokens(docs: DataFrame, path: str, budget: int = BUDGET, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, and fit_chars: the length of the
    longest prefix within the budget."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        prefixes = Prefixes(enc)
        for b in batches:
            raw = texts(b.column(1))
            n_tokens, fit = [], []
            for text, ends in zip(raw, enc.tables(raw), strict=True):
                n_tokens.append(int(ends[-1]))
                if ends[-1] <= budget:
                    fit.append(len(text.decode("utf-8")))
                else:
                    fit.append(longest_within(text, text.split() if enc.by_piece else [text], ends.tolist(), budget, prefixes))
            arrays = [b.column(0), pa.array([len(x) for x in raw], pa.int64()), pa.array(n_tokens, pa.int64()), pa.array([n > budget for n in n_tokens], pa.bool_()), pa.array(fit, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_bytes", "n_tokens", "over_limit", "fit_chars"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean, fit_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: token counts of every document."""
    return count_tokens(read_texts(spark, sf_dir, "documents"), vocabulary_path())
