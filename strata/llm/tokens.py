"""Token ids of a public vocabulary, remembered by white-space-separated piece.

The word vocabularies used here split their input at white space before any
merge and drop the white space, so the ids of a text are the ids of its pieces
one after the other.  ``Encoder`` checks that property of the file when it
loads it and otherwise hands whole texts to the library.

Texts of plain characters (ASCII, Latin letters, common quotation marks) are cut
into pre-tokens by the file's own pattern, which for such characters comes down to
a class of each byte and a few contractions.  That is done for many texts at once
in arrays (``Plain``), and a pre-token is known by a 64-bit hash of its bytes and
its length.  New pre-tokens go to the library many at a time, as one text; the
vocabulary's end-of-word tokens tell them apart afterwards.  Very long plain texts
are cut by the pattern itself, a piece at a time, and pieces of any other text go
to the library one by one.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterable, Iterator
from itertools import chain, pairwise

import numpy as np
from tokenizers import Tokenizer, normalizers, pre_tokenizers

#: Spark runs a worker for each core already.
os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Entries of a generation of remembered pieces or pre-tokens.
REMEMBERED = 200_000
#: Bytes of plain texts that are cut at once, and of a text that is cut alone.
AT_ONCE, LONG_TEXT = 1 << 18, 1 << 20

DEFAULT_VOCABULARY = "word_bpe_49k.json"

#: Characters whose case, normal form and class are the same everywhere.
PLAIN = r"\t\n\x0b\x0c\r -~À-ÖØ-öø-ÿ–—‘’“”•…¡¿«»"
NOT_PLAIN = re.compile(f"[^{PLAIN}]|<\\|")
PRE_TOKEN = re.compile(r"[a-zß-öø-ÿ]+|'s|'t|'re|'ve|'m|'ll|'d|[0-9]|[^\sa-zß-öø-ÿ0-9]+")
#: The file's pattern that PRE_TOKEN stands for, with letters tried first.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def vocabulary_path(name: str = DEFAULT_VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Memory:
    """The latest keys and their values, in two generations.

    When the younger is full it becomes the older; keys that come up again
    move back, so that frequent ones stay.
    """

    def __init__(self, most: int):
        self.most, self.young, self.old = most, {}, {}

    def holding(self, keys: Iterable, compute: Callable[[list], list[bytes]]) -> dict:
        """A dictionary with at least these keys, which may repeat."""
        if len(self.young) > self.most:
            self.young, self.old = {}, self.young
        young, old = self.young, self.old
        if missing := {k for k in keys if k not in young}:
            back = missing & old.keys()
            young.update((k, old[k]) for k in back)
            new = list(missing - back)
            young.update(zip(new, compute(new), strict=True))
        return young


_at = np.arange(256)
#: Capital letters as small ones; the second bytes of Latin letters follow below.
FOLD = np.where((_at >= 65) & (_at <= 90), _at + 32, _at).astype(np.uint8)
SPACE, LETTER, DIGIT, SIGN = range(4)
CLASS = np.select([np.isin(_at, [9, 10, 11, 12, 13, 32]), (_at >= 97) & (_at <= 122) | (_at == 0xC3), (_at >= 48) & (_at <= 57)], [SPACE, LETTER, DIGIT], SIGN).astype(np.uint8)


class Plain:
    """Ids of plain texts, from arrays of their bytes.

    Pre-tokens are looked up in a table of hashes with open addressing, which is
    begun anew when it holds ``most`` of them.
    """

    BASE, MIX = 0x9E3779B97F4A7C15, np.uint64(0xD6E8FEB86659FD93)

    def __init__(self, encode: Callable[[list[str]], list[bytes]], bits: int = 20, most: int = 1 << 19):
        self.encode, self.bits, self.most = encode, bits, most
        self.powers = self.inverse = np.zeros(0, np.uint64)
        self._clear()

    def _clear(self) -> None:
        self.keys, self.place = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.int32)
        self.first, self.count, self.held = np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(1, "<u4")
        self.n = self.used = 0

    @staticmethod
    def _room(x: np.ndarray, n: int) -> np.ndarray:
        return x if n <= len(x) else np.concatenate([x, np.zeros(max(n, 2 * len(x)) - len(x), x.dtype)])

    def _powers(self, n: int) -> None:
        if n > len(self.powers):
            one = np.ones(1, np.uint64)
            for name, base in (("powers", self.BASE), ("inverse", pow(self.BASE, -1, 1 << 64))):
                setattr(self, name, np.concatenate([one, np.multiply.accumulate(np.full(n - 1, base, np.uint64))]))

    @staticmethod
    def cut(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where pre-tokens begin and end in small letters, three blanks behind."""
        kind = CLASS[data]
        kind[np.flatnonzero(data == 0xC3) + 1] = LETTER
        inside = kind != SPACE
        start = inside.copy()
        start[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
        # contractions: an apostrophe that no other sign goes before
        quote = np.flatnonzero(start & (data == 0x27))
        one, two = data[quote + 1], data[quote + 2]
        short = np.isin(one, list(b"stmd"))
        long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        some = short | long
        start[quote[some] + 1] = False
        behind = quote[some] + np.where(short[some], 2, 3)
        start[behind[kind[behind] == LETTER]] = True
        stop = inside.copy()
        stop[:-1] &= ~inside[1:] | start[1:]
        return np.flatnonzero(start), np.flatnonzero(stop) + 1

    def _learn(self, keys: np.ndarray, words: list[str]) -> None:
        ids = [np.frombuffer(x, "<u4") for x in self.encode(words)]
        size = np.array([len(x) for x in ids])
        n, used = self.n + len(ids), self.used + int(size.sum())
        self.first, self.count, self.held = self._room(self.first, n), self._room(self.count, n), self._room(self.held, used)
        self.first[self.n : n], self.count[self.n : n] = self.used + np.cumsum(size) - size, size
        self.held[self.used : used] = np.concatenate(ids)
        last, mask = 64 - self.bits, (1 << self.bits) - 1
        for i, key in enumerate(keys.tolist(), self.n):
            at = key >> last
            while self.keys[at]:
                at = at + 1 & mask
            self.keys[at], self.place[at] = key, i
        self.n, self.used = n, used

    def _known(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The joined texts, where pre-tokens begin and end, which entries they are,
        and how many ids all before each have."""
        joined = b" ".join(texts) + b"   "
        data = FOLD[np.frombuffer(joined, np.uint8)]
        second = np.flatnonzero(data == 0xC3) + 1
        data[second] += np.where(data[second] <= 0x9E, 32, 0).astype(np.uint8)
        begin, end = self.cut(data)
        self._powers(len(data))
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.powers[: len(data)])])
        key = (total[end] - total[begin]) * self.inverse[begin] + (end - begin).astype(np.uint64) * self.MIX
        key = (key ^ key >> np.uint64(32)) * self.MIX
        key ^= key >> np.uint64(29)
        key[key == 0] = 1
        if self.n > self.most:
            self._clear()
        known = np.full(len(key), -1, np.int64)
        todo, slot = np.arange(len(key)), (key >> np.uint64(64 - self.bits)).astype(np.int64)
        while len(todo):
            there = self.keys[slot]
            hit = there == key[todo]
            known[todo[hit]] = self.place[slot[hit]]
            on = ~hit & (there != 0)
            todo, slot = todo[on], slot[on] + 1 & (1 << self.bits) - 1
        new = np.flatnonzero(known < 0)
        if len(new):
            keys, first, which = np.unique(key[new], return_index=True, return_inverse=True)
            small = data.tobytes()
            before = self.n
            self._learn(keys, [small[a:z].decode() for a, z in zip(begin[new[first]].tolist(), end[new[first]].tolist(), strict=True)])
            known[new] = before + which
        return data, begin, end, known, np.concatenate([[0], np.cumsum(self.count[known])])

    @staticmethod
    def _firsts(texts: list[bytes], begin: np.ndarray) -> np.ndarray:
        """The first pre-token of each text, and the number of all."""
        return np.searchsorted(begin, np.cumsum([0, *(len(t) + 1 for t in texts)]))

    def ids(self, texts: list[bytes]) -> list[bytes]:
        """Each text's ids."""
        _, begin, _, known, before = self._known(texts)
        found = self.held[np.repeat(self.first[known] - before[:-1], self.count[known]) + np.arange(before[-1])].tobytes()
        return [found[a:z] for a, z in pairwise((before[self._firsts(texts, begin)] * 4).tolist())]

    def tables(self, texts: list[bytes]) -> list[np.ndarray]:
        """The number of ids of each text's prefixes that end with a piece, the
        empty one first."""
        data, begin, end, _, before = self._known(texts)
        last = np.flatnonzero(CLASS[data[end]] == SPACE)
        firsts = self._firsts(texts, begin)
        cut = np.searchsorted(last, firsts).tolist()
        counts = before[last + 1]
        return [np.concatenate([[0], counts[a:z] - n]) for a, z, n in zip(cut[:-1], cut[1:], before[firsts].tolist(), strict=False)]


class Encoder:
    """ids of texts, as the library gives them without added special tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        self.path = path
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.by_piece = self._splits_at_space(told)
        suffix = told["model"].get("end_of_word_suffix")
        self.ends = None
        if self.by_piece and suffix and self._pattern(told) == PATTERN:
            self.ends = np.zeros(max(self.library.get_vocab().values()) + 1, dtype=bool)
            self.ends[[i for token, i in told["model"]["vocab"].items() if token.endswith(suffix)]] = True
        self.words = self._words(path) if self.ends is not None else self.library
        self.pieces, self.runs = Memory(REMEMBERED), Memory(REMEMBERED)
        self.plain = Plain(self._encode_runs)

    @staticmethod
    def _words(path: str) -> Tokenizer:
        """The library for plain lower-case pre-tokens with blanks between them: its
        steps before the merges come down to a split at white space."""
        library = Tokenizer.from_file(path)
        library.no_truncation()
        library.no_padding()
        library.normalizer = normalizers.Sequence([])
        library.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        return library

    @staticmethod
    def _splits_at_space(told: dict) -> bool:
        steps = (told.get("pre_tokenizer") or {}).get("pretokenizers", [])
        dropped = any(s["type"] == "Split" and s["behavior"] == "Removed" and s["invert"] for s in steps)
        plain = all(not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]) for t in told.get("added_tokens", []))
        spaced = any(c.isspace() for t in told.get("added_tokens", []) for c in t["content"])
        return dropped and plain and not spaced and told.get("post_processor") is None

    @staticmethod
    def _pattern(told: dict) -> str | None:
        return next((s["pattern"].get("Regex") for s in told["pre_tokenizer"]["pretokenizers"] if s["type"] == "Split"), None)

    def _encode(self, pieces: list[str]) -> list[bytes]:
        out = []
        for at in range(0, len(pieces), 5_000):
            found = self.library.encode_batch_fast(pieces[at : at + 5_000], add_special_tokens=False)
            out += [np.array(x.ids, dtype="<u4").tobytes() for x in found]
        return out

    def _encode_runs(self, runs: list[str]) -> list[bytes]:
        """Ids of strings that are one pre-token each."""
        out: list[bytes] = []
        for at in range(0, len(runs), 5_000):
            part = runs[at : at + 5_000]
            ids = np.array(self.words.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, dtype="<u4")
            to = np.flatnonzero(self.ends[ids]) + 1
            if len(to) == len(part) and to[-1] == len(ids):
                whole, to = ids.tobytes(), (to * 4).tolist()
                out += [whole[a:b] for a, b in zip([0, *to[:-1]], to, strict=True)]
            else:
                out += self._encode(part)
        return out

    def _learn(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of pieces."""
        texts = [p.decode("utf-8") for p in pieces]
        split = [PRE_TOKEN.findall(t.lower()) if self.ends is not None and not NOT_PLAIN.search(t) else None for t in texts]
        runs = self.runs.holding((x for parts in split if parts for x in parts), self._encode_runs)
        others = iter(self._encode([t for t, parts in zip(texts, split, strict=True) if parts is None]))
        return [next(others) if parts is None else b"".join([runs[x] for x in parts]) for parts in split]

    @staticmethod
    def _slices(texts: list[bytes]) -> Iterator[list[bytes]]:
        at = 0
        while at < len(texts):
            size, to = 0, at
            while to < len(texts) and (to == at or size + len(texts[to]) < 1 << 22):
                size += len(texts[to])
                to += 1
            yield texts[at:to]
            at = to

    def batches(self, texts: list[bytes]) -> Iterator[tuple[list[list[bytes]], dict[bytes, bytes]]]:
        """For a slice of texts at a time: their pieces, and the ids of each."""
        for part in self._slices(texts):
            split = [t.split() for t in part] if self.by_piece else [[t] for t in part]
            yield split, self.pieces.holding(chain.from_iterable(split), self._learn)

    def ids(self, texts: list[bytes]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        return [ids for part in self._slices(texts) for ids in self._ids(part)]

    def _sorted(self, texts: list[bytes]) -> tuple[list[list[int]], list[int]]:
        """Places of plain texts that are cut at once, and those of the others."""
        plain, size, others = [[]], 0, []
        for i, raw in enumerate(texts):
            if self.ends is None or len(raw) > LONG_TEXT or NOT_PLAIN.search(raw.decode("utf-8")):
                others.append(i)
                continue
            plain[-1].append(i)
            size += len(raw)
            if size > AT_ONCE:
                plain.append([])
                size = 0
        return [x for x in plain if x], others

    def _ids(self, texts: list[bytes]) -> list[bytes]:
        out: list[bytes] = [b""] * len(texts)
        plain, others = self._sorted(texts)
        for places in plain:
            for i, ids in zip(places, self.plain.ids([texts[i] for i in places]), strict=True):
                out[i] = ids
        at = 0
        for split, known in self.batches([texts[i] for i in others]):
            for pieces in split:
                out[others[at]] = b"".join([known[p] for p in pieces])
                at += 1
        return out

    def tables(self, texts: list[bytes]) -> list[np.ndarray]:
        """The token counts of each text's prefixes that end with a white-space-
        separated piece, the empty one first."""
        out: list[np.ndarray] = []
        for part in self._slices(texts):
            found: list[np.ndarray] = [np.zeros(1, np.int64)] * len(part)
            plain, others = self._sorted(part)
            for places in plain:
                for i, table in zip(places, self.plain.tables([part[i] for i in places]), strict=True):
                    found[i] = table
            at = 0
            for split, known in self.batches([part[i] for i in others]):
                for pieces in split:
                    found[others[at]] = np.cumsum([0, *(len(known[p]) >> 2 for p in pieces)])
                    at += 1
            out += found
        return out

    def counts(self, texts: list[bytes]) -> list[list[int]]:
        """The token count of each piece of each text."""
        out: list[list[int]] = []
        for split, known in self.batches(texts):
            out += [[len(known[p]) >> 2 for p in pieces] for pieces in split]
        return out


_loaded: dict[str, Encoder] = {}


def release() -> None:
    """Forget the encoders of this worker."""
    _loaded.clear()


def encoder(path: str) -> Encoder:
    """One encoder for each file and Python worker."""
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    return _loaded[path]
