"""Byte-pair encoding through an index of pair occurrences, and decoding.

The pieces of many texts are merged together: an index maps each adjacent pair of symbols to all its places. The pair with
the lowest rank that is present is merged at all its places at once, in ascending order of ranks, and only the lists of
the neighbouring pairs are updated. A worker remembers the words it has encoded, so a batch merges only new ones.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words, and pieces of words, remembered per worker before that memory starts anew.
REMEMBERED = 200_000
PIECES = 600_000
#: White space for str.split that the vocabulary's own pattern treats as a symbol.
SEPARATORS = regex.compile("[\x1c-\x1f]")


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte: itself if printable in Latin-1, else the next free one from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class PairIndex:
    """Symbols of many pieces in one doubly linked list, and for each mergeable pair the places where it may start."""

    def __init__(self, pieces: Iterable[list[int]], ranks: dict[tuple[int, int], tuple[int, int]]):
        self.ranks = ranks
        self.symbol: list[int] = []
        self.next: list[int] = []
        self.prev: list[int] = []
        self.first: list[int] = []
        self.places: dict[tuple[int, int], list[int]] = {}
        self.active: list[tuple[int, tuple[int, int]]] = []
        for piece in pieces:
            start = len(self.symbol)
            end = start + len(piece) - 1
            self.first.append(start if piece else -1)
            self.symbol.extend(piece)
            self.prev.extend([-1, *range(start, end)] if piece else [])
            self.next.extend([*range(start + 1, end + 1), -1] if piece else [])
            for at in range(start, end):
                self._add(at)

    def _add(self, at: int) -> None:
        pair = (self.symbol[at], self.symbol[self.next[at]])
        found = self.places.get(pair)
        if found is not None:
            found.append(at)
        elif pair in self.ranks:
            self.places[pair] = [at]
            heapq.heappush(self.active, (self.ranks[pair][0], pair))

    def merge_all(self) -> None:
        """Merge until no listed pair is left. Places are taken from left to right; one that no longer holds its pair
        (a neighbour was merged first) is passed over."""
        symbol, nxt, prev = self.symbol, self.next, self.prev
        while self.active:
            _, pair = heapq.heappop(self.active)
            left, right = pair
            merged = self.ranks[pair][1]
            for at in sorted(self.places.pop(pair)):
                second = nxt[at]
                if symbol[at] != left or second < 0 or symbol[second] != right:
                    continue
                symbol[at] = merged
                symbol[second] = -1
                after = nxt[second]
                nxt[at] = after
                if after >= 0:
                    prev[after] = at
                    self._add(at)
                if prev[at] >= 0:
                    self._add(prev[at])

    def pieces(self) -> Iterator[list[int]]:
        for at in self.first:
            out = []
            while at >= 0:
                out.append(self.symbol[at])
                at = self.next[at]
            yield out


class Vocabulary:
    """A word-end BPE vocabulary file: normal form, splitting pattern, merges and special tokens are read from it."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        model = data["model"]
        self.ids: dict[str, int] = dict(model["vocab"])
        self.special: dict[str, int] = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.suffix: str = model["end_of_word_suffix"]
        split = data["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.pattern = regex.compile(split)
        self.specials = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) or r"(?!)")
        self.ranks: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, merge in enumerate(model["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ", 1)
            self.ranks.setdefault((self.ids[left], self.ids[right]), (rank, self.ids[left + right]))
        alphabet = byte_alphabet()
        self.inner = [self.ids.get(c) for c in alphabet]
        self.last = [self.ids.get(c + self.suffix) for c in alphabet]
        self.tokens: dict[int, str] = {i: t for t, i in (self.ids | self.special).items()}

    @property
    def size(self) -> int:
        return max(self.tokens, default=0) + 1

    def symbols(self, piece: str) -> list[int]:
        raw = piece.encode("utf-8", "surrogatepass")
        out = [self.inner[b] for b in raw[:-1]] + [self.last[raw[-1]]]
        return [s for s in out if s is not None]

    def split_word(self, word: str) -> list[str | int]:
        """Pieces and special ids of a run without white space."""
        out: list[str | int] = []
        at = 0
        for hit in self.specials.finditer(word):
            out += self._pieces(word[at : hit.start()])
            out.append(self.special[hit.group()])
            at = hit.end()
        return out + self._pieces(word[at:])

    def _pieces(self, part: str) -> list[str]:
        return self.pattern.findall(self.lowered(part)) if part else []

    def lowered(self, part: str) -> str:
        """The normal form; each character is lowered by itself, as str.lower alone would look at the neighbours of a final sigma."""
        composed = unicodedata.normalize("NFC", part)
        return composed.lower() if "Σ" not in composed else "".join(c.lower() for c in composed)


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Encoder:
    """Encodes batches of texts; remembers the ids of words between batches."""

    def __init__(self, path: str):
        self.vocabulary = vocabulary(path)
        #: Ids of words and of pieces as packed four-byte numbers, which take a third of the room of lists of numbers.
        self.words: dict[str, bytes] = {}
        self.known: dict[str, bytes] = {}

    def _words_of(self, text: str) -> list[str]:
        if SEPARATORS.search(text):
            return [w for w in regex.split(r"[^\S\x1c-\x1f]+", text) if w]
        return text.split()

    def learn(self, words: Iterable[str]) -> None:
        """Encode the words that are not yet remembered, all pieces never seen in one pair index. A full memory starts anew
        before the batch, so that all words of the batch are remembered after it; words and pieces have their own bounds, as
        most new words (a word with its comma) are made of known pieces."""
        if len(self.words) > REMEMBERED:
            self.words.clear()
        if len(self.known) > PIECES:
            self.known.clear()
        split = {w: self.vocabulary.split_word(w) for w in set(words).difference(self.words)}
        known = self.known
        fresh = list({p for parts in split.values() for p in parts if isinstance(p, str) and p not in known})
        index = PairIndex([self.vocabulary.symbols(p) for p in fresh], self.vocabulary.ranks)
        index.merge_all()
        known.update(zip(fresh, (np.asarray(ids, np.int32).tobytes() for ids in index.pieces())))
        for word, parts in split.items():
            self.words[word] = b"".join([known[p] if isinstance(p, str) else np.int32(p).tobytes() for p in parts])

    def encode(self, texts: Iterable[str | None]) -> Iterator[list[int]]:
        """Ids of each text; null counts as empty. The whole batch is merged together."""
        return (ids.tolist() for ids in self.arrays(texts))

    def arrays(self, texts: Iterable[str | None]) -> Iterator[np.ndarray]:
        """The ids of :meth:`encode` as four-byte numbers."""
        split = [self._words_of(t or "") for t in texts]
        self.learn({w for ws in split for w in ws})
        words = self.words
        for ws in split:
            yield np.frombuffer(b"".join([words[w] for w in ws]), np.int32)

    def decode(self, ids: Iterable[int]) -> str:
        """Tokens of the ids between single blanks, word-end marks and special tokens included; unknown ids are left out.

        The vocabulary file names no decoder, and this is the text its library gives back then.
        """
        tokens = self.vocabulary.tokens
        return " ".join(tokens[i] for i in ids if i in tokens)


@functools.lru_cache(maxsize=2)
def encoder_for(path: str) -> Encoder:
    """One encoder per worker process, whose memory serves all its tasks."""
    return Encoder(path)


def _batches(texts: pd.Series, size: int) -> Iterator[list[str | None]]:
    """Runs of texts of about ``size`` characters, so that the memory of a batch does not follow the longest text."""
    run, held = [], 0
    for text in texts:
        run.append(text)
        held += len(text or "")
        if held >= size:
            yield run
            run, held = [], 0
    if run:
        yield run


def encode(text: Column, path: str, batch_chars: int = 2_000_000) -> Column:
    """array<int> of the ids of each text (null: empty array). ``path`` names the vocabulary file on every executor."""

    @F.pandas_udf("array<int>")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = encoder_for(path)
        for texts in batches:
            # Arrays of four bytes an id: lists of Python numbers would take nine times as much for a batch of rows.
            coded = (ids for run in _batches(texts, batch_chars) for ids in encoder.arrays(run))
            yield pd.Series(list(coded), dtype=object)

    return of(text)


def decode(ids: Column, path: str) -> Column:
    """The text of each array of ids; null gives an empty text."""

    @F.pandas_udf("string")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = encoder_for(path)
        for arrays in batches:
            yield pd.Series([encoder.decode(() if a is None else a) for a in arrays], dtype=str)

    return of(ids)


def round_trip(text: Column, path: str, batch_chars: int = 2_000_000) -> Column:
    """struct(ids, n_tokens, ids_sha256, decoded_sha256): the ids of each text, and the digests of :func:`digests` in the same pass.

    The memory of words ends with each task, as a worker may go on with other work after a stage of a pipeline.
    """

    @F.pandas_udf("ids array<int>, n_tokens long, ids_sha256 string, decoded_sha256 string")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        encoder = Encoder(path)
        for texts in batches:
            # Each run leaves by itself, so a worker holds the ids of about ``batch_chars`` characters and not of all rows.
            for run in _batches(texts, batch_chars):
                rows = [(ids, len(ids), *_digests(encoder, ids)) for ids in encoder.arrays(run)]
                yield pd.DataFrame(rows, columns=["ids", "n_tokens", "ids_sha256", "decoded_sha256"])

    return of(text)


def _digests(encoder: Encoder, coded: np.ndarray) -> tuple[str, str]:
    ids = coded.tolist()
    shown = hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    return shown, hashlib.sha256(encoder.decode(ids).encode("utf-8", "surrogatepass")).hexdigest()


def digests(text: Column, path: str, batch_chars: int = 2_000_000) -> Column:
    """struct(n_tokens, ids_sha256, decoded_sha256): each text encoded and decoded again, without carrying its ids on."""

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        encoder = encoder_for(path)
        for texts in batches:
            rows = []
            for run in _batches(texts, batch_chars):
                for ids in encoder.arrays(run):
                    rows.append((len(ids), *_digests(encoder, ids)))
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return of(text)
