"""Ids of a public tokenizer file, computed once for each distinct word a worker meets.

The library encodes words, not texts: its pre-tokenizer splits a text into words that do not influence
one another. A text with a character outside `_known` (combining marks, rare scripts, characters whose
lower case or normal form depends on their neighbours) is given to the library whole.
"""

from __future__ import annotations

import os
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs one task per core

from tokenizers import Tokenizer  # noqa: E402

from seriesforge.llm import text as tx  # noqa: E402

_RANGES = ((0x01, 0x12F), (0x131, 0x1C3), (0x1CD, 0x1DC), (0x1DE, 0x1EF), (0x400, 0x45F), (0x2010, 0x2027), (0x2030, 0x203A), (0x20AC, 0x20AC), (0x3041, 0x3096), (0x30A1, 0x30FA), (0x4E00, 0x9FA5), (0xAC00, 0xD7A3))


@lru_cache(1)
def _known() -> tuple[np.ndarray, np.ndarray]:
    """Characters that need no look at their neighbours, and the lower case of each."""
    known, lower = np.zeros(0x110000, bool), np.arange(0x110000, dtype=np.uint32)
    for first, last in _RANGES:
        for c in range(first, last + 1):
            known[c] = len(chr(c).lower()) == 1
            lower[c] = ord(chr(c).lower()[0])
    known[tx.GAP] = True
    return known, lower


tx.keep_for_stage(_known.cache_clear)


class Library:
    """A tokenizer file of one of two kinds: byte-level (blanks kept) or lower-case words (blanks dropped)."""

    def __init__(self, content: str):
        self.tokenizer = Tokenizer.from_str(content)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.bare = self.tokenizer.normalizer is not None
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        vocabulary = self.tokenizer.get_vocab() if self.bare and suffix else {}
        self.last = np.zeros(max(vocabulary.values(), default=0) + 1, bool)  # ids that end a word
        self.last[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
        self.words = tx.WordIds(self._words)

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words end to end, and the number of each word's."""
        if self.bare:  # blanks fall away and a word's last id shows its end, so many words make one text
            groups = [" ".join(words[i : i + 500]) for i in range(0, len(words), 500)]
            ids = np.fromiter(chain.from_iterable(self._encode(groups)), np.uint32)
            ends = np.flatnonzero(self.last[ids])
            if len(ends) == len(words):
                return ids, np.diff(ends, prepend=-1)
        found = self._encode(words)
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.uint32, int(lengths.sum())), lengths

    def encode(self, texts: pa.Array, sentences: bool = False) -> tuple[np.ndarray, ...]:
        """Ids of all texts end to end, and where each text's begin (and the end).

        `sentences` adds the sorted places, counted in ids, after which a sentence or line ends.
        """
        known, lower = _known()
        points, at = tx.code_points(texts, tx.GAP)
        if not len(points):
            return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64), np.zeros(0, np.int64)
        odd = np.flatnonzero(np.diff(np.concatenate(([0], np.cumsum(~known[points])))[at]))
        if self.bare:
            points = lower[points]
        starts, ends = (tx.bare_words if self.bare else tx.spaced_words)(points)
        ids, word_at = self.words.ids(points, starts, ends)
        doc_at = word_at[np.searchsorted(starts, at)]
        stops = np.zeros(0, np.int64)
        if sentences and len(starts):
            lines = np.concatenate(([0], np.cumsum(points == 0x0A)))
            closing = np.isin(points[ends - 1], [ord(c) for c in ".!?。"])
            closing[:-1] |= lines[starts[1:]] > lines[ends[:-1]]
            stops = word_at[1:][closing]
        if not len(odd):
            return ids, doc_at, stops
        whole = dict(zip(odd.tolist(), self._encode([texts[int(i)].as_py() for i in odd])))
        parts, marks, size = [], [], 0
        for i in range(len(texts)):
            a, b = doc_at[i], doc_at[i + 1]
            part = np.array(whole[i], np.uint32) if i in whole else ids[a:b]
            if i not in whole:
                marks.append(stops[np.searchsorted(stops, a, "right") : np.searchsorted(stops, b, "right")] - a + size)
            parts.append(part)
            size += len(part)
        at = np.concatenate(([0], np.cumsum([len(part) for part in parts])))
        return np.concatenate(parts), at, np.concatenate(marks) if marks else stops[:0]


@lru_cache(2)
def library(content: str) -> Library:
    return Library(content)


tx.keep_for_stage(library.cache_clear)


def file_text(path: str) -> str:
    with open(path, encoding="utf-8") as file:
        return file.read()


def with_end(ids: np.ndarray, at: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with one more id after each text."""
    return np.insert(ids, at[1:], np.uint32(end)), at + np.arange(len(at))
