"""Vectorised text helpers that run inside Arrow tasks.

Texts are handled in blocks of a bounded number of bytes (one text is never split, so a block holds
at least one whole text). Words and n-grams are named by 64-bit hashes of ranges, which a prefix sum
gives for any number of ranges at once.
"""

from __future__ import annotations

import ctypes
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK_BYTES = 1_500_000

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def full_text(column: str = "text") -> Column:
    """The text, a null counting as empty."""
    return F.coalesce(F.col(column), F.lit(""))


#: What workers keep from task to task; emptied when a worker gets its first task of another stage.
_kept: list[Callable[[], None]] = []
_stage: list[int | None] = [None]


def keep_for_stage(empty: Callable[[], None]) -> None:
    """Register what empties a store that the tasks of one stage share in a worker."""
    _kept.append(empty)


def _begin() -> None:
    context = TaskContext.get()
    stage = context.stageId() if context else None
    if stage != _stage[0]:
        for empty in _kept:
            empty()
        _stage[0] = stage


def _end() -> None:
    """Give memory back to the system: workers stay, and wait, after their tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def blocks(batches: Iterator[pa.RecordBatch] | list[pa.RecordBatch], column: str, limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose texts hold at most `limit` bytes, or a single text."""
    _begin()
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes)
        start = 0
        while start < batch.num_rows:
            before = int(ends[start - 1]) if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, "right")))
            yield batch.slice(start, stop - start)
            start = stop
    if not isinstance(batches, list):  # the batches of a task, not a part of them
        _end()


def utf8(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts together, and where each begins (one more entry for the end)."""
    array = pc.fill_null(array.cast(pa.large_string()), "")
    _, offsets, data = array.buffers()
    at = np.frombuffer(offsets, np.int64, len(array) + 1, array.offset * 8)
    if data is None or not data.size:
        return np.zeros(0, np.uint8), at - at[0]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def code_points(array: pa.Array, gap: int) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, each followed by one `gap`; where each text begins, and the end."""
    data, at = utf8(array)
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    leads = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    starts = leads[at]
    return np.insert(points, starts[1:], np.uint32(gap)), starts + np.arange(len(starts))


_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _no_powers() -> None:
    _powers[:] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


keep_for_stage(_no_powers)


def _power_tables(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, BLOCK_BYTES + 1)
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps)
    return _powers


def mix(values: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit values over the whole word (a bijection)."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def range_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of values[start:end] for every range, equal for equal content and length."""
    power, inverse = _power_tables(len(values) + 1)
    sums = np.empty(len(values) + 1, np.uint64)
    sums[0] = 0
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * power[: len(values)], out=sums[1:])
    hashes = (sums[ends] - sums[starts]) * inverse[starts]
    return mix(hashes ^ mix((ends - starts).astype(np.uint64)))


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def words(data: np.ndarray, at: np.ndarray, gap: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte ranges of the words (maximal runs without a byte of `gap`; by default [^\\x20\\x09-\\x0D]+), and the index
    of each text's first word (and the end)."""
    solid = ~gap[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    before = np.concatenate(([False], solid[:-1])) if len(solid) else solid
    starts = np.flatnonzero(solid & (~before | edge[:-1]))
    after = np.concatenate((solid[1:], [False])) if len(solid) else solid
    ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, at)


def window_starts(first: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """First words of all windows of `length` words inside one text, and the text of each."""
    counts = np.maximum(np.diff(first) - length + 1, 0)
    owner = np.repeat(np.arange(len(counts)), counts)
    inside = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    return first[:-1][owner] + inside, owner


def repeated(keys: np.ndarray) -> np.ndarray:
    """Which keys occur more than once."""
    ordered = np.sort(keys)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return np.zeros(len(keys), bool)
    twice = twice[np.concatenate(([True], twice[1:] != twice[:-1]))]
    slot = np.minimum(np.searchsorted(twice, keys), len(twice) - 1)
    return twice[slot] == keys


def ragged_take(flat: np.ndarray, offsets: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows `index` of a ragged table, end to end, and where each begins (and the end)."""
    begins = offsets[index]
    lengths = offsets[index + 1] - begins
    at = np.concatenate(([0], np.cumsum(lengths)))
    where = np.arange(at[-1]) + np.repeat(begins - at[:-1], lengths)
    return flat[where], at


# ---- words of byte-pair tokenizers -------------------------------------------------------------

LETTER, NUMBER, OTHER, BLANK, GAP_CLASS = range(5)
#: Not a character, so no text holds it; stands between texts.
GAP = 0xD800


#: Ranges that Unicode 16.0 added, which Python's own table may not know yet.
_UNICODE_16 = (
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D40, 0x10D8F), (0x10EC2, 0x10EC4), (0x11380, 0x113E2),
    (0x116D0, 0x116E3), (0x11BC0, 0x11BF9), (0x13460, 0x143FA), (0x16100, 0x16139), (0x16D40, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5D0, 0x1E5FF),
)


@lru_cache(1)
def _classes() -> np.ndarray:
    """The kind of every code point, by Unicode's general category; White_Space is as the standard lists it."""
    kinds = {"L": LETTER, "N": NUMBER}
    found = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    for first, last in _UNICODE_16:
        for c in range(first, last + 1):
            found[c] = LETTER if regex.match(r"\p{L}", chr(c)) else NUMBER if regex.match(r"\p{N}", chr(c)) else OTHER
    found[[*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = BLANK
    found[GAP] = GAP_CLASS
    return found


keep_for_stage(_classes.cache_clear)


def _contractions(points: np.ndarray, kinds: np.ndarray, begins: np.ndarray) -> None:
    """An apostrophe that begins a word takes s, t, m, d, re, ve or ll after it."""
    found = np.flatnonzero((points == 0x27) & begins & (kinds == OTHER))
    found = found[kinds[found + 1] == LETTER]
    one, two = points[found + 1], points[np.minimum(found + 2, len(points) - 1)]
    single = np.isin(one, [ord(x) for x in "stmd"])
    double = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
    for which, length in ((single, 1), (double, 2)):
        at = found[which]
        begins[at + 1] = False
        rest = at[kinds[at + 1 + length] == LETTER] + 1 + length
        begins[rest] = True


def spaced_words(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranges of the matches of the byte-level pattern (a single space belongs to the word after it).

    `points` ends with GAP. The matches cover every code point but the gaps.
    """
    kinds = _classes()[points]
    begins = np.concatenate(([True], kinds[1:] != kinds[:-1]))
    last_blank = np.flatnonzero((kinds[:-1] == BLANK) & (kinds[1:] < BLANK))
    begins[last_blank] = True
    begins[last_blank[points[last_blank] == 0x20] + 1] = False
    gaps = kinds == GAP_CLASS
    begins |= gaps
    _contractions(points, kinds, begins)
    starts = np.flatnonzero(begins)
    ends = np.append(starts[1:], len(points))
    keep = ~gaps[starts]
    return starts[keep], ends[keep]


def bare_words(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranges of letter runs, single digits, runs of other characters and contractions; blanks fall away."""
    kinds = _classes()[points]
    begins = np.concatenate(([True], kinds[1:] != kinds[:-1])) | (kinds == NUMBER) | (kinds == GAP_CLASS)
    _contractions(points, kinds, begins)
    starts = np.flatnonzero(begins)
    ends = np.append(starts[1:], len(points))
    keep = kinds[starts] < BLANK
    return starts[keep], ends[keep]


class _Growing:
    """An array with room at its end."""

    def __init__(self, kind, first=()):
        self.data, self.size = np.array(first, kind), len(first)

    def extend(self, values: np.ndarray) -> None:
        end = self.size + len(values)
        if end > len(self.data):
            self.data = np.concatenate((self.data[: self.size], np.empty(max(end, 1 << 16), self.data.dtype)))
        self.data[self.size : end] = values
        self.size = end


class WordIds:
    """Token ids of words, computed once for each distinct word a worker meets.

    `encode_words` gives the ids of all words of a list end to end, and the number of each word's. The store is emptied when it holds more than `most` words, which costs time, never results.
    """

    def __init__(self, encode_words, most: int = 500_000):
        self.encode_words, self.most = encode_words, most
        self._clear()

    def _clear(self):
        self.slots: dict[int, int] = {}
        self.flat, self.offsets = _Growing(np.uint32), _Growing(np.int64, [0])

    def ids(self, points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words end to end, and where each word's begin (and the end)."""
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(1, np.int64)
        if len(self.slots) > self.most:
            self._clear()
        distinct, first, inverse = np.unique(range_hashes(points, starts, ends), return_index=True, return_inverse=True)
        keys = distinct.tolist()
        found = list(map(self.slots.get, keys))
        fresh = [i for i, slot in enumerate(found) if slot is None]
        if fresh:
            everything = points.tobytes().decode("utf-32-le", "surrogatepass")
            spans = zip(starts[first[fresh]].tolist(), ends[first[fresh]].tolist())
            encoded, lengths = self.encode_words([everything[a:b] for a, b in spans])
            for slot, i in enumerate(fresh, len(self.slots)):
                found[i] = self.slots[keys[i]] = slot
            self.offsets.extend(self.flat.size + np.cumsum(lengths))
            self.flat.extend(encoded)
        # The rows of this block's distinct words first, so that the large store is read once.
        small, at = ragged_take(self.flat.data, self.offsets.data, np.array(found, np.int64))
        return ragged_take(small, at, inverse)


def id_lists(ids: np.ndarray, at: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.astype(np.int32)))
