"""Byte-level BPE by merge replay over the words of a whole block of the corpus.

Every distinct word is laid out once in one symbol list. An inverted index holds, for each adjacent
pair that a merge would join, the positions of that pair, under the id the merge makes. Merges are
replayed in rank order: the positions of the lowest rank are joined from left to right and only the
pairs that touch them are looked up anew. Words do not influence one another, so every Spark task
replays its own share of the corpus and no shuffle is needed.

Null texts count as empty and give no ids. Other columns, whatever their names, are kept unless a
new column takes the same name. Equal texts give equal ids; no length is special.
"""

from __future__ import annotations

import base64
import heapq
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriesforge.llm import text as tx
from seriesforge.llm.arrow import with_column

#: Symbols in one replay; bounds its memory. A longer single word is still replayed whole.
REPLAY_SYMBOLS = 400_000
_SHIFT = 24


class Merges:
    """Tokens by rank, and for each pair of ids the id that their merge makes."""

    def __init__(self, content: bytes):
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, content.splitlines())}
        self.single = [self.ranks[bytes([b])] for b in range(256)]
        self.pairs = {}
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                left, right = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if left is not None and right is not None:
                    self.pairs[left << _SHIFT | right] = rank
        tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            tokens[rank] = token
        self.tokens = pa.array(tokens, pa.large_binary())
        self.words = tx.WordIds(self.encode_words)

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        raw = [word.encode() for word in words]
        out = [[self.ranks[word]] if word in self.ranks else None for word in raw]
        group, size = [], 0
        for k, word in enumerate(raw):
            if out[k] is None:
                group.append(k)
                size += len(word)
            if group and (size >= REPLAY_SYMBOLS or k == len(raw) - 1):
                for i, ids in zip(group, self.replay([raw[i] for i in group])):
                    out[i] = ids
                group, size = [], 0
        lengths = np.fromiter(map(len, out), np.int64, len(out))
        return np.fromiter(chain.from_iterable(out), np.uint32, int(lengths.sum())), lengths

    def replay(self, words: list[bytes]) -> list[list[int]]:
        find, single = self.pairs.get, self.single
        symbols, after, before, index = [], [], [], {}
        for word in words:
            base, n = len(symbols), len(word)
            symbols += [single[b] for b in word]
            after += range(base + 1, base + n + 1)
            before += range(base - 1, base + n - 1)
            if n:
                after[-1] = before[base] = -1
            for i in range(base, base + n - 1):
                made = find(symbols[i] << _SHIFT | symbols[i + 1])
                if made is not None:
                    index.setdefault(made, []).append(i)
        waiting = list(index)
        heapq.heapify(waiting)
        while waiting:
            rank = heapq.heappop(waiting)
            positions = sorted(index.pop(rank))
            for done, i in enumerate(positions):
                j = after[i]
                left = symbols[i]
                if left < 0 or j < 0 or find(left << _SHIFT | symbols[j]) != rank:
                    continue  # a neighbour was merged away in the meantime
                k, p = after[j], before[i]
                symbols[i], symbols[j], after[i] = rank, -1, k
                best = rank
                if k >= 0:
                    before[k] = i
                    made = find(rank << _SHIFT | symbols[k])
                    if made is not None:
                        best = made if made < best else best
                        if made in index:
                            index[made].append(i)
                        else:
                            index[made] = [i]
                            heapq.heappush(waiting, made)
                if p >= 0:
                    made = find(symbols[p] << _SHIFT | rank)
                    if made is not None:
                        best = made if made < best else best
                        if made in index:
                            index[made].append(p)
                        else:
                            index[made] = [p]
                            heapq.heappush(waiting, made)
                if best < rank:  # a better merge appeared: it goes first, the rest of this rank waits
                    if rest := positions[done + 1 :]:
                        index[rank] = rest
                        heapq.heappush(waiting, rank)
                    break
        out, base = [], 0
        for word in words:
            end = base + len(word)
            out.append([s for s in symbols[base:end] if s >= 0])
            base = end
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and where each text's begin (and the end)."""
        points, at = tx.code_points(texts, tx.GAP)
        if not len(points):
            return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        starts, ends = tx.spaced_words(points)
        ids, word_at = self.words.ids(points, starts, ends)
        return ids, word_at[np.searchsorted(starts, at)]

    def decode(self, ids: pa.Array) -> pa.Array:
        """The bytes that each list of ids stands for."""
        ids = ids.fill_null([]) if ids.null_count else ids
        joined = self.tokens.take(ids.flatten())
        ends = np.frombuffer(joined.buffers()[1], np.int64, len(joined) + 1, joined.offset * 8)
        offsets = np.asarray(ids.offsets) - ids.offsets[0].as_py()
        at = np.ascontiguousarray(ends[offsets]) if len(joined) else np.zeros(len(ids) + 1, np.int64)
        return pa.Array.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer(at), joined.buffers()[2]])


@lru_cache(2)
def _merges(content: bytes) -> Merges:
    return Merges(content)


tx.keep_for_stage(_merges.cache_clear)


def _content(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


def encode(docs: DataFrame, ranks_path: str, text: str = "text", out: str = "ids") -> DataFrame:
    """`docs` with a column of token ids. The rank file (under 2 MB) is read by the driver and broadcast."""
    content = docs.sparkSession.sparkContext.broadcast(_content(ranks_path))
    return with_column(docs, text, out, T.ArrayType(T.IntegerType(), False), lambda texts: tx.id_lists(*_merges(content.value).encode(texts)))


def decode(encoded: DataFrame, ranks_path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """`encoded` with the bytes its ids stand for; a null list decodes to no bytes."""
    content = encoded.sparkSession.sparkContext.broadcast(_content(ranks_path))
    return with_column(encoded, ids, out, T.BinaryType(), lambda lists: _merges(content.value).decode(lists).cast(pa.binary()))


def digests(decoded: DataFrame) -> DataFrame:
    """Counts and SHA-256 digests of columns `ids` and `decoded`."""
    joined = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return decoded.select(
        *[c for c in decoded.columns if c not in ("ids", "decoded")],
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(joined, 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
