"""Best-fit packing whose bin counts are certified by lower bounds.

Every document's ids and one end id make a document of the packing; only one longer than a sequence is cut, into whole
sequences and a rest. A piece of full length is a sequence of its own. The others are dealt to partitions of about
`group` pieces, and each partition

1. packs its pieces by best fit, longest first;
2. bounds its number of sequences from below by dual feasible functions: functions u of a length with
   sum(u) <= 1 over any set of pieces that fits one sequence, so that sum(u) over all pieces is a lower bound;
3. is certified when its number is that bound. What it has above the bound, the part of a sequence that rounding up
   wastes included, is its gap: it opens its emptiest sequences, and those of the most pieces, a few for each one of the gap.

Pieces of opened sequences are dealt to new partitions, of up to `exchange` old ones each, which pack them again; so
rounds shrink until one partition is left, a round saves nothing (one that does worse is not taken), or the total is the bound of the whole table.
Sequences that stay closed are written once and not read again.

A piece has a key of its own (task and place), which alone decides its partition, so repeated rows do not meet in one
task. A null or empty text has the end id only. Repeated rows are packed once per row. A null doc_id stays null. Other
columns are not read. A very long text is one row of many pieces. An empty table gives no pieces.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesforge.llm import text as tx
from seriesforge.llm import tokens
from seriesforge.sources import staging


@dataclass(frozen=True)
class Repacking:
    length: int = 2048
    end_id: int = 0
    group: int = 20_000
    exchange: int = 64


PIECES = "key long, doc_id long, piece int, start long, length long, ids_crc32 long"
PLACED = f"{PIECES}, sequence_id long, offset long, open boolean"
_COLUMNS = [field.split()[0] for field in PLACED.split(", ")]


# ---- one partition ------------------------------------------------------------------------------


def best_fit(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """The sequence of every piece, taken in the order given: the fullest one it fits, else a new one."""
    room: list[list[int]] = [[] for _ in range(capacity + 1)]  # sequences by free space
    free = 0  # bit r: some sequence has r free
    out, count = [], 0
    for size in lengths.tolist():
        fits = free >> size
        if fits:
            left = size + (fits & -fits).bit_length() - 1
            chosen = room[left].pop()
            if not room[left]:
                free ^= 1 << left
        else:
            chosen, left, count = count, capacity, count + 1
        left -= size
        if left:
            if not room[left]:
                free |= 1 << left
            room[left].append(chosen)
        out.append(chosen)
    return np.array(out, np.int64)


def lower_bound(counts: np.ndarray) -> tuple[int, int]:
    """The best bound of a histogram (pieces of each length, the last the capacity) as a fraction, not rounded.

    Families, all in whole numbers: the share of a sequence; for each e, pieces longer than capacity - e as whole
    sequences and those shorter than e as nothing; for each k, lengths rounded to multiples of 1/k as
    floor((k + 1) x / capacity) / k, where (k + 1) x / capacity is no whole number.
    """
    capacity = len(counts) - 1
    x = np.arange(capacity + 1, dtype=np.int64)
    counts = counts.astype(np.int64)
    best = (int(counts @ x), capacity)
    up_to, weight = np.concatenate(([0], np.cumsum(counts))), np.concatenate(([0], np.cumsum(counts * x)))
    e = np.arange(1, capacity // 2 + 1)
    values = (up_to[-1] - up_to[capacity - e + 1]) * capacity + weight[capacity - e + 1] - weight[e]
    found = [best, (int(values.max(initial=0)), capacity)]
    for k in range(1, min(100, capacity) + 1):
        scaled = (k + 1) * x
        value = np.where(scaled % capacity == 0, k * x, scaled // capacity * capacity)
        found.append((int(counts @ value), k * capacity))
    return max(found, key=lambda f: f[0] / f[1])


def _rounded(bound: tuple[int, int]) -> int:
    return -(-bound[0] // bound[1])


def opened(fill: np.ndarray, held: np.ndarray, bound: tuple[int, int], capacity: int) -> np.ndarray:
    """Which sequences open, from their fill and pieces: eight for each one above the bound, rounded down.

    The emptiest of those not full, and as many of those with the most pieces, whose short pieces fill what is left.
    """
    many = 8 * max(len(fill) - bound[0] // bound[1], 0)
    out = np.zeros(len(fill), bool)
    emptiest = np.argsort(fill, kind="stable")[:many]
    out[emptiest] = fill[emptiest] < capacity
    if out.any():
        out[np.argsort(-held, kind="stable")[:many]] = True
    return out


def _offsets(bins: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by sequence, and the place of each piece (in that order) in its sequence."""
    order = np.argsort(bins, kind="stable")
    ends = np.cumsum(lengths[order])
    starts = ends - lengths[order]
    first = np.searchsorted(bins[order], bins[order])
    return order, starts - starts[first]


def _packer(rule: Repacking, turn: int, last: bool):
    return lambda name, rows: _pack_partition(rule, turn, last, name[0].as_py(), rows)


def _pack_partition(rule: Repacking, turn: int, last: bool, name: int, rows: pa.Table) -> pa.Table:
    lengths, keys = rows.column("length").to_numpy(), rows.column("key").to_numpy()
    by_length = np.lexsort((keys, -lengths))
    rows, lengths = rows.take(pa.array(by_length)), lengths[by_length]
    bins = best_fit(lengths, rule.length)
    again = np.zeros(bins.max() + 1, bool)
    if not last:
        fill = np.bincount(bins, lengths).astype(np.int64)
        again = opened(fill, np.bincount(bins), lower_bound(np.bincount(lengths, minlength=rule.length + 1)), rule.length)
    order, offsets = _offsets(bins, lengths)
    rows, bins = rows.take(pa.array(order)), bins[order]
    sequence = (turn << 58) + (name << 28) + bins
    columns = [rows.column(c) for c in _COLUMNS[:6]]
    return pa.Table.from_arrays([*columns, pa.array(sequence, pa.int64()), pa.array(offsets, pa.int64()), pa.array(again[bins])], _COLUMNS)


# ---- Spark -------------------------------------------------------------------------------------


def pieces(docs: DataFrame, tokenizer_path: str, rule: Repacking = Repacking(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece of a document, with a key of its own. Keys are given by task, so the table is to be stored."""
    content = docs.sparkSession.sparkContext.broadcast(tokens.file_text(tokenizer_path))  # the file has under 2 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = tokens.library(content.value)
        key = TaskContext.get().partitionId() << 36
        for block in tx.blocks(batches, "text"):
            ids, at = tokens.with_end(*library.encode(block.column(1))[:2], rule.end_id)
            sizes = np.diff(at)
            counts = -(-sizes // rule.length)
            owner = np.repeat(np.arange(len(counts)), counts)
            piece = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
            start = piece * rule.length
            length = np.minimum(sizes[owner] - start, rule.length)
            view, low = memoryview(ids.astype("<u4")).cast("B"), at[owner] + start
            crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(low.tolist(), (low + length).tolist())]
            columns = [pa.array(key + np.arange(len(owner))), block.column(0).take(pa.array(owner)), pa.array(piece, pa.int32()), *(pa.array(c, pa.int64()) for c in (start, length, crc))]
            yield pa.RecordBatch.from_arrays(columns, _COLUMNS[:6])
            key += len(owner)

    return docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text")).mapInArrow(run, PIECES)


def bound(parts: DataFrame, rule: Repacking = Repacking()) -> int:
    """No packing of these pieces has fewer sequences. The histogram has a row per length, at most `rule.length`."""
    counts = np.zeros(rule.length + 1, np.int64)
    for row in parts.groupBy("length").count().collect():
        counts[row["length"]] = row["count"]
    return _rounded(lower_bound(counts))


def _sequences(placed: DataFrame) -> int:
    return placed.where("offset = 0").count()


def place(parts: DataFrame, rule: Repacking = Repacking()) -> DataFrame:
    """The stored pieces with sequence_id and offset."""
    whole = parts.where(F.col("length") == rule.length).select("*", F.col("key").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    waiting, done = parts.where(F.col("length") < rule.length), [whole]
    count, least = waiting.count(), bound(waiting, rule)
    partitions, turn, settled, before, earlier = max(1, math.ceil(count / rule.group)), 1, 0, None, None
    while count:
        last = partitions == 1 or turn == 31
        dealt = F.pmod(F.xxhash64("key", F.lit(turn)), F.lit(partitions)).alias("name")
        packed = staging.stage(waiting.groupBy(dealt).applyInArrow(_packer(rule, turn, last), PLACED), f"packed-{turn}")
        found = _sequences(packed)
        # `before`: sequences that this round's pieces had before it. Nothing saved among as many partitions: the end.
        if before is not None and found > before[0]:
            return _union([*done, earlier])
        idle = before is not None and found == before[0] and partitions >= before[1]
        if last or idle or settled + found == least:
            return _union([*done, packed])
        waiting = staging.stage(packed.where("open").select(*_COLUMNS[:6]), f"opened-{turn}")
        earlier = packed.where("open")
        done.append(packed.where("not open"))
        count, kept = waiting.count(), _sequences(done[-1])
        settled, before = settled + kept, (found - kept, partitions)
        partitions, turn = max(math.ceil(partitions / rule.exchange), math.ceil(count / rule.group), 1), turn + 1
    return _union(done)


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.union, [p.select(*_COLUMNS[:8]) for p in parts])


def pack(docs: DataFrame, tokenizer_path: str, rule: Repacking = Repacking(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id and offset."""
    return place(staging.stage(pieces(docs, tokenizer_path, rule, doc_id, text), "pieces"), rule).drop("key")
