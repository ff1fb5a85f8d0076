"""Packing token streams into sequences by an order-preserving dynamic programme.

Every task lays its documents end to end, in the order it reads them, and cuts the stream into windows
of at most `length` ids. A window costs its padding (none when its length is a power of two, otherwise
up to `length`) and a penalty by the place of its end: nothing at the end of a document, a little at the
end of a sentence or line, more elsewhere. With f(j) the least cost of a cut at j,

    f(j) = penalty(j) + min( min over j - length <= i < j of f(i) + length - (j - i),  min over 2^k of f(j - 2^k) )

The first minimum is that of f(i) + i over a sliding window: a monotone queue gives it in constant time.
Candidates for cuts are all ends of documents and sentences, places `stride` ids apart inside longer
sentences, and every place near the end of a stream, so its rest can be split into powers of two.

A stream is closed when it holds `stream_ids` ids, which bounds memory by that and the longest document.
Sequences never span two streams. Null and empty texts have the end id only. Repeated rows are packed
once per row. An empty table gives no pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesforge.llm import text as tx
from seriesforge.llm import tokens


#: Texts are encoded in parts of a block: the arrays beside a part take many times its bytes. Streams end with blocks.
PART_BYTES = 250_000


@dataclass(frozen=True)
class Packing:
    length: int = 2048
    end_id: int = 1
    sentence_penalty: float = 2.0
    cut_penalty: float = 24.0
    stride: int = 128
    stream_ids: int = 1_000_000


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def candidates(ends: np.ndarray, stops: np.ndarray, rule: Packing) -> tuple[np.ndarray, np.ndarray]:
    """Sorted places for cuts, from 0 to the end of the stream, and the penalty of each."""
    total = int(ends[-1])
    natural = np.unique(np.concatenate(([0], ends, stops)))
    gaps = np.diff(natural)
    stride = min(rule.stride, rule.length)
    extra = (gaps - 1) // stride
    inside = np.arange(extra.sum()) - np.repeat(np.cumsum(extra) - extra, extra)
    filler = np.repeat(natural[:-1], extra) + (inside + 1) * stride
    tail = np.arange(max(0, total - rule.length), total)
    places = np.unique(np.concatenate((natural, filler, tail)))
    cost = np.full(len(places), rule.cut_penalty)
    cost[np.searchsorted(places, stops)] = rule.sentence_penalty
    cost[np.searchsorted(places, ends)] = 0
    return places, cost


def _shortcuts(places: np.ndarray, length: int) -> tuple[list[int], list[int]]:
    """Origins of the windows whose length is a power of two, and where those that end at each place begin (and the end)."""
    to, origin, power = [], [], 1
    while power <= length:
        found = np.searchsorted(places, places - power)
        j = np.flatnonzero(places[found] == places - power)
        to.append(j)
        origin.append(found[j])
        power *= 2
    to, origin = np.concatenate(to), np.concatenate(origin)
    return origin[np.argsort(to, kind="stable")].tolist(), np.concatenate(([0], np.cumsum(np.bincount(to, minlength=len(places))))).tolist()


def cuts(places: np.ndarray, cost: np.ndarray, rule: Packing) -> np.ndarray:
    """The cheapest cuts, the first and last place included."""
    origins, begin = _shortcuts(places, rule.length)
    at, penalty, length = places.tolist(), cost.tolist(), rule.length
    best, back = [0.0] * len(at), [0] * len(at)
    # The queue: cuts i in `queue[head:]`, with keys f(i) + place that rise.
    queue, keys, head = [0], [0.0], 0
    for j in range(1, len(at)):
        here = at[j]
        least = here - length
        while at[queue[head]] < least:
            head += 1
        origin = queue[head]
        value = keys[head] - least
        low, high = begin[j], begin[j + 1]
        if low < high:
            for i in origins[low:high]:
                if best[i] < value:
                    value, origin = best[i], i
        value += penalty[j]
        best[j], back[j] = value, origin
        key = value + here
        while len(queue) > head and keys[-1] >= key:
            queue.pop()
            keys.pop()
        queue.append(j)
        keys.append(key)
    path = [len(at) - 1]
    while path[-1]:
        path.append(back[path[-1]])
    return places[path[::-1]]


class _Stream:
    def __init__(self):
        self.docs, self.ids, self.ends, self.stops, self.size = [], [], [], [], 0

    def add(self, docs, ids, at, stops):
        self.docs += docs
        self.ids.append(ids)
        self.ends.append(at[1:] + self.size)
        self.stops.append(stops + self.size)
        self.size += len(ids)

    def pieces(self, rule: Packing, sequence: int) -> tuple[pa.RecordBatch, int]:
        """One row per piece; sequence numbers begin at `sequence`. Also the next free number."""
        ids, ends = np.concatenate(self.ids), np.concatenate(self.ends)
        windows = cuts(*candidates(ends, np.concatenate(self.stops), rule), rule)
        bounds = np.unique(np.concatenate((windows, ends)))
        begin, stop = bounds[:-1], bounds[1:]
        owner = np.searchsorted(ends, begin, "right")
        doc_begin = np.concatenate(([0], ends[:-1]))
        window = np.searchsorted(windows, begin, "right") - 1
        view = memoryview(ids.astype("<u4")).cast("B")
        crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(begin.tolist(), stop.tolist())]
        columns = (
            pa.array([self.docs[i] for i in owner.tolist()], pa.int64()),
            *map(pa.array, (begin - doc_begin[owner], stop - begin, crc, (ends - doc_begin)[owner], sequence + window, begin - windows[window])),
        )
        return pa.RecordBatch.from_arrays([c.cast(pa.int64()) for c in columns], [f.split()[0] for f in PIECES.split(", ")]), sequence + len(windows) - 1


def pack(docs: DataFrame, tokenizer_path: str, doc_id: str = "doc_id", text: str = "text", rule: Packing = Packing()) -> DataFrame:
    """One row per piece of a document. A task numbers its sequences from its partition's own base."""
    content = docs.sparkSession.sparkContext.broadcast(tokens.file_text(tokenizer_path))  # the file has under 2 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = tokens.library(content.value)
        sequence = TaskContext.get().partitionId() << 40
        stream = _Stream()
        for block in tx.blocks(batches, "text"):
            for part in tx.blocks([block], "text", PART_BYTES):
                ids, at, stops = library.encode(part.column(1), sentences=True)
                shift = np.searchsorted(at[1:], stops, "left")  # end ids that stand before each stop
                ids, ends = tokens.with_end(ids, at, rule.end_id)
                stream.add(part.column(0).to_pylist(), ids, ends, stops + shift)
            if stream.size >= rule.stream_ids:
                batch, sequence = stream.pieces(rule, sequence)
                yield batch
                stream = _Stream()
        if stream.size:
            yield stream.pieces(rule, sequence)[0]

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, PIECES)
