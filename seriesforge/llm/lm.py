"""Cross-entropy difference of two matched word-bigram models.

The target model counts chosen documents, the background model all of them. Both share one vocabulary, order,
smoothing and weights, so their losses compare token by token (V: different words, and one for words not seen):

    p(w | v) = MIX * c(v w) / c(v) + (1 - MIX) * (c(w) + ADD) / (N + ADD * V)

with the score of a document the mean of target loss minus background loss (nats a token; lower is more like
the target). Counts cover all documents and are kept by word and bigram (62-bit hashes, taken as equal content), so
they grow with the corpus.

Texts are taken in chunks of bounded size. One shuffle brings the counts of every chunk, as sorted packed arrays, to
the range of hashes they belong to. A range adds them up and answers a chunk only for the words and bigrams that
other chunks hold too: without an answer, the chunk's own count is the whole count. A chunk meets its answers and
scores its texts.

A null or empty text has no tokens and null losses. Repeated rows count and are scored once per row. A very long text
is a chunk of its own. Other columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesforge.llm import text as tx
from seriesforge.sources import staging

MIX, ADD = 0.6, 0.5
#: Text that is scored together, and text whose words and bigrams fill one range of hashes.
CHUNK_BYTES, RANGE_BYTES = 8_000_000, 4_000_000

_WORD, _PAIR = np.uint64(0), np.uint64(1)


def grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes of all texts end to end, hashes of the bigrams they end, whether a word has one before it, text starts."""
    data, at = tx.utf8(texts)
    starts, ends, first = tx.words(data, at)
    words = tx.range_hashes(data, starts, ends)
    pairs, follows = np.zeros(len(words), np.uint64), np.ones(len(words), bool)
    follows[first[:-1][first[:-1] < len(words)]] = False
    if len(words) > 1:
        pairs[1:] = tx.mix(words[:-1] ^ tx.mix(words[1:] + np.uint64(1)))
    return words.view(np.int64), pairs.view(np.int64), follows, first


# ---- packed arrays -----------------------------------------------------------------------------


def squeeze(*columns: np.ndarray) -> bytes:
    """Arrays of unsigned numbers, each without the bytes that are 0 in all its numbers, compressed."""
    planes = []
    for values in columns:
        raw = np.ascontiguousarray(values, "<u8").view(np.uint8).reshape(-1, 8)
        used = (int(values.max(initial=0)).bit_length() + 7) // 8
        planes.append(raw[:, :used].T.tobytes())
    sizes = np.array([x for values, p in zip(columns, planes) for x in (len(values), len(p))], "<i8").tobytes()
    whole = b"".join((sizes, *planes))
    return len(columns).to_bytes(8, "little") + len(whole).to_bytes(8, "little") + pa.compress(whole, "zstd", asbytes=True)


def unsqueeze(blob: bytes) -> list[np.ndarray]:
    count, size = (int.from_bytes(blob[i : i + 8], "little") for i in (0, 8))
    whole = pa.decompress(blob[16:], size, "zstd", asbytes=True)
    out, at = [], 16 * count
    for n, length in np.frombuffer(whole, "<i8", 2 * count).reshape(-1, 2).tolist():
        raw = np.zeros((n, 8), np.uint8)
        if length:
            raw[:, : length // n] = np.frombuffer(whole, np.uint8, length, at).reshape(-1, n).T
        out.append(raw.view("<u8").ravel())
        at += length
    return out


def _edges(ranges: int) -> np.ndarray:
    """Where each range of 63-bit names begins, and the end."""
    return np.array([(r << 63) // ranges for r in range(ranges + 1)], np.uint64)


# ---- chunks ------------------------------------------------------------------------------------

CHUNK = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("target", pa.bool_()), ("counted", pa.bool_())])


def _chunks(rows: DataFrame) -> DataFrame:
    """(chunk, bytes, blob): rows of (doc_id, text, target, counted), packed. Chunks are named by task, so the table is to be stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, taken, chunk = [], 0, TaskContext.get().partitionId() << 32

        def out() -> pa.RecordBatch:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, CHUNK, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))) as stream:
                stream.write_table(pa.Table.from_batches(held).combine_chunks().cast(CHUNK))
            return pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([taken], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["chunk", "bytes", "blob"])

        for block in tx.blocks(batches, "text"):
            if held and taken + block.nbytes > CHUNK_BYTES:
                yield out()
                held, taken, chunk = [], 0, chunk + 1
            held.append(block)
            taken += block.nbytes
        if held:
            yield out()

    return rows.mapInArrow(run, "chunk long, bytes long, blob binary")


@dataclass
class _Counted:
    """The tokens of a chunk, its distinct words and bigrams in order, and their counts in the chunk."""

    doc_ids: pa.Array
    words: np.ndarray  # place of each token's word among the names
    pairs: np.ndarray  # place of the bigram that ends at each token that follows another
    follows: np.ndarray
    first: np.ndarray
    names: np.ndarray
    target: np.ndarray
    background: np.ndarray


def _counted(blob: bytes) -> _Counted:
    rows = pa.ipc.open_stream(blob).read_all().combine_chunks()
    doc_ids, texts, target, counted = (c.chunk(0) if c.num_chunks else pa.array([], c.type) for c in rows.columns)
    parts = [grams(block.column(0)) for block in tx.blocks([pa.RecordBatch.from_arrays([texts], ["text"])], "text")]
    words, pairs, follows = (np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, (np.int64, np.int64, bool)[k]) for k in range(3))
    sizes = np.concatenate([np.diff(p[3]) for p in parts]) if parts else np.zeros(0, np.int64)
    named = lambda hashes, kind: hashes.view(np.uint64) >> np.uint64(2) << np.uint64(1) | kind
    every = np.concatenate((named(words, _WORD), named(pairs[follows], _PAIR)))
    order = np.argsort(every)
    ordered = every[order]
    new = np.ones(len(every), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    place = np.empty(len(every), np.int64)
    place[order] = np.cumsum(new) - 1
    begins = np.flatnonzero(new)
    totals = []
    for flag in (target, counted):
        of_token = np.repeat(flag.fill_null(False).to_numpy(zero_copy_only=False), sizes)
        chosen = np.concatenate((of_token, of_token[follows]))[order]
        totals.append(np.add.reduceat(chosen, begins, dtype=np.int64) if len(begins) else np.zeros(0, np.int64))
    return _Counted(doc_ids, place[: len(words)], place[len(words) :], follows, np.concatenate(([0], np.cumsum(sizes))), ordered[begins], *totals)


def _parts(chunks: DataFrame, ranges: int) -> DataFrame:
    """(range, chunk, blob): names and counts of each chunk in each range of hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = _edges(ranges)
        for batch in batches:
            for chunk, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = _counted(blob.as_py())
                at = np.searchsorted(own.names, edges)
                filled = np.flatnonzero(np.diff(at))
                for low in range(0, len(filled), 1000):
                    some = filled[low : low + 1000].tolist()
                    blobs = []
                    for r in some:
                        part = slice(at[r], at[r + 1])
                        steps = np.diff(own.names[part], prepend=edges[r])
                        blobs.append(squeeze(steps, own.target[part], own.background[part]))
                    yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([chunk] * len(some), pa.int64()), pa.array(blobs, pa.binary())], ["range", "chunk", "blob"])

    return chunks.select("chunk", "blob").mapInArrow(run, "range int, chunk long, blob binary")


ANSWERS = "chunk long, range int, blob binary, words long, pairs long, target long, background long, target_pairs long, background_pairs long"
_ANSWER_TYPES = pa.schema([(f.split()[0], {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}[f.split()[1]]) for f in ANSWERS.split(", ")])


def _answered(ranges: int):
    """Of one range: an answer for each chunk that shares words or bigrams with others, and a row of sums (without chunk)."""

    def run(key, rows):
        number = key[0].as_py()
        start = np.uint64((number << 63) // ranges)
        names, target, background, sizes = [], [], [], []
        for blob in rows.column("blob"):
            steps, t, b = unsqueeze(blob.as_py())
            names.append(start + np.cumsum(steps, dtype=np.uint64))
            target.append(t.astype(np.int64))
            background.append(b.astype(np.int64))
            sizes.append(len(steps))
        names, target, background = (np.concatenate(x) for x in (names, target, background))
        order = np.argsort(names)
        ordered = names[order]
        new = np.ones(len(names), bool)
        new[1:] = ordered[1:] != ordered[:-1]
        begins, group = np.flatnonzero(new), np.cumsum(new) - 1
        sums = [np.add.reduceat(x[order], begins) for x in (target, background)]
        whole = []
        for total in sums:
            spread = np.empty(len(names), np.int64)
            spread[order] = total[group]
            whole.append(spread)
        others = (whole[0] != target) | (whole[1] != background)
        out, at = [], np.concatenate(([0], np.cumsum(sizes))).tolist()
        for chunk, low, high in zip(rows.column("chunk").to_pylist(), at, at[1:]):
            mark = others[low:high]
            if mark.any():
                blob = squeeze(np.packbits(mark).astype(np.uint64), whole[0][low:high][mark], whole[1][low:high][mark])
                out.append({"chunk": chunk, "range": number, "blob": blob})
        kind, seen = ordered[begins] & _PAIR, sums[1] > 0  # words of texts that are only scored are no vocabulary
        word, pair = kind == _WORD, kind == _PAIR
        out.append({"words": int((word & seen).sum()), "pairs": int((pair & seen).sum())} | {f"{name}{end}": int(total[which].sum()) for name, total in zip(("target", "background"), sums) for end, which in (("", word), ("_pairs", pair))})
        return pa.Table.from_pylist(out, schema=_ANSWER_TYPES)

    return run


# ---- models ------------------------------------------------------------------------------------


class Models:
    """Stored chunks, what other chunks add to their counts, and the sums of both models."""

    def __init__(self, chunks: DataFrame, answers: DataFrame, ranges: int):
        self.chunks, self.answers, self.ranges = chunks, answers.where("chunk is not null").select("chunk", "range", "blob"), ranges
        names = ("words", "target", "background", "target_pairs", "background_pairs")
        sums = answers.where("chunk is null").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names]).first()
        self.vocabulary = sums["words"] + 1
        self.totals = np.array([sums["target"], sums["background"]], np.float64)
        self.pairs = np.array([sums["target_pairs"], sums["background_pairs"]], np.float64)


def train(docs: DataFrame, target: Column, counted: Column | None = None, doc_id: str = "doc_id", text: str = "text") -> Models:
    """Models of the rows of `docs` that are counted (all, unless told otherwise); those with `target` make the target model."""
    counted = F.lit(True) if counted is None else F.coalesce(counted, F.lit(False))
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"), (F.coalesce(target, F.lit(False)) & counted).alias("target"), counted.alias("counted"))
    chunks = staging.stage(_chunks(rows), "chunks")
    ranges = max(1, math.ceil((chunks.agg(F.sum("bytes")).first()[0] or 0) / RANGE_BYTES))
    answers = _parts(chunks, ranges).groupBy("range").applyInArrow(_answered(ranges), ANSWERS)
    return Models(chunks, staging.stage(answers, "gram-answers"), ranges)


def losses(word: np.ndarray, before: np.ndarray, pair: np.ndarray, total: float, vocabulary: int) -> np.ndarray:
    """Negative log likelihood of every word, from the counts of it, of the word before (0: none) and of both."""
    single = (word + ADD) / (total + ADD * vocabulary)
    return -np.log(np.where(before > 0, MIX * pair / np.maximum(before, 1) + (1 - MIX) * single, single))


def score(models: Models) -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss and score of every row, counted or not."""
    totals, vocabulary, ranges = models.totals.tolist(), models.vocabulary, models.ranges
    names = ["doc_id", "n_tokens", "target_loss", "background_loss", "score"]

    def run(rows: pa.Table, answers: pa.Table) -> pa.Table:
        tables = []
        for blob in rows.column("blob"):  # one
            own = _counted(blob.as_py())
            counts = [own.target, own.background]
            at = np.searchsorted(own.names, _edges(ranges))
            for number, packed in zip(answers.column("range").to_pylist(), answers.column("blob")):
                marks, *found = unsqueeze(packed.as_py())
                low, high = at[number], at[number + 1]
                where = low + np.flatnonzero(np.unpackbits(marks.astype(np.uint8), count=high - low))
                for count, values in zip(counts, found):
                    count[where] = values
            n, means = np.diff(own.first), []
            for count, total in zip(counts, totals):
                word, pair = count[own.words].astype(np.float64), np.zeros(len(own.words))
                pair[own.follows] = count[own.pairs]
                before = np.where(own.follows, np.concatenate((word[:1], word[:-1])), 0)
                sums = np.concatenate(([0], np.cumsum(losses(word, before, pair, total, vocabulary))))
                means.append(np.diff(sums[own.first]) / np.maximum(n, 1))
            columns = [own.doc_ids, pa.array(n, pa.int64()), *(pa.array(m, mask=n == 0) for m in (*means, means[0] - means[1]))]
            tables.append(pa.Table.from_arrays(columns, names))
        return pa.concat_tables(tables) if tables else pa.Table.from_arrays([pa.array([], t) for t in (pa.int64(), pa.int64(), *[pa.float64()] * 3)], names)

    schema = "doc_id long, n_tokens long, target_loss double, background_loss double, score double"
    chunks = models.chunks.select("chunk", "blob")
    return chunks.groupBy("chunk").cogroup(models.answers.groupBy("chunk")).applyInArrow(run, schema)
