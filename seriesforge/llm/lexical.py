"""Ranked lexical search by presence masks.

Documents are packed into blocks of bounded size, each with an inverted index of the terms that the items ask for.
Statistics of all documents (N, L, and the documents of each term) come from the blocks' sums. For an item, a block

1. sets bit j in the mask of every document that holds the item's term j, one bitmap operation per list of postings;
2. groups documents by mask. No document of a mask scores more than the sum, over the terms of the mask, of the
   term's weight, repeats and greatest count part in the block;
3. takes the masks by descending maximum, scores their documents, and stops when `k` documents score more than the
   next mask's maximum. Scores of blocks before it in the same task count too.

Tasks hand on k documents per item, and a window ranks them. Postings never leave their block; only the items' terms
are sent out, in chunks of at most `CHUNK_TERMS` terms, and each chunk passes over the blocks of its own.

A term is a maximal run of anything but ASCII characters other than letters and digits, with A-Z lower-cased. It is
named by a 64-bit hash, and a document's index keeps those of the items only. A score is the sum of
w * ((1000000000 * tf) div (1000 * tf + 8 * m)) with w = floor(1000 * ln((2 * N + 2) / (2 * df + 1))) and
m = 25 + (75 * n * N) div L, in 64-bit whole numbers.

Null or empty texts have no terms, are no documents of the statistics and are never found; items without terms find
nothing. Repeated rows are documents, and items, of their own. Ties go to the smaller doc_id, a null id before all
others. A very long text is a block of its own. Other columns are not read. Empty tables give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seriesforge.llm import text as tx
from seriesforge.sources import staging

#: Terms of items in one pass (16 MB of broadcast), and documents and postings of one block of the index.
CHUNK_TERMS, BLOCK_DOCS, BLOCK_POSTINGS = 1_000_000, 65_536, 1_500_000
#: Documents scored at once, at least, while masks are taken one after another.
STEP = 256
NO_ID = -(1 << 63)

_GAP = np.ones(256, bool)
_GAP[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Term hashes of all texts end to end, and where each text's begin (and the end)."""
    data, at = tx.utf8(texts)
    data = _LOWER[data]
    starts, ends, first = tx.words(data, at, _GAP)
    return tx.range_hashes(data, starts, ends).view(np.int64), first


# ---- items -------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Items:
    """Items of one pass: their ids (None for null), and their distinct terms with repeats, as places in `vocabulary`."""

    ids: list
    vocabulary: np.ndarray  # sorted hashes
    at: np.ndarray  # where each item's terms begin (and the end)
    term: np.ndarray
    repeats: np.ndarray


def read_items(rows: list) -> Items:
    found, first = terms(pa.array([r[1] for r in rows], pa.string()))
    at, parts = [0], []
    for a, b in zip(first, first[1:]):
        parts.append(np.unique(found[a:b], return_counts=True))
        at.append(at[-1] + len(parts[-1][0]))
    names = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, np.int64)
    vocabulary, term = np.unique(names, return_inverse=True)
    repeats = np.concatenate([p[1] for p in parts]) if parts else np.zeros(0, np.int64)
    return Items([r[0] for r in rows], vocabulary, np.array(at), term, repeats.astype(np.int64))


# ---- blocks ------------------------------------------------------------------------------------

BLOCK = "n_docs long, n_terms long, doc_ids binary, lengths binary, held binary, begins binary, docs binary, counts binary"
_FIELDS = [field.split()[0] for field in BLOCK.split(", ")]


def _packed(kept: list) -> pa.RecordBatch:
    """One block as a row: documents with terms, and postings by term (its number in the vocabulary)."""
    ids, lengths, term, doc, count, base = [], [], [], [], [], 0
    for own_ids, own_lengths, own_term, own_doc, own_count in kept:
        ids.append(own_ids)
        lengths.append(own_lengths)
        term.append(own_term)
        doc.append(own_doc + base)
        count.append(own_count)
        base += len(own_ids)
    ids, lengths, term, doc, count = (np.concatenate(x) for x in (ids, lengths, term, doc, count))
    order = np.lexsort((doc, term))
    term, doc, count = term[order], doc[order], count[order]
    held, begins = np.unique(term, return_index=True)
    blobs = (ids, lengths.astype(np.int64), held.astype(np.int32), np.append(begins, len(term)).astype(np.int64), doc.astype(np.int32), count.astype(np.int32))
    columns = [pa.array([base], pa.int64()), pa.array([int(lengths.sum())], pa.int64()), *(pa.array([x.tobytes()], pa.binary()) for x in blobs)]
    return pa.RecordBatch.from_arrays(columns, _FIELDS)


def index(docs: DataFrame, vocabulary, doc_id: str, text: str) -> DataFrame:
    """The packed blocks; `vocabulary` is a broadcast of sorted term hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, kept, n_docs, n_postings = vocabulary.value, [], 0, 0
        for block in tx.blocks(batches, "text"):
            found, first = terms(block.column(1))
            sizes = np.diff(first)
            filled = np.flatnonzero(sizes)
            if not len(filled):
                continue
            number = np.cumsum(sizes > 0) - 1
            owner = np.repeat(number, sizes)
            slot = np.minimum(np.searchsorted(known, found), max(len(known) - 1, 0))
            mine = known[slot] == found if len(known) else np.zeros(len(found), bool)
            pair, count = np.unique(owner[mine] * np.int64(len(known)) + slot[mine], return_counts=True)
            ids = block.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False).astype(np.int64)[filled]
            kept.append((ids, sizes[filled], pair % max(len(known), 1), pair // max(len(known), 1), count))
            n_docs, n_postings = n_docs + len(filled), n_postings + len(pair)
            if n_docs >= BLOCK_DOCS or n_postings >= BLOCK_POSTINGS:
                yield _packed(kept)
                kept, n_docs, n_postings = [], 0, 0
        if kept:
            yield _packed(kept)

    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return rows.mapInArrow(run, BLOCK)


def frequencies(blocks: DataFrame) -> DataFrame:
    """(term, df): documents of each term, by its number in the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for held, begins in zip(batch.column(0), batch.column(1)):
                found = np.frombuffer(held.as_py(), np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(np.diff(np.frombuffer(begins.as_py(), np.int64)))], ["term", "df"])

    return blocks.select("held", "begins").mapInArrow(run, "term int, df long").groupBy("term").agg(F.sum("df").alias("df"))


# ---- search ------------------------------------------------------------------------------------


def groups(masks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows of a (documents, words of 64 bits) table, and the group of each document."""
    if masks.shape[1] == 1:
        found, inverse = np.unique(masks[:, 0], return_inverse=True)
        return found[:, None], inverse
    order = np.lexsort(masks.T)
    new = np.concatenate(([True], (masks[order[1:]] != masks[order[:-1]]).any(1)))
    inverse = np.empty(len(masks), np.int64)
    inverse[order] = np.cumsum(new) - 1
    return masks[order[new]], inverse


def best(postings: list, weights: np.ndarray, n_docs: int, k: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents of a block with the k highest scores above 0 (all that tie with the last), and their scores.

    `postings` has (documents, count parts) of each term of the item; documents that score less than `floor` may be missing.
    """
    masks = np.zeros((n_docs, (len(postings) + 63) // 64), np.uint64)
    greatest = np.zeros(len(postings), np.int64)
    for j, (docs, parts) in enumerate(postings):
        masks[docs, j // 64] |= np.uint64(1) << np.uint64(j % 64)
        greatest[j] = weights[j] * parts.max(initial=0)
    touched = np.flatnonzero(masks.any(1))
    if not len(touched):
        return touched, touched
    distinct, group = groups(masks[touched])
    limit = np.zeros(len(distinct), np.int64)
    for j in range(len(postings)):
        limit += np.where(distinct[:, j // 64] >> np.uint64(j % 64) & np.uint64(1), greatest[j], 0).astype(np.int64)
    order = np.argsort(-limit, kind="stable")  # masks by descending maximum
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    by_mask = np.argsort(rank[group], kind="stable")
    ends = np.cumsum(np.bincount(rank[group], minlength=len(order)))
    limit = limit[order]
    found, scores, mask, taken = np.zeros(0, np.int64), np.zeros(0, np.int64), 0, 0
    while mask < len(order) and limit[mask] > 0 and limit[mask] >= floor:
        until = min(int(np.searchsorted(ends, taken + STEP)) + 1, len(order))  # whole masks
        until = min(until, max(mask + 1, int(np.searchsorted(-limit, -max(floor, 1), "right"))))
        docs = np.sort(touched[by_mask[taken : ends[until - 1]]])
        total = np.zeros(len(docs), np.int64)
        for (held, parts), weight in zip(postings, weights):
            at = np.minimum(np.searchsorted(held, docs), len(held) - 1)
            total += np.where(held[at] == docs, weight * parts[at], 0)
        found, scores = np.concatenate((found, docs)), np.concatenate((scores, total))
        if len(scores) > k:
            least = np.partition(scores, len(scores) - k)[len(scores) - k]
            found, scores = found[scores >= least], scores[scores >= least]
            floor = max(floor, int(least))
        mask, taken = until, int(ends[until - 1])
    keep = (scores > 0) & (scores >= floor)
    return found[keep], scores[keep]


class _Block:
    def __init__(self, row: dict):
        self.ids, self.lengths, self.begins = (np.frombuffer(row[c], np.int64) for c in ("doc_ids", "lengths", "begins"))
        self.held, self.docs, self.counts = (np.frombuffer(row[c], np.int32) for c in ("held", "docs", "counts"))

    def parts(self, n_all: int, length_all: int) -> np.ndarray:
        """(1000000000 * tf) div (1000 * tf + 8 * m) of every posting."""
        m = 25 + 75 * self.lengths * n_all // length_all
        tf = self.counts.astype(np.int64)
        return 1_000_000_000 * tf // (1000 * tf + 8 * m[self.docs])


def rank(docs: DataFrame, items: DataFrame, k: int = 10, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", chunk_terms: int = CHUNK_TERMS) -> DataFrame:
    """The k highest-scoring documents of every item: item_id, rank, doc_id, score."""
    asked = items.select(F.col(f"`{item_id}`").cast("long").alias("item_id"), F.col(f"`{item_text}`").alias("text"))
    asked = staging.stage(asked.withColumn("bytes", F.coalesce(F.octet_length("text"), F.lit(0))), "items")
    # A term has a byte and a gap at least, so `chunk_terms` holds; only a chunk at a time is with the driver.
    chunks = max(1, math.ceil((asked.agg(F.sum("bytes")).first()[0] or 0) / chunk_terms))
    chunk = F.pmod(F.xxhash64("item_id", "text"), F.lit(chunks))
    found = None
    for number in range(chunks):
        part = _pass(docs, read_items(asked.where(chunk == number).select("item_id", "text").collect()), k, doc_id, text)
        found = part if found is None else found.union(part)
    return found


def _pass(docs: DataFrame, items: Items, k: int, doc_id: str, text: str) -> DataFrame:
    spark = docs.sparkSession
    context = spark.sparkContext
    blocks = staging.stage(index(docs, context.broadcast(items.vocabulary), doc_id, text), "term-blocks")
    totals = blocks.agg(F.sum("n_docs").alias("n"), F.sum("n_terms").alias("l")).first()
    n_all, length_all = totals["n"] or 0, totals["l"] or 0
    df = np.zeros(len(items.vocabulary), np.int64)
    for row in frequencies(blocks).collect():  # a row per term of the pass
        df[row["term"]] = row["df"]
    weight = np.array([math.floor(1000 * math.log((2 * n_all + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
    sent = context.broadcast((items, weight))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, weights = sent.value
        held: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(asked.ids)
        for batch in batches:
            for i in range(batch.num_rows):
                block = _Block({name: batch.column(name)[i].as_py() for name in batch.schema.names})
                parts = block.parts(n_all, length_all)
                slot = np.full(len(weights) + 1, -1)
                slot[block.held] = np.arange(len(block.held))
                for item in range(len(asked.ids)):
                    own = slice(asked.at[item], asked.at[item + 1])
                    there = slot[asked.term[own]]
                    use = np.flatnonzero((there >= 0) & (weights[asked.term[own]] > 0))
                    lists = [slice(block.begins[s], block.begins[s + 1]) for s in there[use].tolist()]
                    ids, scores = held[item]
                    least = int(scores[-1]) if len(scores) >= k else 0
                    pulls = (weights[asked.term[own]] * asked.repeats[own])[use]
                    docs_, fresh = best([(block.docs[x], parts[x]) for x in lists], pulls, len(block.ids), k, least)
                    if len(docs_):
                        ids, scores = np.concatenate((ids, block.ids[docs_])), np.concatenate((scores, fresh))
                        order = np.lexsort((ids, -scores))[:k]
                        held[item] = ids[order], scores[order]
        sizes = [len(ids) for ids, _ in held]
        if sum(sizes):
            numbers = np.repeat(np.arange(len(sizes)), sizes)
            ids, scores = (np.concatenate([h[x] for h in held]) for x in (0, 1))
            columns = [pa.array(numbers, pa.int64()), pa.array([asked.ids[n] for n in numbers.tolist()], pa.int64()), pa.array(ids), pa.array(scores)]
            yield pa.RecordBatch.from_arrays(columns, ["number", "item_id", "doc_id", "score"])

    found = blocks.mapInArrow(run, "number long, item_id long, doc_id long, score long")
    place = F.row_number().over(Window.partitionBy("number").orderBy(F.desc("score"), "doc_id")).cast("int")
    ranked = found.withColumn("rank", place).where(F.col("rank") <= k)
    return ranked.select("item_id", "rank", F.nullif("doc_id", F.lit(NO_ID)).alias("doc_id"), "score")
