"""Near-copy join: five-word shingles with a Jaccard similarity of at least 0.8.

1. Copies. Every text gets a fingerprint of its words; rows of one fingerprint are one text, so the rest
   of the work sees each text once however many copies it has.
2. Candidates. 192 MinHash values give 32 band keys of six values; texts that share a key are a bucket. Buckets
   of the same members are taken once, and large ones are cut into blocks, so that every two members meet in one.
3. Pruning. A bucket's texts are searched from one to the next: MinHash values are compared in steps of 32, and
   after each step a pair is dropped when, by the posterior of its similarity under a uniform prior, reaching the
   threshold is less likely than `TOLERANCE`. What is reached is a cluster; only (text, least text reached) is kept.
4. Verification. Every two texts of a cluster are compared exactly, on their shingle sets, in blocks of bounded
   size. A block gives each text's number of links and its least linked text; pairs are never stored.

Two texts at the threshold share no bucket with probability 6e-5; they are still compared when a chain of other
texts joins them.

A class is a connected component of links. Words are runs of anything but ASCII blanks; a text of one to
four words has one shingle, all of it. A row without words is alone with its repeats. Fingerprints and
shingles are 64-bit hashes. A null id gets a stand-in made of the text's fingerprint. Other columns are kept
by `keep_one`. Empty tables give empty results.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriesforge.llm import text as tx
from seriesforge.sources import staging

SHINGLE, THRESHOLD = 5, 0.8
HASHES, ROWS, STEP = 192, 6, 32
TOLERANCE = 1e-6
#: So many pairs of numbers (32 MB) are broadcast at most; more of them are joined by a shuffle.
BROADCAST_IDS = 2_000_000

_random = np.random.default_rng(20240501)
_XOR = _random.integers(0, 1 << 32, HASHES, np.uint32)
_TIMES = _random.integers(0, 1 << 31, HASHES, np.uint32) * np.uint32(2) + np.uint32(1)
#: Texts of one side of a block of signatures, and texts and shingles of one side of a block of sets.
BLOCK_SIGNATURES, BLOCK_TEXTS, BLOCK_SHINGLES = 8192, 1000, 400_000
#: A shingle of more texts of a block is counted by a matrix product, a rarer one pair by pair.
FEW = 32


def shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingle hashes of all texts end to end (repeats included), where each text's begin, and fingerprints."""
    data, at = tx.utf8(texts)
    starts, ends, first = tx.words(data, at)
    words = tx.range_hashes(data, starts, ends)
    n = np.diff(first)
    counts = np.where(n >= SHINGLE, n - SHINGLE + 1, n > 0)
    begin = np.concatenate(([0], np.cumsum(counts)))
    low = np.repeat(first[:-1] - begin[:-1], counts) + np.arange(begin[-1])
    return tx.range_hashes(words, low, low + np.repeat(np.minimum(n, SHINGLE), counts)), begin, tx.range_hashes(words, first[:-1], first[1:])


def signatures(hashes: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """MinHash values, one row per text; all ones for a text without shingles."""
    out = np.full((len(begin) - 1, HASHES), 0xFFFFFFFF, np.uint32)
    filled = np.flatnonzero(np.diff(begin))
    if len(filled):
        low, at = (hashes >> np.uint64(32)).astype(np.uint32), begin[:-1][filled]
        for k in range(HASHES):
            value = (low ^ _XOR[k]) * _TIMES[k]
            value ^= value >> np.uint32(15)
            out[filled, k] = np.minimum.reduceat(value, at)
    return out


def band_keys(signed: np.ndarray) -> np.ndarray:
    """One 64-bit key per band and text."""
    bands = signed.reshape(len(signed), HASHES // ROWS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(HASHES // ROWS, dtype=np.uint64), bands.shape[:2])
    for k in range(ROWS):
        key = tx.mix(key ^ bands[:, :, k])
    return key


@cache
def least_matches() -> tuple[int, ...]:
    """After each step, the fewest matching values with which a pair stays."""
    found = []
    for n in range(STEP, HASHES + 1, STEP):
        # P(similarity >= t | m of n match) = P(Binomial(n + 1, t) <= m) for a uniform prior
        tail, m = 0.0, -1
        while tail < TOLERANCE:
            m += 1
            tail += math.comb(n + 1, m) * THRESHOLD**m * (1 - THRESHOLD) ** (n + 1 - m)
        found.append(m)
    return tuple(found)


def survivors(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Rows of two signature tables that survive every step."""
    alive, matches = np.arange(len(left)), np.zeros(len(left), np.int64)
    for k, least in enumerate(least_matches()):
        part = slice(k * STEP, (k + 1) * STEP)
        matches[alive] += (left[alive, part] == right[alive, part]).sum(1)
        alive = alive[matches[alive] >= least]
    return alive


def reach(signed: np.ndarray) -> np.ndarray:
    """For each signature, the first one that a chain of surviving pairs leads to."""
    root, left, queue = np.arange(len(signed)), np.arange(1, len(signed)), [0]
    while len(left):
        if not queue:
            queue, left = [int(left[0])], left[1:]
            continue
        pivot = queue.pop()
        hit = survivors(np.broadcast_to(signed[pivot], (len(left), HASHES)), signed[left])
        if len(hit):
            root[left[hit]] = root[pivot]
            queue += left[hit].tolist()
            left = np.delete(left, hit)
    return root


def common(sets: list[np.ndarray]) -> np.ndarray:
    """How many elements every two sets share."""
    n = len(sets)
    row = np.repeat(np.arange(n), [len(x) for x in sets])
    values = np.concatenate(sets) if n else np.zeros(0, np.uint64)
    order = np.argsort(values, kind="stable")
    row, values = row[order], values[order]
    starts = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1]))) if len(values) else np.zeros(0, np.int64)
    counts = np.diff(np.concatenate((starts, [len(values)])))
    column = np.repeat(np.arange(len(starts)), counts)
    held = np.repeat(counts, counts)
    out = np.zeros((n, n), np.int32)
    few = (held > 1) & (held <= FEW)
    rare, of = row[few], column[few]
    for d in range(1, min(FEW, len(rare))):
        same = of[d:] == of[:-d]
        if not same.any():
            break
        np.add.at(out, (rare[:-d][same], rare[d:][same]), 1)
    out += out.T
    many, of = row[held > FEW], column[held > FEW]
    _, of = np.unique(of, return_inverse=True)
    step = max(1, 4_000_000 // max(n, 1))
    for low in range(0, int(of.max(initial=-1)) + 1, step):
        first, last = np.searchsorted(of, (low, low + step))
        dense = np.zeros((n, step), np.float32)
        dense[many[first:last], of[first:last] - low] = 1
        out += (dense @ dense.T).astype(np.int32)
    return out


def similar(sets: list[np.ndarray]) -> np.ndarray:
    """Whether every two different sets reach the threshold."""
    size, shared = np.array([len(x) for x in sets], np.int64), common(sets)
    out = shared >= THRESHOLD * (size[:, None] + size[None, :] - shared) - 1e-9
    np.fill_diagonal(out, False)
    return out


def least_reached(linked: np.ndarray, names: np.ndarray) -> np.ndarray:
    """For each text, the least name among those that links lead to, its own included."""
    least, seen = names.copy(), ~linked.any(1)
    for first in range(len(names)):
        if seen[first]:
            continue
        reached = np.zeros(len(names), bool)
        fresh = np.zeros(len(names), bool)
        fresh[first] = True
        while fresh.any():
            reached |= fresh
            fresh = linked[fresh].any(0) & ~reached
        least[reached] = names[reached].min()
        seen |= reached
    return least


def _binary(rows: np.ndarray) -> pa.Array:
    return pa.array([row.tobytes() for row in rows], pa.binary())


def _fingerprints(ids: pa.Array, begin: np.ndarray, prints: np.ndarray) -> np.ndarray:
    """Fingerprints as signed numbers; a row without words is named by its id."""
    own = ids.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
    return np.where(np.diff(begin) > 0, prints, tx.mix(tx.mix(own))).view(np.int64)


def _with_fingerprint(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))


def sign(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of `docs`: id, fingerprint `tid`, number of shingles, band keys (none without words) and 16-bit signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in tx.blocks(batches, "text"):
            hashes, begin, prints = shingles(block.column(1))
            signed = signatures(hashes, begin)
            tid = _fingerprints(block.column(0), begin, prints)
            worded = np.diff(begin) > 0
            at = np.concatenate(([0], np.cumsum(worded * (HASHES // ROWS)))).astype(np.int32)
            keys = pa.ListArray.from_arrays(pa.array(at), pa.array(band_keys(signed)[worded].view(np.int64).ravel()))
            ids = [i if i is not None else int(t) for i, t in zip(block.column(0).to_pylist(), tid.tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(tid), pa.array(np.diff(begin).astype(np.int64)), keys, _binary(signed.astype(np.uint16))], ["doc_id", "tid", "n", "keys", "sig"])

    return _with_fingerprint(docs, doc_id, text).mapInArrow(run, "doc_id long, tid long, n long, keys array<long>, sig binary")


def _sets(docs: DataFrame) -> DataFrame:
    """Sorted distinct shingles of every row of (doc_id, text, wanted fingerprint `tid`, ...), and the other columns."""
    names = docs.columns[2:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in tx.blocks(batches, "text"):
            hashes, begin, prints = shingles(block.column(1))
            tid = _fingerprints(block.column(0), begin, prints)
            mine = np.flatnonzero(tid == block.column(2).to_numpy())
            sets = [np.unique(hashes[begin[i] : begin[i + 1]]).tobytes() for i in mine]
            yield pa.RecordBatch.from_arrays([*(block.column(c).take(pa.array(mine)) for c in names), pa.array(sets, pa.binary())], [*names, "shingles"])

    return docs.mapInArrow(run, ", ".join(f"{c} long" for c in names) + ", shingles binary")


def _by_id(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Rows with `key`: their id, or the stand-in that `sign` gives to a null id."""
    rows = _with_fingerprint(docs, doc_id, text)
    named = rows.where("doc_id is not null").withColumn("key", F.col("doc_id"))
    nameless = _mark(rows.where("doc_id is null"), "doc_id", "text").select("doc_id", "text", F.col("_kept").alias("key"))
    return named.union(nameless)


def _groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """The rows of each value of `key`, by which the batches are sorted. One value's rows are held at a time."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy()
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        for low, high in zip(cuts, cuts[1:]):
            if held and keys[low] != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(low, high - low))
            last = keys[low]
    if held:
        yield pa.Table.from_batches(held)


def _blocks(rows: DataFrame, key: str, *more: str) -> DataFrame:
    """Rows of a key whose `parts` is n go to n of its n (n + 1) / 2 blocks, so that every two meet.

    `block` names the block; `whole` tells a block of one part, and `own` the rows of its first part.
    """
    part = F.pmod(F.xxhash64("tid", F.lit(1)), F.col("parts"))
    spread = rows.withColumn("part", part).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    low, high = F.least("part", "other"), F.greatest("part", "other")
    return spread.select(F.xxhash64(key, low, high).alias("block"), (low == high).alias("whole"), (F.col("part") == low).alias("own"), "tid", *more)


def clusters(texts: DataFrame) -> DataFrame:
    """(a, b): each text with another of its bucket that a chain of surviving pairs leads to."""
    every = texts.select("tid", F.explode("keys").alias("key"))
    members = [F.count("*").alias("n"), F.min("tid").alias("low"), F.max("tid").alias("high"), F.bit_xor(F.xxhash64("tid")).alias("x"), F.bit_xor(F.xxhash64("tid", F.lit(2))).alias("y")]
    # A bucket of one text gives no pair; of buckets with the same members one is enough.
    shared = every.groupBy("key").agg(*members).where("low <> high").groupBy("n", "low", "high", "x", "y").agg(F.min("key").alias("key"))
    parts = F.ceil(F.col("n") / BLOCK_SIGNATURES).cast("long").alias("parts")
    shared = staging.stage(shared.select("key", parts), "shared-keys")
    if 2 * shared.count() <= BROADCAST_IDS:
        met = texts.select("tid", "sig", F.explode("keys").alias("key")).join(F.broadcast(shared), "key")
    else:  # signatures move once per shared bucket, not once per bucket
        met = every.join(shared, "key").join(texts.select("tid", "sig"), "tid")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, "block"):
            tid = group.column("tid").to_numpy()
            root = tid[reach(np.array([np.frombuffer(x.as_py(), np.uint16) for x in group.column("sig")], np.uint16))]
            apart = tid != root
            if apart.any():
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(tid, root)[apart]), pa.array(np.maximum(tid, root)[apart])], ["a", "b"])

    blocks = _blocks(met, "key", "sig").select("block", "tid", "sig")
    return blocks.repartition("block").sortWithinPartitions("block").mapInArrow(run, "a long, b long").distinct()


def verified(sets: DataFrame) -> DataFrame:
    """(tid, others, least): per block, the rows of texts similar to a text, and the least text that links lead to.

    From rows (tid, copies, cluster, parts, shingles); every two texts of a cluster meet in one block.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, "block"):
            tid, first = np.unique(group.column("tid").to_numpy(), return_index=True)  # rows may repeat
            copies, own = group.column("copies").to_numpy()[first], group.column("own").to_numpy()[first]
            held = group.column("shingles")
            linked = similar([np.frombuffer(held[i].as_py(), np.uint64) for i in first.tolist()])
            if not group.column("whole")[0].as_py():
                linked &= own[:, None] != own[None, :]
            some = linked.any(1)
            if some.any():
                columns = [tid[some], (linked @ copies)[some], least_reached(linked, tid)[some]]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], ["tid", "others", "least"])

    blocks = _blocks(sets, "cluster", "copies", "shingles")
    return blocks.repartition("block").sortWithinPartitions("block").mapInArrow(run, "tid long, others long, least long")


def components(links: DataFrame) -> DataFrame:
    """(tid, comp): the least text reachable over links (a, b). Labels move along links, then jump."""
    both = staging.stage(links.select("a", "b").union(links.select("b", "a")), "links")
    labels = staging.stage(both.groupBy(F.col("a").alias("tid")).agg(F.min("b").alias("m")).select("tid", F.least("tid", "m").alias("comp")), "labels")
    while True:
        moved = both.join(labels.withColumnRenamed("tid", "b"), "b").groupBy(F.col("a").alias("tid")).agg(F.min("comp").alias("near"))
        near = labels.join(moved, "tid").select("tid", F.col("comp").alias("old"), F.least("comp", "near").alias("mid"))
        jumps = labels.select(F.col("tid").alias("mid"), F.col("comp").alias("next"))
        fresh = staging.stage(near.join(jumps, "mid").select("tid", "old", F.least("mid", "next").alias("comp")), "labels")
        changed = fresh.where("comp <> old").limit(1).count()
        labels = fresh.select("tid", "comp")
        if not changed:
            return labels


def links(docs: DataFrame, signed: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(tid, others, least) as `verified` gives it, and the components (tid, comp) of linked texts."""
    rows = signed.where(F.size("keys") > 0).groupBy("tid")
    texts = rows.agg(F.min("doc_id").alias("key"), F.count("*").alias("copies"), F.max("n").alias("n"), F.first("keys").alias("keys"), F.first("sig").alias("sig"))
    texts = staging.stage(texts, "texts")
    met = staging.stage(clusters(texts), "met")
    labels = staging.stage(components(met).withColumnRenamed("comp", "cluster"), "clusters")
    chosen = texts.select("tid", "key", "copies", "n").join(labels, "tid")
    sizes = chosen.groupBy("cluster").agg(F.greatest(F.ceil(F.count("*") / BLOCK_TEXTS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("long").alias("parts"))
    chosen = staging.stage(chosen.join(sizes, "cluster").select("tid", "key", "copies", "cluster", "parts"), "chosen")
    if 5 * chosen.count() <= 2 * BROADCAST_IDS:  # numbers; sent out, no text is shuffled
        chosen = F.broadcast(chosen)
    keyed = _by_id(docs, doc_id, text).join(chosen, "key").select("doc_id", "text", "tid", "copies", "cluster", "parts")
    found = staging.stage(verified(_sets(keyed)), "verified")
    linked = found.where("tid <> least").select(F.col("least").alias("a"), F.col("tid").alias("b"))
    return found, components(linked)


def join(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of `docs`: doc_id, class_id (least id of its class), n_links and the fingerprint `tid`.

    n_links counts rows with the same words (itself excluded) and all rows of texts verified to be similar.
    """
    signed = staging.stage(sign(docs, doc_id, text), "signed")
    found, labels = links(docs, signed, doc_id, text)
    copies = staging.stage(signed.groupBy("tid").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id")), "copies")
    linked = found.groupBy("tid").agg(F.sum("others").alias("others"))
    per_text = copies.join(labels, "tid", "left").join(linked, "tid", "left").withColumn("comp", F.coalesce("comp", "tid"))
    per_text = staging.stage(per_text, "per-text")
    classes = staging.stage(per_text.groupBy("comp").agg(F.min("first_id").alias("class_id")), "classes")
    n_links = (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links")
    named = staging.stage(per_text.join(classes, "comp").select("tid", "class_id", n_links), "named")
    return signed.select("doc_id", "tid").join(named, "tid").select("doc_id", "class_id", "n_links", "tid")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` with the row of the least id of every class only; of repeated rows one stays."""
    kept = join(docs, doc_id, text).where("doc_id = class_id").select("doc_id", "tid").distinct()
    kept = staging.stage(kept, "kept").select(F.col("doc_id").alias("_kept"), F.col("tid").alias("_tid"))
    hidden = docs.select(*[F.col(f"`{c}`").alias(f"_own_{i}") for i, c in enumerate(docs.columns)])
    own_id, own_text = (f"_own_{docs.columns.index(c)}" for c in (doc_id, text))
    marked = _mark(hidden, own_id, own_text)
    one = marked.join(kept, ["_kept", "_tid"]).groupBy("_kept", "_tid").agg(F.first(F.struct(*hidden.columns)).alias("row"))
    return one.select(*[F.col("row")[f"_own_{i}"].alias(c) for i, c in enumerate(docs.columns)])


def _mark(hidden: DataFrame, own_id: str, own_text: str) -> DataFrame:
    """`hidden` with the id (or its stand-in) and the fingerprint that `sign` gives."""
    schema = T.StructType([*hidden.schema.fields, T.StructField("_kept", T.LongType()), T.StructField("_tid", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in tx.blocks(batches, own_text):
            _, begin, prints = shingles(block.column(own_text))
            ids = block.column(own_id).cast(pa.int64())
            tid = _fingerprints(ids, begin, prints)
            keys = [i if i is not None else int(t) for i, t in zip(ids.to_pylist(), tid.tolist())]
            yield pa.RecordBatch.from_arrays([*block.columns, pa.array(keys, pa.int64()), pa.array(tid)], schema.names)

    return hidden.mapInArrow(run, schema)
