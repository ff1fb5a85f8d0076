"""Hard negatives by angular triangle filtering.

For every anchor, its positives are the first rows of its label by inner product, and its hard negatives, for each
positive, the first rows of other labels whose score lies between two fractions of the positive's score.

Vectors are of whole numbers. Each row stores its norm and its angles to reference directions. By the triangle
inequality of angles, a and x at angles s and t to one direction are at least |s - t| and at most min(s + t, 2 pi - s - t)
apart; the directions together give an interval of the cosine, and norms make it an interval of the score, widened by
more than rounding can change. Rows of a shard lie in order of label, nearest direction and angle, and are taken in runs of
`TILE`, whose interval holds that of each of their rows. Only runs whose interval overlaps a window still open (between
the two fractions, and not below the k-th score so far) are scored, exactly, in whole numbers. The result does not
depend on the directions, which are means of clusters of at most `SAMPLE` rows (those of least hash).

Anchors are dealt to groups of about `ANCHORS` and shards to slices; a task holds one group and reads the shards of one
slice after another. So rows travel once per group of anchors, anchors once per slice, and partial results are k rows
per anchor, positive and slice, however many rows have one label.

Rows with a null id, label or vector, or a null or non-finite component, take no part; `whole` marks the latter. Rows that
repeat an id count once, with the least (label, vector). Vectors of different lengths never meet; zero vectors score 0 with all
of theirs. Ties go to the smaller id. Other columns are not read. Empty tables give no rows. Scores must fit 64 bits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seriesforge.sources import staging

DIRECTIONS, SAMPLE, ROUNDS = 16, 4096, 8
SHARD, TILE, BLOCK, ANCHORS = 8192, 128, 512, 32_768
#: Angles are stored with 32 bits; bounds are widened by this share of the product of norms.
SLACK = 1e-5
#: Candidates kept before they are cut to the first k.
HELD = 100_000


def whole(vector: Column, times: float) -> Column:
    """The components times a factor, rounded down; null for a vector with a null or non-finite component."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(finite, F.transform(vector, lambda x: F.floor(x.cast("double") * times)))


# ---- angles and bounds -------------------------------------------------------------------------


def directions(sample: np.ndarray) -> np.ndarray:
    """Unit vectors: means of clusters of the sample by angle, or axes where it is empty."""
    dim = sample.shape[1]
    norms = np.linalg.norm(sample, axis=1)
    unit = sample[norms > 0] / norms[norms > 0, None]
    if not len(unit):
        return np.eye(dim)[:DIRECTIONS]
    chosen = [0]  # each start is far from those before it
    for _ in range(min(DIRECTIONS, len(unit)) - 1):
        chosen.append(int((unit @ unit[chosen].T).max(1).argmin()))
    found = unit[chosen]
    for _ in range(ROUNDS):
        nearest = (unit @ found.T).argmax(1)
        sums = np.zeros_like(found)
        np.add.at(sums, nearest, unit)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        found = np.where(length > 1e-9, sums / np.maximum(length, 1e-9), found)
    return found


def angles(vectors: np.ndarray, refs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Norms, and the angle of every row to every direction (0 for a zero vector)."""
    x = vectors.astype(np.float64)
    norms = np.linalg.norm(x, axis=1)
    cosines = np.where(norms[:, None] > 0, x @ refs.T / np.maximum(norms, 1e-300)[:, None], 1.0)
    return norms, np.arccos(np.clip(cosines, -1, 1)).astype(np.float32)


def bounds(norm: np.ndarray, angle: np.ndarray, low: np.ndarray, high: np.ndarray, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest score of every (row, run): rows have norms and angles, runs intervals of both."""
    above, below = np.ones((len(norm), len(least))), -np.ones((len(norm), len(least)))
    for r in range(angle.shape[1]):
        own, a, b = angle[:, r, None].astype(np.float64), low[None, :, r].astype(np.float64), high[None, :, r].astype(np.float64)
        np.minimum(above, np.cos(np.maximum(0, np.maximum(a - own, own - b))), out=above)
        far = np.minimum(np.cos(own + a), np.cos(own + b))
        np.maximum(below, np.where((own + a <= math.pi) & (own + b >= math.pi), -1, far), out=below)
    slack = SLACK * norm[:, None] * most[None, :] + 1
    return (
        norm[:, None] * np.where(below >= 0, least, most) * below - slack,
        norm[:, None] * np.where(above >= 0, most, least) * above + slack,
    )


def products(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of whole vectors."""
    largest = float(np.linalg.norm(a.astype(np.float64), axis=1).max(initial=0) * np.linalg.norm(x.astype(np.float64), axis=1).max(initial=0))
    if largest < 2.0**52:  # no sum leaves the whole numbers of a double: by Cauchy-Schwarz, for any part of the components
        return (a.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    if largest >= 2.0**62:
        raise OverflowError("a score does not fit 64 bits")
    return a @ x.T


# ---- shards and anchors ------------------------------------------------------------------------


@dataclass
class Rows:
    """Rows of one vector length; anchors of the second pass have up to `wanted` positives too."""

    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    norms: np.ndarray
    angles: np.ndarray
    positives: np.ndarray | None = None  # (rows, wanted), padded with the least number
    positive_scores: np.ndarray | None = None


_PACKED = "dim int, ids binary, labels binary, vectors binary, norms binary, angles binary, positives binary, positive_scores binary"
_FIELDS = [f.split()[0] for f in _PACKED.split(", ")]
NONE = np.iinfo(np.int64).min


def _pack(rows: Rows, dim: int) -> list:
    parts = (rows.ids, rows.labels, rows.vectors, rows.norms, rows.angles, rows.positives, rows.positive_scores)
    return [dim, *(None if p is None else np.ascontiguousarray(p).tobytes() for p in parts)]


def _unpack(row: dict, wanted: int) -> Rows:
    read = lambda name, kind: np.frombuffer(row[name], kind)
    n = len(row["ids"]) // 8
    found = Rows(read("ids", np.int64), read("labels", np.int64), read("vectors", np.int64).reshape(n, row["dim"]), read("norms", np.float64), read("angles", np.float32).reshape(n, -1))
    if row["positives"] is not None:
        found.positives, found.positive_scores = (read(c, np.int64).reshape(n, wanted) for c in ("positives", "positive_scores"))
    return found


def _packer(refs: dict[int, np.ndarray], wanted: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        lists = table.column("vector").combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        sizes = lists.value_lengths().to_numpy()
        flat, at = lists.flatten().to_numpy(), np.concatenate(([0], np.cumsum(sizes)))
        ids, labels = (table.column(c).to_numpy() for c in ("id", "label"))
        out = []
        for dim in np.unique(sizes).tolist():
            mine = np.flatnonzero(sizes == dim)
            vectors = flat[at[mine][:, None] + np.arange(dim)[None, :]].astype(np.int64).reshape(len(mine), dim)
            own = refs.get(dim)
            norms, angle = angles(vectors, directions(np.zeros((0, dim))) if own is None else own)
            nearest = angle.argmin(1) if angle.shape[1] else np.zeros(len(mine), int)
            closest = angle.min(1) if angle.shape[1] else np.zeros(len(mine))
            order = np.lexsort((ids[mine], closest, nearest, labels[mine]))
            rows = Rows(ids[mine][order], labels[mine][order], vectors[order], norms[order], angle[order])
            if "found" in table.column_names:
                lists_ = [table.column("found")[int(i)].as_py() for i in mine[order]]
                rows.positives = np.array([[p["id"] for p in x] + [NONE] * (wanted - len(x)) for x in lists_], np.int64)
                rows.positive_scores = np.array([[p["score"] for p in x] + [NONE] * (wanted - len(x)) for x in lists_], np.int64)
            out.append(_pack(rows, dim))
        return pa.Table.from_pylist([dict(zip(_FIELDS, row)) for row in out], schema=_ARROW)

    return run


_ARROW = pa.schema([("dim", pa.int32()), *((name, pa.binary()) for name in _FIELDS[1:])])


def _packed(rows: DataFrame, size: int, refs: dict[int, np.ndarray], wanted: int) -> DataFrame:
    """Rows of (id, label, vector, ...) in packed parts of about `size` rows."""
    parts = max(1, math.ceil(rows.count() / size))
    run = _packer(refs, wanted)
    return rows.groupBy(F.pmod(F.xxhash64("id"), F.lit(parts)).alias("part")).applyInArrow(lambda table: run(table), _PACKED)


# ---- search of one group of anchors ------------------------------------------------------------


class Best:
    """The first k candidates of each slot, by descending score and then by id."""

    def __init__(self, slots: int, k: int):
        self.k, self.floor = k, np.full(slots, NONE)
        self.slot, self.score, self.id = ([] for _ in range(3))
        self.size = 0

    def add(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        self.slot.append(slot)
        self.score.append(score)
        self.id.append(ids)
        self.size += len(slot)
        if self.size >= HELD:
            self.cut()

    def cut(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        slot, score, ids = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (self.slot, self.score, self.id))
        order = np.lexsort((ids, -score, slot))
        slot, score, ids = slot[order], score[order], ids[order]
        place = np.arange(len(slot)) - np.searchsorted(slot, slot)
        last = place == self.k - 1
        self.floor[slot[last]] = score[last]
        keep = place < self.k
        self.slot, self.score, self.id = [slot[keep]], [score[keep]], [ids[keep]]
        self.size = int(keep.sum())
        return self.slot[0], self.score[0], self.id[0]


def _top(scores: np.ndarray, use: np.ndarray, k: int) -> np.ndarray:
    """Of the entries in use, those not below the k-th of their row."""
    if scores.shape[1] > k:
        held = np.where(use, scores, NONE)
        use &= scores >= np.partition(held, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k, None]
    return use


@dataclass
class Asked:
    """A block of anchors, and what was found for it. `low` and `high` are the windows of its slots."""

    rows: Rows
    k: int
    low: np.ndarray | None = None
    high: np.ndarray | None = None
    best: Best = field(init=False)

    def __post_init__(self):
        self.best = Best(len(self.rows.ids) * (1 if self.low is None else self.low.shape[1]), self.k)

    def meet(self, shard: Rows) -> None:
        own = self.rows
        begin = np.arange(0, len(shard.ids), TILE)
        end = np.minimum(begin + TILE, len(shard.ids))
        least, most = bounds(
            own.norms, own.angles, np.minimum.reduceat(shard.angles, begin), np.maximum.reduceat(shard.angles, begin),
            np.minimum.reduceat(shard.norms, begin), np.maximum.reduceat(shard.norms, begin),
        )
        first, last = shard.labels[begin][None, :], shard.labels[end - 1][None, :]
        mine = own.labels[:, None]
        may = (first <= mine) & (mine <= last) if self.low is None else (first != mine) | (last != mine)
        for t in np.argsort(-most.max(0, initial=0, where=may)).tolist():
            part = slice(begin[t], end[t])
            if self.low is None:
                rows = np.flatnonzero(may[:, t] & (most[:, t] >= self.best.floor))
            else:
                floor = np.maximum(self.low, self.best.floor.reshape(self.low.shape))
                rows = np.flatnonzero(may[:, t] & ((most[:, t, None] >= floor) & (least[:, t, None] <= self.high)).any(1))
            if len(rows):
                self._score(rows, shard, part)

    def _score(self, rows: np.ndarray, shard: Rows, part: slice) -> None:
        own, ids = self.rows, shard.ids[part]
        scores = products(own.vectors[rows], shard.vectors[part])
        same = own.labels[rows, None] == shard.labels[part][None, :]
        width = 1 if self.low is None else self.low.shape[1]
        for j in range(width):
            slots = rows * width + j
            use = scores >= self.best.floor[slots][:, None]
            if self.low is None:
                use &= same & (own.ids[rows, None] != ids[None, :])
            else:
                use &= ~same & (scores >= self.low[rows, j, None]) & (scores <= self.high[rows, j, None])
            if use.any():
                row, col = np.nonzero(_top(scores, use, self.k))
                self.best.add(slots[row], scores[row, col], ids[col])


@dataclass(frozen=True)
class Rule:
    positives: int = 5
    negatives: int = 10
    low: int = 30  # hundredths of the positive's score
    high: int = 90


def _search(rows: DataFrame, anchors: DataFrame, rule: Rule, second: bool, groups: int, out: str) -> DataFrame:
    """The first k of each task for every anchor (or anchor and positive), from stored shards and blocks of anchors."""
    names = [f.split()[0] for f in out.split(", ")]
    width = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slices = max(1, min(rows.count(), math.ceil(width / groups)))
    # The number of a packed part comes from its ids, which differ from part to part.
    number = F.xxhash64("ids", "dim")
    cell = F.lit(slices) * F.col("group") + F.col("slice")
    held = anchors.withColumn("group", F.pmod(number, F.lit(groups))).withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1)))).select(cell.alias("cell"), F.lit(0).alias("kind"), *_FIELDS)
    read = rows.withColumn("slice", F.pmod(number, F.lit(slices))).withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).select(cell.alias("cell"), F.lit(1).alias("kind"), *_FIELDS)

    def results(blocks: list[Asked]) -> Iterator[pa.RecordBatch]:
        for block in blocks:
            slot, score, ids = block.best.cut()
            if not len(slot):
                continue
            if second:
                row, j = slot // rule.positives, slot % rule.positives
                columns = [block.rows.ids[row], block.rows.positives[row, j], ids, block.rows.positive_scores[row, j], score]
            else:
                columns = [block.rows.ids[slot], ids, score]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, blocks = None, []
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i].as_py() for name in batch.schema.names}
                if row["cell"] != current:
                    yield from results(blocks)
                    current, blocks = row["cell"], []
                found = _unpack(row, rule.positives)
                if row["kind"]:
                    for block in blocks:
                        if block.rows.vectors.shape[1] == found.vectors.shape[1]:
                            block.meet(found)
                elif second:
                    there = found.positive_scores != NONE
                    hundreds, rest = found.positive_scores // 100, found.positive_scores % 100  # no product leaves 64 bits
                    low, high = hundreds * rule.low - (-rest * rule.low // 100), hundreds * rule.high + rest * rule.high // 100
                    blocks.append(Asked(found, rule.negatives, np.where(there, low, 1), np.where(there, high, 0)))
                else:
                    blocks.append(Asked(found, rule.positives))
        yield from results(blocks)

    return held.union(read).repartition("cell").sortWithinPartitions("cell", "kind").mapInArrow(run, out)


def mine(table: DataFrame, is_anchor: Column, rule: Rule = Rule(), row_id: str = "vec_id", label: str = "label", vector: str = "vector", shard: int = SHARD, group: int = ANCHORS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score; `is_anchor` is a condition on `id`."""
    rows = table.select(F.col(f"`{row_id}`").cast("long").alias("id"), F.col(f"`{label}`").cast("long").alias("label"), F.col(f"`{vector}`").cast("array<long>").alias("vector"))
    rows = rows.where("id is not null and label is not null and vector is not null and not exists(vector, x -> x is null)")
    rows = rows.groupBy("id").agg(F.min(F.struct("label", "vector")).alias("row")).select("id", "row.*")
    rows = staging.stage(rows, "mining-rows")
    refs: dict[int, list] = {}
    for r in rows.orderBy(F.xxhash64("id")).limit(SAMPLE).collect():
        refs.setdefault(len(r["vector"]), []).append(r["vector"])
    refs = {dim: directions(np.array(found, np.float64).reshape(len(found), dim)) for dim, found in refs.items()}
    shards = staging.stage(_packed(rows, shard, refs, rule.positives), "mining-shards")
    asked = rows.where(is_anchor)
    groups = max(1, math.ceil(asked.count() / group))
    first = staging.stage(_packed(asked, BLOCK, refs, rule.positives), "mining-anchors")
    near = _search(shards, first, rule, False, groups, "anchor_id long, id long, score long")
    place = F.row_number().over(Window.partitionBy("anchor_id").orderBy(F.desc("score"), "id"))
    positives = near.withColumn("rank", place).where(F.col("rank") <= rule.positives)
    listed = positives.groupBy(F.col("anchor_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct("rank", "id", "score"))).alias("found"))
    again = staging.stage(asked.join(listed, "id"), "mining-positives")
    second = staging.stage(_packed(again, BLOCK, refs, rule.positives), "mining-windows")
    hard = _search(shards, second, rule, True, groups, "anchor_id long, positive_id long, negative_id long, positive_score long, negative_score long")
    place = F.row_number().over(Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")).cast("int")
    ranked = hard.withColumn("rank", place).where(F.col("rank") <= rule.negatives)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
