"""Approximate nearest neighbours by inner product: one small-world graph per shard, results merged.

Equal vectors are one node; only the `k + 1` smallest ids of a vector can be among the k nearest, so a
node keeps no more of them. Nodes are dealt to shards of about `SHARD` by a hash. A shard's graph is a
hierarchy of layers with flat neighbour arrays: vectors get one more coordinate that makes all norms equal
(the largest inner product is then the nearest neighbour). Nodes are inserted in order of their level, in batches
that search the graph built so far, descending from the layers above; every node takes diverse neighbours among
those found and those of its batch, and is linked back. Queries descend the upper layers greedily and keep a beam
of `BEAM` nodes in the lowest; they move through the graph in lockstep. Scores are computed anew, in double
precision, on the original vectors.

A shard travels once, to the task that searches it; blocks of queries travel to every shard and pass by it one after
another. A task hands on k rows per query, and a window merges the shards.

Vectors that are null, empty or zero or hold a null or non-finite component take no part, nor does a row
without id. Vectors of different lengths never meet. Repeated rows count once; of different vectors with one id,
each is a candidate, and one that Spark meets first is the query. Ties go to the smaller id. Other columns are not
read. Empty tables give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seriesforge.sources import staging

SHARD, QUERY_BLOCK = 8192, 512
LINKS, CANDIDATES, BEAM, WIDTH = 16, 64, 128, 4
#: Beam of an insertion.
SEEN = 48
#: Nodes that are linked by all their products, at the start of a layer, and nodes inserted at once after them.
FIRST, BATCH = 256, 2048


def usable(vector: Column) -> Column:
    """A vector of finite numbers that are not all zero."""
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vector, lambda x: x != 0)


# ---- graph of one shard ------------------------------------------------------------------------


def _diverse(x: np.ndarray, own: np.ndarray, near: np.ndarray, close: np.ndarray) -> np.ndarray:
    """Of candidates sorted by closeness, those closer to their node than to any neighbour chosen before; -1 pads."""
    picked = x[near]
    among = picked @ picked.transpose(0, 2, 1)
    chosen, count = np.zeros(near.shape, bool), np.zeros(len(near), int)
    for c in range(near.shape[1]):
        blocked = (chosen & (among[:, c, :] > close[:, c, None])).any(1)
        take = ~blocked & (count < LINKS) & (close[:, c] > -np.inf)
        chosen[take, c] = True
        count += take
    # Fill up with the closest that were passed over.
    rank = np.argsort(~chosen, axis=1, kind="stable")[:, :LINKS]
    found = np.take_along_axis(near, rank, 1)
    found[np.take_along_axis(close, rank, 1) == -np.inf] = -1
    return found


def _exact(x: np.ndarray, low: int) -> tuple[np.ndarray, np.ndarray]:
    """For the nodes from `low` on, the closest among those before them and from `low` on: (places, closeness), sorted."""
    close = x[low:] @ x[low:].T
    close[np.arange(len(close))[None, :] >= np.arange(len(close))[:, None]] = -np.inf
    m = min(CANDIDATES, len(close))
    near = np.argpartition(-close, m - 1, axis=1)[:, :m]
    order = np.argsort(-np.take_along_axis(close, near, 1), axis=1)
    near = np.take_along_axis(near, order, 1)
    return near + low, np.take_along_axis(close, near, 1)


class _Layer:
    """Neighbour array (n, width) of one layer: a node's own choices first, then the closest of those that chose it."""

    def __init__(self, x: np.ndarray, width: int):
        self.x, self.own = x, np.zeros(len(x), np.int64)
        self.links, self.sims = np.full((len(x), width), -1, np.int32), np.full((len(x), width), -np.inf, np.float32)

    def insert(self, low: int, near: np.ndarray, close: np.ndarray) -> None:
        """Nodes from `low` on, with candidates sorted by closeness (-inf where there is none)."""
        high, width = low + len(near), self.links.shape[1]
        chosen = _diverse(self.x, np.arange(low, high), near, close)
        row, col = np.nonzero(chosen >= 0)
        head, tail = row + low, chosen[row, col]
        sim = np.einsum("id,id->i", self.x[head], self.x[tail])
        self.links[head, col], self.sims[head, col] = tail, sim
        self.own[low:high] = (chosen >= 0).sum(1)
        # Back links of the nodes chosen: those they have and the new ones, the closest first, after their own choices.
        met = np.unique(tail)
        there = np.arange(width)[None, :] >= self.own[met][:, None]
        at, place = np.nonzero(there & (self.links[met] >= 0))
        tail, head = np.concatenate((tail, met[at])), np.concatenate((head, self.links[met[at], place]))
        sim = np.concatenate((sim, self.sims[met[at], place]))
        order = np.lexsort((-sim, tail))
        tail, head, sim = tail[order], head[order], sim[order]
        place = np.arange(len(tail)) - np.searchsorted(tail, tail) + self.own[tail]
        keep = place < width
        self.links[tail[keep], place[keep]], self.sims[tail[keep], place[keep]] = head[keep], sim[keep]


def layer(x: np.ndarray, width: int, above: list[np.ndarray]) -> np.ndarray:
    """Neighbour array of the nodes of one layer, inserted in order; `above` has the layers above it, the nearest first."""
    made = _Layer(x, width)
    done = min(len(x), max(FIRST, len(above[0]) if above else 0))
    near, close = _exact(x[:done], 0)
    made.insert(0, near, close)
    while done < len(x):
        batch = x[done : done + min(done, BATCH)]
        found = beam_search(x[:done], [made.links[:done], *above], batch, SEEN)
        far = np.where(found >= 0, np.einsum("bmd,bd->bm", x[found], batch), -np.inf)
        near, close = _exact(x[: done + len(batch)], done)
        near, close = np.concatenate((found, near), 1), np.concatenate((far, close), 1)
        order = np.argsort(-close, axis=1, kind="stable")[:, :CANDIDATES]
        made.insert(done, np.maximum(np.take_along_axis(near, order, 1), 0), np.take_along_axis(close, order, 1))
        done += len(batch)
    return made.links


def build(vectors: np.ndarray, seed: int = 0) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Insertion order, augmented vectors in that order, and neighbour arrays from the lowest layer up."""
    n = len(vectors)
    levels = np.floor(-np.log(np.random.default_rng(seed).random(n)) / math.log(LINKS)).astype(int)
    order = np.argsort(-levels, kind="stable")
    x = vectors[order].astype(np.float64)
    scale = np.sqrt((x**2).sum(1).max())
    x = x / scale
    x = np.column_stack((x, np.sqrt(np.maximum(0, 1 - (x**2).sum(1))))).astype(np.float32)
    layers: list[np.ndarray] = []
    for k in reversed(range(levels.max() + 1)):
        layers.insert(0, layer(x[: int((levels >= k).sum())], 2 * LINKS if k == 0 else LINKS, layers))
    return order, x, layers


def search(x: np.ndarray, layers: list[np.ndarray], queries: np.ndarray, k: int) -> np.ndarray:
    """The k nearest nodes found for every query, as (queries, k) node numbers; -1 pads."""
    return beam_search(x, layers, np.column_stack((queries, np.zeros(len(queries)))).astype(np.float32), max(BEAM, k))[:, :k]


def beam_search(x: np.ndarray, layers: list[np.ndarray], q: np.ndarray, beam: int) -> np.ndarray:
    """Nodes found for every (augmented) query, nearest first; -1 pads."""
    current = np.zeros(len(q), np.int64)
    for links in reversed(layers[1:]):
        best = np.einsum("qd,qd->q", x[current], q)
        while True:
            near = links[current]
            close = np.where(near >= 0, np.einsum("qmd,qd->qm", x[near], q), -np.inf)
            top = close.argmax(1)
            better = close[np.arange(len(q)), top] > best
            if not better.any():
                break
            current = np.where(better, near[np.arange(len(q)), top], current)
            best = np.where(better, close[np.arange(len(q)), top], best)
    ids, sims = np.full((len(q), beam), -1, np.int64), np.full((len(q), beam), -np.inf, np.float32)
    ids[:, 0], sims[:, 0] = current, np.einsum("qd,qd->q", x[current], q)
    opened, seen = np.zeros((len(q), beam), bool), np.zeros((len(q), len(x)), bool)
    seen[np.arange(len(q)), current] = True
    active = np.arange(len(q))
    while len(active):
        waiting = np.where(opened[active] | (ids[active] < 0), -np.inf, sims[active])
        pick = np.argsort(-waiting, axis=1)[:, :WIDTH]
        valid = np.take_along_axis(waiting, pick, 1) > -np.inf
        live = valid.any(1)
        active, pick, valid = active[live], pick[live], valid[live]
        if not len(active):
            break
        rows = np.arange(len(active))[:, None]
        opened[active[:, None], pick] |= valid
        near = np.where(valid[:, :, None], layers[0][np.maximum(ids[active[:, None], pick], 0)], -1).reshape(len(active), -1)
        near = np.sort(near, axis=1)
        fresh = (near >= 0) & ~seen[active[:, None], np.maximum(near, 0)]
        fresh[:, 1:] &= near[:, 1:] != near[:, :-1]
        row, col = np.nonzero(fresh)
        seen[active[row], near[row, col]] = True
        close = np.full(near.shape, -np.inf, np.float32)
        close[row, col] = np.einsum("id,id->i", x[near[row, col]], q[active[row]])
        all_ids = np.concatenate((ids[active], np.where(fresh, near, -1)), 1)
        all_sims = np.concatenate((sims[active], close), 1)
        all_open = np.concatenate((opened[active], np.zeros(near.shape, bool)), 1)
        best = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam]
        ids[active], sims[active], opened[active] = all_ids[rows, best], all_sims[rows, best], all_open[rows, best]
    return np.take_along_axis(ids, np.argsort(-sims, axis=1), 1)


# ---- Spark -------------------------------------------------------------------------------------

INDEX = "shard int, dim int, nodes int, ids binary, id_at binary, vectors binary, augmented binary, layers array<binary>, sizes array<int>"


def nodes(table: DataFrame, k: int, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Distinct usable vectors, each with its k + 1 smallest ids.

    The smallest ids are taken within input partitions first, so no task gathers a common vector's ids.
    """
    rows = table.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector")).where(F.col("id").isNotNull() & usable(F.col("vector")))
    least = F.slice(F.sort_array(F.collect_set("id")), 1, k + 1).alias("ids")
    near = rows.withColumn("part", F.spark_partition_id()).groupBy("vector", "part").agg(least)
    return near.groupBy("vector").agg(F.slice(F.sort_array(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, k + 1).alias("ids"))


def build_index(points: DataFrame, shards: int) -> DataFrame:
    """One row per shard (a number below `shards`) and vector length, with everything a search needs."""

    def run(frame):
        import pandas as pd

        frame = frame.sort_values("first")
        vectors = np.array(frame["vector"].tolist(), np.float64)
        order, x, layers = build(vectors, int(frame["shard"].iloc[0]))
        lists = [np.asarray(frame["ids"].iloc[i], np.int64) for i in order]
        at = np.concatenate(([0], np.cumsum([len(i) for i in lists]))).astype(np.int64)
        row = {
            "shard": int(frame["shard"].iloc[0]), "dim": int(frame["dim"].iloc[0]), "nodes": len(order), "ids": np.concatenate(lists).tobytes(), "id_at": at.tobytes(),
            "vectors": vectors[order].tobytes(), "augmented": x.tobytes(), "layers": [part.tobytes() for part in layers], "sizes": [len(part) for part in layers],
        }
        return pd.DataFrame([row])

    dealt = points.withColumn("dim", F.size("vector")).withColumn("first", F.get("ids", F.lit(0))).withColumn("shard", F.pmod(F.xxhash64("vector"), F.lit(shards)).cast("int"))
    return dealt.groupBy("shard", "dim").applyInPandas(run, INDEX)


FOUND = "query_id long, vec_id long, score double"


def _answers(index: dict, query_ids: np.ndarray, queries: np.ndarray, k: int) -> pa.RecordBatch:
    dim = index["dim"]
    x = np.frombuffer(index["augmented"], np.float32).reshape(-1, dim + 1)
    vectors = np.frombuffer(index["vectors"], np.float64).reshape(-1, dim)
    ids, at = np.frombuffer(index["ids"], np.int64), np.frombuffer(index["id_at"], np.int64)
    layers = [np.frombuffer(part, np.int32).reshape(size, -1) for part, size in zip(index["layers"], index["sizes"])]
    found = search(x, layers, queries, k + 1)
    row, col = np.nonzero(found >= 0)
    node = found[row, col]
    score = np.einsum("id,id->i", vectors[node], queries[row])
    counts = at[node + 1] - at[node]
    flat = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(at[node], counts)
    row, near, score = np.repeat(row, counts), ids[flat], np.repeat(score, counts)
    other = near != query_ids[row]
    row, near, score = row[other], near[other], score[other]
    order = np.lexsort((near, -score, row))
    row, near, score = row[order], near[order], score[order]
    keep = np.arange(len(row)) - np.searchsorted(row, row) < k
    return pa.RecordBatch.from_arrays([pa.array(query_ids[row[keep]]), pa.array(near[keep]), pa.array(score[keep])], ["query_id", "vec_id", "score"])


def nearest(table: DataFrame, queries: DataFrame, k: int = 20, vec_id: str = "vec_id", vector: str = "embedding", shard_size: int = SHARD) -> DataFrame:
    """The k nearest rows of `table` found for every usable row of `queries`: query_id, rank, vec_id, score."""
    points = staging.stage(nodes(table, k, vec_id, vector), "vector-nodes")
    shards = max(1, math.ceil(points.count() / shard_size))
    index = staging.stage(build_index(points, shards), "vector-index")
    asked = queries.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector")).where(F.col("id").isNotNull() & usable(F.col("vector")))
    asked = asked.dropDuplicates(["id"]).withColumn("dim", F.size("vector"))
    blocks = F.ceil(F.lit(asked.count()) / QUERY_BLOCK).cast("int")
    blocked = asked.withColumn("block", F.pmod(F.xxhash64("id"), F.greatest(blocks, F.lit(1))))
    # A block of queries is one row of bounded size; every shard gets it once, and stays where it is.
    packed = blocked.groupBy("dim", "block").agg(F.collect_list("id").alias("query_ids"), F.flatten(F.collect_list("vector")).alias("queries")).drop("block")
    passing = staging.stage(packed, "query-blocks").withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    tasks = index.withColumn("turn", F.lit(0)).unionByName(passing.withColumn("turn", F.lit(1)), allowMissingColumns=True)
    tasks = tasks.repartition("shard", "dim").sortWithinPartitions("shard", "dim", "turn")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i] for name in batch.schema.names}
                place = row["shard"].as_py(), row["dim"].as_py()
                if row["turn"].as_py() == 0:
                    held = {name: value.as_py() for name, value in row.items() if name not in ("query_ids", "queries")}
                elif held and place == (held["shard"], held["dim"]):
                    asked_ids = row["query_ids"].values.to_numpy()
                    yield _answers(held, asked_ids, row["queries"].values.to_numpy().reshape(len(asked_ids), -1), k)

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = tasks.mapInArrow(run, FOUND).withColumn("rank", F.row_number().over(best).cast("int"))
    return found.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
