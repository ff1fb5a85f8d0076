"""Recall and exact scores of the graph search, beside brute force."""

import numpy as np
from pyspark.sql import functions as F

from seriesforge.llm import queries, vectors
from tests.llm.common import frame

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows, k):
    ids = np.array([r[0] for r in rows])
    x = np.array([r[1] for r in rows], np.float32).astype(np.float64)
    out = {}
    for q in np.flatnonzero(ids % 20 == 0):
        scores = x @ x[q]
        order = [i for i in np.lexsort((ids, -scores)) if ids[i] != ids[q]][:k]
        out[int(ids[q])] = [int(ids[i]) for i in order]
    return out


def test_recall(spark):
    rng = np.random.default_rng(10)
    centres = rng.normal(size=(30, 16))
    rows = [(i, [float(v) for v in (centres[i % 30] + 0.4 * rng.normal(size=16)) * rng.uniform(0.5, 2)]) for i in range(3000)]
    rows += [(10_000 + i, rows[7][1]) for i in range(900)]  # one common vector
    data = frame(spark, rows, SCHEMA).repartition(4)
    got = {}
    for r in vectors.nearest(data, data.where("vec_id % 20 = 0"), 20, shard_size=1000).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    want = brute(rows, 20)
    assert got.keys() == want.keys()
    hits = sum(len({v for v, _ in got[q]} & set(want[q])) for q in want)
    assert hits >= 0.95 * sum(map(len, want.values()))
    by_id = {i: np.array(v, np.float32).astype(float) for i, v in rows}
    for q, found in got.items():
        assert len(found) == 20 and found == sorted(found, key=lambda f: (-f[1], f[0]))
        assert all(abs(s - by_id[q] @ by_id[v]) < 1e-9 for v, s in found)


def test_recall_of_the_query(spark):
    """The registered query with production parameters, on the embeddings table, beside brute force."""
    folder = "/root/testdata/sf0.01"
    got = {}
    for r in queries.queries()["op8_neighbours"](spark, folder).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    want = brute([tuple(r) for r in spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding").collect()], 20)
    assert sum(len(got[q] & set(want[q])) for q in want) >= 0.9 * sum(map(len, want.values()))


def test_insertion_links_near_nodes():
    """Batches that search the graph give neighbours that a search finds its way with, also in a layer of many batches."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(4000, 24)) * rng.uniform(0.5, 2, (4000, 1))
    order, augmented, layers = vectors.build(x)
    assert [len(part) for part in layers] == sorted((len(part) for part in layers), reverse=True) and (layers[0] < len(x)).all()
    assert all((part != np.arange(len(part))[:, None]).all() for part in layers)
    found = order[vectors.search(augmented, layers, x[:100], 20)]
    exact = np.argsort(-(x[:100] @ x.T), axis=1)[:, :20]
    assert sum(len(set(a) & set(b)) for a, b in zip(found.tolist(), exact.tolist())) >= 0.9 * 2000


def test_clashing_columns(spark):
    rows = [(i, [1.0 + i, float(i % 3)]) for i in range(45)]
    data = frame(spark, rows, SCHEMA)
    wide = data.withColumn("shard", F.lit("x")).withColumn("dim", F.lit(1)).withColumn("id", F.lit(2)).withColumn("score", F.lit(None))
    assert sorted(map(tuple, vectors.nearest(wide, wide.where("vec_id % 20 = 0")).collect())) == sorted(map(tuple, vectors.nearest(data, data.where("vec_id % 20 = 0")).collect()))


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (20, [1.0, 1.0]), (1, [1.0, 1.0]), (1, [1.0, 1.0]), (2, None), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, [2.0]), (None, [1.0, 2.0]), (40, []), (60, None)]
    data = frame(spark, rows, SCHEMA)
    got = sorted(map(tuple, vectors.nearest(data, data.where("vec_id % 20 = 0")).collect()))
    assert got == [(0, 1, 1, 1.0), (0, 2, 20, 1.0), (20, 1, 1, 2.0), (20, 2, 0, 1.0)]
    assert vectors.nearest(data.limit(0), data.limit(0)).count() == 0
