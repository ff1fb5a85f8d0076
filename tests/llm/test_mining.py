"""Hard negatives beside nested loops; bounds that hold for every pair."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesforge.llm import mining
from tests.llm.common import frame

SCHEMA = "vec_id long, label int, vector array<long>"


def brute(rows, rule=mining.Rule(), every=5):
    by_id = {}
    for i, label, v in rows:
        if i is not None and label is not None and v is not None and None not in v:
            by_id[i] = min(by_id.get(i, (label, v)), (label, v))
    out = []
    for a, (label, v) in by_id.items():
        if a % every:
            continue
        scored = [(-sum(x * y for x, y in zip(v, w)), i, other) for i, (other, w) in by_id.items() if i != a and len(w) == len(v)]
        for p, positive, _ in sorted(s for s in scored if s[2] == label)[: rule.positives]:
            fits = sorted(s for s in scored if s[2] != label and rule.low * -p <= 100 * -s[0] <= rule.high * -p)
            out += [(a, positive, k, i, -p, -s) for k, (s, i, _) in enumerate(fits[: rule.negatives], 1)]
    return sorted(out)


def found(table, **options):
    return sorted(map(tuple, mining.mine(table, F.col("id") % 5 == 0, **options).collect()))


@pytest.mark.parametrize("options", [{}, {"shard": 40, "group": 8}])
def test_equals_nested_loops(spark, options):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 7)) * 60
    rows = [(i, int(rng.integers(0, 3)), [int(x) for x in centres[i % 6] + 30 * rng.normal(size=7)]) for i in range(260)]
    rows += [(1000 + i, 1, rows[3][2]) for i in range(60)]  # one common vector: ties
    rows += [rows[5], rows[5], (5, 9, rows[6][2])]  # repeated ids
    assert found(frame(spark, rows, SCHEMA).repartition(3), **options) == brute(rows)


def test_odd_rows(spark):
    rows = [
        (0, 1, [3, 4]), (5, 1, [3, 4]), (1, 2, [1, 2]), (2, 1, [5, 5]), (3, 2, [2, 2]), (10, 1, [0, 0]), (4, None, [3, 4]), (None, 1, [3, 4]), (6, 2, None), (7, 2, [1, None]),
        (15, 1, []), (8, 2, []), (20, 1, [1, 2, 3]), (9, 2, [2, 2, 2]), (25, 3, [-(1 << 29), 1 << 29]), (11, 3, [-(1 << 29), (1 << 29) + 1]), (12, 4, [-(1 << 28), 1 << 28]),
    ]
    want = brute(rows)
    table = frame(spark, rows, SCHEMA)
    assert found(table) == want and any(r[0] == 25 for r in want)
    clashing = table.withColumn("id", F.lit("x")).withColumn("cell", F.lit(1)).withColumn("kind", F.lit(1)).withColumn("score", F.lit(1))
    assert found(clashing) == want
    assert found(table.limit(0)) == []


def test_whole(spark):
    nan, inf = float("nan"), float("inf")
    table = frame(spark, [(0, [0.5, -0.01]), (1, [nan]), (2, [inf]), (3, [None]), (4, None), (5, [])], "id long, v array<float>")
    got = {r.id: r.w for r in table.select("id", mining.whole(F.col("v"), 256).alias("w")).collect()}
    assert got == {0: [128, -3], 1: None, 2: None, 3: None, 4: None, 5: []}


def test_bounds_hold():
    rng = np.random.default_rng(6)
    x = (rng.normal(size=(400, 5)) * rng.uniform(0, 1000, (400, 1))).astype(np.int64)
    x[:3] = 0
    x[3] = -x[4]
    norms, angle = mining.angles(x, mining.directions(x[50:90].astype(float)))
    low, high = (f.reduceat(angle, range(0, 400, 10)) for f in (np.minimum, np.maximum))
    short, long = (f.reduceat(norms, range(0, 400, 10)) for f in (np.minimum, np.maximum))
    least, most = mining.bounds(norms, angle, low, high, short, long)
    exact = (x @ x.T).reshape(400, 40, 10)
    assert (least <= exact.min(2)).all() and (exact.max(2) <= most).all()
    single = mining.bounds(norms, angle, angle, angle, norms, norms)
    assert (single[0] <= x @ x.T).all() and (x @ x.T <= single[1]).all() and (single[1] - single[0]).mean() < 2 * np.outer(norms, norms).mean()


def test_scores_beyond_doubles():
    a, x = np.array([[1 << 30, 3]]), np.array([[(1 << 30) + 1, 5]])
    assert mining.products(a, x)[0, 0] == (1 << 30) * ((1 << 30) + 1) + 15
    with pytest.raises(OverflowError):
        mining.products(a << 2, x << 2)
