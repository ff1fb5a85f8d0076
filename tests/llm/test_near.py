"""Near-copy classes beside all pairs in plain Python."""

import random
import re

import numpy as np

from seriesforge.llm import near
from tests.llm.common import ODD_TEXTS, frame


def plain_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def corpus():
    rng = random.Random(8)
    words = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(25):
        base = [rng.choice(words) for _ in range(rng.randrange(30, 200))]
        for _ in range(rng.randrange(1, 6)):
            copy = list(base)
            for _ in range(rng.randrange(0, 5)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(" ".join(copy))
    passage = " ".join(rng.choice(words) for _ in range(60))
    texts += [passage + " " + " ".join(rng.choice(words) for _ in range(60)) for _ in range(40)]
    return texts + texts[:5] + ODD_TEXTS + ["one two", "one  two", "one two three"]


def test_classes_equal_all_pairs(spark):
    texts = corpus()
    rows = list(enumerate(texts))
    sets = [plain_set(t) for t in texts]
    parent = list(range(len(texts)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    linked = {}
    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                parent[max(top(i), top(j))] = min(top(i), top(j))
                linked.setdefault(i, set()).add(j)
                linked.setdefault(j, set()).add(i)
    docs = frame(spark, rows)
    got = near.join(docs).collect()
    assert {r.doc_id: r.class_id for r in got} == {i: top(i) for i in range(len(texts))}
    for r in got:
        assert 0 <= r.n_links <= len(linked.get(r.doc_id, ()))
        assert (r.n_links > 0) == (r.doc_id in linked)
    kept = near.keep_one(docs.selectExpr("doc_id", "text", "'x' as tid"))
    assert kept.columns == ["doc_id", "text", "tid"]
    assert sorted(map(tuple, kept.collect())) == sorted((i, texts[i], "x") for i in range(len(texts)) if top(i) == i)


def test_repeated_and_nameless_rows(spark):
    docs = frame(spark, [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (None, "q r s t u v"), (2, None), (2, None), (3, "")])
    assert sorted(map(tuple, near.keep_one(docs).collect()), key=str) in (
        sorted([(1, "a b c d e f"), (None, "q r s t u v"), (2, None), (3, "")], key=str),
        sorted([(None, "a b c d e f"), (None, "q r s t u v"), (2, None), (3, "")], key=str),
    )
    assert near.keep_one(docs.limit(0)).count() == 0


def test_pruning_keeps_what_can_reach_the_threshold():
    rng = np.random.default_rng(9)
    left = rng.integers(0, 1 << 16, (4000, near.HASHES)).astype(np.uint16)
    for share, bound in ((0.8, 0.999), (0.4, 0.01)):
        right = np.where(rng.random(left.shape) < share, left, left + 1).astype(np.uint16)
        kept = len(near.survivors(left, right)) / len(left)
        assert kept >= bound if share == 0.8 else kept <= bound


def all_links(texts):
    """Similar rows of every row, and the least row of its class."""
    sets = [plain_set(t) for t in texts]
    links = [{j for j, b in enumerate(sets) if j != i and a and b and len(a & b) >= 0.8 * len(a | b)} for i, a in enumerate(sets)]
    least = list(range(len(texts)))
    for i in range(len(texts)):
        if least[i] == i:
            seen, todo = {i}, [i]
            while todo:
                fresh = links[todo.pop()] - seen
                seen |= fresh
                todo += fresh
            for j in seen:
                least[j] = i
    return links, least


def star(rng, n, changed, length=200):
    """A text and n copies of it, each changed at places of its own."""
    base = [f"b{rng.randrange(10**6)}" for _ in range(length)]
    texts = [" ".join(base)]
    for k in range(n):
        copy = list(base)
        for place in rng.sample(range(length // 10), changed):
            copy[place * 10 + rng.randrange(3)] = f"n{k}x{place}"
        texts.append(" ".join(copy))
    return texts


def equal_all_pairs(spark, texts):
    links, least = all_links(texts)
    got = {r.doc_id: r for r in near.join(frame(spark, list(enumerate(texts))).repartition(5)).collect()}
    assert {i: r.class_id for i, r in got.items()} == dict(enumerate(least))
    assert {i: r.n_links for i, r in got.items()} == {i: len(x) for i, x in enumerate(links)}
    return links, least


def test_large_star_groups_are_whole(spark):
    """1000 copies near J 0.82 with the base and under the threshold with one another."""
    links, least = equal_all_pairs(spark, star(random.Random(21), 1000, 4))
    assert len(links[0]) == 1000 and set(least) == {0} and max(map(len, links[1:])) < 100


def test_links_are_counted_inside_classes(spark):
    """Every two of 300 different copies are similar; others of the corpus have links across repeated rows."""
    texts = star(random.Random(22), 300, 1)
    links, _ = equal_all_pairs(spark, texts + texts[:7] + corpus())
    assert len(links[20]) >= 300


def test_blocks_of_a_cluster_and_of_a_bucket(spark, monkeypatch):
    """Groups larger than a block: every two texts meet once."""
    for name, value in (("BLOCK_SIGNATURES", 50), ("BLOCK_TEXTS", 40), ("BLOCK_SHINGLES", 5000), ("FEW", 4)):
        monkeypatch.setattr(near, name, value)
    equal_all_pairs(spark, star(random.Random(23), 200, 2) + corpus())


def test_common_counts_equal_plain_python():
    rng = np.random.default_rng(24)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 50)).astype(np.uint64)) for _ in range(80)] + [np.arange(100, 140, dtype=np.uint64)]
    got = near.common(sets)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            assert i == j or got[i, j] == len(np.intersect1d(a, b))
