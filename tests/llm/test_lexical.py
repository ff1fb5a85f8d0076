"""Ranked search beside a dictionary of counts."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesforge.llm import lexical
from tests.llm.common import ODD_TEXTS, frame

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k=10):
    counted = [(i, Counter(w), len(w)) for i, w in ((i, words(t)) for i, t in docs) if w]
    n_all, length = len(counted), sum(n for _, _, n in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c, n in counted:
            m = 25 + 75 * n * n_all // length
            score = sum(math.floor(1000 * math.log((2 * n_all + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 8 * m)) for t in words(text) if c[t])
            if score > 0:
                scored.append((-score, (i is not None, i or 0), i))
        out += [(item, r, i, -s) for r, (s, _, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


def corpus(seed=3, n=300):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeé中X9") for _ in range(rng.randrange(1, 4))) for _ in range(120)]
    weights = [1 / (k + 1) for k in range(120)]
    text = lambda low, high: rng.choice([" ", ", ", "-", "\n"]).join(rng.choices(vocabulary, weights, k=rng.randrange(low, high)))
    docs = [(i, text(0, 60)) for i in range(n)] + [(1000 + i, t) for i, t in enumerate(ODD_TEXTS)]
    docs += [(2000 + i, docs[7][1]) for i in range(40)] + [docs[9], (None, docs[9][1]), (None, None)]  # copies: ties
    items = [(i, text(1, 12)) for i in range(25)] + [(30, text(150, 200)), (31, None), (32, ""), (33, "nothing-of-this"), (34, "common " + docs[7][1]), (None, "a b"), (3, "a b")]
    return docs, items + [items[0]]


def found(docs, items, **options):
    return sorted(map(tuple, lexical.rank(docs, items, **options).collect()), key=repr)


@pytest.mark.parametrize("chunk_terms", [lexical.CHUNK_TERMS, 100])
def test_equals_counting(spark, chunk_terms, monkeypatch):
    monkeypatch.setattr(lexical, "BLOCK_DOCS", 70)
    docs, items = corpus()
    got = found(frame(spark, docs).repartition(3), frame(spark, items, "item_id long, text string"), chunk_terms=chunk_terms)
    assert got == brute(docs, items)


def test_masks_stop_early(spark, monkeypatch):
    monkeypatch.setattr(lexical, "STEP", 1)
    docs, items = corpus(8, 150)
    assert found(frame(spark, docs), frame(spark, items, "item_id long, text string"), k=3) == brute(docs, items, 3)


def test_only_masks_that_can_matter_are_scored():
    rng = np.random.default_rng(2)
    rare, common = np.sort(rng.choice(5000, 30, False)), np.arange(5000)
    postings = [(rare, np.full(30, 1000)), (common, rng.integers(1, 900, 5000))]
    docs, scores = lexical.best(postings, np.array([50, 1]), 5000, 10, 0)
    assert set(docs) <= set(rare) and len(docs) == 10 and scores.min() > 50_000


def test_masks_of_many_terms():
    rng = np.random.default_rng(4)
    postings = [(np.sort(rng.choice(300, 40, False)), rng.integers(1, 50, 40)) for _ in range(140)]
    weights = rng.integers(1, 9, 140)
    exact = np.zeros(300, np.int64)
    for (d, p), w in zip(postings, weights):
        exact[d] += w * p
    docs, scores = lexical.best(postings, weights, 300, 7, 0)
    assert sorted(scores)[::-1][:7] == sorted(exact)[::-1][:7] and (exact[docs] == scores).all()


def test_nothing_and_other_columns(spark):
    docs, items = corpus(5, 40)
    a, b = frame(spark, docs), frame(spark, items, "item_id long, text string")
    assert found(a.limit(0), b) == [] and found(a, b.limit(0)) == [] and found(a.where("doc_id is null and text is null"), b) == []
    wide = a.withColumn("score", F.lit(1)).withColumn("rank", F.lit(1)).withColumn("item_id", F.lit(1))
    assert found(wide, b.withColumn("doc_id", F.lit(1)).withColumn("bytes", F.lit(1))) == brute(docs, items)
