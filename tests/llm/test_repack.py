"""Best-fit packing: every id once, whole documents, bounds that hold, counts that reach them."""

import itertools
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from seriesforge.llm import repack, tokens
from tests.llm.common import documents, frame

PATH = public_tokenizers.path("word_bpe_49k.json")


def check(docs, got, rule):
    """Pieces tile their documents and their sequences; returns the number of sequences."""
    library = tokens.Library(tokens.file_text(PATH)).tokenizer
    want = sorted((i is not None, i or 0, tuple(library.encode(t or "", add_special_tokens=False).ids) + (rule.end_id,)) for i, t in docs)
    pieces = defaultdict(list)
    for r in got:
        pieces[r.doc_id].append(r)
    expected = defaultdict(list)
    for there, i, ids in want:
        for piece, start in enumerate(range(0, len(ids), rule.length)):
            part = ids[start : start + rule.length]
            expected[i if there else None].append((piece, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert {i: sorted((r.piece, r.start, r.length, r.ids_crc32) for r in rows) for i, rows in pieces.items()} == {i: sorted(rows) for i, rows in expected.items()}
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for rows in sequences.values():
        end = 0
        for offset, length in sorted(rows):
            assert offset == end
            end += length
        assert end <= rule.length
    return len(sequences)


@pytest.mark.parametrize("rule", [repack.Repacking(), repack.Repacking(length=64, end_id=9, group=40, exchange=2)])
def test_pieces_tile(spark, rule):
    docs = documents(spark)
    rows = [tuple(r) for r in docs.collect()]
    got = repack.pack(docs.repartition(3), PATH, rule).collect()
    sizes = np.array([r.length for r in got])
    least = repack._rounded(repack.lower_bound(np.bincount(sizes, minlength=rule.length + 1)))
    assert least <= check(rows, got, rule) <= least + (1 if rule.group > 40 else 4)


def test_exchange_saves_sequences(spark):
    """Seventeen partitions waste more than one; the rounds come close to best fit over the whole table."""
    rng = random.Random(4)
    rows = [(i, "ab " * rng.choice([3, 5, 9, 14, 20, 30, 41])) for i in range(3200)] + [(9, "ab ab")] * 200
    rule = repack.Repacking(length=64, group=200, exchange=4)
    parts = repack.staging.stage(repack.pieces(frame(spark, rows).repartition(5), PATH, rule), "test-pieces")
    got = repack.place(parts, rule).collect()
    least = repack.bound(parts, rule)
    alone = 0
    for _, own in itertools.groupby(sorted((r.key % 17, -r.length) for r in got), lambda x: x[0]):
        alone += repack.best_fit(-np.array([x for _, x in own]), rule.length).max() + 1
    whole = int((np.array([r.length for r in got]) == rule.length).sum())
    single = repack.best_fit(np.sort([r.length for r in got if r.length < rule.length])[::-1], rule.length).max() + 1 + whole
    used = check(rows, got, rule)
    assert least <= used <= single + 2 < alone


def test_bounds_hold_and_best_fit_fits():
    rng = np.random.default_rng(1)

    def optimum(items, capacity):
        best = len(items)

        def go(i, bins):
            nonlocal best
            if len(bins) >= best:
                return
            if i == len(items):
                best = len(bins)
                return
            for k in {b: k for k, b in enumerate(bins)}.values():
                if bins[k] + items[i] <= capacity:
                    go(i + 1, [*bins[:k], bins[k] + items[i], *bins[k + 1 :]])
            go(i + 1, [*bins, items[i]])

        go(0, [])
        return best

    for _ in range(150):
        capacity = int(rng.integers(2, 40))
        items = np.sort(rng.integers(1, capacity + 1, int(rng.integers(1, 9))))[::-1]
        bound = repack._rounded(repack.lower_bound(np.bincount(items, minlength=capacity + 1)))
        bins = repack.best_fit(items, capacity)
        assert bound <= optimum(items.tolist(), capacity) <= bins.max() + 1
        assert np.bincount(bins, items).max() <= capacity


def test_large_items_are_certified():
    """Where no two fit, the share of space says little and the other functions say all."""
    counts = np.zeros(101, np.int64)
    counts[51] = 10
    assert repack._rounded(repack.lower_bound(counts)) == 10
    counts[:] = 0
    counts[34] = 9  # two of a sequence at most
    assert repack._rounded(repack.lower_bound(counts)) == 5


def test_other_columns_and_nothing(spark):
    docs = documents(spark, 2, 30)
    wide = docs.withColumn("key", F.lit(1)).withColumn("length", F.lit("x")).withColumn("open", F.lit(None)).withColumn("offset", F.lit(2))
    rule = repack.Repacking()
    check([tuple(r) for r in docs.collect()], repack.pack(wide, PATH, rule).collect(), rule)
    assert repack.pack(docs.limit(0), PATH).count() == 0
