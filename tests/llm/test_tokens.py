"""Token operators beside the libraries whose results they must give."""

import base64
import hashlib
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from seriesforge.llm import bpe, idfiles, packing
from seriesforge.sources import staging
from tests.llm.common import documents, frame

RANKS = P.path("byte_bpe_multi_50k.tiktoken")


def library(name):
    tokenizer = Tokenizer.from_file(P.path(name))
    tokenizer.encode_special_tokens = True
    return tokenizer


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_bpe_equals_the_library(spark):
    with open(RANKS, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    want = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs = documents(spark)
    rows = bpe.decode(bpe.encode(docs, RANKS), RANKS).collect()
    assert len(rows) == docs.count()
    for row in rows:
        assert row.ids == want.encode_ordinary(row.text or "")
        assert bytes(row.decoded) == (row.text or "").encode()
    for row in bpe.digests(bpe.decode(bpe.encode(docs, RANKS), RANKS)).collect():
        ids = want.encode_ordinary(row.text or "")
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256((row.text or "").encode()).hexdigest()


def test_bpe_merges_that_compete():
    """Tokens whose best split and rank order disagree, against the plain greedy rule."""
    tokens = [bytes([b]) for b in range(256)] + [b"ab", b"bc", b"cd", b"abc", b"bcd", b"aa", b"aaa", b"abcd", b"dd", b"cdd"]
    for order in (tokens, tokens[:256] + tokens[256:][::-1]):
        merges = bpe.Merges(b"\n".join(base64.b64encode(t) + b" %d" % i for i, t in enumerate(order)))
        ranks = {t: i for i, t in enumerate(order)}
        for word in (b"abcd", b"aaaaaab", b"abcdabcddd", b"bcdcdd", b"aabbccdd" * 50):
            parts = [bytes([b]) for b in word]
            while True:
                found = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
                if not found:
                    break
                i = min(found)[1]
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            assert merges.replay([b"zz", word])[1] == [ranks[p] for p in parts]


def test_bpe_keeps_other_columns(spark):
    docs = frame(spark, [(1, "a b", [9]), (2, None, None)], "doc_id long, text string, ids array<int>")
    assert [(r.doc_id, len(r.ids)) for r in bpe.encode(docs, RANKS).collect()] == [(1, 2), (2, 0)]
    assert bpe.encode(docs.limit(0), RANKS).count() == 0


@pytest.mark.parametrize("partitions", [1, 5])
def test_packing_holds_every_id_once(spark, partitions):
    docs = documents(spark, seed=2, n=400).repartition(partitions)
    want = library("word_bpe_49k.json")
    rule = packing.Packing(length=64, stream_ids=3000)
    ids = {}
    for row in docs.collect():
        ids.setdefault(row.doc_id, []).append(want.encode(row.text or "", add_special_tokens=False).ids + [1])
    pieces = packing.pack(docs, P.path("word_bpe_49k.json"), rule=rule).collect()
    for doc_id, lists in ids.items():
        own = [p for p in pieces if p.doc_id == doc_id]
        assert sum(p.length for p in own) == sum(map(len, lists))
        assert all(p.doc_tokens == len(lists[0]) for p in own)
        assert all(p.ids_crc32 == crc(lists[0][p.start : p.start + p.length]) for p in own)
    by_sequence = {}
    for p in pieces:
        by_sequence.setdefault(p.sequence_id, []).append(p)
    padding = 0
    for own in by_sequence.values():
        own.sort(key=lambda p: p.offset)
        ends = np.cumsum([p.length for p in own]).tolist()
        assert [p.offset for p in own] == [0, *ends[:-1]] and ends[-1] <= rule.length
        padding += 0 if ends[-1] & (ends[-1] - 1) == 0 else rule.length - ends[-1]
    assert padding < 0.08 * sum(p.length for p in pieces)
    assert packing.pack(docs.limit(0), P.path("word_bpe_49k.json")).count() == 0


def test_packing_cuts_are_the_cheapest():
    rng = np.random.default_rng(5)
    for _ in range(60):
        rule = packing.Packing(length=int(rng.integers(3, 20)), stride=2, cut_penalty=float(rng.integers(0, 9)))
        ends = np.cumsum(rng.integers(1, 30, rng.integers(1, 6)))
        places, cost = packing.candidates(ends, np.unique(rng.integers(1, ends[-1] + 1, 4)), rule)

        def window(size):
            return 0 if size & (size - 1) == 0 else rule.length - size

        best = {0: 0.0}
        for j in range(1, len(places)):
            steps = [best[i] + window(int(places[j] - places[i])) for i in range(j) if places[j] - places[i] <= rule.length]
            best[j] = min(steps) + cost[j]
        path = packing.cuts(places, cost, rule)
        where = {int(p): i for i, p in enumerate(places)}
        total = sum(window(int(b - a)) + cost[where[int(b)]] for a, b in zip(path[:-1], path[1:]))
        assert path[0] == 0 and path[-1] == ends[-1] and np.diff(path).max() <= rule.length
        assert total == pytest.approx(best[len(places) - 1])


def test_id_files_round_trip(spark):
    docs = documents(spark, seed=3).repartition(4)
    want = library("byte_bpe_50k.json")
    rows = sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    encoded = [want.encode(r.text or "", add_special_tokens=False).ids + [0] for r in rows]
    files = idfiles.write(docs, P.path("byte_bpe_50k.json"), staging.fresh_path(spark, "ids"))
    assert files.width == 2
    flat = np.concatenate([idfiles.maps(files, name)[0] for name, _, _ in files.parts])
    assert flat.tolist() == [i for ids in encoded for i in ids]
    starts = np.cumsum([0] + [len(ids) for ids in encoded])
    got = sorted(map(tuple, idfiles.read(spark, files).collect()), key=lambda r: r[1])
    assert got == [(r.doc_id, s, len(ids), crc(ids)) for r, s, ids in zip(rows, starts.tolist(), encoded)]


def test_id_files_of_nothing(spark):
    empty = frame(spark, [])
    assert idfiles.write_and_read(empty, P.path("byte_bpe_50k.json")).count() == 0
