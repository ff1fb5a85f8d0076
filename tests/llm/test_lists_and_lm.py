"""URL lists beside plain Python; held-out accuracy of the language models."""

import math
import random
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from seriesforge.llm import lm, queries, url_lists
from tests.llm.common import ODD_TEXTS, frame

SF_DIR = "/root/testdata/sf0.001"


def test_lists_equal_plain_python(spark):
    rng, day = random.Random(11), datetime(2024, 1, 1)
    keys = ["a.com", "x.a.com", "b.org", "y.x.a.com", "c.net"]
    entries = [(rng.choice(["allow", "bad", "worse"]), rng.choice(keys), rng.choice(["add", "remove"]), day + timedelta(rng.randrange(30))) for _ in range(60)]
    entries += [(None, "a.com", "add", day), ("bad", None, "add", day), ("bad", "a.com", "add", None)]
    urls = ["http://a.com/", "https://U:p@X.A.com:80/q?a@b", "ftp://y.x.a.com", "http://b.org.", "http://zz.b.org#x", "nothing", None, "http://com/", "http://d.io/"]
    captures = [(i, rng.choice(urls), day + timedelta(rng.randrange(-2, 33))) for i in range(300)] + [(900, urls[0], None)]
    captures.append(captures[0])
    got = url_lists.judge(frame(spark, captures, "page_id long, url string, fetched timestamp"), frame(spark, entries, "list string, key string, action string, at timestamp")).collect()
    assert len(got) == len(captures)
    hosts = dict(zip(urls, ["a.com", "x.a.com", "y.x.a.com", "b.org", "zz.b.org", None, None, "com", "d.io"]))
    held = {}
    for name in ("allow", "bad", "worse"):
        for key in keys:
            own = {}
            for e in entries:
                if e[0] == name and e[1] == key and e[3]:
                    own[e[3]] = max(own.get(e[3], ""), e[2])
            times = sorted(own)
            held[name, key] = [(t, n) for t, n in zip(times, times[1:] + [datetime.max]) if own[t] == "add"]
    for r in got:
        host = hosts[r.url]
        assert r.host == host
        parts = host.split(".") if host else []
        tails = {".".join(parts[i:]) for i in range(max(1, len(parts) - 1))}
        best = [(len(k), n == "allow", n, k, a) for (n, k), spans in held.items() if k in tails for a, b in spans if r.fetched and a <= r.fetched < b]
        want = max(best, default=None)
        assert (r.list, r.key, r.valid_from) == ((want[2], want[3], want[4]) if want else (None, None, None))
        assert r.blocked == bool(want and want[2] != "allow")


def test_addresses_and_clashing_columns(spark):
    day = datetime(2024, 1, 1)
    entries = [("bad", key, "add", day) for key in ("1.2.3.4", "3.4", "[::1]", "Dot.org.", "a.b")]
    urls = {
        "http://1.2.3.4/": "1.2.3.4", "http://9.2.3.4:8/": None, "http://[::1]:80/": "[::1]", "http://u@[::1]": "[::1]", "http://[::2]/x": None,
        "http://x.dot.org./": "dot.org", "http://1.2.3.4.a.b/": "a.b", f"http://{'a' * 100_000}.a.b/": "a.b", "http://[/": None, "http://...": None,
    }
    schema = "page_id long, url string, fetched timestamp, entry string, list int, host int, _own_0 string, _at int"
    captures = frame(spark, [(i, u, day + timedelta(1), "e", 1, 2, "o", 3) for i, u in enumerate(urls)], schema)
    got = url_lists.judge(captures, frame(spark, entries, "list string, key string, action string, at timestamp"))
    assert {r.url: r.key for r in got.collect()} == urls
    assert got.columns == ["page_id", "url", "fetched", "entry", "_own_0", "_at", "host", "blocked", "list", "key", "valid_from"]
    assert {(r.entry, r._own_0, r._at) for r in got.collect()} == {("e", "o", 3)}


def test_list_query_and_empty_tables(spark):
    rows = queries.queries()["op5_url_lists"](spark, SF_DIR).collect()
    assert len({r.page_id for r in rows}) == len(rows) > 0 and {r.blocked for r in rows} == {True, False}
    pages = frame(spark, [], "page_id long, url string, fetched timestamp")
    assert url_lists.judge(pages, url_lists.drawn_entries(pages)).count() == 0


def test_counts_equal_plain_python(spark):
    docs = frame(spark, [(i, t) for i, t in enumerate(ODD_TEXTS + ["a b a b a", "b a"])]).repartition(3)
    models = lm.train(docs, F.col("text").startswith("a b"))
    assert models.totals[0] == 5 and models.pairs[0].sum() == 4
    assert models.pairs[1].sum() == models.totals[1] - sum(bool((t or "").strip()) for t in ODD_TEXTS) - 2
    scored = {r.doc_id: r for r in lm.score(models).collect()}
    assert scored[0].n_tokens == 0 and scored[0].score is None
    wide = docs.withColumn("target", F.lit("x")).withColumn("chunk", F.lit(1)).withColumn("range", F.lit(1)).withColumn("counted", F.lit(0))
    again = {r.doc_id: r for r in lm.score(lm.train(wide, F.col("text").startswith("a b"))).collect()}
    assert again.keys() == scored.keys() and all(again[i][1:] == pytest.approx(scored[i][1:], nan_ok=True) for i in scored if scored[i].score is not None)
    assert lm.score(lm.train(docs.limit(0), F.lit(True))).count() == 0


@pytest.mark.parametrize("fold", [0, 1])
def test_held_out_accuracy(spark, fold):
    """Documents of two word distributions; models see one half, the other half is told apart."""
    rng = random.Random(12)
    good, poor = [f"g{i}" for i in range(80)], [f"p{i}" for i in range(80)]
    rows = [(i, " ".join(rng.choice((good if i % 2 else poor) if rng.random() < 0.5 else good + poor) for _ in range(60))) for i in range(400)]
    docs = frame(spark, rows)
    seen = F.floor(F.col("doc_id") / 2) % 2 == fold
    models = lm.train(docs, F.col("doc_id") % 2 == 1, seen)
    held = [r for r in lm.score(models).collect() if r.doc_id // 2 % 2 != fold]
    ranked = sorted(held, key=lambda r: r.score)
    assert sum((i < len(held) / 2) == (r.doc_id % 2 == 1) for i, r in enumerate(ranked)) >= 0.95 * len(held)


def test_losses_equal_plain_python(spark, monkeypatch):
    """Counts by word and bigram, of more different ones than 2**18 and 2**20 slots would tell apart."""
    monkeypatch.setattr(lm, "CHUNK_BYTES", 3000)
    monkeypatch.setattr(lm, "RANGE_BYTES", 500_000)
    rng = random.Random(13)
    rows = [(i, " ".join(f"w{int(rng.paretovariate(0.5)) % 500_000}" for _ in range(rng.randrange(3, 60)))) for i in range(300)] + [(900, None), (900, None)]
    rows += [(1000 + i, " ".join(f"u{i}x{k}" for k in range(600))) for i in range(1000)]  # 600,000 words of their own
    docs = frame(spark, rows).repartition(4)
    held_out = frame(spark, [(2000, "never seen w1 w2 w1"), (2001, "w1 w1")])
    models = lm.train(docs.union(held_out), F.col("doc_id") % 2 == 1, F.col("doc_id") < 2000)
    plain = {i: (t or "").split() for i, t in rows}
    words, pairs = [Counter(), Counter()], [Counter(), Counter()]
    for i, tokens in plain.items():
        for k in (0, 1) if i % 2 else (1,):
            words[k].update(tokens)
            pairs[k].update(zip(tokens, tokens[1:]))
    assert models.vocabulary == len(words[1]) + 1 and models.pairs[1] == sum(pairs[1].values())
    sums = [sum(c.values()) for c in words]
    plain |= {2000: "never seen w1 w2 w1".split(), 2001: ["w1", "w1"]}
    got = lm.score(models).collect()
    assert sorted(r.doc_id for r in got) == sorted([i for i, _ in rows] + [2000, 2001])
    for r in got:
        tokens = plain[r.doc_id]
        assert r.n_tokens == len(tokens)
        for k, loss in ((0, r.target_loss), (1, r.background_loss)):
            total, n = 0.0, sums[k]
            for v, w in zip([None] + tokens, tokens):
                p = (words[k][w] + lm.ADD) / (n + lm.ADD * models.vocabulary)
                if words[k][v]:
                    p = lm.MIX * pairs[k][v, w] / words[k][v] + (1 - lm.MIX) * p
                total -= math.log(p)
            assert loss is None if not tokens else loss == pytest.approx(total / len(tokens), rel=1e-9)
