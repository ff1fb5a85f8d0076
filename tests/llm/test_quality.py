"""Quality counts beside plain Python on words and windows."""

import random
import re
from collections import Counter

from seriesforge.llm import quality
from tests.llm.common import ODD_TEXTS, documents, frame


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    inside = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    seen, repeated = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            repeated += line in seen
            seen.add(line)
    failed = len(words) < 20 or 100 * len(inside) > 30 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), repeated, len(inside), failed


def test_counts_equal_plain_python(spark):
    rng = random.Random(4)
    made = [" ".join(rng.choice("abc") for _ in range(rng.randrange(0, 60))) for _ in range(150)]
    lines = ["\n".join(rng.choice(["x y", " ", "", "x  y", "#z|"]) for _ in range(rng.randrange(0, 12))) for _ in range(150)]
    docs = documents(spark).union(frame(spark, list(enumerate(made + lines, 1000))))
    rows = quality.measure(docs).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == plain(r.text)
        assert not (r.kept and r.base_failed)


def test_verdicts(spark):
    rng = random.Random(5)
    clean = " ".join(f"w{rng.randrange(10**6)}" for _ in range(300))
    half = "\n".join(["this very line comes back all the time"] * 30 + [f"{i} {rng.random()} fresh" for i in range(30)])
    docs = frame(spark, [(1, clean), (2, clean + " " + clean), (3, half), (4, None), (5, clean)])
    assert sorted(r.doc_id for r in quality.keep_good(docs).collect()) == [1, 5]


def test_clashing_names_and_empty_tables(spark):
    docs = frame(spark, [(1, t, i, "x") for i, t in enumerate(ODD_TEXTS)], "doc_id long, text string, n_words int, kept string")
    assert quality.keep_good(docs).columns == docs.columns
    assert quality.measure(docs).where("n_words is null").count() == 0
    assert quality.measure(docs.limit(0)).count() == 0 and quality.keep_good(docs.limit(0)).count() == 0
