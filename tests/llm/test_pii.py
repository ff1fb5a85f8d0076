"""Base spans beside plain Python; what the trained classifier adds."""

import hashlib
import random
import re

import pytest

from seriesforge.llm import pii
from tests.llm.common import ODD_TEXTS, frame

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def good(kind, piece):
    digits = re.sub("[^0-9]", "", piece)
    if kind == "ip":
        return all(int(p) <= 255 for p in piece.split("."))
    if kind == "card":
        doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
        return 12 <= len(digits) <= 19 and sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def plain(text):
    found = [(m.start(), i, m.end(), k) for i, k in enumerate(pii.KINDS) for m in re.finditer(PATTERNS[k], text or "") if good(k, m[0])]
    return sorted(found)


def luhn(rng, n):
    digits = [rng.randrange(10) for _ in range(n - 1)]
    return next(x for x in ("".join(map(str, digits + [c])) for c in range(10)) if good("card", x))


LONG = 3000
#: By the first characters of the long texts below.
LONG_COUNTS = {"a@b.a@": (4500, 0, 0, 0), "a@b.c ": (1500, 0, 0, 0), "1.2.3.": (0, 700, 0, 0), "1.1.1.": (0, 2250, 0, 0)}


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(6)
    texts = ODD_TEXTS + ["".join(rng.choice("ab1@.+- (2)5é\U0001f600") for _ in range(rng.randrange(60))) for _ in range(400)]
    texts += ["".join(rng.choice("0123.") for _ in range(40)) for _ in range(100)]
    texts += [f"ñ pay {luhn(rng, rng.randrange(12, 20))} or call +1 (555) 555-12{i:02d} x@y{i}.com a.b@c.d_e@f.g from 10.0.{i}.255" for i in range(60)]
    texts += ["1" * 30_000, "1 " * 20_000, "a@b." * 9000, "a@b.c " * 1500, "+1" * 9000, "x" * 50_000 + "@", "1." * 9000, "1.2.3.4 " * 700, "00001.0.0.0255 1.2.3.256"]
    texts += [f"please call {200 + i}-555-01{i:02d} today, or mail bob{i} (at) host (dot) com" for i in range(30)]
    return frame(spark, list(enumerate(texts)) + [(None, "a@b.cd"), (None, "a@b.cd")])


@pytest.fixture(scope="module")
def decided(docs):
    found = pii.candidates(docs).cache()
    return pii.decide(found, pii.train(found))


def test_base_spans_equal_plain_python(docs, decided):
    rows = pii.digests(decided).collect()
    assert len(rows) == docs.count()
    for r in rows:
        if len(r.text or "") > LONG:  # plain patterns take quadratic time there
            assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == LONG_COUNTS.get((r.text or "")[:6], (0, 0, 0, 0)), r.text[:20]
            continue
        want = plain(r.text)
        joined = ",".join(f"{k}:{a}:{b}" for a, _, b, k in want)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(w[3] == k for w in want) for k in pii.KINDS], r.text[:200]
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert set(filter(None, joined.split(","))) <= set(r.spans.split(","))


def test_classifier_adds_spans_that_look_right(spark):
    """On ordinary prose; among the random strings above, the trained classifier adds nothing."""
    rows = [(i, f"please call {200 + i}-555-01{i:02d} today, or mail bob{i} (at) host (dot) com") for i in range(30)]
    rows += [(100 + i, f"order {i}{i + 3}4 and +1 (555) 555-12{i:02d} x@y{i}.com junk 4{i:02d}1234567890{i:02d}") for i in range(30)]
    found = pii.candidates(frame(spark, rows))
    for r in pii.decide(found, pii.train(found)).collect():
        kinds = [s.kind for s in r["_spans"] if not s.base]
        assert sorted(kinds) == (["email", "phone"] if r.doc_id < 100 else [])


def test_reliabilities():
    """A labeler that votes at random gets no say; the others do."""
    rng = random.Random(7)
    counts = {}
    for _ in range(5000):
        truth = rng.random() < 0.4
        votes = [(1 if truth else -1) * (1 if rng.random() < 0.9 else -1) for _ in range(4)]
        pattern = ("email", *votes, rng.choice((-1, 1)), 0)
        counts[pattern] = counts.get(pattern, 0) + 1
    believed, table = pii.expectation_maximisation(counts)
    table = table["email"]
    assert table["v_pattern"][1][0] > 0.8 > 0.2 > table["v_pattern"][1][1]
    assert abs(table["v_around"][1][0] - table["v_around"][1][1]) < 0.1
    assert believed[("email", 1, 1, 1, 1, -1, 0)] > 0.9 > 0.1 > believed[("email", -1, -1, -1, -1, 1, 0)]


def added(spark, rows):
    found = pii.candidates(frame(spark, rows))
    return {r.doc_id: [(s.kind, r.text[s.start : s.stop]) for s in r["_spans"] if not s.base] for r in pii.decide(found, pii.train(found)).collect()}


def test_words_before_decide(spark):
    """Numbers of one shape: after "order" they stay, after "call" they go; with no word for them, none goes by default."""
    rows = [(i, f"order 4{i:02d}-234-60{i:02d} shipped") for i in range(40)] + [(100 + i, f"call 6{i:02d}-555-70{i:02d} now") for i in range(40)]
    rows += [(200 + i, f"see x@y{i}.com or +1 (555) 555-12{i:02d}") for i in range(60)]
    got = added(spark, rows)
    assert {i for i, spans in got.items() if spans} == set(range(100, 140))
    parts = [(i, f"serial 400-234-60{i:02d} fits") for i in range(40)] + [(100 + i, f"part 300 234 50{i:02d} fits") for i in range(40)]
    assert not any(added(spark, parts).values())
    assert not any(added(spark, [(i, f"and 400-234-60{i:02d} too") for i in range(60)]).values())


def test_held_out_precision_and_recall(spark):
    """Labelled numbers and addresses among others; some words are missing, some mislead."""
    rng = random.Random(20)
    name = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    number = lambda: f"{rng.randrange(200, 999)}{rng.choice(' .-')}{rng.randrange(200, 999)}{rng.choice('.-')}{rng.randrange(10_000):04d}"
    rows, truth = [], {}
    for i in range(1200):
        personal = rng.random() < 0.5
        if rng.random() < 0.4:
            sign = rng.choice([("(at)", "(dot)"), ("[at]", "[dot]")])
            text = f"{rng.choice(['mail', 'write to', 'contact', 'see'])} {name()} {sign[0]} {name()} {sign[1]} {rng.choice(['com', 'org', 'de'])}"
            text, personal = (text, True) if personal else (f"{name()} (at) {name()} . {rng.randrange(100)}", False)
        else:
            words = ["call", "phone", "tel", "fax", "mobile"] if personal else ["order", "serial", "part", "invoice", "version"]
            text = f"{rng.choice(words) if rng.random() < 0.9 else name()} {number()}"
        if rng.random() < 0.2:
            text += f" or {name()}@{name()}.com"
        rows.append((i, f"{name()} {text} {name()}"))
        truth[i] = personal
    seen, held = pii.candidates(frame(spark, rows[:600])), pii.candidates(frame(spark, rows[600:]))
    got = {r.doc_id for r in pii.decide(held, pii.train(seen)).collect() if any(not s.base for s in r["_spans"])}
    right = {i for i, personal in truth.items() if personal and i >= 600}
    assert len(got & right) >= 0.97 * len(got) and len(got & right) >= 0.85 * len(right)


def test_redaction(spark, docs):
    clashing = docs.selectExpr("doc_id", "text", "1 as _spans", "2 as kind")
    rows = pii.redact(clashing).collect()
    assert pii.redact(clashing).columns == clashing.columns and len(rows) == docs.count()
    for r in rows:
        assert len(r.text or "") > LONG or plain(r.text) == [], r.text[:200]
    kept = {r.doc_id: r.text for r in rows}
    for r in docs.where("doc_id is not null").collect():
        if not re.search(r"[0-9@]", r.text or ""):
            assert kept[r.doc_id] == r.text


def test_empty_table(spark):
    empty = frame(spark, [])
    assert pii.redact(empty).count() == 0
    assert pii.digests(pii.decide(pii.candidates(empty), pii.train(pii.candidates(empty)))).count() == 0
    assert sorted(map(tuple, pii.redact(frame(spark, [(1, None), (2, "clean")])).collect())) == [(1, None), (2, "clean")]


def test_square_brackets_need_no_parenthesis(spark):
    """An address is found whatever other brackets its text has, and then it is redacted."""
    rows = [(i, f"please mail bob{i} [at] host [dot] com today") for i in range(30)]
    rows += [(100 + i, f"order {i}{i + 3}4 and x@y{i}.com junk 4{i:02d}1234567890{i:02d}") for i in range(30)]
    docs = frame(spark, rows)
    found = pii.candidates(docs)
    for r in pii.decide(found, pii.train(found)).where("doc_id < 100").collect():
        assert [(s.kind, r.text[s.start : s.stop]) for s in r["_spans"]] == [("email", f"bob{r.doc_id} [at] host [dot] com")]
    assert not any("host" in r.text for r in pii.redact(docs).collect())
