"""Personal data by weak supervision, with DataFrame expressions only.

Candidates are the base spans (`BASE`, checked), base matches that fail their check, and spans of wider
patterns (`WIDER`). Labelers vote +1, 0 (no opinion) or -1 on each: its shape, a check of its digits or its last
domain, a gazetteer, words before it that speak for or against, its neighbours, and base spans near it. None of
them votes on what it has not looked at. Expectation-maximisation over the counted vote patterns estimates how
reliable each labeler is and how likely each pattern is personal data; it starts from what is known of the labelers
(`START`) and of wider spans (`PRIOR`: few are personal data, so a pattern without a vote for it does not win by default).
With those probabilities as soft labels a naive Bayes span classifier over features of the span and its surroundings
is trained, apart for wider spans and for matches of base patterns, and decides about candidates that are not base spans. Base spans always stay.

Sizes: vote patterns (at most 6 * 3**6) and feature values (under 100) are counts over all documents
and the only rows that reach the driver. Nothing is shuffled but those counts.

Offsets count code points, ends are exclusive. A null or empty text has no spans. Repeated rows are
treated alike; other columns are kept by `redact`. Without any candidate the model adds nothing. Patterns
use possessive quantifiers, so that Java matches texts of any length without recursion.
"""

from __future__ import annotations

import math
from collections import defaultdict
from dataclasses import dataclass, field
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesforge.sources import staging

KINDS = ("email", "ip", "card", "phone")

_LOCAL = "A-Za-z0-9._%+-"
#: The base patterns. A start inside a run of the first class cannot match when the run's start did not,
#: unless a match has just ended there (\\G); skipping it keeps the search linear.
BASE = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
WIDER = {
    "email": rf"(?<![{_LOCAL}])[{_LOCAL}]++ ?[\[(] ?at ?[\])] ?[A-Za-z0-9-]++(?: ?(?:\.|[\[(] ?dot ?[\])]) ?[A-Za-z0-9-]++)++",
    "phone": r"(?<![0-9+])(?:\([0-9]{3}\)[ -]?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])",
}
#: What must occur, any of it, for a pattern to match at all; a cheap look before the expensive one.
_NEEDS = {"email": "@", "ip": ".", "phone": "+"}
_WIDER_NEEDS = {"email": "(["}
_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"

#: Fixed values of the labelers: endings of mail hosts, and words before a span that speak for or against it.
GAZETTEER = {
    "email": r"(?i)\.(?:com|org|net|edu|gov|info|io|de|fr|es|it|uk|eu|ch|at|nl)$",
    "ip": r"^(?!0|127\.|255\.)[0-9]",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[47]|6(?:011|5))",
    "phone": r"^\+?(?:1|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|7|8[1246]|9[0-58])[\x20().-]|^\(?[2-9][0-9]{2}\)?[\x20.-]",
}
FOR = {
    "email": r"(?i)(?:e-?mail|mail|contact|kontakt|correo|courriel|write|to|from)\W{0,3}$",
    "ip": r"(?i)(?:\bip|address|adresse|direcci[oó]n|host|server|client)\W{0,3}$",
    "card": r"(?i)(?:card|karte|tarjeta|carte|visa|mastercard|amex|payment)\W{0,3}(?:n[ro]\.?|number|nummer)?\W{0,3}$",
    "phone": r"(?i)(?:phone|tel|telefon|tel[eé]fono|t[eé]l[eé]phone|call|mobile|mobil|fax|ruf|llame)\W{0,3}$",
}
AGAINST = r"(?i)(?:version|license|order|invoice|isbn|issn|serial|part|item|model|build|release|id|no\.|nr\.|§|page|section|chapter|figure)\W{0,3}$"
#: What a wider match must be like to pass its check: a last domain of letters; an area code and an exchange of a numbering plan.
WIDER_CHECK = {"email": r"(?:\.|dot ?[\])]) ?[A-Za-z]{2,}$", "phone": r"^\(?[2-9][0-9]{2}\)?[ .-]?[2-9][0-9]{2}[ .-]"}
#: Code points before a span that are read, after it, and around it in which a base span counts as near.
BEFORE, AFTER, NEAR = 24, 1, 60

VOTES = ("v_pattern", "v_check", "v_gazetteer", "v_context", "v_around", "v_near")
FEATURES = ("kind", "size", "digits", "groups", "left", "right", "before", "near")

#: Where estimation starts: P(vote +1 | personal data), P(vote +1 | not), of a labeler that votes.
START = {"v_pattern": (0.9, 0.5), "v_check": (0.97, 0.5), "v_gazetteer": (0.9, 0.6), "v_context": (0.95, 0.1), "v_around": (0.95, 0.7), "v_near": (0.9, 0.4)}
#: Share of personal data among the candidates of a kind at the start; "~" marks the wider pattern. Any other kind: a half.
PRIOR = {"email~": 0.3, "phone~": 0.1}
#: Votes that the start counts for when the reliability of a labeler is estimated.
TRUST = 10

_BLOCK = 256


def _before_sum(sizes: Column, i: Column) -> Column:
    """Sum of the first i sizes, from sums of whole blocks and a rest; `sizes` has fields `blocks` and `each`."""
    rest = F.slice(sizes["each"], F.floor(i / _BLOCK).cast("int") * _BLOCK + 1, (i % _BLOCK).cast("int"))
    return F.get(sizes["blocks"], F.floor(i / _BLOCK).cast("int")) + F.aggregate(rest, F.lit(0), lambda a, x: a + x)


def _found(df: DataFrame, text: str, out: str, pattern: str, need: str | None) -> DataFrame:
    """`df` with `out`: array of (start, stop, piece) of the matches, from left to right.

    Splitting at the matches gives the gaps between them; starts are running sums of both lengths.
    """
    source = F.when(reduce(or_, [F.contains(F.col(text), F.lit(c)) for c in need]), F.col(text)) if need else F.col(text)
    df = df.withColumn("_m", F.coalesce(F.regexp_extract_all(source, F.lit(pattern), F.lit(0)), F.array().cast("array<string>")))
    gaps = F.when(F.size("_m") > 0, F.transform(F.split(F.col(text), pattern, -1), lambda x: F.length(x)))
    df = df.withColumn("_g", gaps)
    df = df.withColumn("_each", F.when(F.size("_m") > 0, F.zip_with(F.slice("_g", F.lit(1), F.size("_m")), "_m", lambda g, m: g + F.length(m))))
    starts = F.sequence(F.lit(0), F.floor((F.size("_m") - 1) / _BLOCK).cast("int"))
    blocks = F.transform(starts, lambda b: F.aggregate(F.slice("_each", F.lit(1), b * _BLOCK), F.lit(0), lambda a, x: a + x))
    df = df.withColumn("_sizes", F.when(F.size("_m") > 0, F.struct(F.col("_each").alias("each"), blocks.alias("blocks"))))

    def span(piece, i):
        start = _before_sum(F.col("_sizes"), i) + F.get(F.col("_g"), i)
        return F.struct(start.cast("int").alias("start"), (start + F.length(piece)).cast("int").alias("stop"), piece.alias("piece"))

    return df.withColumn(out, F.when(F.size("_m") > 0, F.transform("_m", span)).otherwise(F.transform("_m", lambda m: F.struct(F.lit(0).alias("start"), F.lit(0).alias("stop"), m.alias("piece"))))).drop("_m", "_g", "_each", "_sizes")


def _digits(piece: Column) -> Column:
    return F.regexp_replace(piece, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    turned = F.reverse(digits)

    def weighed(i):
        twice = F.substring(turned, i, F.lit(1)).cast("int") * (2 - i % 2)
        return F.when(twice > 9, twice - 9).otherwise(twice)

    total = F.aggregate(F.transform(F.sequence(F.lit(1), F.length(digits)), weighed), F.lit(0), lambda a, x: a + x)
    return F.when(F.length(digits).between(12, 19), total % 10 == 0).otherwise(F.lit(False))


def passes(kind: str, piece: Column) -> Column:
    """Whether a base match passes its check."""
    if kind == "ip":
        return piece.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$")
    if kind == "card":
        return _luhn(_digits(piece))
    if kind == "phone":
        return F.length(_digits(piece)).between(9, 15)
    return F.lit(True)


def _sign(good: Column, bad: Column) -> Column:
    return F.when(bad, F.lit(-1)).when(good, F.lit(1)).otherwise(F.lit(0)).cast("tinyint")


def _neighbour(c: Column) -> Column:
    return F.when(c == "", "edge").when(c.rlike(r"\s"), "blank").when(c.rlike("[0-9]"), "digit").when(c.rlike("[A-Za-z]"), "letter").otherwise("other")


def _bucket(n: Column, *limits: int) -> Column:
    found = F.lit(f"over {limits[-1]}")
    for limit in reversed(limits):
        found = F.when(n <= limit, F.lit(f"to {limit}")).otherwise(found)
    return found


def _candidate(text: str, kind: str, span: Column, is_base: Column, shape: int, check: Column, wide: bool, near: Column) -> Column:
    """A span with its votes and features; `shape` and `check` are the votes on its shape and its check."""
    piece = span["piece"]
    before = F.substring(F.col(text), F.greatest(span["start"] - BEFORE + 1, F.lit(1)), F.least(span["start"], F.lit(BEFORE)))
    left, right = F.substring(before, -1, 1), F.substring(F.col(text), span["stop"] + 1, F.lit(AFTER))
    digits = F.length(_digits(piece))
    speaks_for, against = before.rlike(FOR[kind]), before.rlike(AGAINST)
    glued = left.rlike("[A-Za-z0-9_/=]") | right.rlike("[A-Za-z0-9_/=]")
    return F.struct(
        span["start"].alias("start"),
        F.lit(KINDS.index(kind)).alias("rank"),
        span["stop"].alias("stop"),
        F.lit(kind).alias("kind"),
        is_base.alias("base"),
        F.lit(wide).alias("wide"),
        F.struct(
            F.lit(shape).cast("tinyint").alias("v_pattern"),
            check.cast("tinyint").alias("v_check"),
            _sign(piece.rlike(GAZETTEER[kind]), F.lit(False)).alias("v_gazetteer"),
            _sign(speaks_for, against).alias("v_context"),
            _sign(~glued, glued).alias("v_around"),
            _sign(near, F.lit(False)).alias("v_near"),
        ).alias("votes"),
        F.struct(
            F.lit(kind).alias("kind"),
            _bucket(F.length(piece), 8, 12, 16, 20, 30).alias("size"),
            _bucket(digits, 0, 4, 8, 11, 15, 19).alias("digits"),
            _bucket(F.size(F.split(piece, "[^A-Za-z0-9]+")), 1, 2, 3, 4, 5).alias("groups"),
            _neighbour(left).alias("left"),
            _neighbour(right).alias("right"),
            F.when(against, "against").when(speaks_for, "for").otherwise("neither").alias("before"),
            F.when(near, "yes").otherwise("no").alias("near"),
        ).alias("features"),
    )


def _judged(kind: str) -> Column:
    """Base matches of a kind, each with the result of its check."""
    judged = F.transform(f"_b_{kind}", lambda s: F.struct(s.alias("s"), passes(kind, s["piece"]).alias("good")))
    if kind == "card":  # short numbers are everywhere and nobody's card
        judged = F.filter(judged, lambda x: F.length(_digits(x["s"]["piece"])) >= 12)
    return judged


def _of_base(text: str, kind: str) -> Column:
    """Base matches: all have the shape; the check votes where there is one."""
    checked = (lambda x: F.lit(0)) if kind == "email" else (lambda x: _sign(x["good"], ~x["good"]))
    return F.transform(f"_j_{kind}", lambda x: _candidate(text, kind, x["s"], x["good"], 1, checked(x), False, F.lit(False)))


def _of_wider(text: str, kind: str) -> Column:
    """Matches of the wider pattern that touch no base span. Words for signs are a shape of their own; three groups of digits are not."""
    within = lambda s, more: F.exists("_base", lambda b: (b["s"]["start"] < s["stop"] + more) & (s["start"] - more < b["s"]["stop"]))
    apart = F.filter(f"_w_{kind}", lambda s: ~within(s, 0))
    passed = lambda s: s["piece"].rlike(WIDER_CHECK[kind])
    return F.transform(apart, lambda s: _candidate(text, kind, s, F.lit(False), int(kind == "email"), _sign(passed(s), ~passed(s)), True, within(s, NEAR)))


def candidates(docs: DataFrame, text: str = "text", out: str = "_spans") -> DataFrame:
    """`docs` with its candidate spans: (start, rank, stop, kind, base, votes, features), sorted."""
    df = docs
    for kind, pattern in BASE.items():
        df = _found(df, text, f"_b_{kind}", pattern, _NEEDS.get(kind))
        df = df.withColumn(f"_j_{kind}", _judged(kind)).drop(f"_b_{kind}")
    df = df.withColumn("_base", F.concat(*[F.filter(f"_j_{kind}", lambda x: x["good"]) for kind in BASE]))
    for kind, pattern in WIDER.items():
        df = _found(df, text, f"_w_{kind}", pattern, _WIDER_NEEDS.get(kind))
    parts = [_of_base(text, kind) for kind in BASE] + [_of_wider(text, kind) for kind in WIDER]
    return df.withColumn(out, F.sort_array(F.concat(*parts))).drop("_base", *[f"_{x}_{k}" for x in "jw" for k in KINDS])


@dataclass
class Model:
    """Log odds of the span classifier, apart for wider spans (True) and matches of base patterns (False): a start, and
    a weight for every value of every feature."""

    start: dict[bool, float] = field(default_factory=lambda: {False: -10.0, True: -10.0})
    weights: dict[bool, dict[str, dict[str, float]]] = field(default_factory=dict)
    reliability: dict[str, dict[str, dict[int, tuple[float, float]]]] = field(default_factory=dict)

    def score(self, span: Column) -> Column:
        def weight(wide, name):
            table = self.weights.get(wide, {}).get(name)
            if not table:
                return F.lit(0.0)
            known = F.create_map(*[F.lit(x) for pair in sorted(table.items()) for x in pair])
            return F.coalesce(F.try_element_at(known, span["features"][name]), F.lit(0.0))

        total = {wide: reduce(lambda a, name: a + weight(wide, name), FEATURES, F.lit(self.start[wide])) for wide in (False, True)}
        return F.when(span["wide"], total[True]).otherwise(total[False])


def expectation_maximisation(counts: dict[tuple, int], rounds: int = 40) -> tuple[dict[tuple, float], dict]:
    """Probability that each pattern (kind, votes...) is personal data, and P(vote | class) of every labeler by kind.

    A labeler that abstains (0) says nothing. Starts from `START` and `PRIOR`; a labeler with few votes keeps what it
    starts with, and none is ever taken to be right less often than wrong, so the classes cannot change places. The
    share of personal data is estimated by kind, but stays `PRIOR` for wider spans without a word or a base span near.
    """
    told = [1 + VOTES.index(name) for name in ("v_context", "v_near")]

    def group(pattern: tuple) -> tuple:
        return pattern[0], pattern[0] in PRIOR and not any(pattern[i] for i in told)

    kinds = {pattern[0] for pattern in counts}
    table = {kind: {name: {1: (yes, no), -1: (1 - yes, 1 - no)} for name, (yes, no) in START.items()} for kind in kinds}
    prior = {group(pattern): PRIOR.get(pattern[0], 0.5) for pattern in counts}
    believed: dict[tuple, float] = {}
    for _ in range(rounds):
        for pattern in counts:
            kind = pattern[0]
            odds = math.log(prior[group(pattern)] / (1 - prior[group(pattern)]))
            odds += sum(math.log(table[kind][name][v][0] / table[kind][name][v][1]) for name, v in zip(VOTES, pattern[1:]) if v)
            believed[pattern] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
        for kind in kinds:
            own = [(p, believed[p], n) for p, n in counts.items() if p[0] == kind]
            if (kind, False) in prior:
                inside = [(b, n) for p, b, n in own if not group(p)[1]]
                start = PRIOR.get(kind, 0.5)
                prior[kind, False] = min(0.99, max(0.01, (TRUST * start + sum(b * n for b, n in inside)) / (TRUST + sum(n for _, n in inside))))
            for place, name in enumerate(VOTES, 1):
                up = []
                for start, belief in zip(START[name], (lambda b: b, lambda b: 1 - b)):
                    voted = {v: sum(belief(b) * n for p, b, n in own if p[place] == v) for v in (-1, 1)}
                    up.append((TRUST * start + voted[1]) / (TRUST + voted[1] + voted[-1]))
                if up[0] < up[1]:
                    up = [sum(up) / 2] * 2
                table[kind][name] = {1: tuple(up), -1: tuple(1 - x for x in up)}
    return believed, table


def train(spans: DataFrame, column: str = "_spans") -> Model:
    """The model of all candidate spans of all documents."""
    group = F.when(F.col("s.wide"), F.concat("s.kind", F.lit("~"))).otherwise(F.col("s.kind")).alias("kind")
    rows = spans.select(F.explode(column).alias("s")).select(group, "s.wide", "s.votes.*", F.col("s.features").alias("f"))
    counted = rows.groupBy("kind", *VOTES).count().collect()  # at most 6 * 3**6 rows
    if not counted:
        return Model()
    believed, table = expectation_maximisation({tuple(r)[:-1]: r["count"] for r in counted})
    key = F.concat_ws(",", "kind", *VOTES)
    belief = F.create_map(*[F.lit(x) for p, b in sorted(believed.items()) for x in (",".join(map(str, p)), b)])
    features = F.explode(F.array(*[F.struct(F.lit(name).alias("feature"), F.col("f")[name].alias("value")) for name in FEATURES])).alias("x")
    # Per pattern, not per span: the soft label is a function of the pattern.
    sums = rows.select(key.alias("key"), "wide", features).groupBy("key", "wide", "x.feature", "x.value").count()
    soft = F.element_at(belief, F.col("key"))
    per_value = sums.groupBy("wide", "feature", "value").agg(F.sum(soft * F.col("count")).alias("yes"), F.sum((1 - soft) * F.col("count")).alias("no")).collect()
    model = Model(reliability=table)
    for wide in {r.wide for r in per_value}:
        by_feature = defaultdict(dict)
        for r in per_value:
            if r.wide == wide:
                by_feature[r.feature][r.value] = (r.yes, r.no)
        yes, no = (sum(x[i] for x in by_feature["kind"].values()) for i in (0, 1))
        model.start[wide] = math.log((yes + 1) / (no + 1))
        model.weights[wide] = {
            name: {value: math.log((a + 1) / (yes + len(values))) - math.log((b + 1) / (no + len(values))) for value, (a, b) in values.items()}
            for name, values in by_feature.items()
        }
    return model


def decide(spans: DataFrame, model: Model, column: str = "_spans") -> DataFrame:
    """`spans` with only base spans and those the classifier takes in `column`."""
    return spans.withColumn(column, F.filter(column, lambda s: s["base"] | (model.score(s) > 0)))


def listed(spans: Column) -> Column:
    """kind:start:end of every span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with every span of its text replaced by its kind in angle brackets.

    The rows are stored once with their candidates: training reads the candidates, the decision all columns.
    """
    hidden = docs.select(*[F.col(f"`{c}`").alias(f"_own_{i}") for i, c in enumerate(docs.columns)])
    own = f"_own_{docs.columns.index(text)}"
    found = staging.stage(candidates(hidden, own), "pii-spans")
    decided = decide(found, train(found))

    def part(s, i):
        reached = F.coalesce(F.array_max(F.transform(F.slice("_spans", F.lit(1), i), lambda p: p["stop"])), F.lit(0))
        gap = F.greatest(s["start"] - reached, F.lit(0))
        return F.concat(F.substring(F.col(own), reached + 1, gap), F.lit("<"), F.upper(s["kind"]), F.lit(">"))

    last = F.array_max(F.transform("_spans", lambda s: s["stop"]))
    tail = F.substring(F.col(own), last + 1, F.length(own))
    clean = F.when(F.size("_spans") > 0, F.concat(F.array_join(F.transform("_spans", part), ""), tail)).otherwise(F.col(own))
    return decided.select(*[(clean if f"_own_{i}" == own else F.col(f"_own_{i}")).alias(c) for i, c in enumerate(docs.columns)])


def _count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def digests(spans: DataFrame, column: str = "_spans") -> DataFrame:
    """Counts and a digest of the base spans, and all spans as text."""
    base = F.filter(column, lambda s: s["base"])
    return spans.select(
        *[c for c in spans.columns if c != column],
        *[_count(base, kind).alias(f"n_{kind}") for kind in KINDS],
        F.sha2(listed(base), 256).alias("base_sha256"),
        listed(F.col(column)).alias("spans"),
    )
