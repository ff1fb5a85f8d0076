"""Rule cells, and rule evaluation against a plain loop."""

import random

import pytest
from pyspark.sql import functions as F

from seriesforge.errors import SubmissionError
from seriesforge.model import DIMENSIONS
from seriesforge.operators import disclosure, rules, validation
from seriesforge.plans import testbed
from tests import scenario

WIDE = "`Check No` string, Description string, Dimensions1 string, Aggregate_to_check1 string, Calculation string, c1 string, c2 string"


def parse(spark, *rows):
    found = rules.parse(spark.createDataFrame(list(rows), WIDE)).collect()
    return {r["check_no"]: (r["dims"], r["aggregate"], r["components"]) for r in found}


def test_cells(spark):
    got = parse(
        spark,
        (" R1 ", None, "5 and 6", "TO1:A", None, "[ISO:D]", " UN9 : U2 "),
        ("R2", "x", "10.0", "A", None, "..", "N"),
        ("R3", "x", "5, 12, 6", "TO1:A", None, "TO3:F", "TO1"),
    )
    two = ["L_DENOM", "L_CURR_TYPE"]
    assert got == {
        "R1": (two, dict(zip(two, ("TO1", "A"))), [dict(zip(two, ("ISO", "D"))), dict(zip(two, ("UN9", "U")))]),
        "R2": (["L_CP_SECTOR"], {"L_CP_SECTOR": "A"}, [{"L_CP_SECTOR": "N"}]),
        "R3": (two, dict(zip(two, ("TO1", "A"))), [dict(zip(two, ("TO3", "F")))]),
    }


def test_unusable_rules_are_left_out(spark):
    assert parse(
        spark,
        (None, "no number", "5", "A", None, "B", None),
        ("no dims", "", "none", "A", None, "B", None),
        ("far dims", "", "12", "A", None, "B", None),
        ("blank total", "", "10", " … ", None, "B", None),
        ("total misfit", "", "5 and 6", "A", None, "B:C", None),
        ("no part", "", "10", "A", None, "..", ""),
    ) == {}


def test_a_dimension_named_twice_keeps_the_last_code(spark):
    assert parse(spark, ("R", "", "5 and 5", "A:B", None, "C:D", None))["R"][1:] == ({"L_DENOM": "B"}, [{"L_DENOM": "D"}])


def naive(rows, book):
    """The checks as nested loops."""
    failed = {}
    for check, dims, total, parts in book:
        groups = {}
        for row in rows:
            codes = dict(zip(DIMENSIONS, row[0].split(".")))
            context = tuple(codes[d] for d in DIMENSIONS if d not in dims) + row[1:3]
            groups.setdefault(context, []).append((codes, row[3]))
        fits = lambda codes, term: all(c == "ISO" or codes[d] == c for d, c in term.items())
        for context, members in groups.items():
            left = [(c, v) for c, v in members if fits(c, total)]
            right = [v for term in parts for c, v in members if fits(c, term)]
            if left and right and abs(sum(v or 0 for _, v in left) - sum(v or 0 for v in right)) >= 1e-4:
                for codes, _ in left:
                    failed.setdefault((codes["L_REP_CTY"], context[-2]), set()).add(check)
    return {batch: ",".join(sorted(checks)) for batch, checks in failed.items()}


def test_thousands_of_rules(spark):
    """2,000 random rules of many shapes beside nested loops; no row is multiplied before it has found its terms."""
    chance = random.Random(9)
    values = {"L_DENOM": ["TO1", "USD", "EUR", "UN9", "JPY"], "L_CURR_TYPE": list("ADFU"), "L_REP_CTY": ["CA", "US", "GB", "NO"], "L_CP_SECTOR": list("ABNM"), "L_POSITION": list("CL"), "L_INSTR": list("ADG")}
    names = list(values)
    rows = []
    for _ in range(400):
        codes = dict(zip(DIMENSIONS, "Q S C A TO1 A 5J A CA A 5J".split())) | {d: chance.choice(v + ["Z"]) for d, v in values.items()}
        rows.append((".".join(codes.values()), "2026-Q1", "LBSR", float(chance.randrange(5))))
    table = []
    for n in range(2000):
        dims = sorted(chance.sample(names, chance.randrange(1, 4)), key=DIMENSIONS.index)
        cell = lambda: ":".join(chance.choice(values[d] + ["ISO"]) for d in dims)
        table.append((f"R{n:04d}", "", " and ".join(str(DIMENSIONS.index(d) + 1) for d in dims), cell(), "", *(cell() for _ in range(4))))
    schema = WIDE.rsplit(", c1", 1)[0] + "".join(f", p{i} string" for i in range(4))
    wide = spark.createDataFrame(table, schema)
    book = rules.load(wide)
    assert book.terms.count() == 10_000 and book.words == 157
    batch = spark.createDataFrame(rows, "TIME_SERIES_CODE string, DATE string, IBS_AGG string, OBS_VALUE double").repartition(4)
    assert validation.with_terms(validation._clean_dimensions(batch), book).count() == 400
    got = validation.verdicts(batch, book).collect()
    parsed = [(r["check_no"], r["dims"], r["aggregate"], r["components"]) for r in rules.parse(wide).collect()]
    assert {(r["L_REP_CTY"], r["DATE"]): r["FAILED_RULE_ID"] for r in got} == naive(rows, parsed)


BOOKS = {
    "currency and sector": [
        ("C1", "5 and 6", "TO1:A", ["[ISO:D]", "TO1:F", "UN9:U"]), ("C2", "5 and 6", "TO1:F", ["USD:F", "EUR:F"]),
        ("C3", "10", "A", ["B", "N"]), ("C3", "10", "N", ["B"])],
    "across reporters": [("X1", "9", "CA", ["US", "GB"]), ("X2", "9 and 10", "ISO:A", ["CA:B", "US:N"]), ("C3", "10", "A", ["B", "N"])],
    "all open": [("W", "5", "ISO", ["ISO"]), ("V", "10 and 5", "A:ISO", ["B:USD", "N:ISO"])],
}


@pytest.mark.parametrize("name", BOOKS)
@pytest.mark.parametrize("seed", [1, 2])
def test_evaluation_equals_a_plain_loop(spark, name, seed):
    chance = random.Random(seed)
    rows = []
    for _ in range(300):
        codes = dict(zip(DIMENSIONS, "Q S C A TO1 A 5J A CA A 5J".split()))
        codes.update(L_DENOM=chance.choice(["TO1", "USD", "EUR", "UN9"]), L_CURR_TYPE=chance.choice("ADFU"),
                     L_REP_CTY=chance.choice(["CA", "US", "GB"]), L_CP_SECTOR=chance.choice("ABN"), L_POSITION=chance.choice("CL"))
        rows.append((".".join(codes.values()), chance.choice(["2026-Q1", "2026-Q2"]), "LBSR", chance.choice([1.0, 2.0, 3.0, None])))
    width = max(len(r[3]) for r in BOOKS[name])
    table = [(n, "", d, t, "", *(p + [None] * (width - len(p)))) for n, d, t, p in BOOKS[name]]
    schema = WIDE.rsplit(", c1", 1)[0] + "".join(f", p{i} string" for i in range(width))
    wide = spark.createDataFrame(table, schema)
    book = [(r["check_no"], r["dims"], r["aggregate"], r["components"]) for r in rules.parse(wide).collect()]
    batch = spark.createDataFrame(rows, "TIME_SERIES_CODE string, DATE string, IBS_AGG string, OBS_VALUE double")
    got = validation.verdicts(batch, rules.load(wide)).collect()
    assert {(r["L_REP_CTY"], r["DATE"]): r["FAILED_RULE_ID"] for r in got} == naive(rows, book)


def macro(spark, rows):
    schema = "TIME_SERIES_CODE string, DATE string, IBS_AGG string, OBS_VALUE double, OBS_STATUS string, OBS_CONF string"
    return spark.createDataFrame(rows, schema)


def test_feeds_fail_the_expected_checks(spark):
    schema = "TIME_SERIES_CODE string, BANK_CODE string, DATE string, IBS_AGG string, OBS_VALUE double"
    batch = disclosure.rollup(spark.createDataFrame(scenario.feed_rows(), schema))
    decided = validation.batch_summary(validation.validate(batch, testbed.rulebook(spark))).collect()
    assert {r["REP_CTY"]: r["FAILED_RULE_ID"] for r in decided} == {c: outcome[2] for c, outcome in scenario.FEED_OUTCOME.items()}


def test_malformed_keys_and_null_periods_stop_the_batch(spark):
    book = testbed.rulebook(spark)
    good = scenario.key("CA", "CAD", "D")
    for bad in [(good[:-3], "2026-Q1"), (good + ".X", "2026-Q1"), (None, "2026-Q1"), (good, None)]:
        with pytest.raises(SubmissionError):
            validation.validate(macro(spark, [(*bad, "LBSR", 1.0, "A", "F")]), book)


def test_lower_case_keys_are_checked_and_kept(spark):
    rows = [(scenario.key("ca", "to1", "a"), "2026-Q1", "LBSR", 5.0, "A", "F"), (scenario.key("CA", "USD", "D"), "2026-Q1", "LBSR", 4.0, "A", "F")]
    got = validation.validate(macro(spark, rows), testbed.rulebook(spark)).collect()
    assert {r["BATCH_STATUS"] for r in got} == {"QUARANTINE"}
    assert {r["TIME_SERIES_CODE"] for r in got} == {r[0] for r in rows}


def test_empty_batch_and_empty_rulebook(spark):
    assert validation.validate(macro(spark, []), testbed.rulebook(spark)).count() == 0
    nothing = rules.load(testbed.rule_table(spark).filter(F.lit(False)))
    got = validation.validate(macro(spark, [(scenario.key("CA", "CAD", "D"), "2026-Q1", "LBSR", 1.0, "A", "F")]), nothing)
    assert got.first()["BATCH_STATUS"] == "PUBLISHED"
