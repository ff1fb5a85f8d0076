import math
import random
from fractions import Fraction

import pytest

from seriesforge.errors import SubmissionError
from seriesforge.operators import disclosure, ledger
from tests import scenario


def one(n, amount, conf="F", country="CA", sector="B"):
    return scenario.position(n, country, f"B{n}", "C", "A", "CAD", "D", "US", sector, amount, conf)


def test_casing_and_padding_do_not_split_a_series(spark):
    rows = scenario.ledger(spark, [one(1, 1.0), one(2, 2.0, "f ", " ca", "b ")])
    result = ledger.rollup(ledger.normalise(rows)).collect()
    assert [(r["TIME_SERIES_CODE"], r["OBS_VALUE"]) for r in result] == [("Q.S.C.A.CAD.D.CA.A.CA.B.US", 3.0)]


def test_zero_missing_and_nan(spark):
    zero = scenario.ledger(spark, [one(1, 0.1), one(2, 0.2), one(3, -0.3)])
    assert ledger.rollup(zero).count() == 0
    partly = scenario.ledger(spark, [one(1, 5.0), one(2, math.nan), one(3, None)])
    assert [r["OBS_VALUE"] for r in ledger.rollup(partly).collect()] == [5.0]
    nothing = scenario.ledger(spark, [one(1, None), one(2, math.nan)])
    assert ledger.rollup(nothing).count() == 0


@pytest.mark.parametrize("amounts, total", [
    ([4e-7], 4e-7), ([1e-300], 1e-300), ([1e300, 1.0, -1e300], 1.0), ([1e300, -1e300], None), ([0.1, 0.2, -0.3], None),
    ([1e300, 4e-7, -1e300, 1e-300, -4e-7], 1e-300), ([-1e300, 5.0], -1e300), ([1e16, 1.0, -1e16, -3.0], -2.0), ([-0.0, 0.0], None),
    ([5e-324, 5e-324], 1e-323), ([1.7976931348623157e308, 1.0], 1.7976931348623157e308), ([-1e22, 1e-10, -1e5], -1.00000000000000001e22), ([2.5e-7, math.nan, None], 2.5e-7),
])
def test_sums_at_any_magnitude(spark, amounts, total):
    rows = scenario.ledger(spark, [one(i, a) for i, a in enumerate(amounts)])
    assert [r["OBS_VALUE"] for r in ledger.rollup(rows).collect()] == ([] if total is None else [total])


def test_sums_equal_fractions(spark):
    """Random doubles of all magnitudes, beside sums of the decimal numbers they show."""
    rng = random.Random(6)
    rows, want = [], {}
    for partner in range(60):
        numbers = [rng.choice([-1, 1]) * rng.random() * 10.0 ** rng.choice([rng.randrange(-320, 300), rng.randrange(-9, 12)]) for _ in range(rng.randrange(1, 9))]
        numbers += [-x for x in numbers if rng.random() < 0.5]
        want[f"P{partner}"] = float(sum(map(Fraction, map(repr, numbers))))
        rows += [scenario.position(i, "NO", "B", "C", "A", "NOK", "D", f"P{partner}", "B", x) for i, x in enumerate(numbers)]
    got = {r["TIME_SERIES_CODE"].split(".")[-1]: r["OBS_VALUE"] for r in ledger.rollup(scenario.ledger(spark, rows)).collect()}
    assert got == {p: v for p, v in want.items() if v}


def test_infinite_amounts_are_an_error(spark):
    with pytest.raises(Exception, match="infinite"):
        ledger.rollup(scenario.ledger(spark, [one(1, math.inf)])).collect()


@pytest.mark.parametrize("flags, strictest", [(["F", "F"], "F"), (["F", "N"], "N"), (["N", "C", "F"], "C"), ([None, "F"], "F")])
def test_strictest_flag_wins(spark, flags, strictest):
    rows = scenario.ledger(spark, [one(i, 1.0, c) for i, c in enumerate(flags)])
    assert ledger.rollup(rows).first()["OBS_CONF"] == strictest


def test_null_dimension_gives_no_short_key(spark):
    rows = scenario.ledger(spark, [one(1, 1.0, sector=None)])
    assert ledger.rollup(rows).first()["TIME_SERIES_CODE"] is None
    assert [r[0] for r in ledger.codelist_offenders(rows).collect()] == [None]
    with pytest.raises(SubmissionError):
        ledger.assert_codelist(rows)


def test_stamp_checks_width(spark):
    rows = spark.createDataFrame(scenario.positions(), scenario.BUSINESS_SCHEMA)
    with pytest.raises(SubmissionError, match="obs_conf"):
        ledger.stamp(rows.drop("obs_conf"), "LBSR", "2026-Q1", "2026-05-15 08:00:00")


def feed(spark, rows):
    return spark.createDataFrame(rows, "TIME_SERIES_CODE string, BANK_CODE string, DATE string, IBS_AGG string, OBS_VALUE double")


def test_dominance_per_country(spark):
    result = disclosure.rollup(feed(spark, scenario.feed_rows())).collect()
    count = {}
    for r in result:
        country = r["TIME_SERIES_CODE"].split(".")[8]
        total, restricted = count.get(country, (0, 0))
        count[country] = (total + 1, restricted + (r["OBS_CONF"] == "N"))
    assert count == {c: outcome[:2] for c, outcome in scenario.FEED_OUTCOME.items()}


def test_dominance_measures_absolute_shares(spark):
    k = scenario.key("CA", "CAD", "D")
    rows = [(k, "A", "2026-Q1", "LBSR", 60.0), (k, "B", "2026-Q1", "LBSR", -40.0), (k, "C", "2026-Q2", "LBSR", 0.0)]
    result = disclosure.rollup(feed(spark, rows)).collect()
    assert [(r["OBS_VALUE"], r["MAX_BANK_SHARE"], r["OBS_CONF"]) for r in result] == [(20.0, 0.6, "N")]
    assert disclosure.rollup(feed(spark, rows), 0.61).first()["OBS_CONF"] == "F"
