"""Hand-made rows with known outcomes, and the outcomes worked out by hand."""

from dataclasses import dataclass

from seriesforge.model import LEDGER_SCHEMA, STAMPED

BUSINESS = [f.name for f in LEDGER_SCHEMA if f.name not in STAMPED]
BUSINESS_SCHEMA = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in LEDGER_SCHEMA if f.name not in STAMPED)


def position(n, country, bank, kind, instrument, currency, currency_type, partner, sector, amount, conf="F"):
    return (f"T{n}", country, bank, kind, instrument, currency, currency_type, country, "A", partner, sector, amount, conf)


@dataclass(frozen=True)
class Line:
    """One series of the two cycles: its amount in each, None where it is not sent."""

    country: str
    plane: tuple  # currency, currency type, sector
    first: float | None
    second: float | None
    conf: str = "F"
    instrument: str = "D"


LINES = [
    # Norway: three parts make the total of all currencies, and two make the foreign one; both cycles add up.
    Line("NO", ("NOK", "D", "N"), 70.5, 80.5),
    Line("NO", ("TO1", "F", "N"), 20.25, 20.25),
    Line("NO", ("UN9", "U", "N"), 9.25, 9.25, "N"),
    Line("NO", ("TO1", "A", "N"), 100.0, 110.0, "C"),
    Line("NO", ("EUR", "F", "N"), 15.25, 15.25),
    Line("NO", ("USD", "F", "N"), 5.0, 5.0),
    # Portugal: two sectors make the total, but not in the second cycle.
    Line("PT", ("EUR", "D", "A"), 88.0, 88.0),
    Line("PT", ("EUR", "D", "B"), 48.0, 48.0, "C"),
    Line("PT", ("EUR", "D", "N"), 40.0, 31.0),
    Line("PT", ("USD", "F", "H"), -3.5, -3.5, "N", "G"),
    Line("PT", ("CHF", "F", "M"), 2.0, 2.0, "F", "G"),
    # New Zealand: nothing to add up; one series ends, two begin.
    Line("NZ", ("NZD", "D", "B"), 11.0, 11.0),
    Line("NZ", ("AUD", "F", "B"), 6.0, 6.0),
    Line("NZ", ("AUD", "F", "C"), 7.0, 7.0, "C"),
    Line("NZ", ("USD", "F", "F"), 8.0, 8.0, "N"),
    Line("NZ", ("USD", "F", "G"), 9.0, None),
    Line("NZ", ("NZD", "D", "U"), 1.0, 1.0),
    Line("NZ", ("JPY", "F", "B"), None, 4.0),
    Line("NZ", ("JPY", "F", "H"), None, 5.0, "N"),
]


def positions(cycle=1):
    sent = [(n, line, line.first if cycle == 1 else line.second) for n, line in enumerate(LINES)]
    return [
        position(n, line.country, f"{line.country}-{n % 2}", "C", line.instrument, line.plane[0], line.plane[1], "5J", line.plane[2], amount, line.conf)
        for n, line, amount in sent
        if amount is not None
    ]


def ledger(spark, rows, period="2026-Q1", at="2026-05-15 08:00:00"):
    from seriesforge.operators.ledger import stamp

    return stamp(spark.createDataFrame(rows, BUSINESS_SCHEMA), "LBSR", period, at)


def key(country, denom, kind, position="C", sector="A"):
    return f"Q.S.{position}.A.{denom}.{kind}.5J.A.{country}.{sector}.5J"


#: Values of banks, in the order of the banks' letters; a bank has 60 % or more in the restricted ones.
FEED = {
    ("NO", "NOK", "D", "C", "A"): [30.0, 25.0, 20.0],
    ("NO", "TO1", "F", "C", "A"): [12.0, 13.0],
    ("NO", "TO1", "A", "C", "A"): [42.0, 38.0, 20.0],
    ("NZ", "NZD", "D", "C", "A"): [20.0],  # restricted
    ("NZ", "TO1", "F", "C", "A"): [15.0, 15.0],
    ("NZ", "TO1", "A", "C", "A"): [35.0, 20.0],  # restricted; 50 would be right
    ("PT", "EUR", "D", "C", "A"): [25.0, 25.0],
    ("PT", "TO1", "F", "C", "A"): [40.0],  # restricted
    ("PT", "TO1", "A", "C", "A"): [45.0, 45.0],
    ("PT", "TO1", "F", "L", "A"): [0.0, 33.0],  # restricted, as its three parts are; 30 would be right
    ("PT", "USD", "F", "L", "A"): [10.0],
    ("PT", "CHF", "F", "L", "A"): [12.0],
    ("PT", "GBP", "F", "L", "A"): [8.0],
    ("PT", "EUR", "D", "L", "A"): [70.0],  # restricted; 65 would be right
    ("PT", "EUR", "D", "L", "B"): [20.0, -20.0, 40.0],
    ("PT", "EUR", "D", "L", "N"): [5.0, 20.0],  # restricted
}
#: Series, restricted ones, and failed checks of each country of the feed.
FEED_OUTCOME = {"NO": (3, 0, None), "NZ": (3, 2, "LBS_CC01"), "PT": (10, 7, "LBS_CC02,LBS_CC:04")}


def feed_rows():
    return [(key(*series), f"BANK_{chr(65 + n)}", "2026-Q1", "LBSR", value) for series, values in FEED.items() for n, value in enumerate(values)]
