import glob

import pytest

from seriesforge.errors import NothingToExport, QueryError
from seriesforge.functions import policy
from seriesforge.operators import governance, history as scd2, search
from seriesforge.plans import publication
from seriesforge.sources import exports
from tests.scenario import key
from tests.test_history import SCHEMA, T1


@pytest.fixture(scope="module")
def history(spark):
    rows = [
        (key("CA", "CAD", "D"), "2026-Q1", "LBSR", 1.0, "A", "F", "PASS", None, "PUBLISHED"),
        (key("CA", "TO1", "A"), "2026-Q1", "LBSR", 2.0, "A", "C", "PASS", None, "PUBLISHED"),
        (key("US", "USD", "D"), "2026-Q2", "LBSR", 3.0, "A", "c", "PASS", None, "published"),
        (key("DE", "EUR", "D"), "2025", "LBSR", 4.0, "A", "F", "FAIL", "X", "QUARANTINE"),
        ("short.key", "2026-Q1", "LBSR", 5.0, "A", "F", "FAIL", None, None),
    ]
    return scd2.initialise(spark.createDataFrame(rows, SCHEMA), T1).cache()


def seen(history, groups):
    return sorted(r["OBS_VALUE"] or -1 for r in governance.govern(history, groups).collect())


def test_tiers(history):
    assert seen(history, {"admin"}) == [1.0, 2.0, 3.0, 4.0, 5.0]
    assert seen(history, {"researcher"}) == [-1, -1, 1.0]
    assert seen(history, {"public"}) == [1.0]
    assert seen(history, {"submitter-de"}) == [1.0, 4.0]
    assert seen(history, {"submitter-us", "researcher"}) == [-1, 1.0, 3.0]
    assert seen(history, set()) == seen(history, {"submitter-"}) == []
    assert seen(history, {"Submitter-DE"}) == [1.0, 4.0]


def test_ledger_rows(spark):
    ledger = spark.createDataFrame([("ca",), ("US",), (None,)], "reporting_country string")
    assert governance.govern_ledger(ledger, {"submitter-ca"}).count() == 1
    assert governance.govern_ledger(ledger, {"admin"}).count() == 3
    assert governance.govern_ledger(ledger, {"researcher", "public"}).count() == 0


@pytest.mark.parametrize("groups, label, quarantine", [
    ({"admin", "submitter-ca"}, "admin", True), ({"submitter-us", "submitter-ca", "researcher"}, "submitter-ca", True),
    ({"Submitter-CA"}, "submitter-ca", True), ({"submitter-", "submitter-cad"}, "none", False), ({"submitter-", "Public"}, "public", False),
    ({"researcher", "public"}, "researcher", False),({"public"}, "public", False), (set(), "none", False), ({"other"}, "none", False)])
def test_persona(spark, groups, label, quarantine):
    assert (policy.persona(groups), policy.may_see_quarantine(groups)) == (label, quarantine)
    members = spark.createDataFrame([("p", g) for g in groups or {None}], "principal string, group string")
    row = governance.personas(members).first()
    assert (row["persona"], row["may_see_quarantine"]) == (label, quarantine)


def build(**request):
    return search.SeriesFilter.build(**request)


def test_request_cleaning():
    request = build(currency=[" usd, eur", "USD"], position="c", date_from=" 2026-q1 ", limit="30000")
    assert request.dimensions == {"L_DENOM": ("USD", "EUR"), "L_POSITION": ("C",)}
    assert (request.date_from, request.limit, build().limit) == ("2026-Q1", 30000, 500)
    for period in ("2026", "2026-S2", "2026-12", "2026-Q4"):
        assert build(date_to=period).date_to == period
    for bad in ({"currency": "U$D"}, {"currency": "A" * 13}, {"date_from": "2026-Q5"}, {"date_to": "26"},
                {"limit": 0}, {"limit": "many"}, {"colour": "red"}):
        with pytest.raises(QueryError):
            build(**bad)
    with pytest.raises(QueryError) as error:
        build(currency="U$D,EUR,€", colour="red", limit="-1", date_from="2026-Q4", date_to="2026-Q1")
    assert [p.split(":")[0] for p in str(error.value).split("; ")] == ["colour", "currency", "date_from", "limit"]


def test_search(history):
    find = lambda groups, **r: [x["OBS_VALUE"] for x in search.search(history, build(**r), groups).collect()]
    assert find({"admin"}) == [1.0, 2.0]
    assert find({"admin"}, include_quarantined=True) == [1.0, 4.0, 2.0]  # in key order
    assert find({"researcher"}, include_quarantined=True) == [1.0, None]
    assert find({"admin"}, currency="cad,to1", reporting_country="CA", limit=1) == [1.0]
    assert find({"admin"}, date_from="2026", date_to="2026") == []
    for limit, rows, masked, truncated in ((1, 1, 0, True), (2, 2, 1, False), (3, 2, 1, False)):
        summary = search.page_summary(history, build(limit=limit), {"researcher"}).first().asDict()
        assert summary == {"row_count": rows, "masked_observations": masked, "truncated": truncated}
    assert search.visible_probe(history, {"public"}) == 1 and search.visible_probe(history, set()) == 0


def test_facets_show_only_what_the_caller_sees(history):
    codes = lambda groups: {r["code"] for r in search.facets(history, groups, ["L_DENOM"]).collect()}
    assert codes({"public"}) == {"CAD"} and codes({"admin"}) == {"CAD", "TO1"} and codes(set()) == set()
    with pytest.raises(QueryError):
        search.facets(history, {"admin"}, ["COLOUR"])


def test_dimension_filter_reaches_the_scan(spark, history, tmp_path):
    history.write.partitionBy("DATE").parquet(str(tmp_path / "h"))
    stored = spark.read.parquet(str(tmp_path / "h"))
    plan = search.search(stored, build(currency="CAD", date_from="2026-Q1"), {"researcher"})._jdf.queryExecution().toString()
    assert "EqualTo(L_DENOM,CAD)" in plan and "PartitionFilters: [isnotnull(DATE" in plan and "TakeOrderedAndProject" in plan


def test_publishing_as_a_caller(history, tmp_path):
    done = publication.publish(history, build(), {"submitter-ca"}, "sdmx-ml", str(tmp_path / "x"))
    document = "".join(open(f).read() for f in sorted(glob.glob(f"{done.path}/part-*")))
    assert done.rows == 2 and '<mes:Sender id="BOC">' in document and document.count("<Obs") == 2
    with pytest.raises(NothingToExport):
        publication.publish(history, build(), set(), "tidy-csv", str(tmp_path / "y"))
    assert publication.sender_of({"researcher"}) == publication.sender_of({"submitter-de"}) == exports.SENDER
