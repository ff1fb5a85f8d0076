"""Two submissions end to end: counts, what each caller sees, replay."""

import pytest
from pyspark.sql import functions as F

from seriesforge.errors import CommitConflict, SubmissionError
from seriesforge.operators import governance, history as scd2
from seriesforge.plans import cycle, testbed
from seriesforge.sources import ledger_store
from seriesforge.sources.history_store import HistoryStore
from seriesforge.sources.manifest import Manifest
from tests import scenario

AT = {"baseline": "2026-05-15 08:00:00", "revision": "2026-08-14 08:00:00"}


@pytest.fixture(scope="module")
def submitted(spark, tmp_path_factory):
    base = str(tmp_path_factory.mktemp("cycle"))
    store, book = HistoryStore(spark, f"{base}/history"), testbed.rulebook(spark)
    batches = {name: scenario.ledger(spark, scenario.positions(cycle)) for cycle, name in enumerate(AT, 1)}
    submissions = [cycle.Submission(name, rows, AT[name]) for name, rows in batches.items()]
    first = cycle.run(submissions[:1], book, store, f"{base}/ledger")[0]
    first = {(r["REP_CTY"], r["BATCH_STATUS"], r["FAILED_RULE_ID"]): r["row_count"] for r in first.collect()}
    after_first = store.read().count()
    second = cycle.run(submissions[1:], book, store, f"{base}/ledger")[0]
    second = {(r["REP_CTY"], r["BATCH_STATUS"], r["FAILED_RULE_ID"]): r["row_count"] for r in second.collect()}
    return dict(base=base, store=store, book=book, submissions=submissions, first=first, after_first=after_first, second=second)


def test_baseline_publishes_everything(submitted):
    assert submitted["first"] == {(c, "PUBLISHED", None): n for c, n in (("NO", 6), ("PT", 5), ("NZ", 6))}
    assert submitted["after_first"] == 17


def test_revision_is_rejected_as_a_whole(submitted):
    assert submitted["second"] == {("NO", "PUBLISHED", None): 6, ("PT", "QUARANTINE", "LBS_CC:04"): 5, ("NZ", "PUBLISHED", None): 7}


def test_history_keeps_the_last_valid_state(submitted):
    """17 rows, two Norwegian and two New Zealand versions more, and five rejected ones."""
    rows = submitted["store"].read()
    assert rows.count() == 26
    assert rows.filter("IS_CURRENT").count() == 18
    audit = rows.filter("NOT IS_CURRENT")
    assert audit.filter("BATCH_STATUS = 'QUARANTINE' AND VALID_FROM = VALID_TO").count() == 5
    assert audit.filter("BATCH_STATUS = 'PUBLISHED' AND VALID_TO = timestamp'2026-08-14 08:00:00'").count() == 3
    assert scd2.published_view(rows).count() == 18
    value = lambda k: scd2.published_view(rows).filter(F.col("TIME_SERIES_CODE").like(k)).first()["OBS_VALUE"]
    assert value("%.EUR.D.PT.A.PT.N.5J") == 40.0 and value("%.TO1.A.NO.A.NO.N.5J") == 110.0


CALLERS = [
    ({"admin"}, 26, 18, 0),
    ({"researcher"}, 21, 18, 8),
    ({"public"}, 13, 11, 0),
    ({"submitter-pt"}, 20, 13, 0),
    ({"submitter-no"}, 16, 13, 0),
    ({"submitter-pt", "researcher"}, 26, 18, 6),
    (set(), 0, 0, 0),
]


@pytest.mark.parametrize("groups, visible, current, masked", CALLERS)
def test_what_callers_see(spark, submitted, groups, visible, current, masked):
    history = submitted["store"].read()
    seen = governance.govern(history, groups)
    assert seen.count() == visible
    assert seen.filter("IS_CURRENT").count() == current
    assert seen.filter("OBS_VALUE IS NULL").count() == masked
    members = spark.createDataFrame([("p", g) for g in groups or {None}], "principal string, group string")
    assert governance.visible_counts(history, members).first().asDict() == {
        "principal": "p", "visible_rows": visible, "current_rows": current, "masked_rows": masked}
    assert sorted(map(str, submitted["store"].scan(groups).collect())) == sorted(map(str, seen.collect()))


def test_replay_adds_nothing(submitted):
    store = submitted["store"]
    kept = store.read().collect()
    for _ in range(2):
        cycle.process(submitted["submissions"][1], submitted["book"], store, f"{submitted['base']}/ledger")
    assert sorted(map(str, store.read().collect())) == sorted(map(str, kept))
    assert ledger_store.read(store.spark, f"{submitted['base']}/ledger").count() == 35


def test_a_later_period_leaves_earlier_ones_alone(spark, submitted):
    store = submitted["store"]
    before = {str(r) for r in store.read().collect()}
    rows = scenario.ledger(spark, scenario.positions()[11:14], "2026-Q2")
    cycle.process(cycle.Submission("next", rows, "2026-09-01 08:00:00"), submitted["book"], store, f"{submitted['base']}/ledger")
    after = store.read()
    assert {str(r) for r in after.filter("DATE = '2026-Q1'").collect()} == before
    assert after.filter("DATE = '2026-Q2' AND IS_CURRENT").count() == 3
    assert store.read(["2026-Q2"]).count() == 3


def test_unknown_sector_stops_the_batch(spark, submitted):
    rows = scenario.ledger(spark, [scenario.position(1, "CA", "N", "C", "A", "CAD", "D", "US", s, 1.0) for s in ("X", None)])
    version = submitted["store"].version()
    with pytest.raises(SubmissionError, match="None.*X"):
        cycle.process(cycle.Submission("bad", rows, "2026-09-02 08:00:00"), submitted["book"], submitted["store"], f"{submitted['base']}/ledger")
    assert submitted["store"].version() == version


def test_a_stale_writer_changes_nothing(spark, submitted, tmp_path):
    store = HistoryStore(spark, str(tmp_path))
    rows = submitted["store"].read(["2026-Q1"]).limit(1)
    value = lambda v: rows.withColumn("OBS_VALUE", F.lit(v))
    store.commit(value(1.0), ["2026-Q1"], store.snapshot())
    seen = store.snapshot()
    assert store.commit(value(2.0), ["2026-Q1"], seen) == 2
    with pytest.raises(CommitConflict):
        store.commit(value(99.0), ["2026-Q1"], seen)
    assert store.version() == 2 and [r["OBS_VALUE"] for r in store.read().collect()] == [2.0]
    assert store.read(at=seen).first()["OBS_VALUE"] == 1.0


def test_a_job_that_dies_before_its_listing(spark, submitted, tmp_path, monkeypatch):
    def dies(*_):
        raise OSError("gone")

    rows = scenario.ledger(spark, scenario.positions())
    ledger_store.append(rows, str(tmp_path / "ledger"), "one")
    store = HistoryStore(spark, str(tmp_path / "history"))
    store.commit(submitted["store"].read(["2026-Q1"]), ["2026-Q1"], store.snapshot())
    with monkeypatch.context() as patch:
        patch.setattr(Manifest, "publish", dies)
        patch.setattr(ledger_store, "put_new", dies)
        with pytest.raises(OSError):
            ledger_store.append(rows.limit(1), str(tmp_path / "ledger"), "one")
        with pytest.raises(OSError):
            store.commit(store.read().limit(1), ["2026-Q1"], store.snapshot())
    assert ledger_store.read(spark, str(tmp_path / "ledger"), ["2026-Q1"]).count() == 17
    assert store.read().count() == submitted["store"].read(["2026-Q1"]).count()


def test_ledger_takes_new_columns(spark, tmp_path):
    rows = scenario.ledger(spark, scenario.positions())
    ledger_store.append(rows, str(tmp_path), "one")
    ledger_store.append(rows.withColumn("channel", F.lit("web")), str(tmp_path), "two")
    back = ledger_store.read(spark, str(tmp_path))
    assert back.count() == 34 and back.filter("channel = 'web'").count() == 17
    with pytest.raises(SubmissionError):
        ledger_store.append(rows, str(tmp_path), "../up")
