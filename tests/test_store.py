"""What a commit writes, what a reader opens, and that neither changes what the history says."""

import glob

import pytest
from pyspark.sql import functions as F

from seriesforge.errors import SubmissionError
from seriesforge.operators import governance, history as scd2, search
from seriesforge.plans import cycle
from seriesforge.sources.history_store import HistoryStore
from tests.scenario import key
from tests.test_history import A, B, G, T1, T2, T3, batch

N_SERIES = 40
COUNTRIES = ("CA", "FR", "GB", "PT")


def rows_of(df):
    return sorted(map(str, df.collect()))


def take(store, arriving, at, periods=("2026-Q1",)):
    """One submission into the store; returns the changes."""
    base = store.snapshot()
    changed = scd2.changes(store.read(list(periods), base, identified=True), arriving, at)
    store.append(changed, list(periods), base)
    return changed


def files(store, kind="*"):
    return {f.split("/data/")[1] for f in glob.glob(f"{store.path}/data/*/*/kind={kind}/*.parquet")}


def test_a_revision_writes_only_what_changed(spark, tmp_path):
    store = HistoryStore(spark, str(tmp_path))
    codes = [key(c, "EUR", "D", sector=s) for c in COUNTRIES for s in "ABCFGHMNU"]
    take(store, batch(spark, *[(k, 1.0) for k in codes]), T1)
    before = files(store)
    revised = [(k, 2.0 if k == codes[4] else 1.0) for k in codes[:8] if k != codes[6]]  # one changed, the seventh and ninth are missing
    take(store, batch(spark, *revised), T2)
    added = files(store) - before
    assert before <= files(store) and {f.split("kind=")[1].split("/")[0] for f in added} == {"open", "closing"}
    new = spark.read.option("basePath", f"{store.path}/data").parquet(*[f"{store.path}/data/{f}" for f in added])
    assert {(r["kind"], r["n"]) for r in new.groupBy("kind").agg(F.count("*").alias("n")).collect()} == {("open", 1), ("closing", 3)}
    assert new.filter("kind = 'closing'").filter("OBS_VALUE IS NOT NULL OR version_hash IS NOT NULL").count() == 0
    history = store.read()
    assert history.count() == 37 and history.filter("IS_CURRENT").count() == 34
    assert [r["OBS_VALUE"] for r in history.filter(F.col("TIME_SERIES_CODE") == codes[4]).orderBy("VALID_FROM").collect()] == [1.0, 2.0]


def test_store_follows_the_merge(spark, tmp_path):
    """Dropped, opened again at the same value, rejected, replayed: as the merge of whole tables, also after compaction."""
    store, whole = HistoryStore(spark, str(tmp_path)), None
    steps = [
        (T1, [(A, 1.0), (B, 2.0), (G, 9.0)]), (T2, [(A, 1.0), (G, 7.0, "QUARANTINE")]), (T3, [(A, 3.0), (B, 2.0)]),
        ("2026-04-01 00:00:00", [(A, 1.0), (B, 5.0), (G, 7.0, "QUARANTINE")]), ("2026-05-01 00:00:00", [(A, 1.0), (B, 5.0), (G, 9.0)]),
    ]
    for at, sent in steps:
        arriving = batch(spark, *sent)
        take(store, arriving, at)
        whole = scd2.initialise(arriving, at) if whole is None else scd2.merge(whole, arriving, at)
        whole = spark.createDataFrame(whole.collect(), whole.schema)
        assert rows_of(store.read()) == rows_of(whole.select(*store.read().columns))
    old = store.snapshot()
    assert store.compact() == old.version + 1 and store.snapshot().of(None, {"closing"}) == []
    assert rows_of(store.read()) == rows_of(store.read(at=old)) and store.compact() == old.version + 1
    take(store, batch(spark, (A, 8.0), (B, 5.0)), "2026-06-01 00:00:00")
    assert store.read().filter("IS_CURRENT").count() == 3


def test_a_batch_with_more_columns(spark, tmp_path):
    """New columns appear for all rows, stay, and are filled on read where a folder lacks them."""
    store = HistoryStore(spark, str(tmp_path))
    arriving = batch(spark, (A, 1.0), (B, 2.0))
    cycle.take(store, arriving, T1, ["2026-Q1"])
    assert "channel" not in store.read().columns
    old = store.snapshot()
    cycle.take(store, batch(spark, (A, 3.0), (B, 2.0)).withColumn("channel", F.lit("web")), T2, ["2026-Q1"])
    cycle.take(store, batch(spark, (A, 4.0), (B, 2.0)), T3, ["2026-Q1"])
    seen = lambda df: sorted((r["OBS_VALUE"], r["channel"]) for r in df.filter(F.col("TIME_SERIES_CODE") == A).collect())
    assert seen(store.read()) == [(1.0, None), (3.0, "web"), (4.0, None)] == seen(store.scan({"admin"}))
    assert "channel" not in store.read(at=old).columns and len(glob.glob(f"{store.path}/schemas/*.json")) == 2
    store.compact(0.0)
    assert seen(store.read()) == [(1.0, None), (3.0, "web"), (4.0, None)]
    with pytest.raises(SubmissionError, match="channel is int"):
        cycle.take(store, batch(spark, (A, 5.0)).withColumn("channel", F.lit(1)), "2026-06-01 00:00:00", ["2026-Q1"])


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """Two periods, four countries; one country rejected in the second period, one with restricted values."""
    store = HistoryStore(spark, str(tmp_path_factory.mktemp("store")))
    spark.conf.set("spark.sql.files.maxRecordsPerFile", "9")  # a file per country, as in a large table
    try:
        for period, bad in (("2026-Q1", None), ("2026-Q2", "PT")):
            rows = [(key(c, "EUR" if n % 2 else "USD", "D", sector=s), float(n), "QUARANTINE" if c == bad else "PUBLISHED", period) for c in COUNTRIES for n, s in enumerate("ABCFGHMNU")]
            sent = batch(spark, *rows)
            sent = sent.withColumn("OBS_CONF", F.when(F.col("TIME_SERIES_CODE").contains(".FR."), "C").otherwise("F"))
            take(store, sent, T1, (period,))
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")
    return store


@pytest.mark.parametrize("groups, request_, share", [
    ({"admin"}, None, 1.0), ({"researcher"}, None, 0.9), ({"public"}, None, 0.7), ({"submitter-pt"}, None, 0.9), (set(), None, 0.0),
    ({"researcher"}, {"reporting_country": "GB"}, 0.3), ({"researcher"}, {"date_from": "2026-Q2", "reporting_country": "CA,GB"}, 0.3), ({"submitter-pt"}, {"include_quarantined": True, "reporting_country": "PT", "date_from": "2026-Q2"}, 0.15)])
def test_a_caller_opens_few_files(stored, groups, request_, share):
    request = None if request_ is None else search.SeriesFilter.build(**request_)
    history = stored.read()
    want = governance.govern(history, groups) if request is None else search.matching(history, request, groups)
    assert rows_of(stored.scan(groups, request)) == rows_of(want.select(*history.columns))
    opened = stored.files(groups, request).count()
    assert opened <= share * len(files(stored)) and (opened > 0) == bool(groups)


def test_tiers_reach_the_scan(spark, stored):
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    pushed = lambda groups, request=None: stored.scan(groups, request)._jdf.queryExecution().toString()
    try:
        assert "EqualTo(row_status,PUBLISHED)" in pushed({"researcher"})
        assert "EqualTo(row_flag,F)" in pushed({"public"})
        own, free = "EqualTo(row_country,PT)", "And(EqualTo(row_status,PUBLISHED),EqualTo(row_flag,F))"
        plan = pushed({"submitter-pt"})
        assert f"Or({own},{free})" in plan or f"Or({free},{own})" in plan
        assert "EqualTo(L_DENOM,USD)" in pushed({"researcher"}, search.SeriesFilter.build(currency="USD"))
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
