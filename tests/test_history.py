"""Edge rows of the versioned history."""

import random

import pytest
from pyspark.sql import functions as F

from seriesforge.errors import SubmissionError
from seriesforge.model import BATCH_COLUMNS, BATCH_SCHEMA, RESULT_COLUMNS
from seriesforge.operators import history as scd2
from tests.scenario import key

T1, T2, T3 = "2026-01-01 00:00:00", "2026-02-01 00:00:00", "2026-03-01 00:00:00"
A, B, C = (key("CA", "CAD", "D", sector=s) for s in "ABN")
G = key("GB", "GBP", "D")
SCHEMA = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in BATCH_SCHEMA)


def batch(spark, *rows):
    """(key, value[, status[, period]]) to batch rows."""
    full = []
    for row in rows:
        code, value, status, period = (*row, *("PUBLISHED", "2026-Q1")[len(row) - 2:])
        full.append((code, period, "LBSR", value, "A", "F", "PASS" if status == "PUBLISHED" else "FAIL", None, status))
    return spark.createDataFrame(full, SCHEMA)


def state(df):
    return sorted((r["TIME_SERIES_CODE"], r["DATE"], r["OBS_VALUE"], r["IS_CURRENT"]) for r in df.collect())


def first(spark, *rows):
    return scd2.initialise(batch(spark, *rows), T1)


def test_changed_dropped_and_added(spark):
    after = scd2.merge(first(spark, (A, 1.0), (B, 2.0), (G, 9.0)), batch(spark, (A, 5.0), (C, 3.0)), T2)
    assert state(after) == sorted([
        (A, "2026-Q1", 1.0, False), (A, "2026-Q1", 5.0, True), (B, "2026-Q1", 2.0, False),
        (C, "2026-Q1", 3.0, True), (G, "2026-Q1", 9.0, True)])
    closed = after.filter("NOT IS_CURRENT").select(F.date_format("VALID_TO", "yyyy-MM-dd").alias("t")).distinct().collect()
    assert [r["t"] for r in closed] == ["2026-02-01"]
    assert after.filter("IS_CURRENT AND VALID_TO <> timestamp'9999-12-31'").count() == 0


def test_dropped_series_opens_again(spark):
    closed = scd2.merge(first(spark, (A, 1.0), (B, 2.0)), batch(spark, (A, 1.0)), T2)
    opened = scd2.merge(closed, batch(spark, (A, 1.0), (B, 2.0)), T3)
    assert [s for s in state(opened) if s[0] == B] == [(B, "2026-Q1", 2.0, False), (B, "2026-Q1", 2.0, True)]


def test_rejected_rows_change_nothing_current(spark):
    before = first(spark, (A, 1.0), (B, 2.0))
    for status in ("QUARANTINE", None, "published"):
        after = scd2.merge(before, batch(spark, (A, 7.0, status)), T2)
        assert [s for s in state(after) if s[3]] == state(before)
        assert scd2.merge(after, batch(spark, (A, 7.0, status)), T3).count() == 3


def test_scope_of_closing(spark):
    before = first(spark, (A, 1.0), (B, 2.0), (B, 3.0, "PUBLISHED", "2025-Q4"))
    arriving = batch(spark, (A, 1.0))
    assert sum(s[3] for s in state(scd2.merge(before, arriving, T2))) == 2
    assert sum(s[3] for s in state(scd2.merge(before, arriving, T2, periods=["2025-Q4"]))) == 3
    assert sum(s[3] for s in state(scd2.merge(before, arriving, T2, framework="OTHER"))) == 3


def test_missing_hash_is_filled_in(spark):
    before = first(spark, (A, 1.0), (B, 2.0)).withColumn("version_hash", F.lit(None).cast("string"))
    after = scd2.merge(before, batch(spark, (A, 1.0), (B, 4.0)), T2)
    assert state(after) == [(A, "2026-Q1", 1.0, True), (B, "2026-Q1", 2.0, False), (B, "2026-Q1", 4.0, True)]
    assert scd2.patch_schema(before.drop("version_hash")).filter("version_hash IS NULL").count() == 0


def test_null_and_blank_differ_in_the_hash(spark):
    df = spark.createDataFrame([(None, 1.0), ("", 1.0), (None, 1.0000001), (None, float("nan")), (None, None)], "t string, v double")
    hashes = [r[0] for r in scd2.with_version_hash(df, ["v", "t"]).select("version_hash").collect()]
    assert len(set(hashes)) == 5


def test_initial_rejected_rows_are_closed(spark):
    row = first(spark, (A, 1.0, "QUARANTINE")).first()
    assert not row["IS_CURRENT"] and row["VALID_TO"] == row["VALID_FROM"]


def test_duplicate_key_is_refused(spark):
    with pytest.raises(SubmissionError, match="2 times"):
        scd2.merge(first(spark, (A, 1.0)), batch(spark, (A, 1.0), (A, 2.0, "QUARANTINE")), T2)


def test_empty_batch(spark):
    before = first(spark, (A, 1.0))
    assert state(scd2.merge(before, batch(spark), T2)) == state(before)


def test_bank_history_takes_a_batch_without_status(spark):
    feed = spark.createDataFrame([(A, "B1", "2026-Q1", "LBSR", 1.0)], "TIME_SERIES_CODE string, BANK_CODE string, DATE string, IBS_AGG string, OBS_VALUE double")
    row = scd2.initialise(feed, T1, scd2.MICRO_GATED).first()
    assert row["BATCH_STATUS"] == "PUBLISHED" and row["is_current"]
    other = feed.withColumn("BANK_CODE", F.lit("B2"))
    ungated = scd2.merge(scd2.initialise(feed, T1, scd2.MICRO), other, T2, scd2.MICRO, periods=["2026-Q1"], framework="LBSR")
    assert ungated.filter("is_current").first()["BANK_CODE"] == "B2"
    gated = scd2.merge(scd2.initialise(feed, T1, scd2.MICRO_GATED), other, T2, scd2.MICRO_GATED)
    assert gated.filter("is_current").count() == 2


def test_one_country_feed_leaves_the_others_open(spark):
    schema = "TIME_SERIES_CODE string, BANK_CODE string, DATE string, IBS_AGG string, OBS_VALUE double"
    both = spark.createDataFrame([(A, "B1", "2026-Q1", "LBSR", 1.0), (B, "B1", "2026-Q1", "LBSR", 2.0), (G, "B9", "2026-Q1", "LBSR", 9.0)], schema)
    after = scd2.merge(scd2.initialise(both, T1, scd2.MICRO), both.limit(1), T2, scd2.MICRO)
    assert sorted(r["OBS_VALUE"] for r in after.filter("is_current").collect()) == [1.0, 9.0]


def test_replay_over_audit_rows_without_hash(spark):
    rejected = batch(spark, (A, 7.0, "QUARANTINE"))
    before = scd2.merge(first(spark, (A, 1.0)), rejected, T2).withColumn("version_hash", F.lit(None).cast("string"))
    assert scd2.merge(before, rejected, T3).count() == 2


def test_union_fills_and_renames(spark):
    bank = spark.createDataFrame([(A, "B1", "2026-Q1", "x", True)], "TIME_SERIES_CODE string, BANK_CODE string, DATE string, OBS_VALUE string, is_current boolean")
    both = scd2.union_histories([first(spark, (A, 1.0)), bank], RESULT_COLUMNS).select(*RESULT_COLUMNS)
    assert sorted(str(r["OBS_VALUE"]) for r in both.collect()) == ["1.0", "None"]
    assert both.filter("IS_CURRENT").count() == 2


@pytest.mark.parametrize("seed", [3, 4])
def test_random_batches_against_a_dictionary(spark, seed):
    """Current rows follow a dictionary; one current row per key; a replay adds no row."""
    chance, expected, history = random.Random(seed), {}, None
    codes = [key(c, d, "D", sector=s) for c in ("CA", "GB") for d in ("CAD", "GBP") for s in "ABN"]
    for step in range(4):
        country_status = {c: chance.choice(["PUBLISHED", "PUBLISHED", "QUARANTINE"]) for c in ("CA", "GB")}
        rows = [(k, float(chance.randint(1, 3)), country_status[k.split(".")[8]]) for k in chance.sample(codes, 8)]
        at = f"2026-0{step + 1}-01 00:00:00"
        arriving = batch(spark, *rows)
        history = scd2.initialise(arriving, at) if history is None else scd2.merge(history, arriving, at)
        history = spark.createDataFrame(history.collect(), history.schema)
        published = {k: v for k, v, s in rows if s == "PUBLISHED"}
        touched = {k.split(".")[8] for k in published}
        expected = {k: v for k, v in expected.items() if k.split(".")[8] not in touched} | published
        current = history.filter("IS_CURRENT").collect()
        assert {r["TIME_SERIES_CODE"]: r["OBS_VALUE"] for r in current} == expected and len(current) == len(expected)
        assert scd2.merge(history, arriving, "2027-01-01 00:00:00").count() == history.count()
    assert set(BATCH_COLUMNS) <= set(history.columns)
