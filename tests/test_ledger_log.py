"""The ledger's log: entries of fixed size, checkpoints, writers side by side."""

import glob
import os
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from seriesforge.errors import CommitConflict, SubmissionError
from seriesforge.sources import ledger_store
from seriesforge.sources.manifest import put_new
from tests import scenario


def sizes(path):
    return {f: os.path.getsize(f) for f in glob.glob(f"{path}/**/*", recursive=True) if os.path.isfile(f)}


def test_an_append_costs_the_same_after_many(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ledger_store, "BLOCK", 50)
    rows = scenario.ledger(spark, scenario.positions())
    log = ledger_store.LedgerLog(spark, str(tmp_path / "log"))
    written = []
    for n in range(310):
        before = sizes(log.path) if n in (7, 307) else {}
        assert log.add(f"batch-{n % 260:03d}", f"{n:032x}", rows.schema, ["2026-Q1"]) == n + 1
        if before:
            written.append(sum(size for f, size in sizes(log.path).items() if f not in before and not f.endswith(".crc")))
    assert abs(written[0] - written[1]) <= 4  # two more digits of the number
    assert len(glob.glob(f"{log.path}/schemas/*.json")) == 1 and len(glob.glob(f"{log.path}/checkpoints/block=*")) == 6
    live = {r["batch_id"]: int(r["attempt"], 16) for r in log.live().collect()}
    assert live == {f"batch-{n % 260:03d}": n for n in range(310)}
    opened = [f for f in log.live().inputFiles() if f.endswith(".json")]
    assert len(opened) == 11  # entries 300 to 310, after the last checkpoint


def test_a_lost_checkpoint_costs_time_only(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ledger_store, "BLOCK", 3)
    log = ledger_store.LedgerLog(spark, str(tmp_path))
    schema = scenario.ledger(spark, scenario.positions()).schema
    for n in range(7):
        log.add(f"b{n}", f"a{n}", schema)
    os.remove(f"{tmp_path}/checkpoints/block=1/_SUCCESS")  # its writer died
    assert {r["batch_id"] for r in log.live().collect()} == {f"b{n}" for n in range(7)}


def test_sent_again_removed_and_by_period(spark, tmp_path):
    path = str(tmp_path)
    rows = scenario.ledger(spark, scenario.positions())
    later = scenario.ledger(spark, scenario.positions()[:3], "2026-Q2")
    with pytest.raises(SubmissionError):
        ledger_store.read(spark, path)
    ledger_store.append(rows, path, "one")
    ledger_store.append(later, path, "two")
    ledger_store.append(rows.limit(5), path, "one")
    assert ledger_store.read(spark, path).count() == 8 and ledger_store.read(spark, path, ["2026-Q1"]).count() == 5
    assert all("batch_id=two" in f for f in ledger_store.read(spark, path, ["2026-Q2"]).inputFiles())
    with pytest.raises(SubmissionError, match="sector_code is int"):
        ledger_store.append(rows.withColumn("sector_code", F.lit(1)), path, "three")
    ledger_store.remove(spark, path, "one")
    assert ledger_store.read(spark, path).count() == 3 and ledger_store.read(spark, path, ["1999-Q1"]).count() == 0
    ledger_store.remove(spark, path, "two")
    assert ledger_store.read(spark, path).schema.fieldNames() == rows.columns and ledger_store.read(spark, path).count() == 0


def test_writers_side_by_side(spark, tmp_path):
    log = ledger_store.LedgerLog(spark, str(tmp_path))
    schema = scenario.ledger(spark, scenario.positions()).schema
    with ThreadPoolExecutor(4) as pool:
        versions = list(pool.map(lambda n: log.add(f"b{n}", f"a{n}", schema), range(12)))
    assert sorted(versions) == list(range(1, 13)) and log.live().count() == 12


def test_a_name_is_given_once(spark, tmp_path):
    put_new(spark, "first", f"{tmp_path}/x/name", f"{tmp_path}/aside")
    with pytest.raises(CommitConflict):
        put_new(spark, "second", f"{tmp_path}/x/name", f"{tmp_path}/aside")
    assert open(f"{tmp_path}/x/name").read() == "first"
