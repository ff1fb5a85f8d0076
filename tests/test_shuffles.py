"""How often rows are sent: plans and files of the ledger and of the bank-level merge, on tables made here."""

import datetime as dt
import re
from collections import Counter

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from seriesforge.errors import SubmissionError
from seriesforge.model import LEDGER_SCHEMA
from seriesforge.operators import history as scd2
from seriesforge.operators import ledger
from seriesforge.plans import catalog, testbed
from seriesforge.sources import ledger_store
from tests import scenario


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    """Lines of six banks, with repeated rows, missing line numbers, orders without customer, customers without segment."""
    folder = str(tmp_path_factory.mktemp("tables"))
    day = lambda n: dt.datetime(1995, 1, 1) + dt.timedelta(days=37 * n)
    lines = [(n // 4, n % 6, None if n % 11 == 0 else n % 9, 1.5 * n, 0.09 if n % 5 == 0 else 0.01, "ANR"[n % 3], "OF"[n % 2], day(n % 20)) for n in range(300)]
    lines += lines[:7]
    made = {
        "lineitem": (lines, "l_orderkey l_suppkey l_linenumber l_extendedprice l_discount l_returnflag l_linestatus l_shipdate"),
        "orders": ([(n, n % 13, [None, "1-URGENT", "3-MEDIUM"][n % 3]) for n in range(75)], "o_orderkey o_custkey o_orderpriority"),
        "customer": ([(n, n % 5, [None, "AUTOMOBILE", "BUILDING"][n % 3]) for n in range(12)], "c_custkey c_nationkey c_mktsegment"),
        "supplier": ([(n, n) for n in range(6)], "s_suppkey s_nationkey"),
        "nation": ([(n, n % 5) for n in range(6)], "n_nationkey n_regionkey"),
    }
    kinds = {"l_linenumber": pa.int32(), "c_nationkey": pa.int32(), "s_nationkey": pa.int32(), "n_nationkey": pa.int32(), "n_regionkey": pa.int32()}
    for name, (rows, columns) in made.items():
        names = columns.split()
        arrays = [pa.array(values, kinds.get(c, pa.timestamp("us") if c == "l_shipdate" else None)) for c, values in zip(names, zip(*rows))]
        pq.write_table(pa.table(arrays, names), f"{folder}/{name}.parquet")
    return folder


@pytest.fixture
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString().splitlines()


def test_lines_are_not_sent_by_customer(spark, tables, no_broadcast):
    plan = _plan(testbed.ledger_rows(spark, tables))
    below = [plan[i + 1] for i, line in enumerate(plan) if re.search(r"Exchange hashpartitioning\(o_custkey", line)]
    assert below and not any("l_orderkey" in line for line in below)


def test_sector_totals_in_one_pass_are_those_of_a_union(spark, tables):
    total = lambda rows: rows.withColumn("sector_code", F.lit("A"))
    late = testbed.ledger_rows(spark, tables, testbed.LATE_LINES)
    rows = testbed.ledger_rows(spark, tables)
    british = F.col("reporting_country") == "GB"
    united = late.unionByName(total(late.filter(~british))).unionByName(total(rows.filter(british)))
    mark = F.coalesce(F.expr(testbed.LATE_LINES), F.lit(False))
    marked = testbed.ledger_rows(spark, tables, marks={"late": mark})
    once = testbed.with_sector_totals(marked, F.col("late"), F.col("late") | british)
    assert once.columns == [f.name for f in LEDGER_SCHEMA]
    assert sum(line.count("lineitem.parquet") for line in _plan(once)) == 1
    assert Counter(map(tuple, once.collect())) == Counter(map(tuple, united.collect())) and united.count() > 300


def test_bank_feeds_are_sums_of_all_and_of_late_lines(spark, tables):
    for feed, where in zip(catalog._bank_feeds(spark, tables), ("true", testbed.LATE_LINES)):
        expected = Counter()
        rows = testbed.ledger_rows(spark, tables, where).withColumn("key", ledger.series_key()).collect()
        for r in rows:
            expected[r["key"], r["date_scope"], r["reporting_institution"]] += r["transaction_amount"]
        assert {(r[0], r[1], r["BANK_CODE"]): r["OBS_VALUE"] for r in feed.collect()} == dict(expected)


@pytest.mark.parametrize("query", ["q_scd2_micro", "q_scd2_micro_gated"])
def test_a_merge_finds_bank_rows_in_place(spark, tables, query):
    """No shuffle by key but the one that made the feed."""
    sent = [line for line in _plan(getattr(catalog, query)(spark, tables)) if re.search(r"Exchange hashpartitioning\(TIME_SERIES_CODE", line)]
    assert sent and all("REPARTITION_BY_COL" in line for line in sent)


def test_a_rejected_row_is_new_by_key_and_hash(spark):
    keys = ("A.B", "bank", "2026-Q1", "LBSR")
    schema = "TIME_SERIES_CODE string, BANK_CODE string, DATE string, IBS_AGG string, OBS_VALUE double, BATCH_STATUS string"
    at = ["2026-01-01 00:00:00", "2026-02-01 00:00:00"]
    first = scd2.initialise(spark.createDataFrame([(*keys, 1.0, "QUARANTINE"), ("C.D", *keys[1:], 5.0, None)], schema), at[0], scd2.MICRO_GATED)
    batch = spark.createDataFrame([(*keys, 1.0, "QUARANTINE"), (*keys, 2.0, "QUARANTINE"), ("C.D", *keys[1:], 6.0, None), (None, *keys[1:], 7.0, None)], schema)
    audit = scd2.changes(first, batch, at[1], scd2.MICRO_GATED, check_unique=False).filter(F.col("change") == scd2.AUDIT)
    assert sorted(r["OBS_VALUE"] for r in audit.collect()) == [2.0, 6.0, 7.0]


def test_append_writes_from_where_rows_are(spark, tmp_path):
    rows = scenario.ledger(spark, scenario.positions()).crossJoin(spark.range(4, numPartitions=4)).drop("id").repartition(4)
    target = ledger_store.append(rows.persist(), str(tmp_path), "one")
    files = spark.read.parquet(target).inputFiles()
    assert len(files) == 4 and ledger_store.read(spark, str(tmp_path)).count() == rows.count()
    rows.unpersist()


def test_a_gate_looks_at_what_was_written(spark, tmp_path):
    rows, seen = scenario.ledger(spark, scenario.positions()), []

    def gate(written):
        seen.extend(written.inputFiles())
        ledger.assert_codelist(written.withColumn("sector_code", F.lit("X")))

    with pytest.raises(SubmissionError, match="X"):
        ledger_store.append(rows, str(tmp_path), "one", gate)
    assert seen and all("batch_id=one" in f for f in seen)
    with pytest.raises(SubmissionError, match="no submission"):
        ledger_store.read(spark, str(tmp_path))
