"""One submission from ledger rows to a new history."""

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from seriesforge.errors import CommitConflict
from seriesforge.operators import history as scd2
from seriesforge.operators import ledger, validation
from seriesforge.operators.rules import Rulebook
from seriesforge.sources import ledger_store
from seriesforge.sources.history_store import HistoryStore
from seriesforge.sources.staging import stage

ATTEMPTS = 5


@dataclass(frozen=True)
class Submission:
    """Ledger rows that arrived together: an id for replay, and one timestamp."""

    batch_id: str
    rows: DataFrame
    at: str


def observations(rows: DataFrame) -> DataFrame:
    """Normalised ledger rows to a batch of observations, not yet judged."""
    return ledger.with_normal_status(ledger.rollup(rows))


def take(store: HistoryStore, batch: DataFrame, at: str, periods: list, framework=None) -> int:
    """Merge a batch that has one row per key into those periods of a store; returns the new version."""
    for left in reversed(range(ATTEMPTS)):
        base = store.snapshot()
        before = scd2.widen(store.read(periods, base, identified=True), batch)
        changed = scd2.changes(before, batch, at, store.spec, periods=periods, framework=framework, check_unique=False)
        try:
            return store.append(changed, periods, base)
        except CommitConflict:  # merge again, into what the faster writer left
            if not left:
                raise


def process(submission: Submission, book: Rulebook, store: HistoryStore, ledger_path: str, framework=None):
    """Take one submission into ledger and history; returns the batch summary.

    Only the periods of the batch are read from the history, and only what changes is written. Sending
    the same submission twice replaces its ledger folder and adds no version of a series.
    """
    spark = submission.rows.sparkSession
    normal = ledger.normalise(submission.rows)
    # The rows are computed once: the gate looks at what was written, before it becomes part of the ledger.
    target = ledger_store.append(normal, ledger_path, submission.batch_id, ledger.assert_codelist)
    accepted = spark.read.parquet(target).withColumn("date_scope", F.col("date_scope").cast("string"))
    batch = stage(validation.validate(observations(accepted), book), "validated")
    periods = sorted(r[0] for r in batch.select("DATE").distinct().collect())
    if not periods:
        return validation.batch_summary(batch)
    take(store, batch, submission.at, periods, framework)
    return validation.batch_summary(batch)


def run(submissions, book: Rulebook, store: HistoryStore, ledger_path: str) -> list:
    """Take submissions in order; returns their summaries."""
    return [process(s, book, store, ledger_path) for s in submissions]
