"""A folder of submission messages to accepted and rejected batches."""

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from seriesforge.model import BATCH_COLUMNS, FRAMEWORK
from seriesforge.operators import validation
from seriesforge.operators.keycheck import assert_keys
from seriesforge.operators.rules import Rulebook
from seriesforge.sources import submissions
from seriesforge.sources.staging import stage

SUBMITTER = "SUBMITTING_COUNTRY"


@dataclass(frozen=True)
class Verdict:
    """Every observation with its status, and one row per submitter and period."""

    rows: DataFrame
    decisions: DataFrame


def judge(spark: SparkSession, path: str, book: Rulebook, framework: str = FRAMEWORK) -> Verdict:
    """Read the messages at `path` (a folder or a pattern), check every batch in them and decide about each as a whole.

    All messages are read, checked and judged together, however many there are; each is decided by the checks that its
    reporting country fails in its period. A folder without observations is an error.
    """
    read = submissions.default_status(submissions.read_submissions(spark, path, framework))
    # Read three times: keys, sums, verdicts.
    sent = stage(read.withColumn(SUBMITTER, F.upper("SUBMITTED_BY")).drop("SUBMITTED_BY"), "messages")
    submissions.assert_not_empty(sent)
    assert_keys(sent)
    failing = stage(validation.verdicts(sent, book), "verdicts")
    rows = stage(validation.apply_verdicts(sent, failing, (SUBMITTER,)), "judged")
    decisions = rows.groupBy(SUBMITTER, "DATE", "BATCH_STATUS", "FAILED_RULE_ID").agg(F.count(F.lit(1)).alias("row_count"))
    return Verdict(rows.select(SUBMITTER, *BATCH_COLUMNS), decisions)
