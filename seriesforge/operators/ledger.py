"""Bank-level ledger: stamping, normalising, code gate, roll-up to series."""

from pyspark.sql import Column, DataFrame, functions as F

from seriesforge.errors import SubmissionError
from seriesforge.functions.keys import join_key
from seriesforge.functions.values import binned, flag_of, joined, strictness
from seriesforge.model import (
    CODE_COLUMNS,
    DIMENSION_SOURCES,
    FREQUENCY,
    LEDGER_SCHEMA,
    MEASURE,
    NORMAL_STATUS,
    SECTOR_CODES,
    STAMPED,
)


def stamp(df: DataFrame, framework: str, period: str, timestamp) -> DataFrame:
    """Give every row of one submission the same framework, period and timestamp.

    The input must carry exactly the business columns; a missing or surplus column is an error.
    """
    expected = [f.name for f in LEDGER_SCHEMA if f.name not in STAMPED]
    if sorted(df.columns) != sorted(expected):
        wrong = sorted(set(expected).symmetric_difference(df.columns))
        raise SubmissionError(f"ledger rows need {len(expected)} columns; wrong: {wrong}")
    stamped = df.withColumns(
        {
            "ibs_agg_scope": F.lit(framework),
            "date_scope": F.lit(period),
            "transaction_timestamp": F.lit(timestamp).cast("timestamp"),
        }
    )
    return stamped.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in LEDGER_SCHEMA])


def normalise(df: DataFrame) -> DataFrame:
    """Trim and upper-case the code columns; a lower-case country would escape the row filter."""
    return df.withColumns({c: F.upper(F.trim(F.col(c))) for c in CODE_COLUMNS})


def codelist_offenders(df: DataFrame, column: str = "sector_code", codes=SECTOR_CODES) -> DataFrame:
    """Distinct codes outside the list. NULL is outside."""
    listed = F.col(column).isin(list(codes))
    return df.filter(~F.coalesce(listed, F.lit(False))).select(column).distinct()


def assert_codelist(df: DataFrame, column: str = "sector_code", codes=SECTOR_CODES) -> None:
    """Refuse the batch when a code is outside the list; names 20 of them and says how many there are."""
    offenders = codelist_offenders(df, column, codes)
    shown = [r[0] for r in offenders.limit(20).collect()]
    if shown:
        total = len(shown) if len(shown) < 20 else offenders.count()
        raise SubmissionError(f"{total} {column} codes, {sorted(map(str, shown))} among them, are not in {list(codes)}")


def series_key() -> Column:
    """The series key from the ledger's code columns."""
    parts = [F.lit(FREQUENCY), F.lit(MEASURE)] + [F.col(c) for c in DIMENSION_SOURCES.values()]
    return join_key(parts)


def reported(df: DataFrame, value: str = "OBS_VALUE") -> DataFrame:
    """Drop what is not reported: missing values and exact zeros."""
    return df.filter(F.col(value).isNotNull() & (F.col(value) != 0))


def totals(df: DataFrame) -> DataFrame:
    """Sum of amounts and strictest flag per series and period, zeros included.

    Amounts add up exactly at any magnitude. First per series and bin of magnitude, with constant-size state, so each
    task hands over at most one row per series and bin and no series is too large for the task that finishes it; then
    the few bins of a series meet.
    """
    codes = [*DIMENSION_SOURCES.values(), "date_scope", "ibs_agg_scope"]
    amounts = df.select(*codes, binned(F.col("transaction_amount")).alias("amount"), strictness(F.col("obs_conf")).alias("strict"))
    bins = amounts.groupBy(*codes, F.col("amount.bin").alias("bin")).agg(F.sum("amount.part").alias("part"), F.max("strict").alias("strict"))
    summed = bins.groupBy(*codes).agg(
        joined(F.collect_list(F.struct("bin", "part"))).alias("OBS_VALUE"),
        flag_of(F.max("strict")).alias("OBS_CONF"),
    )
    return summed.select(
        series_key().alias("TIME_SERIES_CODE"),
        F.col("date_scope").alias("DATE"),
        F.col("ibs_agg_scope").alias("IBS_AGG"),
        "OBS_VALUE",
        "OBS_CONF",
    )


def rollup(df: DataFrame) -> DataFrame:
    """Ledger rows to observations; series that net to zero are left out."""
    return reported(totals(df))


def with_normal_status(df: DataFrame) -> DataFrame:
    return df.withColumn("OBS_STATUS", F.lit(NORMAL_STATUS))
