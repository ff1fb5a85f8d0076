"""Dominance rule: a series one bank makes up to a large part is not for publication."""

from pyspark.sql import DataFrame, functions as F

from seriesforge.functions.values import exact
from seriesforge.model import DOMINANCE_THRESHOLD, NORMAL_STATUS, SERIES_KEYS
from seriesforge.operators.ledger import reported


def feed(ledger: DataFrame, *more: str) -> DataFrame:
    """Bank-level feed rows (series, bank, period, framework, value) from ledger rows; columns of `more` are kept."""
    from seriesforge.operators.ledger import series_key

    return ledger.select(
        series_key().alias("TIME_SERIES_CODE"),
        F.col("reporting_institution").alias("BANK_CODE"),
        F.col("date_scope").alias("DATE"),
        F.col("ibs_agg_scope").alias("IBS_AGG"),
        F.col("transaction_amount").alias("OBS_VALUE"),
        *more,
    )


def rollup(df: DataFrame, threshold: float = DOMINANCE_THRESHOLD) -> DataFrame:
    """Feed rows to observations with the largest bank's share of the absolute total.

    The first aggregation is per series and bank, which spreads a series of any size over many
    tasks; the second sees one row per bank and again combines before its shuffle.
    """
    banks = df.groupBy(*SERIES_KEYS, "BANK_CODE").agg(
        F.sum(exact(F.col("OBS_VALUE"))).alias("bank_value")
    )
    amount = F.coalesce(F.abs("bank_value"), F.lit(0).cast("decimal(38,6)"))
    series = banks.groupBy(*SERIES_KEYS).agg(
        F.sum("bank_value").cast("double").alias("OBS_VALUE"),
        F.max(amount).cast("double").alias("largest"),
        F.sum(amount).cast("double").alias("exposure"),
    )
    share = F.coalesce(F.try_divide("largest", "exposure"), F.lit(0.0))
    shares = series.withColumn("MAX_BANK_SHARE", share)
    return reported(shares).select(
        *SERIES_KEYS,
        "OBS_VALUE",
        "MAX_BANK_SHARE",
        F.when(F.col("MAX_BANK_SHARE") >= threshold, "N").otherwise("F").alias("OBS_CONF"),
        F.lit(NORMAL_STATUS).alias("OBS_STATUS"),
    )
