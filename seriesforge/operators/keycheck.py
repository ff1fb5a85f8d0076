"""Series keys as data: explode into components, find and refuse malformed ones."""

from pyspark.sql import DataFrame, functions as F

from seriesforge.errors import ExportError, SubmissionError
from seriesforge.functions.keys import WIDTH, is_malformed, segment, segments
from seriesforge.model import DIMENSIONS, KEY

ATTRIBUTES = ("OBS_STATUS", "OBS_CONF")


def rejects(df: DataFrame) -> DataFrame:
    """Rows whose key does not have eleven segments, with the number it has (NULL key: 0)."""
    count = F.coalesce(F.size(segments(F.col(KEY))), F.lit(0))
    return df.filter(is_malformed(F.col(KEY))).select(KEY, count.alias("segment_count"))


def assert_keys(df: DataFrame) -> None:
    """Refuse a batch with a malformed key, a NULL period or a NULL framework."""
    broken = df.filter(
        is_malformed(F.col(KEY)) | F.col("DATE").isNull() | F.col("IBS_AGG").isNull()
    )
    found = broken.agg(F.count(F.lit(1)).alias("n"), F.min(KEY).alias("first")).first()
    if found["n"]:
        have = len(found["first"].split(".")) if found["first"] is not None else 0
        raise SubmissionError(
            f"{found['n']} row(s) lack a key of {WIDTH} segments, a period or a framework; "
            f"first key: {found['first']!r} with {have} segment(s)"
        )


def explode(df: DataFrame, carried=()) -> DataFrame:
    """Eleven dimensions, TIME_PERIOD, OBS_VALUE and the attributes; a missing attribute is blank.

    A malformed key fails the job that reads the result. Columns named in `carried` come along
    under their name with a plus sign in front.
    """
    if KEY not in df.columns:
        raise ExportError(f"no {KEY} column")
    period = "TIME_PERIOD" if "TIME_PERIOD" in df.columns else "DATE"
    if period not in df.columns:
        raise ExportError("neither TIME_PERIOD nor DATE")
    checked = F.when(
        is_malformed(F.col(KEY)),
        F.raise_error(F.concat(F.lit("malformed series key: "), F.coalesce(F.col(KEY), F.lit("NULL")))),
    ).otherwise(F.col(KEY))
    value = F.col("OBS_VALUE").try_cast("double") if "OBS_VALUE" in df.columns else F.lit(None).cast("double")
    attributes = [
        (F.col(a).cast("string") if a in df.columns else F.lit("")).alias(a) for a in ATTRIBUTES
    ]
    keyed = df.withColumn("_key", checked)
    return keyed.select(
        *[segment(F.col("_key"), d).alias(d) for d in DIMENSIONS],
        F.col(period).cast("string").alias("TIME_PERIOD"),
        value.alias("OBS_VALUE"),
        *attributes,
        *[F.col(c).alias(f"+{c}") for c in carried],
    )
