"""Submission messages: one observation per element, one folder per country and period."""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from seriesforge.errors import SubmissionError
from seriesforge.functions.keys import join_key
from seriesforge.functions.values import plain_text
from seriesforge.model import BREAK_STATUS, DIMENSIONS, FRAMEWORK, KEY, NORMAL_STATUS, REPORTER
from seriesforge.operators.keycheck import ATTRIBUTES, explode

# Dataset action per lifecycle state, and sender per country.
ACTIONS = {"First Submission": "Information", "Revision": "Replace", "Break in Series": "Replace"}
SENDERS = {"CA": ("BOC", "Bank of Canada"), "US": ("FRB", "Federal Reserve System"), "GB": ("BOE", "Bank of England")}
OTHER_SENDER = "ZZZ"
FIRST = "First Submission"
BREAK = "Break in Series"

OBSERVATION = ("TIME_PERIOD", "OBS_VALUE") + ATTRIBUTES


def _lookup(table: dict, key: Column, default) -> Column:
    pairs = [F.lit(x) for item in table.items() for x in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), default) if pairs else default


def check_states(states: dict) -> None:
    unknown = sorted(set(states.values()) - set(ACTIONS))
    if unknown:
        raise SubmissionError(f"unknown lifecycle state(s) {unknown}; expected one of {sorted(ACTIONS)}")


def lifecycle(df: DataFrame, states: dict) -> DataFrame:
    """Observations with what their country's lifecycle state makes of them.

    `states` maps a country to a state; a country without one makes a first submission.
    """
    check_states(states)
    country = F.upper(F.col(REPORTER))
    state = _lookup({c.upper(): s for c, s in states.items()}, country, F.lit(FIRST))
    status = F.when(F.col("SUBMISSION_TYPE") == BREAK, BREAK_STATUS).otherwise(F.col("OBS_STATUS"))
    rows = explode(df).withColumn("SUBMISSION_TYPE", state).withColumn("OBS_STATUS", status)
    return rows.withColumns(
        {
            "DATASET_ACTION": _lookup(ACTIONS, F.col("SUBMISSION_TYPE"), F.lit(None)),
            "SENDER_ID": _lookup({c: s[0] for c, s in SENDERS.items()}, country, F.lit(OTHER_SENDER)),
            "DATASET_ID": F.concat_ws("_", country, F.lit(FRAMEWORK), F.replace("TIME_PERIOD", F.lit("-"), F.lit(""))),
        }
    )


def summary(df: DataFrame, states: dict) -> DataFrame:
    """Per country: sender, state, action, number of series, number of restricted ones."""
    return lifecycle(df, states).groupBy(
        F.upper(REPORTER).alias("country"), "SENDER_ID", "SUBMISSION_TYPE", "DATASET_ACTION"
    ).agg(
        F.count(F.lit(1)).alias("series_count"),
        F.count_if(F.col("OBS_CONF") == "N").alias("restricted_series"),
    )


def write_submissions(df: DataFrame, path: str, states: dict, prepared=None) -> str:
    """Write `<path>/messages/SUBMISSION=<cc>_submission_<period>/` and the headers beside them.

    Every file is a complete XML document, so a country of any size is written by many tasks
    and read back file by file.
    """
    rows = lifecycle(df, states)
    name = F.concat_ws("_", F.lower(REPORTER), F.lit("submission"), F.replace("TIME_PERIOD", F.lit("-"), F.lit("_")))
    body = rows.select(
        *[F.col(d).alias(f"_{d}") for d in DIMENSIONS],
        F.col("TIME_PERIOD").alias("_TIME_PERIOD"),
        plain_text(F.col("OBS_VALUE")).alias("_OBS_VALUE"),
        *[F.nullif(F.col(a), F.lit("")).alias(f"_{a}") for a in ATTRIBUTES],
        name.alias("SUBMISSION"),
    ).hint("rebalance", "SUBMISSION")
    writer = body.write.format("xml").option("rootTag", "DataSet").option("rowTag", "Obs")
    writer.option("declaration", 'version="1.0" encoding="UTF-8"').partitionBy("SUBMISSION").save(f"{path}/messages")
    when = F.current_timestamp() if prepared is None else F.lit(prepared).cast("timestamp")
    names = _lookup({s[0]: s[1] for s in SENDERS.values()}, F.col("SENDER_ID"), F.lit(None).cast("string"))
    headers = rows.select("DATASET_ID", "DATASET_ACTION", "SENDER_ID", "SUBMISSION_TYPE").distinct().select(
        F.col("DATASET_ID").alias("ID"),
        F.lit(False).alias("Test"),
        when.alias("Prepared"),
        F.struct(F.col("SENDER_ID").alias("_id"), names.alias("Name")).alias("Sender"),
        F.col("DATASET_ACTION").alias("DataSetAction"),
        F.col("DATASET_ID").alias("DataSetID"),
    )
    headers.write.format("xml").option("rootTag", "Headers").option("rowTag", "Header").save(f"{path}/headers")
    return path


def read_submissions(spark: SparkSession, path: str, framework: str = FRAMEWORK) -> DataFrame:
    """Batch rows from message files, with the country their file or folder is named after.

    Takes both shapes of a structure-specific message: observations inside series, and flat
    observations that carry the key. `path` is a folder or a pattern such as `*_submission_*`.
    """
    text = "string"
    reader = spark.read.format("xml").option("ignoreNamespace", "true").option("mode", "FAILFAST")
    observation = ", ".join(f"_{c} {text}" for c in OBSERVATION)
    dims = ", ".join(f"_{d} {text}" for d in DIMENSIONS)
    nested = reader.schema(f"{dims}, Obs array<struct<{observation.replace(' string', ': string')}>>")
    nested = nested.option("rowTag", "Series").load(path).select("*", "_metadata.file_path")
    key = [f"_{d}" for d in DIMENSIONS]
    nested = nested.select("file_path", *key, F.inline("Obs"))
    flat = reader.schema(f"{dims}, {observation}").option("rowTag", "Obs").load(path)
    flat = flat.select("_metadata.file_path", *key, *[f"_{c}" for c in OBSERVATION])
    # An Obs element inside a Series carries no key of its own.
    flat = flat.filter(F.coalesce(*key).isNotNull())
    rows = flat.unionByName(nested)
    return rows.select(
        F.lower(F.regexp_extract("file_path", r"([^/=_]+)_submission_[^/]*", 1)).alias("SUBMITTED_BY"),
        join_key([F.col(k) for k in key]).alias(KEY),
        F.col("_TIME_PERIOD").alias("DATE"),
        F.lit(framework).alias("IBS_AGG"),
        F.nullif(F.trim("_OBS_VALUE"), F.lit("")).cast("double").alias("OBS_VALUE"),
        *[F.col(f"_{a}").alias(a) for a in ATTRIBUTES],
    )


def assert_not_empty(df: DataFrame) -> None:
    if df.isEmpty():
        raise SubmissionError("the message holds no observation")


def default_status(df: DataFrame) -> DataFrame:
    """Observations without a status are normal."""
    return df.withColumn("OBS_STATUS", F.coalesce("OBS_STATUS", F.lit(NORMAL_STATUS)))
