"""Bank-level feeds and rulebooks as CSV."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from seriesforge.functions.keys import segment
from seriesforge.model import FEED_SCHEMA, KEY, REPORTER


def write_feed(df: DataFrame, path: str) -> str:
    """One folder per reporting country, with header."""
    columns = FEED_SCHEMA.fieldNames()
    country = F.lower(segment(F.col(KEY), REPORTER))
    rows = df.select(*columns).withColumn("country", country).hint("rebalance", "country")
    rows.write.partitionBy("country").csv(path, header=True)
    return path


def read_feed(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FEED_SCHEMA).csv(path, header=True).select(*FEED_SCHEMA.fieldNames())


def read_rulebook(spark: SparkSession, path: str) -> DataFrame:
    """A wide rulebook, every cell as text. Cells may hold line breaks."""
    return spark.read.csv(path, header=True, inferSchema=False, multiLine=True)
