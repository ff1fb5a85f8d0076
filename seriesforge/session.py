"""Session settings the jobs rely on."""

from pyspark.sql import SparkSession

# Runtime re-planning splits skewed join partitions and merges small ones; it is the reason
# no operator here needs a hand-set partition count.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    # A task writes that many periods side by side instead of sorting all its rows first.
    "spark.sql.maxConcurrentOutputFileWriters": "64",
}

# Can only be set when the session starts. Spares a look at the Python stack for every column
# expression, about a third of the planning time of a long plan.
AT_START = {"spark.python.sql.dataFrameDebugging.enabled": "false"}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the settings to a session that already runs."""
    for name, value in SETTINGS.items():
        spark.conf.set(name, value)
    return spark


def local_session(cores: int = 8, memory: str = "8g") -> SparkSession:
    """A single-machine session for tests and timing runs."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("seriesforge")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(cores))
    )
    for name, value in {**SETTINGS, **AT_START}.items():
        builder = builder.config(name, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
