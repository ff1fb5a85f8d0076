"""Ledger files: one folder per attempt at a submission, and a log of the accepted ones.

A submission that is sent again takes the place of its earlier copy. The earlier files stay readable until then, so a
job that dies while it writes loses nothing.

An append adds one log entry of fixed size: batch, attempt, periods and the name of its schema. Schemas are files named
by their content, written once each. Every `BLOCK` entries the live submissions are written as a Parquet checkpoint.
The log is read as a table: the last checkpoint, and the entries after it. So neither writing nor reading touches all
earlier submissions, and a reader of some periods opens only their folders.
"""

import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from seriesforge.errors import CommitConflict, SubmissionError
from seriesforge.sources.manifest import SchemaFiles, files_in, merged, put_new

BATCH_ID = re.compile(r"[A-Za-z0-9_.-]{1,64}")
ENTRY_NAME = re.compile(r"entry-(\d+)\.json")
ENTRY = "version long, batch_id string, attempt string, schema string, periods array<string>"
ATTEMPTS = 20
BLOCK = 100


class LedgerLog:
    """Numbered entries in blocks; an entry without attempt takes a batch away."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path.rstrip("/")
        self.schemas = SchemaFiles(spark, f"{self.path}/schemas")

    def latest(self) -> dict:
        """The last entry; version 0 and no schema before the first."""
        for block in reversed(self._blocks("log")):
            found = [int(m.group(1)) for name in files_in(self.spark, f"{self.path}/log/block={block}") if (m := ENTRY_NAME.fullmatch(name))]
            if found:
                return self.spark.read.schema(ENTRY).json(self._entry(max(found))).first().asDict()
        return {"version": 0, "schema": None}

    def _blocks(self, folder: str) -> list:
        names = files_in(self.spark, f"{self.path}/{folder}")
        return sorted(int(name.removeprefix("block=")) for name in names if name.startswith("block="))

    def _entry(self, version: int) -> str:
        return f"{self.path}/log/block={version // BLOCK}/entry-{version}.json"

    def live(self) -> DataFrame:
        """The entry of every batch that is part of the ledger."""
        whole = [b for b in self._blocks("checkpoints") if "_SUCCESS" in files_in(self.spark, f"{self.path}/checkpoints/block={b}")]
        last = max(whole, default=-1)
        later = [f"{self.path}/log/block={b}" for b in self._blocks("log") if b > last]
        entries = self.spark.read.schema(ENTRY).json(later) if later else self.spark.createDataFrame([], ENTRY)
        if whole:
            entries = entries.unionByName(self.spark.read.schema(ENTRY).parquet(f"{self.path}/checkpoints/block={last}"))
        newest = entries.groupBy("batch_id").agg(F.max_by(F.struct(*entries.columns), "version").alias("entry"))
        return newest.select("entry.*").filter(F.col("attempt").isNotNull())

    def add(self, batch_id: str, attempt: str | None, schema: T.StructType | None, periods=()) -> int:
        """Add one entry after the latest one; another writer's entry in between is no conflict, only the next number."""
        for left in reversed(range(ATTEMPTS)):
            before = self.latest()
            known = [self.schemas.load(before["schema"])] if before["schema"] else []
            kept = self.schemas.keep(merged([*known, schema] if schema else known))
            entry = {"version": before["version"] + 1, "batch_id": batch_id, "attempt": attempt, "schema": kept, "periods": sorted(periods)}
            try:
                put_new(self.spark, json.dumps(entry), self._entry(entry["version"]), f"{self.path}/attempts")
                break
            except CommitConflict:
                if not left:
                    raise
        if entry["version"] % BLOCK == BLOCK - 1:
            self.live().write.mode("ignore").parquet(f"{self.path}/checkpoints/block={entry['version'] // BLOCK}")
        return entry["version"]


def _log(spark: SparkSession, path: str) -> LedgerLog:
    return LedgerLog(spark, f"{path}/log")


def append(df: DataFrame, path: str, batch_id: str, gate=None) -> str:
    """Write one submission, partitioned by period, and return its folder.

    Rows go to files from the task that has them: a shuffle by period would send each row once more, at three times the
    bytes it takes in a file. So a period of any size is written by many tasks. `gate` gets the written rows and raises
    to refuse them; until it has passed, no reader sees them.
    """
    if not BATCH_ID.fullmatch(batch_id):
        raise SubmissionError(f"batch id {batch_id!r}: letters, digits, _ . - only, up to 64")
    spark = df.sparkSession
    attempt = uuid.uuid4().hex
    target = f"{path}/data/batch_id={batch_id}/attempt={attempt}"
    df.write.partitionBy("date_scope").parquet(target)
    written = spark.read.schema(df.schema).parquet(target)
    if gate:
        gate(written)
    periods = written.select("date_scope").distinct().collect()  # the periods of one submission
    _log(spark, path).add(batch_id, attempt, df.schema, [p[0] for p in periods if p[0] is not None])
    return target


def remove(spark: SparkSession, path: str, batch_id: str) -> None:
    """Take a submission out of the ledger; its files stay where they are."""
    _log(spark, path).add(batch_id, None, None)


def read(spark: SparkSession, path: str, periods=None) -> DataFrame:
    """All submissions, or those periods of them. Columns added by later ones are NULL in the
    earlier ones; the log knows columns and periods, so no file is opened to learn them."""
    log = _log(spark, path)
    latest = log.latest()
    if latest["schema"] is None:
        raise SubmissionError(f"no submission in {path}")
    schema = log.schemas.load(latest["schema"])
    live = log.live()
    if periods is not None:
        wanted = F.array(*[F.lit(p) for p in periods]).cast("array<string>")
        live = live.filter(F.arrays_overlap("periods", wanted))
    folders = [f"{path}/data/batch_id={e['batch_id']}/attempt={e['attempt']}" for e in live.select("batch_id", "attempt").collect()]
    if not folders:
        return spark.createDataFrame([], schema)
    df = spark.read.schema(schema).option("basePath", f"{path}/data").parquet(*sorted(folders)).select(*schema.fieldNames())
    return df if periods is None else df.filter(F.col("date_scope").isin(list(periods)))
