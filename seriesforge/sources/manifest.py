"""A numbered list of folders, and files that only one writer can put: where commits become visible.

Data go to a folder of their own first. A listing is one JSON file, written aside and then renamed to
`listing-<n>.json`. The rename refuses a name that is taken, so of two writers that started from one
version one succeeds; the other gets a `CommitConflict`, and nothing that readers see has changed.
"""

import hashlib
import json
import re
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from seriesforge.errors import CommitConflict, SubmissionError

LISTING = re.compile(r"/listing-(\d+)\.json$")


def _rename_new(spark: SparkSession, source, target: str) -> None:
    """Rename a file to a name that nothing has yet; in HDFS one step, which only one writer can make."""
    jvm, hadoop = spark._jvm, spark._jvm.org.apache.hadoop.fs
    path = hadoop.Path(source)
    context = hadoop.FileContext.getFileContext(path.toUri(), spark._jsc.hadoopConfiguration())
    keep_existing = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 0)
    try:
        context.rename(path, hadoop.Path(target), keep_existing)
    except Py4JJavaError as error:
        if error.java_exception.getClass().getSimpleName() == "FileAlreadyExistsException":
            raise CommitConflict(f"{target} was committed by another writer") from error
        raise


def _system(spark: SparkSession, path: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def files_in(spark: SparkSession, folder: str) -> list:
    """Names in a folder; none where there is no such folder."""
    path, system = _system(spark, folder)
    return [status.getPath().getName() for status in system.listStatus(path)] if system.exists(path) else []


def put_new(spark: SparkSession, text: str, target: str, aside: str) -> None:
    """Write a small text file under a name that nothing has yet, else `CommitConflict`."""
    path, system = _system(spark, f"{aside}/{uuid.uuid4().hex}")
    stream = system.create(path)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    parent, _ = _system(spark, target.rsplit("/", 1)[0])
    system.mkdirs(parent)
    _rename_new(spark, path.toUri(), target)


class SchemaFiles:
    """Schemas as files named by their content, so each set of columns there ever was is written once."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def keep(self, schema: T.StructType) -> str:
        text = schema.json()
        name = hashlib.sha256(text.encode()).hexdigest()[:32]
        if f"{name}.json" not in files_in(self.spark, self.folder):
            try:
                put_new(self.spark, text, f"{self.folder}/{name}.json", f"{self.folder}/_attempts")
            except CommitConflict:  # another writer has just put the same text there
                pass
        return name

    def load(self, name: str) -> T.StructType:
        return T.StructType.fromJson(json.loads(self.spark.read.text(f"{self.folder}/{name}.json", wholetext=True).first()[0]))


def merged(schemas) -> T.StructType:
    """All columns in the order of their first arrival."""
    fields = {}
    for schema in schemas:
        for field in schema:
            known = fields.setdefault(field.name, field)
            if known.dataType != field.dataType:
                raise SubmissionError(f"column {field.name} is {field.dataType.simpleString()} here and {known.dataType.simpleString()} in the table")
    return T.StructType([T.StructField(f.name, f.dataType) for f in fields.values()])


class Manifest:
    """`fields` is the DDL of one entry; an entry stands for one folder, so a listing is small."""

    def __init__(self, spark: SparkSession, folder: str, fields: str):
        self.spark = spark
        self.folder = folder
        self.schema = f"entries array<struct<{fields}>>"

    def latest(self) -> tuple:
        """The latest version (0 before the first) and its entries."""
        try:
            files = self.spark.read.schema(self.schema).json(self.folder).inputFiles()
        except AnalysisException as error:
            if error.getCondition() == "PATH_NOT_FOUND":
                return 0, []
            raise
        version = max((int(LISTING.search(f).group(1)) for f in files), default=0)
        if not version:
            return 0, []
        return version, self.spark.read.schema(self.schema).json(self._path(version)).first()["entries"]

    def publish(self, version: int, entries: list) -> int:
        """Make `entries` the listing of that version, unless another writer has made one."""
        # Names with an underscore are no part of what readers list.
        aside = f"{self.folder}/_attempt-{uuid.uuid4().hex}"
        self.spark.createDataFrame([(entries,)], self.schema).coalesce(1).write.json(aside)
        source = self.spark.read.schema(self.schema).json(aside).inputFiles()[0]
        _rename_new(self.spark, self.spark._jvm.java.net.URI(source), self._path(version))
        return version

    def _path(self, version: int) -> str:
        return f"{self.folder}/listing-{version}.json"
