"""History on plain Parquet: a commit adds files for what changed, and a new list of folders.

`data/commit=<n>-<attempt>/DATE=<period>/kind=<kind>` holds the rows of one commit, one period and one kind:

    open     versions as they were opened
    closing  the positions (key and opening commit) of open versions that ended, and when
    closed   versions whose end is final, after a compaction
    audit    rejected rows

The manifest lists the folders that make up a state, so a commit carries everything older by reference. Readers put
open and closing rows together. A reader sees the state before a commit or after it. A writer commits on the snapshot it
has read; when another one was faster it gets a `CommitConflict` and starts again.

Beside each commit lie statistics of its files: least and greatest key, countries, statuses and flags. `scan` asks them
which files a caller and a request can need at all. A batch may bring columns the table does not have: the folder names
the schema it was written with, the table has the columns of all its folders, and older rows have NULL in the new ones. Rows carry status, flag and country in normal form, so that the
remaining filters are plain comparisons that reach the scan, and files have a Bloom filter of the series keys.
"""

import uuid
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from seriesforge.functions import policy
from seriesforge.functions.keys import segment
from seriesforge.model import HISTORY_SCHEMA, KEY, PUBLISHED, REPORTER
from seriesforge.operators import history as scd2
from seriesforge.sources.manifest import Manifest, SchemaFiles, merged

OPEN, CLOSING, CLOSED, AUDIT = "open", "closing", "closed", "audit"
KIND_OF = {scd2.INSERTED: OPEN, scd2.AUDIT: AUDIT, scd2.EXPIRED: CLOSING, scd2.MISSING: CLOSING}
#: Columns that only files have: country, status and flag in normal form, and the commit that opened what a closing row ends.
NORMAL = T.StructType([T.StructField(n, T.StringType()) for n in ("row_country", "row_status", "row_flag", "opened")])
FOLDER = T.StructType([T.StructField(n, T.StringType()) for n in ("commit", "kind")])


@dataclass(frozen=True)
class Folder:
    period: str
    kind: str
    commit: str
    rows: int
    schema: str = ""


@dataclass(frozen=True)
class Snapshot:
    """A version, and the folders that make it up."""

    version: int
    folders: tuple

    def of(self, periods=None, kinds=None) -> list:
        inside = lambda value, allowed: allowed is None or value in allowed
        return [f for f in self.folders if inside(f.period, periods) and inside(f.kind, kinds)]


class HistoryStore:
    def __init__(self, spark: SparkSession, path: str, schema=HISTORY_SCHEMA, spec=scd2.MACRO):
        self.spark = spark
        self.path = path.rstrip("/")
        self.schema = schema
        self.spec = spec
        self.schemas = SchemaFiles(spark, f"{self.path}/schemas")
        self.manifest = Manifest(spark, f"{self.path}/manifest", "DATE string, kind string, commit string, row_count long, schema string")

    # ---- reading ---------------------------------------------------------------------------

    def snapshot(self) -> Snapshot:
        version, entries = self.manifest.latest()
        return Snapshot(version, tuple(Folder(e["DATE"], e["kind"], e["commit"], e["row_count"], e["schema"]) for e in entries))

    def version(self) -> int:
        return self.snapshot().version

    def read(self, periods=None, at: Snapshot | None = None, identified: bool = False) -> DataFrame:
        """A state (the latest unless told otherwise), or those periods of it.

        With `identified`, current rows name the commit that opened them.
        """
        at = at or self.snapshot()
        wanted, schema = at.of(None if periods is None else set(periods)), self.columns(at)
        rows = self._together({f"{self._folder(f)}": f.kind for f in wanted}, F.lit(True), schema)
        return rows.select(*schema.fieldNames(), *(["opened"] if identified else []))

    def columns(self, at: Snapshot) -> T.StructType:
        """The columns of a state: those of the table, and what its commits brought, in their order."""
        names = dict.fromkeys(f.schema for f in sorted(at.folders, key=lambda f: int(f.commit.split("-")[0])))
        return merged([self.schema, *(self.schemas.load(name) for name in names)])

    def _folder(self, folder: Folder) -> str:
        return f"{self.path}/data/commit={folder.commit}/DATE={folder.period}/kind={folder.kind}"

    def _rows(self, paths: list, schema: T.StructType) -> DataFrame:
        stored = _stored(schema)
        if not paths:
            return self.spark.createDataFrame([], stored)
        return self.spark.read.schema(stored).option("basePath", f"{self.path}/data").parquet(*sorted(paths))

    def _together(self, paths: dict, condition: Column, schema: T.StructType) -> DataFrame:
        """Rows of those files or folders that meet the condition; `paths` has the kind of each."""
        of = lambda *kinds: [p for p, kind in paths.items() if kind in kinds]
        spec = self.spec
        live = self._rows(of(OPEN), schema).filter(condition).withColumn("opened", F.col("commit"))
        if of(CLOSING):  # a few rows beside the open ones; Spark knows the size and picks the join
            ended = self._rows(of(CLOSING), schema).select(*spec.keys, "opened", F.col(spec.valid_to).alias("ended"))
            live = live.join(ended, [*spec.keys, "opened"], "left")
            still = F.col("ended").isNull()
            live = live.withColumns({spec.valid_to: F.coalesce("ended", spec.valid_to), spec.current: still, "opened": F.when(still, F.col("opened"))})
        parts = [live.select(*schema.fieldNames(), *NORMAL.fieldNames())]
        if of(CLOSED, AUDIT):
            parts.append(self._rows(of(CLOSED, AUDIT), schema).filter(condition).select(*schema.fieldNames(), *NORMAL.fieldNames()))
        return reduce(DataFrame.union, parts)

    # ---- reading as a caller -----------------------------------------------------------------

    def files(self, groups, request=None, at: Snapshot | None = None) -> DataFrame:
        """(commit, DATE, kind, file) of the files that can hold a row the caller may see and the request asks for."""
        folders = (at or self.snapshot()).folders
        entries = [(f.commit, f.period, f.kind) for f in folders]
        listed = self.spark.createDataFrame(entries, "commit string, DATE string, kind string")
        if not entries:
            return listed.withColumn("file", F.lit(""))
        statistics = self.spark.read.parquet(*sorted({f"{self.path}/stats/{f.commit}" for f in folders}))
        return statistics.join(listed, ["commit", "DATE", "kind"]).filter(_needed(groups, request)).select("commit", "DATE", "kind", "file")

    def scan(self, groups, request=None, at: Snapshot | None = None) -> DataFrame:
        """What `search.matching` gives on the whole history, or `governance.govern` without a request, from few files."""
        at = at or self.snapshot()
        schema = self.columns(at)
        chosen = self.files(groups, request, at).collect()  # names of files, as every scan has them
        paths = {f"{self._folder(Folder(f['DATE'], f['kind'], f['commit'], 0))}/{f['file']}": f["kind"] for f in chosen}
        normal = {"country": "row_country", "conf": "row_flag", "normal": True}
        condition = policy.row_filter(groups, status="row_status", **normal)
        if request is not None:
            condition = condition & request.stored_predicate()
        rows = self._together(paths, condition, schema).withColumn("OBS_VALUE", policy.masked_value(groups, **normal))
        return (rows if request is None else rows.filter(request.predicate(groups))).select(*schema.fieldNames())

    # ---- writing ---------------------------------------------------------------------------

    def append(self, changed: DataFrame, periods, base: Snapshot) -> int:
        """Add the changes (as `history.changes` labels them, from `read(identified=True)`) to `base`; returns the new version.

        Only what changed is written; every folder of `base` stays.
        """
        kind = reduce(lambda found, c: F.when(F.col("change") == c, KIND_OF[c]).otherwise(found), KIND_OF, F.lit(None))
        rows = changed.filter(F.col("change") != scd2.KEPT).withColumn("kind", kind)
        if "opened" not in rows.columns:
            rows = rows.withColumn("opened", F.lit(None).cast("string"))
        keep = {*self.spec.keys, self.spec.valid_from, self.spec.valid_to, "change", "kind", "opened"}
        blank = {c: F.when(F.col("kind") != CLOSING, F.col(c)) for c in rows.columns if c not in keep}
        return self._commit(rows.withColumns(_normal(self.schema)).withColumns(blank), periods, base, list(base.folders))

    def commit(self, rows: DataFrame, periods, base: Snapshot) -> int:
        """Replace those periods of `base` by `rows`, keep the others, and return the new version.

        `rows` may come from `read`: every attempt writes a folder of its own, so nothing that a
        reader can see is overwritten, also not when two writers attempt the same version.
        """
        kind = F.when(F.col(self.spec.current), OPEN).when(F.col(self.spec.valid_from) == F.col(self.spec.valid_to), AUDIT).otherwise(CLOSED)
        whole = rows.withColumn("kind", kind).withColumn("opened", F.lit(None).cast("string"))
        kept = [f for f in base.folders if f.period not in set(periods)]
        return self._commit(whole.withColumns(_normal(self.schema)), periods, base, kept)

    def compact(self, share: float = 0.25) -> int:
        """Rewrite the periods where closing rows are more than a share of the open ones; returns the version."""
        base = self.snapshot()
        count = lambda period, kind: sum(f.rows for f in base.of({period}, {kind}))
        grown = sorted({f.period for f in base.of(None, {CLOSING}) if count(f.period, CLOSING) > share * count(f.period, OPEN)})
        return self.commit(self.read(grown, base), grown, base) if grown else base.version

    def _commit(self, rows: DataFrame, periods, base: Snapshot, kept: list) -> int:
        commit = f"{base.version + 1}-{uuid.uuid4().hex}"
        data = f"{self.path}/data/commit={commit}"
        own = {"change", "kind", *NORMAL.fieldNames()}
        more = [T.StructField(f.name, f.dataType) for f in rows.schema if f.name not in own | set(self.schema.fieldNames())]
        schema = T.StructType([*self.schema.fields, *more])
        name = self.schemas.keep(schema)
        columns = [*schema.fieldNames(), *NORMAL.fieldNames(), "kind"]
        # Few countries per file, and keys in order inside it, so that statistics tell files apart.
        spread = rows.select(*columns).hint("rebalance", "DATE", "kind", "row_country").sortWithinPartitions("DATE", "kind", "row_country", KEY)
        spread.write.option(f"parquet.bloom.filter.enabled#{KEY}", "true").partitionBy("DATE", "kind").parquet(data)
        written = self.spark.read.schema(T.StructType([f for f in _stored(schema) if f.name != "commit"])).parquet(data)
        values = lambda c: F.sort_array(F.collect_set(c)).alias(f"{c}_values")  # codes: few however many rows there are
        per_file = written.groupBy(F.lit(commit).alias("commit"), "DATE", "kind", F.col("_metadata.file_name").alias("file")).agg(
            F.count(F.lit(1)).alias("row_count"), F.min(KEY).alias("least_key"), F.max(KEY).alias("greatest_key"),
            values("row_country"), values("row_status"), values("row_flag"),
        )
        statistics = f"{self.path}/stats/{commit}"
        per_file.write.parquet(statistics)
        found = self.spark.read.schema(per_file.schema).parquet(statistics).groupBy("DATE", "kind").agg(F.sum("row_count").alias("n")).collect()
        stray = {r["DATE"] for r in found} - set(periods)
        if stray:
            raise ValueError(f"rows of periods outside the commit: {sorted(map(str, stray))}")
        folders = [*kept, *(Folder(r["DATE"], r["kind"], commit, r["n"], name) for r in found)]
        entries = sorted((f.period, f.kind, f.commit, f.rows, f.schema) for f in folders)
        return self.manifest.publish(base.version + 1, entries)


def _stored(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, *NORMAL.fields, *FOLDER.fields])


def _normal(schema) -> dict:
    """The columns in normal form, as `policy` compares them."""
    have = lambda c: F.upper(F.coalesce(F.col(c), F.lit(""))) if c in schema.fieldNames() else F.lit("")
    country = F.col(REPORTER) if REPORTER in schema.fieldNames() else segment(F.col(KEY), REPORTER)
    return {"row_country": F.upper(F.coalesce(country, F.lit(""))), "row_status": have("BATCH_STATUS"), "row_flag": have("OBS_CONF")}


def _needed(groups, request) -> Column:
    """Whether a file, by its statistics, can hold a row that is wanted. Closing rows have no status of their own."""
    own = policy.countries(groups)
    groups = policy.known(groups)
    published = F.array_contains("row_status_values", PUBLISHED)
    tiers = [F.lit(policy.ADMIN in groups)]
    if policy.RESEARCHER in groups:
        tiers.append(published)
    if policy.PUBLIC in groups or own:
        tiers.append(published & F.array_contains("row_flag_values", "F"))
    overlap = lambda column, codes: F.arrays_overlap(column, F.array(*[F.lit(c) for c in codes]))
    if own:
        tiers.append(overlap("row_country_values", own))
    wanted = reduce(or_, tiers)
    inside = F.lit(True)
    if request is not None:
        if codes := request.dimensions.get(REPORTER):
            inside = inside & overlap("row_country_values", codes)
        if request.date_from:
            inside = inside & (F.col("DATE") >= request.date_from)
        if request.date_to:
            inside = inside & (F.col("DATE") <= request.date_to)
        if not (request.include_quarantined and policy.may_see_quarantine(groups)):
            inside = inside & F.col("kind").isin(OPEN, CLOSING)
    return inside & (wanted | (F.col("kind") == CLOSING))
