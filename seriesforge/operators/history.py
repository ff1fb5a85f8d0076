"""Slowly changing history (type 2): versions, audit rows, scoped closing.

A merge is one function from the old rows and a batch to the new rows. All change sets come from
the same input, one timestamp marks every change, and a batch that was rejected leaves the
current rows as they are.
"""

from dataclasses import dataclass, replace
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, functions as F

from seriesforge.errors import SubmissionError
from seriesforge.functions.keys import segment
from seriesforge.functions.values import fingerprint
from seriesforge.model import DIMENSIONS, KEY, OPEN_END, PUBLISHED, REPORTER, SERIES_KEYS
from seriesforge.sources.staging import stage

HASH = "version_hash"
BATCH = (REPORTER, "DATE", "IBS_AGG")

# Labels of the `change` column.
KEPT = "kept"
EXPIRED = "expired"
MISSING = "missing"
INSERTED = "inserted"
AUDIT = "audit"


@dataclass(frozen=True)
class HistorySpec:
    """What distinguishes one history table from another."""

    keys: tuple
    payload: tuple
    valid_from: str
    valid_to: str
    current: str
    dimensions: tuple
    gated: bool  # rejected rows become audit rows
    close_missing: bool  # rows absent from the batch are closed, where it published something


MACRO = HistorySpec(
    keys=SERIES_KEYS,
    payload=("OBS_VALUE", "OBS_STATUS", "OBS_CONF", "QUALITY_STATUS", "FAILED_RULE_ID", "BATCH_STATUS"),
    valid_from="VALID_FROM",
    valid_to="VALID_TO",
    current="IS_CURRENT",
    dimensions=DIMENSIONS,
    gated=True,
    close_missing=True,
)

MICRO = HistorySpec(
    keys=(KEY, "BANK_CODE", "DATE", "IBS_AGG"),
    payload=("OBS_VALUE",),
    valid_from="effective_start_date",
    valid_to="effective_end_date",
    current="is_current",
    dimensions=(REPORTER,),
    gated=False,
    close_missing=True,
)

MICRO_GATED = replace(
    MICRO,
    payload=("OBS_VALUE", "QUALITY_STATUS", "FAILED_RULE_ID", "BATCH_STATUS"),
    gated=True,
    close_missing=False,
)


def with_version_hash(df: DataFrame, payload) -> DataFrame:
    """Add the fingerprint of the payload columns."""
    return df.withColumn(HASH, fingerprint(payload, dict(df.dtypes)))


def patch_schema(history: DataFrame, spec: HistorySpec = MACRO) -> DataFrame:
    """Give a history from before change tracking its hash, and every NULL hash a value."""
    payload = [c for c in spec.payload if c in history.columns]
    computed = fingerprint(payload, dict(history.dtypes))
    known = F.coalesce(F.col(HASH), computed) if HASH in history.columns else computed
    return history.withColumn(HASH, known)


def _published(rows: DataFrame, spec: HistorySpec) -> DataFrame:
    return rows.filter(F.col("BATCH_STATUS") == PUBLISHED) if spec.gated else rows


def _rejected(rows: DataFrame) -> DataFrame:
    """Everything that is not PUBLISHED, a NULL status included."""
    return rows.filter(F.col("BATCH_STATUS").isNull() | (F.col("BATCH_STATUS") != PUBLISHED))


def prepare(batch: DataFrame, spec: HistorySpec) -> DataFrame:
    """Batch rows with status, hash and stored dimensions."""
    if spec.gated and "BATCH_STATUS" not in batch.columns:
        batch = batch.withColumn("BATCH_STATUS", F.lit(PUBLISHED))
    hashed = with_version_hash(batch, [c for c in spec.payload if c in batch.columns])
    return _with_dimensions(hashed, spec)


def _with_dimensions(df: DataFrame, spec: HistorySpec) -> DataFrame:
    return df.withColumns({d: segment(F.col(KEY), d) for d in spec.dimensions})


def assert_unique(batch: DataFrame, spec: HistorySpec) -> None:
    """Refuse a batch that names one key twice: it would open two current rows."""
    repeated = batch.groupBy(*spec.keys).count().filter("count > 1").limit(1).collect()
    if repeated:
        raise SubmissionError(f"key occurs {repeated[0]['count']} times in the batch: {repeated[0][:-1]}")


def _opened(rows: DataFrame, spec: HistorySpec, at: Column) -> DataFrame:
    return rows.withColumns(
        {spec.valid_from: at, spec.valid_to: F.lit(OPEN_END).cast("timestamp"), spec.current: F.lit(True)}
    )


def _audited(rows: DataFrame, spec: HistorySpec, at: Column) -> DataFrame:
    return rows.withColumns({spec.valid_from: at, spec.valid_to: at, spec.current: F.lit(False)})


def initialise(batch: DataFrame, at, spec: HistorySpec = MACRO) -> DataFrame:
    """First state of a history: published rows open, rejected rows closed on arrival."""
    at = F.lit(at).cast("timestamp")
    rows = prepare(batch, spec)
    published = F.coalesce(F.col("BATCH_STATUS") == PUBLISHED, F.lit(False)) if spec.gated else F.lit(True)
    return rows.withColumns(
        {
            spec.valid_from: at,
            spec.valid_to: F.when(published, F.lit(OPEN_END).cast("timestamp")).otherwise(at),
            spec.current: published,
        }
    )


def _flag_missing_scope(current: DataFrame, published: DataFrame, spec, periods, framework) -> DataFrame:
    """Mark the current rows that close when the batch does not name them."""
    if not spec.close_missing:
        return current.withColumn("closable", F.lit(False))
    inside = F.lit(True)
    if periods is not None:
        inside = inside & F.col("DATE").isin(list(periods))
    if framework is not None:
        inside = inside & (F.col("IBS_AGG") == framework)
    # At most one row per country, period and framework; written so that its size is known.
    batches = stage(published.select(*BATCH).distinct().withColumn("in_batch", F.lit(True)), "published")
    flagged = current.join(batches, list(BATCH), "left")
    return flagged.withColumn("closable", inside & F.col("in_batch").isNotNull()).drop("in_batch")


def changes(
    history: DataFrame,
    batch: DataFrame,
    at,
    spec: HistorySpec = MACRO,
    periods=None,
    framework=None,
    check_unique: bool = True,
) -> DataFrame:
    """The new history, each row with a `change` label.

    An absent row is closed only where the batch published something of its country, period and
    framework; `periods` and `framework` limit that further.

    Current rows and published rows meet in one full outer join on the key. Both sides have one
    row per key, so no key is hot. The stored dimensions are left out of that shuffle and taken
    from the key again; older versions are not shuffled for it at all.
    """
    at = F.lit(at).cast("timestamp")
    # Closed and audit rows too: a replay is told by their hashes.
    history = patch_schema(history, spec)
    rows = prepare(batch, spec)
    if check_unique:
        assert_unique(rows, spec)
    published = _published(rows, spec)
    live = _flag_missing_scope(history.filter(F.col(spec.current)), published, spec, periods, framework)

    columns = history.columns
    keys = list(spec.keys)
    carried = [c for c in columns if c not in keys and c not in spec.dimensions]
    types = dict(history.dtypes)
    arriving = _opened(published, spec, at)
    arriving = arriving.withColumns({c: F.lit(None).cast(types[c]) for c in carried if c not in arriving.columns})
    old = live.select(*keys, F.struct(*carried).alias("old"), "closable")
    new = arriving.select(*keys, F.struct(*carried).alias("new"))
    met = old.join(new, keys, "full")

    has_old, has_new = F.col("old").isNotNull(), F.col("new").isNotNull()
    differs = has_old & has_new & ~F.col(f"old.{HASH}").eqNullSafe(F.col(f"new.{HASH}"))
    missing = has_old & ~has_new & F.coalesce(F.col("closable"), F.lit(False))
    closed = F.col("old").withField(spec.valid_to, at).withField(spec.current, F.lit(False))
    old_label = F.when(differs, EXPIRED).when(missing, MISSING).otherwise(KEPT)
    old_row = F.struct(old_label.alias("change"), F.when(differs | missing, closed).otherwise(F.col("old")).alias("row"))
    new_row = F.struct(F.lit(INSERTED).alias("change"), F.col("new").alias("row"))
    emitted = F.array(
        F.when(has_old, old_row),
        F.when(has_new & (~has_old | differs), new_row),
    )
    result = met.select(*keys, F.inline(F.array_compact(emitted))).select("change", *keys, "row.*")
    result = _with_dimensions(result, spec).select("change", *columns)

    older = history.filter(F.col(spec.current).isNull() | ~F.col(spec.current))
    result = result.unionByName(older.select(F.lit(KEPT).alias("change"), "*"))
    if spec.gated:
        # Key and hash together: replaying a rejected batch adds nothing.
        # The hash is a condition beside the key (a range, since an equality would become a join key): rows that
        # already lie by their key stay where they are.
        known = history.select(*keys, F.col(HASH).alias("known"))
        named, arrived = known.alias("known_rows"), _rejected(rows).alias("arrived_rows")
        met_before = reduce(and_, [F.col(f"arrived_rows.{k}") == F.col(f"known_rows.{k}") for k in keys])
        same = F.col(f"arrived_rows.{HASH}").between(F.col("known_rows.known"), F.col("known_rows.known"))
        fresh = arrived.join(named, met_before & same, "left_anti")
        audit = _audited(fresh, spec, at).withColumn("change", F.lit(AUDIT))
        result = result.unionByName(audit, allowMissingColumns=True)
    return result.select("change", *columns)


def widen(history: DataFrame, batch: DataFrame) -> DataFrame:
    """The history with the columns a batch brings, NULL in all rows so far. They are carried, and tell no versions apart."""
    known = {f.name: f.dataType for f in history.schema}
    for field in batch.schema:
        if known.get(field.name, field.dataType) != field.dataType:
            raise SubmissionError(f"column {field.name} is {field.dataType.simpleString()} here and {known[field.name].simpleString()} in the history")
    new = [f for f in batch.schema if f.name not in known]
    return history.withColumns({f.name: F.lit(None).cast(f.dataType) for f in new}) if new else history


def merge(history: DataFrame, batch: DataFrame, at, spec: HistorySpec = MACRO, **scope) -> DataFrame:
    """The history after the batch."""
    return changes(history, batch, at, spec, **scope).drop("change")


def change_counts(changed: DataFrame) -> DataFrame:
    return changed.groupBy("change").agg(F.count(F.lit(1)).alias("row_count"))


def state_counts(history: DataFrame, spec: HistorySpec = MACRO) -> DataFrame:
    """Rows by status and currency."""
    return history.groupBy("BATCH_STATUS", spec.current).agg(F.count(F.lit(1)).alias("row_count"))


def published_view(history: DataFrame) -> DataFrame:
    """The last valid state: six columns of the published current rows."""
    served = history.filter((F.col("BATCH_STATUS") == PUBLISHED) & F.col("IS_CURRENT"))
    return served.select(KEY, "DATE", "IBS_AGG", "OBS_VALUE", "OBS_STATUS", "OBS_CONF")


def union_histories(histories, columns) -> DataFrame:
    """Several history tables as one: renamed validity columns, missing columns as NULL."""
    renames = {MICRO.valid_from: MACRO.valid_from, MICRO.valid_to: MACRO.valid_to, MICRO.current: MACRO.current}
    result = None
    for df in histories:
        df = df.withColumnsRenamed({k: v for k, v in renames.items() if k in df.columns})
        missing = [c for c in columns if c not in df.columns]
        df = df.withColumns({c: F.lit(None).cast("string") for c in missing if c != "OBS_VALUE"})
        value = F.col("OBS_VALUE") if "OBS_VALUE" in df.columns else F.lit(None)
        df = df.withColumn("OBS_VALUE", value.try_cast("double"))
        result = df if result is None else result.unionByName(df, allowMissingColumns=True)
    return result
