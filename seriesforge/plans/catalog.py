"""The registered queries: each takes a session and the folder of the input tables."""

from pyspark.sql import DataFrame, functions as F

from seriesforge.functions.keys import segment
from seriesforge.model import CODE_COLUMNS, DIMENSIONS, KEY, MICRO_SCHEMA, REPORTER, RESULT_COLUMNS, SERIES_KEYS
from seriesforge.operators import disclosure, governance, keycheck, ledger, rules, search, validation
from seriesforge.operators import history as scd2
from seriesforge.plans import cycle, intake, testbed
from seriesforge.sources import exports, feeds, ledger_store, submissions
from seriesforge.sources.history_store import HistoryStore
from seriesforge.sources.staging import fresh_path, stage

#: How each country's data changed; Germany sends without a word, and nobody knows the sender of Japan.
STATES = {"CA": "First Submission", "GB": "Revision", "JP": "Break in Series", "US": "Revision"}
RESEARCHER = frozenset({"researcher"})
ADMIN = frozenset({"admin"})
PUBLIC = frozenset({"public"})
SUBMITTER_CA = frozenset({"submitter-ca"})
CA_AND_RESEARCHER = frozenset({"submitter-ca", "researcher"})


def _texts(df: DataFrame) -> DataFrame:
    """Timestamps as text, so that the open end 9999-12-31 fits any client."""
    stamps = [c for c, t in df.dtypes if t.startswith("timestamp")]
    return df.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in stamps})


# ---- ledger and roll-up ------------------------------------------------------------------


def q_micro_ledger(spark, sf_dir):
    return _texts(testbed.ledger_rows(spark, sf_dir))


def q_batch_stamp(spark, sf_dir):
    rows = testbed.ledger_rows(spark, sf_dir).drop("ibs_agg_scope", "date_scope", "transaction_timestamp")
    return _texts(ledger.stamp(rows, "LBSR", "2026-Q1", testbed.BASELINE_AT))


def q_ledger_append(spark, sf_dir):
    path = fresh_path(spark, "ledger")
    claims = testbed.ledger_rows(spark, sf_dir, "l_linestatus = 'O'")
    liabilities = testbed.ledger_rows(spark, sf_dir, "l_linestatus <> 'O'").withColumn("channel", F.lit("web"))
    ledger_store.append(claims, path, "claims")
    ledger_store.append(liabilities, path, "liabilities")
    ledger_store.append(claims, path, "claims")  # sent again: replaces itself
    return ledger_store.read(spark, path).groupBy("date_scope", "reporting_country").agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count("channel").alias("with_channel"),
        F.sum(F.col("transaction_amount").cast("decimal(38,6)")).cast("double").alias("amount"),
    )


def q_normalise(spark, sf_dir):
    rows = testbed.ledger_rows(spark, sf_dir)
    untidy = rows.withColumns({c: F.concat(F.lit("  "), F.lower(c), F.lit(" ")) for c in CODE_COLUMNS})
    return ledger.normalise(untidy).groupBy(*CODE_COLUMNS).agg(F.count(F.lit(1)).alias("row_count"))


def q_codelist_offenders(spark, sf_dir):
    sector = F.when(F.col("currency") == "CHF", "x").when(F.col("currency") == "JPY", None).otherwise(F.lower("sector_code"))
    rows = testbed.ledger_rows(spark, sf_dir).withColumn("sector_code", sector)
    return ledger.codelist_offenders(ledger.normalise(rows))


def q_macro_rollup(spark, sf_dir):
    return testbed.roll_up(spark, sf_dir)


def q_conf_elevation(spark, sf_dir):
    return ledger.totals(testbed.ledger_rows(spark, sf_dir)).select(*SERIES_KEYS, "OBS_CONF")


def q_zero_drop(spark, sf_dir):
    rows = testbed.ledger_rows(spark, sf_dir)
    reversed_ = rows.filter("sector_code = 'N'").withColumn("transaction_amount", -F.col("transaction_amount"))
    # Beside them, four more instruments: tiny amounts, tinier ones, amounts between two huge ones, and only huge ones.
    huge, amount = F.lit(1e300), F.col("transaction_amount")
    sent = [("X1", F.lit(4e-7)), ("X2", F.lit(1e-300)), ("X3", huge), ("X3", amount), ("X3", -huge), ("X4", huge), ("X4", -huge)]
    more = F.explode(F.array(*[F.struct(F.lit(i).alias("instrument"), a.alias("transaction_amount")) for i, a in sent]))
    some = rows.filter("sector_code = 'B'").withColumn("more", more)
    extreme = some.withColumns({"instrument": F.col("more.instrument"), "transaction_amount": F.col("more.transaction_amount")}).drop("more")
    return ledger.rollup(rows.unionByName(reversed_).unionByName(extreme))


def q_micro_feed_csv(spark, sf_dir):
    path = feeds.write_feed(disclosure.feed(testbed.ledger_rows(spark, sf_dir)), fresh_path(spark, "feed"))
    return feeds.read_feed(spark, path)


def q_dominance(spark, sf_dir):
    return disclosure.rollup(disclosure.feed(testbed.ledger_rows(spark, sf_dir)))


# ---- keys --------------------------------------------------------------------------------


def q_explode_key(spark, sf_dir):
    return keycheck.explode(testbed.roll_up(spark, sf_dir))


def q_key_rejects(spark, sf_dir):
    quarter = F.substring("DATE", 7, 1)
    short = F.regexp_replace(KEY, r"\.[^.]*$", "")
    damaged = F.when(quarter == "1", short).when(quarter == "2", F.concat(KEY, F.lit(".X"))).when(quarter == "3", None)
    batch = testbed.roll_up(spark, sf_dir).withColumn(KEY, damaged.otherwise(F.col(KEY)))
    return keycheck.rejects(batch)


# ---- rules and validation ----------------------------------------------------------------


def wide_rules(spark, sf_dir) -> DataFrame:
    """A wide rule table with one row per part: footnotes, brackets, blanks, misfits."""
    part = testbed.table(spark, sf_dir, "part")
    kind, size = F.col("p_partkey") % 5, F.col("p_size")
    pair = kind.isin(0, 2)
    digit = (size % 10).cast("string")
    dims = F.when(kind == 0, "5 and 6").when(kind == 1, "10").when(kind == 2, "5, 6 and 12").when(kind == 3, "12").otherwise("9.0")
    return part.select(
        F.when(F.col("p_brand") != "Brand#11", F.concat(F.lit(" PC:"), F.col("p_partkey").cast("string"))).alias("Check No"),
        F.col("p_name").alias("Description"),
        dims.alias("Dimensions1"),
        F.when(size == 17, "…").when(pair, "TO1:A").otherwise(F.concat(F.lit("U"), digit)).alias("Aggregate_to_check1"),
        F.lit("").alias("Calculation"),
        F.when(pair, "[ISO:D]").otherwise(F.substring("p_type", 1, 1)).alias("first"),
        F.when(pair, F.concat(F.lit("UN9:U"), digit)).otherwise(" .. ").alias("second"),
        F.when(size % 3 == 0, "TO1").when(pair, " usd : F ").otherwise("[N]").alias("third"),
    )


def q_rules_parse(spark, sf_dir):
    shown = lambda codes: F.array_join(F.transform("dims", lambda d: F.concat(d, F.lit("="), codes[d])), ",")
    parsed = rules.parse(wide_rules(spark, sf_dir))
    totals = parsed.select(
        "check_no", "description", F.lit(0).alias("component_no"), shown(F.col("aggregate")).alias("codes")
    )
    parts = parsed.select("check_no", "description", "dims", F.posexplode("components").alias("at", "part")).select(
        "check_no", "description", (F.col("at") + 1).alias("component_no"), shown(F.col("part")).alias("codes")
    )
    return totals.unionByName(parts)


def q_rule_eval(spark, sf_dir):
    return validation.evaluate(testbed.reported(spark, sf_dir), testbed.rulebook(spark))


def _validated(spark, sf_dir):
    return validation.validate(testbed.reported(spark, sf_dir), testbed.rulebook(spark))


def q_validate(spark, sf_dir):
    return _validated(spark, sf_dir)


def q_batch_summary(spark, sf_dir):
    return validation.batch_summary(_validated(spark, sf_dir))


def q_batch_decision(spark, sf_dir):
    return validation.batch_decisions(_validated(spark, sf_dir))


# ---- history -----------------------------------------------------------------------------

VERSION_COLUMNS = [*SERIES_KEYS, "OBS_VALUE", "OBS_CONF", "FAILED_RULE_ID", "BATCH_STATUS",
                   "version_hash", "VALID_FROM", "VALID_TO", "IS_CURRENT"]


def _versions(df):
    return _texts(df.select(*VERSION_COLUMNS))


def q_version_hash(spark, sf_dir):
    batch = testbed.roll_up(spark, sf_dir).withColumn("FAILED_RULE_ID", F.lit(None).cast("string"))
    hashed = scd2.with_version_hash(batch, ["OBS_VALUE", "OBS_STATUS", "OBS_CONF", "FAILED_RULE_ID"])
    return hashed.select(*SERIES_KEYS, "version_hash")


def q_scd2_init(spark, sf_dir):
    return _versions(scd2.initialise(testbed.validated(spark, sf_dir, revision=True), testbed.REVISION_AT))


def q_schema_patch(spark, sf_dir):
    old = testbed.baseline_history(spark, sf_dir).drop("version_hash")
    return scd2.patch_schema(old).select(*SERIES_KEYS, "version_hash")


def _changed(spark, sf_dir, label):
    return _versions(testbed.revision_changes(spark, sf_dir).filter(F.col("change") == label))


def q_scd2_expire(spark, sf_dir):
    return _changed(spark, sf_dir, scd2.EXPIRED)


def q_scd2_insert(spark, sf_dir):
    return _changed(spark, sf_dir, scd2.INSERTED)


def q_scd2_quarantine(spark, sf_dir):
    return _changed(spark, sf_dir, scd2.AUDIT)


def q_scd2_delete(spark, sf_dir):
    return _changed(spark, sf_dir, scd2.MISSING)


def q_scd2_full(spark, sf_dir):
    return _versions(testbed.revision_changes(spark, sf_dir))


def q_scd2_change_counts(spark, sf_dir):
    return scd2.change_counts(testbed.revision_changes(spark, sf_dir))


def q_scd2_replay(spark, sf_dir):
    before, batch = testbed.cycle_inputs(spark, sf_dir)
    after = stage(scd2.merge(before, batch, testbed.REVISION_AT, check_unique=False), "history")
    return scd2.change_counts(scd2.changes(after, batch, testbed.REPLAY_AT, check_unique=False))


def _bank_feeds(spark, sf_dir, countries=None):
    """One value per series, bank and period: of all lines, and of the late ones.

    The rows are dealt once, by what a merge joins on (all are of one framework), so that the merge finds both sides in
    place. A cell has a row or two: a sum before the shuffle would spare none.
    """
    late = F.coalesce(F.expr(testbed.LATE_LINES), F.lit(False))
    rows = testbed.ledger_rows(spark, sf_dir, marks={"late": late})
    if countries:  # before the lines meet their orders
        rows = rows.filter(F.col("reporting_country").isin(*countries))
    dealt = disclosure.feed(rows, "late").repartition(KEY, "BANK_CODE", "DATE")
    amount = F.col("OBS_VALUE").cast("decimal(38,6)")
    sums = dealt.groupBy(*SERIES_KEYS, "BANK_CODE").agg(
        F.sum(amount).cast("double").alias("every"),
        F.sum(F.when(F.col("late"), amount)).cast("double").alias("revised"),
        F.max("late").alias("late"),
    )
    # Both ask for `late`, else the two shuffles would differ in a column and Spark would not do with one.
    feed = lambda where, value: sums.filter(where).select(*SERIES_KEYS, "BANK_CODE", F.col(value).alias("OBS_VALUE"))
    return feed(F.col("late").isNotNull(), "every"), feed("late", "revised")


def _micro_versions(df, *more):
    spec = scd2.MICRO
    return _texts(df.select(*spec.keys, "OBS_VALUE", *more, "version_hash", spec.valid_from, spec.valid_to, spec.current))


def q_scd2_micro(spark, sf_dir):
    every, batch = _bank_feeds(spark, sf_dir)
    before = scd2.initialise(every, testbed.BASELINE_AT, scd2.MICRO)
    after = scd2.merge(before, batch, testbed.REVISION_AT, scd2.MICRO, framework="LBSR", check_unique=False)
    return _micro_versions(after)


def q_scd2_micro_one_country(spark, sf_dir):
    """A revision by one of five countries leaves the others open."""
    before = scd2.initialise(_bank_feeds(spark, sf_dir)[0], testbed.BASELINE_AT, scd2.MICRO)
    batch = _bank_feeds(spark, sf_dir, ["CA"])[1]
    return _micro_versions(scd2.merge(before, batch, testbed.REVISION_AT, scd2.MICRO, check_unique=False))


def _store(spark, sf_dir):
    """A stored history after two submissions whose rows come with sector totals. In the second,
    British totals still count the late lines, so those checks fail."""
    rows = testbed.ledger_rows(spark, sf_dir)
    marked = testbed.ledger_rows(spark, sf_dir, marks={"late": F.coalesce(F.expr(testbed.LATE_LINES), F.lit(False))})
    every, late, british = F.lit(True), F.col("late"), F.col("reporting_country") == "GB"
    sent = {
        testbed.BASELINE_AT: testbed.with_sector_totals(rows, every, every),
        testbed.REVISION_AT: testbed.with_sector_totals(marked, late, late | british),
    }
    base = fresh_path(spark, "store")
    store = HistoryStore(spark, f"{base}/history")
    batches = [cycle.Submission(f"batch-{k}", batch, at) for k, (at, batch) in enumerate(sent.items())]
    cycle.run(batches, testbed.rulebook(spark), store, f"{base}/ledger")
    return store


def q_store_two_cycles(spark, sf_dir):
    return _versions(_store(spark, sf_dir).read())


def q_store_read_periods(spark, sf_dir):
    return _versions(_store(spark, sf_dir).read(["1994-Q2", "1996-Q1", "1996-Q4"]))


def q_store_micro_two_countries(spark, sf_dir):
    """A stored bank-level history of two countries; one of them revises its data, with a column more."""
    store = HistoryStore(spark, fresh_path(spark, "micro"), MICRO_SCHEMA, scd2.MICRO)
    both, revised = _bank_feeds(spark, sf_dir, ["CA", "GB"])[0], _bank_feeds(spark, sf_dir, ["CA"])[1]
    for at, feed in ((testbed.BASELINE_AT, both), (testbed.REVISION_AT, revised.withColumn("channel", F.lit("web")))):
        batch = stage(feed, "bank-feed")
        cycle.take(store, batch, at, sorted(r[0] for r in batch.select("DATE").distinct().collect()))
    return _micro_versions(store.read(), "channel")


def q_store_compacted(spark, sf_dir):
    """The stored history after its closing rows were folded into the versions they end."""
    store = _store(spark, sf_dir)
    store.compact(0.0)
    return _versions(store.read())


def _seen_in_store(spark, sf_dir, groups, request=None):
    seen = _store(spark, sf_dir).scan(groups, request)
    return seen.select(*SERIES_KEYS, "OBS_VALUE", "OBS_CONF", "BATCH_STATUS", "IS_CURRENT", "version_hash")


def q_store_rls_researcher(spark, sf_dir):
    return _seen_in_store(spark, sf_dir, RESEARCHER)


def q_store_rls_public(spark, sf_dir):
    return _seen_in_store(spark, sf_dir, PUBLIC)


def q_store_rls_submitter_ca(spark, sf_dir):
    return _seen_in_store(spark, sf_dir, SUBMITTER_CA)


def q_store_search(spark, sf_dir):
    request = search.SeriesFilter.build(reporting_country="gb", currency="EUR,USD", date_from="1994", include_quarantined=True)
    return _seen_in_store(spark, sf_dir, frozenset({"submitter-gb"}), request)


def _gated_micro(spark, sf_dir):
    """Baseline without a status, then a revision with British rows rejected."""
    every, revised = _bank_feeds(spark, sf_dir)
    before = scd2.initialise(every, testbed.BASELINE_AT, scd2.MICRO_GATED)
    rejected = segment(F.col(KEY), REPORTER) == "GB"
    batch = revised.withColumn(
        "BATCH_STATUS", F.when(rejected, "QUARANTINE").otherwise("PUBLISHED")
    )
    return scd2.merge(before, batch, testbed.REVISION_AT, scd2.MICRO_GATED, check_unique=False)


def q_scd2_micro_gated(spark, sf_dir):
    return _micro_versions(_gated_micro(spark, sf_dir), "BATCH_STATUS")


def q_two_cycle_state(spark, sf_dir):
    return testbed.history(spark, sf_dir).groupBy(REPORTER, "BATCH_STATUS", "IS_CURRENT").agg(
        F.count(F.lit(1)).alias("row_count"), F.countDistinct("DATE").alias("periods")
    )


def q_history_state(spark, sf_dir):
    return scd2.state_counts(testbed.history(spark, sf_dir))


def q_published_view(spark, sf_dir):
    return scd2.published_view(testbed.history(spark, sf_dir))


def q_history_union(spark, sf_dir):
    macro, micro = testbed.history(spark, sf_dir), _gated_micro(spark, sf_dir)
    both = scd2.union_histories([macro, micro], RESULT_COLUMNS)
    return both.select(*RESULT_COLUMNS)


# ---- governance --------------------------------------------------------------------------


def _governed(spark, sf_dir, groups):
    seen = governance.govern(testbed.history(spark, sf_dir), groups)
    return seen.select(*SERIES_KEYS, "OBS_VALUE", "OBS_CONF", "BATCH_STATUS", "IS_CURRENT", "version_hash")


def q_rls_admin(spark, sf_dir):
    return _governed(spark, sf_dir, ADMIN)


def q_rls_researcher(spark, sf_dir):
    return _governed(spark, sf_dir, RESEARCHER).drop("OBS_VALUE")


def q_rls_public(spark, sf_dir):
    return _governed(spark, sf_dir, PUBLIC)


def q_rls_submitter_ca(spark, sf_dir):
    return _governed(spark, sf_dir, SUBMITTER_CA)


def q_rls_multi(spark, sf_dir):
    return _governed(spark, sf_dir, CA_AND_RESEARCHER).drop("OBS_VALUE")


def q_mask_researcher(spark, sf_dir):
    return _governed(spark, sf_dir, RESEARCHER)


def q_mask_multi(spark, sf_dir):
    return _governed(spark, sf_dir, CA_AND_RESEARCHER)


def q_rls_micro(spark, sf_dir):
    rows = governance.govern_ledger(testbed.ledger_rows(spark, sf_dir), frozenset({"submitter-gb"}))
    return rows.select("transaction_id", "reporting_country", "reporting_institution", "transaction_amount")


def q_rls_counts(spark, sf_dir):
    return governance.visible_counts(testbed.history(spark, sf_dir), testbed.memberships(spark, sf_dir))


def q_persona(spark, sf_dir):
    return governance.personas(testbed.memberships(spark, sf_dir))


# ---- search ------------------------------------------------------------------------------


def _search(spark, sf_dir, groups, **request):
    return search.search(testbed.history(spark, sf_dir), search.SeriesFilter.build(**request), groups)


def q_search(spark, sf_dir):
    return _search(spark, sf_dir, RESEARCHER, reporting_country=["ca,us"], currency=["TO1", "USD"])


def q_search_period(spark, sf_dir):
    return _search(spark, sf_dir, PUBLIC, position="C", date_from="1995-Q2", date_to="1997-Q3", limit=20000)


def q_search_quarantine(spark, sf_dir):
    return _search(spark, sf_dir, SUBMITTER_CA, reporting_country="CA", include_quarantined=True, limit=20000)


def q_search_summary(spark, sf_dir):
    return search.page_summary(testbed.history(spark, sf_dir), search.SeriesFilter.build(reporting_country="CA,US,GB"), RESEARCHER)


def q_facets(spark, sf_dir):
    return search.facets(testbed.history(spark, sf_dir), frozenset({"submitter-us"}))


# ---- submissions and exports -------------------------------------------------------------


def _for_submission(spark, sf_dir):
    return disclosure.rollup(disclosure.feed(testbed.ledger_rows(spark, sf_dir)))


def q_lifecycle_status(spark, sf_dir):
    rows = submissions.lifecycle(testbed.roll_up(spark, sf_dir), STATES)
    return rows.select(*DIMENSIONS, "TIME_PERIOD", "OBS_STATUS", "SUBMISSION_TYPE", "DATASET_ACTION", "SENDER_ID", "DATASET_ID")


def q_submission_summary(spark, sf_dir):
    return submissions.summary(_for_submission(spark, sf_dir), STATES)


def q_submission_write(spark, sf_dir):
    batch = stage(_for_submission(spark, sf_dir), "submission")
    path = submissions.write_submissions(batch, fresh_path(spark, "submissions"), STATES, testbed.BASELINE_AT)
    header = "DataSetID string, DataSetAction string, Sender struct<_id: string, Name: string>"
    headers = spark.read.schema(header).format("xml").option("rowTag", "Header").load(f"{path}/headers")
    return headers.select(
        F.col("DataSetID").alias("dataset_id"),
        F.col("DataSetAction").alias("dataset_action"),
        F.col("Sender._id").alias("sender_id"),
        F.col("Sender.Name").alias("sender_name"),
    )


def q_submission_scan(spark, sf_dir):
    batch = stage(_for_submission(spark, sf_dir), "submission")
    path = submissions.write_submissions(batch, fresh_path(spark, "submissions"), STATES, testbed.BASELINE_AT)
    return submissions.read_submissions(spark, f"{path}/messages")


def q_submission_validate(spark, sf_dir):
    """Messages of five countries, some with broken totals, from files to decisions."""
    batch = stage(testbed.reported(spark, sf_dir), "submission")
    path = submissions.write_submissions(batch, fresh_path(spark, "submissions"), STATES, testbed.BASELINE_AT)
    return intake.judge(spark, f"{path}/messages", testbed.rulebook(spark)).decisions


def _exported(spark, sf_dir):
    """Everything a researcher may see of the current rows."""
    return search.matching(testbed.history(spark, sf_dir), search.SeriesFilter.build(), RESEARCHER)


def q_series_group(spark, sf_dir):
    return exports.series_lines(_exported(spark, sf_dir))


def q_sdmx_ml(spark, sf_dir):
    path = fresh_path(spark, "ml")
    exports.export(_exported(spark, sf_dir), "sdmx-ml", path)
    return exports.read_sdmx_ml(spark, path).groupBy("line").agg(F.count(F.lit(1)).alias("n"))


def q_sdmx_ml_roundtrip(spark, sf_dir):
    path = fresh_path(spark, "ml")
    exports.export(_exported(spark, sf_dir), "sdmx-ml", path, validate=True)
    element = F.regexp_extract("line", r"<(/?\w+)", 1).alias("element")
    return exports.read_sdmx_ml(spark, path).groupBy(element).agg(F.count(F.lit(1)).alias("n"))


def q_sdmx_json_dict(spark, sf_dir):
    return exports.json_dictionary(_exported(spark, sf_dir))


def q_sdmx_json_series(spark, sf_dir):
    return exports.json_series(stage(_exported(spark, sf_dir), "export"))


def q_sdmx_json_document(spark, sf_dir):
    """The series of a written document of two frameworks, with rejected and closed rows."""
    rows = testbed.history(spark, sf_dir)
    both = rows.unionByName(rows.filter(F.col(REPORTER) == "GB").withColumn("IBS_AGG", F.lit("LBSN")))
    path = fresh_path(spark, "json")
    exports.export(both, "sdmx-json", path)
    lines = spark.read.text(path).select(F.col("value").alias("line"))
    return lines.filter(F.col("line").rlike(r'^,?"[0-9:]+":\{')).groupBy("line").agg(F.count(F.lit(1)).alias("n"))


def q_sdmx_csv(spark, sf_dir):
    return exports.csv_rows(_exported(spark, sf_dir), "Replace")


def q_tidy_csv(spark, sf_dir):
    return exports.tidy_rows(_exported(spark, sf_dir))


def queries() -> dict:
    return {name: value for name, value in globals().items() if name.startswith("q_")}
