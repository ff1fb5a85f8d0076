"""Inputs derived from the star-schema tables: ledger, reported series, revisions, callers."""

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from seriesforge.functions.keys import join_key, segment
from seriesforge.functions.values import exact, strictest
from seriesforge.model import DIMENSIONS, KEY, LEDGER_SCHEMA, REPORTER
from seriesforge.operators import history as scd2
from seriesforge.operators import ledger, rules, validation
from seriesforge.operators.rules import Rulebook
from seriesforge.sources.staging import stage

BASELINE_AT = "2026-05-15 08:00:00"
REVISION_AT = "2026-08-14 08:00:00"
REPLAY_AT = "2026-08-15 08:00:00"

# The three checks the reference data is judged by.
RULES = [
    ("LBS_CC01", "All currencies", "5 and 6", "TO1:A", "", "[ISO:D]", "TO1:F", "UN9:U2", None, None, None),
    ("LBS_CC02", "Foreign currencies", "5 and 6", "TO1:F", "", "USD:F", "EUR:F", "JPY:F", "CHF:F", "GBP:F", "TO3:F"),
    ("LBS_CC:04", "Sectors", "10", "A", "", "B", "N", "..", None, None, None),
]


# Columns read from each table; a given schema spares the look into the files.
TABLES = {
    "lineitem": "l_orderkey bigint, l_linenumber int, l_suppkey bigint, l_extendedprice double, l_discount double, "
    "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderpriority string",
    "customer": "c_custkey bigint, c_nationkey int, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_nationkey int",
    "nation": "n_nationkey int, n_regionkey int",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{sf_dir}/{name}.parquet")


def _choose(column, choices: dict, otherwise) -> Column:
    result = F.lit(otherwise)
    for value, chosen in choices.items():
        result = F.when(F.col(column) == value, chosen).otherwise(result)
    return result


def country_of_region(column="n_regionkey") -> Column:
    return _choose(column, {0: "CA", 1: "US", 2: "GB", 3: "DE"}, "JP")


def ledger_rows(spark: SparkSession, sf_dir: str, where: str = "true", marks: dict | None = None) -> DataFrame:
    """Ledger rows, one per order line: a bank's position with a reporting country.

    Orders meet their customers before they meet the lines, so only the order key moves a line: the lines are the largest
    table, and a join on the customer would send them all a second time. `marks` are more columns, computed from a line.
    """
    marks = marks or {}
    banks = table(spark, sf_dir, "supplier")
    nations = table(spark, sf_dir, "nation")
    sign = F.when(F.col("l_discount") >= 0.08, -1).otherwise(1)
    line = ["l_orderkey", "l_linenumber", "l_suppkey", "l_returnflag", "l_linestatus", "l_shipdate"]
    lines = (
        table(spark, sf_dir, "lineitem")
        .filter(where)
        .select(*line, (F.col("l_extendedprice") * sign).alias("amount"), *[mark.alias(name) for name, mark in marks.items()])
        .join(banks, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(nations, F.col("s_nationkey") == F.col("n_nationkey"))
        .select(*line, "amount", *marks, country_of_region().alias("country"))
    )
    currencies = {"AUTOMOBILE": "USD", "BUILDING": "EUR", "FURNITURE": "JPY", "HOUSEHOLD": "CHF"}
    customers = table(spark, sf_dir, "customer").select("c_custkey", _choose("c_mktsegment", currencies, "GBP").alias("denom"))
    urgent = F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")
    orders = (
        table(spark, sf_dir, "orders")
        .select("o_orderkey", "o_custkey", F.when(urgent, "B").otherwise("N").alias("sector"))
        .join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .select("o_orderkey", "sector", "denom")
    )
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    modulo = F.col("l_orderkey") % 20
    quarter = F.concat_ws("-Q", F.year("l_shipdate").cast("string"), F.quarter("l_shipdate").cast("string"))
    columns = {
        "transaction_id": F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")),
        "reporting_country": F.col("country"),
        "reporting_institution": F.concat(F.lit("BANK_"), F.col("l_suppkey").cast("string")),
        "position_type": F.when(F.col("l_linestatus") == "O", "C").otherwise("L"),
        "instrument": F.lit("A"),
        "currency": F.col("denom"),
        "currency_type": F.when(F.col("l_returnflag") == "A", "D").otherwise("F"),
        "parent_country": F.lit("5J"),
        "bank_type": F.lit("A"),
        "counterpart_country": F.lit("5J"),
        "sector_code": F.col("sector"),
        "transaction_amount": F.col("amount"),
        "obs_conf": F.when(modulo == 0, "C").when(modulo == 1, "N").otherwise("F"),
        "ibs_agg_scope": F.lit("LBSR"),
        "date_scope": quarter,
        "transaction_timestamp": F.col("l_shipdate").cast("timestamp"),
    }
    return joined.select(*[columns[f.name].cast(f.dataType).alias(f.name) for f in LEDGER_SCHEMA], *marks)


def with_sector_totals(rows: DataFrame, own: Column, total: Column) -> DataFrame:
    """Rows where `own` holds, and beside them the same rows of sector A where `total` holds, from one pass over the rows."""
    sectors = F.array(F.when(own, F.struct(F.col("sector_code").alias("sector"))), F.when(total, F.struct(F.lit("A").alias("sector"))))
    spread = rows.withColumn("sent", F.explode(F.array_compact(sectors)))
    return spread.withColumn("sector_code", F.col("sent.sector")).select(*[f.name for f in LEDGER_SCHEMA])


def roll_up(spark: SparkSession, sf_dir: str, where: str = "true") -> DataFrame:
    return ledger.with_normal_status(ledger.rollup(ledger_rows(spark, sf_dir, where)))


def with_totals(series: DataFrame) -> DataFrame:
    """Series and the totals a country reports beside them: currencies, currency types, sectors."""
    own = F.struct(segment(F.col(KEY), "L_DENOM").alias("denom"), segment(F.col(KEY), "L_CURR_TYPE").alias("kind"))
    total = lambda kind: F.struct(F.lit("TO1").alias("denom"), F.lit(kind).alias("kind"))
    planes = F.array_compact(F.array(own, total("A"), F.when(own["kind"] == "F", total("F"))))
    sectors = F.array(segment(F.col(KEY), "L_CP_SECTOR"), F.lit("A"))
    spread = series.select("*", F.inline(planes)).select("*", F.explode(sectors).alias("sector"))
    replaced = {"L_DENOM": F.col("denom"), "L_CURR_TYPE": F.col("kind"), "L_CP_SECTOR": F.col("sector")}
    parts = [replaced.get(d, segment(F.col(KEY), d)) for d in DIMENSIONS]
    keyed = spread.withColumn(KEY, join_key(parts))
    sums = keyed.groupBy(KEY, "DATE", "IBS_AGG").agg(
        F.sum(exact(F.col("OBS_VALUE"))).cast("double").alias("OBS_VALUE"),
        F.lit("A").alias("OBS_STATUS"),
        strictest(F.col("OBS_CONF")).alias("OBS_CONF"),
    )
    return ledger.reported(sums)


def corrupt(batch: DataFrame) -> DataFrame:
    """Add 1000 to one total of every country-quarter whose number is divisible by 7."""
    country, date = segment(F.col(KEY), REPORTER), F.col("DATE")
    number = F.ascii(country) + F.substring(date, 1, 4).cast("int") * 4 + F.substring(date, 7, 1).cast("int")
    is_total = F.col(KEY).rlike(r"^Q\.S\.C\.A\.TO1\.A\.5J\.A\.[A-Z]{2}\.A\.5J$")
    return batch.withColumn(
        "OBS_VALUE", F.when(is_total & (number % 7 == 0), F.col("OBS_VALUE") + 1000).otherwise(F.col("OBS_VALUE"))
    )


def reported(spark: SparkSession, sf_dir: str, where: str = "true", broken: bool = True) -> DataFrame:
    batch = with_totals(roll_up(spark, sf_dir, where))
    return corrupt(batch) if broken else batch


def rule_table(spark: SparkSession) -> DataFrame:
    columns = ["Check No", "Description", "Dimensions1", "Aggregate_to_check1", "Calculation"]
    columns += [f"Component{i}" for i in range(1, 7)]
    return spark.createDataFrame(RULES, ", ".join(f"`{c}` string" for c in columns))


def rulebook(spark: SparkSession) -> Rulebook:
    return rules.load(rule_table(spark))


LATE_LINES = "l_linenumber <> 7"


def validated(spark: SparkSession, sf_dir: str, revision: bool, book: Rulebook | None = None) -> DataFrame:
    """Baseline: everything reconciles. Revision: fewer lines, and some totals are broken."""
    where = LATE_LINES if revision else "true"
    return validation.validate(reported(spark, sf_dir, where, broken=revision), book or rulebook(spark))


def baseline_history(spark: SparkSession, sf_dir: str, book: Rulebook | None = None) -> DataFrame:
    return scd2.initialise(validated(spark, sf_dir, revision=False, book=book), BASELINE_AT)


def cycle_inputs(spark: SparkSession, sf_dir: str) -> tuple:
    """The history after the baseline, and the revision to merge into it.

    Neither needs the other, so both jobs run at the same time.
    """
    book = rulebook(spark)
    with ThreadPoolExecutor(2) as pool:
        before = pool.submit(lambda: stage(baseline_history(spark, sf_dir, book), "baseline"))
        batch = pool.submit(lambda: stage(validated(spark, sf_dir, revision=True, book=book), "revision"))
        return before.result(), batch.result()


def revision_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    before, batch = cycle_inputs(spark, sf_dir)
    return scd2.changes(before, batch, REVISION_AT, check_unique=False)


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The history after both cycles, written once."""
    return stage(revision_changes(spark, sf_dir).drop("change"), "history")


def memberships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(principal, group): every customer with up to two groups; some have none."""
    country = country_of_region()
    submitter = F.concat(F.lit("submitter-"), F.lower(country))
    first = F.col("c_custkey") % 6
    groups = F.array(
        F.when(first == 0, "admin").when(first == 1, "researcher").when(first == 2, "public").when(first == 3, submitter),
        F.when(F.col("c_custkey") % 4 == 1, submitter),
    )
    customers = table(spark, sf_dir, "customer").join(
        table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")
    )
    # A row without group keeps a principal without membership.
    listed = F.array_append(F.array_compact(groups), F.lit(None).cast("string"))
    return customers.select(F.col("c_custkey").cast("string").alias("principal"), F.explode(listed).alias("group"))
