"""Cross-checks of a batch, and the verdict each country-period receives as a whole."""

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from seriesforge.functions.keys import segment
from seriesforge.functions.values import exact
from seriesforge.model import BATCH_COLUMNS, DIMENSIONS, KEY, PUBLISHED, QUARANTINE, REPORTER, TOLERANCE
from seriesforge.operators.keycheck import assert_keys
from seriesforge.operators.rules import WORD, Rulebook
from seriesforge.sources.staging import stage

CONTEXT = ("rule_id", "check_no", "context", "DATE", "IBS_AGG")


def _clean_dimensions(df: DataFrame) -> DataFrame:
    return df.withColumns({d: F.upper(F.trim(segment(F.col(KEY), d))) for d in DIMENSIONS})


def with_terms(rows: DataFrame, book: Rulebook) -> DataFrame:
    """Rows with `matched`: the terms each matches, as words of bits. No row is added or dropped.

    A row looks up one bitmap per dimension that some term fixes, and the AND of them is what it matches. The bitmaps
    of a dimension are a written table: Spark broadcasts it while it is below the session's size limit.
    """
    if not book.open_terms:  # no term fixes anything: every term matches
        numbers = book.terms.agg(F.count(F.lit(1)).alias("n")).first()["n"]
        every = [((1 << min(max(numbers - WORD * w, 0), WORD)) - 1) for w in range(book.words)]
        return rows.withColumn("matched", _literal(every))
    found = []
    for d, held in book.open_terms.items():
        codes = book.bitmaps.filter(F.col("dimension") == d).select(F.col("code").alias(d), F.col("bits").alias(f"bits_{d}"))
        rows = rows.join(codes, d, "left")
        found.append(F.coalesce(f"bits_{d}", _literal(held)))
    if book.words == 1:
        matched = F.array(reduce(lambda a, b: a.bitwiseAND(b), [F.element_at(bits, 1) for bits in found]))
    else:
        matched = reduce(lambda a, b: F.zip_with(a, b, lambda x, y: x.bitwiseAND(y)), found)
    return rows.withColumn("matched", matched).drop(*[f"bits_{d}" for d in book.open_terms])


def _literal(words) -> Column:
    signed = [w - (1 << WORD) if w >= 1 << (WORD - 1) else w for w in words]
    return F.array(*[F.lit(w).cast("long") for w in signed])


def _matches(df: DataFrame, book: Rulebook) -> DataFrame:
    """Each observation beside every rule term it matches; observations without a match go before anything is multiplied."""
    rows = _clean_dimensions(df).select(*DIMENSIONS, "DATE", "IBS_AGG", exact(F.col("OBS_VALUE")).alias("amount"))
    some = with_terms(rows, book).filter(F.exists("matched", lambda w: w != 0))
    bits = F.sequence(F.lit(0), F.lit(WORD - 1))
    is_set = lambda word, bit: F.call_function("shiftrightunsigned", word, bit).bitwiseAND(F.lit(1).cast("long")) == 1

    def numbers_of(word, at):
        of_word = F.transform(F.filter(bits, lambda bit: is_set(word, bit)), lambda bit: at * WORD + bit)
        return F.when(word == 0, F.array().cast("array<int>")).otherwise(of_word)

    numbers = F.transform("matched", numbers_of)
    matched = some.withColumn("term", F.explode(F.flatten(numbers))).drop("matched").join(book.terms, "term")
    # The context of a rule is the key with the rule's own dimensions blanked out.
    open_dims = [
        F.when(F.col("rule_mask").bitwiseAND(1 << i) == 0, F.col(d)).otherwise(F.lit("*"))
        for i, d in enumerate(DIMENSIONS)
    ]
    return matched.withColumn("context", F.concat_ws(".", *open_dims))


def _sums(df: DataFrame, book: Rulebook) -> DataFrame:
    total = F.col("is_total")
    return _matches(df, book).groupBy(*CONTEXT, REPORTER).agg(
        F.count(F.when(total, 1)).alias("total_rows"),
        F.sum(F.when(total, F.col("amount"))).alias("total"),
        F.count(F.when(~total, 1)).alias("part_rows"),
        F.sum(F.when(~total, F.col("amount"))).alias("parts"),
    )


def _judge(sums: DataFrame) -> DataFrame:
    """Keep contexts that report both sides and compare them."""
    zero = F.lit(0).cast("decimal(38,6)")
    both = sums.filter((F.col("total_rows") > 0) & (F.col("part_rows") > 0))
    difference = F.abs(F.coalesce("total", zero) - F.coalesce("parts", zero))
    return both.withColumns(
        {
            "total": F.coalesce("total", zero).cast("double"),
            "parts": F.coalesce("parts", zero).cast("double"),
            "failed": difference >= F.lit(TOLERANCE).cast("decimal(38,6)"),
        }
    )


def _over_reporters(sums: DataFrame) -> DataFrame:
    """Bring together the reporters of one context, for rules that cut across reporters."""
    return sums.groupBy(*CONTEXT).agg(
        *[F.sum(c).alias(c) for c in ("total_rows", "total", "part_rows", "parts")]
    )


def evaluate(df: DataFrame, book: Rulebook) -> DataFrame:
    """One row per rule and context: total, sum of parts, failed or not."""
    sums = _sums(df, book)
    judged = _judge(_over_reporters(sums) if book.spans_reporters else sums)
    return judged.select(
        "check_no", "context", "DATE", "IBS_AGG", "total_rows", "part_rows", "total", "parts", "failed"
    )


def verdicts(df: DataFrame, book: Rulebook) -> DataFrame:
    """One row per failing country and period, with its failed checks in sorted order."""
    sums = _sums(df, book)
    if book.spans_reporters:
        sums = stage(sums, "context-sums")
        failing = _judge(_over_reporters(sums)).filter("failed").select(*CONTEXT)
        failed = sums.filter(F.col("total_rows") > 0).join(failing, list(CONTEXT), "left_semi")
    else:
        failed = _judge(sums).filter("failed")
    # The set per group is bounded by the number of check codes in the rulebook.
    return failed.groupBy(REPORTER, "DATE").agg(
        F.array_join(F.array_sort(F.collect_set("check_no")), ",").alias("FAILED_RULE_ID")
    )


def apply_verdicts(df: DataFrame, failing: DataFrame, more: tuple = ()) -> DataFrame:
    """Mark every row of a failing country-period, and publish the rest; columns of `more` are kept in front."""
    reporter = F.upper(F.trim(segment(F.col(KEY), REPORTER)))
    judged = df.withColumn(REPORTER, reporter).join(failing, [REPORTER, "DATE"], "left")
    failed = F.col("FAILED_RULE_ID").isNotNull()
    return judged.withColumns(
        {
            "QUALITY_STATUS": F.when(failed, "FAIL").otherwise("PASS"),
            "BATCH_STATUS": F.when(failed, QUARANTINE).otherwise(PUBLISHED),
        }
    ).select(*more, *BATCH_COLUMNS)


def validate(df: DataFrame, book: Rulebook, staged: bool = False) -> DataFrame:
    """The batch with QUALITY_STATUS, FAILED_RULE_ID and BATCH_STATUS on every row.

    The batch is read three times (key check, sums, verdicts), so it is written first unless the
    caller already did. The verdicts, at most one row per country and period, are written too.
    """
    batch = df if staged else stage(df, "batch")
    assert_keys(batch)
    failing = stage(verdicts(batch, book), "verdicts")
    return apply_verdicts(batch, failing)


def batch_summary(validated: DataFrame) -> DataFrame:
    """Rows per country, period, status and failed checks."""
    reporter = segment(F.col(KEY), REPORTER).alias("REP_CTY")
    return validated.groupBy(reporter, "DATE", "BATCH_STATUS", "FAILED_RULE_ID").agg(
        F.count(F.lit(1)).alias("row_count")
    )


def batch_decisions(validated: DataFrame) -> DataFrame:
    """One row per submitting country and period."""
    return validated.select(
        F.upper(F.trim(segment(F.col(KEY), REPORTER))).alias("SUBMITTING_COUNTRY"),
        "DATE",
        "BATCH_STATUS",
    ).distinct()
