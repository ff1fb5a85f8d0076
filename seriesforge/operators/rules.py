"""Rulebook: from a wide table of cells to match terms a join can use."""

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from seriesforge.model import DIMENSIONS, REPORTER, RULE_COLUMNS, WILDCARD
from seriesforge.sources.staging import stage

# Cell patterns. An empty cell is blank or dots only; a footnote is the digits
# after a single letter (U2 is U), while TO1 and UN9 are codes.
EMPTY_CELL = r"^[.…\s]*$"
FOOTNOTE = r"^([A-Za-z])\d+$"
CELL_EDGE = r"^\s*[\[\]]*\s*|\s*[\[\]]*\s*$"

REPORTER_BIT = 1 << DIMENSIONS.index(REPORTER)


def _positions(cell):
    """Every whole number in the cell that names one of the dimensions."""
    numbers = F.transform(
        F.regexp_extract_all(F.coalesce(cell, F.lit("")), F.lit(r"(\d+)"), F.lit(1)),
        lambda n: n.try_cast("int"),
    )
    return F.filter(numbers, lambda n: F.coalesce(n.between(1, len(DIMENSIONS)), F.lit(False)))


def _codes(cell, dims):
    """Map from dimension to code, or NULL when the cell is empty or does not fit the dimensions."""
    text = F.regexp_replace(cell, CELL_EDGE, "")
    parts = F.split(text, ":", -1)
    clean = F.transform(parts, lambda p: F.regexp_replace(F.trim(p), FOOTNOTE, "$1"))
    pairs = F.arrays_zip(dims.alias("dim"), clean.alias("code"))
    # A dimension named twice keeps its last code.
    numbered = F.transform(pairs, lambda p, i: F.struct(p["dim"].alias("k"), p["code"].alias("v"), i.alias("i")))
    last = F.filter(numbered, lambda p: ~F.exists(numbered, lambda q: (q["k"] == p["k"]) & (q["i"] > p["i"])))
    entries = F.transform(last, lambda p: F.struct(p["k"], p["v"]))
    fits = cell.isNotNull() & ~text.rlike(EMPTY_CELL) & (F.size(parts) == F.size(dims))
    return F.when(fits, F.map_from_entries(entries))


def parse(wide: DataFrame) -> DataFrame:
    """One row per usable rule: check_no, description, dims, aggregate, components.

    `wide` has the five rule columns and any number of component columns, all text. Rows without
    a check number, without a known dimension, without a readable aggregate or without a readable
    component are left out.
    """
    component_columns = [c for c in wide.columns if c not in RULE_COLUMNS]
    names = F.array(*[F.lit(d) for d in DIMENSIONS])
    dims = F.transform(_positions(F.col("Dimensions1")), lambda p: F.element_at(names, p))
    ruled = wide.filter(F.col("`Check No`").isNotNull()).withColumn("dims", dims)
    cells = F.array(*[F.col(f"`{c}`") for c in component_columns])
    parsed = ruled.select(
        F.trim("`Check No`").alias("check_no"),
        F.trim(F.coalesce("Description", F.lit(""))).alias("description"),
        "dims",
        _codes(F.col("Aggregate_to_check1"), F.col("dims")).alias("aggregate"),
        F.array_compact(F.transform(cells, lambda c: _codes(c, F.col("dims")))).alias("components"),
    )
    return parsed.filter(
        (F.size("dims") > 0) & F.col("aggregate").isNotNull() & (F.size("components") > 0)
    )


def component_rows(parsed: DataFrame) -> DataFrame:
    """One row per rule component, numbered from 1 in column order."""
    return parsed.select(
        "check_no", "dims", F.posexplode("components").alias("at", "codes")
    ).select("check_no", "dims", (F.col("at") + 1).alias("component_no"), "codes")


WORD = 64


@dataclass(frozen=True)
class Rulebook:
    """Match terms of a rulebook, and a bitmap index of them.

    `terms` has one row per side of a rule: term (a number from 0), rule_id, check_no, rule_mask (its dimensions as
    bits) and is_total. `bitmaps` has, for each dimension that some term fixes and each code it is fixed to, the terms
    that allow the code as bits of `words` 64-bit words; terms that leave the dimension open are in every bitmap of it.
    `open_terms` gives these alone, for a code no term names. A key matches the terms in all its bitmaps.
    """

    terms: DataFrame
    bitmaps: DataFrame
    open_terms: dict
    words: int
    spans_reporters: bool


def _mask(has_bit):
    bits = [F.when(has_bit(d), F.lit(1 << i)).otherwise(F.lit(0)) for i, d in enumerate(DIMENSIONS)]
    return reduce(lambda a, b: a + b, bits)


def _words(entries, words: int):
    """An array of words from an array of (word, bits)."""
    bits_of = F.map_from_entries(entries)
    return F.transform(F.sequence(F.lit(0), F.lit(words - 1)), lambda w: F.coalesce(F.try_element_at(bits_of, w), F.lit(0).cast("long")))


def compile_rules(parsed: DataFrame) -> Rulebook:
    """Write the match terms of a parsed rulebook, and the bitmaps over them."""
    # Ids only have to differ; they are fixed by the write below. A rule that is listed twice has
    # two ids and is judged twice, with one outcome.
    numbered = parsed.withColumn("rule_id", F.monotonically_increasing_id())
    rule_mask = _mask(lambda d: F.array_contains("dims", d))
    sides = F.concat(
        F.array(F.struct(F.lit(True).alias("is_total"), F.col("aggregate").alias("codes"))),
        F.transform("components", lambda c: F.struct(F.lit(False).alias("is_total"), c.alias("codes"))),
    )
    side = numbered.select("rule_id", "check_no", rule_mask.alias("rule_mask"), F.posexplode(sides).alias("side", "s"))
    fixed = F.map_filter("s.codes", lambda d, code: code != WILDCARD)
    # A rulebook is a list that people keep, so numbering its terms is one small sort.
    term = (F.row_number().over(Window.orderBy("rule_id", "side")) - 1).alias("term")
    terms = stage(side.select(term, "rule_id", "check_no", "rule_mask", "s.is_total", fixed.alias("fixed")), "terms")
    place = (F.col("term") / WORD).cast("int").alias("word")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("term") % WORD)
    # A row per dimension and word: the terms that leave the dimension open, and whether any fixes it.
    each = F.explode(F.array(*[F.lit(d) for d in DIMENSIONS])).alias("dimension")
    has = F.map_contains_key("fixed", F.col("dimension"))
    facts = terms.select("term", "rule_mask", "fixed", each).groupBy("dimension", place).agg(
        F.bit_or(F.when(~has, bit)).alias("open"),
        F.bool_or(has).alias("fixed"),
        F.bool_or(F.col("rule_mask").bitwiseAND(REPORTER_BIT) != 0).alias("spans"),
    ).collect()
    words = max((r["word"] + 1 for r in facts), default=1)
    open_terms = {d: [0] * words for d in DIMENSIONS if any(r["fixed"] for r in facts if r["dimension"] == d)}
    for r in facts:
        if r["dimension"] in open_terms:
            open_terms[r["dimension"]][r["word"]] = r["open"] or 0
    named = terms.select("term", F.explode("fixed").alias("dimension", "code")).groupBy("dimension", "code", place).agg(F.bit_or(bit).alias("bits"))
    own = named.groupBy("dimension", "code").agg(_words(F.collect_list(F.struct("word", "bits")), words).alias("own"))
    if open_terms:
        literals = F.create_map(*[x for d, held in open_terms.items() for x in (F.lit(d), F.array(*[F.lit(w).cast("long") for w in held]))])
        both = F.zip_with("own", literals[F.col("dimension")], lambda a, b: a.bitwiseOR(b))
        bitmaps = stage(own.select("dimension", "code", both.alias("bits")), "term-bitmaps")
    else:
        bitmaps = parsed.sparkSession.createDataFrame([], "dimension string, code string, bits array<long>")
    return Rulebook(terms.drop("fixed"), bitmaps, open_terms, words, any(r["spans"] for r in facts))


def load(wide: DataFrame) -> Rulebook:
    return compile_rules(parse(wide))
