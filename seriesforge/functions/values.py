"""Observation values: exact sums, exact text, version fingerprints."""

from pyspark.sql import Column, functions as F

from seriesforge.model import CONFIDENTIALITY, EXACT

# Fixed value: stands for NULL inside a fingerprint, so that NULL and "" differ.
NULL_MARK = "\u0000NULL"


def exact(value: Column) -> Column:
    """A DOUBLE as an exact decimal. NaN counts as missing; an overflow is an error."""
    return F.nanvl(value, F.lit(None).cast("double")).cast(EXACT)


# ---- sums at any magnitude -----------------------------------------------------------------
#
# A double is the decimal number its shortest text shows: a whole mantissa and a power of ten. Powers are dealt to bins
# of nine, and a number is a whole part, in units of its bin, so that parts of one bin add up as whole numbers without
# rounding. The sums of the bins (74 at most) are joined at the end, with carries from bin to bin.

BIN_DIGITS = 9
#: Lowest power in bin 0, so that amounts with up to six decimals and fifteen digits share one bin.
BIN_START = -6
_PART = "decimal(38,0)"
_PLAIN_LIMIT = 1e15


def _is_plain(value: Column) -> Column:
    """Up to six decimals and fifteen digits before them: the cast says it all, without a look at the text."""
    short = value.between(-_PLAIN_LIMIT, _PLAIN_LIMIT)
    return short & (F.when(short, value).cast(EXACT).cast("double") == value)


def binned(value: Column) -> Column:
    """(bin, part) of a double; NaN counts as missing and has part NULL in bin 0. Infinity is an error."""
    number = F.nanvl(value, F.lit(None).cast("double"))
    text = F.upper(number.cast("string"))
    mantissa = F.substring_index(text, "E", 1)
    power = F.when(F.contains(text, F.lit("E")), F.substring_index(text, "E", -1).cast("int")).otherwise(0)
    last = power - F.length(F.substring_index(mantissa, ".", -1))  # Spark's text of a double has a point
    finite = F.when(F.abs(number) < float("inf"), last).otherwise(F.raise_error(F.lit("an amount is infinite")).cast("int"))
    place = F.floor((finite - BIN_START) / F.lit(BIN_DIGITS)).cast("int")
    whole = F.concat(mantissa, F.lit("E"), (power - BIN_START - place * BIN_DIGITS).cast("string")).cast(_PART)
    plain = _is_plain(number)
    # The unscaled digits of a number with six decimals, as a whole number.
    scaled = (F.when(plain, number).cast(EXACT) * F.lit(10 ** -BIN_START).cast("decimal(7,0)")).cast(_PART)
    zero = F.lit(0)
    return F.when(number.isNull(), F.struct(zero.alias("bin"), F.lit(None).cast(_PART).alias("part"))).when(
        plain, F.struct(zero.alias("bin"), scaled.alias("part"))
    ).otherwise(F.struct(place.alias("bin"), whole.alias("part")))


def joined(bins: Column) -> Column:
    """The double nearest to the sum of an array of (bin, part); NULL where no part is known.

    What exceeds nine digits is carried to the next bin, so that the bins become the digits of one number, which is
    read as text: only this last step rounds.
    """
    parts = F.filter(bins, lambda x: x["part"].isNotNull())
    first, last = F.array_min(F.transform(parts, lambda x: x["bin"])), F.array_max(F.transform(parts, lambda x: x["bin"]))
    unit = F.lit(10**BIN_DIGITS).cast("decimal(10,0)")

    def read(digits, place):
        return F.concat(digits, F.lit("E"), (place * BIN_DIGITS + BIN_START).cast("string")).cast("double")

    def carried(sign: int) -> Column:
        def step(state, place):
            own = F.aggregate(F.filter(parts, lambda x: x["bin"] == place), F.lit(0).cast(_PART), lambda total, x: (total + x["part"]).cast(_PART))
            total = (state["carry"] + own * sign).cast(_PART)
            low = F.pmod(total, unit)
            digits = F.lpad(low.cast("decimal(9,0)").cast("string"), BIN_DIGITS, "0")
            return F.struct(((total - low) / unit).cast(_PART).alias("carry"), F.concat(digits, state["digits"]).alias("digits"))

        return F.aggregate(F.sequence(first, last), F.struct(F.lit(0).cast(_PART).alias("carry"), F.lit("").alias("digits")), step)

    def whole(state):
        return read(F.concat(state["carry"].cast("string"), state["digits"]), first)

    single = F.get(parts, F.lit(0))
    many = F.when(carried(1)["carry"] >= 0, whole(carried(1))).otherwise(-whole(carried(-1)))  # a sum below 0 ends with a carry below 0
    none = F.lit(None).cast("double")
    return F.when(F.size(parts) == 0, none).when(F.size(parts) == 1, read(single["part"].cast("string"), single["bin"])).otherwise(many)


def exact_text(value: Column) -> Column:
    """Text that tells any two different doubles apart, and is the same in every SQL engine
    for a value with up to six decimals."""
    as_decimal = value.try_cast(EXACT)
    return F.when(as_decimal.cast("double") == value, as_decimal.cast("string")).otherwise(
        value.cast("string")
    )


def plain_text(value: Column) -> Column:
    """`exact_text` without trailing zeros, for export."""
    text = exact_text(value)
    fraction = F.regexp_replace(text, r"\.?0+$", "")
    return F.when(text.rlike(r"^-?\d+\.\d*0$"), fraction).otherwise(text)


def fingerprint(columns, types) -> Column:
    """SHA-256 over the payload columns; `types` maps a column to its Spark type name."""
    parts = [
        F.coalesce(
            exact_text(F.col(c)) if types[c] == "double" else F.col(c).cast("string"),
            F.lit(NULL_MARK),
        )
        for c in columns
    ]
    return F.sha2(F.concat_ws("||", *parts), 256)


def strictness(conf: Column) -> Column:
    """0 for F and anything unknown, 1 for N, 2 for C."""
    return F.when(conf == CONFIDENTIALITY[2], 2).when(conf == CONFIDENTIALITY[1], 1).otherwise(0)


def flag_of(strict: Column) -> Column:
    return F.element_at(F.array(*[F.lit(c) for c in CONFIDENTIALITY]), strict + 1)


def strictest(conf: Column) -> Column:
    """Aggregate: the most restrictive flag of a group. One integer of state per group."""
    return flag_of(F.max(strictness(conf)))
