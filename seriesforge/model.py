"""Data model: dimension order, schemas and code lists."""

from pyspark.sql import types as T

# The 11 key dimensions, in key order.
DIMENSIONS = (
    "FREQ",
    "L_MEASURE",
    "L_POSITION",
    "L_INSTR",
    "L_DENOM",
    "L_CURR_TYPE",
    "L_PARENT_CTY",
    "L_REP_BANK_TYPE",
    "L_REP_CTY",
    "L_CP_SECTOR",
    "L_CP_COUNTRY",
)
REPORTER = "L_REP_CTY"

# Permitted counterparty sectors.
SECTOR_CODES = ("A", "B", "C", "F", "G", "H", "M", "N", "U")

# Confidentiality flags, from least to most restrictive.
CONFIDENTIALITY = ("F", "N", "C")

# Tolerance of a cross-check, dominance threshold, rule wildcard.
TOLERANCE = "0.0001"
DOMINANCE_THRESHOLD = 0.60
WILDCARD = "ISO"

# Frequency and measure of every rolled-up series, and the default framework.
FREQUENCY = "Q"
MEASURE = "S"
FRAMEWORK = "LBSR"

PUBLISHED = "PUBLISHED"
QUARANTINE = "QUARANTINE"
NORMAL_STATUS = "A"
BREAK_STATUS = "B"
OPEN_END = "9999-12-31 00:00:00"

# Amounts are added up in this type, so that a sum does not depend on the order of its rows.
EXACT = "decimal(38,6)"

KEY = "TIME_SERIES_CODE"
SERIES_KEYS = (KEY, "DATE", "IBS_AGG")


def _fields(*specs):
    return T.StructType([T.StructField(name, kind, nullable) for name, kind, nullable in specs])


LEDGER_SCHEMA = _fields(
    ("transaction_id", T.StringType(), True),
    ("reporting_country", T.StringType(), True),
    ("reporting_institution", T.StringType(), True),
    ("position_type", T.StringType(), True),
    ("instrument", T.StringType(), True),
    ("currency", T.StringType(), True),
    ("currency_type", T.StringType(), True),
    ("parent_country", T.StringType(), True),
    ("bank_type", T.StringType(), True),
    ("counterpart_country", T.StringType(), True),
    ("sector_code", T.StringType(), True),
    ("transaction_amount", T.DoubleType(), True),
    ("obs_conf", T.StringType(), True),
    ("ibs_agg_scope", T.StringType(), True),
    ("date_scope", T.StringType(), True),
    ("transaction_timestamp", T.TimestampType(), True),
)

# The columns a whole submission shares.
STAMPED = ("ibs_agg_scope", "date_scope", "transaction_timestamp")

# Code columns brought to upper case before a key is built from them.
CODE_COLUMNS = (
    "reporting_country",
    "position_type",
    "instrument",
    "currency",
    "currency_type",
    "parent_country",
    "bank_type",
    "counterpart_country",
    "sector_code",
    "obs_conf",
    "ibs_agg_scope",
)

# Ledger column that feeds each dimension after FREQ and L_MEASURE.
DIMENSION_SOURCES = {
    "L_POSITION": "position_type",
    "L_INSTR": "instrument",
    "L_DENOM": "currency",
    "L_CURR_TYPE": "currency_type",
    "L_PARENT_CTY": "parent_country",
    "L_REP_BANK_TYPE": "bank_type",
    "L_REP_CTY": "reporting_country",
    "L_CP_SECTOR": "sector_code",
    "L_CP_COUNTRY": "counterpart_country",
}

FEED_SCHEMA = _fields(
    (KEY, T.StringType(), True),
    ("BANK_CODE", T.StringType(), True),
    ("DATE", T.StringType(), True),
    ("IBS_AGG", T.StringType(), True),
    ("OBS_VALUE", T.DoubleType(), True),
)

BATCH_SCHEMA = _fields(
    (KEY, T.StringType(), False),
    ("DATE", T.StringType(), False),
    ("IBS_AGG", T.StringType(), False),
    ("OBS_VALUE", T.DoubleType(), True),
    ("OBS_STATUS", T.StringType(), True),
    ("OBS_CONF", T.StringType(), True),
    ("QUALITY_STATUS", T.StringType(), True),
    ("FAILED_RULE_ID", T.StringType(), True),
    ("BATCH_STATUS", T.StringType(), True),
)
BATCH_COLUMNS = tuple(BATCH_SCHEMA.fieldNames())

HISTORY_SCHEMA = T.StructType(
    [T.StructField(f.name, f.dataType, True) for f in BATCH_SCHEMA]
    + [T.StructField(d, T.StringType(), True) for d in DIMENSIONS]
    + [
        T.StructField("version_hash", T.StringType(), True),
        T.StructField("VALID_FROM", T.TimestampType(), True),
        T.StructField("VALID_TO", T.TimestampType(), True),
        T.StructField("IS_CURRENT", T.BooleanType(), True),
    ]
)

# The history of bank-level values.
MICRO_SCHEMA = T.StructType(
    [T.StructField(f.name, f.dataType, True) for f in FEED_SCHEMA]
    + [
        T.StructField(REPORTER, T.StringType(), True),
        T.StructField("version_hash", T.StringType(), True),
        T.StructField("effective_start_date", T.TimestampType(), True),
        T.StructField("effective_end_date", T.TimestampType(), True),
        T.StructField("is_current", T.BooleanType(), True),
    ]
)

# Columns a search returns ahead of the dimensions.
RESULT_COLUMNS = (
    KEY,
    "DATE",
    "IBS_AGG",
    "OBS_VALUE",
    "OBS_STATUS",
    "OBS_CONF",
    "QUALITY_STATUS",
    "BATCH_STATUS",
    "IS_CURRENT",
)

# Rulebook columns that are not component columns.
RULE_COLUMNS = ("Check No", "Description", "Dimensions1", "Aggregate_to_check1", "Calculation")
