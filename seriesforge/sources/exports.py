"""Results in the four wire formats. Every export is a distributed write to a folder."""

import json
import uuid
from dataclasses import dataclass
from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from seriesforge.errors import ExportError, NothingToExport
from seriesforge.functions.values import plain_text
from seriesforge.model import DIMENSIONS, KEY, PUBLISHED
from seriesforge.operators.keycheck import ATTRIBUTES, explode
from seriesforge.sources.staging import stage

# The dataflow results are reported against, action codes, namespaces and the
# JSON schema address.
AGENCY, DATAFLOW, DATAFLOW_VERSION = "BIS", "WS_LBS_D_PUB", "1.0"
ACTION_CODES = {"Information": "I", "Append": "A", "Replace": "R", "Delete": "D"}
NAMESPACES = {
    "mes": "http://www.sdmx.org/resources/sdmxml/schemas/v3_0/message",
    "com": "http://www.sdmx.org/resources/sdmxml/schemas/v3_0/common",
    "xsi": "http://www.w3.org/2001/XMLSchema-instance",
}
JSON_SCHEMA = (
    "https://raw.githubusercontent.com/sdmx-twg/sdmx-json/master/data-message/"
    "tools/schemas/2.0.0/sdmx-json-data-schema.json"
)
MESSAGE_TYPE = "StructureSpecificData"
MARKS = ("TIME_PERIOD",) + ATTRIBUTES
COMPONENTS = DIMENSIONS + MARKS

REFERENCE = f"{AGENCY}:{DATAFLOW}({DATAFLOW_VERSION})"
URN = f"urn:sdmx:org.sdmx.infomodel.datastructure.Dataflow={REFERENCE}"
STRUCTURE_ID = f"{AGENCY}_{DATAFLOW}_{DATAFLOW_VERSION.replace('.', '_')}"

SENDER = ("SERIESFORGE", "Series data export")


def _check_action(action: str) -> None:
    if action not in ACTION_CODES:
        raise ExportError(f"unknown dataset action {action!r}; expected one of {sorted(ACTION_CODES)}")


# ---- CSV ---------------------------------------------------------------------------------


def csv_rows(df: DataFrame, action: str = "Information") -> DataFrame:
    """SDMX-CSV 2.0.0 rows: each names its structure and action; a missing cell is blank."""
    _check_action(action)
    blank = F.lit("")
    rows = explode(df)
    return rows.select(
        F.lit("dataflow").alias("STRUCTURE"),
        F.lit(REFERENCE).alias("STRUCTURE_ID"),
        F.lit(ACTION_CODES[action]).alias("ACTION"),
        *DIMENSIONS,
        "TIME_PERIOD",
        F.coalesce(plain_text(F.nanvl("OBS_VALUE", F.lit(None).cast("double"))), blank).alias("OBS_VALUE"),
        *[F.coalesce(a, blank).alias(a) for a in ATTRIBUTES],
    )


def tidy_rows(df: DataFrame, columns=None) -> DataFrame:
    """Composite key, components and, where the input has them, framework and status columns."""
    kept = [c for c in ("IBS_AGG", "BATCH_STATUS", "QUALITY_STATUS") if c in df.columns]
    rows = explode(df, [KEY] + kept).withColumnsRenamed({f"+{c}": c for c in [KEY] + kept})
    names = [KEY, *DIMENSIONS, "TIME_PERIOD", "OBS_VALUE", *ATTRIBUTES, *kept]
    if columns:
        unknown = [c for c in columns if c not in names]
        if unknown:
            raise ExportError(f"unknown export column(s): {unknown}")
        names = list(columns)
    return rows.select(*names)


def _write_csv(rows: DataFrame, path: str) -> None:
    rows.write.csv(path, header=True, emptyValue="", nullValue="")


def write_sdmx_csv(df: DataFrame, path: str, action: str = "Information") -> str:
    _write_csv(csv_rows(df, action), path)
    return path


def write_tidy_csv(df: DataFrame, path: str, columns=None) -> str:
    rows = tidy_rows(df, columns)
    if "OBS_VALUE" in rows.columns:
        rows = rows.withColumn("OBS_VALUE", plain_text(F.col("OBS_VALUE")))
    _write_csv(rows, path)
    return path


# ---- XML ---------------------------------------------------------------------------------


def _escaped(text: Column) -> Column:
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("\n", "&#10;"), ("\r", "&#13;")):
        text = F.replace(text, F.lit(plain), F.lit(entity))
    return text


def _attribute(name: str, text: Column) -> Column:
    """ name="text", or nothing when the text is missing or blank."""
    written = F.concat(F.lit(f' {name}="'), _escaped(text), F.lit('"'))
    return F.when(text.isNotNull() & (text != ""), written).otherwise("")


def series_lines(df: DataFrame) -> DataFrame:
    """The body of a message as text lines with their order: (TIME_SERIES_CODE, part,
    TIME_PERIOD, line), where part 0 opens a series, 1 is an observation and 2 closes it.

    Sorting puts the observations of a series between its tags, so no task has to hold a series:
    it may have any number of observations, and its lines may run over several files.
    """
    rows = explode(df)
    key = F.concat_ws(".", *DIMENSIONS)
    observations = rows.select(
        key.alias(KEY),
        F.lit(1).alias("part"),
        "TIME_PERIOD",
        F.concat(
            F.lit("      <Obs"),
            _attribute("TIME_PERIOD", F.col("TIME_PERIOD")),
            _attribute("OBS_VALUE", plain_text(F.nanvl("OBS_VALUE", F.lit(None).cast("double")))),
            *[_attribute(a, F.col(a)) for a in ATTRIBUTES],
            F.lit("/>"),
        ).alias("line"),
    )
    opening = F.concat(F.lit("    <Series"), *[_attribute(d, F.col(d)) for d in DIMENSIONS], F.lit(">"))
    tags = F.array(
        F.struct(F.lit(0).alias("part"), F.lit("").alias("TIME_PERIOD"), opening.alias("line")),
        F.struct(F.lit(2).alias("part"), F.lit("").alias("TIME_PERIOD"), F.lit("    </Series>").alias("line")),
    )
    series = rows.select(*DIMENSIONS).distinct().select(key.alias(KEY), F.inline(tags))
    return observations.unionByName(series)


def _frame(spark: SparkSession, sender, action, dataset_id, message_id, prepared) -> DataFrame:
    """Lines before (section 0) and after (section 2) the body."""

    def attr(text):
        return text.replace("&", "&amp;").replace("<", "&lt;").replace('"', "&quot;")

    spaces = " ".join(f'xmlns:{p}="{u}"' for p, u in NAMESPACES.items())
    head = [
        '<?xml version="1.0" encoding="UTF-8"?>',
        f"<mes:{MESSAGE_TYPE} {spaces}>",
        "  <mes:Header>",
        f"    <mes:ID>{attr(message_id)}</mes:ID>",
        "    <mes:Test>false</mes:Test>",
        f"    <mes:Prepared>{attr(prepared)}</mes:Prepared>",
        f'    <mes:Sender id="{attr(sender[0])}"><com:Name xml:lang="en">{attr(sender[1])}</com:Name></mes:Sender>',
        f'    <mes:Structure structureID="{STRUCTURE_ID}" namespace="{URN}" dimensionAtObservation="TIME_PERIOD">',
        f"      <com:Structure>{URN}</com:Structure>",
        "    </mes:Structure>",
        f"    <mes:DataSetAction>{action}</mes:DataSetAction>",
        f"    <mes:DataSetID>{attr(dataset_id)}</mes:DataSetID>",
        "  </mes:Header>",
        f'  <mes:DataSet structureRef="{STRUCTURE_ID}" action="{action}">',
    ]
    tail = ["  </mes:DataSet>", f"</mes:{MESSAGE_TYPE}>"]
    rows = [(0, i, line) for i, line in enumerate(head)] + [(2, i, line) for i, line in enumerate(tail)]
    return spark.createDataFrame(rows, "section int, part int, line string")


def write_sdmx_ml(
    df: DataFrame,
    path: str,
    output_type: str = MESSAGE_TYPE,
    sender=SENDER,
    action: str = "Information",
    dataset_id: str | None = None,
    message_id: str | None = None,
    prepared: str | None = None,
    validate: bool = False,
) -> str:
    """SDMX-ML 3.0 message. The files, put together in name order, are the document.

    Message id and time are arguments: with both given, the same result gives the same bytes.
    """
    if output_type != MESSAGE_TYPE:
        raise ExportError(f"{output_type!r} is not a data message of the standard; only {MESSAGE_TYPE} is")
    _check_action(action)
    now = datetime.now(timezone.utc)
    frame = _frame(
        df.sparkSession,
        sender,
        action,
        dataset_id or f"{DATAFLOW}_{now:%Y%m%dT%H%M%SZ}",
        message_id or str(uuid.uuid4()),
        prepared or f"{now:%Y-%m-%dT%H:%M:%SZ}",
    )
    body = series_lines(df).withColumn("section", F.lit(1))
    ordered = body.unionByName(frame, allowMissingColumns=True)
    # The whole sort key spreads the lines of one large series over several tasks.
    ordered.orderBy("section", KEY, "part", "TIME_PERIOD", "line").select("line").write.text(path)
    if validate:
        check_sdmx_ml(df, path)
    return path


OBS_SCHEMA = "_TIME_PERIOD string, _OBS_VALUE string, _OBS_STATUS string, _OBS_CONF string"


def read_sdmx_ml(spark: SparkSession, path: str) -> DataFrame:
    """Body lines of a written message."""
    lines = spark.read.text(path).select(F.col("value").alias("line"))
    return lines.filter(F.trim("line").rlike("^<(Series|Obs|/Series)"))


def check_sdmx_ml(df: DataFrame, path: str) -> None:
    """Read a message back: every line that was meant to be there is, and nothing else."""
    back = read_sdmx_ml(df.sparkSession, path)
    found = back.groupBy("line").agg(F.count(F.lit(1)).alias("n"))
    meant = series_lines(df).groupBy("line").agg(F.count(F.lit(1)).alias("n"))
    different = found.join(meant.withColumnRenamed("n", "m"), "line", "full").filter(~F.col("n").eqNullSafe(F.col("m")))
    sample = different.limit(1).collect()
    if sample:
        raise ExportError(f"the message at {path} does not read back: {sample[0]['line']!r}")
    observations = back.filter(F.trim("line").startswith("<Obs"))
    unread = observations.filter(F.from_xml("line", OBS_SCHEMA, {"rowTag": "Obs"})["_TIME_PERIOD"].isNull())
    if not unread.isEmpty():
        raise ExportError(f"the message at {path} has an unreadable observation")


# ---- JSON --------------------------------------------------------------------------------


#: Stand for a missing code, and part codes, in the name of a mark.
_MISSING, _SEPARATOR = "\u0000", "\u0001"


def _series_name(columns=DIMENSIONS) -> Column:
    return F.concat_ws(".", *columns)


def _mark_name() -> Column:
    """Names a period with its attributes."""
    return F.concat_ws(_SEPARATOR, *[F.coalesce(F.col(c), F.lit(_MISSING)) for c in MARKS])


def _named(df: DataFrame) -> DataFrame:
    """(name, place, component, id): the codes of the distinct series, and those of the distinct marks."""
    rows = explode(df)

    def coded(columns, name):
        codes = F.array(*[F.struct(F.lit(i).alias("place"), F.lit(c).alias("component"), F.col(c).alias("id")) for i, c in enumerate(columns)])
        return rows.select(*columns).distinct().select(name.alias("name"), F.inline(codes))

    return coded(DIMENSIONS, _series_name()).unionByName(coded(MARKS, _mark_name()))


def json_dictionary(df: DataFrame, named: DataFrame | None = None) -> DataFrame:
    """(component, id, position): the codes of each component, numbered from 0 in code order.

    Codes come from distinct series and distinct marks, and the ranking sees distinct codes only, never observations.
    """
    named = _named(df) if named is None else named
    codes = named.select("component", "id").filter(F.col("id").isNotNull())
    codes = codes.filter((F.col("id") != "") | ~F.col("component").isin(*ATTRIBUTES)).distinct()
    rank = F.dense_rank().over(Window.partitionBy("component").orderBy("id")) - 1
    return codes.withColumn("position", rank)


def _encoded(df: DataFrame) -> tuple:
    """The dictionary, and (name, positions) of every distinct series and mark, both stored."""
    named = stage(_named(df), "names")
    dictionary = stage(json_dictionary(df, named), "dictionary")
    found = named.join(dictionary, ["component", "id"], "left").groupBy("name").agg(F.array_sort(F.collect_list(F.struct("place", "position"))).alias("at"))
    return dictionary, stage(found.select("name", F.transform("at", lambda x: x["position"]).alias("at")), "positions")


def json_series(df: DataFrame, positions: DataFrame | None = None, by: tuple = ()) -> DataFrame:
    """(series_key, observations): keys and cells by dictionary position, cells as JSON text.

    Of several observations of one series and period (and of one value of `by`, which comes first)
    a current one goes before a closed one, an accepted one before a rejected one, then the
    latest stays. What is then listed per series is at most one cell per period. Codes are looked up once per distinct
    mark and once per series, not once per component.
    """
    positions = _encoded(df)[1] if positions is None else positions
    order = [c for c in ("VALID_FROM", "version_hash") if c in df.columns] or ["OBS_VALUE"]
    ranks = {
        "IS_CURRENT": F.coalesce("IS_CURRENT", F.lit(False)),
        "BATCH_STATUS": F.upper(F.coalesce("BATCH_STATUS", F.lit(""))) == PUBLISHED,
    }
    ranks = {f"_{c}": rank for c, rank in ranks.items() if c in df.columns}
    order = [*ranks, *order]
    rows = explode(df.withColumns(ranks) if ranks else df, (*order, *by))
    rows = rows.withColumnsRenamed({f"+{c}": c for c in by})
    latest = F.max_by(
        F.struct("OBS_VALUE", *ATTRIBUTES), F.struct(*[F.col(f"+{c}") for c in order])
    )
    cells = rows.groupBy(*by, _series_name().alias("series"), "TIME_PERIOD").agg(latest.alias("cell")).select(*by, "series", "TIME_PERIOD", "cell.*")
    cells = cells.withColumn("name", _mark_name()).join(positions, "name")
    null = F.lit("null")
    value = plain_text(F.nanvl("OBS_VALUE", F.lit(None).cast("double")))
    period = F.element_at("at", 1)
    attributes = [F.coalesce(F.element_at("at", i + 2).cast("string"), null) for i in range(len(ATTRIBUTES))]
    cell = F.concat(
        F.lit('"'), period.cast("string"), F.lit('":['),
        F.concat_ws(",", F.coalesce(value, null), *attributes), F.lit("]"),
    )
    listed = F.array_sort(F.collect_list(F.struct(period.alias("at"), cell.alias("text"))))
    series = cells.groupBy(*by, F.col("series").alias("name")).agg(F.concat(
        F.lit("{"), F.array_join(F.transform(listed, lambda c: c["text"]), ","), F.lit("}")
    ).alias("observations"))
    return series.join(positions, "name").select(*by, F.array_join(F.col("at").cast("array<string>"), ":").alias("series_key"), "observations")


def _framework(df: DataFrame) -> tuple:
    return ("IBS_AGG",) if "IBS_AGG" in df.columns else ()


def json_left_out(df: DataFrame) -> int:
    """How many different rows a JSON document cannot show beside another of their series and period."""
    return df.distinct().count() - df.groupBy(KEY, _period(df), *_framework(df)).count().count()


def _period(df: DataFrame) -> str:
    return "TIME_PERIOD" if "TIME_PERIOD" in df.columns else "DATE"


def _json_frame(sender, action, message_id, prepared, frameworks) -> dict:
    """The fixed text by (section, place, part), around the series of each framework (section 1) and each component's codes (2).

    Of several frameworks, each data set names its own by an annotation.
    """
    meta = {
        "schema": JSON_SCHEMA,
        "id": message_id,
        "test": False,
        "prepared": prepared,
        "contentLanguages": ["en"],
        "sender": {"id": sender[0], "name": sender[1]},
    }
    links = [{"urn": URN, "rel": "self"}]
    rows = {
        (0, 0, 0): f'{{"meta":{json.dumps(meta)},"data":{{"dataSets":[',
        (3, 0, 0): "]}}]}}",
    }
    noted = len(frameworks) > 1
    for at in range(len(frameworks)):
        note = f'"annotations":[{at}],' if noted else ""
        rows[1, at, 0] = f'{"," if at else ""}{{"action":{json.dumps(action)},{note}"series":{{'
        rows[1, at, 2] = "}}"
    notes = f'"annotations":{json.dumps([{"type": "IBS_AGG", "title": x} for x in frameworks])},' if noted else ""
    sets = json.dumps(list(range(len(frameworks))))
    rows[1, len(frameworks), 0] = f'],"structures":[{{"dataSets":{sets},{notes}"links":{json.dumps(links)},"dimensions":{{"series":['
    last_dimension, time = len(DIMENSIONS) - 1, len(DIMENSIONS)
    for place, component in enumerate(COMPONENTS):
        fields = {"id": component, "name": "Time period" if place == time else component}
        if place <= last_dimension:
            fields["keyPosition"] = place
        after = ","
        if place == last_dimension:
            after = '],"observation":['
        elif place == time:
            after = ']},"attributes":{"observation":['
        elif place == len(COMPONENTS) - 1:
            after = ""
        rows[2, place, 0] = json.dumps(fields)[:-1] + ',"values":['
        rows[2, place, 2] = "]}" + after
    return rows


def write_sdmx_json(
    df: DataFrame,
    path: str,
    sender=SENDER,
    action: str = "Information",
    message_id: str | None = None,
    prepared: str | None = None,
) -> str:
    """SDMX-JSON 2.0.0 message, one data set per framework. The files, put together in name order, are the document."""
    _check_action(action)
    spark, by = df.sparkSession, _framework(df)
    dictionary, positions = _encoded(df)
    series = stage(json_series(df, positions, by).withColumn("framework", F.col(by[0]) if by else F.lit(None).cast("string")), "series")
    # One row per framework; there are a handful.
    found = series.groupBy("framework").agg(F.min("series_key").alias("first")).orderBy("framework").collect()
    now = f"{datetime.now(timezone.utc):%Y-%m-%dT%H:%M:%SZ}"
    frame = _json_frame(sender, action, message_id or str(uuid.uuid4()), prepared or now, [row["framework"] for row in found])

    def text(*wanted) -> DataFrame:
        """The fixed lines of those (section, place, part), in one partition."""
        return spark.createDataFrame([(frame[w],) for w in wanted], "line string").coalesce(1)

    entry = F.concat(F.lit('"'), F.col("series_key"), F.lit('":{"attributes":[],"observations":'), F.col("observations"), F.lit("}"))
    parts = [text((0, 0, 0))]
    for place, row in enumerate(found):
        own = series.filter(F.col("framework").eqNullSafe(F.lit(row["framework"])))
        first = F.col("series_key") == row["first"]
        # The order of series says nothing, so the body is written as it lies; one series goes first, without a comma.
        body = own.filter(~first).select(F.concat(F.lit(","), entry).alias("line"))
        parts += [text((1, place, 0)), own.filter(first).select(entry.alias("line")).coalesce(1), body, text((1, place, 2))]
    places = F.create_map(*[F.lit(x) for i, c in enumerate(COMPONENTS) for x in (c, i)])
    code = F.to_json(F.struct("id", F.col("id").alias("name")))
    codes = dictionary.select(
        places[F.col("component")].alias("place"),
        F.lit(1).alias("part"),
        "position",
        F.concat(F.when(F.col("position") == 0, "").otherwise(","), code).alias("line"),
    )
    around = spark.createDataFrame([(place, part, 0, line) for (section, place, part), line in frame.items() if section == 2], "place int, part int, position int, line string")
    parts += [text((1, len(found), 0)), codes.unionByName(around).orderBy("place", "part", "position").select("line"), text((3, 0, 0))]
    # The partitions of a union follow one another, and so do its files.
    reduce(DataFrame.union, parts).write.text(path)
    return path


# ---- dispatch ----------------------------------------------------------------------------


@dataclass(frozen=True)
class Export:
    path: str
    media_type: str
    extension: str
    rows: int
    #: Rows of `rows` that the format cannot show beside another of their series and period.
    left_out: int = 0


# Format name, with its writer, media type and file extension.
FORMATS = {
    "sdmx-ml": (write_sdmx_ml, "application/xml", "xml"),
    "sdmx-json": (write_sdmx_json, "application/vnd.sdmx.data+json;version=2.0.0", "json"),
    "sdmx-csv": (write_sdmx_csv, "application/vnd.sdmx.data+csv;version=2.0.0", "csv"),
    "tidy-csv": (write_tidy_csv, "text/csv", "csv"),
}


def export(df: DataFrame, wire_format: str, path: str, **options) -> Export:
    """Write a result in a named format. An empty result is an error, not an empty file."""
    if wire_format not in FORMATS:
        raise ExportError(f"unsupported format {wire_format!r}; expected one of {sorted(FORMATS)}")
    writer, media_type, extension = FORMATS[wire_format]
    result = stage(df, "export")
    rows = result.count()
    if not rows:
        raise NothingToExport("no observation matches")
    writer(result, path, **options)
    return Export(path, media_type, extension, rows, json_left_out(result) if wire_format == "sdmx-json" else 0)
