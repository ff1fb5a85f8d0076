import glob
import json
import math
import os
import xml.etree.ElementTree as ET

import pytest
from pyspark.sql import functions as F

from seriesforge.errors import ExportError, NothingToExport, SubmissionError
from seriesforge.operators import disclosure, keycheck
from seriesforge.plans import intake, testbed
from seriesforge.sources import exports, feeds, submissions
from tests.scenario import FEED_OUTCOME, feed_rows, key

SCHEMA = "TIME_SERIES_CODE string, DATE string, IBS_AGG string, OBS_VALUE double, OBS_STATUS string, OBS_CONF string, BATCH_STATUS string"
K1, K2 = key("CA", "CAD", "D"), key("US", "USD", "F")


@pytest.fixture
def result(spark):
    return spark.createDataFrame([
        (K1, "2026-Q2", "LBSR", 123456789.25, "A", "F", "PUBLISHED"),
        (K1, "2026-Q1", "LBSR", None, "A", "C", "PUBLISHED"),
        (K2, "2026-Q1", "LBSR", -100.0, "B", None, "PUBLISHED"),
    ], SCHEMA)


def text(path):
    return "".join(open(f, encoding="utf-8").read() for f in sorted(glob.glob(f"{path}/part-*")))


def test_xml_is_one_document(result, tmp_path):
    done = exports.export(result, "sdmx-ml", str(tmp_path / "x"), validate=True, sender=("A&B", "A & B"), action="Replace",
                          dataset_id="D", message_id="M", prepared="2026-01-01T00:00:00Z")
    assert (done.rows, done.media_type, done.extension) == (3, "application/xml", "xml")
    root = ET.fromstring(text(done.path))
    dataset = root.find("{%s}DataSet" % exports.NAMESPACES["mes"])
    assert dataset.attrib["action"] == "Replace"
    found = {(s.attrib["L_REP_CTY"], o.attrib["TIME_PERIOD"]): o.attrib for s in dataset.findall("Series") for o in s.findall("Obs")}
    assert len(dataset.findall("Series")) == 2
    assert found["CA", "2026-Q2"]["OBS_VALUE"] == "123456789.25"
    assert "OBS_VALUE" not in found["CA", "2026-Q1"] and found["CA", "2026-Q1"]["OBS_CONF"] == "C"
    assert found["US", "2026-Q1"] == {"TIME_PERIOD": "2026-Q1", "OBS_VALUE": "-100", "OBS_STATUS": "B"}
    again = str(tmp_path / "y")
    exports.write_sdmx_ml(result, again, sender=("A&B", "A & B"), action="Replace", dataset_id="D", message_id="M", prepared="2026-01-01T00:00:00Z")
    assert text(again) == text(done.path)


def test_a_long_series_runs_over_several_files(spark, tmp_path):
    """Three quarters of the rows in one series: its lines spread, and the document stays whole."""
    many = spark.range(40000).select(
        F.when(F.col("id") % 4 < 3, K1).otherwise(F.concat(F.lit(K2[:-2]), F.col("id").cast("string"))).alias("TIME_SERIES_CODE"),
        F.concat(F.lit("2026-Q1"), F.lit("")).alias("DATE"), F.col("id").cast("double").alias("OBS_VALUE"))
    # As with data that is too large to be merged into one task.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        path = exports.write_sdmx_ml(many, str(tmp_path / "x"))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    dataset = ET.fromstring(text(path)).find("{%s}DataSet" % exports.NAMESPACES["mes"])
    sizes = sorted(len(s) for s in dataset)
    assert (len(sizes), sizes[-1], sum(sizes)) == (10001, 30000, 40000)
    holding = [f for f in glob.glob(f"{path}/part-*") if open(f).read().count("<Obs") > 100]
    assert len(holding) > 3


def test_a_damaged_message_is_noticed(spark, result, tmp_path):
    path = exports.write_sdmx_ml(result, str(tmp_path / "x"))
    exports.check_sdmx_ml(result, path)
    with pytest.raises(ExportError, match="does not read back"):
        exports.check_sdmx_ml(result.filter("OBS_VALUE > 0"), path)


def test_json_is_one_document(spark, result, tmp_path):
    doubled = result.unionByName(spark.createDataFrame([(K2, "2026-Q1", "LBSR", -200.0, "A", "F", "PUBLISHED")], SCHEMA))
    done = exports.export(doubled, "sdmx-json", str(tmp_path / "j"))
    message = json.loads(text(done.path))
    structure = message["data"]["structures"][0]
    codes = {d["id"]: [v["id"] for v in d["values"]] for d in structure["dimensions"]["series"] + structure["dimensions"]["observation"]}
    codes.update({a["id"]: [v["id"] for v in a["values"]] for a in structure["attributes"]["observation"]})
    assert [d["keyPosition"] for d in structure["dimensions"]["series"]] == list(range(11))
    cells = {}
    for series, body in message["data"]["dataSets"][0]["series"].items():
        names = ".".join(v[int(i)] for i, v in zip(series.split(":"), codes.values()))
        for period, cell in body["observations"].items():
            attributes = [None if i is None else codes[a][i] for a, i in zip(keycheck.ATTRIBUTES, cell[1:])]
            cells[names, codes["TIME_PERIOD"][int(period)]] = [cell[0], *attributes]
    assert cells == {(K1, "2026-Q2"): [123456789.25, "A", "F"], (K1, "2026-Q1"): [None, "A", "C"], (K2, "2026-Q1"): [-100.0, "B", None]}


def test_csv(result, tmp_path):
    exports.export(result, "sdmx-csv", str(tmp_path / "c"), action="Append")
    lines = sorted(set(text(tmp_path / "c").splitlines()))
    head = f"dataflow,BIS:WS_LBS_D_PUB(1.0),A,{K1.replace('.', ',')}"
    assert f"{head},2026-Q1,,A,C" in lines and f"{head},2026-Q2,123456789.25,A,F" in lines
    assert any(x.endswith("2026-Q1,-100,B,") for x in lines)
    with pytest.raises(ExportError):
        exports.csv_rows(result, "Merge")


def test_tidy_csv(result, tmp_path):
    assert exports.tidy_rows(result).columns[-2:] == ["IBS_AGG", "BATCH_STATUS"]
    exports.export(result, "tidy-csv", str(tmp_path / "t"), columns=["TIME_SERIES_CODE", "OBS_VALUE"])
    assert f"{K2},-100" in text(tmp_path / "t") and f'{K1},\n' in text(tmp_path / "t")
    with pytest.raises(ExportError, match="COLOUR"):
        exports.tidy_rows(result, ["COLOUR"])


def test_refusals(result, tmp_path):
    with pytest.raises(ExportError):
        exports.export(result, "pdf", str(tmp_path / "a"))
    with pytest.raises(NothingToExport):
        exports.export(result.limit(0), "sdmx-csv", str(tmp_path / "b"))
    with pytest.raises(ExportError):
        exports.write_sdmx_ml(result, str(tmp_path / "c"), output_type="GenericData")
    with pytest.raises(ExportError):
        keycheck.explode(result.drop("DATE"))
    with pytest.raises(Exception, match="malformed series key"):
        keycheck.explode(result.withColumn("TIME_SERIES_CODE", F.lit("a.b"))).collect()


def test_plain_numbers(spark):
    values = [100.0, 0.5, -1250000.0, 1e20, 0.0000001, 123456789.125]
    df = spark.createDataFrame([(v,) for v in values], "OBS_VALUE double")
    from seriesforge.functions.values import plain_text
    texts = [r[0] for r in df.select(plain_text(F.col("OBS_VALUE"))).collect()]
    assert texts[:3] == ["100", "0.5", "-1250000"] and all(math.isclose(float(t), v) for t, v in zip(texts, values))


def test_submissions_read_back(spark, result, tmp_path):
    path = submissions.write_submissions(result.filter("OBS_CONF IS NOT NULL"), str(tmp_path), {"CA": "Break in Series"})
    back = submissions.read_submissions(spark, f"{path}/messages").collect()
    assert sorted((r["SUBMITTED_BY"], r["TIME_SERIES_CODE"], r["DATE"], str(r["OBS_VALUE"]), r["OBS_STATUS"]) for r in back) == [
        ("ca", K1, "2026-Q1", "None", "B"), ("ca", K1, "2026-Q2", "123456789.25", "B")]
    with pytest.raises(SubmissionError):
        submissions.lifecycle(result, {"CA": "Draft"})


def test_submissions_of_others(spark, tmp_path):
    """A file with namespaces and observations inside series."""
    dims = " ".join(f'{d}="{v}"' for d, v in zip(exports.DIMENSIONS, K2.split(".")))
    body = f'<m:S xmlns:m="urn:x"><m:DataSet><Series {dims}><Obs TIME_PERIOD="2026-Q1" OBS_VALUE="1.5"/><Obs TIME_PERIOD="2026-Q2"/></Series></m:DataSet></m:S>'
    (tmp_path / "US_submission_2026_Q1.xml").write_text(body)
    back = submissions.read_submissions(spark, f"{tmp_path}/*_submission_*.xml")
    assert sorted((r["SUBMITTED_BY"], r["TIME_SERIES_CODE"], r["DATE"], str(r["OBS_VALUE"])) for r in back.collect()) == [
        ("us", K2, "2026-Q1", "1.5"), ("us", K2, "2026-Q2", "None")]
    (tmp_path / "CA_submission_2026_Q1.xml").write_text("<m:S xmlns:m='urn:x'/>")
    with pytest.raises(SubmissionError):
        submissions.assert_not_empty(submissions.read_submissions(spark, f"{tmp_path}/CA_submission_*.xml"))


def test_files_to_verdict(spark, tmp_path):
    """The feed's countries as messages, one of them in the nested shape: decided as the feed itself is."""
    feed = spark.createDataFrame(feed_rows(), "TIME_SERIES_CODE string, BANK_CODE string, DATE string, IBS_AGG string, OBS_VALUE double")
    batch = disclosure.rollup(feed)
    messages = submissions.write_submissions(batch.filter("TIME_SERIES_CODE not like '%.NZ.%'"), str(tmp_path / "s"), {"PT": "Break in Series"}) + "/messages"
    series = "".join(
        "<Series " + " ".join(f'{d}="{v}"' for d, v in zip(exports.DIMENSIONS, r["TIME_SERIES_CODE"].split("."))) + f'><Obs TIME_PERIOD="{r["DATE"]}" OBS_VALUE="{r["OBS_VALUE"]}"/></Series>'
        for r in batch.filter("TIME_SERIES_CODE like '%.NZ.%'").collect()
    )
    os.makedirs(f"{messages}/SUBMISSION=nz_submission_2026_Q1")
    with open(f"{messages}/SUBMISSION=nz_submission_2026_Q1/m.xml", "w") as file:
        file.write(f"<m:S xmlns:m='urn:x'><m:DataSet>{series}</m:DataSet></m:S>")
    found = intake.judge(spark, messages, testbed.rulebook(spark))
    decided = {r["SUBMITTING_COUNTRY"]: (r["row_count"], r["BATCH_STATUS"], r["FAILED_RULE_ID"]) for r in found.decisions.collect()}
    assert decided == {c: (n, "QUARANTINE" if checks else "PUBLISHED", checks) for c, (n, _, checks) in FEED_OUTCOME.items()}
    assert {r["OBS_STATUS"] for r in found.rows.filter("SUBMITTING_COUNTRY = 'NZ'").collect()} == {"A"}
    assert {r["OBS_STATUS"] for r in found.rows.filter("SUBMITTING_COUNTRY = 'PT'").collect()} == {"B"}
    os.makedirs(tmp_path / "none")
    (tmp_path / "none" / "xx_submission_2026_Q1.xml").write_text("<m:S xmlns:m='urn:x'/>")
    with pytest.raises(SubmissionError):
        intake.judge(spark, f"{tmp_path}/none", testbed.rulebook(spark))


def test_feed_and_rulebook_files(spark, tmp_path):
    feed = spark.createDataFrame(feed_rows(), "TIME_SERIES_CODE string, BANK_CODE string, DATE string, IBS_AGG string, OBS_VALUE double")
    back = feeds.read_feed(spark, feeds.write_feed(feed, str(tmp_path / "f")))
    assert sorted(map(str, back.collect())) == sorted(map(str, feed.collect()))
    (tmp_path / "rules.csv").write_text('Check No,Dimensions1\nR1,"5\nand 6"\n')
    assert feeds.read_rulebook(spark, str(tmp_path / "rules.csv")).first()["Dimensions1"] == "5\nand 6"


def test_json_shows_every_framework_and_prefers_accepted_rows(spark, tmp_path):
    """A rejected later row does not replace the accepted one; rows not shown are counted."""
    rows = spark.createDataFrame([
        (K1, "2026-Q1", "LBSN", 1.0, "A", "F", "PUBLISHED", "2026-01-01"),
        (K1, "2026-Q1", "LBSR", 2.0, "A", "F", "PUBLISHED", "2026-01-01"),
        (K1, "2026-Q1", "LBSR", 3.0, "A", "F", "REJECTED", "2026-02-01"),
        (K2, "2026-Q1", "LBSR", 4.0, "A", "F", "PUBLISHED", "2026-01-01"),
    ], SCHEMA + ", VALID_FROM string")
    done = exports.export(rows, "sdmx-json", str(tmp_path / "k"))
    assert (done.rows, done.left_out) == (4, 1)
    data = json.loads(text(done.path))["data"]
    structure = data["structures"][0]
    assert structure["dataSets"] == [0, 1]
    shown = {}
    for dataset in data["dataSets"]:
        name = structure["annotations"][dataset["annotations"][0]]["title"]
        shown[name] = sorted(c[0] for s in dataset["series"].values() for c in s["observations"].values())
    assert shown == {"LBSN": [1.0], "LBSR": [2.0, 4.0]}
