"""Legacy ARC volumes to WARC 1.1 archives, and back to records.

An ARC volume begins with a version block whose second line names the version; the version fixes the
fields of every header line after it (five in version 1, ten in version 2). The last field is the
declared length of the content that follows. `parse_arc` reads lines and lengths, `convert` synthesises
what WARC wants besides: a record identifier (a name-based UUID of volume, place and URL, so a task that
runs again gives the same one), an ISO timestamp, the record type and SHA-1 digests in base32.

`mark_revisits` turns all but one record of equal payloads into revisits. `write_warc` writes records
with Spark's text writer: a record is a line, and the two line breaks WARC wants after every record are
the line separator. Files are gzip-compressed. `read_warc` inflates and parses them piece by piece.

Null payloads count as empty. A null key is kept as no key. Of equal payloads the record with the largest
key stays a response (no key counts as less than any; equal keys go by record identifier). Repeated rows
become one record each. A content shorter than declared is marked as truncated; a header line that does
not fit its version is an error. Further columns of the input are ignored. An empty table gives no files.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesforge.llm import text as tx
from seriesforge.sources import staging

#: The header fields of both versions.
ARC_FIELDS = {
    b"1": ("url", "ip", "date", "mime", "length"),
    b"2": ("url", "ip", "date", "mime", "status", "checksum", "location", "offset", "filename", "length"),
}
KEY_FIELD = "X-Record-Key"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


# ---- ARC ---------------------------------------------------------------------------------------


def _unspaced(url: str) -> bytes:
    return re.sub(rb"[\x00-\x20\x7f]", lambda m: b"%%%02X" % m[0][0], url.encode()) or b"urn:none"


def arc_volume(name: str, version: bytes, rows: Iterator[tuple[int | None, str | None, int, bytes]]) -> bytes:
    """An ARC volume of (key, URL, fetch time in seconds, payload) rows, each a successful HTTP answer."""
    fields = {b"1": b"URL IP-address Archive-date Content-type Archive-length", b"2": b"URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"}[version]
    about = version + b" 0 seriesforge\n" + fields + b"\n"
    own = name.encode()
    more = b" 200 - - 0 " + own if version == b"2" else b""
    parts = [b"filedesc://" + own + b" 0.0.0.0 19960101000000 text/plain" + more + b" %d\n" % len(about) + about]
    size = len(parts[0])
    for key, url, fetched, payload in rows:
        date = datetime.fromtimestamp(fetched, timezone.utc).strftime("%Y%m%d%H%M%S").encode()
        head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n" % len(payload)
        if key is not None:
            head += f"{KEY_FIELD}: {key}\r\n".encode()
        content = head + b"\r\n" + payload
        more = b" 200 - - %d " % (size + 1) + own if version == b"2" else b""
        parts.append(b"\n" + _unspaced(url or "") + b" 0.0.0.0 " + date + b" text/html" + more + b" %d\n" % len(content) + content)
        size += len(parts[-1])
    return b"".join(parts) + b"\n"


def parse_arc(volume: bytes) -> Iterator[dict]:
    """Header fields, `place` and `content` of every record; the version block comes first."""
    place, fields = 0, None
    while place < len(volume):
        if volume[place] == 0x0A:  # the break before a header line
            place += 1
            continue
        line_end = volume.find(b"\n", place)
        line = volume[place:line_end] if line_end >= 0 else volume[place:]
        if fields is None:
            length = int(line.rsplit(b" ", 1)[1])
            version = volume[line_end + 1 : line_end + 1 + length].split(b" ", 1)[0]
            if version not in ARC_FIELDS:
                raise ValueError(f"unknown ARC version {version!r}")
            fields = ARC_FIELDS[version]
        values = line.rsplit(b" ", len(fields) - 1)
        if len(values) != len(fields) or not values[-1].isdigit():
            raise ValueError(f"no ARC header line at {place}: {line[:200]!r}")
        record = dict(zip(fields, values))
        begin, length = line_end + 1, int(record["length"])
        record |= {"place": place, "content": volume[begin : begin + length], "declared": length}
        yield record
        place = begin + length


def arc_volumes(pages: DataFrame, key: str, url: str, payload: str, fetched: Column) -> DataFrame:
    """The rows of `pages` as ARC volumes of a few MB, versions 1 and 2 in turn."""
    rows = pages.select(F.col(key).cast("long").alias("key"), F.col(url).cast("string").alias("url"), fetched.cast("long").alias("fetched"), F.coalesce(F.col(payload), F.lit("")).alias("payload"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for count, block in enumerate(tx.blocks(batches, "payload")):
            keys, urls, times, payloads = (column.to_pylist() for column in block.columns)
            name = f"part-{part:05d}-{count:05d}.arc"
            content = arc_volume(name, b"12"[count % 2 : count % 2 + 1], zip(keys, urls, (t or 0 for t in times), (p.encode() for p in payloads)))
            yield pa.RecordBatch.from_pylist([{"name": name, "content": content}])

    return rows.mapInArrow(run, "name string, content binary")


RECORDS = "record_id string, type string, url string, date string, ip string, mime string, key long, head binary, payload binary, payload_bytes long, payload_digest string, block_digest string, truncated boolean"
_ARROW = pa.schema([("record_id", pa.string()), ("type", pa.string()), ("url", pa.string()), ("date", pa.string()), ("ip", pa.string()), ("mime", pa.string()), ("key", pa.int64()), ("head", pa.binary()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("block_digest", pa.string()), ("truncated", pa.bool_())])


def _split_http(content: bytes) -> tuple[bytes, bytes]:
    """HTTP head with its empty line, and payload."""
    cut = content.find(b"\r\n\r\n")
    return (content[: cut + 4], content[cut + 4 :]) if content.startswith(b"HTTP/") and cut >= 0 else (b"", content)


def _key(head: bytes) -> int | None:
    found = re.search(rb"\r\n" + KEY_FIELD.encode() + rb": (-?\d+)\r\n", head)
    return int(found[1]) if found else None


def to_warc(name: str, record: dict) -> dict:
    """One parsed ARC record as the fields of a WARC record."""
    url, content = record["url"].decode("utf-8", "replace"), record["content"]
    head, payload = _split_http(content)
    date = datetime.strptime(record["date"].decode()[:14].ljust(14, "0"), "%Y%m%d%H%M%S")
    kind = "warcinfo" if url.startswith("filedesc://") else "response" if head else "resource"
    return {
        "record_id": f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{name} {record["place"]} {url}')}",
        "type": kind,
        "url": url,
        "date": date.strftime("%Y-%m-%dT%H:%M:%SZ"),
        "ip": record["ip"].decode(),
        "mime": "application/http; msgtype=response" if head else record["mime"].decode(),
        "key": _key(head),
        "head": head,
        "payload": payload,
        "payload_bytes": len(payload),
        "payload_digest": base32_sha1(payload),
        "block_digest": base32_sha1(content),
        "truncated": len(content) < record["declared"],
    }


def convert(volumes: DataFrame) -> DataFrame:
    """WARC records of ARC volumes (columns `name`, `content`)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                name, volume = batch.column("name")[i].as_py(), batch.column("content")[i].as_py()
                rows, size = [], 0
                for record in parse_arc(volume):
                    rows.append(to_warc(name, record))
                    size += len(record["content"])
                    if size > tx.BLOCK_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, _ARROW)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, _ARROW)

    return volumes.select("name", "content").mapInArrow(run, RECORDS)


# ---- WARC --------------------------------------------------------------------------------------


def mark_revisits(records: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Of responses with equal payloads of at least `least_bytes`, the largest key stays; the others revisit it.

    The digest table is written first: its size is then known, and a digest that many records share is
    split by Spark when the join has to shuffle.
    """
    eligible = (F.col("type") == "response") & (F.col("payload_bytes") >= least_bytes)
    target = F.max(F.struct("key", "record_id", "url", "date")).alias("target")
    targets = staging.stage(records.where(eligible).groupBy("payload_digest").agg(target).withColumnRenamed("payload_digest", "_digest"), "warc-targets")
    joined = records.join(targets, eligible & (F.col("payload_digest") == F.col("_digest")), "left").drop("_digest")
    again = F.col("target").isNotNull() & (F.col("target.record_id") != F.col("record_id"))
    return joined.withColumn("target", F.when(again, F.col("target"))).withColumn("type", F.when(again, "revisit").otherwise(F.col("type")))


def _lines() -> Column:
    """Header lines and block of a record, as one string."""
    def line(name: str, value: Column) -> Column:  # null when the value is null, which concat_ws leaves out
        return F.concat(F.lit(f"{name}: "), value)

    revisit = F.col("type") == "revisit"
    block = F.when(revisit, F.col("head").cast("string")).otherwise(F.concat(F.col("head").cast("string"), F.col("payload").cast("string")))
    size = F.octet_length("head") + F.when(revisit, 0).otherwise(F.octet_length("payload"))
    lines = [
        F.lit("WARC/1.1"),
        line("WARC-Type", F.col("type")),
        line("WARC-Record-ID", F.concat(F.lit("<"), F.col("record_id"), F.lit(">"))),
        line("WARC-Date", F.col("date")),
        line("WARC-Target-URI", F.when(F.col("type") != "warcinfo", F.col("url"))),
        line("WARC-Filename", F.when(F.col("type") == "warcinfo", F.col("url"))),
        line("WARC-IP-Address", F.when(F.col("type") != "warcinfo", F.col("ip"))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        line("WARC-Block-Digest", F.when(~revisit, F.concat(F.lit("sha1:"), F.col("block_digest")))),
        line("WARC-Truncated", F.when(F.col("truncated"), "length")),
        line("WARC-Profile", F.when(revisit, "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        line("WARC-Refers-To", F.concat(F.lit("<"), F.col("target.record_id"), F.lit(">"))),
        line("WARC-Refers-To-Target-URI", F.col("target.url")),
        line("WARC-Refers-To-Date", F.col("target.date")),
        line("X-Refers-To-Key", F.col("target.key").cast("string")),
        line("Content-Type", F.col("mime")),
        line("Content-Length", size.cast("string")),
    ]
    return F.concat(F.concat_ws("\r\n", *lines), F.lit("\r\n\r\n"), block)


def write_warc(records: DataFrame, folder: str, records_per_file: int = 20_000) -> None:
    writer = records.select(_lines().alias("value")).write
    writer.options(lineSep="\r\n\r\n", compression="gzip", maxRecordsPerFile=records_per_file).text(folder)


def inflate(data: bytes, step: int = 1 << 20) -> Iterator[bytes]:
    """The content of a gzip file of one or more members, in pieces."""
    view, tool = memoryview(data), zlib.decompressobj(31)
    for begin in range(0, len(view), step):
        piece = view[begin : begin + step]
        while piece:
            yield tool.decompress(piece)
            piece = tool.unused_data
            if tool.eof:
                tool = zlib.decompressobj(31)


def parse_warc(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (names in lower case) and block of each record, holding one record at a time."""
    held = bytearray()

    def need(size: int) -> bool:
        while len(held) < size:
            piece = next(pieces, None)
            if piece is None:
                return False
            held.extend(piece)
        return True

    while need(4):
        cut, looked = held.find(b"\r\n\r\n"), 0
        while cut < 0:
            looked = max(0, len(held) - 3)
            if not need(len(held) + 1):
                raise ValueError("a WARC header without end")
            cut = held.find(b"\r\n\r\n", looked)
        version, *lines = held[:cut].decode("utf-8", "replace").split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"no WARC record: {version[:100]}")
        fields = {name.lower(): value for name, value in (line.split(": ", 1) for line in lines)}
        end = cut + 4 + int(fields["content-length"])
        if not need(end + 4):
            raise ValueError("a WARC record shorter than declared")
        yield fields, bytes(held[cut + 4 : end])
        del held[: end + 4]


READ = "record_id string, type string, url string, date string, key long, payload_bytes long, payload_digest string, refers_to_id string, refers_to_key long"
_READ_ARROW = pa.schema([("record_id", pa.string()), ("type", pa.string()), ("url", pa.string()), ("date", pa.string()), ("key", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to_id", pa.string()), ("refers_to_key", pa.int64())])


def _described(fields: dict[str, str], block: bytes) -> dict:
    head, payload = _split_http(block)
    digest = fields["warc-payload-digest"].removeprefix("sha1:")
    if fields["warc-type"] == "revisit":
        size = int(re.search(rb"\r\nContent-Length: (\d+)\r\n", head)[1])
    else:
        size, found = len(payload), base32_sha1(payload)
        if found != digest:
            raise ValueError(f"{fields['warc-record-id']}: payload digest {found}, not {digest}")
    refers, key = fields.get("warc-refers-to"), fields.get("x-refers-to-key")
    return {
        "record_id": fields["warc-record-id"].strip("<>"), "type": fields["warc-type"], "url": fields.get("warc-target-uri"), "date": fields["warc-date"],
        "key": _key(head), "payload_bytes": size, "payload_digest": digest, "refers_to_id": refers and refers.strip("<>"), "refers_to_key": None if key is None else int(key),
    }


def read_warc(spark: SparkSession, folder: str) -> DataFrame:
    """One row per record of all archives below `folder`; payload digests are verified."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows = []
                for fields, block in parse_warc(inflate(content.as_py())):
                    rows.append(_described(fields, block))
                    if len(rows) == 5000:
                        yield pa.RecordBatch.from_pylist(rows, _READ_ARROW)
                        rows = []
                yield pa.RecordBatch.from_pylist(rows, _READ_ARROW)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(folder)
    return files.select("content").mapInArrow(run, READ)
