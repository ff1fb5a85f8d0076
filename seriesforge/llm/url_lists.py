"""Dated URL lists joined to captures as of their fetch time, with DataFrame expressions only.

A list is a table of dated entries (list, key, action, at): `add` or `remove` a host or domain. Entries
become validity intervals: an addition holds from its date until the next entry for the same list and key.
A capture is judged against all domains its host belongs to, by intervals that hold when it was fetched.
The most specific key decides; on one key `allow` goes before other lists, then the list's name decides.

Captures are reduced to distinct (host, time) first. Both sides of the interval join are written tables, so
Spark knows their sizes and splits a host that many captures share. Of entries with equal list, key and time
a removal wins. Entries without list, key or time are void; captures without host or time are not blocked.
Repeated rows keep their number. Other columns of captures are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seriesforge.sources import staging

#: Scheme, user information, host (an IPv6 address stands in brackets), rest.
_HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:@\[\]]+)"
_ADDRESS = r"^(?:\[.*\]|[0-9]+(?:\.[0-9]+){3})$"


def normal(name: Column) -> Column:
    """A host, or the key of a list, in lower case and without a final dot; null when nothing is left."""
    found = F.lower(F.regexp_replace(F.trim(name), r"\.+$", ""))
    return F.when(found != "", found)


def host(url: Column) -> Column:
    """Host of an absolute URL in normal form, an IPv6 address with its brackets; null when there is none."""
    return normal(F.regexp_extract(url, _HOST, 1))


def domains(name: Column) -> Column:
    """A host and all domains above it that have a dot. An IP address is in no domain but itself."""
    parts = F.split(name, r"\.")
    tails = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    return F.when(name.rlike(_ADDRESS), F.array(name)).when(name.isNotNull(), tails)


def intervals(entries: DataFrame) -> DataFrame:
    """(list, key, valid_from, valid_to): when each addition holds; an open end is null."""
    sound = entries.select("list", normal(F.col("key")).alias("key"), "action", "at").where("list is not null and key is not null and at is not null")
    one = sound.groupBy("list", "key", "at").agg(F.max("action").alias("action"))  # 'remove' > 'add'
    following = F.lead("at").over(Window.partitionBy("list", "key").orderBy("at"))
    dated = one.withColumn("valid_to", following)
    return dated.where("action = 'add'").select("list", "key", F.col("at").alias("valid_from"), "valid_to")


def judge(captures: DataFrame, entries: DataFrame, url: str = "url", fetched: str = "fetched") -> DataFrame:
    """`captures` with host, blocked, list, key and valid_from of the entry that decided (null: none)."""
    added = ["host", "blocked", "list", "key", "valid_from"]
    # The columns of the captures get names of ours, so that none can clash; those named like an added one give way to it.
    own = [f"_own_{i}" for i in range(len(captures.columns))]
    kept = [(o, c) for o, c in zip(own, captures.columns) if c not in added]
    at = own[captures.columns.index(fetched)]
    named = captures.toDF(*own).withColumn("host", host(F.col(own[captures.columns.index(url)])))
    asked = named.select("host", F.col(at).alias("_at")).where("host is not null and _at is not null").distinct()
    keyed = staging.stage(asked.withColumn("key", F.explode(domains(F.col("host")))), "captures")
    held = staging.stage(intervals(entries), "intervals")
    met = keyed.join(held, "key").where((F.col("valid_from") <= F.col("_at")) & (F.col("valid_to").isNull() | (F.col("_at") < F.col("valid_to"))))
    decisive = F.max(F.struct(F.length("key").alias("size"), (F.col("list") == "allow").alias("allow"), "list", "key", "valid_from")).alias("entry")
    decided = staging.stage(met.groupBy("host", "_at").agg(decisive), "decisions").withColumnRenamed("host", "_host")
    joined = named.join(decided, (named["host"] == decided["_host"]) & (named[at] == decided["_at"]), "left")
    blocked = F.coalesce(F.col("entry.list") != "allow", F.lit(False)).alias("blocked")
    decision = ["host", blocked, F.col("entry.list").alias("list"), F.col("entry.key").alias("key"), F.col("entry.valid_from").alias("valid_from")]
    return joined.select(*[F.col(o).alias(c) for o, c in kept], *decision)


def drawn_entries(captures: DataFrame, url: str = "url") -> DataFrame:
    """Entries drawn from the hosts of a capture table: a digest of each domain says when it is listed, and where."""
    keys = captures.select(F.explode(domains(host(F.col(url)))).alias("key")).distinct()
    digest = keys.withColumn("d", F.md5("key"))

    def number(first: int, size: int) -> Column:
        return F.conv(F.substring("d", first, size), 16, 10).cast("int")

    lists = F.when(number(1, 1) < 2, "allow").when(number(1, 1) < 6, "phishing").when(number(1, 1) < 9, "adult")
    base = F.unix_timestamp(F.lit("2024-01-01 00:00:00").cast("timestamp"))

    def event(action: str, days: Column) -> Column:
        return F.struct(F.lit(action).alias("action"), F.timestamp_seconds(base + days * 86400).alias("at"))

    begin = number(2, 2) % 200
    events = F.array(event("add", begin), event("remove", begin + 1 + number(4, 2) % 60), event("add", begin + 80 + number(6, 2) % 60))
    return digest.withColumn("list", lists).where("list is not null").select("list", "key", F.explode(events).alias("e")).select("list", "key", "e.action", "e.at")
