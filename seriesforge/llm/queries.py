"""The registered queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

import os
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesforge.llm import archives, bpe, idfiles, lexical, lm, mining, near, packing, pii, quality, repack, url_lists, vectors
from seriesforge.llm.text import table
from seriesforge.sources import staging


def ship(spark: SparkSession) -> SparkSession:
    """Let Python workers find this package when the driver got it from a folder of its own.

    Arrow batches get fewer rows than Spark's 10,000: pairs of shingle sets or long texts fill a worker's memory.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, (root, known)))
    return spark


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode every text, decode the ids, and return digests of both."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    encoded = bpe.encode(docs, path).select("doc_id", "ids")
    return bpe.digests(bpe.decode(encoded, path)).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op2_cross_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target: documents labelled as good and not toxic. Background: all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    good = table(spark, sf_dir, "labels").where("quality = 1 and toxic = 0").select("doc_id").distinct()
    good = staging.stage(good.withColumn("good", F.lit(True)), "good-ids")
    if good.count() <= near.BROADCAST_IDS:  # numbers only; sent out, no text is shuffled
        good = F.broadcast(good)
    return lm.score(lm.train(docs.join(good, "doc_id", "left"), F.col("good")))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as ARC volumes, converted to WARC archives, which are then read back."""
    fetched = F.lit(1704067200) + F.pmod(F.coalesce(F.col("page_id"), F.lit(0)), F.lit(31536000))
    volumes = archives.arc_volumes(table(spark, sf_dir, "pages"), "page_id", "url", "html", fetched)
    folder = staging.fresh_path(spark, "warc")
    archives.write_warc(archives.mark_revisits(archives.convert(volumes)), folder)
    found = archives.read_warc(spark, folder).where(F.col("type") != "warcinfo")
    return found.select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), F.col("refers_to_key").alias("refers_to"))


def op4_near_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.join(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("tid")


def op5_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captures at times their ids give, against entries drawn from the hosts of the table."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    captures = pages.withColumn("fetched", F.timestamp_seconds(F.lit(1704067200) + F.pmod(F.col("page_id") * 7919, F.lit(31622400))))
    shown = [F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) for c in ("fetched", "valid_from")]
    return url_lists.judge(captures, url_lists.drawn_entries(pages)).select("page_id", "host", shown[0], "blocked", "list", "key", shown[1])


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate spans are stored without their texts; training and the decision read them there."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = staging.stage(pii.candidates(docs).drop("text"), "pii-candidates")
    return pii.digests(pii.decide(found, pii.train(found)))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = quality.measure(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return measured.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return vectors.nearest(rows, rows.where("vec_id % 20 = 0"), 20)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return idfiles.write_and_read(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every 100th vector, against all; every seventh row has a wrong label on purpose."""
    vector = mining.whole(F.col("embedding"), 256)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", label.alias("label"), vector.alias("vector"))
    return mining.mine(rows, F.col("id") % 100 == 0)


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 10)


def op13_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repack.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


QUERIES = (op1_byte_bpe, op2_cross_entropy, op3_warc, op4_near_join, op5_url_lists, op6_personal_data, op7_quality_rules, op8_neighbours, op9_packing, op10_token_files, op11_hard_negatives, op12_ranked_search, op13_best_fit)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def shipped(query):
        return lambda spark, sf_dir: query(ship(spark), sf_dir)

    return {query.__name__: shipped(query) for query in QUERIES}


#: Twenty bits of a hexadecimal digest are four base32 digits.
OP3_SQL = """
WITH payloads AS (
  SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS hex, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS last_id FROM pages
)
SELECT page_id, strlen(payload)::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(0, 40, 5), lambda k: array_to_string(list_transform([15, 10, 5, 0],
    lambda b: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(hex, (k + 1)::INT, 5))::BIGINT >> b) & 31)::INT + 1, 1)), '')), '') AS payload_digest,
  CASE WHEN page_id = last_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> last_id THEN last_id END AS refers_to
FROM payloads
"""


OP5_SQL = r"""
WITH caps AS (
  SELECT page_id, make_timestamp((1704067200 + page_id * 7919 % 31622400) * 1000000) AS fetched,
    nullif(lower(regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:@\[\]]+)', 1), '\.+$', '')), '') AS host
  FROM pages
), tails AS (
  SELECT host, unnest(CASE WHEN regexp_matches(host, '^(?:\[.*\]|[0-9]+(?:\.[0-9]+){3})$') THEN [host] ELSE
    list_transform(range(1, greatest(len(parts) - 1, 1) + 1), lambda i: array_to_string(parts[i:], '.')) END) AS key
  FROM (SELECT DISTINCT host, string_split(host, '.') AS parts FROM caps WHERE host IS NOT NULL)
), drawn AS (
  SELECT key, ('0x' || d[1:1])::INT AS place, [('0x' || d[2:3])::INT % 200, ('0x' || d[4:5])::INT % 60, ('0x' || d[6:7])::INT % 60] AS n
  FROM (SELECT DISTINCT key, md5(key) AS d FROM tails)
), entries AS (
  SELECT key, CASE WHEN place < 2 THEN 'allow' WHEN place < 6 THEN 'phishing' ELSE 'adult' END AS list,
    unnest([{'action': 'add', 'days': n[1]}, {'action': 'remove', 'days': n[1] + 1 + n[2]}, {'action': 'add', 'days': n[1] + 80 + n[3]}]) AS e
  FROM drawn WHERE place < 9
), dated AS (
  SELECT key, list, action, valid_from, lead(valid_from) OVER (PARTITION BY list, key ORDER BY valid_from) AS valid_to
  FROM (SELECT key, list, max(e.action) AS action, TIMESTAMP '2024-01-01' + to_days(e.days) AS valid_from FROM entries GROUP BY key, list, e.days)
), decided AS (
  SELECT host, fetched, list, key, valid_from
  FROM (SELECT DISTINCT host, fetched FROM caps) JOIN tails USING (host) JOIN dated USING (key)
  WHERE action = 'add' AND valid_from <= fetched AND (valid_to IS NULL OR fetched < valid_to)
  QUALIFY row_number() OVER (PARTITION BY host, fetched ORDER BY length(key) DESC, list = 'allow' DESC, list DESC, key DESC, valid_from DESC) = 1
)
SELECT page_id, host, strftime(fetched, '%Y-%m-%d %H:%M:%S') AS fetched, coalesce(list <> 'allow', false) AS blocked, list, key, strftime(valid_from, '%Y-%m-%d %H:%M:%S') AS valid_from
FROM caps LEFT JOIN decided USING (host, fetched)
"""

OP11_SQL = """
WITH usable AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM usable a JOIN usable b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, (row_number() OVER w)::INT AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id)
WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)
QUALIFY rank <= 10
"""

OP12_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS terms
  FROM documents WHERE text IS NOT NULL
), items AS (
  SELECT row_number() OVER () AS i, item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS terms
  FROM benchmark WHERE text IS NOT NULL
), asked AS (SELECT i, item_id, term, count(*) AS repeats FROM (SELECT i, item_id, unnest(terms) AS term FROM items) GROUP BY ALL),
totals AS (SELECT count(*) AS n, sum(len(terms))::BIGINT AS l FROM docs WHERE len(terms) > 0),
postings AS (
  SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, len(terms)::BIGINT AS n, unnest(terms) AS term FROM docs)
  WHERE term IN (SELECT term FROM asked) GROUP BY ALL
), weights AS (SELECT term, floor(1000 * ln((2 * totals.n + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM postings, totals GROUP BY term, totals.n),
scores AS (
  SELECT i, item_id, r, doc_id, sum(repeats * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * postings.n * totals.n) // totals.l))))::BIGINT AS score
  FROM asked JOIN postings USING (term) JOIN weights USING (term), totals GROUP BY i, item_id, r, doc_id
)
SELECT item_id, (row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS FIRST))::INT AS rank, doc_id, score FROM scores WHERE score > 0 QUALIFY rank <= 10
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_warc": OP3_SQL, "op5_url_lists": OP5_SQL, "op11_hard_negatives": OP11_SQL, "op12_ranked_search": OP12_SQL}
