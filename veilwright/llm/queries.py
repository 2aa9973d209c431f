"""The registered queries of the training-data operators and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilwright.llm.bpe import round_trip
from veilwright.llm.common import documents
from veilwright.llm.exact_dedup import exact_dedup
from veilwright.llm.media import text_media
from veilwright.llm.packing import pack
from veilwright.llm.pii import find_personal_data
from veilwright.llm.quality import resample
from veilwright.llm.secrets import scan_secrets
from veilwright.llm.simhash import near_duplicates
from veilwright.llm.toxicity import toxicity
from veilwright.llm.warc import resolve_revisits

VOCABULARY = "byte_bpe_50k.json"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir))


QUERIES["op1_exact_dedup"] = op1_exact_dedup
ORACLES["op1_exact_dedup"] = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW same AS (PARTITION BY coalesce(text, ''))
"""


def op5_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


QUERIES["op5_simhash_dedup"] = op5_simhash_dedup


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "tile")
    return text_media(documents(spark, sf_dir)).select(*columns)


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(documents(spark, sf_dir))


QUERIES["op2_media_columns"] = op2_media_columns
QUERIES["op7_pii"] = op7_pii


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


QUERIES["op6_toxicity"] = op6_toxicity


def op9_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(documents(spark, sf_dir), public_tokenizers.path(VOCABULARY))


QUERIES["op9_bpe_roundtrip"] = op9_bpe_roundtrip


def op8_bm25_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir), public_tokenizers.path(VOCABULARY))


QUERIES["op8_bm25_packing"] = op8_bm25_packing


def op4_quality_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    share = labels.agg(F.avg("quality")).first()[0]
    return resample(documents(spark, sf_dir), labels.where("quality = 1"), share=share)


QUERIES["op4_quality_resampling"] = op4_quality_resampling


def crawl_log(pages: DataFrame) -> DataFrame:
    """WARC records of a crawl: each page answered in full, and asked again (with a noisy URL) for a not-modified answer.

    Page p answers at 10 p and is revisited at 10 p + 4, every seventh one at 10 p - 3, before its
    own answer; every fifth revisit carries an outdated ETag.
    """
    p = pages.select(F.col("page_id").cast("long").alias("p"), "url", F.md5(F.coalesce("html", F.lit("")).cast("binary")).alias("tag"), F.length(F.coalesce("html", F.lit(""))).cast("string").alias("n"))
    when = F.when(F.col("p") % 7 == 0, F.col("p") * 10 - 3).otherwise(F.col("p") * 10 + 4)
    tag = F.when(F.col("p") % 5 == 0, F.concat(F.lit("old-"), F.col("tag"))).otherwise(F.col("tag"))
    none = F.lit(None).cast("string")
    full = p.select((F.col("p") * 2).alias("record_id"), "url", (F.col("p") * 10).alias("ts"), F.lit("response").alias("kind"), F.col("tag").alias("etag"), none.alias("last_modified"), F.create_map(F.lit("content-type"), F.lit("text/html"), F.lit("content-length"), F.col("n"), F.lit("date"), (F.col("p") * 10).cast("string")).alias("headers"))
    noisy = F.concat(F.regexp_replace("url", "#.*$", ""), F.when(F.col("url").contains("?"), "&").otherwise("?"), F.lit("utm_source=again#part"))
    again = p.select((F.col("p") * 2 + 1).alias("record_id"), noisy.alias("url"), when.alias("ts"), F.lit("revisit").alias("kind"), tag.alias("etag"), none.alias("last_modified"), F.create_map(F.lit("date"), when.cast("string"), F.lit("content-length"), F.lit("0")).alias("headers"))
    return full.unionByName(again)


def op10_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resolve_revisits(crawl_log(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    shown = F.array_join(F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ";")
    return found.select(((F.col("record_id") - 1) / 2).cast("long").alias("page_id"), "canonical", "status", "response_id", shown.alias("headers"))


QUERIES["op10_warc_revisits"] = op10_warc_revisits
ORACLES["op10_warc_revisits"] = """
WITH p AS (
  SELECT CAST(page_id AS BIGINT) AS p, md5(coalesce(html, '')) AS tag, CAST(length(coalesce(html, '')) AS VARCHAR) AS n,
         regexp_replace(trim(url), '#.*$', '') AS plain
  FROM pages
), parts AS (
  SELECT *, lower(regexp_extract(plain, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) AS scheme,
         regexp_replace(plain, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?@]*@)?', '') AS rest
  FROM p
), canon AS (
  SELECT p, tag, n, CASE WHEN scheme = '' THEN plain ELSE
    scheme || '://' || CASE scheme WHEN 'http' THEN regexp_replace(lower(regexp_extract(rest, '^([^/?]*)', 1)), ':80$', '')
                                   WHEN 'https' THEN regexp_replace(lower(regexp_extract(rest, '^([^/?]*)', 1)), ':443$', '')
                                   ELSE lower(regexp_extract(rest, '^([^/?]*)', 1)) END
    || regexp_replace(regexp_extract(rest, '^[^/?]*(/[^?]*)?', 1), '/+$', '')
    || coalesce('?' || nullif(array_to_string(list_sort(list_filter(string_split(regexp_extract(rest, '\\?(.*)$', 1), '&'),
         lambda x: x <> '' AND NOT regexp_matches(regexp_extract(x, '^([^=]*)', 1), '^(utm_[a-z]+|ref|fbclid|gclid|sessionid)$'))), '&'), ''), '')
    END AS canonical
  FROM parts
), full_answers AS (
  SELECT canonical, p * 10 AS ts, p * 2 AS record_id, tag, n FROM canon
), again AS (
  SELECT p, canonical, CASE WHEN p % 7 = 0 THEN p * 10 - 3 ELSE p * 10 + 4 END AS ts,
         CASE WHEN p % 5 = 0 THEN 'old-' || tag ELSE tag END AS tag
  FROM canon
), found AS (
  SELECT a.p, a.canonical, a.ts, a.tag, f.record_id, f.tag AS stored, f.n
  FROM again a ASOF LEFT JOIN full_answers f ON a.canonical = f.canonical AND a.ts > f.ts
)
SELECT p AS page_id, canonical,
       CASE WHEN record_id IS NULL THEN 'no_response' WHEN tag <> stored THEN 'validator_mismatch' ELSE 'resolved' END AS status,
       CASE WHEN tag = stored THEN record_id END AS response_id,
       CASE WHEN tag = stored THEN 'content-length=' || n || ';content-type=text/html;date=' || ts
            ELSE 'content-length=0;date=' || ts END AS headers
FROM found
"""


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(documents(spark, sf_dir), path_col="source")


QUERIES["op3_secret_scan"] = op3_secret_scan
