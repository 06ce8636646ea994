"""Queries of the training-data operators and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, licenses, media, mixing, neardup, sharding, substrings, toxicity, urls, warc


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read(warc.write(_read(spark, sf_dir, "pages")))


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(_read(spark, sf_dir, "pages"), _read(spark, sf_dir, "labels"))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_read(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judge(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark")).drop("th")


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(_read(spark, sf_dir, "documents"))


def op7_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(_read(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.features(media.encode(_read(spark, sf_dir, "documents")))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.interleave(_read(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_warc, op2_url_filters, op3_licenses, op4_toxicity, op5_decontamination, op6_near_duplicates, op7_substrings, op8_mixing, op9_media, op10_sharding)}


OP1_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, sha1(encode(html)) AS payload_digest FROM p),
m AS (SELECT payload_digest, max(page_id) AS last FROM d WHERE payload_bytes >= 1000 GROUP BY payload_digest HAVING count(*) > 1)
SELECT d.*, CASE WHEN m.last IS NULL OR d.page_id = m.last THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN d.page_id IS DISTINCT FROM m.last THEN m.last END AS refers_to
FROM d LEFT JOIN m ON d.payload_digest = m.payload_digest
"""

OP8_SQL = r"""
WITH q AS (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id),
d AS (SELECT d.doc_id, d.source, d.source IS NULL AS n, coalesce(d.source, '') AS s, coalesce(len(regexp_extract_all(d.text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
  -ln((CAST('0x' || substr(md5('mix-1:' || coalesce(d.doc_id::VARCHAR, 'null')), 1, 12) AS BIGINT) + 0.5::DOUBLE) / 281474976710656.0::DOUBLE)
    / CASE WHEN q.quality >= 1 THEN 1.0::DOUBLE WHEN q.quality IS NOT NULL THEN 0.5::DOUBLE ELSE 0.75::DOUBLE END AS k
  FROM documents d LEFT JOIN q USING (doc_id)),
z AS (SELECT n, s, sum(size)::BIGINT AS source_size FROM d GROUP BY n, s),
w AS (SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][1 + (row_number() OVER (ORDER BY n, encode(s)) - 1) % 3] AS w FROM z),
r AS (SELECT *, 2.0::DOUBLE * source_size AS cap, 2.0::DOUBLE * source_size / w AS ratio FROM w),
l AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY ratio, n, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(w) OVER (ORDER BY ratio, n, s ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r),
v AS (SELECT *, max(CASE WHEN level <= ratio THEN level END) OVER () AS water FROM l),
t AS (SELECT n, s, source_size, CASE WHEN water IS NULL THEN cap ELSE least(cap, w * water) END AS target FROM v),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM t),
p AS (SELECT d.*, e.source_size, e.target, e.epochs, floor(e.target - e.epochs * e.source_size)::BIGINT AS rest,
  sum(d.size) OVER (PARTITION BY d.n, d.s ORDER BY d.k, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) - d.size AS start FROM d JOIN e ON d.n = e.n AND d.s = e.s)
SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, rest - start)))::BIGINT AS taken, source FROM p
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_warc": OP1_SQL, "op8_mixing": OP8_SQL}
