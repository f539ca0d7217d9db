"""The registered queries of the operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinframe.llm import (
    decontamination, hard_negatives, lexical_search, near_dedup, oracles, perspectives, pii, quality_rules, secrets, segmentation,
    sharding, substring_dedup, url_filter, warc,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def register(f):
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


SHARDS = 40


@register
def op1_byte_shards(spark, sf_dir):
    return sharding.byte_shards(table(spark, sf_dir, "documents"), SHARDS)


@register
def op2_perspectives(spark, sf_dir):
    return perspectives.perspective_digests(table(spark, sf_dir, "conversations"))


SQL["op2_perspectives"] = """
WITH turns AS (SELECT conv_id, turn, role AS speaker, coalesce(text, '') AS text FROM conversations),
speakers AS (SELECT DISTINCT conv_id, speaker AS perspective FROM turns WHERE speaker IS NOT NULL AND speaker <> 'system'),
views AS (
  SELECT t.conv_id, s.perspective, t.turn, t.speaker, t.text,
    CASE WHEN t.speaker = s.perspective THEN 'assistant' WHEN t.speaker = 'system' THEN 'system' ELSE 'user' END AS role,
    CASE WHEN t.speaker <> s.perspective AND t.speaker <> 'system' THEN t.speaker END AS name
  FROM turns t JOIN speakers s ON t.conv_id IS NOT DISTINCT FROM s.conv_id),
headed AS (
  SELECT *, '<|im_start|>' || role || CASE WHEN name IS NULL THEN '' ELSE ' name=' || name END || chr(10) AS head FROM views),
placed AS (
  SELECT *, CAST(coalesce(sum(length(head) + length(text) + length('<|im_end|>') + 1) OVER (
    PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker NULLS FIRST, text
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM headed)
SELECT conv_id, perspective, turn, role, name, start,
  CASE WHEN role = 'assistant' THEN start + length(head) END AS train_start,
  CASE WHEN role = 'assistant' THEN start + length(head) + length(text) END AS train_end,
  sha256(head || text || '<|im_end|>' || chr(10)) AS rendered_sha256
FROM placed"""


@register
def op3_archived_pages(spark, sf_dir):
    return warc.archived(table(spark, sf_dir, "pages"))


@register
def op5_repeated_windows(spark, sf_dir):
    return substring_dedup.removal_digests(table(spark, sf_dir, "documents"))


@register
def op10_near_duplicates(spark, sf_dir):
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


@register
def op6_segmentations(spark, sf_dir):
    return segmentation.segmentation_digests(table(spark, sf_dir, "documents"))


@register
def op7_personal_data(spark, sf_dir):
    return pii.personal_data(table(spark, sf_dir, "documents"))


@register
def op8_secret_spans(spark, sf_dir):
    return secrets.secret_spans(table(spark, sf_dir, "documents"))


@register
def op9_contaminated_words(spark, sf_dir):
    return decontamination.contaminated_words(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@register
def op4_quality_rules(spark, sf_dir):
    return quality_rules.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@register
def op11_ranked_documents(spark, sf_dir):
    return lexical_search.ranked_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


URL_RULES = [
    ("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


@register
def op12_judged_urls(spark, sf_dir):
    values = ", ".join(str(rule) for rule in URL_RULES)
    rules = spark.sql(f"SELECT * FROM VALUES {values} AS rules(host, path, verdict)")
    return url_filter.judged_urls(table(spark, sf_dir, "pages"), rules)


@register
def op13_hard_negatives(spark, sf_dir):
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(table(spark, sf_dir, "embeddings"), label=moved)


SQL |= {
    "op11_ranked_documents": oracles.RANKED, "op12_judged_urls": oracles.judged_urls(URL_RULES),
    "op13_hard_negatives": oracles.HARD_NEGATIVES,
    "op3_archived_pages": oracles.ARCHIVED, "op4_quality_rules": oracles.QUALITY,
    "op5_repeated_windows": oracles.REPEATED_WINDOWS, "op9_contaminated_words": oracles.CONTAMINATED,
    "op10_near_duplicates": oracles.NEAR_DUPLICATES,
}
