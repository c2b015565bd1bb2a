"""The registered queries of the training-data operators, each over its whole table, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import classifier, divergence, langid, lm_bloom, maglev, media, mixing, packing, sketch_join, token_count
from .common import table


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_bloom.score(table(spark, sf_dir, "documents"), order=3)


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maglev.place(table(spark, sf_dir, "documents"))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch_join.near_links(table(spark, sf_dir, "documents"))


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(table(spark, sf_dir, "pages"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(table(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.judge(table(spark, sf_dir, "documents"), labels=table(spark, sf_dir, "labels"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identify_documents(docs, langid.fit_text(docs))


def op7_language_id_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify_pages(table(spark, sf_dir, "pages"), langid.fit_text(table(spark, sf_dir, "documents")))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.schedule(table(spark, sf_dir, "documents"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {
        f.__name__: f
        for f in (
            op1_lm_scoring,
            op2_sharding,
            op3_ngram_join,
            op4_media_columns,
            op5_token_counts,
            op6_quality_rules,
            op7_language_id,
            op7_language_id_pages,
            op8_mixing,
            op9_quality_classifier,
            op10_best_fit_packing,
        )
    }


def _sharding_sql() -> str:
    names = maglev.shard_names()
    slots = ",".join(str(i) for i in maglev.lookup_table(names))
    return f"""
WITH lut AS (SELECT string_split('{slots}', ',') AS t),
placed AS (SELECT doc_id, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) % {maglev.SLOTS} AS slot FROM documents)
SELECT doc_id, slot, 'shard-' || lpad(t[slot + 1], 4, '0') AS shard FROM placed, lut"""


def _mixing_sql() -> str:
    b = mixing.BLOCK_TOKENS
    return f"""
WITH n AS (
  SELECT source, doc_id, SUM(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\r\\f]+'), lambda x: x <> ''))) AS n_tokens
  FROM documents GROUP BY source, doc_id),
h AS (SELECT *, CAST('0x' || substr(md5('{mixing.SEED}:' || coalesce(source, '') || ':' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h FROM n),
s AS (
  SELECT source, doc_id, CAST(n_tokens AS BIGINT) AS n_tokens,
    CAST(SUM(n_tokens) OVER (PARTITION BY source ORDER BY h, doc_id ROWS UNBOUNDED PRECEDING) - n_tokens AS BIGINT) AS start,
    CAST(SUM(n_tokens) OVER (PARTITION BY source) AS BIGINT) AS total FROM h),
b AS (SELECT *, LEAST(start // {b}, GREATEST(1, (total + {b - 1}) // {b}) - 1) AS block FROM s),
r AS (
  SELECT source, GREATEST(1, (CAST(SUM(n_tokens) AS BIGINT) + {b - 1}) // {b}) AS n_blocks, GREATEST(1, CAST(FLOOR(POW(CAST(SUM(n_tokens) AS DOUBLE), {mixing.TEMPERATURE}) * 100) AS BIGINT)) AS raw
  FROM b GROUP BY source),
f AS (SELECT CAST(SUM(raw) AS HUGEINT) AS r, CAST(SUM(n_blocks + {mixing.SPARE}) AS HUGEINT) AS q FROM r),
g AS (SELECT source, n_blocks, raw * f.q + (n_blocks + {mixing.SPARE}) * f.r AS w FROM r, f),
t AS (SELECT CAST(SUM(w) AS HUGEINT) AS w FROM g),
slots AS (SELECT MAX(((n_blocks + {mixing.SPARE}) * t.w + g.w - 1) // g.w) AS k FROM g, t),
spans AS (
  SELECT source, n_blocks, (CAST(upto - g.w AS HUGEINT) * {1 << mixing.POINT_BITS}) // t.w AS lo, (CAST(upto AS HUGEINT) * {1 << mixing.POINT_BITS}) // t.w AS hi
  FROM (SELECT *, SUM(w) OVER (ORDER BY source ROWS UNBOUNDED PRECEDING) AS upto FROM g) g, t),
points AS (SELECT range AS slot, (CAST(range + 1 AS HUGEINT) * {mixing.PHI48}) % {1 << mixing.POINT_BITS} AS u FROM slots, range(CAST(slots.k AS BIGINT))),
ranked AS (
  SELECT slot, source, n_blocks, ROW_NUMBER() OVER (PARTITION BY source ORDER BY slot) - 1 AS r
  FROM points JOIN spans ON u >= lo AND u < hi)
SELECT slot, b.source, r // n_blocks AS epoch, block, doc_id, n_tokens, start - block * {b} AS "offset"
FROM ranked JOIN b ON b.source = ranked.source AND b.block = r % n_blocks"""


def oracle_sql() -> dict[str, str]:
    return {"op2_sharding": _sharding_sql(), "op8_mixing": _mixing_sql()}
