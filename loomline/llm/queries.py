"""Registered queries of the training-data operators, and their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, html_text, licenses, line_dedup, minhash_dedup, packing, quality_model, quality_rules, secrets, shards
from .common import read_table


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read_table(spark, sf_dir, "documents"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(read_table(spark, sf_dir, "documents"))


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(read_table(spark, sf_dir, "documents"), percent=85, width=3)


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(read_table(spark, sf_dir, "pages"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"))


def op6_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.write_shards(read_table(spark, sf_dir, "documents"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    scored = quality_model.score(docs, quality_model.train(docs, labels))
    return scored.select("doc_id", "text_score", "meta_score", "quality_score", "kept")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = line_dedup.drop_recurring(read_table(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", "n_lines", "n_dropped", F.length("text").cast("long").alias("n_chars"), "text")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality(read_table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (
        op1_license_scan, op2_secret_scan, op3_minhash_near_dedup, op4_html_extraction, op5_packing, op6_token_shards,
        op7_quality_classifier, op8_decontamination, op9_line_dedup, op10_quality_rules, pipeline,
    )
}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES = {
    "op3_minhash_near_dedup": rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, len(w) AS n, w FROM w
), sh AS (
  SELECT DISTINCT doc_id, CASE WHEN n < 3 THEN array_to_string(w, ' ') ELSE w[k] || ' ' || w[k + 1] || ' ' || w[k + 2] END AS g
  FROM (SELECT doc_id, n, w, unnest(range(1, greatest(n - 1, CASE WHEN n > 0 THEN 2 ELSE 1 END))) AS k FROM s)
), size AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
pair AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both_have FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
), link AS (
  SELECT a, b FROM pair JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b WHERE 100 * both_have >= 85 * (x.n + y.n - both_have)
), edge AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach AS (SELECT doc_id, doc_id AS r FROM documents UNION SELECT reach.doc_id, edge.b FROM reach JOIN edge ON edge.a = reach.r),
c AS (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY 1)
SELECT d.doc_id, coalesce(size.n, 0)::BIGINT AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d JOIN c USING (doc_id) LEFT JOIN size USING (doc_id)
""",
    "op8_decontamination": rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), win AS (
  SELECT DISTINCT item_id, n, array_to_string(list_slice(w, k, k + n - 1), ' ') AS g
  FROM (SELECT item_id, w, least(len(w), 13) AS n, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS k FROM b WHERE len(w) > 0)
), size AS (SELECT DISTINCT n FROM win),
dw AS (
  SELECT doc_id, k, n, array_to_string(list_slice(w, k, k + n - 1), ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, size WHERE len(w) >= n)
), hit AS (SELECT doc_id, k, dw.n, item_id FROM dw JOIN win USING (n, g)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM hit) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM hit) GROUP BY 1)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
""",
    "op10_quality_rules": rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM t),
win AS (
  SELECT doc_id, k, array_to_string(list_slice(w, k, k + 4), ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS k FROM w WHERE len(w) >= 5)
), again AS (SELECT doc_id, g FROM win GROUP BY 1, 2 HAVING count(*) > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(k, k + 5)) AS p FROM win JOIN again USING (doc_id, g)) GROUP BY 1),
line AS (SELECT doc_id, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM t) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
counted AS (
  SELECT doc_id, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n, len(regexp_extract_all(line, '\p{{Lu}}')) AS capitals,
         length(regexp_replace(line, '[\x20\x09-\x0D]+', '', 'g')) AS chars FROM line
), judged AS (
  SELECT doc_id, line, CASE WHEN (n >= 5 AND NOT regexp_matches(line, '[.!?…。！？:;,]'))
      OR len(regexp_extract_all(line, '\|')) * 5 > greatest(n, 10) OR len(regexp_extract_all(line, '[#*$%&<>]')) * 5 > greatest(n, 5)
      OR (capitals >= 20 AND 2 * capitals > len(regexp_extract_all(line, '\p{{L}}'))) OR regexp_matches(line, '{quality_rules.BOILERPLATE}')
    THEN 0 ELSE chars END AS good FROM counted
), lines AS (SELECT doc_id, count(*) - count(DISTINCT line) AS dup, sum(good) AS good FROM judged GROUP BY 1),
x AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(dup, 0)::BIGINT AS n_dup_lines,
         coalesce(rep.n, 0)::BIGINT AS n_repeat_words, coalesce(good, 0)::BIGINT AS clean_chars
  FROM w LEFT JOIN rep USING (doc_id) LEFT JOIN lines USING (doc_id)
)
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND 100 * clean_chars >= {100 - quality_rules.MOST_LOST} * word_chars AS kept
FROM x
""",
}


def oracles() -> dict[str, str]:
    import corpus_pipeline

    return ORACLES | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
