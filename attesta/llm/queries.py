"""The registered queries of this subpackage and, where SQL can express one, its SQL for DuckDB."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from attesta.llm.common import LOWER, UPPER, table
from attesta.llm.exact_dedup import exact_dedup
from attesta.llm.ivf_pq import search
from attesta.llm.license_scan import scan_licenses
from attesta.llm.merge_dropout import encode_pieces
from attesta.llm.mixing import mix
from attesta.llm.ngram_join import ngram_join
from attesta.llm.quality import score_quality
from attesta.llm.token_file import token_digest
from attesta.llm.toxicity import score_toxicity, train
from attesta.llm.url_rules import Rule, filter_urls

WORD_TOKENIZER, PIECE_MODEL = (public_tokenizers.path(f) for f in ("word_bpe_49k.json", "piece_bpe_32k.model"))
RULES = [
    Rule("allow", "com", "/"), Rule("block", "example.com", "/en/"), Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"), Rule("block", "net", "/fr/"),
]


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def op2_ivf_pq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"))


def op4_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"), RULES)


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_toxicity(docs, train(docs, table(spark, sf_dir, "labels")))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(table(spark, sf_dir, "documents"))


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


def op9_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digest(table(spark, sf_dir, "documents"), WORD_TOKENIZER)


def op10_merge_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_pieces(table(spark, sf_dir, "documents"), PIECE_MODEL, with_ids=False)


QUERIES = {f.__name__: f for f in (op1_license_scan, op2_ivf_pq, op3_quality, op4_url_rules, op5_exact_dedup, op6_toxicity, op7_ngram_join, op8_source_mix, op9_token_file, op10_merge_dropout)}

_RULES_SQL = ", ".join(f"('{r.action}', '{r.host}', '{r.path}')" for r in RULES)
_WORDS = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"
ORACLE_SQL = {
    "op4_url_rules": rf"""
WITH u AS (SELECT page_id, translate(regexp_extract(r, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path
  FROM (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages)),
rules(action, rhost, rpath) AS (VALUES {_RULES_SQL}),
fits AS (SELECT page_id, first(rhost || rpath ORDER BY length(rhost || rpath) DESC, length(rhost) DESC) AS rule,
  first(action ORDER BY length(rhost || rpath) DESC, length(rhost) DESC) AS action
  FROM (SELECT DISTINCT * FROM u) JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id)
SELECT u.page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM u LEFT JOIN fits USING (page_id)""",
    "op5_exact_dedup": f"""
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS norm FROM documents),
g AS (SELECT norm, max(doc_id) AS keep_id, count(*)::BIGINT AS group_size, sha256(norm) AS text_sha256 FROM t GROUP BY norm)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AND row_number() OVER (PARTITION BY norm, doc_id ORDER BY doc_id) = 1 AS kept, text_sha256
FROM t JOIN g USING (norm)""",
    "op8_source_mix": f"""
WITH sized AS (SELECT doc_id, source, {_WORDS}::BIGINT AS size,
    ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '') || ':' || coalesce(source, '') || ':' || md5(coalesce(text, ''))), 1, 15))::BIGINT AS h FROM documents),
totals AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
ranked AS (SELECT *, [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3 + 1] AS w FROM totals),
caps AS (SELECT *, 2 * source_size AS cap, (2 * source_size)::DOUBLE / w AS ratio, 1.5::DOUBLE * sum(source_size) OVER () AS budget FROM ranked),
levels AS (SELECT *, (budget - coalesce(sum(cap) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
    / (sum(w) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS lvl FROM caps),
targets AS (SELECT source, source_size, CASE WHEN lvl < ratio THEN (max(CASE WHEN lvl < ratio THEN lvl END) OVER ()) * w ELSE cap::DOUBLE END AS target FROM levels),
plan AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS full_times FROM targets),
edges AS (SELECT e.*, target - full_times * source_size AS rest, sum(n) OVER (PARTITION BY e.source ORDER BY h) AS cum
    FROM (SELECT source, h, sum(size) AS n, count(*) AS rows FROM sized GROUP BY ALL) e JOIN plan p ON e.source IS NOT DISTINCT FROM p.source),
cut AS (SELECT source, min(h) AS edge, arg_min(floor((rest - cum + n) * rows / n + 0.5), h) AS first_rows FROM edges WHERE cum > rest GROUP BY source),
judged AS (SELECT doc_id, size, p.source_size, target, s.source, least(2, full_times + CASE WHEN h < edge
        OR (h = edge AND row_number() OVER (PARTITION BY s.source, h ORDER BY doc_id) <= first_rows) THEN 1 ELSE 0 END)::BIGINT AS times
    FROM sized s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source LEFT JOIN cut c ON s.source IS NOT DISTINCT FROM c.source)
SELECT doc_id, size, source_size, target, (times * size)::BIGINT AS taken, times, source FROM judged""",
}
