"""Queries of the training-data operators, each over its whole table, and their SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import bpe, cascade, forest, jaccard, language, lines, mixing, pages, pieces, winnow
from docloom.llm.common import table


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.main_text(table(spark, sf_dir, "pages"))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.score(table(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnow.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cascade.filter_urls(table(spark, sf_dir, "pages"), cascade.by_host())


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_removed")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.token_counts(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language.identify(docs, language.train(docs))


QUERIES = {f.__name__: f for f in (op1_html_extraction, op2_lm_scoring, op3_decontamination, op4_bpe, op5_url_filters, op6_line_dedup, op7_quality_rules, op8_token_counts, op9_ngram_jaccard, op10_language_id)}

AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
RULES_SQL = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in cascade.RULES)

ORACLES = {
    "op3_decontamination": f"""
WITH doc AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), {AZ}), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '') AS words FROM documents),
item AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), {AZ}), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '') AS words FROM benchmark),
span AS (SELECT DISTINCT item_id, least(len(words), 10) AS n, array_to_string(words[i:i + least(len(words), 10) - 1], ' ') AS span
  FROM (SELECT item_id, words, unnest(generate_series(1, len(words) - least(len(words), 10) + 1)) AS i FROM item WHERE len(words) > 0)),
size AS (SELECT DISTINCT n FROM span),
run AS (SELECT doc_id, i, n, array_to_string(words[i:i + n - 1], ' ') AS span FROM (SELECT doc_id, words, n, unnest(generate_series(1, len(words) - n + 1)) AS i FROM doc, size)),
found AS (SELECT run.doc_id, run.i, run.n, span.item_id FROM run JOIN span USING (n, span)),
word AS (SELECT doc_id, count(DISTINCT w) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS w FROM found) GROUP BY doc_id),
ids AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(id, ',' ORDER BY id)) AS sha FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM found) GROUP BY doc_id)
SELECT doc.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, coalesce(sha, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN word USING (doc_id) LEFT JOIN ids USING (doc_id)""",
    "op5_url_filters": f"""
WITH part AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
url AS (SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1), {AZ}) AS host, regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM part),
rule(h, p, v) AS (VALUES {RULES_SQL}),
fit AS (SELECT page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS v FROM url JOIN rule ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(v, CASE WHEN regexp_matches(host, '{cascade.LISTED_HOST}') THEN 'block' ELSE 'allow' END) AS verdict
FROM url LEFT JOIN fit USING (page_id)""",
    "op6_line_dedup": f"""
WITH line AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, unnest(generate_series(1, len(string_split(text, chr(10))))) AS pos FROM documents),
wide AS (SELECT line, min(doc_id) AS first FROM line WHERE trim(line) <> '' GROUP BY line HAVING count(DISTINCT source) >= {lines.SITES}),
kept AS (SELECT doc_id, coalesce(string_agg(line.line, chr(10) ORDER BY pos) FILTER (wide.first IS NULL OR wide.first = doc_id), '') AS text, count(*) AS n_lines, count(*) FILTER (wide.first <> doc_id) AS n_removed FROM line LEFT JOIN wide USING (line) GROUP BY doc_id)
SELECT doc_id, text, CAST(n_lines AS BIGINT) AS n_lines, CAST(n_removed AS BIGINT) AS n_removed FROM kept""",
}
