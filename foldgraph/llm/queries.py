"""The operators as registered queries, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from foldgraph.llm import (
    byte_pairs, filter_audit, fingerprints, jaccard, language, neighbours, packing, passages, periodic, quality, secrets, toxicity, url_filters,
)

BYTE_TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def op1_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    return fingerprints.edited_fingerprints(_table(spark, sf, "documents"))


def op2_passages(spark: SparkSession, sf: str) -> DataFrame:
    return passages.repeated_passages(_table(spark, sf, "documents"))


def op3_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    return neighbours.nearest(_table(spark, sf, "embeddings"), every=20, k=20)


def op4_language(spark: SparkSession, sf: str) -> DataFrame:
    return language.identify(_table(spark, sf, "documents"))


def op5_byte_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return byte_pairs.encode_documents(_table(spark, sf, "documents"), BYTE_TOKENIZER)


def op6_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    docs = _table(spark, sf, "documents")
    return toxicity.grade(docs, toxicity.fit(docs, _table(spark, sf, "labels")))


def op7_jaccard(spark: SparkSession, sf: str) -> DataFrame:
    return jaccard.jaccard_join(_table(spark, sf, "documents")).drop("class_key", "text_hash")


def op8_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf, "documents"), WORD_TOKENIZER, capacity=4096, end_id=2)


def op9_url_filters(spark: SparkSession, sf: str) -> DataFrame:
    return url_filters.judge_urls(_table(spark, sf, "pages"), url_filters.rule_table(spark, RULES))


def op10_secrets(spark: SparkSession, sf: str) -> DataFrame:
    found = secrets.find_secrets(_table(spark, sf, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", F.size("live").alias("n_live"), "examples")


def op11_filter_audit(spark: SparkSession, sf: str) -> DataFrame:
    docs, labels = _table(spark, sf, "documents"), _table(spark, sf, "labels")
    return filter_audit.interactions(filter_audit.combinations(docs, labels, filter_audit.FILTERS), "".join([*filter_audit.FILTERS, "E"]))


def op12_periodic_runs(spark: SparkSession, sf: str) -> DataFrame:
    found = periodic.periodic_runs(periodic.with_loops(_table(spark, sf, "documents")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    line = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"), F.expr("1000 * best.length div -best.period").alias("exponent_milli"),
        F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    return quality.judge_quality(_table(spark, sf, "documents")).drop("n_lines")


def pipeline(spark: SparkSession, sf: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_fingerprints, op2_passages, op3_neighbours, op4_language, op5_byte_pairs, op6_toxicity, op7_jaccard, op8_packing, op9_url_filters,
              op10_secrets, op11_filter_audit, op12_periodic_runs, op13_quality_rules, pipeline)
}

OP9_SQL = r"""
WITH parts AS (
  SELECT page_id, CASE WHEN position('://' IN coalesce(url, '')) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages
), judged AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts
), rules(verdict, rule_host, rule_path) AS (
  VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
), best AS (
  SELECT host, path, max(struct_pack(n := length(rule_host) + length(rule_path), h := length(rule_host), b := CAST(verdict = 'block' AS INTEGER),
    rule := rule_host || rule_path)) AS r
  FROM (SELECT DISTINCT host, path FROM judged) u JOIN rules
    ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY host, path
)
SELECT page_id, j.host, j.path, r.rule AS rule, CASE WHEN r.b = 1 THEN 'block' ELSE 'allow' END AS verdict
FROM judged j LEFT JOIN best ON j.host = best.host AND j.path = best.path
"""

OP11_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), f AS (
  SELECT doc_id, part, [len(words) < 100, 100 * len(list_distinct(words)) < 80 * len(words), 100 * len(regexp_extract_all(text, '[A-Z]')) > 10 * length(text),
    regexp_matches(text, '[#$%&*|]'), doc_id > min(doc_id) OVER (PARTITION BY text)] AS fails FROM d
), l AS (
  SELECT doc_id, max(CAST(quality = 1 AS INTEGER)) AS quality, max(CAST(toxic = 1 AS INTEGER)) AS toxic FROM labels GROUP BY doc_id
), c AS (
  SELECT part, CASE WHEN fails[1] THEN 1 ELSE 0 END AS a, CASE WHEN fails[2] THEN 1 ELSE 0 END AS b, CASE WHEN fails[3] THEN 1 ELSE 0 END AS c,
    CASE WHEN fails[4] THEN 1 ELSE 0 END AS d, CASE WHEN fails[5] THEN 1 ELSE 0 END AS e, coalesce(quality, 0) AS quality, coalesce(toxic, 0) AS toxic, count(*) AS n
  FROM f LEFT JOIN l ON f.doc_id = l.doc_id GROUP BY ALL
), s AS (
  SELECT part, (CASE WHEN a = 1 THEN 'A' ELSE '' END) || (CASE WHEN b = 1 THEN 'B' ELSE '' END) || (CASE WHEN c = 1 THEN 'C' ELSE '' END)
    || (CASE WHEN d = 1 THEN 'D' ELSE '' END) || (CASE WHEN e = 1 THEN 'E' ELSE '' END) AS failed, quality, toxic, n FROM c
), letters(x) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
orders AS (
  SELECT p.x || q.x || r.x || s.x || t.x AS filter_order FROM letters p, letters q, letters r, letters s, letters t
  WHERE p.x <> q.x AND p.x <> r.x AND p.x <> s.x AND p.x <> t.x AND q.x <> r.x AND q.x <> s.x AND q.x <> t.x AND r.x <> s.x AND r.x <> t.x AND s.x <> t.x
), steps AS (
  SELECT filter_order, step, substr(filter_order, step, 1) AS letter, substr(filter_order, 1, step - 1) AS before FROM orders, (VALUES (1), (2), (3), (4), (5)) k(step)
), g AS (
  SELECT s.*, filter_order, step, letter, contains(failed, letter) AS fails, length(translate(failed, before, '')) < length(failed) AS gone FROM s, steps
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(sum(CASE WHEN NOT gone AND NOT fails THEN n ELSE 0 END) AS BIGINT) AS kept,
  CAST(sum(CASE WHEN NOT gone AND fails THEN n ELSE 0 END) AS BIGINT) AS removed, CAST(sum(CASE WHEN gone AND fails THEN n ELSE 0 END) AS BIGINT) AS redundant,
  CAST(sum(CASE WHEN failed = letter THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
  CAST(sum(CASE WHEN NOT gone AND fails AND quality = 1 THEN n ELSE 0 END) AS BIGINT) AS good_lost,
  CAST(sum(CASE WHEN NOT gone AND fails AND toxic = 1 THEN n ELSE 0 END) AS BIGINT) AS toxic_lost,
  CAST(sum(CASE WHEN fails THEN n * 120 // length(failed) ELSE 0 END) AS BIGINT) AS shapley
FROM g GROUP BY part, filter_order, step
"""

OP13_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents
), x AS (
  SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS g FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM d WHERE len(words) > 2)
), r AS (
  SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS k FROM x) WHERE k > 1
), repeats AS (
  SELECT doc_id, count(DISTINCT j) AS n FROM r GROUP BY doc_id
), m AS (
  SELECT d.doc_id, text, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, len(lines) AS n_lines,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(repeats.n, 0) AS n_repeat_words
  FROM d LEFT JOIN repeats ON d.doc_id = repeats.doc_id
), b AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  NOT (base_failed OR word_chars < 2 * n_words OR word_chars > 15 * n_words OR 100 * n_symbols > 25 * n_words OR 100 * n_dup_lines > 50 * n_lines
    OR 2 * len(regexp_extract_all(text, '\p{Lu}')) > word_chars OR 10 * len(regexp_extract_all(text, '\p{L}')) < 5 * word_chars
    OR 100 * len(regexp_extract_all(text, '(?:\.\.\.|…)[ \t\r]*(?:\n|\z)')) > 30 * n_lines) AS kept
FROM b
"""

#: Only where SQL can state the whole result in reasonable time; the others are tested against brute force in tests/llm.
ORACLE: dict[str, str] = {"op9_url_filters": OP9_SQL, "op11_filter_audit": OP11_SQL, "op13_quality_rules": OP13_SQL}
