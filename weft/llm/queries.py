"""The operators' queries over the driver's tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm import bpe, counting, fingerprints, jaccard, packing, quality, repeats, secrets, sharding, urls


def vocabulary(name: str) -> str:
    """Where a public vocabulary file is."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.ledger(_documents(spark, sf_dir).select("doc_id", "text"))
    base = F.col("failed_bits").bitwiseAND(F.lit(quality.POLICIES["base-1"]).cast("long")) != 0
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), quality.kept("web-2").alias("kept"), "failed_bits")


def op2_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(_documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans", "n_entropy")


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(_documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "shard_id", "shard_depth", "row_bytes", "shard_bytes")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_documents(spark, sf_dir), vocabulary("word_bpe_49k.json"))


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.remove(_documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = counting.count_tokens(_documents(spark, sf_dir).select("doc_id", "text"), vocabulary("byte_bpe_50k.json"))
    return found.select("doc_id", "n_bytes", "n_tokens", "over_limit", "n_splices")


def op7_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.against_next(_documents(spark, sf_dir))


def op8_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(_documents(spark, sf_dir), vocabulary("byte_bpe_multi_50k.tiktoken"))


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.groups(_documents(spark, sf_dir))


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return urls.judge(pages).select("page_id", "host", "path", "rule", "verdict", "n_strict", "n_soft")


QUERIES = {f.__name__: f for f in (op1_quality_rules, op2_secret_scans, op3_sharding, op4_packing, op5_suffix_array_dedup, op6_token_counts, op7_document_fingerprints, op8_byte_level_bpe, op9_ngram_jaccard_join, op10_url_filters)}


def _op1_sql() -> str:
    words = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
    tests = {name: f"CASE WHEN {sql} THEN {1 << quality.RULES[name][0]} ELSE 0 END" for name, sql in {
        "few_words": "n_words < 20",
        "repeated_words": "100 * n_repeat_words > 30 * n_words",
        "symbols": "10 * n_symbols > 3 * n_words",
        "repeated_lines": "10 * n_dup_lines > 3 * n_lines",
        "short_words": "word_chars < 2 * n_words",
        "long_words": "word_chars > 20 * n_words",
        "no_letters": "10 * n_letter_words < 6 * n_words",
        "capitals": "10 * n_capitals > 4 * word_chars",
    }.items()}
    any_script = tests | {name: f"CASE WHEN {sql} THEN {1 << quality.RULES[name][0]} ELSE 0 END" for name, sql in {
        "few_words": "n_units < 20",
        "symbols": "10 * n_symbols > 3 * n_units",
        "long_words": "spaced_chars > 20 * n_spaced_words",
        "no_letters": "10 * n_any_letter_words < 6 * n_words",
    }.items()}
    unspaced = quality.UNSPACED.replace("{Is", "{")
    return rf"""
    WITH d AS (
      SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, {words} AS w,
             list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
      FROM documents),
    win AS (
      SELECT r, i, array_to_string(w[i:i + 7], ' ') AS s
      FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS i FROM d)),
    rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, s) AS n FROM win) WHERE n > 1),
    cov AS (SELECT r, count(DISTINCT i + j) AS n FROM (SELECT r, i, unnest(range(0, 8)) AS j FROM rep) GROUP BY r),
    m AS (
      SELECT doc_id, len(w) AS n_words,
             coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
             len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
             len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines,
             coalesce(cov.n, 0) AS n_repeat_words,
             len(list_filter(w, lambda x: lower(x) <> upper(x))) AS n_letter_words,
             len(regexp_extract_all(text, '[A-Z]')) AS n_capitals,
             list_filter(w, lambda x: NOT regexp_matches(x, '{unspaced}')) AS spaced,
             len(list_filter(w, lambda x: regexp_matches(x, '\p{{L}}'))) AS with_letters,
             len(regexp_extract_all(text, '{unspaced}')) AS n_unspaced
      FROM d LEFT JOIN cov USING (r)),
    u AS (
      SELECT *, len(spaced) AS n_spaced_words, coalesce(list_sum(list_transform(spaced, lambda x: length(x))), 0)::BIGINT AS spaced_chars, len(spaced) + n_unspaced AS n_units,
             CASE WHEN 10 * n_letter_words < 6 * n_words THEN with_letters ELSE n_letter_words END AS n_any_letter_words
      FROM m),
    b AS (SELECT *, CAST({" + ".join(tests.values())} AS BIGINT) AS failed_bits, CAST({" + ".join(any_script.values())} AS BIGINT) AS failed_any_script FROM u)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
           (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed, failed_any_script = 0 AS kept, failed_bits
    FROM b"""


def _op10_sql() -> str:
    one = lambda terms: f"regexp_matches(lower(coalesce(url, '')), '(^|[^a-z0-9])({'|'.join(terms)})([^a-z0-9]|$)')"
    soft = " + ".join(f"CASE WHEN {one([t])} THEN 1 ELSE 0 END" for t in urls.SOFT)
    hits = " + ".join(f"len(list_filter(string_split(regexp_replace(lower(coalesce(url, '')), '[^a-z0-9]', ' ', 'g'), ' '), lambda x: x = '{t}'))" for t in urls.STRICT)
    case = lambda k: "CASE " + " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{(h + p) if k else v}'" for v, h, p in sorted(urls.RULES, key=lambda r: -len(r[1] + r[2]))) + " END"
    return rf"""
    WITH a AS (
      SELECT page_id, url, CASE WHEN contains(url, '://') THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^?#]*') ELSE '' END AS rest FROM pages),
    h AS (SELECT page_id, url, translate(regexp_extract(rest, '^[^/]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                 substr(rest, length(regexp_extract(rest, '^[^/]*')) + 1) AS path FROM a),
    t AS (SELECT *, {hits} AS n_strict, {soft} AS n_soft, {case(True)} AS rule, {case(False)} AS said FROM h)
    SELECT page_id, host, path, rule, coalesce(said, CASE WHEN n_strict > 0 OR n_soft >= {urls.LEAST_SOFT} THEN 'block' ELSE 'allow' END) AS verdict,
           n_strict::BIGINT AS n_strict, n_soft::BIGINT AS n_soft
    FROM t"""


ORACLE_SQL = {"op1_quality_rules": _op1_sql(), "op10_url_filters": _op10_sql()}
