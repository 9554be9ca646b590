"""Registered queries of the operators: each applies one to its whole table; and the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slotweave.llm.decontam import find_contamination
from slotweave.llm.fim import fill_in_middle, restored
from slotweave.llm.hosts import host_quality
from slotweave.llm.merkle import compare_edits
from slotweave.llm.mixing import soft_mixing
from slotweave.llm.quality import quality_scores
from slotweave.llm.simhash import simhash_near_duplicates
from slotweave.llm.substring import substring_dedup
from slotweave.llm.suffix_dedup import suffix_dedup
from slotweave.llm.tokens import section_tokens
from slotweave.llm.urls import url_verdicts
from slotweave.llm.variants import spelling_variants
from slotweave.llm.warc import round_trip
from slotweave.session import prepare

QUERIES, ORACLES = {}, {}


def query(name: str, table: str):
    def add(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(prepare(spark).read.parquet(f"{sf_dir}/{table}.parquet"), spark, sf_dir)
        return fn

    return add


@query("op1_suffix_array_dedup", "documents")
def op1(docs: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = suffix_dedup(docs, length=400)  # what is left of a character that was cut in two shows as U+FFFD in text, not in the digest
    return kept.withColumn("text", F.make_valid_utf8(F.col("kept").cast("string"))).drop("kept")


@query("op9_simhash_near_dedup", "documents")
def op9(docs: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_near_duplicates(docs, shingle=3, radius=3, seed=42)


@query("op10_substring_dedup", "documents")
def op10(docs: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(docs, window=50)


RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Shares of all tokens that the mix aims at.
TARGETS = {"good": 0.95, "poor": 0.04, "toxic": 0.01}
#: Of these no more than there is: else a cleaner corpus would get copies of bad text and lose good ones.
AT_MOST = ("poor", "toxic")

#: Failure rate from which a host's documents all go: more fail than don't.
HOST_LIMIT = 0.5


def domains(labels: DataFrame) -> DataFrame:
    """Labelled domains: toxic documents, others of low quality, the rest."""
    return labels.select("doc_id", F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "poor").when(F.col("quality") == 1, "good").alias("domain"))


@query("op2_soft_mixing", "documents")
def op2(docs: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    return soft_mixing(docs, domains(spark.read.parquet(f"{sf_dir}/labels.parquet")), TARGETS, at_most=AT_MOST)


@query("op3_warc_chunks", "pages")
def op3(pages: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(pages)


@query("op4_section_tokens", "documents")
def op4(docs: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    return section_tokens(docs, VOCABULARY, rule="majority")


@query("op5_benchmark_decontamination", "documents")
def op5(docs: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), window=13)
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


@query("op6_url_filter", "pages")
def op6(pages: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_verdicts(pages, spark.createDataFrame(RULES, "host string, path string, verdict string"))


@query("op7_merkle_fingerprints", "documents")
def op7(docs: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_edits(docs)


@query("op8_quality_discriminant", "documents")
def op8(docs: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), threshold=0.3)


@query("op11_fill_in_middle", "documents")
def op11(docs: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    made = restored(fill_in_middle(docs, seed=1, plain_percent=10, spm_percent=20))
    digests = F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("restored_sha256")
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


@query("op12_host_rules", "documents")
def op12(docs: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = host_quality(docs, host="source", least_words=20, repeat_percent=30, limit=HOST_LIMIT)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query("op13_spelling_variants", "documents")
def op13(docs: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(docs, least_length=7, least_count=2, factor=10, every=31)


ORACLES["op6_url_filter"] = """
WITH cut AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM cut
), rules(rule_host, rule_path, verdict) AS (
  VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), fits AS (
  SELECT page_id, host, path, rule_host || rule_path AS rule, verdict, length(rule_host) + length(rule_path) AS size, length(rule_host) AS host_size
  FROM parts LEFT JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM fits
QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY size DESC NULLS LAST, host_size DESC) = 1
"""

ORACLES["op3_warc_chunks"] = """
WITH slim AS (SELECT page_id, sha1(coalesce(html, '')) AS digest, coalesce(strlen(html), 0) AS bytes FROM pages),
newest AS (SELECT digest, max(page_id) AS last FROM slim WHERE bytes >= 1000 GROUP BY digest)
SELECT page_id, bytes AS payload_bytes, digest AS payload_digest,
       CASE WHEN bytes >= 1000 AND page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN bytes >= 1000 AND page_id < last THEN last END AS refers_to
FROM slim LEFT JOIN newest USING (digest)
"""

ORACLES["op11_fill_in_middle"] = r"""
WITH units AS (
  SELECT doc_id, coalesce(text, '') AS body, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents
), drawn AS (
  SELECT *, len(t) AS n, ('0x' || h[1:8])::BIGINT % (len(t) + 1) AS c1, ('0x' || h[9:16])::BIGINT % (len(t) + 1) AS c2,
         ('0x' || h[17:24])::BIGINT % 100 AS d3, ('0x' || h[25:32])::BIGINT % 100 AS d4 FROM units
), cut AS (
  SELECT doc_id, body, n, CASE WHEN body = '' OR contains(body, '<P>') OR contains(body, '<S>') OR contains(body, '<M>') OR d3 >= 90 THEN 'plain' WHEN d4 < 20 THEN 'spm' ELSE 'psm' END AS form,
         array_to_string(t[1:least(c1, c2)], '') AS prefix, array_to_string(t[least(c1, c2) + 1:greatest(c1, c2)], '') AS middle, array_to_string(t[greatest(c1, c2) + 1:], '') AS suffix FROM drawn
)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN body WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(body) AS restored_sha256 FROM cut
"""

ORACLES["op12_host_rules"] = r"""
WITH own AS (
  SELECT row_number() OVER () AS k, doc_id, source, coalesce(text, '') AS body FROM documents
), split AS (
  SELECT *, regexp_extract_all(body, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(body, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM own
), windows AS (
  SELECT k, i, w[i:i + 7] AS words FROM (SELECT k, w, unnest(range(1, len(w) - 6)) AS i FROM split)
), twice AS (
  SELECT k, i, lag(i, 1, -8) OVER (PARTITION BY k ORDER BY i) AS before FROM (SELECT k, i, count(*) OVER (PARTITION BY k, words) AS n FROM windows) WHERE n > 1
), repeated AS (
  SELECT k, sum(least(8, i - before)) AS n FROM twice GROUP BY k
), base AS (
  SELECT doc_id, source, len(w) AS n_words, length(regexp_replace(body, '[\x20\x09-\x0D]', '', 'g')) AS word_chars, length(regexp_replace(body, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
         len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words FROM split LEFT JOIN repeated r USING (k)
), judged AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM base
), hosts AS (
  SELECT source, count(*)::DOUBLE AS n, count(*) FILTER (base_failed)::DOUBLE AS f FROM judged WHERE source IS NOT NULL GROUP BY source
), sums AS (
  SELECT count(*) AS k, sum(n) AS rows, sum(f) AS failed, sum(n * n) AS squares, sum(f * f / n) AS spread, sum(f) / sum(n) AS mean FROM hosts
), moments AS (
  SELECT *, mean * (1 - mean) AS chance, rows - squares / rows - (k - 1) AS room FROM sums
), prior AS (
  SELECT mean, CASE WHEN chance > 0 AND room > 0 AND (spread - mean * failed) / chance > k - 1
                    THEN greatest(least(room / ((spread - mean * failed) / chance - (k - 1)) - 1, 1e6), 1e-3) ELSE 1e6 END AS strength FROM moments
), bad AS (
  SELECT source FROM hosts, prior WHERE (f + mean * strength) / (n + strength) >= 0.5
)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND bad.source IS NULL AS kept FROM judged LEFT JOIN bad ON judged.source = bad.source
"""
