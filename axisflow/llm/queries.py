"""The queries that apply each operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from axisflow.llm.html_templates import extract_main_text
from axisflow.llm.media import sample_report
from axisflow.llm.mixing import mix_sources
from axisflow.llm.packing import pack_by_retrieval
from axisflow.llm.pii import find_pii, fit_candidates
from axisflow.llm.quality_rules import fit_quality, judge_quality
from axisflow.llm.secrets import scan_secrets
from axisflow.llm.shared import scratch
from axisflow.llm.shingle_join import similarity_classes
from axisflow.llm.toxicity import fit_toxicity, held_out, score_toxicity
from axisflow.llm.warc import read_warc, write_warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_site_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))


def op2_pattern_grammar_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit_toxicity(docs, table(spark, sf_dir, "labels").filter(~held_out()))
    scored = score_toxicity(docs, model, keep=["doc_id"])
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_mix_to_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken, _ = mix_sources(table(spark, sf_dir, "documents"))
    return taken.select("doc_id", "size", "source_size", "target", "taken")


def op4_boosted_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return find_pii(docs, fit_candidates(spark, docs))


def op5_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rules = fit_quality(docs, table(spark, sf_dir, "labels"))
    return judge_quality(docs.select("doc_id", "text"), rules).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_entropy_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))


def op7_signature_sniffing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample_report(table(spark, sf_dir, "documents"), "text", ["doc_id"])


def op8_token_combination_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity_classes(table(spark, sf_dir, "documents"), words=3, percent=90)


def op9_retrieval_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_by_retrieval(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_dictionary_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    uri = scratch(spark, "warc")
    write_warc(table(spark, sf_dir, "pages"), uri)
    return read_warc(spark, uri, payload=False).select("page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_site_templates, op2_pattern_grammar_toxicity, op3_mix_to_weights, op4_boosted_pii, op5_decision_list, op6_entropy_secrets, op7_signature_sniffing, op8_token_combination_join, op9_retrieval_packing, op10_dictionary_warc)}


#: SHA-1 as base32: 5 hexadecimal digits are 4 characters.
BASE32 = "array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((('0x' || substr(h, CAST(5 * (i // 4) + 1 AS INTEGER), 5))::BIGINT >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31) + 1 AS INTEGER), 1) for i in range(0, 32)], '')"

SQL = {
    "op8_token_combination_join": """
WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
    SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE [w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] for i in range(1, len(w) - 1)] END) AS s FROM words),
sizes AS (SELECT d.doc_id, count(s) AS n FROM documents d LEFT JOIN shingles USING (doc_id) GROUP BY d.doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (SELECT a, b FROM common c JOIN sizes x ON x.doc_id = c.a JOIN sizes y ON y.doc_id = c.b WHERE 100 * c.n >= 90 * (x.n + y.n - c.n)),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT s.doc_id, s.n AS n_shingles, least(s.doc_id, coalesce(min(r.b), s.doc_id)) AS component_id FROM sizes s LEFT JOIN reach r ON r.a = s.doc_id GROUP BY s.doc_id, s.n""",
    "op10_dictionary_warc": f"""
WITH p AS (SELECT page_id, url, encode(coalesce(html, '')) AS b, sha1(encode(coalesce(html, ''))) AS h FROM pages),
r AS (SELECT *, max(page_id) OVER (PARTITION BY b) AS last FROM p)
SELECT page_id, url, octet_length(b) AS payload_bytes, {BASE32} AS payload_digest, CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> last THEN last END AS refers_to FROM r""",
}


def oracle_sql() -> dict[str, str]:
    """SQL for the queries that have a form that ends on whole tables of the correctness check's size."""
    return dict(SQL)
