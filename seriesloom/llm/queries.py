"""The registered queries of the training-data operators, with production parameters."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesloom.llm import (
    decontamination, html_text, licenses, ngram_join, packing, periodic_runs, quality_rules, simhash_trees, substrings,
    token_files, toxicity, vector_codes, warc)
from seriesloom.llm.common import table
from seriesloom.llm.encoding import default_tokenizer


def op1_token_files(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return token_files.read_token_files(token_files.write_token_files(docs, default_tokenizer()))


def op2_license_scan(spark: SparkSession, sf: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf, "documents"))


def op3_warc_chain(spark: SparkSession, sf: str) -> DataFrame:
    return warc.read_archives(warc.write_archives(table(spark, sf, "pages")))


def op4_html_layout(spark: SparkSession, sf: str) -> DataFrame:
    return html_text.extract_text(table(spark, sf, "pages"))


def op5_benchmark_leaks(spark: SparkSession, sf: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


def op6_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    return quality_rules.quality_verdicts(table(spark, sf, "documents"))


def op7_ngram_join(spark: SparkSession, sf: str) -> DataFrame:
    return ngram_join.linked_documents(table(spark, sf, "documents"))


def op8_best_fit_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf, "documents"), default_tokenizer())


def op9_repeated_phrases(spark: SparkSession, sf: str) -> DataFrame:
    return substrings.removal_report(table(spark, sf, "documents"))


def op10_toxicity_models(spark: SparkSession, sf: str) -> DataFrame:
    return toxicity.toxicity_scores(table(spark, sf, "documents"), table(spark, sf, "labels"))


def op11_vector_codes(spark: SparkSession, sf: str) -> DataFrame:
    coded = vector_codes.vector_codes(table(spark, sf, "embeddings"))
    return coded.select("vec_id", "code", F.col("error").try_cast("long").alias("error"),
                        F.col("label_error").try_cast("long").alias("label_error"), "codebooks_sha256")


def op12_simhash_groups(spark: SparkSession, sf: str) -> DataFrame:
    return simhash_trees.simhash_groups(table(spark, sf, "documents"))


def looped(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words of one document in ten repeat from some place on, as its id has it."""
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not words:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def op13_periodic_runs(spark: SparkSession, sf: str) -> DataFrame:
    found = periodic_runs.periodic_runs(table(spark, sf, "documents"), looped)
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "strongest.start", "strongest.length", "strongest.period",
        F.expr("1000 * strongest.length DIV strongest.period").alias("exponent_milli"),
        F.sha2(F.concat_ws("", lines), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_token_files, op2_license_scan, op3_warc_chain, op4_html_layout, op5_benchmark_leaks, op6_quality_rules,
    op7_ngram_join, op8_best_fit_packing, op9_repeated_phrases, op10_toxicity_models, op11_vector_codes,
    op12_simhash_groups, op13_periodic_runs)}

def codes_sql() -> str:
    """Six rounds of assignment and refinement, every distance compared; vec_ids of the test tables do not repeat."""
    steps = ["""kept AS MATERIALIZED (SELECT vec_id, label, embedding, len(embedding) // 8 AS w,
        row_number() OVER (ORDER BY vec_id) - 1 AS rank FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
             """cells AS MATERIALIZED (SELECT vec_id, rank, i // w AS part, i % w AS place,
        floor(4096 * embedding[i + 1]::DOUBLE)::BIGINT AS v FROM (SELECT *, unnest(range(len(embedding))) AS i FROM kept))""",
             "book0 AS MATERIALIZED (SELECT part, rank AS entry, place, v FROM cells WHERE rank < 16)"]
    for k in range(7):
        steps.append(f"""near{k} AS MATERIALIZED (SELECT vec_id, part, min(d * 16 + entry) AS best FROM (
            SELECT c.vec_id, part, b.entry, sum((c.v - b.v) * (c.v - b.v)) AS d FROM cells c JOIN book{k} b USING (part, place)
            GROUP BY ALL) GROUP BY ALL)""")
        if k < 6:
            steps.append(f"""book{k + 1} AS MATERIALIZED (
            SELECT part, entry, place, coalesce(((s - ((s % n) + n) % n) // n)::BIGINT, v) AS v FROM book{k} LEFT JOIN (
            SELECT part, best % 16 AS entry, place, sum(v) AS s, count(*) AS n FROM near{k} JOIN cells USING (vec_id, part)
            GROUP BY ALL) USING (part, entry, place))""")
    steps.append("""coded AS (SELECT vec_id, string_agg(printf('%02x', (best % 16)::BIGINT), '' ORDER BY part) AS code,
        sum(best // 16)::BIGINT AS error FROM near6 GROUP BY vec_id)""")
    return f"""WITH {", ".join(steps)}
        SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, (SELECT
        sha256(string_agg(v::VARCHAR, ',' ORDER BY part, entry, place)) FROM book6) AS codebooks_sha256
        FROM coded JOIN kept USING (vec_id)"""


# Shingle joins, automata, tokenizers and models have no SQL form that is right and fast on whole tables;
# tests/llm compares them with brute force, round trips and held-out labels.
LLM_ORACLE: dict[str, str] = {
    "op3_warc_chain": """SELECT page_id, strlen(h) AS payload_bytes, sha1(h) AS payload_digest,
        CASE WHEN strlen(h) >= 1000 AND page_id <> keeper THEN 'revisit' ELSE 'response' END AS record_type,
        CASE WHEN strlen(h) >= 1000 AND page_id <> keeper THEN keeper END AS refers_to
        FROM (SELECT page_id, coalesce(html, '') AS h, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS keeper FROM pages)""",
    "op11_vector_codes": codes_sql(),
}
