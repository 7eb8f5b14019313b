"""Registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assetflow.llm import (cdc_dedup, hard_negatives, hnsw, langid_ecoc, mixing_poisson, packing_drr, periodic_runs,
                           pii_boosted, quality_nbsvm, risk_rules, simhash, url_filter, warc_archive)
from assetflow.llm.common import fold, read

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing_drr.pack(read(spark, sf_dir, "documents"), TOKENIZER)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return risk_rules.judge(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cdc_dedup.repeated_spans(read(spark, sf_dir, "documents"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii_boosted.find(read(spark, sf_dir, "documents"))
    return found.select("doc_id", *[f"n_{k}" for k in pii_boosted.BASE], F.sha2("base_text", 256).alias("base_sha256"), "spans", "n_added")


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_nbsvm.fit(docs, read(spark, sf_dir, "labels"))
    return quality_nbsvm.score(docs, model).select(
        "doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score",
        (F.col("score") >= quality_nbsvm.THRESHOLD).cast("int").alias("predicted"))


def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.neighbours(read(spark, sf_dir, "embeddings"), every=20, k=20)


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(read(spark, sf_dir, "pages"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing_poisson.replicate(read(spark, sf_dir, "documents"), max_rate=None)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    said = langid_ecoc.predict(docs, langid_ecoc.fit(docs))
    return said.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "lang_pred", "score", "ambiguous")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"), shingle=3, radius=3)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(read(spark, sf_dir, "embeddings").withColumn("label", label))


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_archive.round_trip(read(spark, sf_dir, "pages")).drop("problem")


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.periodic_runs(periodic_runs.planted(read(spark, sf_dir, "documents")))


QUERIES = {f.__name__: f for f in (
    op1_packing, op2_quality_rules, op3_substring_dedup, op4_pii, op5_quality_classifier, op6_nearest_neighbours,
    op7_url_filter, op8_mixing, op9_language_id, op10_simhash, op11_hard_negatives, op12_warc, op13_periodic_runs)}

ORACLE = {
    "op8_mixing": """
        WITH sized AS (
            SELECT coalesce(source, '') AS s, sum(length(coalesce(text, '')))::DOUBLE AS size FROM documents GROUP BY 1),
        whole AS (SELECT sum(size) AS all_size, sum(sqrt(size)) AS all_w FROM sized),
        rates AS (
            SELECT s, CASE WHEN size > 0 AND all_w > 0 THEN sqrt(size) / all_w * all_size / size ELSE 1.0 END AS rate
            FROM sized, whole),
        cdf AS (
            SELECT s, sum(exp(-rate + k * ln(rate) - lgamma(k + 1))) OVER (PARTITION BY s ORDER BY k) AS c
            FROM rates, range(0, 1100) AS q(k)),
        steps AS (SELECT s, list(c) AS cs FROM cdf GROUP BY s),
        drawn AS (
            SELECT d.*, coalesce(d.doc_id::VARCHAR, '') AS key,
                   len(list_filter(cs, lambda c: c <= ('0x' || substr(md5('draw17:' || coalesce(d.doc_id::VARCHAR, '')), 1, 13))::BIGINT
                                                      / 4503599627370496.0)) AS n
            FROM documents d JOIN steps ON coalesce(d.source, '') = steps.s)
        SELECT doc_id, text, lang, source, n_chars, copy::INTEGER AS copy, md5('deal17:' || key || ':' || copy) AS shuffle_key
        FROM (SELECT *, unnest(range(1, n + 1)) AS copy FROM drawn WHERE n > 0)
    """,
    "op12_warc": """
        WITH p AS (
            SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
        tops AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) END AS top FROM p)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN top IS NULL OR page_id IS NOT DISTINCT FROM top THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id IS DISTINCT FROM top THEN top END AS refers_to
        FROM tops
    """,
}
