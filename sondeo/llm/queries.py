"""The thin queries: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sondeo.llm import exact_dedup, filter_audit, html_extraction, labelled, license_scan, mixing, nb_svm, ngram_join, packing, quality_rules, runs, substring_dedup, toxicity, url_filter


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_ngram_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.annotated(table(spark, folder, "documents"))


def op2_license_scans(spark: SparkSession, folder: str) -> DataFrame:
    found = license_scan.scanned(table(spark, folder, "documents"))
    return found.drop("spans")


def op3_mixing_sources(spark: SparkSession, folder: str) -> DataFrame:
    found = mixing.annotated(table(spark, folder, "documents"))
    return found.select("row.doc_id", "size", "source_size", "target", "taken")


def op4_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    return url_filter.judged(table(spark, folder, "pages")).drop("purity")


def op5_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return exact_dedup.annotated(docs, keep="largest").select("row.doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op6_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.packed(table(spark, folder, "documents"), tokenizer_path())


def op7_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    docs, excluded = table(spark, folder, "documents"), lambda key: labelled.held_out(key, 4, 2)
    model = nb_svm.fit(docs, table(spark, folder, "labels"), "quality", excluded)
    return nb_svm.scored(docs, model).select("doc_id", excluded(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op8_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = substring_dedup.deduplicated(table(spark, folder, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op9_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs, excluded = table(spark, folder, "documents"), lambda key: labelled.held_out(key, 3, 1)
    model = toxicity.fit(docs, table(spark, folder, "labels"), "toxic", excluded)
    return toxicity.scored(docs, model).select("doc_id", excluded(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op10_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    found = quality_rules.annotated(table(spark, folder, "documents"), carry=["doc_id"])
    return found.select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")


def op11_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    """The main text of every page, by a field fitted on pages whose markup labels their blocks."""
    pages = table(spark, folder, "pages")
    return html_extraction.extracted(pages, html_extraction.fit(pages)).select("page_id", "url", "text", "n_chars")


def op12_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    """What each of the five filters removes in every order of the five, for each source of ``documents``."""
    return filter_audit.audit(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op13_run_detection(spark: SparkSession, folder: str) -> DataFrame:
    """The maximal periodic runs of every document, a tenth of them with planted runs, and the texts without the repeats."""
    found = runs.detected(runs.planted(table(spark, folder, "documents")))
    return found.select(
        "doc_id", "n_runs", "start", "length", "period", F.floor(1000 * F.col("length") / F.col("period")).alias("exponent_milli"),
        runs.digest(F.col("runs")).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_ngram_jaccard, op2_license_scans, op3_mixing_sources, op4_url_filters, op5_exact_dedup, op6_packing,
        op7_quality_classifier, op8_substring_dedup, op9_toxicity, op10_quality_rules, op11_html_extraction, op12_filter_audit, op13_run_detection,
    )
}
