"""Registered queries of the operators, with the SQL that checks them where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tapeloom.llm import (
    bin_slack,
    filter_audit,
    lattice_lm,
    ngram_join,
    oracles,
    personal_data,
    quality_rules,
    repeated_bytes,
    spaced_seeds,
    spelling_variants,
    token_matrix,
    token_rollup,
    toxicity_pu,
    zstd_quality,
)
from tapeloom.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn

    return wrap


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_ngram_join", oracles.NGRAM_JOIN)
def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of all documents whose 3-word shingles have a Jaccard similarity of 0.9 or more."""
    return ngram_join.similar_groups(table(spark, sf_dir, "documents"), 3, 90)


@query("op2_personal_data")
def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data in all documents."""
    return personal_data.report(table(spark, sf_dir, "documents"))


@query("op3_quality_rules")
def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, score and verdict of all documents; trusted text is that of good labels."""
    out = quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr")


@query("op4_token_rollup")
def op4_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token totals of all documents by source, language and tokenizer version, after five batches."""
    store = token_rollup.Rollup(spark, scratch_path(spark, "token-rollup"))
    return token_rollup.corpus_totals(table(spark, sf_dir, "documents"), store)


@query("op5_repeated_bytes", oracles.REPEATED_BYTES)
def op5_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the bytes of strings of 200 bytes that start elsewhere too."""
    return repeated_bytes.dedupe(table(spark, sf_dir, "documents"))


@query("op6_token_matrix")
def op6_token_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the packed id matrix of all documents, as stored."""
    return token_matrix.packed_digest(table(spark, sf_dir, "documents"))


@query("op7_bin_slack")
def op7_bin_slack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2,048 ids."""
    return bin_slack.pack(table(spark, sf_dir, "documents"))


@query("op8_lattice_lm")
def op8_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lattice and plain word scores of all documents."""
    return lattice_lm.score(table(spark, sf_dir, "documents"))


@query("op9_spaced_seeds", oracles.SPACED_SEEDS)
def op9_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark passages, with the item and how much of it."""
    return spaced_seeds.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op10_zstd_quality")
def op10_zstd_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents, learned from the labels of four folds in five."""
    return zstd_quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op11_filter_audit", oracles.FILTER_AUDIT)
def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove from all documents of each source, in all 120 orders."""
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op12_spelling_variants", oracles.SPELLING_VARIANTS)
def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All words of all documents with their near words, frequent form and root."""
    return spelling_variants.variants(table(spark, sf_dir, "documents"))


@query("op13_toxicity_pu")
def op13_toxicity_pu(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents, learned from the toxic labels of four folds in five."""
    return toxicity_pu.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
