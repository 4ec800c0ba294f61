"""The queries of this subpackage: thin uses of the operators on the given tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from wideloom.llm import conversations, conversations_sql, decontaminate, html_text, kneser_ney, language, line_dedup, line_dedup_sql, ngram_join, packing, pii, quality, rules, token_align, token_counts
from wideloom.llm.common import fold

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {"op6_line_dedup": line_dedup_sql.LINE_REPEATS, "op11_conversation_repair": conversations_sql.REPAIR}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


@query
def op2_packing(spark, sf_dir):
    """Power-of-two pieces of every document."""
    pieces = packing.pack(read(spark, sf_dir, "documents"), tokenizer_path(), with_ids=False)
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


@query
def op4_quality(spark, sf_dir):
    """Quality score of every document."""
    docs = read(spark, sf_dir, "documents")
    model = quality.train(docs, read(spark, sf_dir, "labels"), allowed=~quality.held_out(F.col("doc_id")))
    return quality.score(docs, model).select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


@query
def op8_ngram_join(spark, sf_dir):
    """Classes of 4-word shingle sets with similarity 0.85 or more."""
    return ngram_join.jaccard_classes(read(spark, sf_dir, "documents"), k=4, percent=85)


@query
def op9_pii(spark, sf_dir):
    """Personal data of every document: base counts and digest, and all spans."""
    found = pii.find(read(spark, sf_dir, "documents"))
    counts = [pii.count_of(F.col("base"), i).alias(f"n_{k}") for i, k in enumerate(pii.KINDS)]
    return found.select("doc_id", *counts, F.sha2(pii.listed(F.col("base")), 256).alias("base_sha256"), pii.listed(F.col("spans")).alias("spans"))


@query
def op10_decontamination(spark, sf_dir):
    """Benchmark items contained in documents."""
    return decontaminate.leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


@query
def op1_language(spark, sf_dir):
    """Language of every document."""
    docs, out = read(spark, sf_dir, "documents"), fold(F.col("doc_id"), 5) == 0
    found = language.predict(docs, language.train(docs, ~out))
    return found.select("doc_id", out.alias("held_out"), "lang_pred", "score", "ambiguous")


@query
def op3_language_model(spark, sf_dir):
    """Kneser-Ney and unigram score of every document."""
    docs, out = read(spark, sf_dir, "documents"), fold(F.col("doc_id"), 7) == 2
    model = kneser_ney.train(docs, ~out, order=kneser_ney.ORDER)
    return kneser_ney.score(docs, model).select("doc_id", out.alias("held_out"), "n_tokens", "n_known",
                                                F.lit(model.tokens).cast("bigint").alias("train_tokens"), "base_score", "score")


@query
def op5_quality_rules(spark, sf_dir):
    """Counted rules and the calibrated verdict for every document."""
    docs = read(spark, sf_dir, "documents")
    model = rules.train(docs, read(spark, sf_dir, "labels"), allowed=~quality.held_out(F.col("doc_id")))
    return rules.judge(docs, model)


@query
def op6_line_dedup(spark, sf_dir):
    """Passages that repeat in documents: every occurrence by unit, with original offsets and the one that stays."""
    return line_dedup.repeats(read(spark, sf_dir, "documents"))


@query
def op7_html_text(spark, sf_dir):
    """Main text of every page."""
    return html_text.extract(read(spark, sf_dir, "pages"))


@query
def op13_token_counts(spark, sf_dir):
    """Tokens of every document, and the longest prefix within the limit."""
    return token_counts.count(read(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), limit=1024).select(
        "doc_id", "n_bytes", "n_tokens", "over_limit", "fit_chars")


@query
def op12_token_alignment(spark, sf_dir):
    """Groups and links between the tokens of two vocabularies."""
    return token_align.align(read(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


@query
def op11_conversation_repair(spark, sf_dir):
    """Faults, cheapest repair and digest of every damaged conversation."""
    return conversations.repair_damaged(read(spark, sf_dir, "conversations"))
