"""The queries of this subpackage: thin adapters from an operator to its contract's columns."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import backoff_lm, byte_bpe, conversation_repair, decontamination, line_dedup, ngram_jaccard, quality_fm, quality_rules, simhash, token_alignment, token_counts, toxicity, warc_zip
from .labelled import fold
from .shared import shared_folder
from .sql import ORACLES

#: Name of the public rank file; see the tokenizers' folder.
RANKS = "byte_bpe_50k.tiktoken"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ranks_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(RANKS)


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard.components(_table(spark, sf_dir, "documents"), n=4, p=85, q=100)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.section_counts(_table(spark, sf_dir, "documents"), ranks_path(), rule="start")


def op3_backoff_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backoff_lm.score(_table(spark, sf_dir, "documents"))


def _classified(docs: DataFrame, model, threshold: float) -> DataFrame:
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return _classified(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")), 0.3)


def op5_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return _classified(docs, quality_fm.fit(docs, _table(spark, sf_dir, "labels")), 0.7)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup.dedup(_table(spark, sf_dir, "documents"))
    return done.select("doc_id", F.col("n_lines_removed").cast("long").alias("n_lines_removed"), F.sha2(F.encode("text", "UTF-8"), 256).alias("text_sha256"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), decontamination.digest_of_items().alias("items_sha256"), decontamination.contaminated().alias("contaminated"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = quality_rules.apply_policy(quality_rules.ledger(_table(spark, sf_dir, "documents")))
    base = F.col("failed_bits").bitwiseAND(F.lit(quality_rules.policy_mask("base", 1))) != 0
    return entries.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), "kept", "failed_bits")


def op9_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    archives = warc_zip.write_archives(warc_zip.with_revisits(pages), f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}")
    kind = pages.schema["page_id"].dataType
    return warc_zip.read_archives(archives).select(F.col("page").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(_table(spark, sf_dir, "documents"), ranks_path())


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.components(_table(spark, sf_dir, "documents"), n=4, most=4)


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    a = token_alignment.Tokenizer("byte_level", public_tokenizers.path("byte_bpe_50k.json"))
    b = token_alignment.Tokenizer("pieces", public_tokenizers.path("piece_bpe_32k.model"))
    found = token_alignment.align(_table(spark, sf_dir, "documents"), a, b)
    return found.select(*[c for c in found.columns if c != "groups"], F.when(F.col("n_groups") > 0, F.sha2(F.encode("groups", "UTF-8"), 256)).otherwise("").alias("groups_sha256"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = conversation_repair.damaged(_table(spark, sf_dir, "conversations"))
    return conversation_repair.report(conversation_repair.repair(rows, present=F.col("present")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_ngram_jaccard, op2_token_counts, op3_backoff_lm, op4_toxicity, op5_quality_fm, op6_line_dedup, op7_decontamination, op8_quality_rules, op9_warc_zip, op10_byte_bpe, op11_simhash, op12_token_alignment, op13_conversation_repair)}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in ORACLES.items() if k in QUERIES}
