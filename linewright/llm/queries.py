"""The queries of this subpackage's operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linewright.llm import byte_bpe, chat_format, decontamination, matroska, quality, repeats, secret_scan, simhash, token_scan, toxicity
from linewright.llm.base import table

#: Rank file of the encoder; any path that the driver can read will do.
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
#: Tokenizer file of the chat formatter.
CHAT_TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")

#: Least score of a text that counts as toxic.
TOXIC_FROM = 0.7


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded bytes of every whole text, as digests. Null and empty texts have no tokens; see byte_bpe.encode."""
    return byte_bpe.encode(table(spark, sf_dir, "documents"), RANKS, public_tokenizers.PATTERN, ids=False)


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every whole text, with those that ownership adds. Null texts are empty; see secret_scan.scan."""
    return secret_scan.scan(table(spark, sf_dir, "documents"))


def op2_separator_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every whole text, counted from flat files. Null and empty texts have none; see token_scan.token_counts."""
    return token_scan.token_counts(table(spark, sf_dir, "documents"), RANKS, public_tokenizers.PATTERN)


def op3_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text as a media file, and what is read back from it. Null texts are empty; see matroska.store and features."""
    return matroska.features(matroska.store(table(spark, sf_dir, "documents")))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one of control strings, formatted and read back. Null texts are empty; see chat_format.format_conversations."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", tricky), (-1, 1, "assistant", tricky)], rows.schema)
    return chat_format.read_back(chat_format.format_conversations(rows.unionByName(extra), CHAT_TOKENIZER))


def _classified(spark: SparkSession, sf_dir: str, kind, least: float) -> DataFrame:
    """A row for each row of documents, repeated ones included; a null id counts as empty text in the fold."""
    docs = table(spark, sf_dir, "documents")
    model = kind.fit(docs, table(spark, sf_dir, "labels"), usable=lambda i: ~kind.held_out(i))
    scored = kind.score(docs, model)
    predicted = F.when(F.col("score") >= least, 1).otherwise(0)
    return scored.select("doc_id", kind.held_out(F.col("doc_id")).alias("held_out"), "score", predicted.alias("predicted"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every whole text, empty ones included, by a model that learns outside the held-out fold; see quality.fit and score."""
    return _classified(spark, sf_dir, quality, 0.3)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every whole text, empty ones included, by a model that learns outside the held-out fold; see toxicity.fit and score."""
    return _classified(spark, sf_dir, toxicity, TOXIC_FROM)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every whole text; null, empty and wordless ones have fingerprint zero. See simhash.near_duplicates."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every whole text without repeated strings of 100 bytes. Null texts are empty; see repeats.remove_repeats."""
    return repeats.remove_repeats(table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in every whole text; null and empty texts have none. See decontamination.scan_documents."""
    return decontamination.scan_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secret_scan": op1_secret_scan,
    "op2_separator_scan": op2_separator_scan,
    "op3_matroska": op3_matroska,
    "op4_chat_format": op4_chat_format,
    "op5_quality": op5_quality,
    "op6_toxicity": op6_toxicity,
    "op7_simhash": op7_simhash,
    "op8_repeats": op8_repeats,
    "op9_decontamination": op9_decontamination,
    "op10_byte_bpe": op10_byte_bpe,
}

ORACLES: dict[str, str] = {
    "op1_secret_scan": secret_scan.SQL,
}
