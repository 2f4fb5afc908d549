"""Cleans `documents` for training, stage by stage, and encodes what is left.

Toxic texts go; of near-duplicates one stays; texts that hold benchmark windows go; secrets are redacted; the
rest is encoded. Every stage but the last returns the columns of `documents`.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linewright.llm import byte_bpe, decontamination, secret_scan, simhash, toxicity
from linewright.llm.base import new_path, remove, scratch, table
from linewright.llm.queries import RANKS, TOXIC_FROM


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text scores under TOXIC_FROM; the model learns from `labels` outside its held-out fold.

    Null and empty texts have no toxic words and stay; repeated rows share their fate; of an empty table none is left.
    """
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), usable=lambda i: ~toxicity.held_out(i))
    scored = toxicity.score(docs, model, keep=tuple(docs.columns), column="_lw_score")
    return scored.filter(F.col("_lw_score") < TOXIC_FROM).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near-duplicates: that of the smallest id, null last.

    Null, empty and wordless texts are one component; of repeated rows one stays; of an empty table none is left.
    """
    return simhash.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text holds no window of a benchmark item.

    Null and empty texts hold none and stay, as all rows do if the benchmark is empty; repeated rows share their fate.
    """
    items = table(spark, sf_dir, "benchmark")
    found = decontamination.scan_documents(docs, items, keep=tuple(docs.columns), prefix="_lw_")
    return found.filter(~F.col("_lw_contaminated")).select(*docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, repeated ones included, with the secrets in their texts redacted; null texts stay null."""
    return secret_scan.redact(docs)


def encode_bytes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row's text, with their number and digests; null and empty texts have no tokens."""
    return byte_bpe.encode(docs, RANKS, public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", drop_toxic),
    ("SimHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("secret scans", redact_secrets),
    ("byte-level BPE", encode_bytes),
]

#: Models and fingerprints cannot be written as SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each but the last is written to the shared folder and read again.

    A stage's table, and what it wrote on the way, are removed when the next stage's table is written; that of
    the last but one stays for the result to read.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        path = new_path(spark)
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.schema(docs.schema).parquet(path)
        if before is not None:
            remove(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
