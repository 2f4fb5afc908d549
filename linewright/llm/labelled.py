"""Bounded samples of labelled documents for the classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(doc_id: Column, folds: int) -> Column:
    """Remainder of the CRC-32 of an id as text; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def drawn(ids: DataFrame, id_col: str, most: int) -> DataFrame:
    """At most `most` rows, those least by a hash of the id and then the id: the same rows in every run."""
    return ids.orderBy(F.xxhash64(id_col), id_col).limit(most)


def with_texts(sample: DataFrame, docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """A bounded sample (column _lw_id, each id once, and others) beside the texts of its documents.

    One row for an id, however often it is repeated: of its texts the least, null as empty. The sample is
    broadcast: its size is bounded by drawn(), so only the sample's texts are shuffled.
    """
    texts = docs.select(docs[doc_id].alias("_lw_id"), F.coalesce(docs[text], F.lit("")).alias("_lw_text"))
    others = [c for c in sample.columns if c != "_lw_id"]
    found = texts.join(F.broadcast(sample), "_lw_id")
    return found.groupBy("_lw_id", *others).agg(F.min("_lw_text").alias("_lw_text"))


def labels_by_id(labels: DataFrame, label_id: str, label: str) -> DataFrame:
    """_lw_id and _lw_label: a row for each labelled id; of contrary labels for one id the lower counts."""
    return (
        labels.select(labels[label_id].alias("_lw_id"), labels[label].cast("int").alias("_lw_label"))
        .filter("_lw_id is not null and _lw_label is not null")
        .groupBy("_lw_id").agg(F.min("_lw_label").alias("_lw_label"))
    )
