"""Separator scan over flat token files (operator 2).

A flat file is token ids end to end, an end-of-document id behind each document, and no index. It is read by
byte ranges; each is searched for the id with one vectorised comparison, and a prefix scan over the ranges of a
file stitches documents that cross their edges.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linewright.llm.base import cut, new_path, slices, texts_of, written
from linewright.llm.byte_bpe import _encoder, read_ranks

#: Bytes of a range, a multiple of any id's size; bytes that a writer holds before it writes them.
RANGE, HELD = 1 << 20, 4 << 20


class Flat(NamedTuple):
    """How ids are kept: the end-of-document id and the type of an id."""

    separator: int
    kind: str


def flat_of(vocabulary: str) -> Flat:
    """The first id behind those of a rank file, and the narrowest type that holds it."""
    with open(vocabulary, "rb") as f:
        separator = max(read_ranks(f.read()).values()) + 1
    return Flat(separator, "<u2" if separator < 1 << 16 else "<u4")


def write_flat(
    docs: DataFrame, folder: str, vocabulary: str, pattern: str, id_col: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Write every input split's whole texts as one flat file in `folder`; (file, first, ids) tells what went in.

    `ids` are some documents of a file, in order, the first of which is number `first` of it. They are a table
    written by the same tasks, so files of tasks that failed or ran twice are not in it. Null and empty texts are
    a separator alone, bytes that are no UTF-8 are read as U+FFFD, repeated rows are repeated, and an empty table
    has no files. `folder` may be of any file system that Arrow opens.
    """
    flat = flat_of(vocabulary)
    with open(vocabulary, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task = _encoder(shared.value, pattern).encode, TaskContext.get()
        name, first, out, held, size = f"part-{task.partitionId():06}-{task.taskAttemptId()}", 0, None, [], 0
        try:
            for batch in slices(batches):
                if out is None:
                    at, root = fs.FileSystem.from_uri(folder)
                    at.create_dir(root, recursive=True)
                    out = at.open_output_stream(f"{root}/{name}")
                for t in texts_of(batch.column(1)):
                    held.append(np.array([*encode(t.decode("utf-8", "replace")), flat.separator], flat.kind))
                    size += held[-1].nbytes
                    if size >= HELD:
                        out.write(np.concatenate(held))
                        held, size = [], 0
                n = batch.num_rows
                ids = pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), batch.column(0))
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([first], pa.int64()), ids], names=["file", "first", "ids"])
                first += n
            if held:
                out.write(np.concatenate(held))
        finally:
            if out is not None:
                out.close()

    return written(docs.select(id_col, text).mapInArrow(run, f"file string, first long, ids array<{kind}>"))


def files_in(spark: SparkSession, folder: str) -> DataFrame:
    """(file, size) of the files of a folder."""
    found = spark.read.format("binaryFile").load(folder).select("path", "length")
    return found.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("size"))


def scan(files: DataFrame, folder: str, flat: Flat, range_bytes: int | None = None) -> DataFrame:
    """(file, ordinal, n_tokens) of each document of some flat files (file, size), by its separator.

    Documents count from 0 in a file; ids behind the last separator of a file belong to no document, and files
    without bytes have none. A range is read by one task, whatever the size of its file; the prefix scan has one
    small row for each range.
    """
    step = range_bytes or RANGE
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(step).cast("long")))
    ranges = files.filter("size > 0").select("file", "size", starts.alias("at")).repartition("file", "at")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, root = fs.FileSystem.from_uri(folder)
        for batch in slices(batches):
            for file, size, begin in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                with at.open_input_file(f"{root}/{file}") as f:
                    ids = np.frombuffer(f.read_at(min(step, size - begin), begin), flat.kind)
                ends = np.flatnonzero(ids == flat.separator)
                counts = np.diff(ends, prepend=-1) - 1
                tail = len(ids) - 1 - int(ends[-1]) if len(ends) else len(ids)
                lists = pa.ListArray.from_arrays(pa.array([0, len(counts)], pa.int32()), pa.array(counts, pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([begin], pa.int64()), lists, pa.array([tail], pa.int64())],
                                                 names=["file", "at", "counts", "tail"])

    found = cut(ranges.mapInArrow(run, "file string, at long, counts array<long>, tail long"))
    w = Window.partitionBy("file").orderBy("at")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    sums = found.select("file", "at", F.size("counts").alias("n"), "tail").withColumn("cum", F.sum("tail").over(w))
    # ids since the last separator of an earlier range
    since = F.coalesce(F.last(F.when(F.col("n") > 0, F.col("cum") - F.col("tail")), True).over(before), F.lit(0))
    stitched = sums.select("file", "at", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"),
                           (F.coalesce(F.lag("cum").over(w), F.lit(0)) - since).alias("carry"))
    each = found.join(stitched, ["file", "at"]).select("file", "first", "carry", F.posexplode("counts").alias("k", "n"))
    return each.select("file", (F.col("first") + F.col("k")).alias("ordinal"),
                       (F.col("n") + F.when(F.col("k") == 0, F.col("carry")).otherwise(0)).alias("n_tokens"))


def token_counts(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_tokens, file, ordinal) of every row, counted from flat files by their separators alone.

    The files go to the shared folder. Nulls, repeated rows and empty tables: see write_flat; other columns are
    not read.
    """
    spark, flat = docs.sparkSession, flat_of(vocabulary)
    folder = new_path(spark)
    told = write_flat(docs, folder, vocabulary, pattern, id_col, text)
    if told.isEmpty():
        return told.select(F.lit(None).cast(docs.schema[id_col].dataType).alias(id_col), F.lit(0).cast("long").alias("n_tokens"),
                           "file", F.col("first").alias("ordinal"))
    whole = files_in(spark, folder).join(told.select("file").distinct(), "file", "left_semi")
    names = told.select("file", "first", F.posexplode("ids").alias("k", id_col))
    numbered = names.select("file", (F.col("first") + F.col("k")).alias("ordinal"), id_col)
    return scan(whole, folder, flat).join(numbered, ["file", "ordinal"]).select(id_col, "n_tokens", "file", "ordinal")
