"""What the operators of this subpackage share."""

from __future__ import annotations

import sys
import types
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that a worker handles at once; the bytes of a whole Arrow batch are bounded by Spark.
BATCH_ROWS = 512
#: A key with more than one in so many rows is hot; there are fewer hot keys than this.
HOT = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches cut into pieces of BATCH_ROWS rows; pieces without rows are left out."""
    for batch in batches:
        for at in range(0, batch.num_rows, BATCH_ROWS):
            yield batch.slice(at, BATCH_ROWS)


def worker_cache(key: object, make: Callable[[], object], most: int = 4) -> object:
    """One object per Python worker and key; tasks that reuse the worker share it. The `most` latest are held."""
    held = sys.modules.setdefault("_linewright_worker", types.ModuleType("_linewright_worker")).__dict__.setdefault("held", {})
    if key in held:
        held[key] = held.pop(key)
    else:
        while len(held) >= most:
            del held[next(iter(held))]
        held[key] = make()
    return held[key]


class Memo:
    """Results of a function by key (bytes or text), emptied when what it holds reaches `most` bytes, about."""

    def __init__(self, most: int = 64 << 20) -> None:
        self.held: dict = {}
        self.size, self.most = 0, most

    def get(self, key, make: Callable):
        found = self.held.get(key)
        return self.put(key, make(key)) if found is None else found

    def put(self, key, value):
        self.size += 200 + len(key) + 36 * len(value)
        if self.size > self.most:
            self.held.clear()
            self.size = 0
        else:
            self.held[key] = value
        return value


def texts_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null counts as empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def map_rows(
    df: DataFrame, text_col: str, schema: str, make: Callable[[], Callable[[bytes], tuple]], keep: list[str]
) -> DataFrame:
    """Columns `keep` of df beside what make()'s function returns for each row's text as UTF-8 bytes.

    `schema` is the DDL of the function's tuple. No shuffle; memory is bounded by one Arrow batch.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    added = StructType.fromDDL(schema)
    arrow = [f.type for f in to_arrow_schema(added)]
    source = df.select(*[df[c] for c in keep], df[text_col].alias("_lw_text"))
    full = StructType([*[df.schema[c] for c in keep], *added.fields])
    names = full.names

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = None
        for batch in slices(batches):
            work = work or make()
            columns = list(zip(*[work(t) for t in texts_of(batch.column(len(keep)))], strict=True))
            made = [pa.array(list(c), type=t) for c, t in zip(columns, arrow, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *made], names=names)

    return source.mapInArrow(run, full)


def join_groups(rows: DataFrame, groups: DataFrame, key: str, count: str) -> DataFrame:
    """rows beside the row of `groups` that has their key; null keys have none.

    `groups` has each key of rows once, with the number of its rows in column `count`, which is left out. Keys
    of more than one in HOT rows are broadcast, fewer than HOT of them whatever the data; only the rows of other
    keys are dealt by key. `rows` is evaluated twice and should be cheap, as a checkpoint is.
    """
    total = groups.agg(F.sum(count)).scalar()
    others = [c for c in groups.columns if c not in (key, count)]
    hot = groups.filter(F.col(count) * HOT > total).select(key, F.struct(*others).alias("_lw_group"))
    marked = rows.join(F.broadcast(hot), key, "left")
    own = [F.col(c) for c in rows.columns]
    near = marked.filter("_lw_group is not null").select(*own, *[F.col("_lw_group")[c].alias(c) for c in others])
    far = marked.filter("_lw_group is null").select(*own).join(groups.select(key, *others), key)
    return near.unionByName(far)


def shared_folder(spark: SparkSession) -> str:
    """This application's folder where spark.checkpoint.dir points; under the warehouse where that is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_linewright"
    return f"{named.rstrip('/')}/linewright-{spark.sparkContext.applicationId}"


def cut(df: DataFrame) -> DataFrame:
    """A checkpoint of df. Spark removes it when nothing refers to it, if its cleaner is told to clean checkpoints."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


_scopes: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that written() makes inside are removed at the end; what is read from them must be done by then."""
    made: list[str] = []
    _scopes.append(made)
    try:
        yield
    finally:
        _scopes.remove(made)
        for path in made:
            remove(spark, path)


def new_path(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a file or folder wherever Spark's file systems keep it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def written(df: DataFrame) -> DataFrame:
    """df as a table written to the shared folder and read again: columns are packed, and lineage ends there.

    The table stays until the scratch() around the call ends, or as long as the application's folder.
    """
    path = new_path(df.sparkSession)
    df.write.parquet(path)
    if _scopes:
        _scopes[-1].append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
