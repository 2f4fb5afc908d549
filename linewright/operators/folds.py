"""Folds over a key's rows in order, for rules in which each row depends on what the one before led to.

Rows are dealt by key and sorted by Spark, which spills; a worker holds one batch and one state, so a key may have
any number of rows. A key's rows are one task's, as the rule asks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def ordered_fold(rows: DataFrame, key: str, order: tuple[str, ...], columns: tuple[str, ...], made: str, start: Callable, step: Callable) -> DataFrame:
    """rows (key, order, columns) with the columns `made` (DDL) that step(state, values of columns) gives.

    `start` makes a key's first state; step gives the next state and a tuple. Null keys are one key; repeated rows
    are taken one after the other; an empty table gives none.
    """
    added = StructType.fromDDL(made)
    names = list(dict.fromkeys((key, *order, *columns)))
    source = rows.select(*names)
    schema = StructType([*source.schema.fields, *added.fields])
    kinds = [f.type for f in to_arrow_schema(added)]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = object(), None
        for batch in batches:
            if not batch.num_rows:
                continue
            out = []
            values = zip(*(batch.column(names.index(c)).to_pylist() for c in columns), strict=True)
            for k, row in zip(batch.column(0).to_pylist(), values, strict=True):
                if k != now:
                    now, state = k, start()
                state, said = step(state, *row)
                out.append(said)
            made_columns = [pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made_columns], names=schema.names)

    return source.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, schema)
