"""From texts to rows of lines, and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linewright.functions import text as T


def explode_lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line_no, line) of every line, numbered from 0. An empty or null text has none."""
    return df.select(key, F.posexplode(T.lines(F.col(text))).alias("line_no", "line"))


def explode_stems(rows: DataFrame, line: str, *columns: str) -> DataFrame:
    """(columns, phrase): a row for each stem of T.stems(line). Words are rows before they are stemmed, which is compiled then."""
    cut = rows.select(*columns, F.explode(F.split(T.text_of(F.col(line)), T.TOKEN_SPLIT)).alias("_lw_word"))
    words = cut.filter(F.col("_lw_word").rlike(rf"^{T.IDENTIFIER}\z")).select(*columns, F.lower("_lw_word").alias("_lw_word"))
    return words.select(*columns, T.stem_of(F.col("_lw_word")).alias("phrase"))


def join_lines(rows: DataFrame, key: str, out: str, order: str = "line_no", name: str = "text", end: str = "") -> DataFrame:
    """Rows of a key joined in order by line feeds; null rows are left out."""
    pairs = F.array_sort(F.collect_list(F.when(F.col(out).isNotNull(), F.struct(F.col(order).alias("k"), F.col(out).alias("v")))))
    joined = F.array_join(F.transform(pairs, lambda p: p["v"]), "\n")
    return rows.groupBy(key).agg((F.concat(joined, F.lit(end)) if end else joined).alias(name))


def islands(rows: DataFrame, key: str, changed: Column, order: str = "line_no", name: str = "run") -> DataFrame:
    """rows with the number of the run they belong to; `changed` says that a row begins one."""
    w = Window.partitionBy(key).orderBy(order)
    return rows.withColumn(name, F.sum(changed.cast("int")).over(w))


def differs(c: str, key: str, order: str = "line_no") -> Column:
    """Whether a value differs from that of the row before; true for the first row."""
    w = Window.partitionBy(key).orderBy(order)
    return ~F.col(c).eqNullSafe(F.lag(c).over(w)) | (F.row_number().over(w) == 1)
