"""Inverted index over texts: postings, statistics, ranking and incremental renewal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linewright.functions import classify as C
from linewright.functions import text as T
from linewright.operators.lines import explode_lines, explode_stems

K1, B = 1.2, 0.75


def postings(docs: DataFrame, key: str = "doc_id", text: str = "text", defines: Callable[[Column], Column] = C.is_index_definition) -> DataFrame:
    """(key, phrase, is_def, zone, occ, first_line): one row for each stem of each text.

    zone is 1 only if every line that holds the stem is prose. The texts, smaller than their postings, are
    dealt by key once; postings and the statistics of a text then need no further shuffle.
    """
    rows = explode_lines(docs.select(key, text).repartition(key), key, text)
    # classes are computed a line at a time, below the explode
    classed = rows.select(key, "line_no", "line", C.zone(F.col("line")).alias("zone"), defines(F.col("line")).cast("int").alias("is_def"))
    each = explode_stems(classed, "line", key, "line_no", "zone", "is_def")
    return each.groupBy(key, "phrase").agg(
        F.max("is_def").alias("is_def"), F.floor(F.sum("zone") / F.count("*")).cast("int").alias("zone"),
        F.count("*").alias("occ"), F.min("line_no").alias("first_line"))


def doc_stats(docs: DataFrame, posts: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, token_len, content_len): distinct stems and bytes of the texts that have stems."""
    lengths = posts.groupBy(key).agg(F.count("*").alias("token_len"))
    return lengths.join(docs.select(key, F.octet_length(T.text_of(F.col(text))).cast("long").alias("content_len")), key)


def doc_freq(posts: DataFrame) -> DataFrame:
    return posts.groupBy("phrase").agg(F.count("*").alias("df"))


def index_stats(posts: DataFrame, key: str = "doc_id") -> DataFrame:
    return posts.agg(F.count_distinct(key).alias("files"), F.count_distinct("phrase").alias("phrases"), F.count("*").alias("occurrences"))


def query_terms(query: str) -> list[str]:
    """Searchable parts of a query: words of two bytes or more, without marks; parts under three characters match nothing."""
    kept = ("".join(c for c in w if c.isalnum() or c in "_-") for w in query.split() if len(w.encode()) >= 2)
    return sorted({w.lower() for w in kept if len(w) >= 3})


def idf(n: Column, df: Column) -> Column:
    return F.log((n - df + 0.5) / (df + 0.5) + 1.0)


def bm25(weight: Column, tf: Column, length: Column, mean: Column) -> Column:
    t = F.log(F.lit(1.0) + tf)
    return weight * (t * (K1 + 1.0)) / (t + K1 * (1.0 - B + B * length / mean))


def search(posts: DataFrame, stats: DataFrame, query: str, most: int = 10, key: str = "doc_id", tf: str | None = None) -> DataFrame:
    """(key, score, line, zone) of the best texts for a query; ties go to the smaller key.

    A term matches every stem that contains it. Each text counts with its best stem, and of equal ones with
    the first in order. tf is 1 unless a column of counts is named.
    """
    terms = query_terms(query)
    hit = F.lit(False)
    for t in terms:
        hit = hit | F.contains("phrase", F.lit(t))
    matched = posts.filter(hit)
    corpus = stats.agg(F.count("*").cast("double").alias("n"), F.avg("token_len").alias("mean"))
    freq = doc_freq(matched)
    counts = F.col(tf).cast("double") if tf else F.lit(1.0)
    scored = (
        matched.join(freq, "phrase").join(stats.select(key, "token_len"), key, "left").crossJoin(F.broadcast(corpus))
        .withColumn("score", bm25(idf(F.col("n"), F.col("df")), counts, F.coalesce("token_len", F.lit(50)), F.coalesce("mean", F.lit(1.0))))
    )
    best = scored.groupBy(key).agg(F.min_by(F.struct("score", "first_line", "zone"), F.struct((-F.col("score")).alias("s"), "phrase")).alias("b"))
    flat = best.select(key, F.round("b.score", 6).alias("score"), F.col("b.first_line").alias("line"), F.col("b.zone").alias("zone"))
    return flat.orderBy(F.desc("score"), key).limit(most)


def references(posts: DataFrame, identifier: str, exclude, most: int = 20, key: str = "doc_id") -> DataFrame:
    """(key, n) of the other texts that hold an identifier's stem."""
    found = posts.filter((F.col("phrase") == T.stem(F.lit(identifier.lower()))) & (F.col(key) != exclude))
    return found.groupBy(key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), key).limit(most)


def pack(is_def: Column, zone: Column, occ: Column, line: Column) -> tuple[Column, Column]:
    """One byte of flags (definition, zone, count up to 30, else 31) and the line in 16 bits."""
    count = F.when(occ <= 30, occ).otherwise(31).cast("int")
    flags = (is_def + 1).bitwiseAND(3).bitwiseOR(F.shiftleft(zone.bitwiseAND(1), 2)).bitwiseOR(F.shiftleft(count, 3))
    return flags.cast("int"), line.cast("int").bitwiseAND(65535)


def unpack(flags: Column) -> tuple[Column, Column, Column]:
    return flags.bitwiseAND(3) - 1, F.shiftright(flags, 2).bitwiseAND(1), F.shiftright(flags, 3)


def line_scores(docs: DataFrame, freq: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, line_no, line, info): mean log of one more than the document frequency of a line's identifiers; 0 without any.

    Low scores are surprising lines.
    """
    rows = explode_lines(docs.select(key, text).repartition(key), key, text)
    each = rows.select(key, "line_no", F.explode(T.stems(F.col("line"))).alias("phrase"))
    per = each.groupBy(key, "line_no", "phrase").agg(F.count("*").alias("k")).join(freq, "phrase", "left")
    info = per.groupBy(key, "line_no").agg((F.sum(F.col("k") * F.log1p(F.coalesce("df", F.lit(0)))) / F.sum("k")).alias("info"))
    return rows.join(info, [key, "line_no"], "left").withColumn("info", F.coalesce("info", F.lit(0.0)))


def compress_weighted(
    scored: DataFrame, shorten: Callable[[Column, Column], Column], key: str = "doc_id", below: float = 1.6, most: float = 0.7
) -> DataFrame:
    """(key, text): surprising and blank lines as they are, runs of others through shorten(text, number of lines).

    null if more than `most` of the lines are kept. A last run stands after an empty line.
    """
    kept = C.is_blank(F.col("line")) | (F.col("info") < below)
    w = Window.partitionBy(key).orderBy("line_no")
    rows = scored.withColumn("kept", kept).withColumn("new", F.col("kept") | F.coalesce(F.lag("kept").over(w), F.lit(True)))
    rows = rows.withColumn("run", F.sum(F.col("new").cast("int")).over(w))
    share = rows.groupBy(key).agg(F.avg(F.col("kept").cast("double")).alias("share"), F.max("run").alias("last"))
    runs = rows.groupBy(key, "run").agg(
        F.first("kept").alias("kept"), F.count("*").alias("n"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("body"))
    short = T.trim_end(shorten(F.col("body"), F.col("n")))
    piece = F.when(F.col("kept"), F.concat("body", F.lit("\n"))).when(short == "", "").when(
        F.col("run") == F.col("last"), F.concat(F.lit("\n"), short)).otherwise(F.concat(short, F.lit("\n")))
    pieces = runs.join(share, key).withColumn("piece", piece)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("run", "piece"))), lambda x: x["piece"]), "")
    return pieces.groupBy(key).agg(F.when(F.first("share") <= most, joined).alias("text"))


def renew(old: DataFrame, changed: DataFrame, key: str = "doc_id") -> DataFrame:
    """Postings with those of changed texts replaced by `changed`'s; `changed` holds new postings of whole texts."""
    return old.join(changed.select(key).distinct(), key, "left_anti").unionByName(changed)


def path_candidates(path: Column, root: str) -> Column:
    """Forms under which an index may hold a path: relative to the root, without a leading crates folder, and as it is."""
    rel = F.regexp_replace(F.substring(path, F.lit(len(root) + 2), F.length(path)), "^/+", "")
    inner = F.when(rel.startswith("crates/"), F.array(rel, F.substring(rel, F.lit(8), F.length(rel)))).otherwise(F.array(rel))
    return F.when(path.startswith(root), F.concat(inner, F.array(path))).otherwise(F.array(path))
