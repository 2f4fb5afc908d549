"""What an edit breaks: identifiers removed, introduced or unknown, against an index."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linewright.functions import text as T
from linewright.sources.tables import stored

# Names of libraries that an unknown-name test lets pass.
LIBRARIES = ("std", "core", "alloc", "vec", "string", "option", "result", "box", "rc", "arc", "clone", "copy", "debug", "display",
             "fmt", "iter", "into", "from", "os", "sys", "json", "re", "math", "time", "datetime", "pathlib", "typing", "list",
             "dict", "tuple", "set", "str", "int", "float", "bool", "none", "test", "assert", "assert_eq", "assert_ne", "setup",
             "teardown", "before_each", "after_each")


def removed(old: DataFrame, new: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, phrase) of phrases that a text had and its new version has not."""
    return old.select(key, "phrase").join(new.select(key, "phrase"), [key, "phrase"], "left_anti")


def first_others(posts: DataFrame, wanted: DataFrame, most: int, key: str = "doc_id") -> DataFrame:
    """(phrase, holders): the smallest most + 1 keys that hold each wanted phrase; row numbers are limited before the shuffle."""
    rank = F.row_number().over(Window.partitionBy("phrase").orderBy(key))
    held = posts.join(wanted.select("phrase").distinct(), "phrase", "left_semi").select("phrase", key).withColumn("rank", rank)
    return held.filter(F.col("rank") <= most + 1).groupBy("phrase").agg(F.array_sort(F.collect_list(key)).alias("holders"))


def orphan_references(old: DataFrame, new: DataFrame, posts: DataFrame, common: int = 10, most: int = 3, key: str = "doc_id") -> DataFrame:
    """(key, phrase, n_files, examples): removed phrases that other texts still hold, common ones left out."""
    freq = posts.groupBy("phrase").agg(F.count("*").alias("df"))
    gone = removed(old, new, key).join(freq, "phrase").filter(F.col("df") < common)
    own = posts.select(key, "phrase", F.lit(1).alias("own"))
    found = gone.join(own, [key, "phrase"], "left").withColumn("n_files", F.col("df") - F.coalesce("own", F.lit(0))).filter("n_files > 0")
    shown = found.join(first_others(posts, found, most, key), "phrase")
    return shown.select(key, "phrase", "n_files", F.array_join(F.slice(F.filter("holders", lambda h: h != F.col(key)), 1, most), ",").alias("examples"))


def missing_definitions(old: DataFrame, new: DataFrame, definitions: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, phrase, n_files): introduced phrases that other texts define."""
    fresh = removed(new, old, key)
    defined = definitions.select("phrase", F.col(key).alias("_lw_in")).distinct()
    return fresh.join(defined, "phrase").filter(F.col("_lw_in") != F.col(key)).groupBy(key, "phrase").agg(F.count("*").alias("n_files"))


def validated(
    definitions: DataFrame, posts: DataFrame, top: int = 5, most: int = 3, key: str = "doc_id",
    keep: Callable[[Column], Column] = T.interesting,
) -> DataFrame:
    """(key, phrase, n_files, examples, rank): of each text's own definitions, those that most other texts hold.

    The postings are read three times, so they are made once.
    """
    posts = stored(posts.select(key, "phrase"))
    own = definitions.select(key, "phrase").distinct().filter(keep(F.col("phrase")) & ~F.col("phrase").rlike(r"^[\p{Lu}_]+\z"))
    freq = posts.groupBy("phrase").agg(F.count("*").alias("df"))
    held = posts.select(key, "phrase", F.lit(1).alias("own"))
    counted = own.join(freq, "phrase").join(held, [key, "phrase"], "left").withColumn("n_files", F.col("df") - F.coalesce("own", F.lit(0)))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n_files"), "phrase"))
    best = counted.filter("n_files > 0").withColumn("rank", rank).filter(F.col("rank") <= top)
    shown = best.join(first_others(posts, best, most, key), "phrase")
    return shown.select(key, "phrase", "n_files", "rank", F.array_join(F.slice(F.filter("holders", lambda h: h != F.col(key)), 1, most), ",").alias("examples"))


def unknown_names(names: DataFrame, phrases: DataFrame, libraries: tuple[str, ...] = LIBRARIES) -> DataFrame:
    """Distinct names (column name) that no phrase contains and no library has.

    A phrase that contains a name has the name's first three characters among its trigrams: an equi-join on
    them finds the candidates, so no name meets every phrase.
    """
    asked = names.select("name").distinct().filter((F.octet_length("name") > 2) & ~F.col("name").isin(*libraries))
    keyed = asked.withColumn("gram", F.substring("name", 1, 3))
    grams = phrases.select("phrase").distinct().select("phrase", F.explode(F.array_distinct(T.trigrams(F.col("phrase")))).alias("gram"))
    known = keyed.join(grams, "gram").filter(F.contains("phrase", "name")).select("name").distinct()
    return asked.join(known, "name", "left_anti")


def annotate(messages: DataFrame, failing: DataFrame, content: str = "text", keys: tuple[str, ...] = ("conv_id", "turn")) -> DataFrame:
    """keys and the text with a note behind the first mention of a file that failed before with a name the text has.

    `failing` has (file, identifier). Texts meet it by the pieces they are made of; the first pair in order
    that changes a text is the one noted.
    """
    pieces = messages.select(*keys, F.explode(F.array_distinct(T.pieces(F.col(content)))).alias("identifier"))
    pairs = pieces.join(failing.select("file", "identifier").distinct(), "identifier").join(messages.select(*keys, content), list(keys))
    hit = pairs.filter(F.contains(content, "file")).groupBy(*keys).agg(F.min(F.struct("file", "identifier")).alias("p"))
    noted = messages.select(*keys, content).join(hit, list(keys))
    place = F.instr(content, F.col("p.file"))
    size = F.length("p.file")
    body = F.concat(F.substring(content, F.lit(1), place + size - 1), F.lit(" /* -"), F.col("p.identifier"), F.lit("/**/"),
                    F.substring(content, place + size, F.length(content)))
    return noted.select(*keys, body.alias("text"))
