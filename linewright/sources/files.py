"""Readers of files and folders, and writers."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linewright.sources.tables import kept

# Endings of files that are indexed, those that are searched for dead names, and folders passed over.
INDEXED = ("rs", "py", "js", "ts", "tsx", "jsx", "go", "rb", "c", "cpp", "h", "hpp", "sh", "toml", "yaml", "yml", "json", "md")
SEARCHED = ("rs", "py", "js", "ts", "go", "java", "rb", "c", "cpp", "h", "hpp", "sh", "toml", "yaml", "yml", "json", "md")
IGNORED = (".git", "node_modules", "target", "__pycache__", ".venv", ".cargo", ".rustup", ".npm", ".cache", ".local", "venv", ".next",
           "dist", "build", "vendor", "bundle", ".bundle")
MOST_BYTES = 10_000_000


def wanted(path: Column, endings: Iterable[str] = INDEXED, ignored: Iterable[str] = IGNORED) -> Column:
    """Whether a path ends as it should and no part of it is hidden or ignored."""
    ending = F.regexp_extract(path, r"\.([A-Za-z0-9]+)\z", 1).isin(*endings)
    parts = F.split(F.regexp_replace(path, r"^[a-z]+:/*", ""), "/")
    hidden = F.exists(parts, lambda p: (p.startswith(".") & (p != ".")) | p.isin(*ignored))
    return ending & ~hidden


def read_folder(spark: SparkSession, folder: str, endings: Iterable[str] = INDEXED, after: str | None = None, most: int = MOST_BYTES) -> DataFrame:
    """(path, modified, size, text) of the text files under a folder; larger files and those that are no UTF-8 are left out.

    `after`, a time, keeps those modified since.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    reader = reader.option("modifiedAfter", after) if after else reader
    rel = F.substring("path", F.instr("path", F.lit(folder.rstrip("/"))) + len(folder.rstrip("/")), F.length("path"))
    files = reader.load(folder).filter((F.col("length") <= most) & wanted(rel, endings))
    text = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string"))
    return files.select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("size"), text.alias("text")).filter("text is not null")


LOG_SCHEMA = "event string, auth_prefix string, prompt_tokens long, completion_tokens long, savings_pct double, history_saved long, response_compressed boolean, timestamp long"


def log_events(lines: DataFrame) -> DataFrame:
    """Events of lines (value) of a proxy log, one JSON object a line; lines that are none are left out."""
    return lines.select(F.from_json("value", LOG_SCHEMA).alias("e")).select("e.*").filter(F.col("event").isin("stream_usage", "proxy_response"))


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return log_events(spark.read.text(path))


def tail_log(spark: SparkSession, folder: str) -> DataFrame:
    """The events of a folder's log files as a stream: what is there, and files as they come."""
    return log_events(spark.readStream.text(folder))


def _first_rows(rows: DataFrame, most: int) -> DataFrame:
    """The first rows in order of their files."""
    return rows.withColumn("_lw_at", F.monotonically_increasing_id()).orderBy("_lw_at").limit(most).drop("_lw_at")


def read_questions(spark: SparkSession, path: str, most: int = 100) -> DataFrame:
    """(context, question, expected, unanswerable) of a question set in JSON lines with `answers.text`: half with answers, half without."""
    rows = spark.read.schema("context string, question string, answers struct<text: array<string>>").json(path)
    answer = F.get("answers.text", F.lit(0))
    made = rows.select("context", "question", answer.alias("expected"), (F.coalesce(F.size("answers.text"), F.lit(0)) <= 0).alias("unanswerable"))
    return _first_rows(made.filter("not unanswerable"), most // 2).unionByName(_first_rows(made.filter("unanswerable"), most - most // 2))


def read_calls(spark: SparkSession, path: str, most: int = 100) -> DataFrame:
    """(query, tools, expected) of a set of tool calls in JSON lines: the first human turn, and the calls of the first reply.

    Turns are (from, value), calls JSON objects between tags in a reply. Samples without tools, query or calls are left out.
    """
    rows = spark.read.schema("tools string, conversations array<struct<from: string, value: string>>").json(path)
    first = lambda who: F.get(F.filter("conversations", lambda c: c["from"] == who), F.lit(0))["value"]
    bodies = F.regexp_extract_all(first("gpt"), F.lit(r"(?s)<tool_call>\s*(.*?)\s*</tool_call>"), F.lit(1))
    calls = F.transform(bodies, lambda b: F.struct(F.get_json_object(b, "$.name").alias("name"), F.get_json_object(b, "$.arguments").alias("arguments")))
    made = rows.select(first("human").alias("query"), "tools", F.filter(calls, lambda c: c["name"].isNotNull()).alias("expected"))
    return _first_rows(made.filter((F.coalesce("query", F.lit("")) != "") & (F.size("expected") > 0) & (F.get_json_object("tools", "$[0]").isNotNull())), most)


def read_memories(spark: SparkSession, path: str) -> DataFrame:
    """A table of memories in order of id, with the columns that are not stored."""
    return spark.read.parquet(path).withColumn("error_flag", F.lit(0)).withColumn("entropy", F.lit(0.0))


def write_index(posts: DataFrame, path: str, files: int = 16) -> None:
    """Postings in files sorted by phrase, so a phrase's row groups are found by their statistics."""
    posts.repartitionByRange(files, "phrase").sortWithinPartitions("phrase").write.mode("overwrite").parquet(path)


def append_events(log: DataFrame, path: str) -> None:
    """Events by kind of event, so that questions about one kind read its folder alone."""
    log.write.mode("append").partitionBy("event").parquet(path)


def write_jsonl(rows: DataFrame, path: str, most: int = 100_000) -> None:
    """Rows as JSON lines, at most so many a file."""
    rows.write.mode("append").option("maxRecordsPerFile", most).json(path)


def upsert(old: DataFrame, new: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """old with new's rows in place of those of equal keys."""
    return old.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new)


def replace_memories(memories: DataFrame, path: str) -> None:
    """All memories anew, with ids in order of time: ranges of time are numbered apart and moved up by those before."""
    ranges = memories.repartitionByRange("ts", "content").sortWithinPartitions("ts", "content")
    numbered = kept(ranges.withColumn("_lw_part", F.spark_partition_id()).withColumn("_lw_k", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)))
    counts = numbered.groupBy("_lw_part").agg(F.count("*").alias("n"))  # a row for each partition
    before = F.coalesce(F.sum("n").over(Window.orderBy("_lw_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    moved = numbered.join(F.broadcast(counts.select("_lw_part", before.alias("_lw_before"))), "_lw_part")
    moved.withColumn("id", F.col("_lw_before") + F.col("_lw_k") + 1).drop("_lw_part", "_lw_k", "_lw_before").write.mode("overwrite").parquet(path)


def rendered(lines: Column, label: str, form: str = "default") -> Column:
    """An array of lines as JSON, as lines, or under a label."""
    if form == "json":
        return F.to_json(lines)
    if form == "compact":
        return F.array_join(lines, "\n")
    return F.when(F.size(lines) == 0, F.lit(f"{label}: (none)")).otherwise(F.concat(F.lit(f"{label}:\n  "), F.array_join(lines, "\n  ")))


def fits(text: Column, most: int = MOST_BYTES) -> Column:
    return F.octet_length(text) <= most
