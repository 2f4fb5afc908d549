"""Cleaning of conversations: rows (conv_id, turn, role, text), each step a frame to a frame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linewright.operators import compress

TOOL_ROLES = ("tool", "toolResult")


def of(key: str = "conv_id") -> Window:
    return Window.partitionBy(key).orderBy("turn")


def normalise_roles(rows: DataFrame) -> DataFrame:
    return rows.withColumn("role", F.when(F.col("role").isin("developer", "latest_reminder"), "system").otherwise(F.col("role")))


def drop_empty_replies(rows: DataFrame, key: str = "conv_id") -> DataFrame:
    """Assistant rows without text go, unless they are last or call tools."""
    calls = F.size("tool_calls") > 0 if "tool_calls" in rows.columns else F.lit(False)
    empty = (F.col("role") == "assistant") & (F.coalesce("text", F.lit("")) == "") & ~F.coalesce(calls, F.lit(False))
    last = F.lead("turn").over(of(key)).isNull()
    return rows.withColumn("_lw_gone", empty & ~last).filter("not _lw_gone").drop("_lw_gone")


def user_turns(rows: DataFrame, key: str = "conv_id", name: str = "user_turns") -> DataFrame:
    """With the number of user rows up to each row."""
    count = F.sum((F.col("role") == "user").cast("int")).over(of(key).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn(name, count)


def collapse_old_results(rows: DataFrame, after: int = 8, over: int = 100, roles: tuple[str, ...] = TOOL_ROLES, key: str = "conv_id") -> DataFrame:
    """Tool results of over `over` bytes that come after more than `after` user turns become a line."""
    old = F.col("role").isin(*roles) & (F.col("_lw_turns") > after) & (F.octet_length("text") > over)
    note = F.concat(F.lit("[tool result: "), F.octet_length("text").cast("string"), F.lit(" chars — collapsed]"))
    return user_turns(rows, key, "_lw_turns").withColumn("text", F.when(old, note).otherwise(F.col("text"))).drop("_lw_turns")


def minify_results(rows: DataFrame, roles: tuple[str, ...] = TOOL_ROLES) -> DataFrame:
    return rows.withColumn("text", F.when(F.col("role").isin(*roles), compress.minify_json(F.col("text"))).otherwise(F.col("text")))


def drop_repeats(rows: DataFrame, roles: tuple[str, ...] = TOOL_ROLES, key: str = "conv_id") -> DataFrame:
    """Of rows of equal role and text the first; empty ones and tool results all stay."""
    rank = F.row_number().over(Window.partitionBy(key, "role", "text").orderBy("turn"))
    free = F.col("role").isin(*roles) | (F.coalesce("text", F.lit("")) == "") | (F.coalesce("role", F.lit("")) == "")
    return rows.withColumn("_lw_rank", rank).filter(free | (F.col("_lw_rank") == 1)).drop("_lw_rank")


def strip_system(rows: DataFrame, key: str = "conv_id") -> DataFrame:
    """From two user turns on, a first system row's text becomes a marker."""
    users = F.sum((F.col("role") == "user").cast("int")).over(Window.partitionBy(key))
    first = F.lag("turn").over(of(key)).isNull()
    cached = (F.col("role") == "system") & first & (users >= 2)
    return rows.withColumn("_lw_cached", cached).withColumn(
        "text", F.when(F.col("_lw_cached"), "[system prompt cached]").otherwise(F.col("text"))).drop("_lw_cached")


def drop_reused_calls(rows: DataFrame, key: str = "conv_id") -> DataFrame:
    """Rows with tool_calls (array of struct with id) and tool_call_id: calls whose id an earlier row made go.

    Each id belongs to the first assistant row that makes it. Results directly behind a row that lost calls
    go if they answer one of those.
    """
    calls = rows.filter("size(tool_calls) > 0").select(key, "turn", F.explode("tool_calls").alias("c")).select(key, "turn", F.col("c.id").alias("id"))
    owner = calls.groupBy(key, "id").agg(F.min("turn").alias("owner"))
    lost = calls.join(owner, [key, "id"]).filter("turn > owner").groupBy(key, "turn").agg(F.collect_set("id").alias("_lw_lost"))
    marked = rows.join(lost, [key, "turn"], "left")
    block = F.last(F.when(F.col("role") != "tool", F.coalesce("_lw_lost", F.array().cast("array<string>"))), True).over(of(key))
    gone = (F.col("role") == "tool") & F.array_contains(F.coalesce("_lw_block", F.array().cast("array<string>")), F.col("tool_call_id"))
    kept = marked.withColumn("_lw_block", block).filter(~F.coalesce(gone, F.lit(False)))
    left = F.filter("tool_calls", lambda c: ~F.array_contains(F.coalesce("_lw_lost", F.array().cast("array<string>")), c["id"]))
    return kept.withColumn("tool_calls", left).select(*rows.columns)


def compress_history(
    rows: DataFrame, key: str = "conv_id", cap: int = 200, budget: float = 50.0,
    results: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """rows with replies and tool results in the form that saves most, and the column `saved` of bytes saved.

    Conversations of up to two rows, user and system rows and texts of under 100 bytes stay. Each distinct
    text is compressed once; of those that get shorter, the first `cap` of a conversation count.
    """
    n = F.count("*").over(Window.partitionBy(key))
    marked = rows.withColumn("_lw_n", n)
    open_ = marked.filter((F.col("_lw_n") > 2) & ~F.col("role").isin("user", "system") & (F.octet_length("text") >= 100))
    distinct = open_.select("role", "text").distinct().withColumn("_lw_key", F.sha2(F.concat_ws("\0", "role", "text"), 256))
    replies = distinct.filter(F.col("role") == "assistant")
    ids = ("_lw_key",)
    shorter = compress.compress_reply(replies, ids).withColumnRenamed("text", "_lw_a")
    erased = compress.erase_common_words(replies, ids, budget=budget).withColumnRenamed("text", "_lw_b")
    found = distinct.join(shorter, "_lw_key", "left").join(erased, "_lw_key", "left")
    state = F.when(F.col("role") == "assistant", compress.dialogue_state(F.col("text")))
    tool = F.when(F.col("role").isin(*TOOL_ROLES), F.coalesce(compress.hoist_invariants(F.col("text")), results(F.col("text")) if results else F.lit(None).cast("string")))
    best = found.select("role", "text", compress.best_of(F.col("text"), F.col("_lw_a"), F.col("_lw_b"), state, tool).alias("_lw_best"))
    useful = best.filter("_lw_best is not null")
    seen = open_.join(useful, ["role", "text"]).groupBy(key, "role", "text").agg(F.min("turn").alias("_lw_turn"))
    ranked = seen.withColumn("_lw_rank", F.row_number().over(Window.partitionBy(key).orderBy("_lw_turn"))).filter(F.col("_lw_rank") <= cap)
    chosen = ranked.join(useful, ["role", "text"]).select(key, "role", "text", "_lw_best")
    both = marked.join(chosen, [key, "role", "text"], "left").withColumn("_lw_ok", (F.col("_lw_n") > 2) & F.col("_lw_best").isNotNull())
    return both.withColumn("saved", F.when(F.col("_lw_ok"), F.octet_length("text") - F.octet_length("_lw_best")).otherwise(0)).withColumn(
        "text", F.when(F.col("_lw_ok"), F.col("_lw_best")).otherwise(F.col("text"))).select(*rows.columns, "saved")


def clean(rows: DataFrame, after: int = 8, key: str = "conv_id", roles: tuple[str, ...] = TOOL_ROLES) -> DataFrame:
    """All steps but the compression of history, in the order in which a request goes through them."""
    return (rows.transform(drop_empty_replies, key).transform(normalise_roles)
            .transform(lambda r: collapse_old_results(r, after, roles=roles, key=key)).transform(lambda r: minify_results(r, roles))
            .transform(lambda r: drop_repeats(r, TOOL_ROLES, key)).transform(strip_system, key))
