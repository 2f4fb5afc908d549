"""Session logs of an agent: one JSON event a line, to reads, edits, test runs and a state block."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linewright.functions import classify as C
from linewright.functions import text as T

EVENT = """type string, message struct<role: string, toolCallId: string, toolName: string,
 content: array<struct<type: string, id: string, name: string, text: string, arguments: string>>>"""


def parsed(lines: DataFrame, session: str = "session", seq: str = "seq", value: str = "value") -> DataFrame:
    """(session, seq, role, call_id, tool, content, turn) of message events; lines that are no JSON are left out."""
    rows = lines.select(session, seq, F.from_json(value, EVENT).alias("e")).filter(F.col("e.type") == "message")
    turn = F.sum((F.col("role") == "user").cast("int")).over(Window.partitionBy(session).orderBy(seq))
    flat = rows.select(session, seq, F.coalesce("e.message.role", F.lit("")).alias("role"), F.col("e.message.toolCallId").alias("call_id"),
                       F.col("e.message.toolName").alias("tool"), F.col("e.message.content").alias("content"))
    return flat.withColumn("turn", turn)


def results(events: DataFrame, session: str = "session", seq: str = "seq") -> DataFrame:
    """Tool results beside the arguments of their call: the latest call of the id before, which the first result uses up."""
    calls = events.filter("role = 'assistant'").select(session, F.col(seq).alias("made"), F.explode("content").alias("c")).filter("c.type = 'toolCall'").select(
        session, "made", F.coalesce("c.id", F.lit("")).alias("call_id"), F.col("c.arguments").alias("arguments"))
    answers = events.filter("role = 'toolResult'").withColumn("call_id", F.coalesce("call_id", F.lit("")))
    pairs = answers.join(calls, [session, "call_id"]).filter(F.col("made") < F.col(seq))
    newest = F.row_number().over(Window.partitionBy(session, "call_id", seq).orderBy(F.desc("made")))
    first = F.row_number().over(Window.partitionBy(session, "call_id", "made").orderBy(seq))
    return pairs.withColumn("_lw_n", newest).filter("_lw_n = 1").withColumn("_lw_f", first).filter("_lw_f = 1").drop("_lw_n", "_lw_f", "made")


def reads(found: DataFrame, session: str = "session", seq: str = "seq") -> DataFrame:
    """(session, seq, path, size, hash, is_rerun) of file reads; the size is that of the texts in bytes, the hash its hexadecimal."""
    path = F.get_json_object("arguments", "$.path")
    size = F.aggregate(F.filter(F.transform("content", lambda c: c["text"]), lambda t: t.isNotNull()), F.lit(0), lambda a, t: a + F.octet_length(t))
    rows = found.filter((F.col("tool") == "read") & (F.size("content") > 0)).withColumn("path", path).filter("path <> ''").withColumn("size", size)
    again = F.row_number().over(Window.partitionBy(session, "path").orderBy(seq)) > 1
    return rows.select(session, seq, "path", "size", F.lower(F.hex("size")).alias("hash"), again.alias("is_rerun"))


def tests(found: DataFrame, session: str = "session", seq: str = "seq") -> DataFrame:
    """(session, seq, i, turn, failed, output, summary) of the texts of test runs that passed or failed."""
    command = F.coalesce(F.get_json_object("arguments", "$.command"), F.lit(""))
    rows = found.filter((F.col("tool") == "bash") & (command.contains("cargo test") | command.contains("pytest")))
    each = rows.select(session, seq, "turn", F.posexplode("content").alias("i", "c")).filter("c.type = 'text'").withColumn("text", F.coalesce("c.text", F.lit("")))
    failed = F.col("text").contains("FAILED") | F.col("text").contains("failures:")
    said = each.withColumn("failed", failed).filter(F.col("failed") | F.col("text").contains("test result:"))
    return said.select(session, seq, "i", "turn", "failed", F.substring("text", 1, 200).alias("output"), C.error_summary(T.lines(F.col("text"))).alias("summary"))


def edits(found: DataFrame, session: str = "session", seq: str = "seq") -> DataFrame:
    """(session, seq, i, file, line, attempt, old_snippet, new_snippet) of the replacements asked for; attempts count by file."""
    wanted = F.from_json(F.get_json_object("arguments", "$.edits"), "array<struct<oldText: string, newText: string>>")
    rows = found.filter("tool = 'edit'").select(session, seq, F.coalesce(F.get_json_object("arguments", "$.file"), F.lit("")).alias("file"), F.posexplode(wanted).alias("i", "e"))
    old, new = F.coalesce("e.oldText", F.lit("")), F.coalesce("e.newText", F.lit(""))
    attempt = F.row_number().over(Window.partitionBy(session, "file").orderBy(seq, "i"))
    return rows.select(session, seq, "i", "file", F.coalesce(F.get(T.lines(old), F.lit(0)), F.lit("")).alias("line"), attempt.alias("attempt"),
                       F.substring(old, 1, 40).alias("old_snippet"), F.substring(new, 1, 40).alias("new_snippet"))


def edited_files(found: DataFrame, session: str = "session", seq: str = "seq") -> DataFrame:
    """(session, files): the files that a session edited, each once, sorted."""
    return edits(found, session, seq).groupBy(session).agg(F.array_sort(F.collect_set("file")).alias("files"))


def states(lines: DataFrame, session: str = "session", seq: str = "seq", value: str = "value") -> DataFrame:
    """(session, turns, reads, edits, tests, errors, last_output, last_pass): a session's facts as arrays in order.

    The last edit succeeded if the last test run passed.
    """
    events = parsed(lines, session, seq, value)
    found = results(events, session, seq)
    ordered = lambda *c: F.array_sort(F.collect_list(F.struct(*c)))
    turns = events.groupBy(session).agg(F.max("turn").alias("turns"))
    read = reads(found, session, seq).groupBy(session).agg(ordered(seq, "path", "size", "hash", "is_rerun").alias("reads"))
    edit = edits(found, session, seq).groupBy(session).agg(ordered(seq, "i", "file", "line", "attempt", "old_snippet", "new_snippet").alias("edits"))
    run = tests(found, session, seq)
    test = run.groupBy(session).agg(F.max_by(F.struct("output", "failed"), F.struct(seq, "i")).alias("last"),
                                    ordered(seq, "i", "turn", F.when(F.col("failed"), F.col("summary")).alias("summary")).alias("tests"))
    joined = turns.join(read, session, "left").join(edit, session, "left").join(test, session, "left")
    passed = F.coalesce(~F.col("last.failed"), F.lit(False))
    marked = F.transform(F.coalesce("edits", F.array()), lambda e, i: F.struct(e["file"].alias("file"), e["line"].alias("line"), e["attempt"].alias("attempt"), e["old_snippet"].alias("old_snippet"),
                                                                             e["new_snippet"].alias("new_snippet"), (passed & (i == F.size("edits") - 1)).alias("success")))
    errors = F.filter("tests", lambda t: t["summary"].isNotNull())
    return joined.select(session, "turns", F.coalesce("reads", F.array()).alias("reads"), F.when(F.col("edits").isNull(), F.array()).otherwise(marked).alias("edits"),
                         F.coalesce(errors, F.array()).alias("errors"), F.col("last.output").alias("last_output"), passed.alias("last_pass"))


def recent_reads(reads_array):
    """Reads of which each path and hash counts once, at its last place."""
    return F.filter(reads_array, lambda r, i: ~F.exists(F.slice(reads_array, i + 2, F.size(reads_array)), lambda s: (s["path"] == r["path"]) & (s["hash"] == r["hash"])))


def state_block(states_: DataFrame, session: str = "session") -> DataFrame:
    """(session, block): the facts in a few lines; 'early' before the third turn."""
    newest = lambda a: F.slice(F.reverse(a), 1, 4)
    s = lambda c: c.cast("string")
    unique = recent_reads(F.col("reads"))
    name = lambda r: F.replace(F.substring(F.element_at(F.split(r["path"], "/"), -1), 1, 25), F.lit("\n"), F.lit(" "))
    read = F.array_join(F.transform(newest(unique), lambda r: F.concat(name(r), F.lit("("), s(r["size"]), F.lit("b)"), F.when(r["is_rerun"], "[re-read]").otherwise(""))), " | ")
    edit = F.array_join(F.transform(newest(F.col("edits")), lambda e: F.concat(
        F.lit("L"), s(e["attempt"]), F.lit(' "…'), F.substring(e["old_snippet"], 1, 20), F.lit('…"→"…'), F.substring(e["new_snippet"], 1, 20), F.lit('…"'),
        F.when(e["success"], "✓").otherwise("✗"))), " | ")
    test = F.concat(F.lit("tests: "), F.when(F.col("last_pass"), "PASS").otherwise("FAIL"), F.lit(" — "), F.replace(F.substring("last_output", 1, 100), F.lit("\n"), F.lit(" ")))
    last = F.element_at("errors", -1)
    parts = F.filter(F.array(
        F.concat(F.lit("turn: "), s(F.col("turns"))), F.when(F.size(unique) > 0, F.concat(F.lit("reads: "), read)), F.when(F.col("last_output").isNotNull(), test),
        F.when(F.size("edits") > 0, F.concat(F.lit("edits: "), edit)),
        F.when(F.size("errors") > 0, F.concat(F.lit("error[t"), s(last["turn"]), F.lit("]: "), last["summary"])),
        F.concat(F.lit("session: "), s(F.col("turns")), F.lit(" turns, "), s(F.size(unique)), F.lit(" files read ("),
                 s(F.size(F.filter("reads", lambda r: r["is_rerun"]))), F.lit(" re-reads), "), s(F.size("edits")), F.lit(" edits")),
    ), lambda p: p.isNotNull())
    return states_.select(session, F.when(F.col("turns") < 3, "early\n").otherwise(F.concat(F.lit("[state]\n"), F.array_join(parts, "\n"), F.lit("\n"))).alias("block"))
