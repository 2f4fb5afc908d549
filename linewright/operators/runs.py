"""Runs of lines: gaps and islands over (key, line_no, line).

Every operator takes rows of lines and gives rows of lines; line_no is that of the run's first line, and a
fraction follows where one line becomes two. A key's rows meet in one partition; nothing else is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linewright.functions import classify as C
from linewright.functions import text as T
from linewright.operators.folds import ordered_fold

# Words that begin lines of progress.
PROGRESS_WORDS = ("Compiling", "Checking", "Building", "Linking", "Running")


def by(key: str) -> Window:
    return Window.partitionBy(key).orderBy("line_no")


def numbered_runs(rows: DataFrame, key: str, value: Column, name: str = "run") -> DataFrame:
    """rows with the number of the run of equal values that each belongs to; null equals null."""
    marked = rows.withColumn("_lw_value", value)
    starts = ~F.col("_lw_value").eqNullSafe(F.lag("_lw_value").over(by(key))) | (F.row_number().over(by(key)) == 1)
    return marked.withColumn("_lw_start", starts.cast("int")).withColumn(name, F.sum("_lw_start").over(by(key))).drop("_lw_value", "_lw_start")


def joined(order: Column, value: Column, between: str) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), value.alias("v")))), lambda x: x["v"]), between)


def collapse_blanks(rows: DataFrame, key: str) -> DataFrame:
    """Of each run of blank lines the first."""
    blank = rows.withColumn("_lw_blank", C.is_blank(F.col("line")))
    seen = blank.withColumn("_lw_again", F.col("_lw_blank") & F.coalesce(F.lag("_lw_blank").over(by(key)), F.lit(False)))
    return seen.filter(~F.col("_lw_again")).select(*rows.columns)


def error_blocks(rows: DataFrame, key: str, is_error: Callable[[Column], Column] = C.is_error) -> DataFrame:
    """(key, line_no, line, merged): from an error line to the next blank one, one line of several joined by a bar."""
    marked = rows.withColumn("_lw_blank", C.is_blank(F.col("line"))).withColumn("_lw_part", F.sum(F.col("_lw_blank").cast("int")).over(by(key)))
    w = Window.partitionBy(key, "_lw_part")
    first = F.min(F.when(is_error(F.col("line")) & ~F.col("_lw_blank"), F.col("line_no"))).over(w)
    inside = marked.withColumn("merged", ~F.col("_lw_blank") & F.coalesce(F.col("line_no") >= first, F.lit(False)))
    group = F.when(F.col("merged"), F.col("_lw_part")).otherwise(-1 - F.col("line_no"))
    return inside.groupBy(key, group.alias("_lw_group")).agg(
        F.min("line_no").alias("line_no"), F.first("merged").alias("merged"),
        F.when(F.first("merged"), joined(F.col("line_no"), T.trim(F.col("line")), "\n┃ ")).otherwise(F.first("line")).alias("line"),
    ).select(key, "line_no", "line", "merged")


def output_error_runs(rows: DataFrame, key: str, is_error: Callable[[Column], Column] | None = None) -> DataFrame:
    """Runs of errors, warnings and places become their first line and a count of the others."""
    c = F.col("line")
    default = C.output_class(c).isin("error", "warning") | ((C.output_class(c) == "summary") & c.contains("  --> "))
    marked = rows.withColumn("_lw_error", is_error(c) if is_error else default)
    runs = numbered_runs(marked, key, F.when(~F.col("_lw_error"), F.col("line_no")), "_lw_run")
    grouped = runs.groupBy(key, "_lw_run").agg(F.min("line_no").alias("line_no"), F.min_by("line", "line_no").alias("line"), F.count("*").alias("n"))
    more = F.concat(F.lit("  [error: "), (F.col("n") - 1).cast("string"), F.lit(" additional lines]"))
    both = F.when(F.col("n") > 1, F.array("line", more)).otherwise(F.array("line"))
    return grouped.select(key, F.col("line_no").cast("double").alias("l"), F.posexplode(both).alias("i", "line")).select(
        key, (F.col("l") + F.col("i") / 2).alias("line_no"), "line")


def _collapsed(runs: DataFrame, key: str, label: Column) -> DataFrame:
    """Runs numbered in _lw_run: a label for those that have one, every line of the others."""
    w = Window.partitionBy(key, "_lw_run")
    counted = runs.withColumn("_lw_n", F.count("*").over(w)).withColumn("_lw_first", F.min("line_no").over(w))
    shown = counted.withColumn("_lw_label", label)
    return shown.filter(F.col("_lw_label").isNull() | (F.col("line_no") == F.col("_lw_first"))).select(
        key, "line_no", F.coalesce("_lw_label", "line").alias("line"))


def is_ok(line: Column) -> Column:
    t = T.trim(line)
    return t.contains("... ok") | (t == "ok")


def ends_ok(line: Column) -> Column:
    t = T.trim(line)
    return t.endswith("... ok") | (t == "ok")


def ok_runs(rows: DataFrame, key: str, ok: Callable[[Column], Column] = ends_ok, least: int = 3) -> DataFrame:
    """Runs of at least `least` good lines become a count."""
    marked = rows.withColumn("_lw_ok", ok(F.col("line")))
    runs = numbered_runs(marked, key, F.when(~F.col("_lw_ok"), F.col("line_no")), "_lw_run")
    n = F.col("_lw_n")
    return _collapsed(runs, key, F.when(F.col("_lw_ok") & (n >= least), F.concat(F.lit("["), n.cast("string"), F.lit(" ok]"))))


def prefix_runs(
    rows: DataFrame, key: str, starts: tuple[str, ...] = PROGRESS_WORDS, ok: Callable[[Column], Column] = is_ok, least: int = 3
) -> DataFrame:
    """Runs of lines with one first word of progress become the word and a count; then runs of good lines a count.

    A run of good lines that began before a run of progress holds the lines that are both.
    """
    t = T.trim(F.col("line"))
    word = F.regexp_extract(t, r"(?U)^\S+", 0)
    marked = rows.withColumn("_lw_word", word).withColumn("_lw_ok", ok(F.col("line")))
    progress = F.lit(False)
    for s in starts:
        progress = progress | F.col("_lw_word").startswith(s)
    marked = marked.withColumn("_lw_progress", progress)
    one = numbered_runs(marked, key, F.when(F.col("_lw_progress"), F.col("_lw_word")).otherwise(F.concat(F.lit(" "), F.col("line_no").cast("string"))), "_lw_p")
    many = one.withColumn("_lw_many", F.col("_lw_progress") & (F.count("*").over(Window.partitionBy(key, "_lw_p")) >= least))
    good = numbered_runs(many, key, F.when(~F.col("_lw_ok"), F.col("line_no")), "_lw_g")
    g = Window.partitionBy(key, "_lw_g")
    led = F.min_by("_lw_many", "line_no").over(g)
    taken = good.withColumn("_lw_taken", F.col("_lw_ok") & ~led & (F.count("*").over(g) >= least))
    kind = (F.when(F.col("_lw_taken"), F.concat(F.lit("g"), F.col("_lw_g").cast("string")))
            .when(F.col("_lw_many"), F.concat(F.lit("p"), F.col("_lw_p").cast("string")))
            .when(F.col("_lw_ok"), F.lit("o")).otherwise(F.concat(F.lit("l"), F.col("line_no").cast("string"))))
    runs = numbered_runs(taken.withColumn("_lw_kind", kind), key, F.col("_lw_kind"), "_lw_run")
    n = F.col("_lw_n").cast("string")
    label = (F.when(F.col("_lw_many") & ~F.col("_lw_taken"), F.concat(F.lit("["), n, F.lit(" "), F.col("_lw_word"), F.lit(" ...] ("), n, F.lit(" lines)")))
             .when(F.col("_lw_ok") & (F.col("_lw_n") >= least), F.concat(F.lit("["), n, F.lit(" ok]"))))
    return _collapsed(runs, key, label)


def diff_runs(rows: DataFrame, key: str, least: int = 3) -> DataFrame:
    """Runs of at least `least` equal context lines become a count; blank lines go, headers and separators stay."""
    t = T.trim(F.col("line"))
    header = (t.startswith("@@ -") & t.contains(" +") & t.endswith("@@")) | t.startswith("--- ") | t.startswith("+++ ")
    plain = header | C.is_separator(F.col("line")) | (t == "")
    marked = rows.withColumn("_lw_plain", plain)
    runs = numbered_runs(marked, key, F.when(F.col("_lw_plain"), F.concat(F.lit(" "), F.col("line_no").cast("string"))).otherwise(F.concat(F.lit("="), F.col("line"))), "_lw_run")
    n = F.col("_lw_n")
    label = F.when(~F.col("_lw_plain") & (n >= least), F.concat(F.lit("["), n.cast("string"), F.lit(" identical context lines]")))
    return _collapsed(runs.filter(~C.is_blank(F.col("line"))), key, label)


def zone_truncate(rows: DataFrame, key: str, head: int, tail: int) -> DataFrame:
    """The first and last lines, and between them a note of how many are left out."""
    n = F.count("*").over(Window.partitionBy(key))
    placed = rows.withColumn("_lw_n", n)
    left = F.col("_lw_n") - head - tail
    inside = (left > 0) & (F.col("line_no") >= head) & (F.col("line_no") < F.col("_lw_n") - tail)
    note = F.when(inside & (F.col("line_no") == head), F.concat(F.lit("[... "), left.cast("string"), F.lit(" lines omitted ...]")))
    return placed.withColumn("_lw_in", inside).withColumn("_lw_note", note).filter(~F.col("_lw_in") | F.col("_lw_note").isNotNull()).select(
        key, "line_no", F.coalesce("_lw_note", "line").alias("line"))


def zone_truncate_info(rows: DataFrame, key: str, keep: int, score: Column) -> DataFrame:
    """The `keep` lines of highest score in their order, with a note for each run that is left out.

    Error lines count 10 more, the first and last three 0.5; of equal scores the earlier line stays.
    """
    w = Window.partitionBy(key)
    placed = rows.withColumn("_lw_n", F.count("*").over(w))
    edge = (F.col("line_no") < 3) | (F.col("line_no") >= F.greatest(F.col("_lw_n") - 3, F.lit(0)))
    total = score + F.when(C.is_error_line(F.col("line")), 10.0).otherwise(0.0) + F.when(edge, 0.5).otherwise(0.0)
    ranked = placed.withColumn("_lw_score", total)
    ranked = ranked.withColumn("_lw_rank", F.row_number().over(w.orderBy(F.desc("_lw_score"), "line_no")))
    kept = ranked.withColumn("_lw_kept", (F.col("_lw_n") <= keep) | (F.col("_lw_rank") <= keep))
    runs = numbered_runs(kept, key, F.when(F.col("_lw_kept"), F.col("line_no")), "_lw_run")
    label = F.when(~F.col("_lw_kept"), F.concat(F.lit("[…"), F.count("*").over(Window.partitionBy(key, "_lw_run")).cast("string"), F.lit(" lines…]")))
    return _collapsed(runs.drop("_lw_n"), key, label)


def compress_output(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text): long command output with errors, progress, good and blank lines collapsed, where that is shorter.

    Texts of up to 200 bytes or 15 lines stay as they are.
    """
    body = T.text_of(F.col(text))
    long = docs.filter((F.octet_length(body) > 200) & (F.size(T.lines(body)) > 15))
    rows = long.select(key, F.posexplode(F.transform(T.lines(body), C.strip_ansi_narrow)).alias("line_no", "line"))
    steps = collapse_blanks(ok_runs(prefix_runs(output_error_runs(rows, key), key), key), key)
    made = steps.groupBy(key).agg(joined(F.col("line_no"), F.col("line"), "\n").alias("_lw_made"))
    both = docs.select(key, F.col(text).alias("text")).join(made, key, "left")
    return both.select(key, F.when(F.octet_length("_lw_made") < F.octet_length("text"), F.col("_lw_made")).otherwise(F.col("text")).alias("text"))


def gate_class(line: Column) -> Column:
    """Class of a line before a tool's result is shown."""
    t = T.trim(line)
    return (F.when(t == "", "blank").when(t.rlike(r"^(Compiling|Checking|Building|Linking|Running)\b"), "progress")
            .when((t == "ok") | t.rlike(r"\b\.\.\. ok\z"), "ok")
            .when(t.rlike(r"\b(FAILED|failed|error|Error|ERROR|E\d{4}|Traceback)\b"), "error")
            .when(t.startswith("  --> ") | t.startswith("   = help") | t.startswith("   = note"), "help").otherwise("code"))


def gate_runs(rows: DataFrame, key: str, least: int = 3, classes: Callable[[Column], Column] = gate_class) -> DataFrame:
    """Runs of at least `least` blank, good or progress lines become an empty line or a count."""
    marked = rows.withColumn("_lw_class", classes(F.col("line")))
    runs = numbered_runs(marked, key, F.col("_lw_class"), "_lw_run")
    n = F.col("_lw_n").cast("string")
    word = F.min_by(F.regexp_extract(T.trim(F.col("line")), r"(?U)^\S*", 0), "line_no").over(Window.partitionBy(key, "_lw_run"))
    label = F.when(F.col("_lw_n") >= least, F.when(F.col("_lw_class") == "ok", F.concat(F.lit("["), n, F.lit(" ok]"))).when(
        F.col("_lw_class") == "blank", "").when(F.col("_lw_class") == "progress", F.concat(F.lit("["), n, F.lit(" "), word, F.lit(" ...]"))))
    return _collapsed(runs, key, label)


def function_ends(rows: DataFrame, starts: DataFrame, key: str) -> DataFrame:
    """(key, start, end): the last line of the function whose body begins at line `start`, by indentation.

    `starts` has (key, start, indent). The body ends before the first line from `start` on that is not blank,
    no comment and indented no more than `indent`; blank and comment lines before it are not the body's. Starts
    behind a text's last line have no row. Lines and starts are folded from the last line to the first, beside
    a stack of the nearest lines of each lesser indentation.
    """
    t = T.trim(F.col("line"))
    skipped = (t == "") | t.startswith("#") | t.startswith("//")
    deep = F.octet_length("line") - F.octet_length(F.regexp_replace("line", r"(?U)^\s+", ""))
    full = F.max(F.when(~F.col("skip"), F.col("line_no"))).over(by(key).rowsBetween(Window.unboundedPreceding, -1))
    marked = rows.select(key, "line_no", skipped.alias("skip"), deep.cast("int").alias("deep")).withColumn("before", full)
    total = rows.groupBy(key).agg(F.max("line_no").alias("_lw_last"))
    number = lambda c: F.col(c).cast("long")
    both = marked.select(key, (-number("line_no")).alias("at"), F.lit(0).alias("kind"), number("deep").alias("deep"), "skip", number("before").alias("before")).unionByName(
        starts.select(key, (-number("start")).alias("at"), F.lit(1).alias("kind"), number("indent").alias("deep"), F.lit(False).alias("skip"), F.lit(None).cast("long").alias("before")))

    def step(stack: tuple, at: int, kind: int, deep: int, skip: bool, before: int | None) -> tuple:
        if kind == 1:
            _, stop, last = next((x for x in reversed(stack) if x[0] <= deep), (None, None, None))
            return stack, (stop, last)
        if skip:
            return stack, (None, None)
        return (*(x for x in stack if x[0] < deep), (deep, -at, before)), (None, None)

    folded = ordered_fold(both, key, ("at", "kind"), ("at", "kind", "deep", "skip", "before"), "stop long, last long", tuple, step)
    ends = folded.filter("kind = 1").select(key, (-F.col("at")).alias("start"), "stop", "last").join(total, key).filter(F.col("start") <= F.col("_lw_last"))
    # nothing but skipped lines before the stop: the line before it
    found = F.when(F.col("stop").isNull(), F.col("_lw_last")).when(F.col("last") >= F.col("start"), F.col("last")).otherwise(F.greatest(F.col("stop") - 1, F.lit(0)))
    return ends.select(key, F.col("start").cast("int").alias("start"), found.cast("int").alias("end"))
