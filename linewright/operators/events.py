"""Questions about an append-only event log. The present is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linewright.functions import text as T
from linewright.operators.folds import ordered_fold

# Names that count as having failed once.
WEAK_NAMES = ("unwrap", "legacy", "hack", "todo", "TODO", "FIXME", "debug_", "temp", "old_text", "clone")


def since(now: Column, hours: int) -> Column:
    return now - F.expr(f"interval {hours} hours")


def recent(log: DataFrame, now: Column, hours: int, most: int = 50, order: str = "t", tie: str = "id") -> DataFrame:
    """The newest `most` events of the last hours; equal times by id, newest first."""
    return log.filter(F.col(order) >= since(now, hours)).orderBy(F.desc(order), F.desc(tie)).limit(most)


def repeated(log: DataFrame, now: Column, column: str = "detail", days: int = 7, least: int = 2) -> DataFrame:
    """Values seen at least `least` times in the last days."""
    return log.filter(F.col("t") >= since(now, 24 * days)).groupBy(column).agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def prior(log: DataFrame, now: Column) -> DataFrame:
    """One row `prior`: undone edits of the last day, names refused twice in a week, and the latest clean-ups."""
    day = log.filter(F.col("t") >= since(now, 24))
    undone = day.filter((F.col("event") == "edit") & F.col("outcome").startswith("revert"))
    first = lambda d, body: d.orderBy(F.desc("t"), F.desc("id")).limit(3).agg(F.array_join(F.transform(
        F.reverse(F.array_sort(F.collect_list(F.struct("t", "id", body.alias("s"))))), lambda x: F.concat(F.lit("  "), x["s"], F.lit("\n"))), "").alias("s"))
    fails = undone.agg(F.count("*").alias("n")).crossJoin(F.broadcast(first(undone, F.concat("file", F.lit(": "), "outcome")))).select(
        F.when(F.col("n") > 0, F.concat(F.lit("Recent edit failures: "), F.col("n").cast("string"), F.lit(" in last 24h\n"), "s")).otherwise("").alias("a"))
    names = repeated(log.filter("event = 'veto'"), now).agg(F.array_join(F.array_sort(F.collect_list("detail")), ", ").alias("b")).select(
        F.when(F.col("b") != "", F.concat(F.lit("Blocked identifiers (hallucinated): "), "b", F.lit("\n"))).otherwise("").alias("b"))
    sweeps = first(day.filter("event = 'scavenge'"), F.concat("file", F.lit(": "), "detail")).select(
        F.when(F.col("s") != "", F.concat(F.lit("Recent scavenger actions:\n"), "s")).otherwise("").alias("c"))
    joined = fails.crossJoin(F.broadcast(names)).crossJoin(F.broadcast(sweeps))
    return joined.select(F.coalesce(F.nullif(F.concat("a", "b", "c"), F.lit("")), F.lit("No prior events")).alias("prior"))


def failure_risk(attempts: DataFrame, by: tuple[str, ...], name: str = "identifier", success: str = "success", least: int = 2) -> DataFrame:
    """(by, name, risk, fails, successes) of names that failed at least `least` times, weak names once more."""
    sums = attempts.groupBy(*by, name).agg(F.count_if(F.col(success)).alias("successes"), F.count_if(~F.col(success)).alias("f"))
    fails = F.col("f") + F.col(name).isin(*WEAK_NAMES).cast("int")
    return sums.withColumn("fails", fails).filter(F.col("fails") >= least).select(
        *by, name, (F.col("fails") / F.greatest(F.col("fails") + F.col("successes"), F.lit(1))).alias("risk"), "fails", "successes")


def outcomes(messages: DataFrame, content: str = "text", tool: str = "tool", keys: tuple[str, ...] = ("id",)) -> DataFrame:
    """(keys, file, identifier, operation, success) of tool results that name a file: edits, and sed commands."""
    body = F.col(content)
    edit = F.col(tool).isin("edit", "apply-edit", "write")
    shell = F.col(tool).isin("bash", "run")
    path = F.when(edit, T.first_path(body)).when(shell, T.sed_target(body))
    found = messages.withColumn("file", path).filter(F.col("file").isNotNull())
    file_stem = F.regexp_replace(F.element_at(F.split("file", r"[/\\]"), -1), r"(?<=.)\.[^.]*\z", "")
    low = F.lower(content)
    bad = low.contains("error") | low.contains("fail") | (edit & low.contains("revert"))
    return found.select(*keys, "file", F.when(edit, T.primary_identifier(F.col(content), file_stem)).otherwise("sed").alias("identifier"),
                        F.when(edit, F.col(tool)).otherwise("bash").alias("operation"), (~bad).alias("success"))


def edit_mention(text: Column) -> Column:
    """(path, content) that a reply's tool call holds: the quoted strings behind its keys; null without both."""
    after = lambda mark: F.substring(text, F.instr(text, F.lit(mark)) + len(mark), F.length(text))
    second = lambda c: F.get(F.split(c, '"', -1), F.lit(1))
    one = text.contains('"filePath"') & text.contains('"newText"')
    two = text.contains('"path":') & text.contains('"content":')
    pair = lambda a, b: F.struct(second(after(a)).alias("path"), second(after(b)).alias("content"))
    # the key itself is passed without its closing quote, as the quotes are counted from there
    return F.when(one, pair('"filePath"', '"newText"')).when(two, pair('"path"', '"content"'))


def latest(rows: DataFrame, keys: tuple[str, ...], order: str = "ts", tie: str = "event_id") -> DataFrame:
    """The newest row of each key."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order), F.desc(tie)))
    return rows.withColumn("_lw_rank", rank).filter("_lw_rank = 1").drop("_lw_rank")


def sweep(rows: DataFrame, now: Column, hours: int = 24, order: str = "ts") -> DataFrame:
    return rows.filter(F.col(order) >= since(now, hours))


def newest(rows: DataFrame, cap: int, order: str = "ts", tie: str = "event_id") -> DataFrame:
    """The newest `cap` rows, without a window over all."""
    return rows.orderBy(F.desc(order), F.desc(tie)).limit(cap)


def rolling_mean(rows: DataFrame, key: str, value: str, order: tuple[str, ...], last: int = 5) -> DataFrame:
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(-(last - 1), 0)
    return rows.withColumn("rolling", F.avg(value).over(w))


def feedback(rows: DataFrame, key: str, order: tuple[str, ...], hit: str = "hit", total: str = "total", low: float = 0.30, high: float = 0.80) -> DataFrame:
    """rows with `paused`: below `low` a rolling mean of five ratios pauses, above `high` it resumes, between it stays.

    The state is that of the last ratio that decided, so it is carried by a window, not folded. Rows of no
    tokens decide nothing and keep the state. Pauses that run out by the clock are a streaming matter.
    """
    ratios = rows.withColumn("_lw_ratio", F.when(F.col(total) > 0, F.col(hit) / F.col(total)))
    w = Window.partitionBy(key).orderBy(*order)
    counted = ratios.withColumn("_lw_k", F.count("_lw_ratio").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    real = counted.filter("_lw_ratio is not null")
    mean = F.avg("_lw_ratio").over(w.rowsBetween(-4, 0))
    decided = real.withColumn("_lw_mean", mean).withColumn("_lw_says", F.when(F.col("_lw_mean") < low, True).when(F.col("_lw_mean") > high, False))
    state = F.coalesce(F.last("_lw_says", True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(False))
    states = decided.withColumn("paused", state).select(key, "_lw_k", "paused")
    return counted.join(states, [key, "_lw_k"], "left").withColumn("paused", F.coalesce("paused", F.lit(False))).drop("_lw_ratio", "_lw_k")


def admitted(rows: DataFrame, key: str, order: tuple[str, ...], time: str, limit: int, seconds: int) -> DataFrame:
    """(key, order, allowed): up to `limit` of a key in a window of seconds that begins with its first event.

    The next window begins with the first event more than `seconds` after that, so a key's events are folded in
    order of time.
    """
    span = seconds * 1_000_000

    def step(state: tuple, t: int) -> tuple:
        begin, n = state
        if begin is None or t - begin > span:
            begin, n = t, 0
        return (begin, n + (n < limit)), (n < limit,)

    timed = rows.withColumn("_lw_us", F.unix_micros(time))
    return ordered_fold(timed, key, ("_lw_us", *order), ("_lw_us",), "allowed boolean", lambda: (None, 0), step).drop("_lw_us")


def safety_states(log: DataFrame, key: str = "session", order: str = "seq", spiral: int = 3, turns: int = 10, redirects: int = 5) -> DataFrame:
    """(key, order, level, redirected) of a session's log (key, order, turn, kind, path).

    A read of a path for the `spiral`-th time since it was edited raises the level to 2 for some turns; then it is
    0 again. At level 2 a command is redirected, but the `redirects`-th such command of a session, and each later
    one, is let through and lowers the level to 1.
    """

    def step(state: tuple, turn: int, kind: str, path: str) -> tuple:
        level, until, seen, sent = state
        if level and until <= turn:
            level = 0
        redirected = False
        if kind == "edit":
            seen = {p: n for p, n in seen.items() if p != path}
        elif kind == "read":
            seen = seen | {path: seen.get(path, 0) + 1}
            if seen[path] >= spiral and level < 2:
                level, until = 2, turn + turns
        elif kind == "command" and level >= 2:
            sent += 1
            level, redirected = (1, False) if sent >= redirects else (level, True)
        return (level, until, seen, sent), (level, redirected)

    folded = ordered_fold(log, key, (order,), ("turn", "kind", "path"), "level int, redirected boolean", lambda: (0, 0, {}, 0), step)
    return folded.select(key, order, "level", "redirected")


def cached(rows: DataFrame, keys: tuple[str, ...], now: Column, seconds: int, cap: int, order: str = "ts", tie: str = "event_id") -> DataFrame:
    """What a cache holds that keeps the newest row of a key for some seconds, and the newest `cap` of them."""
    alive = rows.filter(F.col(order) >= now - F.expr(f"interval {seconds} seconds"))
    return newest(latest(alive, keys, order, tie), cap, order, tie)


def maintenance_delays(runs_: DataFrame, key: str, order: str, took: str, pause: int = 120, slow: int = 60, longest: int = 1800) -> DataFrame:
    """runs with `delay`, the seconds until the next: doubled after each run over `slow` seconds, up to `longest`, else `pause`."""
    w = Window.partitionBy(key).orderBy(order)
    good = F.sum((F.col(took) <= slow).cast("int")).over(w)
    streak = F.sum((F.col(took) > slow).cast("int")).over(Window.partitionBy(key, "_lw_good").orderBy(order))
    delay = F.least(F.lit(longest), F.lit(pause) * F.pow(2.0, F.least("_lw_streak", F.lit(16))))
    return runs_.withColumn("_lw_good", good).withColumn("_lw_streak", streak).withColumn("delay", delay.cast("int")).drop("_lw_good", "_lw_streak")


def status_counts(files: DataFrame, log: DataFrame) -> DataFrame:
    """One row: files of the index, and events of the log."""
    return files.agg(F.count("*").alias("files")).crossJoin(F.broadcast(log.agg(F.count("*").alias("events"))))


def safety_levels(reads: DataFrame, key: str, order: str = "seq", spiral: int = 3) -> DataFrame:
    """reads (key, order, path, edited) with the number of reads of a path since its last edit, and whether it spirals."""
    w = Window.partitionBy(key, "path").orderBy(order)
    part = F.sum(F.col("edited").cast("int")).over(w)
    count = F.sum((~F.col("edited")).cast("int")).over(Window.partitionBy(key, "path", "_lw_part").orderBy(order))
    return reads.withColumn("_lw_part", part).withColumn("reads", count).withColumn("spiral", F.col("reads") >= spiral).drop("_lw_part")


def unchanged(reads: DataFrame, path: str, content: str, order: str) -> DataFrame:
    """reads with whether the content is what the path's last read gave."""
    w = Window.partitionBy(path).orderBy(order)
    digest = F.sha2(F.col(content), 256)
    return reads.withColumn("_lw_digest", digest).withColumn("unchanged", F.coalesce(F.col("_lw_digest") == F.lag("_lw_digest").over(w), F.lit(False))).drop("_lw_digest")


def normalised_url(url: Column) -> Column:
    """A base address with the endpoint that its host and ending ask for."""
    u = F.regexp_replace(url, "/+$", "")
    host = F.regexp_extract(F.regexp_replace(F.regexp_extract(F.regexp_replace(u, r"^.*?://", ""), r"^[^/]*", 0), r"^.*@", ""), r"^[^:]*", 0)
    return (F.when(u.endswith("/chat/completions") | u.endswith("/v1/messages"), u)
            .when(host.contains("anthropic"), F.when(u.endswith("/v1"), F.concat(u, F.lit("/messages"))).otherwise(F.concat(u, F.lit("/v1/messages"))))
            .when(u.endswith("/v1") | u.contains("/v1/"), F.concat(u, F.lit("/chat/completions")))
            .otherwise(F.concat(u, F.lit("/v1/chat/completions"))))


def first_source(*sources: tuple[str, Column]) -> Column:
    """(value, source) of the first source that has a value, in order."""
    chosen = F.lit(None)
    for name, c in reversed(sources):
        chosen = F.when(c.isNotNull(), F.struct(c.alias("value"), F.lit(name).alias("source"))).otherwise(chosen)
    return chosen
