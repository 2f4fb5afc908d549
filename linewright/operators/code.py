"""Facts about source text: risk, exports, dead names, fixes, functions and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linewright.functions import classify as C
from linewright.functions import text as T
from linewright.operators.lines import explode_lines

# How definitions, exports and dead names are recognised.
RISK_DEFINITIONS = (("starts", "fn "), ("starts", "def "), ("starts", "function "), ("starts", "struct "), ("starts", "class "),
                    ("starts", "trait "), ("starts", "impl "), ("starts", "pub "), ("starts", "enum "), ("starts", "interface "))
EXPORTS = (("starts", "pub fn "), ("starts", "pub struct "), ("starts", "pub enum "), ("starts", "pub trait "), ("starts", "pub type "),
           ("starts", "pub const "), ("starts", "pub static "), ("starts", "export "))
EXPORT_KINDS = ("fn", "struct", "enum", "trait", "type", "const", "static")
DEAD_DEFINITIONS = (("starts", "fn "), ("starts", "def "), ("starts", "class "), ("starts", "struct "), ("starts", "enum "),
                    ("starts", "trait "), ("starts", "const "), ("starts", "let "), ("starts", "var "), ("starts", "function "),
                    ("starts", "public "), ("starts", "private "))
TEST_MARKS = ("test", "spec", "mock")
FUNCTION_KEYWORDS = ("fn ", "def ", "function ", "pub ", "struct ", "class ", "trait ", "impl ", "enum ")
FIX_PATTERNS = (
    r"'([^']+)'\s*(?:→|->|=>)\s*'([^']+)'",
    r"`([^`]+)`\s*(?:→|->|=>)\s*`([^`]+)`",
    r"(?i)change\s+'([^']+)'\s+to\s+'([^']+)'",
    r"(?i)(?:replace|swap|switch)\s+'([^']+)'\s+(?:with|to|for)\s+'([^']+)'",
    r"s/([^/]+)/([^/]*)/",
    r"(\S+(?:\s+\S+){0,5})\s*(?:→|->|=>)\s*(\S+(?:\s+\S+){0,5})",
)
MENTION = r"['`]?(\S{2,})['`]?\s*(?:→|->|=>)\s*['`]?(\S{2,})['`]?"


def risk_counts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, defs, lines, tests, todos, read_first) of every text."""
    body = T.text_of(F.col(text))
    lines = T.lines(body)
    trimmed = F.transform(lines, T.trim)
    imports = F.filter(trimmed, lambda t: t.startswith("use ") | t.startswith("import ") | t.startswith("from "))
    paths = F.filter(F.transform(imports, lambda t: F.coalesce(F.get(T.words(t), F.lit(1)), F.lit(""))),
                     lambda p: (p != "") & ~p.startswith("std") & ~p.startswith("crate"))
    todos = sum((F.regexp_count(body, F.lit(w)) for w in ("FIXME", "HACK", "XXX")), F.regexp_count(body, F.lit("TODO")))
    return docs.select(
        key, F.size(F.filter(trimmed, lambda t: C.any_of(t, RISK_DEFINITIONS))).alias("defs"), F.size(lines).alias("lines"),
        F.size(F.filter(trimmed, lambda t: F.lower(t).contains("test") | F.lower(t).contains("spec"))).alias("tests"),
        todos.alias("todos"), F.slice(paths, 1, 3).alias("read_first"))


def file_risk(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, risk, reason, read_first): how risky a text is to edit."""
    n = risk_counts(docs, key, text)
    defs, lines, tests, todos = (F.col(c) for c in ("defs", "lines", "tests", "todos"))
    high = (defs > 20) & (lines > 200) & (tests < 3) & (todos > 5)
    medium = ((defs > 10) & (lines > 100) & (todos > 2)) | ((defs > 30) & (lines > 300)) | ((tests == 0) & (lines > 50))
    level = F.when(high, "high").when(medium, "medium").otherwise("low")
    s = lambda c: c.cast("string")
    reason = F.when(high, F.concat(s(defs), F.lit(" defs, "), s(lines), F.lit(" lines, "), s(tests), F.lit(" tests, "), s(todos), F.lit(" TODOs — high blast radius"))).when(
        medium, F.concat(s(defs), F.lit(" defs, "), s(lines), F.lit(" lines — moderate complexity"))).otherwise("Low risk: small file with test references")
    return n.select(key, level.alias("risk"), reason.alias("reason"), "read_first")


def exported_names(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, line_no, name) of exported definitions."""
    rows = explode_lines(docs, key, text).withColumn("t", T.trim(F.col("line"))).filter(C.any_of(F.col("t"), EXPORTS))
    words = T.words(F.col("t"))
    kind = F.array_position(F.transform(words, lambda w: w.isin(*EXPORT_KINDS)), True)
    name = F.regexp_replace(F.coalesce(F.get(words, kind.cast("int")), F.lit("")), r"(?U)[^\p{IsAlphabetic}\p{N}_]+\z", "")
    return rows.select(key, "line_no", F.when(kind > 0, name).alias("name")).filter("name <> ''")


def dead_names(docs: DataFrame, key: str = "doc_id", text: str = "text", file: str | None = None, least: int = 3,
               extra: tuple[tuple[str, str], ...] = ()) -> DataFrame:
    """(key, name, line, confidence): names defined on the only line of a text that has them, a row for each place.

    `extra` adds rules of lines that define. Lines count from 1.
    """
    path = F.col(file) if file else F.lit("")
    rows = docs.select(key, path.alias("_lw_file"), F.posexplode(T.lines(F.col(text))).alias("line_no", "line"))
    defines = C.any_of(T.trim(F.col("line")), DEAD_DEFINITIONS + extra)
    each = rows.select(key, "_lw_file", "line_no", "line", defines.alias("d"), F.explode(T.code_tokens(F.col("line"), least)).alias("name"))
    marked = each.withColumn("d", F.col("d") | F.contains("line", F.concat(F.lit("fn "), "name")) | F.contains("line", F.concat(F.lit("def "), "name")))
    once = marked.groupBy(key, "name").agg(
        F.min("line_no").alias("lo"), F.max("line_no").alias("hi"), F.count_if("d").alias("places"), F.first("_lw_file").alias("_lw_file"))
    dead = once.filter("lo = hi and places > 0")
    test = F.lit(False)
    for m in TEST_MARKS:
        test = test | F.col("_lw_file").contains(m)
    long = F.octet_length("name") >= 5
    label = F.when(test, "low").when(F.col("name").rlike(r"^[A-Z_]+\z") & long, "high").when(long, "medium").otherwise("low")
    return dead.select(key, "name", (F.col("lo") + 1).alias("line"), label.alias("confidence"), F.explode(F.sequence(F.lit(1), F.col("places").cast("int"))).alias("_lw_i")).drop("_lw_i")


def first_by_name(dead: DataFrame, key: str = "doc_id") -> DataFrame:
    """Of dead names that several texts share the first."""
    rank = F.row_number().over(Window.partitionBy("name").orderBy(key, "line"))
    return dead.withColumn("_lw_rank", rank).filter("_lw_rank = 1").drop("_lw_rank")


def confident(dead: DataFrame, least: str = "low") -> DataFrame:
    wanted = {"high": ("high",), "medium": ("high", "medium")}.get(least, ("high", "medium", "low"))
    return dead.filter(F.col("confidence").isin(*wanted))


def dead_summary(dead: DataFrame, limit: int = 10) -> DataFrame:
    """One row: totals by confidence and whether a list of `limit` would be cut."""
    n = lambda c: F.count_if(F.col("confidence") == c).alias(c)
    return dead.agg(F.count("*").alias("total"), n("high"), n("medium"), n("low")).withColumn("truncated", F.col("total") > limit)


def extract_fixes(note: Column) -> Column:
    """Array of (old, new) that a note asks for, pattern by pattern."""
    found = []
    for i, p in enumerate(FIX_PATTERNS):
        old, new = F.regexp_extract_all(note, F.lit(p), F.lit(1)), F.regexp_extract_all(note, F.lit(p), F.lit(2))
        pairs = F.zip_with(old, new, lambda a, b: F.struct(a.alias("old"), b.alias("new")))
        if i == 4:
            pairs = F.filter(pairs, lambda x: (x["new"] != "") & (x["old"] != x["new"]))
        elif i == 5:
            pairs = F.transform(pairs, lambda x: F.struct(T.trim(x["old"]).alias("old"), T.trim(x["new"]).alias("new")))
            pairs = F.filter(pairs, lambda x: (F.octet_length(x["old"]) >= 2) & (F.octet_length(x["new"]) >= 2) & (x["old"] != x["new"]))
        found.append(pairs)
    return F.concat(*found)


def apply_fixes(content: Column, fixes: Column) -> Column:
    """(text, n): fixes applied in order with the number of places; an old text that is not there is tried without quotes."""
    def step(a: Column, f: Column) -> Column:
        bare = F.regexp_replace(f["old"], "^['\"`]+|['\"`]+\\z", "")
        use = F.when(F.contains(a["text"], f["old"]), f["old"]).when((F.octet_length(bare) < F.octet_length(f["old"])) & (bare != ""), bare)
        count = (F.length(a["text"]) - F.length(F.replace(a["text"], use, F.lit("")))) / F.length(use)
        skip = use.isNull() | (f["old"] == f["new"]) | ~F.contains(a["text"], F.coalesce(use, F.lit("\0")))
        return F.struct(F.when(skip, a["text"]).otherwise(F.replace(a["text"], use, f["new"])).alias("text"),
                        (a["n"] + F.when(skip, 0).otherwise(count.cast("int"))).alias("n"))

    return F.aggregate(fixes, F.struct(content.alias("text"), F.lit(0).alias("n")), step)


def mentioned_pairs(note: Column, content: Column) -> Column:
    """(old, new) pairs of a note whose old text a content has."""
    bare = lambda x: F.regexp_replace(x, "^['\"`]+|['\"`]+\\z", "")
    old, new = F.regexp_extract_all(note, F.lit(MENTION), F.lit(1)), F.regexp_extract_all(note, F.lit(MENTION), F.lit(2))
    pairs = F.zip_with(old, new, lambda a, b: F.struct(bare(a).alias("old"), bare(b).alias("new")))
    return F.filter(pairs, lambda p: (F.octet_length(p["old"]) >= 2) & F.contains(content, p["old"]))


def find_function(rows: DataFrame, signature: str, key: str = "doc_id") -> DataFrame:
    """(key, line_no, line) of the line that best fits a signature: equal, beginning with it, or by its name."""
    t, s = T.trim(F.col("line")), F.lit(signature.strip())
    name = T.function_name(F.lit(signature))
    keyword = F.lit(False)
    for k in FUNCTION_KEYWORDS:
        keyword = keyword | t.contains(k)
    named = (F.octet_length(name) >= 3)
    tier = (F.when(t == s, 1).when(F.startswith(t, s), 2).when(named & F.contains(t, name) & keyword, 3)
            .when(named & F.contains("line", name), 4))
    return rows.withColumn("_lw_tier", tier).filter("_lw_tier is not null").groupBy(key).agg(
        F.min_by(F.struct("line_no", "line"), F.struct("_lw_tier", "line_no")).alias("b")).select(key, "b.line_no", "b.line")


def structured_summary(docs: DataFrame, key: str = "doc_id", text: str = "text", file: str | None = None) -> DataFrame:
    """(key, summary): lines, definitions and the first six of them; at most 600 characters."""
    lines = F.split(T.text_of(F.col(text)), "\n", -1)
    sigs = F.filter(lines, lambda x: x.rlike(T.SIGNATURE))
    name = F.element_at(F.split(F.col(file), "/"), -1) if file else F.col(key).cast("string")
    head = F.concat(F.lit("["), name, F.lit("] "), F.size(lines).cast("string"), F.lit("L | "), F.size(sigs).cast("string"), F.lit(" defs"))
    body = F.array_join(F.transform(F.slice(sigs, 1, 6), lambda x: F.concat(F.lit("\n  "), T.trim(x))), "")
    return docs.select(key, F.substring(F.concat(head, body), 1, 600).alias("summary"))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path.cast("string"), "/"), -1)


def read_summary(docs: DataFrame, posts: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, summary): lines and definitions, the first six with up to three other texts that hold their names, and risk.

    Keys may be paths: texts are named by their last part, and those of the same name do not count as others.
    """
    rows = explode_lines(docs, key, text)
    name = F.regexp_extract("line", T.SIGNATURE, 3)
    defs = rows.withColumn("name", name).filter("name <> ''")
    rank = F.row_number().over(Window.partitionBy(key).orderBy("line_no"))
    ranked = defs.withColumn("rank", rank).withColumn("phrase", T.stem(F.col("name")))
    shown = ranked.filter("rank <= 6")
    held = posts.join(shown.select("phrase").distinct(), "phrase", "left_semi").select("phrase", F.col(key).alias("other")).withColumn(
        "k", F.row_number().over(Window.partitionBy("phrase").orderBy("other"))).filter("k <= 4")
    callers = shown.join(held, "phrase", "left").groupBy(key, "rank", "line_no", "line").agg(
        F.slice(F.array_sort(F.collect_list(F.when(basename(F.col("other")) != basename(F.col(key)), F.col("other")))), 1, 3).alias("c"))
    note = F.when(F.size("c") > 0, F.concat(F.lit(" c: ["), F.array_join(F.transform("c", basename), ", "), F.lit("]"))).otherwise("")
    line = F.concat(F.lit("\n  L"), (F.col("line_no") + 1).cast("string"), F.lit(": "), T.trim(F.col("line")), note)
    body = callers.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("s")))), lambda x: x["s"]), "").alias("body"))
    counts = ranked.groupBy(key).agg(F.count("*").alias("defs"))
    risk = file_risk(docs, key, text).select(key, "risk", "reason")
    all_ = docs.select(key, F.size(T.lines(F.col(text))).alias("n")).join(counts, key, "left").join(body, key, "left").join(risk, key)
    tail = F.when(F.col("risk") != "low", F.concat(F.lit("\n[risk: "), F.initcap("risk"), F.lit("] "), F.substring("reason", 1, 80))).otherwise("")
    head = F.concat(F.lit("["), basename(F.col(key)), F.lit("] "), F.col("n").cast("string"), F.lit("L | "), F.coalesce("defs", F.lit(0)).cast("string"), F.lit(" defs"))
    return all_.select(key, F.concat(head, F.coalesce("body", F.lit("")), tail).alias("summary"))
