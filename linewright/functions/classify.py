"""Classes and flags of lines, as Column expressions.

Three families of rules live side by side and are named by family: `zone_` for the index, `content_` for files,
`output_` for command output; plain names are those of line grouping.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from linewright.functions.text import let, trim, words

# How each rule recognises a line, as (test, text).
ERROR_RULES = (("has", "FAILED"), ("has", "Error:"), ("has", "error["), ("has", "panic"), ("has", "Traceback"),
               ("has", "Exception"), ("starts", "  --> "), ("starts", "error:"))
GROUP_ERROR_RULES = (("has", "Error:"), ("has", "error["), ("has", "FAILED"), ("starts", "  --> "), ("starts", "error:"))
BAR_RULES = (("has", "###"), ("has", "==="), ("has", "---"), ("has", "..."), ("has", "██"), ("has", "▒▒"), ("has", "░░"),
             ("has", "|||"))
SUMMARY_STARTS = (("starts", "test result:"), ("starts", "Finished"), ("starts", "Compiling"), ("starts", "Downloaded"))
OK_WORDS = ("ok", "ok.", "ok,", "[ok]")
OUTPUT_ERROR_RULES = (("starts", "error:"), ("starts", "error["), ("starts", "Error:"), ("starts", "FAILED"), ("starts", "thread '"))
OUTPUT_WARNING_RULES = (("starts", "warning:"), ("starts", "Warning:"))
CONTENT_COMMENT_RULES = (("starts", "#"), ("starts", ";"), ("starts", "%"), ("starts", "'"), ("starts", "//"), ("starts", "--"),
                         ("starts", "/*"), ("starts", "* "))
CONTENT_IMPORT_RULES = (("starts", "import "), ("starts", "from "), ("starts", "use "), ("starts", "include"),
                        ("starts", "require("), ("starts", "pub use "), ("starts", "extern crate"))
INDEX_DEFINITION_RULES = (("starts", "fn "), ("starts", "def "), ("starts", "class "), ("starts", "struct "),
                          ("starts", "enum "), ("starts", "trait "), ("starts", "pub "))

# Patterns of terminal control sequences and of command output.
ANSI_ALL = r'\x1b(?:\[[^A-Za-z~"]*[A-Za-z~"]?|[\]PX^_][^\x07\x1b]*(?:\x07|\x1b[\s\S]?)?|[\s\S])?'
ANSI_NARROW = r"\x1b(?:[@-Z\\-_]|\[[0-?]*[ -/]*[@-~]|\])"
OUTPUT_PROGRESS = r"^\s*(?:Compiling|Checking|Building|Linking|Running|Processing|Generating)\s"
OUTPUT_HEADER = r"^(?:running|test|tests? result)"
STRUCTURAL = "[{}();=<>]"
ZONE_STRUCTURAL = r"[{}()\[\]<>;:=|&!@#$%^*\-+/?\\]"


def any_of(c: Column, rules) -> Column:
    """Whether some rule holds of a string."""
    found = F.lit(False)
    for test, text in rules:
        found = found | (c.contains(text) if test == "has" else c.startswith(text))
    return found


def count_of(c: Column, characters: str) -> Column:
    """Number of characters of a class, given as a pattern of one character."""
    return F.regexp_count(c, F.lit(characters))


def is_error_line(line: Column) -> Column:
    return any_of(line, ERROR_RULES)


def strip_ansi(line: Column) -> Column:
    """Without control sequences, private strings included."""
    return F.regexp_replace(line, ANSI_ALL, "")


def strip_ansi_narrow(line: Column) -> Column:
    return F.regexp_replace(line, ANSI_NARROW, "")


def is_error(line: Column) -> Column:
    return any_of(line, GROUP_ERROR_RULES)


def is_blank(line: Column) -> Column:
    return trim(line) == ""


def is_separator(line: Column) -> Column:
    return trim(line).rlike(r"^[-=._*]+\z")


def is_progress(line: Column) -> Column:
    return line.contains("%") & any_of(line, BAR_RULES)


def is_key_value(line: Column) -> Column:
    return line.contains(": ") | line.contains("=")


def is_summary(line: Column) -> Column:
    lower = F.lower(line)
    ok = F.arrays_overlap(words(lower), F.array(*map(F.lit, OK_WORDS)))
    return (ok & ~lower.contains("not ok")) | any_of(line, SUMMARY_STARTS)


def should_drop(line: Column) -> Column:
    """Blank, separating, progress and tiny lines, unless they are errors."""
    return ~is_error(line) & (is_blank(line) | is_separator(line) | is_progress(line) | (F.octet_length(trim(line)) <= 2))


def is_index_definition(line: Column) -> Column:
    return any_of(trim(line), INDEX_DEFINITION_RULES)


def is_definition_of(phrase: Column, line: Column) -> Column:
    """Whether the first place of a phrase in a line looks like its definition."""
    at = F.instr(line, phrase)
    before = F.when(at > 1, F.substring(line, F.lit(1), at - 1)).otherwise("")
    after = F.substring(line, at + F.length(phrase), F.length(line))
    return ((at > 0) & (after != "") & ~before.rlike(r"[A-Za-z0-9_.]\z")
            & ~before.rlike(r"(^|[^A-Za-z0-9_])(new|import)[^A-Za-z0-9_]*\z")
            & after.rlike(r"^[ \t]*[A-Za-z0-9_]*[ \t]*([(<\[=:{]|->)"))


def zone(line: Column) -> Column:
    """1 for prose and comments, 0 for code."""
    return let(trim(line), lambda s: F.when(s == "", 1).when(s.rlike(r"^/[/*]"), 1).when(s.startswith("#!"), 0)
               .when(s.rlike(r"^(#|\*|<!--|>)"), 1).otherwise(let(_measures(s), _zone)))


def _measures(s: Column) -> Column:
    parts = words(s)
    mean = let(parts, lambda w: F.aggregate(w, F.lit(0), lambda a, x: a + F.octet_length(x)) / F.size(w))
    return F.struct(F.octet_length(s).cast("double").alias("n"), count_of(s, "[a-z]").alias("lower"), count_of(s, ZONE_STRUCTURAL).alias("structural"),
                    count_of(s, "[A-Za-z_][A-Za-z0-9_]{2,}").alias("names"), mean.alias("mean"))


def _zone(m: Column) -> Column:
    prose, structural, names = m["lower"] / m["n"], m["structural"] / m["n"], m["names"]
    return (
        F.when((prose > 0.65) & (structural < 0.08) & (names < 3), 1).when(names == 0, 1)
        .when((prose > 0.5) & (m["mean"] < 6.0) & (structural < 0.05) & (names < 2), 1)
        .when((m["n"] >= 10) & (m["structural"] > 2), 0).when((m["n"] >= 10) & (prose > 0.7) & (names <= 1), 1).otherwise(0)
    )


def is_definition(line: Column) -> Column:
    """By block openers, structural density or assignment; of a trimmed line."""
    opens = line.rlike(r"(\{|=>|->|:)\z") & F.regexp_replace(line, r"[{=>\-:]+\z", "").rlike("[A-Za-z0-9]")
    many = count_of(line, STRUCTURAL)
    dense = ((many >= 2) & line.contains("(") & line.contains(")") & (many / F.greatest(F.octet_length(line), F.lit(1)) > 0.05)
             & (count_of(line, "[A-Za-z]") >= 3))
    assigns = line.contains(" = ") & ~line.contains("==") & F.substring_index(line, "=", 1).rlike("[A-Za-z0-9]")
    return opens | dense | assigns


def content_class(line: Column) -> Column:
    t = trim(line)
    lower = F.lower(t)
    return (
        F.when(t == "", "blank")
        .when(t.rlike(r"^[-=*._~]{3,}\z"), "separator")
        .when(lower.contains("error") | t.startswith("FAILED"), "error")
        .when((lower.contains("passed") & lower.contains("failed")) | lower.startswith("test result:") | lower.startswith("finished")
              | t.contains("  --> "), "summary")
        .when(any_of(t, CONTENT_COMMENT_RULES), "comment")
        .when(any_of(lower, CONTENT_IMPORT_RULES), "import")
        .when(is_definition(t), "definition")
        .otherwise("code")
    )


def output_prefix(line: Column) -> Column:
    """(prefix, body) of a trimmed line: the word before the first space or > if it has 5 to 20 bytes, and over 5 after it."""
    head = F.regexp_extract(line, r"^([^> ]*)[> ]", 1)
    body = F.regexp_replace(F.substring(line, F.length(head) + 1, F.length(line)), r"(?U)^\s+", "")
    fits = line.rlike("[> ]") & F.octet_length(head).between(5, 20) & (F.octet_length(body) > 5)
    return F.when(fits, F.struct(head.alias("prefix"), body.alias("body")))


def output_class(line: Column) -> Column:
    """Class of a line of command output; control sequences are stripped first."""
    t = trim(strip_ansi_narrow(line))
    lower = F.lower(t)
    return (
        F.when(t == "", "blank").when(t.rlike(r"^[-=*_.~]{3,}\z"), "separator")
        .when(any_of(t, OUTPUT_ERROR_RULES), "error").when(any_of(t, OUTPUT_WARNING_RULES), "warning")
        .when((lower.contains("passed") & lower.contains("failed")) | t.startswith("test result:") | t.startswith("Finished "), "summary")
        .when(t.rlike(OUTPUT_HEADER), "summary").when(t.rlike(OUTPUT_PROGRESS), "progress")
        .when(output_prefix(t).isNotNull(), "prefix").otherwise("code")
    )


def truncate_line(line: Column, most: int) -> Column:
    """Longer lines cut to characters that begin before byte most - 20, with the number of bytes they had."""
    room = max(0, most - 20)
    sizes = F.transform(F.split(line, ""), F.octet_length)
    kept = F.aggregate(sizes, F.struct(F.lit(0).alias("at"), F.lit(0).alias("n")),
                       lambda a, s: F.struct((a["at"] + s).alias("at"), (a["n"] + (a["at"] < room).cast("int")).alias("n")))["n"]
    ascii_kept = F.when(F.octet_length(line) == F.length(line), F.lit(room)).otherwise(kept)
    cut = F.concat(F.substring(line, F.lit(1), ascii_kept), F.lit("... ("), F.octet_length(line).cast("string"), F.lit(" chars)"))
    return F.when(F.octet_length(line) > most, cut).otherwise(line)


def has_level(line: Column, level: str) -> Column:
    return line.contains(f" [{level.upper()}] ") | line.contains(f"[{level.lower()}]")


def error_summary(lines: Column) -> Column:
    """The first telling line of a test run's output, 120 characters of it; of an array of lines."""
    telling = F.filter(F.transform(lines, trim), lambda t: t.rlike("FAILED|panicked at|assertion|expected `true`, got `false`"))
    failing = F.filter(lines, lambda x: x.contains("failure"))
    return F.substring(F.coalesce(F.get(telling, F.lit(0)), F.get(failing, F.lit(0)), F.get(lines, F.lit(0)), F.lit("")), 1, 120)


def first_failure(lines: Column) -> Column:
    """As error_summary, without result lines; failing that the last three lines, or that all was undone."""
    telling = F.filter(F.transform(lines, trim), lambda t: (t.contains("FAILED") & ~t.contains("test result"))
                       | t.rlike("panicked at|assertion|expected `true`, got `false`"))
    last = F.substring(F.array_join(F.slice(lines, F.greatest(F.size(lines) - 2, F.lit(1)), 3), " | "), 1, 150)
    return F.coalesce(F.substring(F.get(telling, F.lit(0)), 1, 120), F.when(F.size(lines) >= 3, last), F.lit("Tests failed — reverted"))
