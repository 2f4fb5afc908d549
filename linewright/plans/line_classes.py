"""Queries of the line classes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from linewright.functions import classify as C
from linewright.functions import skeleton as S
from linewright.functions import text as T
from linewright.operators.lines import explode_lines
from linewright.plans import sql
from linewright.plans.registry import ORACLES, query  # noqa: F401
from linewright.sources.tables import table


def line_rows(spark, sf_dir):
    return explode_lines(table(spark, sf_dir, "documents"), "doc_id", "text")


TRIMMED = f"with {sql.lines()}, t as (select doc_id, line_no, line, {sql.trim('line')} as t, lower({sql.trim('line')}) as w from lines)\n"

GROUP_ERROR = sql.any_of("line", C.GROUP_ERROR_RULES)
PROGRESS = f"(contains(line, '%') and {sql.any_of('line', C.BAR_RULES)})"
SEPARATOR = "regexp_full_match(t, '[-=._*]+')"


@query("line_flags", TRIMMED + f"""
select doc_id, line_no, {sql.any_of('line', C.ERROR_RULES)} as is_error_line, {GROUP_ERROR} as is_error, {SEPARATOR} as is_separator,
 {PROGRESS} as is_progress, contains(line, ': ') or contains(line, '=') as is_key_value,
 (list_has_any({sql.words('lower(line)')}, ['ok', 'ok.', 'ok,', '[ok]']) and not contains(lower(line), 'not ok')) or {sql.any_of('line', C.SUMMARY_STARTS)} as is_summary,
 not {GROUP_ERROR} and (t = '' or {SEPARATOR} or {PROGRESS} or strlen(t) <= 2) as should_drop,
 {sql.any_of('t', C.INDEX_DEFINITION_RULES)} as is_definition
from t
""")
def line_flags(spark, sf_dir):
    c = F.col("line")
    return line_rows(spark, sf_dir).select(
        "doc_id", "line_no", C.is_error_line(c).alias("is_error_line"), C.is_error(c).alias("is_error"), C.is_separator(c).alias("is_separator"),
        C.is_progress(c).alias("is_progress"), C.is_key_value(c).alias("is_key_value"), C.is_summary(c).alias("is_summary"),
        C.should_drop(c).alias("should_drop"), C.is_index_definition(c).alias("is_definition"))


@query("repeat_distance", TRIMMED + """
, d as (select doc_id, line_no, t, line_no - lag(line_no) over (partition by doc_id, t order by line_no) as d from t)
select doc_id, line_no, cast(case when t = '' then 1 when d <= 20 then d else 0 end as bigint) as repeat_dist from d
""")
def repeat_distance(spark, sf_dir):
    return repeat_distances(line_rows(spark, sf_dir)).select("doc_id", "line_no", "repeat_dist")


def repeat_distances(rows):
    """Distance to the nearest equal trimmed line among the 20 before; 1 for blank lines, else 0."""
    t = rows.withColumn("t", T.trim(F.col("line")))
    w = Window.partitionBy("doc_id", "t").orderBy("line_no")
    d = F.col("line_no") - F.lag("line_no").over(w)
    found = t.withColumn("d", d)
    return found.withColumn("repeat_dist", F.when(F.col("t") == "", 1).when(F.col("d") <= 20, F.col("d")).otherwise(0).cast("long"))


ZS = r"[{}()\[\]<>;:=|&!@#$%^*\-+/?\\]"


@query("zone_by_line", TRIMMED + f"""
, z as (select doc_id, line_no, t, greatest(strlen(t), 1) as n, {sql.count_of('t', '[a-z]')} as lo, {sql.count_of('t', ZS)} as st,
  {sql.count_of('t', '[A-Za-z_][A-Za-z0-9_]{2,}')} as ids, {sql.words('t')} as ws from t)
select doc_id, line_no, cast(case when t = '' then 1 when regexp_matches(t, '^/[/*]') then 1 when starts_with(t, '#!') then 0
 when regexp_matches(t, '^(#|\\*|<!--|>)') then 1
 when lo / n > 0.65 and st / n < 0.08 and ids < 3 then 1 when ids = 0 then 1
 when lo / n > 0.5 and list_sum(list_transform(ws, lambda w: strlen(w))) / len(ws) < 6 and st / n < 0.05 and ids < 2 then 1
 when strlen(t) >= 10 and st > 2 then 0 when strlen(t) >= 10 and lo / n > 0.7 and ids <= 1 then 1 else 0 end as integer) as zone from z
""")
def zone_by_line(spark, sf_dir):
    return line_rows(spark, sf_dir).select("doc_id", "line_no", C.zone(F.col("line")).alias("zone"))


DEFINITION = f"""((regexp_matches(t, '(\\{{|=>|->|:)$') and regexp_matches(regexp_replace(t, '[{{=>\\-:]+$', ''), '[A-Za-z0-9]'))
 or ({sql.count_of('t', '[{}();=<>]')} >= 2 and contains(t, '(') and contains(t, ')')
   and {sql.count_of('t', '[{}();=<>]')} / greatest(strlen(t), 1) > 0.05 and {sql.count_of('t', '[A-Za-z]')} >= 3)
 or (contains(t, ' = ') and not contains(t, '==') and regexp_matches(split_part(t, '=', 1), '[A-Za-z0-9]')))"""

CONTENT_CLASS = f"""case when t = '' then 'blank' when regexp_full_match(t, '[-=*._~]{{3,}}') then 'separator'
 when contains(w, 'error') or starts_with(t, 'FAILED') then 'error'
 when (contains(w, 'passed') and contains(w, 'failed')) or starts_with(w, 'test result:') or starts_with(w, 'finished') or contains(t, '  --> ') then 'summary'
 when {sql.any_of('t', C.CONTENT_COMMENT_RULES)} then 'comment' when {sql.any_of('w', C.CONTENT_IMPORT_RULES)} then 'import'
 when {DEFINITION} then 'definition' else 'code' end"""


@query("content_class_by_line", TRIMMED + f"select doc_id, line_no, {CONTENT_CLASS} as class from t")
def content_class_by_line(spark, sf_dir):
    return line_rows(spark, sf_dir).select("doc_id", "line_no", C.content_class(F.col("line")).alias("class"))


PREFIX = r"regexp_extract(t, '^([^> ]*)[> ]', 1)"
BODY = f"regexp_replace(substr(t, length({PREFIX}) + 1), '^{sql.SPACE}+', '')"


@query("output_class_by_line", TRIMMED + f"""
select doc_id, line_no, case when t = '' then 'blank' when regexp_full_match(t, '[-=*_.~]{{3,}}') then 'separator'
 when {sql.any_of('t', C.OUTPUT_ERROR_RULES)} then 'error' when {sql.any_of('t', C.OUTPUT_WARNING_RULES)} then 'warning'
 when (contains(w, 'passed') and contains(w, 'failed')) or starts_with(t, 'test result:') or starts_with(t, 'Finished ') then 'summary'
 when regexp_matches(t, '^(?:running|test|tests? result)') then 'summary' when regexp_matches(t, '{C.OUTPUT_PROGRESS}') then 'progress'
 when regexp_matches(t, '[> ]') and strlen({PREFIX}) between 5 and 20 and strlen({BODY}) > 5 then 'prefix' else 'code' end as class from t
""")
def output_class_by_line(spark, sf_dir):
    return line_rows(spark, sf_dir).select("doc_id", "line_no", C.output_class(F.col("line")).alias("class"))


@query("definition_sites", f"""
with t as (select page_id, cast(unnest(range(len(ls))) as integer) as line_no, unnest(ls) as line from (select page_id, {sql.line_list('html')} as ls from pages where html <> '')),
p as (select page_id, line_no, line, list_filter({sql.pieces('line')}, lambda w: strlen(w) >= 3 and regexp_full_match(w, '[A-Za-z_][A-Za-z0-9_]*'))[1] as phrase from t),
q as (select *, instr(line, phrase) as pos from p where phrase is not null),
r as (select *, left(line, pos - 1) as b, substr(line, pos + length(phrase)) as a from q)
select page_id, line_no, phrase, pos > 0 and a <> '' and not regexp_matches(b, '[A-Za-z0-9_.]$')
 and not regexp_matches(b, '(^|[^A-Za-z0-9_])(new|import)[^A-Za-z0-9_]*$') and regexp_matches(a, '^[ \\t]*[A-Za-z0-9_]*[ \\t]*([(<\\[=:{{]|->)') as defines from r
""")
def definition_sites(spark, sf_dir):
    rows = explode_lines(table(spark, sf_dir, "pages"), "page_id", "html")
    first = rows.withColumn("phrase", F.get(T.code_tokens(F.col("line")), F.lit(0))).filter("phrase is not null")
    return first.select("page_id", "line_no", "phrase", C.is_definition_of(F.col("phrase"), F.col("line")).alias("defines"))


COLOURED = "chr(27) || '[1;3' || (event_id % 8) || 'm' || event_type || chr(27) || '[0m ' || chr(27) || ']0;' || user_id || chr(7) || ' value ' || chr(27) || '(B' || event_id"


@query("ansi_stripped", f"""
select event_id, regexp_replace(l, '{C.ANSI_ALL}', '', 'g') as wide, regexp_replace(l, '{C.ANSI_NARROW}', '', 'g') as narrow
from (select event_id, {COLOURED} as l from events)
""")
def ansi_stripped(spark, sf_dir):
    esc, line = F.char(F.lit(27)), None
    events = table(spark, sf_dir, "events")
    line = F.concat(esc, F.lit("[1;3"), (F.col("event_id") % 8).cast("string"), F.lit("m"), F.col("event_type"), esc, F.lit("[0m "), esc,
                    F.lit("]0;"), F.col("user_id").cast("string"), F.char(F.lit(7)), F.lit(" value "), esc, F.lit("(B"), F.col("event_id").cast("string"))
    return events.select("event_id", C.strip_ansi(line).alias("wide"), C.strip_ansi_narrow(line).alias("narrow"))


@query("output_skeletons")
def output_skeletons(spark, sf_dir):
    return line_rows(spark, sf_dir).select("doc_id", "line_no", S.output_skeleton(F.col("line")).alias("skeleton"))


@query("skeletons")
def skeletons(spark, sf_dir):
    c = F.col("line")
    return line_rows(spark, sf_dir).select("doc_id", "line_no", S.skeleton(c).alias("skeleton"), S.aggressive_skeleton(c).alias("template"))


@query("stripped_lines", TRIMMED + f"""
, s as (select doc_id, line_no, regexp_replace(line, '{sql.SPACE}+$', '') as s from t)
select doc_id, string_agg(s, chr(10) order by line_no) as text from s group by doc_id
""")
def stripped_lines(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    stripped = F.transform(T.lines(F.col("text")), T.trim_end)
    return docs.filter("text <> ''").select("doc_id", F.array_join(stripped, "\n").alias("text"))


@query("truncated_lines", TRIMMED + """
select doc_id, line_no, case when strlen(line) > 120 then
  left(line, len(list_filter(range(100), lambda i: i < length(line) and strlen(left(line, i)) < 100))) || '... (' || strlen(line) || ' chars)' else line end as line
from t
""")
def truncated_lines(spark, sf_dir):
    return line_rows(spark, sf_dir).select("doc_id", "line_no", C.truncate_line(F.col("line"), 120).alias("line"))


LEVELLED = "'t=' || event_id || ' [' || upper(event_type) || '] [' || event_type || '] done'"


@query("level_filter", f"select event_id, l as line from (select event_id, {LEVELLED} as l from events) where contains(l, ' [CLICK] ') or contains(l, '[click]')")
def level_filter(spark, sf_dir):
    line = F.concat(F.lit("t="), F.col("event_id").cast("string"), F.lit(" ["), F.upper("event_type"), F.lit("] ["), F.col("event_type"), F.lit("] done"))
    return table(spark, sf_dir, "events").select("event_id", line.alias("line")).filter(C.has_level(F.col("line"), "click"))


TELLING = "FAILED|panicked at|assertion|expected `true`, got `false`"


@query("error_summaries", f"""
with d as (select doc_id, {sql.line_list("coalesce(text, '')")} as ls from documents where text <> '')
select doc_id, left(coalesce(list_filter(list_transform(ls, lambda l: {sql.trim('l')}), lambda l: regexp_matches(l, '{TELLING}'))[1],
  list_filter(ls, lambda l: contains(l, 'failure'))[1], ls[1], ''), 120) as summary,
  coalesce(left(list_filter(list_transform(ls, lambda l: {sql.trim('l')}), lambda l: (contains(l, 'FAILED') and not contains(l, 'test result')) or regexp_matches(l, 'panicked at|assertion|expected `true`, got `false`'))[1], 120),
    case when len(ls) >= 3 then left(array_to_string(ls[-3:], ' | '), 150) end, 'Tests failed — reverted') as failure from d
""")
def error_summaries(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").filter("text <> ''").select("doc_id", T.lines(F.col("text")).alias("ls"))
    return docs.select("doc_id", C.error_summary(F.col("ls")).alias("summary"), C.first_failure(F.col("ls")).alias("failure"))
