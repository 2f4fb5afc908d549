"""Queries of the run operators. Prose has no progress lines, so words and endings that it has stand for them."""

from __future__ import annotations

from pyspark.sql import functions as F

from linewright.functions import classify as C
from linewright.operators import runs
from linewright.plans import sql
from linewright.plans.line_classes import ORACLES, line_rows
from linewright.plans.registry import query
from linewright.sources.tables import table

L = f"with {sql.lines()}, t as (select doc_id, line_no, line, {sql.trim('line')} as t from lines)\n"
WORDS = ("The", "De", "La", "In", "Die")


@query("collapse_blank", L + """
, b as (select *, t = '' and coalesce(lag(t) over (partition by doc_id order by line_no) = '', false) as again from t)
select doc_id, line_no, line from b where not again
""")
def collapse_blank(spark, sf_dir):
    return runs.collapse_blanks(line_rows(spark, sf_dir), "doc_id")


@query("error_blocks", L + """
, p as (select *, sum(case when t = '' then 1 else 0 end) over (partition by doc_id order by line_no) as part from t),
f as (select *, min(case when contains(line, 'token') and t <> '' then line_no end) over (partition by doc_id, part) as first from p),
g as (select *, t <> '' and line_no >= first and first is not null as merged from f)
select doc_id, min(line_no) as line_no, true as merged, string_agg(t, chr(10) || '┃ ' order by line_no) as line from g where merged group by doc_id, part
union all select doc_id, line_no, false, line from g where not merged
""")
def error_blocks(spark, sf_dir):
    return runs.error_blocks(line_rows(spark, sf_dir), "doc_id", lambda c: c.contains("token"))


@query("output_error_runs", L + """
, e as (select *, contains(t, 'ation') as err from t),
n as (select *, case when not err or not coalesce(lag(err) over (partition by doc_id order by line_no), false) then 1 else 0 end as new from e),
r as (select *, sum(new) over (partition by doc_id order by line_no) as run from n),
g as (select doc_id, run, min(line_no) as l, count(*) as n, arg_min(line, line_no) as line from r group by all)
select doc_id, cast(l as double) as line_no, line from g union all
select doc_id, l + 0.5, '  [error: ' || (n - 1) || ' additional lines]' from g where n > 1
""")
def output_error_runs(spark, sf_dir):
    return runs.output_error_runs(line_rows(spark, sf_dir), "doc_id", lambda c: c.contains("ation"))


@query("ok_runs", L + """
, e as (select *, right(t, 1) = '.' as ok from t),
n as (select *, case when not ok or not coalesce(lag(ok) over (partition by doc_id order by line_no), false) then 1 else 0 end as new from e),
r as (select *, sum(new) over (partition by doc_id order by line_no) as run from n),
c as (select *, count(*) over (partition by doc_id, run) as k, min(line_no) over (partition by doc_id, run) as first from r)
select doc_id, line_no, case when ok and k >= 3 then '[' || k || ' ok]' else line end as line from c where not (ok and k >= 3) or line_no = first
""")
def ok_runs(spark, sf_dir):
    return runs.ok_runs(line_rows(spark, sf_dir), "doc_id", lambda c: c.endswith("."))


@query("prefix_runs", L + f"""
, w as (select *, regexp_extract(t, '^\\S+', 0) as word from t),
p as (select *, {' or '.join(f"starts_with(word, '{x}')" for x in WORDS)} as prog from w),
n as (select *, case when prog and word = lag(word) over (partition by doc_id order by line_no) then 0 else 1 end as new from p),
r as (select *, sum(new) over (partition by doc_id order by line_no) as run from n),
c as (select *, count(*) over (partition by doc_id, run) as k, min(line_no) over (partition by doc_id, run) as first from r)
select doc_id, line_no, case when prog and k >= 2 then '[' || k || ' ' || word || ' ...] (' || k || ' lines)' else line end as line from c where not (prog and k >= 2) or line_no = first
""")
def prefix_runs(spark, sf_dir):
    return runs.prefix_runs(line_rows(spark, sf_dir), "doc_id", WORDS, least=2)


@query("diff_runs", L + """
, e as (select *, regexp_full_match(t, '[-=._*]+') or starts_with(t, '--- ') or starts_with(t, '+++ ') or (starts_with(t, '@@ -') and contains(t, ' +') and right(t, 2) = '@@') or t = '' as plain from t),
n as (select *, case when not plain and line = lag(line) over (partition by doc_id order by line_no) and not lag(plain) over (partition by doc_id order by line_no) then 0 else 1 end as new from e),
r as (select *, sum(new) over (partition by doc_id order by line_no) as run from n where t <> ''),
c as (select *, count(*) over (partition by doc_id, run) as k, min(line_no) over (partition by doc_id, run) as first from r)
select doc_id, line_no, case when not plain and k >= 3 then '[' || k || ' identical context lines]' else line end as line from c where plain or k < 3 or line_no = first
""")
def diff_runs(spark, sf_dir):
    return runs.diff_runs(line_rows(spark, sf_dir), "doc_id")


@query("zone_truncate", L + """
, n as (select *, count(*) over (partition by doc_id) as k from t)
select doc_id, line_no, case when k > 8 and line_no = 5 then '[... ' || (k - 8) || ' lines omitted ...]' else line end as line from n
where k <= 8 or line_no <= 5 or line_no >= k - 3
""")
def zone_truncate(spark, sf_dir):
    return runs.zone_truncate(line_rows(spark, sf_dir), "doc_id", 5, 3)


@query("zone_truncate_info", L + f"""
, n as (select *, count(*) over (partition by doc_id) as k from t),
s as (select *, strlen(line) / 1000.0 + case when {sql.any_of('line', C.ERROR_RULES)} then 10.0 else 0.0 end + case when line_no < 3 or line_no >= k - 3 then 0.5 else 0.0 end as s from n),
r as (select *, k <= 6 or row_number() over (partition by doc_id order by s desc, line_no) <= 6 as kept from s),
g as (select *, case when kept or coalesce(lag(kept) over (partition by doc_id order by line_no), true) then 1 else 0 end as new from r),
h as (select *, sum(new) over (partition by doc_id order by line_no) as run from g),
c as (select *, count(*) over (partition by doc_id, run) as m, min(line_no) over (partition by doc_id, run) as first from h)
select doc_id, line_no, case when kept then line else '[…' || m || ' lines…]' end as line from c where kept or line_no = first
""")
def zone_truncate_info(spark, sf_dir):
    return runs.zone_truncate_info(line_rows(spark, sf_dir), "doc_id", 6, F.octet_length("line") / 1000.0)


@query("gate_runs", L + """
, e as (select *, case when t = '' then 'blank' when regexp_matches(t, '^(The|De)\\b') then 'progress' when right(t, 1) = '.' then 'ok' else 'code' end as c from t),
n as (select *, case when c = lag(c) over (partition by doc_id order by line_no) then 0 else 1 end as new from e),
r as (select *, sum(new) over (partition by doc_id order by line_no) as run from n),
k as (select *, count(*) over (partition by doc_id, run) as k, min(line_no) over (partition by doc_id, run) as first from r)
select doc_id, line_no, case when k < 2 or c = 'code' then line when c = 'ok' then '[' || k || ' ok]' when c = 'blank' then ''
  else '[' || k || ' ' || regexp_extract(first_value(t) over (partition by doc_id, run order by line_no), '^\\S*', 0) || ' ...]' end as line
from k where k < 2 or c = 'code' or line_no = first
""")
def gate_runs(spark, sf_dir):
    def classes(line):
        t = runs.T.trim(line)
        return F.when(t == "", "blank").when(t.rlike(r"^(The|De)\b"), "progress").when(t.endswith("."), "ok").otherwise("code")

    return runs.gate_runs(line_rows(spark, sf_dir), "doc_id", 2, classes)


@query("compress_output", L + f"""
, cls as ({ORACLES['output_class_by_line']}),
e as (select t.*, cls.class in ('error', 'warning') or (cls.class = 'summary' and contains(line, '  --> ')) as err from t join cls using (doc_id, line_no)),
a as (select doc_id, max(line_no) + 1 as n, bool_or(err or t = '' or contains(t, '... ok') or t = 'ok' or regexp_matches(t, '^(Compiling|Checking|Building|Linking|Running)')) as touched from e group by all)
select doc_id, text from documents where doc_id not in (select doc_id from a where touched and n > 15)
union all select doc_id, text from documents where doc_id in (select doc_id from a where touched and n > 15)
""")
def compress_output(spark, sf_dir):
    return runs.compress_output(table(spark, sf_dir, "documents"))


@query("function_ends", L + """
, d as (select doc_id, line_no, t = '' or starts_with(t, '#') or starts_with(t, '//') as skip, strlen(line) - strlen(regexp_replace(line, '^[\\s\\x0B]+', '')) as deep from t),
s as (select doc_id, cast(line_no + 1 as integer) as start, cast(line_no % 7 as integer) as indent from t where regexp_matches(t, '^[A-Z]')),
e as (select * replace (case when skip then 99 else strlen(line_) % 11 end as deep) from (select d.*, t.line as line_ from d join t using (doc_id, line_no))),
x as (select s.doc_id, s.start, s.indent, (select min(e.line_no) from e where e.doc_id = s.doc_id and e.line_no >= s.start and not e.skip and e.deep <= s.indent) as stop from s),
m as (select doc_id, max(line_no) as last from t group by all),
b as (select x.doc_id, x.start, m.last, x.stop, (select max(e.line_no) from e where e.doc_id = x.doc_id and e.line_no >= x.start and e.line_no < x.stop and not e.skip) as body from x join m using (doc_id) where x.start <= m.last)
select doc_id, start, cast(case when stop is null then last when body is not null then body else greatest(stop - 1, 0) end as integer) as "end" from b
""")
def function_ends(spark, sf_dir):
    """Prose has no indentation: lines are indented by their bytes, and every line with a capital is a start of some indent."""
    rows = line_rows(spark, sf_dir)
    trimmed = runs.T.trim(F.col("line"))
    starts = rows.filter(trimmed.rlike("^[A-Z]")).select("doc_id", (F.col("line_no") + 1).alias("start"), (F.col("line_no") % 7).cast("int").alias("indent"))
    indented = rows.withColumn("line", F.concat(F.repeat(F.lit(" "), (F.octet_length("line") % 11).cast("int")), trimmed))
    return runs.function_ends(indented, starts, "doc_id")
