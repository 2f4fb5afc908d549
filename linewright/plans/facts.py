"""Queries of quality measures and of facts about source."""

from __future__ import annotations

from pyspark.sql import functions as F

from linewright.functions import classify as C
from linewright.operators import code, index, quality
from linewright.plans import sql
from linewright.plans.line_classes import CONTENT_CLASS, line_rows
from linewright.plans.registry import query
from linewright.sources.tables import table


def docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


@query("entropy", """
with b as (select doc_id, unnest(regexp_extract_all(hex(text), '..')) as b from documents where text <> ''),
c as (select doc_id, b, count(*) as n from b group by all), t as (select doc_id, sum(n) as total from c group by all)
select doc_id, round(-sum(n / total * log2(n / total)), 6) as entropy from c join t using (doc_id) group by doc_id
""")
def entropy(spark, sf_dir):
    return quality.byte_measures(docs(spark, sf_dir).filter("text <> ''")).select("doc_id", F.round("entropy", 6).alias("entropy"))


@query("lexical_diversity", f"select doc_id, round(case when len(w) = 0 then 0.0 else len(list_distinct(w)) / len(w) end, 9) as diversity from (select doc_id, {sql.words('text')} as w from documents)")
def lexical_diversity(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.round(quality.lexical_diversity(F.col("text")), 9).alias("diversity"))


@query("maxwell_gate")
def maxwell_gate(spark, sf_dir):
    return quality.gate(docs(spark, sf_dir))


@query("preservation_srcr", f"""
with d as (select doc_id, text, left(text, cast(floor(length(text) / 2) as bigint)) as c from documents),
t as (select doc_id, text, c, strlen(text) as a, strlen(c) as b, list_distinct(list_filter({sql.pieces('text')}, lambda w: strlen(w) >= 4)) as ts from d),
k as (select doc_id, a, b, case when a < 50 or b >= a or len(ts) = 0 then 1.0 else len(list_filter(ts, lambda w: contains(c, w))) / len(ts) end as kept, case when a < 50 or b >= a then 0.0 else greatest(1.0 - b / a, 0.0) end as saved from t)
select doc_id, round(kept * saved, 9) as srcr, round(kept, 9) as preservation, round(saved, 9) as compression from k
""")
def preservation_srcr(spark, sf_dir):
    half = F.substring("text", F.lit(1), F.floor(F.length("text") / 2).cast("int"))
    scored = docs(spark, sf_dir).select("doc_id", F.col("text"), half.alias("c")).select("doc_id", quality.srcr(F.col("text"), F.col("c")).alias("s"))
    return scored.select("doc_id", *[F.round(f"s.{c}", 9).alias(c) for c in ("srcr", "preservation", "compression")])


@query("template_concentration")
def template_concentration(spark, sf_dir):
    return quality.template_concentration(line_rows(spark, sf_dir))


COLON = "event_type || (case when event_id % 7 = 0 then '-' || (event_id % 5) else '' end) || ': ' || event_id"


@query("prefix_concentration", f"""
with l as (select user_id, split_part({COLON}, ':', 1) as p from events),
c as (select user_id, p, count(*) as k from l group by all), t as (select user_id, sum(k) as total from c group by all),
r as (select c.*, t.total, row_number() over (partition by c.user_id order by c.k desc, c.p desc) as rank from c join t using (user_id))
select user_id, p as prefix from r where rank = 1 and total >= 5 and k / total > 0.2
""".replace("> 0.2", "> 0.5"))
def prefix_concentration(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    odd = F.when(F.col("event_id") % 7 == 0, F.concat(F.lit("-"), (F.col("event_id") % 5).cast("string"))).otherwise("")
    rows = events.select("user_id", F.concat("event_type", odd, F.lit(": "), F.col("event_id").cast("string")).alias("line"))
    return quality.prefix_concentration(rows, "user_id")


@query("source_content", f"""
with {sql.lines()}, t as (select doc_id, line, {sql.trim('line')} as t, lower({sql.trim('line')}) as w from lines),
c as (select doc_id, line, {CONTENT_CLASS} as class from t),
s as (select doc_id, count(*) as n, count(*) filter (where class <> 'blank') as full_, count(*) filter (where contains(line, 'warning:') or starts_with(line, '  --> ')) as warns,
 sum(strlen(line)) filter (where class <> 'blank') as chars, sum({sql.count_of('line', C.STRUCTURAL)}) filter (where class <> 'blank') as marks, count(*) filter (where class in ('definition', 'import')) as defs from c group by doc_id)
select doc_id, coalesce(n >= 20 and full_ >= 10 and warns < 3 and marks / greatest(chars, 1) >= 0.02 and defs > floor(full_ / 10), false) as content from s
""")
def source_content(spark, sf_dir):
    return quality.looks_like_content(docs(spark, sf_dir))


PAIRS = """p as (select a.conv_id, a.turn, a.text as truth, b.text as prediction from conversations a join conversations b on a.conv_id = b.conv_id and b.turn = a.turn + 1 where a.role = 'user' and b.role = 'assistant')"""


def pairs(spark, sf_dir):
    talk = table(spark, sf_dir, "conversations")
    a = talk.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("truth"))
    b = talk.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("prediction"))
    return a.join(b, ["conv_id", "turn"])


NORM = "list_filter(" + sql.words("regexp_replace(lower({x}), '[!-/:-@\\[-`{-~]', '', 'g')") + ", lambda w: w not in ('a', 'an', 'the'))"
F1 = f"""{PAIRS}, n as (select conv_id, turn, {NORM.replace('{x}', 'prediction')} as p, {NORM.replace('{x}', 'truth')} as t from p),
w as (select conv_id, turn, unnest(p) as w, 1 as a, 0 as b from n union all select conv_id, turn, unnest(t), 0, 1 from n),
c as (select conv_id, turn, w, least(sum(a), sum(b)) as k from w group by all), s as (select conv_id, turn, sum(k) as same from c group by all),
f as (select n.conv_id, n.turn, case when len(p) = 0 or len(t) = 0 then case when len(p) = len(t) then 1.0 else 0.0 end when same = 0 then 0.0 else 2.0 * same / (len(p) + len(t)) end as f1,
 cast(case when array_to_string(p, ' ') = array_to_string(t, ' ') then 1.0 else 0.0 end as double) as exact from n left join s using (conv_id, turn))"""


@query("token_f1", f"with {F1} select conv_id, turn, round(f1, 9) as f1, exact from f")
def token_f1(spark, sf_dir):
    scored = quality.token_overlap(pairs(spark, sf_dir), ("conv_id", "turn"))
    return scored.select("conv_id", "turn", F.round("f1", 9).alias("f1"), "exact")


@query("refusals", "select conv_id, turn, " + " or ".join(f"contains(lower(t), '{m.replace(chr(39), chr(39) * 2)}')" for m in quality.REFUSALS) + """ as refuses
from (select conv_id, turn, case when turn % 5 = 1 then 'I do not KNOW. ' || text else text end as t from conversations)""")
def refusals(spark, sf_dir):
    text = F.when(F.col("turn") % 5 == 1, F.concat(F.lit("I do not KNOW. "), "text")).otherwise(F.col("text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", quality.refuses(text).alias("refuses"))


@query("retention_table", f"""
with {F1}, t as (select 'mod' || (conv_id % 3) as condition, f1, cast(conv_id + turn as double) as cost from f),
m as (select condition, avg(f1) as f1, avg(cost) as cost, count(*) as n from t group by all), b as (select f1 as f0, cost as c0 from m where condition = 'mod0')
select condition, round(f1, 6) as f1, round(cost, 6) as cost, n, round((cost - c0) / c0 * 100, 6) as delta, round(case when f0 > 0 then f1 / f0 * 100 else 0 end, 6) as retention,
 case when (case when f0 > 0 then f1 / f0 * 100 else 0 end) >= 95 then 'PASS' else 'FAIL' end as verdict from m, b
""")
def retention_table(spark, sf_dir):
    scored = quality.token_overlap(pairs(spark, sf_dir), ("conv_id", "turn"))
    trials = scored.select(F.concat(F.lit("mod"), (F.col("conv_id") % 3).cast("string")).alias("condition"), "f1", (F.col("conv_id") + F.col("turn")).cast("double").alias("cost"))
    return quality.retention(trials, "condition", "mod0")


@query("call_match_f1", "select event_id, case when event_type = 'view' or cast(props ->> 'k' as bigint) = event_id % 3 then cast(2 as double) / 3 else 0.0 end as f1 from events")
def call_match_f1(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    call = lambda name, args: F.struct(name.alias("name"), args.alias("arguments"))
    other = F.to_json(F.struct((F.col("event_id") % 3).alias("k")))
    rows = events.select("event_id", F.array(call(F.col("event_type"), F.col("props"))).alias("expected"),
                         F.array(call(F.col("event_type"), other), call(F.lit("view"), F.col("props"))).alias("predicted"))
    return quality.call_matches(rows, "event_id")


@query("file_risk", f"""
with d as (select doc_id, coalesce(text, '') as x, {sql.line_list("coalesce(text, '')")} as ls from documents),
n as (select doc_id, x, case when x = '' then [] else list_transform(ls, lambda l: {sql.trim('l')}) end as ts from d),
c as (select doc_id, len(ts) as lines, len(list_filter(ts, lambda t: {sql.any_of('t', code.RISK_DEFINITIONS)})) as defs,
 len(list_filter(ts, lambda t: contains(lower(t), 'test') or contains(lower(t), 'spec'))) as tests,
 len(regexp_extract_all(x, 'TODO|FIXME|HACK|XXX')) as todos from n)
select doc_id, case when defs > 20 and lines > 200 and tests < 3 and todos > 5 then 'high'
 when (defs > 10 and lines > 100 and todos > 2) or (defs > 30 and lines > 300) or (tests = 0 and lines > 50) then 'medium' else 'low' end as risk,
 case when defs > 20 and lines > 200 and tests < 3 and todos > 5 then defs || ' defs, ' || lines || ' lines, ' || tests || ' tests, ' || todos || ' TODOs — high blast radius'
 when (defs > 10 and lines > 100 and todos > 2) or (defs > 30 and lines > 300) or (tests = 0 and lines > 50) then defs || ' defs, ' || lines || ' lines — moderate complexity'
 else 'Low risk: small file with test references' end as reason from c
""")
def file_risk(spark, sf_dir):
    return code.file_risk(docs(spark, sf_dir)).select("doc_id", "risk", "reason")


# Source text from the benchmark's words, as the tables have none.
SOURCE = "'pub fn name_' || item_id || '(x) {' || chr(10) || 'use other::thing' || chr(10) || 'const LIMIT_' || (item_id % 3) || ' = 1' || chr(10) || text || chr(10) || 'name_' || (item_id + 1) || ' LIMIT_1 // TODO'"


def sources(spark, sf_dir):
    i = F.col("item_id")
    s = lambda c: c.cast("string")
    body = F.concat(F.lit("pub fn name_"), s(i), F.lit("(x) {\nuse other::thing\nconst LIMIT_"), s(i % 3), F.lit(" = 1\n"), F.col("text"), F.lit("\nname_"), s(i + 1), F.lit(" LIMIT_1 // TODO"))
    return table(spark, sf_dir, "benchmark").select(i.alias("doc_id"), body.alias("text"))


SRC = f"src as (select item_id as doc_id, {SOURCE} as text from benchmark), {sql.lines('src')}, t as (select doc_id, line_no, line, {sql.trim('line')} as t from lines)"


@query("blast_radius", f"""
with {SRC}, w as (select doc_id, line_no, {sql.words('t')} as ws from t where {sql.any_of('t', code.EXPORTS)}),
n as (select doc_id, line_no, regexp_replace(ws[list_position(list_transform(ws, lambda w: w in ({sql.quoted(code.EXPORT_KINDS)})), true) + 1], '[^\\p{{L}}\\p{{N}}_]+$', '') as name from w)
select doc_id, cast(line_no as integer) as line_no, name from n where name <> ''
""")
def blast_radius(spark, sf_dir):
    return code.exported_names(sources(spark, sf_dir))


DEAD = f"""with {SRC}, k as (select doc_id, line_no, line, {sql.any_of('t', code.DEAD_DEFINITIONS)} as d, unnest({sql.pieces('line')}) as name from t),
m as (select doc_id, name, line_no, d or contains(line, 'fn ' || name) or contains(line, 'def ' || name) as d from k where strlen(name) >= 3 and regexp_full_match(name, '[A-Za-z_][A-Za-z0-9_]*')),
o as (select doc_id, name, min(line_no) as lo, max(line_no) as hi, cast(sum(cast(d as integer)) as bigint) as places from m group by all),
e as (select doc_id, name, cast(lo + 1 as integer) as line, unnest(range(places)) as i from o where lo = hi and places > 0),
dead as (select doc_id, name, line, case when regexp_full_match(name, '[A-Z_]+') and strlen(name) >= 5 then 'high' when strlen(name) >= 5 then 'medium' else 'low' end as confidence from e)"""


@query("dead_identifiers", DEAD + " select * from dead")
def dead_identifiers(spark, sf_dir):
    return code.dead_names(sources(spark, sf_dir))


@query("dead_first_by_name", DEAD + " select doc_id, name, line, confidence from (select *, row_number() over (partition by name order by doc_id, line) as k from dead) where k = 1")
def dead_first_by_name(spark, sf_dir):
    return code.first_by_name(code.dead_names(sources(spark, sf_dir)))


@query("dead_summary", DEAD + " select count(*) as total, count(*) filter (where confidence = 'high') as high, count(*) filter (where confidence = 'medium') as medium, count(*) filter (where confidence = 'low') as low, count(*) > 10 as truncated from dead where confidence in ('high', 'medium')")
def dead_summary(spark, sf_dir):
    return code.dead_summary(code.confident(code.dead_names(sources(spark, sf_dir)), "medium"))


@query("extracted_fixes", """
with n as (select n_nationkey, 'rename ''a' || n_nationkey || ''' -> ''b' || n_nationkey || '''; s/old_' || n_name || '/new/ and change ''x'' to ''y''' as note from nation)
select n_nationkey, 'a' || n_nationkey as old, 'b' || n_nationkey as new, 0 as i from n union all select n_nationkey, 'x', 'y', 1 from n
union all select n_nationkey, 'old_' || regexp_extract(note, 'old_([^/]*)/', 1), 'new', 2 from n
union all select n_nationkey, 'rename ''a' || n_nationkey || '''', '''b' || n_nationkey || '''; s/old_' || regexp_extract(note, 'old_([^/]*)/', 1) || '/new/ and change ''x'' to', 3 from n
""")
def extracted_fixes(spark, sf_dir):
    s = F.col("n_nationkey").cast("string")
    note = F.concat(F.lit("rename 'a"), s, F.lit("' -> 'b"), s, F.lit("'; s/old_"), F.col("n_name"), F.lit("/new/ and change 'x' to 'y'"))
    rows = table(spark, sf_dir, "nation").select("n_nationkey", F.posexplode(code.extract_fixes(note)).alias("i", "f"))
    return rows.select("n_nationkey", "f.old", "f.new", "i")


@query("applied_fixes", "select doc_id, replace(replace(text, 'the', 'THE'), 'tion', 'TION') as text, cast((length(text) - length(replace(text, 'the', ''))) // 3 + (length(text) - length(replace(text, 'tion', ''))) // 4 as integer) as n from documents")
def applied_fixes(spark, sf_dir):
    fix = lambda a, b: F.struct(F.lit(a).alias("old"), F.lit(b).alias("new"))
    fixes = F.array(fix("'the'", "THE"), fix("tion", "TION"), fix("same", "same"))
    return docs(spark, sf_dir).select("doc_id", code.apply_fixes(F.col("text"), fixes).alias("f")).select("doc_id", "f.text", "f.n")


@query("mentioned_pairs", "select doc_id, case when contains(text, 'the') then 1 else 0 end + case when contains(text, 'tion') then 1 else 0 end as n from documents")
def mentioned_pairs(spark, sf_dir):
    note = F.lit("use 'the' -> 'a'; `tion` => `x`; \"zzzzqq\" -> 'b'")
    return docs(spark, sf_dir).select("doc_id", F.size(code.mentioned_pairs(note, F.col("text"))).alias("n"))


@query("found_functions", f"""
with {SRC}, c as (select doc_id, line_no, line, case when t = 'name_1(x)' then 1 when starts_with(t, 'name_1(x)') then 2 when contains(t, 'name_1') and regexp_matches(t, 'fn |def |function |pub |struct |class |trait |impl |enum ') then 3 when contains(line, 'name_1') then 4 end as tier from t),
r as (select *, row_number() over (partition by doc_id order by tier, line_no) as k from c where tier is not null)
select doc_id, cast(line_no as integer) as line_no, line from r where k = 1
""")
def found_functions(spark, sf_dir):
    from linewright.operators.lines import explode_lines

    return code.find_function(explode_lines(sources(spark, sf_dir), "doc_id", "text"), "name_1(x)")


@query("structured_summaries", f"""
with src as (select item_id as doc_id, {SOURCE} as text from benchmark)
select doc_id, left('[' || doc_id || '] ' || len(string_split(text, chr(10))) || 'L | 1 defs' || chr(10) || '  ' || string_split(text, chr(10))[1], 600) as summary from src
""")
def structured_summaries(spark, sf_dir):
    return code.structured_summary(sources(spark, sf_dir))


@query("read_summaries")
def read_summaries(spark, sf_dir):
    rows = sources(spark, sf_dir)
    return code.read_summary(rows, index.postings(rows))
