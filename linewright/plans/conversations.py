"""Queries of the conversation steps. Replies stand for tool results where the tables have none."""

from __future__ import annotations

from pyspark.sql import functions as F

from linewright.functions import text as T
from linewright.operators import compress, convo, guard
from linewright.operators.lines import explode_lines
from linewright.plans import sql
from linewright.plans.registry import query
from linewright.sources.tables import table


def talk(spark, sf_dir):
    return table(spark, sf_dir, "conversations")


# The tables have no empty replies, repeats or old roles: some are made from rows that are there.
MADE_SQL = """made as (select conv_id, turn, case when role = 'system' then 'developer' else role end as role, case when role = 'assistant' and turn % 4 = 1 then '' else text end as text from conversations
 union all select conv_id, turn + 100, role, text from conversations where turn % 3 = 0)"""


def made(spark, sf_dir):
    rows = talk(spark, sf_dir)
    first = rows.select("conv_id", "turn", F.when(F.col("role") == "system", "developer").otherwise(F.col("role")).alias("role"),
                        F.when((F.col("role") == "assistant") & (F.col("turn") % 4 == 1), "").otherwise(F.col("text")).alias("text"))
    return first.unionByName(rows.filter("turn % 3 = 0").withColumn("turn", F.col("turn") + 100).select("conv_id", "turn", "role", "text"))


EMPTY = "select conv_id, turn, role, text from (select *, lead(turn) over (partition by conv_id order by turn) as nxt from {t}) where not (role = 'assistant' and text = '' and nxt is not null)"
ROLES = "select conv_id, turn, case when role in ('developer', 'latest_reminder') then 'system' else role end as role, text from {t}"
TURNS = "select *, sum(case when role = 'user' then 1 else 0 end) over (partition by conv_id order by turn) as user_turns from {t}"
OLD = "select conv_id, turn, role, case when role = 'assistant' and user_turns > 1 and strlen(text) > 100 then '[tool result: ' || strlen(text) || ' chars — collapsed]' else text end as text from (" + TURNS + ")"
REPEATS = "select conv_id, turn, role, text from (select *, row_number() over (partition by conv_id, role, text order by turn) as k from {t}) where k = 1 or text = '' or role in ('tool', 'toolResult')"
SYSTEM = """select conv_id, turn, role, case when role = 'system' and first and users >= 2 then '[system prompt cached]' else text end as text from (
 select *, lag(turn) over (partition by conv_id order by turn) is null as first, sum(case when role = 'user' then 1 else 0 end) over (partition by conv_id) as users from {t})"""


@query("convo_drop_empty", f"with {MADE_SQL} " + EMPTY.format(t="made"))
def convo_drop_empty(spark, sf_dir):
    return convo.drop_empty_replies(made(spark, sf_dir))


@query("convo_roles", f"with {MADE_SQL} " + ROLES.format(t="made"))
def convo_roles(spark, sf_dir):
    return convo.normalise_roles(made(spark, sf_dir))


@query("convo_turns", f"select conv_id, turn, cast(user_turns as bigint) as user_turns from ({TURNS.format(t='conversations')})")
def convo_turns(spark, sf_dir):
    return convo.user_turns(talk(spark, sf_dir)).select("conv_id", "turn", "user_turns")


@query("convo_context_filter", OLD.format(t="conversations"))
def convo_context_filter(spark, sf_dir):
    return convo.collapse_old_results(talk(spark, sf_dir), after=1, roles=("assistant",))


@query("convo_dedup", f"with {MADE_SQL} " + REPEATS.format(t="made"))
def convo_dedup(spark, sf_dir):
    return convo.drop_repeats(made(spark, sf_dir))


@query("convo_system_strip", SYSTEM.format(t="conversations"))
def convo_system_strip(spark, sf_dir):
    return convo.strip_system(talk(spark, sf_dir))


@query("convo_pipeline", f"with {MADE_SQL}, a as ({EMPTY.format(t='made')}), b as ({ROLES.format(t='a')}), c as ({OLD.format(t='b')}), d as ({REPEATS.format(t='c')}) {SYSTEM.format(t='d')}")
def convo_pipeline(spark, sf_dir):
    return convo.clean(made(spark, sf_dir), after=1, roles=("assistant",))


ERASED = f"""
w as (select conv_id, turn, strlen(text) as was, unnest(range(len(ws))) as i, unnest(ws) as word, len(ws) as total from (select *, {sql.words('text')} as ws from {{t}}) where strlen(text) >= 100 and len(ws) >= 10),
c as (select *, -log2(count(*) over (partition by conv_id, turn, word) / total) as cost, strlen(word) > 2 and not regexp_matches(word, '[0-9(){{}}\\[\\]<>=:;]') as free from w),
s as (select *, coalesce(sum(case when free then cost else 0 end) over (partition by conv_id, turn order by cost, i rows between unbounded preceding and 1 preceding), 0) as spent from c),
g as (select *, free and spent < 50 as gone from s),
h as (select *, gone and coalesce(lag(gone) over (partition by conv_id, turn order by i), false) as again from g),
e as (select conv_id, turn, string_agg(case when gone then '_' else word end, ' ' order by i) as text, min(was) as was from h where not again group by all)
"""


@query("entropy_erasure", "with a as (select * from conversations where role = 'assistant'), " + ERASED.replace("{t}", "a") + " select conv_id, turn, text from e where strlen(text) < was")
def entropy_erasure(spark, sf_dir):
    return compress.erase_common_words(talk(spark, sf_dir).filter("role = 'assistant'"), ("conv_id", "turn"))


@query("history_saved", "with n as (select *, count(*) over (partition by conv_id) as k from conversations), a as (select * from n where k > 2 and role = 'assistant'), " + ERASED.replace("{t}", "a")
       + " select conv_id, cast(sum(was - strlen(text)) as bigint) as saved from (select * from e where strlen(text) < was) group by conv_id")
def history_saved(spark, sf_dir):
    return convo.compress_history(talk(spark, sf_dir)).groupBy("conv_id").agg(F.sum("saved").cast("bigint").alias("saved")).filter("saved > 0")


OPENERS = ("Let me check this first. ", "Based on the text. So, ", "Now I can see it, basically. ")


def phrases_sql(x):
    """SQL that removes the phrases one after the other, then runs of white space."""
    for p in compress.PHRASES:
        x = f"regexp_replace({x}, '(?i){p.replace(chr(39), chr(39) * 2)}', ' ', 'g')"
    return f"array_to_string({sql.words(x)}, ' ')"


@query("reasoning_phrases", f"""
with r as (select conv_id, turn, repeat(case turn % 3 when 0 then '{OPENERS[0]}' when 1 then '{OPENERS[1]}' else '{OPENERS[2]}' end, 8) || 'That is ' || text as text from conversations where role = 'assistant'),
k as (select conv_id, turn, text, {phrases_sql('text')} as kept from r)
select conv_id, turn, kept, case when strlen(text) >= 200 and not ({' or '.join(f"contains(text, '{m}')" for m in compress.CODE_MARKS)}) and strlen(kept) < strlen(text) * 0.6 then kept end as text from k
""")
def reasoning_phrases(spark, sf_dir):
    """Whole replies behind a phrase to be removed, eight times over; null where the rule keeps a reply."""
    rows = talk(spark, sf_dir).filter("role = 'assistant'")
    opener = F.get(F.array(*map(F.lit, OPENERS)), (F.col("turn") % 3).cast("int"))
    text = F.concat(F.repeat(opener, 8), F.lit("That is "), F.col("text"))
    return rows.select("conv_id", "turn", text.alias("text")).select("conv_id", "turn", compress.without_phrases(F.col("text")).alias("kept"),
                                                                    compress.compress_reasoning(F.col("text")).alias("text"))


@query("reply_compress")
def reply_compress(spark, sf_dir):
    rows = talk(spark, sf_dir).filter("role = 'assistant'")
    fenced = F.concat(F.repeat(F.lit("Let me check this first. I will need to look. "), 6), F.lit("\n```\ncode here\n```\n"), F.col("text"))
    return compress.compress_reply(rows.select("conv_id", "turn", fenced.alias("text")), ("conv_id", "turn"))


@query("dictionary_load", f"select token as symbol, count(*) as frequency from (select unnest({sql.identifiers('text')}) as token from conversations) group by all having count(*) > 1 order by frequency desc, symbol limit 200")
def dictionary_load(spark, sf_dir):
    return compress.load_dictionary(symbol_dictionary(spark, sf_dir))


@query("symbol_dictionary", f"select token as symbol, count(*) as frequency from (select unnest({sql.identifiers('text')}) as token from conversations) group by all having count(*) > 1")
def symbol_dictionary(spark, sf_dir):
    return compress.build_dictionary(talk(spark, sf_dir).select(F.explode(T.identifiers(F.col("text"))).alias("symbol")))


@query("dictionary_applied", "select conv_id, turn, replace(replace(replace(text, 'the', '[the]'), 'tion', '[tion]'), 'de', '[de]') as text from conversations")
def dictionary_applied(spark, sf_dir):
    symbols = F.array(F.lit("the"), F.lit("tion"), F.lit("de"))
    return talk(spark, sf_dir).select("conv_id", "turn", compress.apply_dictionary(F.col("text"), symbols).alias("text"))


@query("extracted_phrases", f"""
with b as (select item_id as doc_id, case when item_id % 2 = 0 then 'pub fn name_' || item_id || chr(10) || 'use x' || chr(10) || text else text end as text from benchmark),
{sql.lines('b')},
t as (select doc_id, line_no, {sql.trim('line')} as t from lines where line_no < 15),
n as (select *, regexp_extract(t, '{compress.SIGNATURE}', 1) as name from t),
k as (select *, sum(case when name <> '' then 1 else 0 end) over (partition by doc_id order by line_no) as k from n),
m as (select doc_id, k, max(name) as name from k group by all),
f as (select doc_id, k, arg_min(left(t, 40), line_no) as phrase from k where k > 0 and name = '' and strlen(t) > 5 and not starts_with(t, 'use ') group by all)
select f.doc_id, m.name, f.phrase from f join m using (doc_id, k)
""")
def extracted_phrases(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark")
    text = F.when(F.col("item_id") % 2 == 0, F.concat(F.lit("pub fn name_"), F.col("item_id").cast("string"), F.lit("\nuse x\n"), F.col("text"))).otherwise(F.col("text"))
    return compress.extract_phrases(items.select(F.col("item_id").alias("doc_id"), text.alias("text")))


def nation_json(spark, sf_dir):
    rows = table(spark, sf_dir, "nation")
    return rows.groupBy("n_regionkey").agg(F.to_json(F.sort_array(F.collect_list(F.struct(
        F.lit("nation").alias("kind"), F.col("n_name").alias("name"), F.col("n_nationkey").alias("nationkey"), F.lit("x" * 30).alias("note"), F.col("n_regionkey").alias("regionkey"))))).alias("text"))


@query("json_invariants", f"""
with r as (select n_regionkey, n_name, n_nationkey, row_number() over (partition by n_regionkey order by n_name) as i from nation)
select n_regionkey, '[S] kind=nation,note={'x' * 30},regionkey=' || n_regionkey || chr(10) || string_agg(i || ':name=' || n_name || ',nationkey=' || n_nationkey || chr(10), '' order by i) as text from r group by n_regionkey
""")
def json_invariants(spark, sf_dir):
    return nation_json(spark, sf_dir).select("n_regionkey", compress.hoist_invariants(F.col("text")).alias("text"))


@query("json_minify", """
with n as (select n_regionkey, '[' || string_agg('{"kind":"nation","name":"' || n_name || '","nationkey":' || n_nationkey || ',"note":"' || repeat('x', 30) || '","regionkey":' || n_regionkey || '}', ',' order by n_name) || ']' as text from nation group by all),
s as (select n_regionkey, text, regexp_replace(text, '([,:])"', '\\1  "', 'g') as spaced from n)
select n_regionkey, case when strlen(spaced) > 500 and strlen(text) < strlen(spaced) then text else spaced end as text from s
""")
def json_minify(spark, sf_dir):
    spaced = F.regexp_replace(F.col("text"), r'([,:])"', '$1  "')
    return nation_json(spark, sf_dir).select("n_regionkey", compress.minify_json(spaced).alias("text"))


@query("dialogue_states")
def dialogue_states(spark, sf_dir):
    rows = talk(spark, sf_dir).filter("role = 'assistant'")
    text = F.concat(F.lit("Goal: fix the merge\nproblem: it fails\nran `cargo test`; ok\nresult: 3 failed\nnext: look again. "), F.col("text"))
    return rows.select("conv_id", "turn", compress.dialogue_state(text).alias("state"))


@query("reply_word_lines", f"with {sql.lines('conversations', 'conv_id, turn', 'text')} select conv_id, turn, count(*) as lines from lines group by all")
def reply_word_lines(spark, sf_dir):
    rows = talk(spark, sf_dir).withColumn("k", F.struct("conv_id", "turn"))
    return explode_lines(rows, "k", "text").groupBy("k.conv_id", "k.turn").agg(F.count("*").alias("lines"))


@query("annotated_messages", f"""
with f as (select 'the' as file, token as identifier from (select unnest({sql.identifiers("'that with from'")}) as token)),
w as (select distinct conv_id, turn, w as identifier, text from (select conv_id, turn, text, unnest({sql.pieces('text')}) as w from conversations)),
p as (select conv_id, turn, text, f.file, min(f.identifier) as identifier from w join f using (identifier) where contains(text, f.file) group by all)
select conv_id, turn, left(text, instr(text, 'the') + 2) || ' /* -' || identifier || '/**/' || substr(text, instr(text, 'the') + 3) as text from p
""")
def annotated_messages(spark, sf_dir):
    failing = spark.createDataFrame([("the", n) for n in ("that", "with", "from")], "file string, identifier string")
    return guard.annotate(talk(spark, sf_dir), failing)


@query("response_bodies")
def response_bodies(spark, sf_dir):
    rows = talk(spark, sf_dir).filter("role = 'assistant'")
    text = F.concat(F.repeat(F.lit("Let me check this first. I will need to look. "), 12), F.col("text"))
    body = F.to_json(F.struct(F.array(F.struct(F.struct(text.alias("content")).alias("message"))).alias("choices")))
    ident = F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    return compress.compress_bodies(rows.select(ident.alias("id"), body.alias("body")))
