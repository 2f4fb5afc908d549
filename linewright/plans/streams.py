"""Queries of streams, each beside the SQL of its batch twin."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from linewright.operators import index, session
from linewright.plans.history import ORACLES
from linewright.plans.indexing import INDEX
from linewright.plans.registry import query
from linewright.sources.tables import shared_folder, table
from linewright.streaming import stateful as S


def events(spark, sf_dir):
    return S.stream_table(spark, sf_dir, "events")


@query("rate_limit_stream", ORACLES["rate_limited"])
def rate_limit_stream(spark, sf_dir):
    return S.run(S.admit(events(spark, sf_dir), "user_id", "ts", 3, 86400)).select("event_id", "allowed")


@query("feedback_stream", ORACLES["cache_feedback"].replace("order by ts, event_id", "order by event_id"))
def feedback_stream(spark, sf_dir):
    turns = events(spark, sf_dir).select("user_id", "event_id", ((F.col("event_id") % 10) * (F.col("event_id") % 3)).cast("double").alias("hit"),
                                         F.when(F.col("event_id") % 11 > 0, 18.0).otherwise(0.0).alias("total"))
    return S.run(S.feedback(turns, "user_id", "event_id")).filter("event_id % 11 > 0").select("event_id", "paused")


@query("window_counts_stream", "select cast(date_trunc('day', ts) as timestamp) as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by all")
def window_counts_stream(spark, sf_dir):
    counted = S.run(S.windowed_counts(events(spark, sf_dir), "ts", "1 day", "event_type"), "complete")
    return counted.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("dedup_stream", "select user_id, event_type from events group by all")
def dedup_stream(spark, sf_dir):
    return S.run(S.first_seen(events(spark, sf_dir).select("user_id", "event_type", "ts"), ["user_id", "event_type"], "ts", "400 days")).select("user_id", "event_type")




def chunks(spark, sf_dir):
    """Pieces of replies: a user's events, of which some name a reason to finish, cut in the middle."""
    rows = events(spark, sf_dir)
    text = F.when(F.col("event_id") % 2 == 0, F.lit('x "finish_rea')).otherwise(F.lit('son":"stop" y'))
    return rows.select(F.col("user_id").alias("stream"), F.col("event_id").alias("seq"), text.alias("chunk"), (F.col("event_type") == "purchase").alias("last"))


CHUNKS = "c as (select user_id as stream, event_id as seq, case when event_id % 2 = 0 then 'x \"finish_rea' else 'son\":\"stop\" y' end as chunk, event_type = 'purchase' as last from events)"


@query("finished_streams", f"""
with {CHUNKS}, t as (select stream, string_agg(chunk, '' order by seq) as body, bool_or(last) as ended from c group by stream)
select stream, contains(body, '\"finish_reason\":\"stop\"') as finished, case when not finished then '{S.TERMINATOR}' end as terminator from t where ended
""")
def finished_streams(spark, sf_dir):
    return S.run(S.finished_streams(chunks(spark, sf_dir)))


@query("flushed_chunks", f"""
with recursive {CHUNKS}, o as (select stream, strlen(chunk) as b, last, row_number() over (partition by stream order by seq) as k from c),
f as (select stream, k, 1 as n, b as size, b >= 64 or last as out from o where k = 1 union all
 select o.stream, o.k, case when f.out then 1 else f.n + 1 end, case when f.out then 0 else f.size end + o.b, case when f.out then 0 else f.size end + o.b >= 64 or o.last
 from f join o on o.stream = f.stream and o.k = f.k + 1)
select stream, cast(n as integer) as n, cast(size as bigint) as bytes from f where out
""")
def flushed_chunks(spark, sf_dir):
    return S.run(S.flushed(chunks(spark, sf_dir), least=64))


@query("stream_usage", """
with c as (select user_id as stream, event_id as seq, event_id * 2 as p, event_id % 7 as k from events where event_id % 3 = 0)
select stream, arg_max(p, seq) as prompt_tokens, arg_max(k, seq) as completion_tokens, cast(0 as bigint) as hit_tokens from c group by stream
""")
def stream_usage(spark, sf_dir):
    s = lambda c: c.cast("string")
    text = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('{"usage":{"prompt_tokens": '), s(F.col("event_id") * 2), F.lit(',"completion_tokens":'), s(F.col("event_id") % 7), F.lit("}}"))).otherwise("data")
    return S.run(S.stream_usage(events(spark, sf_dir).select(F.col("user_id").alias("stream"), F.col("event_id").alias("seq"), text.alias("chunk"))), "complete")


@query("maintained_index", INDEX + "select doc_id, phrase, occ from post")
def maintained_index(spark, sf_dir):
    folder = f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"
    return S.maintain_index(S.stream_table(spark, sf_dir, "documents").select("doc_id", "text"), folder, index.postings).select("doc_id", "phrase", "occ")


@query("session_blocks")
def session_blocks(spark, sf_dir):
    """Sessions made of conversations: user turns, and a read or an edit for each reply."""
    return session.state_block(session.states(session_lines(spark, sf_dir)))


@query("edited_files", """
select conv_id as session, 'src/a.rs' as files from conversations where role = 'assistant' and turn % 4 <> 1 group by conv_id
""")
def edited_files(spark, sf_dir):
    found = session.edited_files(session.results(session.parsed(session_lines(spark, sf_dir))))
    return found.select("session", F.array_join("files", ",").alias("files"))


def session_lines(spark, sf_dir):
    talk = table(spark, sf_dir, "conversations")
    k = F.col("turn").cast("string")
    call = F.to_json(F.struct(F.lit("message").alias("type"), F.struct(F.lit("assistant").alias("role"), F.array(F.struct(
        F.lit("toolCall").alias("type"), k.alias("id"), F.when(F.col("turn") % 4 == 1, "read").otherwise("edit").alias("name"),
        F.struct(F.lit("src/a.rs").alias("path"), F.lit("src/a.rs").alias("file"), F.array(F.struct(F.lit("old").alias("oldText"), F.lit("new").alias("newText"))).alias("edits")).alias("arguments"))).alias("content")).alias("message")))
    answer = F.to_json(F.struct(F.lit("message").alias("type"), F.struct(F.lit("toolResult").alias("role"), k.alias("toolCallId"), F.when(F.col("turn") % 4 == 1, "read").otherwise("edit").alias("toolName"),
                                                                         F.array(F.struct(F.lit("text").alias("type"), F.col("text"))).alias("content")).alias("message")))
    user = F.to_json(F.struct(F.lit("message").alias("type"), F.struct(F.lit("user").alias("role")).alias("message")))
    each = F.when(F.col("role") == "assistant", F.array(call, answer)).otherwise(F.array(user))
    return talk.select(F.col("conv_id").alias("session"), "turn", F.posexplode(each).alias("i", "value")).select("session", (F.col("turn") * 2 + F.col("i")).alias("seq"), "value")
