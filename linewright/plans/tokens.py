"""Queries of the token functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from linewright.functions import text as T
from linewright.plans import sql
from linewright.plans.registry import query
from linewright.sources.tables import table


@query("identifiers", f"""
select doc_id, token, count(*) as n from (select doc_id, unnest({sql.identifiers('text')}) as token from documents) group by all
""")
def identifiers(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.explode(T.identifiers(F.col("text"))).alias("token")).groupBy("doc_id", "token").agg(F.count("*").alias("n"))


@query("stems", f"""
select distinct token, {sql.stem('token')} as stem from (select unnest({sql.identifiers('text')}) as token from documents)
""")
def stems(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.explode(T.identifiers(F.col("text"))).alias("token")).distinct().select("token", T.stem(F.col("token")).alias("stem"))


@query("trigrams", f"""
with t as (select distinct token from (select unnest({sql.identifiers('text')}) as token from benchmark)),
g as (select token, unnest(range(greatest(length(token) - 2, 1))) as place from t)
select token, cast(place as integer) as place, substr(token, place + 1, 3) as trigram from g
""")
def trigrams(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark")
    tokens = items.select(F.explode(T.identifiers(F.col("text"))).alias("token")).distinct()
    return tokens.select("token", F.posexplode(T.trigrams(F.col("token"))).alias("place", "trigram"))


@query("memory_tokens", f"""
select item_id, lower(w) as token, count(*) as n from (select item_id, unnest({sql.pieces('text')}) as w from benchmark)
where strlen(w) >= 3 and regexp_matches(w, '\\p{{L}}') group by all
""")
def memory_tokens(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark")
    return items.select("item_id", F.explode(T.memory_tokens(F.col("text"))).alias("token")).groupBy("item_id", "token").agg(F.count("*").alias("n"))


@query("preservation_targets", f"""
select conv_id, turn, w as target, count(*) as n from (select conv_id, turn, unnest({sql.pieces('text')}) as w from conversations)
where strlen(w) >= 4 group by all
""")
def preservation_targets(spark, sf_dir):
    talk = table(spark, sf_dir, "conversations")
    return talk.select("conv_id", "turn", F.explode(T.preservation_targets(F.col("text"))).alias("target")).groupBy("conv_id", "turn", "target").agg(F.count("*").alias("n"))


@query("code_tokens", f"""
select page_id, w as token, count(*) as n from (select page_id, unnest({sql.pieces('html')}) as w from pages)
where strlen(w) >= 3 and regexp_full_match(w, '[A-Za-z_][A-Za-z0-9_]*') group by all
""")
def code_tokens(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", F.explode(T.code_tokens(F.col("html"))).alias("token")).groupBy("page_id", "token").agg(F.count("*").alias("n"))


@query("loose_identifiers", f"""
select page_id, count(*) as n, count(distinct w) as n_distinct from (select page_id, unnest({sql.pieces('html')}) as w from pages)
where strlen(w) >= 2 and regexp_matches(w, '^[\\p{{L}}_]') group by all
""")
def loose_identifiers(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", F.explode(T.loose_identifiers(F.col("html"))).alias("w")).groupBy("page_id").agg(
        F.count("*").alias("n"), F.count_distinct("w").alias("n_distinct"))


@query("primary_identifier", f"""
with t as (select doc_id, list_filter({sql.pieces('text')}, lambda w: strlen(w) between 3 and 40 and regexp_matches(w, '^[\\p{{L}}_]')
  and w <> source and not (regexp_full_match(w, '[a-z]+') and strlen(w) < 5)) as k from documents)
select doc_id, coalesce(list_filter(k, lambda w: regexp_matches(w, '\\p{{Lu}}') or contains(w, '_') or strlen(w) >= 6)[1], k[1], 'unknown') as identifier from t
""")
def primary_identifier(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", T.primary_identifier(F.col("text"), F.col("source")).alias("identifier"))


@query("interesting_identifiers", f"""
select distinct token from (select unnest({sql.pieces('html')}) as token from pages) where {sql.interesting('token')}
""")
def interesting_identifiers(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return pages.select(F.explode(T.pieces(F.col("html"))).alias("token")).filter(T.interesting(F.col("token"))).distinct()


@query("first_paths", rf"""
with w as (select page_id, list_transform({sql.words('html')}, lambda w: regexp_replace(w, '^["''`(),:;]+|["''`(),:;]+$', '', 'g')) as ws from pages),
p as (select page_id, list_filter(list_transform(list_filter(ws, lambda w: regexp_matches(w, '[/\\]') and strlen(w) >= 3),
  lambda w: regexp_replace(w, '[.,:;0-9]+$', '')), lambda w: strlen(w) >= 3) as ps from w)
select page_id, ps[1] as path from p
""")
def first_paths(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", T.first_path(F.col("html")).alias("path"))


@query("leading_tokens", f"""
with {sql.lines('documents')},
t as (select doc_id, line_no, {sql.trim('line')} as t from lines),
h as (select doc_id, line_no, {sql.trim("split_part(t, ':', 1)")} as h from t where contains(t, ':'))
select doc_id, line_no, h as token from h where strlen(h) between 2 and 119
""")
def leading_tokens(spark, sf_dir):
    from linewright.operators.lines import explode_lines

    rows = explode_lines(table(spark, sf_dir, "documents"), "doc_id", "text")
    return rows.select("doc_id", "line_no", T.leading_token(F.col("line")).alias("token")).filter("token is not null")


EVENT_LINE = "strftime(ts, '%H:%M:%S') || '.' || (event_id % 1000) || ' ' || event_type || ' user ' || user_id"


@query("timestamp_remainders", f"""
select event_id, regexp_replace(left({sql.trim("regexp_replace(substr(l, 9), '^\\.[0-9]*', '')")}, 30), '[0-9 :]+$', '') as remainder
from (select event_id, {EVENT_LINE} as l from events)
""")
def timestamp_remainders(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    line = F.concat(F.date_format("ts", "HH:mm:ss"), F.lit("."), (F.col("event_id") % 1000).cast("string"), F.lit(" "),
                    F.col("event_type"), F.lit(" user "), F.col("user_id").cast("string"))
    return events.select("event_id", T.timestamp_remainder(line).alias("remainder"))
