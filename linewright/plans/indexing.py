"""Queries of the index and of the guard."""

from __future__ import annotations

from pyspark.sql import functions as F

from linewright.functions import text as T
from linewright.operators import guard, index
from linewright.operators.lines import explode_lines
from linewright.plans import line_classes, sql
from linewright.plans.registry import ORACLES, query
from linewright.sources.tables import table

ZONE_SQL = ORACLES["zone_by_line"].replace("select doc_id, line_no, cast(", "select doc_id, line_no, t, cast(")
INDEX = f"""with zones as ({ZONE_SQL}),
tok as (select l.doc_id, l.line_no, z.zone, {line_classes.sql.any_of('z.t', line_classes.C.INDEX_DEFINITION_RULES)} as is_def, unnest({sql.identifiers('l.line')}) as token
  from (with {sql.lines()} select * from lines) l join zones z using (doc_id, line_no)),
post as (select doc_id, {sql.stem('token')} as phrase, max(cast(is_def as integer)) as is_def, cast(floor(sum(zone) / count(*)) as integer) as zone, count(*) as occ, cast(min(line_no) as integer) as first_line from tok group by all),
stats as (select p.doc_id, p.n as token_len, strlen(d.text) as content_len from (select doc_id, count(*) as n from post group by all) p join documents d using (doc_id)),
freq as (select phrase, count(*) as df from post group by all)
"""


def posts(spark, sf_dir):
    return index.postings(table(spark, sf_dir, "documents"))


@query("index_postings", INDEX + "select * from post")
def index_postings(spark, sf_dir):
    return posts(spark, sf_dir)


@query("doc_stats", INDEX + "select * from stats")
def doc_stats(spark, sf_dir):
    return index.doc_stats(table(spark, sf_dir, "documents"), posts(spark, sf_dir))


@query("doc_freq", INDEX + "select * from freq")
def doc_freq(spark, sf_dir):
    return index.doc_freq(posts(spark, sf_dir))


@query("index_stats", INDEX + "select count(distinct doc_id) as files, count(distinct phrase) as phrases, count(*) as occurrences from post")
def index_stats(spark, sf_dir):
    return index.index_stats(posts(spark, sf_dir))


SCORE = """, m as (select * from post where {hit}),
f as (select phrase, count(*) as df from m group by all),
c as (select cast(count(*) as double) as n, avg(token_len) as mean from stats),
s as (select m.doc_id, m.phrase, m.first_line, m.zone, ln((c.n - f.df + 0.5) / (f.df + 0.5) + 1.0) * (ln({tf}) * 2.2) / (ln({tf}) + 1.2 * (0.25 + 0.75 * st.token_len / c.mean)) as score
  from m join f using (phrase) join stats st using (doc_id) cross join c),
r as (select *, row_number() over (partition by doc_id order by score desc, phrase) as k from s)
select doc_id, round(score, 6) as score, first_line as line, zone from r where k = 1 order by round(score, 6) desc, doc_id limit {most}"""


@query("search_bm25_topk", INDEX + SCORE.format(hit="contains(phrase, 'ation') or contains(phrase, 'thing')", tf="2.0", most=10))
def search_bm25_topk(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = posts(spark, sf_dir)
    return index.search(found, index.doc_stats(docs, found), "ation thing x", 10)


@query("search_by_occurrences", INDEX + SCORE.format(hit="contains(phrase, 'eur') or contains(phrase, 'heit')", tf="1.0 + m.occ", most=50))
def search_by_occurrences(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = posts(spark, sf_dir)
    return index.search(found, index.doc_stats(docs, found), "eur heit", 50, tf="occ")


@query("who_references", INDEX + f"select doc_id, count(*) as n from post where phrase = {sql.stem("'thing'")} and doc_id <> 5 group by all order by n desc, doc_id limit 20")
def who_references(spark, sf_dir):
    return index.references(posts(spark, sf_dir), "Thing", 5)


@query("flag_pack_roundtrip", INDEX + """
select doc_id, phrase, ((is_def + 1) & 3) | ((zone & 1) << 2) | (cast(case when occ <= 30 then occ else 31 end as integer) << 3) as flags, first_line & 65535 as line16,
 is_def, zone, cast(case when occ <= 30 then occ else 31 end as integer) as occ from post
""")
def flag_pack_roundtrip(spark, sf_dir):
    flags, line = index.pack(F.col("is_def"), F.col("zone"), F.col("occ"), F.col("first_line"))
    packed = posts(spark, sf_dir).select("doc_id", "phrase", flags.alias("flags"), line.alias("line16"))
    is_def, zone, occ = index.unpack(F.col("flags"))
    return packed.select("*", is_def.alias("is_def"), zone.alias("zone"), occ.alias("occ"))


LINE_INFO = INDEX + f""", u as (select doc_id, line_no, {sql.stem('token')} as phrase from tok),
i as (select u.doc_id, u.line_no, avg(ln(coalesce(df, 0) + 1)) as info from u left join freq using (phrase) group by all),
li as (select l.doc_id, l.line_no, l.line, coalesce(info, 0) as info from (with {sql.lines()} select * from lines) l left join i using (doc_id, line_no))
"""


@query("line_info_score", LINE_INFO + "select doc_id, line_no, round(info, 6) as info, round(info, 6) < 1.6 as preserve from li")
def line_info_score(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rows = index.line_scores(docs, index.doc_freq(posts(spark, sf_dir)))
    return rows.select("doc_id", "line_no", F.round("info", 6).alias("info"), (F.round("info", 6) < 1.6).alias("preserve"))


@query("df_weighted_keep", LINE_INFO + f"""
, k as (select *, ({sql.trim('line')} = '' or info < 4.0) as kept from li),
n as (select *, case when kept or coalesce(lag(kept) over (partition by doc_id order by line_no), true) then 1 else 0 end as new from k),
g as (select *, sum(new) over (partition by doc_id order by line_no) as run from n),
h as (select doc_id, avg(cast(kept as integer)) as share, max(run) as last from g group by all),
p as (select g.doc_id, g.run, bool_and(kept) as kept, count(*) as n, string_agg(line, chr(10) order by line_no) as body from g group by all),
o as (select p.doc_id, p.run, h.share, case when p.kept then body || chr(10) when p.run = h.last then chr(10) || '[' || n || ' lines]' else '[' || n || ' lines]' || chr(10) end as piece from p join h using (doc_id))
select doc_id, case when max(share) <= 0.7 then string_agg(piece, '' order by run) end as text from o group by doc_id
""")
def df_weighted_keep(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rows = index.line_scores(docs, index.doc_freq(posts(spark, sf_dir)))
    return index.compress_weighted(rows, lambda body, n: F.concat(F.lit("["), n.cast("string"), F.lit(" lines]")), below=4.0)


@query("path_candidates", """
with p as (select doc_id, case when doc_id % 2 = 0 then '/work/crates/' || source || '/' || doc_id || '.md' else '/other/' || source end as path from documents),
r as (select doc_id, path, substr(path, 7) as rel from p)
select doc_id, unnest(case when not starts_with(path, '/work') then [path] when starts_with(rel, 'crates/') then [rel, substr(rel, 8), path] else [rel, path] end) as candidate from r
""")
def path_candidates(spark, sf_dir):
    inside = F.concat(F.lit("/work/crates/"), F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md"))
    path = F.when(F.col("doc_id") % 2 == 0, inside).otherwise(F.concat(F.lit("/other/"), F.col("source")))
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(index.path_candidates(path, "/work")).alias("candidate"))


@query("renewed_postings", INDEX + f"""
, u as (select item_id as doc_id, unnest({sql.identifiers('text')}) as token from benchmark where item_id % 2 = 0),
v as (select doc_id, {sql.stem('token')} as phrase, count(*) as occ from u group by all)
select doc_id, phrase, occ from post where doc_id not in (select doc_id from v) union all select doc_id, phrase, occ from v
""")
def renewed_postings(spark, sf_dir):
    changed = index.postings(table(spark, sf_dir, "benchmark").filter("item_id % 2 = 0").withColumnRenamed("item_id", "doc_id"))
    return index.renew(posts(spark, sf_dir), changed).select("doc_id", "phrase", "occ")


NEW = f", u as (select distinct item_id as doc_id, unnest({sql.identifiers('text')}) as token from benchmark), fresh as (select distinct doc_id, {sql.stem('token')} as phrase from u), old as (select doc_id, phrase from post where doc_id in (select item_id from benchmark))"


def _versions(spark, sf_dir):
    found = posts(spark, sf_dir)
    items = table(spark, sf_dir, "benchmark").withColumnRenamed("item_id", "doc_id")
    return found, found.join(items.select("doc_id"), "doc_id", "left_semi"), index.postings(items)


@query("orphan_refs", INDEX + NEW + """
, gone as (select o.doc_id, o.phrase, f.df from old o join freq f using (phrase) where f.df < 10 and not exists (select 1 from fresh n where n.doc_id = o.doc_id and n.phrase = o.phrase)),
x as (select g.doc_id, g.phrase, p.doc_id as other, row_number() over (partition by g.doc_id, g.phrase order by p.doc_id) as k from gone g join post p on p.phrase = g.phrase and p.doc_id <> g.doc_id)
select doc_id, phrase, count(*) as n_files, string_agg(cast(other as varchar), ',' order by other) filter (where k <= 3) as examples from x group by all
""")
def orphan_refs(spark, sf_dir):
    found, old, new = _versions(spark, sf_dir)
    return guard.orphan_references(old, new, found)


FIRSTS = f", d as (select doc_id, {sql.stem('token')} as phrase from (select doc_id, {sql.identifiers('line')}[1] as token from (with {sql.lines()} select * from lines)) where token is not null), defs as (select distinct doc_id, phrase from d)"


def _definitions(spark, sf_dir):
    """Prose has no definitions: the first identifier of each line stands for one."""
    rows = explode_lines(table(spark, sf_dir, "documents"), "doc_id", "text")
    return rows.select("doc_id", T.first_identifier(F.col("line")).alias("w")).filter("w is not null").select("doc_id", T.stem_of(F.col("w")).alias("phrase"))


@query("missing_defs", INDEX + NEW + FIRSTS + """
select n.doc_id, n.phrase, count(*) as n_files from fresh n join defs d on d.phrase = n.phrase and d.doc_id <> n.doc_id
where not exists (select 1 from old o where o.doc_id = n.doc_id and o.phrase = n.phrase) group by all
""")
def missing_defs(spark, sf_dir):
    _, old, new = _versions(spark, sf_dir)
    return guard.missing_definitions(old, new, _definitions(spark, sf_dir))


@query("validated_reads", INDEX + FIRSTS + f"""
, c as (select d.doc_id, d.phrase, f.df - 1 as n_files from defs d join freq f using (phrase) where length(d.phrase) >= 6 and f.df > 1),
r as (select *, cast(row_number() over (partition by doc_id order by n_files desc, phrase) as integer) as rank from c),
b as (select * from r where rank <= 5),
h as (select phrase, doc_id as other, row_number() over (partition by phrase order by doc_id) as k from post where phrase in (select phrase from b)),
x as (select b.doc_id, b.phrase, b.n_files, b.rank, h.other, row_number() over (partition by b.doc_id, b.phrase order by h.other) as k from b join h on h.phrase = b.phrase and h.k <= 4 and h.other <> b.doc_id)
select doc_id, phrase, n_files, rank, string_agg(cast(other as varchar), ',' order by other) filter (where k <= 3) as examples from x group by all
""")
def validated_reads(spark, sf_dir):
    return guard.validated(_definitions(spark, sf_dir), posts(spark, sf_dir), keep=lambda p: F.length(p) >= 6)


@query("veto_unknown", INDEX + f"""
, a as (select distinct lower(w) as name from (select unnest({sql.pieces('html')}) as w from pages) where regexp_full_match(w, '[A-Za-z_][A-Za-z0-9_]{{2,39}}') and lower(w) not in ({sql.quoted(guard.LIBRARIES)}))
select name from a where not exists (select 1 from freq f where contains(f.phrase, a.name))
""")
def veto_unknown(spark, sf_dir):
    names = table(spark, sf_dir, "pages").select(F.explode(T.identifiers(F.col("html"))).alias("name"))
    return guard.unknown_names(names, posts(spark, sf_dir))
