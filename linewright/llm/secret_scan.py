"""Secret scans with corpus-wide ownership frequency (operator 1), in DataFrame functions only.

Three kinds of secrets are found by pattern. Their values, and those of long unlabelled tokens, are candidates:
hashes of candidates are counted by distinct owners and repositories over the whole corpus. A random-looking
token that one owner alone has is a live-looking credential and becomes a span of its own; a value that several
owners have is a widely copied example.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linewright.llm.base import join_groups, written

#: Kinds in the order in which equal starts are listed; the last is what ownership adds.
KINDS = ("assign", "access", "hex", "live")
#: Owners from which on a value is a widely copied example; distinct characters of a random-looking token.
EXAMPLE_OWNERS, RANDOM_CHARACTERS = 3, 10
#: Lengths that are summed at once.
BLOCK = 64

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Runs that fail the length hold no shorter match, so the length can stand in the pattern.
ACCESS = r"AKIA[A-Z0-9]{12,}+"
HEX = r"[0-9a-f]{32,}+"
TOKEN = r"[A-Za-z0-9]{20,}+"

SPAN = "array<struct<start:int,rank:int,end:int,hash:string>>"


def running(lengths: Column) -> Column:
    """Running sums of an array, by blocks, so that the time stays in proportion to its size."""
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    add = lambda a, x, y: F.struct((a["at"] + x).alias("at"), F.concat(a["out"], F.array(y)).alias("out"))
    last = F.greatest(F.ceil(F.size(lengths) / BLOCK).cast("int") - 1, F.lit(0))
    blocks = F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(lengths, b * BLOCK + 1, BLOCK))
    sums = F.transform(blocks, lambda block: F.aggregate(block, zero, lambda a, x: add(a, x, a["at"] + x)))
    before = F.aggregate(sums, zero, lambda a, x: add(a, x["at"], a["at"]))["out"]
    return F.flatten(F.zip_with(sums, before, lambda s, b: F.transform(s["out"], lambda x: x + b)))


def walked(text: Column, pattern: str, rank: int, value: Callable[[Column], Column], wanted: Callable[[Column], Column]) -> Column:
    """Leftmost matches of a pattern that don't overlap, as spans in code points with a hash of the value.

    Their ends are running sums over the pieces between matches and the matches, side by side; `wanted` tells of
    a value whether its match stays.
    """
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.zip_with(F.slice(F.split(text, pattern, -1), 1, F.size(matches)), matches, lambda g, m: F.length(g) + F.length(m))
    each = F.zip_with(matches, running(pieces), lambda m, e: F.struct(m.alias("m"), value(m).alias("v"), e.alias("e")))
    found = F.transform(F.filter(each, lambda x: wanted(x["v"])), lambda x: F.struct(
        (x["e"] - F.length(x["m"])).alias("start"), F.lit(rank).alias("rank"), x["e"].alias("end"), F.sha2(x["v"], 256).alias("hash")))
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(SPAN))


def spans(text: Column, pattern: str, rank: int, group: int = 0, least: int = 0) -> Column:
    """Spans of a pattern's matches whose value, a group at the match's end, has `least` characters or more."""
    value = (lambda m: F.regexp_extract(m, pattern, group)) if group else (lambda m: m)
    return walked(text, pattern, rank, value, lambda v: F.length(v) >= least)


def tokens(text: Column) -> Column:
    """Spans of long unlabelled tokens that mix letters and digits and look random."""
    return walked(text, TOKEN, 3, lambda m: m, _random)


def _random(value: Column) -> Column:
    digits = F.length(F.regexp_replace(value, "[^0-9]", ""))
    distinct = F.size(F.array_distinct(F.split(value, "")))
    return (digits >= 3) & (F.length(value) - digits >= 3) & (distinct >= RANDOM_CHARACTERS)


def listed(found: Column) -> Column:
    """kind:start:end by start and kind, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(found), lambda s: F.concat_ws(
        ":", F.element_at(names, s["rank"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def ownership(candidates: DataFrame) -> DataFrame:
    """(hash, n_owners, n_repos, n_rows) of candidates (hash, owner, repo): distinct owners, repositories of them, rows.

    Counted in steps, each pre-aggregated before its shuffle, so a value that is everywhere costs no more
    rows than it has owners and repositories in each task. Null owners and repositories count as one.
    """
    pairs = candidates.select("hash", F.coalesce("owner", F.lit("")).alias("owner"), F.coalesce("repo", F.lit("")).alias("repo"))
    by_repo = pairs.groupBy("hash", "owner", "repo").agg(F.count("*").alias("n_rows"))
    by_owner = by_repo.groupBy("hash", "owner").agg(F.count("*").alias("n"), F.sum("n_rows").alias("n_rows"))
    return by_owner.groupBy("hash").agg(F.count("*").alias("n_owners"), F.sum("n").alias("n_repos"), F.sum("n_rows").alias("n_rows"))


def find(
    df: DataFrame, id_col: str = "doc_id", text: str = "text", owner: str = "source", repo: str = "lang"
) -> DataFrame:
    """A row for each row of df with its base spans and its tokens, written once; texts stay behind.

    Columns: _lw_row, id, text_hash, owner, repo, base and extra (arrays of start, rank, end, hash).
    """
    body = F.coalesce(df[text], F.lit(""))
    base = F.concat(spans(body, ASSIGN, 0, 1, 8), spans(body, ACCESS, 1), spans(body, HEX, 2))
    found = df.select(
        df[id_col].alias("id"), F.xxhash64(body).alias("text_hash"), df[owner].cast("string").alias("owner"), df[repo].cast("string").alias("repo"),
        base.alias("base"), tokens(body).alias("extra"),
    )
    outside = F.filter("extra", lambda t: ~F.exists("base", lambda b: (t["start"] < b["end"]) & (b["start"] < t["end"])))
    return written(found.select("id", "text_hash", "owner", "repo", "base", outside.alias("extra"),
                                F.monotonically_increasing_id().alias("_lw_row")))


def judge(found: DataFrame) -> DataFrame:
    """(_lw_row, live, n_live, n_example, most_owners) of the rows of find() that have candidates.

    A value that a large share of all candidates have is not dealt to one task: its counts go to the rows.
    """
    each = found.select("_lw_row", "owner", "repo", F.explode(F.concat("base", "extra")).alias("s"))
    flat = each.select("_lw_row", "owner", "repo", "s", F.col("s.hash").alias("hash"))
    seen = ownership(flat.select("hash", "owner", "repo"))
    judged = join_groups(flat, seen, "hash", "n_rows")
    one, many = F.col("n_owners") == 1, F.col("n_owners") >= EXAMPLE_OWNERS
    return judged.groupBy("_lw_row").agg(
        F.collect_list(F.when(one & (F.col("s.rank") == 3), F.col("s"))).alias("live"),
        F.count(F.when(one, 1)).alias("n_live"), F.count(F.when(many, 1)).alias("n_example"),
        F.max("n_owners").alias("most_owners"),
    )


def scan(
    df: DataFrame, id_col: str = "doc_id", text: str = "text", owner: str = "source", repo: str = "lang"
) -> DataFrame:
    """id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_example and most_owners for each row of df.

    Spans are kind:start:end in code points, end exclusive, sorted by start and kind. n_live and n_example
    count candidates, base ones included, whose value one owner or at least EXAMPLE_OWNERS have; most_owners
    is the greatest number of owners of one of them. Null texts are empty; a null owner or repository is one
    like any other; repeated rows give repeated results and count once for ownership; an empty table gives
    none; other columns are not read. Texts are read once and never shuffled; only spans are.
    """
    found = find(df, id_col, text, owner, repo)
    rows = found.join(judge(found), "_lw_row", "left")
    none = F.array().cast(SPAN)
    count = lambda k: F.size(F.filter("base", lambda s: s["rank"] == k)).cast("long")
    return rows.select(
        F.col("id").alias(id_col), count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(listed(F.col("base")), 256).alias("base_sha256"),
        listed(F.concat("base", F.coalesce("live", none))).alias("spans"),
        F.coalesce("n_live", F.lit(0)).alias("n_live"), F.coalesce("n_example", F.lit(0)).alias("n_example"),
        F.coalesce("most_owners", F.lit(0)).alias("most_owners"),
    )


def redact(
    df: DataFrame, id_col: str = "doc_id", text: str = "text", owner: str = "source", repo: str = "lang",
    length: str | None = "n_chars", marker: str = "[REDACTED]",
) -> DataFrame:
    """df with every span of scan() in its texts replaced by a marker; spans that overlap become one.

    All rows and columns stay, whatever their names; a column of lengths, if there is one of that name,
    follows the new text where it changed. Null texts stay null. The texts are joined to the spans of their
    rows by id and a hash of the text, so repeated rows are all redacted.
    """
    found = find(df, id_col, text, owner, repo)
    none = F.array().cast(SPAN)
    rows = found.filter((F.size("base") > 0) | (F.size("extra") > 0)).join(judge(found), "_lw_row", "left")
    spans_of = (
        rows.select(F.col("id").alias("_lw_id"), F.col("text_hash").alias("_lw_hash"),
                    F.array_sort(F.concat("base", F.coalesce("live", none))).alias("_lw_spans"))
        .filter(F.size("_lw_spans") > 0).groupBy("_lw_id", "_lw_hash").agg(F.max("_lw_spans").alias("_lw_spans"))
    )
    body = df[text]
    spans_of = written(spans_of)  # read from there, a key that is repeated often can be split
    same = df[id_col].eqNullSafe(spans_of["_lw_id"]) & (F.xxhash64(F.coalesce(body, F.lit(""))) == spans_of["_lw_hash"])
    joined = df.join(spans_of, same, "left")
    walked = F.aggregate(
        "_lw_spans", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda a, s: F.struct(
            F.greatest(a["at"], s["end"]).alias("at"),
            F.when(s["start"] < a["at"], a["out"]).otherwise(
                F.concat(a["out"], F.substring(body, a["at"] + 1, s["start"] - a["at"]), F.lit(marker))).alias("out"),
        ),
        lambda a: F.concat(a["out"], F.substring(body, a["at"] + 1, F.length(body))),
    )
    changed = F.col("_lw_spans").isNotNull() & body.isNotNull()
    renewed = F.when(changed, walked).otherwise(body)
    columns = []
    for c in df.columns:
        if c == text:
            columns.append(renewed.alias(c))
        elif c == length:
            columns.append(F.when(changed, F.length(renewed)).otherwise(df[c]).cast(df.schema[c].dataType).alias(c))
        else:
            columns.append(df[c])
    return joined.select(*columns)


#: What scan() gives with its defaults, over documents(doc_id, text, lang, source).
SQL = r"""
with d as (select row_number() over () as r, doc_id, coalesce(source, '') as owner, coalesce(lang, '') as repo, coalesce(text, '') as t from documents),
p as (select * from (values (0, '(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)')) as v(k, re)),
a as (select r, 0 as k, regexp_extract_all(t, (select re from p), 0) as m, regexp_extract_all(t, (select re from p), 1) as v, regexp_split_to_array(t, (select re from p)) as g from d),
b as (select r, 1 as k, regexp_extract_all(t, 'AKIA[A-Z0-9]{12,}', 0) as m, regexp_extract_all(t, 'AKIA[A-Z0-9]{12,}', 0) as v, regexp_split_to_array(t, 'AKIA[A-Z0-9]{12,}') as g from d),
c as (select r, 2 as k, regexp_extract_all(t, '[0-9a-f]{32,}', 0) as m, regexp_extract_all(t, '[0-9a-f]{32,}', 0) as v, regexp_split_to_array(t, '[0-9a-f]{32,}') as g from d),
e as (select r, 3 as k, regexp_extract_all(t, '[A-Za-z0-9]{20,}', 0) as m, regexp_extract_all(t, '[A-Za-z0-9]{20,}', 0) as v, regexp_split_to_array(t, '[A-Za-z0-9]{20,}') as g from d),
u as (select * from a union all select * from b union all select * from c union all select * from e),
w as (select r, k, unnest(m) as m, unnest(v) as v, unnest(g[1:len(m)]) as g, unnest(range(len(m))) as i from u where len(m) > 0),
x as (select r, k, v, sum(length(g) + length(m)) over (partition by r, k order by i) as stop, length(m) as n from w),
s as (select r, k, v, cast(stop - n as bigint) as start, cast(stop as bigint) as stop from x
      where case k when 0 then length(v) >= 8 when 3 then
        length(regexp_replace(v, '[^0-9]', '', 'g')) >= 3 and length(regexp_replace(v, '[0-9]', '', 'g')) >= 3 and len(list_distinct(string_split(v, ''))) >= 10
      else true end),
f as (select s.* from s where k < 3 or not exists (select 1 from s o where o.r = s.r and o.k < 3 and s.start < o.stop and o.start < s.stop)),
h as (select f.*, d.owner, d.repo from f join d using (r)),
o as (select v, count(distinct owner) as n from h group by v),
j as (select f.*, o.n from f join o using (v)),
z as (select r, count(*) filter (where k = 0) as n_assign, count(*) filter (where k = 1) as n_access, count(*) filter (where k = 2) as n_hex,
        string_agg(case k when 0 then 'assign' when 1 then 'access' else 'hex' end || ':' || start || ':' || stop, ',' order by start, k) filter (where k < 3) as base,
        string_agg(case k when 0 then 'assign' when 1 then 'access' when 2 then 'hex' else 'live' end || ':' || start || ':' || stop, ',' order by start, k) filter (where k < 3 or n = 1) as spans,
        count(*) filter (where n = 1) as n_live, count(*) filter (where n >= 3) as n_example, max(n) as most_owners
      from j group by r)
select d.doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex,
  sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans, coalesce(n_live, 0) as n_live, coalesce(n_example, 0) as n_example,
  coalesce(most_owners, 0) as most_owners
from d left join z using (r)
"""
