"""Fragments of the SQL twins."""

from __future__ import annotations

from linewright.functions.text import COMMON_WORDS, SUFFIXES

SPACE = r"[\s\x0B\x{85}\p{Z}]"
SPLIT = r"[^\p{L}\p{M}\p{N}_]+"


def quoted(values) -> str:
    return ", ".join("'" + str(v).replace("'", "''") + "'" for v in values)


def trim(x: str) -> str:
    return f"regexp_replace({x}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '{SPACE}+'), lambda w: w <> '')"


def pieces(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '{SPLIT}'), lambda w: w <> '')"


def identifiers(x: str) -> str:
    return (f"list_transform(list_filter(regexp_split_to_array({x}, '{SPLIT}'), "
            "lambda w: regexp_full_match(w, '[A-Za-z_][A-Za-z0-9_]{2,39}')), lambda w: lower(w))")


def stem(w: str) -> str:
    rules = " ".join(
        f"when right({w}, {len(s)}) = '{s}' and length({w}) > {len(s) + 2} then left({w}, length({w}) - {len(s)})" for s in SUFFIXES
    )
    return (f"(case when length({w}) <= 3 then {w} {rules} when right({w}, 1) = 's' and right({w}, 2) <> 'ss' "
            f"then left({w}, length({w}) - 1) else {w} end)")


def interesting(w: str) -> str:
    return (f"(strlen({w}) between 3 and 40 and regexp_matches({w}, '^\\p{{L}}') and {w} not in ({quoted(COMMON_WORDS)}) "
            f"and (not regexp_full_match({w}, '[\\p{{Ll}}_]+') or contains({w}, '_')))")


def line_list(t: str) -> str:
    return (f"list_transform(string_split(case when right({t}, 1) = chr(10) then left({t}, length({t}) - 1) else {t} end, chr(10)), "
            "lambda l: case when right(l, 1) = chr(13) then left(l, length(l) - 1) else l end)")


def lines(table: str = "documents", key: str = "doc_id", text: str = "text", name: str = "lines") -> str:
    """A common table of (key, line_no, line); line_no from 0."""
    return (f"{name} as (select {key}, cast(unnest(range(len(ls))) as integer) as line_no, unnest(ls) as line from "
            f"(select {key}, {line_list(text)} as ls from {table} where {text} <> ''))")


def tokens(of: str, name: str, key: str, text: str, made: str) -> str:
    return f"{name} as (select {key}, unnest({made}) as token from {of})"


POSTINGS = f"""
{lines()},
tok as (select doc_id, line_no, line, unnest({identifiers('line')}) as token from lines),
post as (select doc_id, {stem('token')} as phrase, line_no, line from tok)
"""


def any_of(x: str, rules) -> str:
    parts = []
    for test, text in rules:
        literal = "'" + text.replace("'", "''") + "'"
        parts.append(f"contains({x}, {literal})" if test == "has" else f"starts_with({x}, {literal})")
    return "(" + " or ".join(parts) + ")"


def count_of(x: str, characters: str) -> str:
    """Characters of a class, or matches of a pattern."""
    return f"len(regexp_extract_all({x}, '{characters}'))"
