"""Table functions for SQL: lines and identifiers of a text. Registered by register()."""

from __future__ import annotations

from pyspark.sql import SparkSession

SPLIT_LINES = r"""
create or replace temporary function split_lines(t string) returns table (line_no int, line string)
return select i, regexp_replace(l, '\\r\\z', '') from (select posexplode(split(regexp_replace(t, '\\n\\z', ''), '\n', -1)) as (i, l)) where t <> ''
"""
SCAN_IDENTIFIERS = r"""
create or replace temporary function scan_identifiers(t string) returns table (place int, identifier string)
return select i, lower(w) from (select posexplode(filter(split(t, '[^\\p{IsAlphabetic}\\p{N}_]+'), w -> w rlike '^[A-Za-z_][A-Za-z0-9_]{2,39}$')) as (i, w))
"""


def register(spark: SparkSession) -> None:
    """split_lines(text) and scan_identifiers(text) as SQL table functions; they inline into the plan."""
    for body in (SPLIT_LINES, SCAN_IDENTIFIERS):
        spark.sql(body)
