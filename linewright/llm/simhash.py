"""SimHash near-duplicates searched with BK-trees (operator 7).

A text's fingerprint has the majority bits of the hashes of its word shingles. Fingerprints that differ in
few bits agree on some blocks of bits (pigeonhole), so each choice of agreeing blocks is a bucket and any
linked pair meets in one. A bucket holds a BK-tree: children keyed by their distance to the parent, of which
a search follows only those within the radius. Large buckets are split again by the bits that are left, so a
tree stays small whatever the corpus. Trees are built where their bucket is, not broadcast: all of them
together grow with the corpus.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linewright.llm.base import cut, join_groups, map_rows, slices
from linewright.llm.components import components

#: Words of a shingle, seed of its hash, and most differing bits of a link.
SHINGLE, SEED, RADIUS = 4, 42, 4
#: Widths of the blocks of a fingerprint, from the low bits; any link agrees on all but RADIUS of them.
BLOCKS = (11, 11, 11, 11, 10, 10)
#: Fingerprints of one tree; a larger bucket is split by parts of the other bits.
TREE = 512


def fingerprint(text: bytes) -> int:
    """Unsigned majority bits of the XXH64 of all shingles of lower-cased words; 0 without words."""
    words = text.lower().split()
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) < SHINGLE:
        hashes = [digest(joined, SEED)]
    else:
        ends = list(itertools.accumulate(map(len, words)))
        begins = [0, *(e + i for i, e in enumerate(ends, 1))]
        hashes = [digest(joined[a : b - 1], SEED) for a, b in zip(begins, begins[SHINGLE:], strict=False)]
    bits = np.unpackbits(np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return int(np.packbits(bits.sum(0, dtype=np.int64) * 2 > len(hashes), bitorder="little").view("<u8")[0])


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(
    df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), column: str = "fingerprint"
) -> DataFrame:
    """`keep` and the fingerprint of each row's whole text as a signed long. Null and wordless texts have 0."""
    return map_rows(df, text, f"{column} long", lambda: lambda t: (signed(fingerprint(t)),), list(keep))


class Tree:
    """BK-tree of distinct integers under the Hamming distance."""

    def __init__(self) -> None:
        self.items: list[int] = []
        self.children: list[dict[int, int]] = []

    def within(self, x: int, radius: int) -> list[int]:
        """Places of the items at most `radius` away."""
        found, stack = [], [0] if self.items else []
        items, children = self.items, self.children
        while stack:
            at = stack.pop()
            d = (items[at] ^ x).bit_count()
            if d <= radius:
                found.append(at)
            for edge, child in children[at].items():
                if -radius <= edge - d <= radius:
                    stack.append(child)
        return found

    def add(self, x: int) -> int:
        self.items.append(x)
        self.children.append({})
        new = len(self.items) - 1
        at = 0
        while new:
            d = (self.items[at] ^ x).bit_count()
            child = self.children[at].setdefault(d, new)
            if child == new:
                break
            at = child
        return new


def tree_links(values: list[int], radius: int) -> list[tuple[int, int]]:
    """Links (value, least value of its group) that join what searches of one tree join; values are distinct."""
    tree, above = Tree(), list(range(len(values)))

    def root(i: int) -> int:
        while above[i] != i:
            above[i] = above[above[i]]
            i = above[i]
        return i

    for i, x in enumerate(values):
        for j in tree.within(x, radius):
            a, b = root(i), root(j)
            if a != b:
                above[max(a, b)] = min(a, b)
        tree.add(x)
    return [(x, values[root(i)]) for i, x in enumerate(values) if root(i) != i]


def bucket_links(values: np.ndarray, free: list[int], radius: int, most: int = TREE) -> list[tuple[int, int]]:
    """Links among sorted distinct unsigned values that may differ in the `free` bits only.

    Up to `most` values make one tree. More are dealt by each of radius + 1 parts of the free bits, of which
    any link agrees on one, until trees are small or the bits are used up.
    """
    if len(values) <= most or len(free) <= radius:
        return tree_links(values.tolist(), radius)
    out = []
    for part in np.array_split(np.array(free), radius + 1):
        mask = np.uint64(sum(1 << int(b) for b in part))
        key = values & mask
        order = np.argsort(key, kind="stable")
        edges = np.flatnonzero(np.diff(key[order])) + 1
        rest = [b for b in free if b not in set(part.tolist())]
        for group in np.split(order, edges):
            if 1 < len(group) < len(values):
                out += bucket_links(values[group], rest, radius, most)
            elif len(group) == len(values):  # this part tells nothing here, and every link is in this group
                return bucket_links(values, rest, radius, most)
    return out


def bucket_keys(value: Column, radius: int) -> Column:
    """Array of the buckets of a fingerprint: one for each choice of blocks that all links must agree on."""
    starts = list(itertools.accumulate(BLOCKS, initial=0))
    keys = []
    for k, chosen in enumerate(itertools.combinations(range(len(BLOCKS)), len(BLOCKS) - radius)):
        mask = sum(((1 << BLOCKS[b]) - 1) << starts[b] for b in chosen)
        keys.append(F.struct(F.lit(k).alias("k"), value.bitwiseAND(F.lit(signed(mask))).alias("b")))
    return F.array(*keys)


def links(distinct: DataFrame, column: str = "fingerprint", radius: int = RADIUS) -> DataFrame:
    """Links (a, b) between the distinct fingerprints of a table, enough to connect all that are in the radius.

    Every pair within the radius is searched for; of the links found in one bucket only a spanning part is
    given. `radius` must be less than the number of blocks. Nulls have no links.
    """
    if not 0 <= radius < len(BLOCKS):
        raise ValueError("the radius must be less than the number of blocks")
    choices = list(itertools.combinations(range(len(BLOCKS)), len(BLOCKS) - radius))
    starts = list(itertools.accumulate(BLOCKS, initial=0))
    free = [[bit for b in range(len(BLOCKS)) if b not in chosen for bit in range(starts[b], starts[b] + BLOCKS[b])]
            for chosen in choices]
    keyed = (
        distinct.filter(F.col(column).isNotNull())
        .select(F.explode(bucket_keys(F.col(column), radius)).alias("_lw_key"), F.col(column).alias("f"))
        .select("_lw_key.k", "_lw_key.b", "f")
    )
    dealt = keyed.repartition("k", "b").sortWithinPartitions("k", "b", "f")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def search(k: np.ndarray, b: np.ndarray, f: np.ndarray) -> pa.RecordBatch:
            cuts = np.flatnonzero((np.diff(k) != 0) | (np.diff(b) != 0)) + 1
            bounds = np.concatenate(([0], cuts, [len(k)]))
            out: list[tuple[int, int]] = []
            for i in np.flatnonzero(np.diff(bounds) > 1).tolist():
                begin, end = bounds[i], bounds[i + 1]
                out += bucket_links(np.sort(f[begin:end]), free[k[begin]], radius)
            pairs = np.array(out, dtype=np.uint64).reshape(-1, 2).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for batch in slices(batches):
            k, b, f = (batch.column(i).to_numpy() for i in range(3))
            f = f.view(np.uint64)
            same = (k == k[-1]) & (b == b[-1])
            start = len(k) - int(np.argmin(same[::-1])) if not same.all() else 0
            if start:  # what came before the last bucket of this batch is whole
                parts.append((k[:start], b[:start], f[:start]))
                yield search(*map(np.concatenate, zip(*parts, strict=True)))
                parts = []
            elif parts and (parts[-1][0][-1], parts[-1][1][-1]) != (k[0], b[0]):
                yield search(*map(np.concatenate, zip(*parts, strict=True)))
                parts = []
            parts.append((k[start:], b[start:], f[start:]))
        if parts:
            yield search(*map(np.concatenate, zip(*parts, strict=True)))

    return dealt.mapInArrow(run, "a long, b long")


def classes(rows: DataFrame, id_col: str = "doc_id", column: str = "fingerprint", radius: int = RADIUS) -> DataFrame:
    """(fingerprint, root, component_id, n): for each distinct fingerprint the least one and the smallest id
    that links reach from it, and its number of rows.

    Equal fingerprints collapse before the search, so copies cost nothing there. Null ids take part through
    their fingerprint, but are no class's id unless it has no other. A class of any size is spread over tasks.
    """
    distinct = cut(rows.groupBy(column).agg(F.min(id_col).alias("_lw_least"), F.count("*").alias("n")))
    roots = components(links(distinct, column, radius)).withColumnRenamed("node", column)
    rooted = cut(distinct.join(roots, column, "left").withColumn("root", F.coalesce("root", column)))
    least = rooted.groupBy("root").agg(F.min("_lw_least").alias("component_id"), F.count("*").alias("_lw_n"))
    return join_groups(rooted, least, "root", "_lw_n").select(column, "root", "component_id", "n")


def near_duplicates(
    df: DataFrame, text: str = "text", id_col: str = "doc_id", radius: int = RADIUS
) -> DataFrame:
    """id, fingerprint (16 hexadecimal digits) and component_id for each row of df.

    Rows are linked if their fingerprints differ in at most `radius` bits; the component is named by the
    smallest id in it. Null, empty and wordless texts have fingerprint zero and are linked like any other;
    repeated rows give repeated results; an empty table gives none; other columns are not read.
    """
    rows = cut(fingerprints(df, text, (id_col,)))
    found = join_groups(rows, cut(classes(rows, id_col, "fingerprint", radius)), "fingerprint", "n")
    return found.select(id_col, F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(df: DataFrame, text: str = "text", id_col: str = "doc_id", radius: int = RADIUS) -> DataFrame:
    """The rows of df, with all their columns, of which one stays of each component: that of its smallest id.

    Of rows that share the smallest id the one of the least fingerprint stays, and of rows equal in both any
    one. A null id is greater than any other. Other columns pass through unread, whatever their names.
    """
    rows = cut(fingerprints(df, text, (id_col,), "_lw_fp").withColumnRenamed(id_col, "_lw_id"))
    found = join_groups(rows, cut(classes(rows, "_lw_id", "_lw_fp", radius)), "_lw_fp", "n")
    best = found.filter(F.col("_lw_id").eqNullSafe(F.col("component_id"))).groupBy("root", "_lw_id").agg(F.min("_lw_fp").alias("_lw_fp"))
    kept = best.select("_lw_id", F.col("_lw_fp").alias("_lw_best"))
    n, ids = rows.agg(F.count("*"), F.count_distinct("_lw_id")).first()
    if n == ids:  # every id is one row's
        return df.join(kept, df[id_col] == kept["_lw_id"], "left_semi")
    marked = fingerprints(df, text, tuple(df.columns), "_lw_fp")
    same = marked[id_col].eqNullSafe(kept["_lw_id"]) & (marked["_lw_fp"] == kept["_lw_best"])
    return marked.join(kept, same, "left_semi").dropDuplicates([id_col, "_lw_fp"]).select(*df.columns)
