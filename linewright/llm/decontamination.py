"""Benchmark decontamination with one Aho-Corasick automaton (operator 9).

Texts are normalised to lower-case words, and each word of the test items is one symbol of an alphabet, other
words another; every window of ten words of an item is a pattern. Each text is scanned once, and places in it,
which are word numbers, are mapped to code points of the original.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from itertools import repeat

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linewright.llm.base import map_rows, worker_cache, written

#: Words of a window, bytes of test items in one automaton (more items are taken in blocks), and window starts of
#: one segment of a long item.
WINDOW_WORDS, BLOCK_BYTES, SEGMENT = 10, 4 << 20, 4096

#: Word bytes in lower case; any other byte becomes a space. Bytes from 128 belong to non-ASCII letters.
NORMAL = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(NORMAL).split()


def symbol(n: int) -> str:
    """The symbol of the n-th word, from 1 on; surrogates are left out."""
    return chr(n if n < 0xD800 else n + 0x800)


class Patterns:
    """The automaton of the windows of (item, text) pairs."""

    def __init__(self, items: list[tuple[str, bytes]], width: int = WINDOW_WORDS) -> None:
        owners: dict[str, set[str]] = {}
        self.symbols: dict[bytes, str] = {}
        for item, text in items:
            line = "".join([self.symbols.setdefault(w, symbol(len(self.symbols) + 1)) for w in words_of(text)])
            for i in range(max(1, len(line) - width + 1) if line else 0):
                owners.setdefault(line[i : i + width], set()).add(item)
        self.empty = not owners
        self.trie = ahocorasick.Automaton()
        for pattern, own in owners.items():
            self.trie.add_word(pattern, (len(pattern), tuple(sorted(own))))
        if owners:
            self.trie.make_automaton()

    def scan(self, text: bytes) -> tuple[int, list[tuple[int, int]], set[str]]:
        """Number of words, word ranges of the windows found (merged, end exclusive), and items found."""
        words = words_of(text)
        if self.empty or not words:
            return len(words), [], set()
        line = "".join(map(self.symbols.get, words, repeat("\0")))
        found = [(end + 1 - n, end + 1, own) for end, (n, own) in self.trie.iter(line)]
        return len(words), merge(sorted((a, b) for a, b, _ in found)), {x for *_, own in found for x in own}


def segments(text: bytes, width: int) -> list[bytes]:
    """Parts of an item's words that hold each of its windows once, none of more than SEGMENT windows."""
    words = words_of(text)
    starts = max(1, len(words) - width + 1) if words else 0
    return [b" ".join(words[a : min(a + SEGMENT, starts) + width - 1]) for a in range(0, starts, SEGMENT)]


def merge(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted ranges with touching or overlapping ones joined."""
    out: list[tuple[int, int]] = []
    for a, b in ranges:
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def original_spans(text: bytes, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Code points of the original, end exclusive, that word ranges cover."""
    if not ranges:
        return []
    inside = np.frombuffer(text.translate(NORMAL), np.uint8) != 32
    edge = np.flatnonzero(np.diff(np.concatenate(([0], inside.view(np.int8), [0]))))
    begins, ends = edge[::2], edge[1::2]
    point = np.concatenate(([0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)))
    return [(int(point[begins[a]]), int(point[ends[b - 1]])) for a, b in ranges]


def _result(text: bytes, n_words: int, ranges: list[tuple[int, int]], items: set[str]) -> tuple:
    hit = sum(b - a for a, b in ranges)
    names = ",".join(sorted(items)).encode()
    return n_words, hit, len(items), hashlib.sha256(names).hexdigest(), hit > 0, ",".join(
        f"{a}:{b}" for a, b in original_spans(text, ranges)
    )


def _schema(prefix: str) -> str:
    kinds = {"n_words": "long", "n_hit": "long", "n_items": "long", "items_sha256": "string", "contaminated": "boolean", "spans": "string"}
    return ", ".join(f"{prefix}{name} {kind}" for name, kind in kinds.items())


def _worker(shared, width: int, whole: bool) -> Callable[[], Callable[[bytes], tuple]]:
    def make() -> Callable[[bytes], tuple]:
        items = shared.value
        key = ("windows", width, hashlib.sha256(repr(items).encode()).digest())
        scan = worker_cache(key, lambda: Patterns(items, width), 2).scan
        if whole:
            return lambda text: _result(text, *scan(text))

        def part(text: bytes) -> tuple:
            n, ranges, own = scan(text)
            return [{"a": a, "b": b} for a, b in ranges], sorted(own)

        return part

    return make


def scan_documents(
    docs: DataFrame,
    items: DataFrame,
    text_col: str = "text",
    keep: tuple[str, ...] = ("doc_id",),
    item_id: str = "item_id",
    item_text: str = "text",
    width: int = WINDOW_WORDS,
    block_bytes: int = BLOCK_BYTES,
    prefix: str = "",
) -> DataFrame:
    """`keep`, n_words, n_hit, n_items, items_sha256, contaminated and spans for each row of docs.

    A window is `width` consecutive words of an item, or all of a shorter item; a word inside any occurrence
    of a window is hit. `spans` are the hit runs as begin:end in code points of the original text. Null and
    empty texts have no words; items without words have no windows; a null item_id is named "null"; repeated
    items count once by id, and repeated documents give repeated rows. Empty tables give no rows or no hits.

    `prefix` stands before the names of the new columns, for tables that have such names already.

    The items' size is measured first. Up to `block_bytes` they are one broadcast automaton and the texts are
    scanned once, without a shuffle. Beyond it their segments are dealt into blocks of half that size, about, one
    after the other: each is broadcast, scanned for, its hits written to the shared folder, and then let go, on the
    driver and by the workers, so no more than one is held. The hits are brought together by a digest of the text
    and joined to the rows once.
    """
    spark = docs.sparkSession
    source = items.select(
        F.coalesce(items[item_id].cast("string"), F.lit("null")).alias("i"),
        F.coalesce(items[item_text], F.lit("")).alias("t"),
    ).distinct()
    cut_up = map_rows(source, "t", "s array<string>", lambda: lambda t: ([x.decode("utf-8", "replace") for x in segments(t, width)],), ["i"])
    source = cut_up.select("i", F.explode("s").alias("t")).distinct()
    total = source.agg(F.sum(F.octet_length("t") + F.octet_length("i") + 16)).first()[0] or 0

    def share(part: DataFrame):
        return spark.sparkContext.broadcast(sorted((i, t.encode()) for i, t in part.toLocalIterator()))

    if total <= block_bytes:
        return map_rows(docs, text_col, _schema(prefix), _worker(share(source), width, True), list(keep))

    blocks = -(-2 * total // block_bytes)
    source = written(source.withColumn("k", F.pmod(F.xxhash64("i", "t"), F.lit(blocks))))
    narrow = docs.select(*[docs[c] for c in keep], docs[text_col].alias("_lw_body"),
                         F.sha2(F.coalesce(docs[text_col], F.lit("")), 256).alias("_lw_key"))
    hits = None
    for k in range(blocks):
        block = share(source.filter(F.col("k") == k).select("i", "t"))
        made = map_rows(
            narrow.select("_lw_key", "_lw_body"), "_lw_body",
            "_lw_ranges array<struct<a:int,b:int>>, _lw_items array<string>", _worker(block, width, False), ["_lw_key"],
        ).filter(F.size("_lw_items") > 0).dropDuplicates(["_lw_key"])
        told = written(made)
        block.destroy()
        hits = told if hits is None else hits.unionByName(told)
    hits = hits.groupBy("_lw_key").agg(F.flatten(F.collect_list("_lw_ranges")).alias("_lw_ranges"),
                                       F.array_distinct(F.flatten(F.collect_list("_lw_items"))).alias("_lw_items"))
    joined = narrow.join(hits, "_lw_key", "left")
    packed = F.to_json(F.struct(F.transform("_lw_ranges", lambda r: F.array(r.a, r.b)).alias("r"),
                                F.col("_lw_items").alias("i")))
    both = F.concat(packed, F.lit("\n"), F.coalesce("_lw_body", F.lit("")))

    def finish() -> Callable[[bytes], tuple]:
        import json

        def row(data: bytes) -> tuple:
            head, _, text = data.partition(b"\n")
            said = json.loads(head)
            ranges = merge(sorted(tuple(r) for r in said.get("r") or []))
            return _result(text, len(words_of(text)), ranges, set(said.get("i") or []))

        return row

    return map_rows(joined.select(*keep, both.alias("_lw_both")), "_lw_both", _schema(prefix), finish, list(keep))
