"""Removal of repeated byte strings by bucket-pointer refinement (operator 8).

A suffix array sorted to the depth of one string length is all that is needed: which strings of that length
also start earlier. As in bucket-pointer refinement, starts are first put into buckets by their q-grams, and
buckets are refined by sorting on the identifiers of later offsets, whose updates are used again.

The first buckets are kept only at anchors: starts whose q-gram is least, by a hash, in some string of the
length. Equal strings have equal anchors, so each string is judged at its anchors alone, about 3 % of all
starts. Anchors whose surroundings, all that strings around them can hold, have one digest repeat the earliest in
full. Of buckets that hold different surroundings one member of each is taken, with its bytes. Their buckets are
refined byte by byte to the right and to the left of the q-gram, each step by sorting on the identifiers of the
next offset and reusing those of the last, and at last, for every string through the anchor, the buckets of its
right part by sorting on those of its left part. A bucket of very many members is not brought together: its anchors
are dealt by their surroundings, and digests of all strings through them instead of their bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linewright.llm.base import partitions, slices, texts_of, written

#: Bytes of a string and of the q-gram of the first buckets (a power of two, and 2q less than LENGTH).
LENGTH, Q = 100, 32
#: Anchors of one block of a map task; a task holds one block at a time.
BLOCK_ANCHORS = 400_000
#: Bytes of texts, or of a part of one, whose identifiers are held at once.
PIECE = 1 << 20
#: Bytes of texts whose anchors make one part of a shuffle, and members of a bucket that are refined together.
PART_BYTES, MOST_MEMBERS = 64 << 20, 100_000
#: One in so many documents tells beforehand which buckets have too many anchors for one task, and the most of them.
#: It decides where anchors meet, not what is found.
SAMPLE, MOST_HOT = 64, 100_000

MIX = np.uint64(0x9E3779B97F4A7C15)
#: Hashes of the 256 bytes, and of what lies outside a text; they choose anchors and buckets, not equal strings.
BYTE_IDS = np.random.default_rng(20).integers(1, 1 << 63, 257, dtype=np.uint64) | np.uint64(1)
OUTSIDE = 256


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * MIX
    return x ^ (x >> np.uint64(29))


def grown(ids: np.ndarray, gap: int) -> np.ndarray:
    """Hashes of longer strings: those at each offset combined with those `gap` later."""
    return mix(ids[:-gap] * MIX + ids[gap:])


def refined(bucket: np.ndarray, later: np.ndarray) -> np.ndarray:
    """Bucket identifiers after each bucket is sorted by its members' identifiers at a later offset and split.

    Identifiers of buckets stay under five times the members; buckets of one member stay as they are.
    """
    open_ = np.flatnonzero(np.bincount(bucket)[bucket] > 1)
    if not len(open_):
        return bucket
    key = bucket[open_].astype(np.uint64) << np.uint64(32) | later[open_].astype(np.uint64)
    order = np.argsort(key, kind="stable")
    out = bucket.copy()
    out[open_[order]] = bucket.max() + 1 + np.cumsum(np.concatenate(([0], key[order][1:] != key[order][:-1])))
    return np.unique(out, return_inverse=True)[1] if out.max() > 4 * len(out) else out


def digests(data: bytes, begins: list[int], ends: list[int], marks: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """128-bit digests of parts of some bytes, each behind a small number, as two columns."""
    digest, mark = hashlib.blake2b, [bytes([i]) for i in range(256)]
    made = b"".join([digest(mark[m] + data[a:b], digest_size=16).digest() for a, b, m in zip(begins, ends, marks, strict=True)])
    both = np.frombuffer(made, np.uint64).reshape(-1, 2)
    return both[:, 0], both[:, 1]


def sliding(least: bool, x: np.ndarray, width: int) -> np.ndarray:
    """Least or greatest of every `width` neighbours."""
    pick, n, reach = (np.minimum if least else np.maximum), len(x) - width + 1, 1
    out = x
    while 2 * reach <= width:
        out = pick(out[:-reach], out[reach:])
        reach *= 2
    return pick(out[:n], out[width - reach : width - reach + n])


def pieces(texts: list[bytes]) -> Iterator[tuple[int, int, bytes, int, int]]:
    """(text number, begin, bytes, first, stop) of parts of texts whose strings start in [first, stop) of the part.

    A part holds the surroundings of all its anchors, so a text of any length is taken PIECE starts at a time.
    """
    side = LENGTH - Q
    for i, t in enumerate(texts):
        starts = len(t) - LENGTH + 1
        for a in range(0, max(0, starts), PIECE):
            b = min(a + PIECE, starts)
            begin = max(0, a - side)
            yield i, begin, t[begin : b + LENGTH + side], a - begin, b - begin


def anchors(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """(text number, place, bucket, two columns of surroundings) of the anchors of some texts.

    The surroundings are the bytes from LENGTH - Q before the q-gram to LENGTH after its start, or as many of
    them as the text has; their digest tells where the text begins.
    """
    none, no = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    found, held, size, cut = [(none, none, no, no, no)], [], 0, False
    for piece in pieces(texts):
        held.append(piece)
        size += len(piece[2])
        cut |= piece[1] > 0
        if size >= PIECE:
            found.append(_anchors(held))
            held, size = [], 0
    if held:
        found.append(_anchors(held))
    columns = [np.concatenate(c) for c in zip(*found, strict=True)]
    if cut:  # neighbouring parts of a text may both report an anchor
        _, kept = np.unique(columns[0] << 40 | columns[1], return_index=True)
        columns = [c[kept] for c in columns]
    return tuple(columns)


def _anchors(parts: list[tuple[int, int, bytes, int, int]]) -> tuple[np.ndarray, ...]:
    side = LENGTH - Q
    gap = np.full(LENGTH + side, OUTSIDE, np.int16)
    joined, offsets, at = [gap], [], len(gap)
    for _, _, data, _, _ in parts:
        joined += [np.frombuffer(data, np.uint8), gap]
        offsets.append(at)
        at += len(data) + len(gap)
    text, begin, first, stop = (np.array([p[i] for p in parts], np.int64) for i in (0, 1, 3, 4))
    offset = np.array(offsets, np.int64)
    grams = BYTE_IDS[np.concatenate(joined)]
    n = 1
    while n < Q:
        grams = grown(grams, n)
        n *= 2
    lows = sliding(True, grams, side + 1)
    whole = np.zeros(len(lows) + 1, np.int32)  # only strings inside one text count
    np.add.at(whole, offset + first, 1)
    np.add.at(whole, offset + stop, -1)
    lows = np.where(np.cumsum(whole[:-1]) > 0, lows, np.uint64(0))
    pad = np.zeros(side, np.uint64)
    high = sliding(False, np.concatenate((pad, lows, pad)), side + 1)
    place = np.flatnonzero((high == grams[: len(high)]) & (high > 0))
    which = np.searchsorted(offset, place, "right") - 1
    data, start = b"".join([p[2] for p in parts]), np.cumsum([0, *(len(p[2]) for p in parts)])
    local = place - offset[which]
    first_byte, last_byte = np.maximum(local - side, 0), np.minimum(local + LENGTH, np.diff(start)[which])
    one, two = digests(data, (first_byte + start[which]).tolist(), (last_byte + start[which]).tolist(), (local - first_byte).tolist())
    return text[which], local + begin[which], grams[place], one, two


def pack(*columns: np.ndarray) -> bytes:
    """Columns of equal length as one compressed block; numbers of documents and places as differences."""
    head = np.array([len(columns[0])], np.int64).tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(np.ascontiguousarray(c).tobytes() for c in columns))


def unpack(block: bytes, kinds: tuple[str, ...]) -> list[np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(block)
    n, at, out = int(np.frombuffer(data, np.int64, 1)[0]), 8, []
    for kind in kinds:
        out.append(np.frombuffer(data, kind, n, at))
        at += n * np.dtype(kind).itemsize
    return out


#: Columns of a block of anchors, of spans, and of surroundings with their bytes.
ANCHORS = ("u8", "u8", "u8", "i8", "i4", "i8")  # bucket, surroundings twice, document, part of it, place
SPANS = ("i8", "i4", "i8", "i8")  # document, part of it, begin, end
AROUND = f"S{2 * LENGTH - Q}"
MEMBERS = ("u8", "i8", "i4", "i8", "i2", "i2", AROUND)  # bucket, document, part, place, bytes before, bytes after, bytes
STRINGS = ("u8", "u8", "i8", "i4", "i8")  # digest twice, document, part of it, begin


def _first_of(one: np.ndarray, two: np.ndarray, doc: np.ndarray, part: np.ndarray, place: np.ndarray):
    """Order by digest and earliest start, and flags of new digests in it.

    Repeated rows of a document give the same starts, of which one is left in the order.
    """
    order = np.lexsort((place, part, doc, two, one))
    a, b = one[order], two[order]
    new = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
    same = np.flatnonzero(~new)
    for column in (place, doc, part):
        same = same[column[order[same]] == column[order[same - 1]]]
    return (np.delete(order, same), np.delete(new, same)) if len(same) else (order, new)


def _dealt(to: np.ndarray, columns: list[np.ndarray]) -> Iterator[tuple[int, bytes]]:
    """A block of the columns for each part."""
    by = np.argsort(to, kind="stable")
    for group in np.split(by, np.flatnonzero(np.diff(to[by])) + 1):
        if len(group):
            yield int(to[group[0]]), pack(*(c[group] for c in columns))


def _blocks(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())],
        names=["to", "kind", "block"])


def _span(place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.maximum(place - (LENGTH - Q), 0), place + LENGTH


def _buckets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, n): the anchors of each batch by bucket."""
    for batch in slices(batches):
        found, n = np.unique(anchors(texts_of(batch.column(0)))[2].view(np.int64), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n, pa.int64())], names=["bucket", "n"])


def hot_buckets(docs: DataFrame) -> np.ndarray:
    """Buckets of more anchors than are refined together, by a sample of the documents; at most MOST_HOT, sorted."""
    some = docs.filter(F.pmod(F.xxhash64("doc", "part"), F.lit(SAMPLE)) == 0).select("_lw_text")
    counts = some.mapInArrow(_buckets, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).filter(F.col("n") * SAMPLE > MOST_MEMBERS)
    most = counts.orderBy(F.desc("n"), "bucket").limit(MOST_HOT).select("bucket").toArrow()
    return np.sort(most["bucket"].to_numpy().astype(np.int64).view(np.uint64))


def _map_anchors(parts: int, hot: np.ndarray) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Blocks of anchors, dealt by bucket, those of hot buckets by surroundings; what repeats an earlier start of the
    same block is settled at once."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []

        def block() -> pa.RecordBatch:
            columns = [np.concatenate(c) for c in zip(*held, strict=True)]
            held.clear()
            bucket, one, two, doc, part, place = columns
            order, new = _first_of(one, two, doc, part, place)
            again, first = np.sort(order[~new]), np.sort(order[new])
            rows = [(int(doc[again[0]]) % parts, SETTLED, pack(doc[again], part[again], *_span(place[again])))] if len(again) else []
            by = np.where(np.isin(bucket[first], hot), one[first], bucket[first]) if len(hot) else bucket[first]
            return _blocks(rows + [(t, OPEN, b) for t, b in _dealt((by % np.uint64(parts)).astype(np.int64), [c[first] for c in columns])])

        for batch in slices(batches):
            which, place, bucket, one, two = anchors(texts_of(batch.column(2)))
            if len(which):
                doc, part = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                held.append([bucket, one, two, doc[which], part[which], place])
                if sum(len(h[0]) for h in held) >= BLOCK_ANCHORS:
                    yield block()
        if held:
            yield block()

    return run


#: Kinds of blocks: what is to be compared, spans, and strings of hot buckets by digest.
OPEN, SETTLED, HOT_STRINGS = 0, 1, 2


def _runs(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple[int, bytes]]]]:
    """The (kind, block) rows of each part; rows come sorted by part."""
    now, rows = None, []
    for batch in batches:
        for to, kind, block in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if to != now and rows:
                yield now, rows
                rows = []
            now = to
            rows.append((kind, block))
    if rows:
        yield now, rows


def _info(doc, part, begin, end, bucket) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(doc, pa.int64()), pa.array(part, pa.int32()), pa.array(begin, pa.int64()), pa.array(end, pa.int64()),
         pa.array(np.ascontiguousarray(bucket).view(np.int64), pa.int64())],
        names=["doc", "part", "begin", "end", "bucket"],
    )


INFO = "doc long, part int, begin long, end long, bucket long"


def _settled(rows: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
    for kind, data in rows:
        if kind == SETTLED:
            doc, part, begin, end = unpack(data, SPANS)
            yield _info(doc, part, begin, end, np.zeros(len(doc), np.int64))


def _joined(rows: list[tuple[int, bytes]], kind: int, kinds: tuple[str, ...]) -> list[np.ndarray]:
    blocks = [unpack(data, kinds) for k, data in rows if k == kind]
    return [np.concatenate(c) for c in zip(*blocks, strict=True)]


def _reduce_anchors(hot: np.ndarray) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Spans of anchors whose surroundings start earlier, and places of the first of each surroundings, in buckets with
    several, to be refined: end is -1, or -2 in buckets of too many."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _runs(batches):
            yield from _settled(rows)
            columns = _joined(rows, OPEN, ANCHORS)
            if not columns:
                continue
            bucket, one, two, doc, part, place = columns
            order, new = _first_of(one, two, doc, part, place)
            again, first = order[~new], order[new]
            if len(again):
                yield _info(doc[again], part[again], *_span(place[again]), np.zeros(len(again), np.int64))
            _, which, counts = np.unique(bucket[first], return_inverse=True, return_counts=True)
            members = np.where(np.isin(bucket[first], hot), MOST_MEMBERS + 1, counts[which])
            open_, end = first[members > 1], np.where(members > MOST_MEMBERS, -2, -1)[members > 1]
            if len(open_):
                yield _info(doc[open_], part[open_], place[open_], end, bucket[open_])

    return run


def _documents(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[tuple, list[dict], tuple]]:
    """For each document its key, its rows (the text with the first alone) and its info; rows come sorted, texts first.

    Columns: doc, part, kind, begin, end, bucket, data, then those of the result.
    """
    now, texts, infos = None, [], []
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        doc, part, kind, begin, end, bucket = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(6))
        edges = np.flatnonzero((np.diff(doc) != 0) | (np.diff(part) != 0)) + 1
        for a, b in zip([0, *edges.tolist()], [*edges.tolist(), n], strict=True):
            key = (int(doc[a]), int(part[a]))
            if key != now:
                if texts:
                    yield now, texts, infos
                now, texts, infos = key, [], []
            k = int(np.searchsorted(kind[a:b], 1)) + a
            for i in range(a, k):
                texts.append((None if texts else batch.column(6)[i].as_py(), batch.column(7)[i].as_py()))
            if b > k:
                infos.append((begin[k:b].copy(), end[k:b].copy(), bucket[k:b].copy()))
    if texts:
        yield now, texts, infos


def _members(parts: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Blocks of the anchors to be refined, with their surroundings in bytes; of hot buckets (end -2) the strings.

    Of strings that one block holds more than once the earliest goes on, and the others are settled at once.
    """
    side, most = LENGTH - Q, 2 * LENGTH - Q

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        hot: list[tuple] = []

        def block() -> pa.RecordBatch:
            columns = [np.array(c, k) for c, k in zip(zip(*held, strict=True), MEMBERS, strict=True)]
            held.clear()
            return _blocks([(t, OPEN, b) for t, b in _dealt((columns[0] % np.uint64(parts)).astype(np.int64), columns)])

        def strings() -> pa.RecordBatch:
            one, two, doc, part, begin = (np.concatenate(c) for c in zip(*hot, strict=True))
            hot.clear()
            order, new = _first_of(one, two, doc, part, begin)
            again, first = order[~new], order[new]
            rows = [(int(doc[again[0]]) % parts, SETTLED, pack(doc[again], part[again], begin[again], begin[again] + LENGTH))] if len(again) else []
            kept = [c[first] for c in (one, two, doc, part, begin)]
            return _blocks(rows + [(t, HOT_STRINGS, b) for t, b in _dealt((one[first] % np.uint64(parts)).astype(np.int64), kept)])

        unzip = zstandard.ZstdDecompressor()
        for (doc, part), texts, infos in _documents(batches):
            if not infos:
                continue
            begin, end, bucket = (np.concatenate(c) for c in zip(*infos, strict=True))
            text = unzip.decompress(texts[0][0])
            for p, kind, b in zip(begin.tolist(), end.tolist(), bucket.tolist(), strict=True):
                before, after = min(p, side), min(len(text) - p, LENGTH)
                if kind == -1:
                    piece = text[p - before : p + after]
                    held.append((b & (1 << 64) - 1, doc, part, p, before, after,
                                 b"\0" * (side - before) + piece + b"\0" * (most - side - after)))
                else:
                    begins = np.arange(p - before, p + after - LENGTH + 1)
                    one, two = digests(text, begins.tolist(), (begins + LENGTH).tolist(), [0] * len(begins))
                    n = len(begins)
                    hot.append((one, two, np.full(n, doc), np.full(n, part, np.int32), begins))
            if len(held) >= BLOCK_ANCHORS // 8:
                yield block()
            if len(hot) >= BLOCK_ANCHORS // 64:
                yield strings()
        if held:
            yield block()
        if hot:
            yield strings()

    return run


def _reduce_members(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of the strings through refined anchors, and of strings of hot buckets, that start earlier too."""
    for _, rows in _runs(batches):
        yield from _settled(rows)
        columns = _joined(rows, HOT_STRINGS, STRINGS)
        if columns:
            one, two, doc, part, begin = columns
            order, new = _first_of(one, two, doc, part, begin)
            again = order[~new]
            yield _info(doc[again], part[again], begin[again], begin[again] + LENGTH, np.zeros(len(again), np.int64))
        columns = _joined(rows, OPEN, MEMBERS)
        if columns:
            order = np.lexsort((columns[3], columns[2], columns[1], columns[0]))  # earliest of a bucket first: stable sorts keep it so
            edges = np.flatnonzero(np.diff(columns[0][order])) + 1
            at = 0
            while at < len(order):  # whole buckets, some MOST_MEMBERS members at once
                far = int(np.searchsorted(edges, at + MOST_MEMBERS))
                stop_at = int(edges[far]) if far < len(edges) else len(order)
                _, doc, part, place, before, after, around = (c[order[at:stop_at]] for c in columns)
                who, first, stop = repeated_strings(around.view(np.uint8).reshape(len(around), -1), before, after)
                begin = place[who] - (LENGTH - Q) + first
                yield _info(doc[who], part[who], begin, begin + (stop - first - 1) + LENGTH, np.zeros(len(who), np.int64))
                at = stop_at


def repeated_strings(around: np.ndarray, before: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(member, first, stop) of the runs of offsets at which a member's string equals one of an earlier member.

    `around` holds each member's bytes, its q-gram at offset LENGTH - Q; `before` and `after` tell how many bytes
    before its q-gram, and from its start on, belong to its text. Bytes are compared, not hashes.
    """
    side, n = LENGTH - Q, len(around)
    grams = np.ascontiguousarray(around[:, side:LENGTH]).view(f"V{Q}").ravel()
    right = np.unique(grams, return_inverse=True)[1].astype(np.int32)  # buckets of the q-gram and the o bytes behind it
    left = [right]  # and of it and k bytes before it
    for k in range(side):
        left.append(refined(left[-1], around[:, side - 1 - k]).astype(np.int32))
    again = np.zeros((n, side + 1), bool)
    for o in range(side + 1):
        right = refined(right, around[:, LENGTH + o - 1]) if o else right
        has = np.flatnonzero((before >= side - o) & (after >= o + LENGTH - side))
        if len(has) < 2:
            continue
        whole = refined(right[has], left[side - o][has])
        by = np.argsort(whole, kind="stable")
        again[has[by[1:][whole[by][1:] == whole[by][:-1]]], o] = True
    edges = np.diff(again.view(np.int8), axis=1, prepend=np.int8(0), append=np.int8(0))
    who, first = np.nonzero(edges == 1)
    return who, first, np.nonzero(edges == -1)[1]


def _kept(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The result of each document: what is left without the bytes of its spans."""
    unzip = zstandard.ZstdDecompressor()
    out: list[tuple] = []

    def made() -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
        columns = [pa.array(list(c), k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]
        out.clear()
        return pa.RecordBatch.from_arrays(columns, names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed"])

    for _, texts, infos in _documents(batches):
        text = unzip.decompress(texts[0][0])
        digest, spans, gone, at = hashlib.sha256(), [], 0, 0
        if infos:
            begin, end = (np.concatenate(c) for c in list(zip(*infos, strict=True))[:2])
            real = end >= 0
            begin, end = begin[real], np.minimum(end[real], len(text))
            order = np.argsort(begin, kind="stable")
            begin, reach = begin[order], np.maximum.accumulate(end[order]) if len(order) else end
            starts = np.flatnonzero(np.concatenate(([True], begin[1:] > reach[:-1]))) if len(order) else order
            stops = [*(starts[1:] - 1).tolist(), len(begin) - 1]
            spans = [(int(begin[i]), int(reach[j])) for i, j in zip(starts.tolist(), stops, strict=False)]
        for a, b in spans:
            digest.update(text[at:a])
            gone, at = gone + b - a, b
        digest.update(text[at:])
        row = (len(text), gone, len(spans), digest.hexdigest(), ",".join(f"{a}:{b}" for a, b in spans))
        out += [(orig, *row) for _, orig in texts]
        if len(out) >= 2000:
            yield made()
    if out:
        yield made()


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id, n_bytes, n_removed, n_spans, kept_sha256 and removed (begin:end in bytes) for each row of df.

    A byte of a text goes if a string of LENGTH bytes covers it that also starts earlier: in a document of
    smaller id, or in the same one before. Strings are judged on the input and never cross documents. Null
    texts are empty; a null id (an integer otherwise) is smaller than any. Rows of equal id and text are one
    document, and each gives its result; rows of equal id and other text are ordered by a hash of the text.
    An empty table gives no rows; other columns are not read.

    Blocks of anchors are shuffled by bucket, members of buckets with several surroundings by bucket, and strings of
    buckets of over MOST_MEMBERS by digest; two shuffles carry the compressed texts, by document, to meet what was
    found. A string that occurs everywhere leaves each map task once, and no bucket is brought into one task that is
    too large for it. Surroundings and strings of hot buckets are compared by BLAKE2 digests of 128 bits, other
    strings by their bytes.
    """
    spark = df.sparkSession
    texts = df.select(df[id_col].cast("long").alias("_lw_id"), F.coalesce(df[text], F.lit("")).alias("_lw_text"))
    key = F.coalesce("_lw_id", F.lit(-(1 << 63)).cast("long"))
    hashed = texts.select(key.alias("doc"), F.xxhash64("_lw_text").alias("h"), F.octet_length("_lw_text").alias("size")).distinct()
    by_doc = hashed.groupBy("doc").agg(F.count("*").alias("n"), F.sort_array(F.collect_set("h")).alias("hs"), F.sum("size").alias("size"))
    most, size = by_doc.agg(F.max("n"), F.sum("size")).first()
    parts = max(partitions(spark), -(-(size or 0) // PART_BYTES))
    if (most or 0) < 2:
        docs = texts.select(key.alias("doc"), F.lit(0).alias("part"), "_lw_text", "_lw_id")
    else:  # some id has different texts: they are ranked
        ranks = by_doc.filter("n > 1").select("doc", F.posexplode("hs").alias("part", "h"))
        docs = texts.withColumn("doc", key).withColumn("h", F.xxhash64("_lw_text")).join(ranks, ["doc", "h"], "left").select(
            "doc", F.coalesce("part", F.lit(0)).alias("part"), "_lw_text", "_lw_id"
        )

    blocks = "to long, kind int, block binary"
    hot = hot_buckets(docs)
    mapped = docs.select("doc", "part", "_lw_text").mapInArrow(_map_anchors(parts, hot), blocks)
    info = written(mapped.repartition(parts, "to").sortWithinPartitions("to").mapInArrow(_reduce_anchors(hot), INFO))
    squeezed = docs.mapInArrow(_squeeze, "doc long, part int, data binary, id long")

    def beside(found: DataFrame) -> DataFrame:
        """Texts and what was found of them, document by document."""
        rows = squeezed.select("doc", "part", F.lit(0).alias("kind"), *(F.lit(0).cast("long").alias(c) for c in ("begin", "end", "bucket")), "data", "id")
        more = found.select("doc", "part", F.lit(1).alias("kind"), "begin", "end", "bucket",
                            F.lit(None).cast("binary").alias("data"), F.lit(None).cast("long").alias("id"))
        return rows.unionByName(more).repartition(parts, "doc", "part").sortWithinPartitions("doc", "part", "kind")

    members = beside(info.filter("end < 0")).mapInArrow(_members(parts), blocks)
    refined_ = members.repartition(parts, "to").sortWithinPartitions("to").mapInArrow(_reduce_members, INFO)
    found = info.filter("end >= 0").unionByName(refined_)
    result = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed string"
    return beside(found).mapInArrow(_kept, result).withColumnRenamed("id", id_col)


def _squeeze(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    squeeze = zstandard.ZstdCompressor(level=1).compress
    for batch in slices(batches):
        data = pa.array([squeeze(t) for t in texts_of(batch.column(2))], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), data, batch.column(3)], names=["doc", "part", "data", "id"])
