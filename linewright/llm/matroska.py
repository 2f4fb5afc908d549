"""Matroska as a store for media columns: writer, parser and packet tables (operator 3).

A payload becomes 8-bit PCM samples in one audio track: EBML header, segment, info, tracks, clusters of
simple blocks in all four lacings, and cues. The parser reads variable-length elements of any such file,
block groups and elements of unknown size included, and gives a packet for every laced frame with its
track, timestamp and byte range; features are computed from the bytes at those ranges.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linewright.llm.base import map_rows

# Element identifiers of the Matroska format.
EBML, EBML_VERSION, EBML_READ_VERSION, EBML_MAX_ID, EBML_MAX_SIZE = 0x1A45DFA3, 0x4286, 0x42F7, 0x42F2, 0x42F3
DOC_TYPE, DOC_TYPE_VERSION, DOC_TYPE_READ_VERSION = 0x4282, 0x4287, 0x4285
SEGMENT, INFO, TIMESTAMP_SCALE, DURATION, MUXING_APP, WRITING_APP = 0x18538067, 0x1549A966, 0x2AD7B1, 0x4489, 0x4D80, 0x5741
TRACKS, TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, FLAG_LACING = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x9C
CODEC_ID, AUDIO, SAMPLING_FREQUENCY, CHANNELS, BIT_DEPTH = 0x86, 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER, CLUSTER_TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, REFERENCE_BLOCK = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1, 0xFB
CUES, CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
SEEK_HEAD, CHAPTERS, TAGS, ATTACHMENTS = 0x114D9B74, 0x1043A770, 0x1254C367, 0x1941A469
DEFAULT_DURATION = 0x23E383

TOP_LEVEL = frozenset({SEGMENT, SEEK_HEAD, INFO, TRACKS, CLUSTER, CUES, CHAPTERS, TAGS, ATTACHMENTS, EBML})
LACINGS = ("none", "xiph", "fixed", "ebml")

#: Samples of a frame, samples a millisecond, and the blocks of a cluster as (lacing, frames).
FRAME, RATE_MS = 576, 8
PATTERN = ((0, 1), (1, 4), (2, 8), (3, 8)) * 3


class MatroskaError(ValueError):
    """The bytes are no Matroska file that this parser can read."""


class Packet(NamedTuple):
    track: int
    timestamp_ns: int
    offset: int
    size: int
    keyframe: bool
    lacing: str
    cluster: int


class Media(NamedTuple):
    doc_type: str
    tracks: list[dict]
    packets: list[Packet]
    cues: list[tuple[int, int, int]]
    clusters: list[int]
    duration_ns: int


def size_vint(value: int) -> bytes:
    """A size as a variable-length integer; all ones are kept for unknown sizes."""
    n = 1
    while value >= (1 << 7 * n) - 1:
        n += 1
    return (value | 1 << 7 * n).to_bytes(n, "big")


def element(ident: int, body: bytes) -> bytes:
    return ident.to_bytes((ident.bit_length() + 7) // 8, "big") + size_vint(len(body)) + body


def unsigned(ident: int, value: int) -> bytes:
    return element(ident, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


def lace_header(kind: int, sizes: list[int]) -> bytes:
    """What stands between a block's flags and its frames."""
    if not kind:
        return b""
    head = bytearray([len(sizes) - 1])
    if kind == 1:
        for s in sizes[:-1]:
            head += b"\xff" * (s // 255) + bytes([s % 255])
    elif kind == 3 and len(sizes) > 1:
        head += size_vint(sizes[0])
        for before, s in zip(sizes, sizes[1:-1], strict=False):
            n = 1
            while not -(1 << 7 * n - 1) < s - before < (1 << 7 * n - 1):
                n += 1
            head += (s - before + (1 << 7 * n - 1) - 1 | 1 << 7 * n).to_bytes(n, "big")
    return bytes(head)


def uneven(frames: int) -> list[int]:
    """Sizes of frames that together hold `frames` frames' samples, whole milliseconds each."""
    sizes = [FRAME + 2 * RATE_MS * (j % 3 - 1) for j in range(frames - 1)]
    return [*sizes, frames * FRAME - sum(sizes)]


LAYOUTS = {(k, n): uneven(n) if k in (1, 3) else [FRAME] * n for k in range(4) for n in range(1, 9)}
HEADS = {key: lace_header(key[0], sizes) for key, sizes in LAYOUTS.items()}
FLAGS = (0x80, 0x82, 0x84, 0x86)


def pad(payload: bytes) -> bytes:
    """The payload with bytes 255 up to a positive multiple of FRAME."""
    return payload + b"\xff" * (FRAME * max(1, -(-len(payload) // FRAME)) - len(payload))


def write_matroska(payload: bytes) -> bytes:
    """A Matroska file whose only track has these bytes as samples; a positive multiple of FRAME of them."""
    if not payload or len(payload) % FRAME:
        raise ValueError("a payload is a positive multiple of a frame")
    info = element(INFO, unsigned(TIMESTAMP_SCALE, 1_000_000)
                   + element(DURATION, struct.pack(">d", len(payload) / RATE_MS))
                   + element(MUXING_APP, b"linewright") + element(WRITING_APP, b"linewright"))
    audio = (element(SAMPLING_FREQUENCY, struct.pack(">d", RATE_MS * 1000.0)) + unsigned(CHANNELS, 1)
             + unsigned(BIT_DEPTH, 8))
    tracks = element(TRACKS, element(TRACK_ENTRY, unsigned(TRACK_NUMBER, 1) + unsigned(TRACK_UID, 1)
                                     + unsigned(TRACK_TYPE, 2) + unsigned(FLAG_LACING, 1)
                                     + unsigned(DEFAULT_DURATION, FRAME * 1_000_000 // RATE_MS)
                                     + element(CODEC_ID, b"A_PCM/INT/LIT") + element(AUDIO, audio)))
    body, cues, pos = bytearray(info + tracks), bytearray(), 0
    while pos < len(payload):
        start = pos
        parts = [unsigned(CLUSTER_TIMESTAMP, start // RATE_MS)]
        for kind, frames in PATTERN:
            n = min(frames, (len(payload) - pos) // FRAME)
            if not n:
                break
            head = struct.pack(">BhB", 0x81, (pos - start) // RATE_MS, FLAGS[kind]) + HEADS[kind, n]
            parts += [b"\xa3", size_vint(len(head) + n * FRAME), head, payload[pos : pos + n * FRAME]]
            pos += n * FRAME
        at = unsigned(CUE_TRACK, 1) + unsigned(CUE_CLUSTER, len(body))
        cues += element(CUE_POINT, unsigned(CUE_TIME, start // RATE_MS) + element(CUE_POSITIONS, at))
        body += element(CLUSTER, b"".join(parts))
    body += element(CUES, bytes(cues))
    header = element(EBML, unsigned(EBML_VERSION, 1) + unsigned(EBML_READ_VERSION, 1) + unsigned(EBML_MAX_ID, 4)
                     + unsigned(EBML_MAX_SIZE, 8) + element(DOC_TYPE, b"matroska")
                     + unsigned(DOC_TYPE_VERSION, 4) + unsigned(DOC_TYPE_READ_VERSION, 2))
    return header + element(SEGMENT, bytes(body))


def read_vint(data: bytes, at: int, end: int, marker: bool) -> tuple[int, int, bool]:
    """Value, next place and whether all value bits are one; `marker`: the length bit stays, as in identifiers."""
    if at >= end or not data[at]:
        raise MatroskaError(f"no variable-length integer at byte {at}")
    n = 9 - data[at].bit_length()
    if at + n > end:
        raise MatroskaError(f"an integer is cut off at byte {at}")
    value = int.from_bytes(data[at : at + n], "big")
    bare = value ^ 1 << 7 * n
    return value if marker else bare, at + n, bare == (1 << 7 * n) - 1


def elements(data: bytes, at: int, end: int, parent: int = 0) -> Iterator[tuple[int, int, int]]:
    """(identifier, begin, end) of the elements between two places.

    An element of unknown size goes to the end of what holds it or, in a cluster, to the next element of the
    top levels; a known size beyond the end is an error.
    """
    while at < end:
        ident, begin, _ = read_vint(data, at, end, True)
        size, begin, unknown = read_vint(data, begin, end, False)
        stop = begin + size
        if unknown:
            if ident not in (SEGMENT, CLUSTER):
                raise MatroskaError(f"unknown size of an element at byte {at}")
            stop = end
            if ident == CLUSTER:
                place = begin
                while place < end:
                    child, after, _ = read_vint(data, place, end, True)
                    if child in TOP_LEVEL:
                        stop = place
                        break
                    length, after, _ = read_vint(data, after, end, False)
                    place = after + length
        elif stop > end:
            raise MatroskaError(f"the element at byte {at} is cut off")
        yield ident, begin, stop
        at = stop


def number(data: bytes, begin: int, end: int) -> int:
    return int.from_bytes(data[begin:end], "big")


def real(data: bytes, begin: int, end: int) -> float:
    return {0: lambda: 0.0, 4: lambda: struct.unpack_from(">f", data, begin)[0],
            8: lambda: struct.unpack_from(">d", data, begin)[0]}.get(end - begin, lambda: 0.0)()


def frame_sizes(data: bytes, at: int, end: int, kind: int) -> tuple[list[int], int]:
    """Sizes of a block's frames, and where the first begins."""
    if not kind:
        return [end - at], at
    if at >= end:
        raise MatroskaError("a laced block has no frame count")
    n, at = data[at] + 1, at + 1
    sizes: list[int] = []
    if kind == 2:
        if (end - at) % n:
            raise MatroskaError("a block of fixed lacing has a remainder")
        return [(end - at) // n] * n, at
    for j in range(n - 1):
        if kind == 1:
            size = 0
            while True:
                if at >= end:
                    raise MatroskaError("a lace is cut off")
                size, at = size + data[at], at + 1
                if data[at - 1] != 255:
                    break
        else:
            begin = at
            size, at, _ = read_vint(data, at, end, False)
            if j:
                size += sizes[-1] - ((1 << 7 * (at - begin) - 1) - 1)
        sizes.append(size)
    sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise MatroskaError("the frames of a block exceed it")
    return sizes, at


def read_matroska(data: bytes) -> Media:
    """Tracks, packets, cues and clusters of a file; MatroskaError if it can't be read."""
    top = elements(data, 0, len(data))
    doc_type, tracks, packets, cues, clusters, duration, scale = "", [], [], [], [], 0.0, 1_000_000
    lengths: dict[int, int] = {}

    def block(begin: int, end: int, base: int, key: bool | None) -> None:
        track, at, _ = read_vint(data, begin, end, False)
        if at + 3 > end:
            raise MatroskaError("a block's head is cut off")
        offset, flags = struct.unpack_from(">hB", data, at)
        kind = (0, 1, 2, 3)[flags >> 1 & 3]
        sizes, at = frame_sizes(data, at + 3, end, kind)
        time, each = (base + offset) * scale, lengths.get(track, (0, 0))
        for size in sizes:
            packets.append(Packet(track, time, at, size, bool(flags & 0x80) if key is None else key, LACINGS[kind], len(clusters) - 1))
            at += size
            # PCM frames last as long as their samples; others as long as the track says.
            time += size * each[0] if each[0] else each[1]

    try:
        ident, begin, end = next(top)
    except StopIteration:
        raise MatroskaError("no bytes") from None
    if ident != EBML:
        raise MatroskaError("no EBML header")
    for child, b, e in elements(data, begin, end):
        if child == DOC_TYPE:
            doc_type = data[b:e].rstrip(b"\0").decode("ascii", "replace")
    for ident, begin, end in top:
        if ident != SEGMENT:
            continue
        for part, b, e in elements(data, begin, end):
            if part == INFO:
                for child, x, y in elements(data, b, e):
                    if child == TIMESTAMP_SCALE:
                        scale = number(data, x, y)
                    elif child == DURATION:
                        duration = real(data, x, y)
            elif part == TRACKS:
                for child, x, y in elements(data, b, e):
                    if child == TRACK_ENTRY:
                        track = read_track(data, x, y)
                        tracks.append(track)
                        lengths[track["number"]] = (track["sample_ns"], track["default_ns"])
            elif part == CLUSTER:
                base = 0
                clusters.append(b)
                for child, x, y in elements(data, b, e):
                    if child == CLUSTER_TIMESTAMP:
                        base = number(data, x, y)
                    elif child == SIMPLE_BLOCK:
                        block(x, y, base, None)
                    elif child == BLOCK_GROUP:
                        inner = list(elements(data, x, y))
                        key = all(i != REFERENCE_BLOCK for i, _, _ in inner)
                        for i, p, q in inner:
                            if i == BLOCK:
                                block(p, q, base, key)
            elif part == CUES:
                for child, x, y in elements(data, b, e):
                    if child == CUE_POINT:
                        cues += read_cue(data, x, y, begin, scale)
    return Media(doc_type, tracks, packets, cues, clusters, round(duration * scale))


def read_track(data: bytes, begin: int, end: int) -> dict:
    """Number, type, codec, and nanoseconds of a byte of samples (PCM) and of a frame (or 0)."""
    track = {"number": 0, "type": 0, "codec": "", "rate": 8000.0, "channels": 1, "bits": 0, "default_ns": 0}
    for child, b, e in elements(data, begin, end):
        if child in (TRACK_NUMBER, TRACK_TYPE, DEFAULT_DURATION):
            track[{TRACK_NUMBER: "number", TRACK_TYPE: "type", DEFAULT_DURATION: "default_ns"}[child]] = number(data, b, e)
        elif child == CODEC_ID:
            track["codec"] = data[b:e].rstrip(b"\0").decode("ascii", "replace")
        elif child == AUDIO:
            for part, x, y in elements(data, b, e):
                if part == SAMPLING_FREQUENCY:
                    track["rate"] = real(data, x, y)
                elif part in (CHANNELS, BIT_DEPTH):
                    track["channels" if part == CHANNELS else "bits"] = number(data, x, y)
    wide = track["bits"] // 8 * track["channels"]
    pcm = track["codec"].startswith("A_PCM") and wide and track["rate"]
    return track | {"sample_ns": int(1e9 / track["rate"] / wide) if pcm else 0}


def read_cue(data: bytes, begin: int, end: int, segment: int, scale: int) -> list[tuple[int, int, int]]:
    """(timestamp in ns, track, place of the cluster) of a cue point."""
    time, found = 0, []
    for child, b, e in elements(data, begin, end):
        if child == CUE_TIME:
            time = number(data, b, e)
        elif child == CUE_POSITIONS:
            inner = {i: number(data, x, y) for i, x, y in elements(data, b, e) if i in (CUE_TRACK, CUE_CLUSTER)}
            found.append((inner.get(CUE_TRACK, 0), segment + inner.get(CUE_CLUSTER, 0)))
    return [(time * scale, track, at) for track, at in found]


def payload_of(data: bytes, media: Media, track: int | None = None) -> bytes:
    """The bytes of a track's packets in order; of the first track if none is named."""
    track = (media.tracks[0]["number"] if media.tracks else 0) if track is None else track
    return b"".join([data[p.offset : p.offset + p.size] for p in media.packets if p.track == track])


def features_of(media: Media, payload: bytes) -> str:
    """Counts of the container's parts, duration, range and sum of samples, and their coarse histogram."""
    kinds = dict.fromkeys(LACINGS, 0)
    for p in media.packets:
        kinds[p.lacing] += 1
    a = np.frombuffer(payload, np.uint8)
    low, high = (int(a.min()), int(a.max())) if len(a) else (0, 0)
    bins = np.bincount(a >> 5, minlength=8).tolist()
    crossings = int(np.count_nonzero((a[1:] > 127) != (a[:-1] > 127)))
    return (f"clusters={len(media.clusters)};cues={len(media.cues)};packets={len(media.packets)};"
            + "".join(f"{k}={n};" for k, n in kinds.items())
            + f"ms={media.duration_ns // 1_000_000};last_ms={max((p.timestamp_ns for p in media.packets), default=0) // 1_000_000};"
            + f"min={low};max={high};sum={int(a.sum(dtype=np.int64))};crossings={crossings};bins={','.join(map(str, bins))}")


def store(df: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep`, n_bytes and the column `media`: every whole text as a Matroska file. Null counts as empty.

    A row for each row of df, repeated rows included; other columns are not read.
    """
    return map_rows(df, text_col, "n_bytes long, media binary", lambda: lambda t: (len(t), write_matroska(pad(t))), list(keep))


def _packet_rows(data: bytes) -> tuple:
    try:
        media = read_matroska(data)
    except MatroskaError as e:
        return [], str(e)
    return [p._asdict() for p in media.packets], None


def packets(df: DataFrame, media_col: str = "media", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """A row for each packet: `keep`, packet, track, timestamp_ns, offset, size, keyframe, lacing, cluster, error.

    A file that can't be read, null and empty ones included, has one row whose packet is null and whose error
    says why; a file without blocks has one with neither.
    """
    each = "array<struct<track:long,timestamp_ns:long,offset:long,size:long,keyframe:boolean,lacing:string,cluster:int>>"
    rows = map_rows(df, media_col, f"_lw_packets {each}, error string", lambda: _packet_rows, list(keep))
    return rows.select(*keep, F.posexplode_outer("_lw_packets").alias("packet", "_lw_p"), "error").select(
        *keep, "packet", "_lw_p.*", "error"
    )


def _feature_row(data: bytes) -> tuple:
    try:
        media = read_matroska(data)
    except MatroskaError as e:
        return None, None, None, len(data), hashlib.sha256(data).hexdigest(), None, str(e)
    payload = payload_of(data, media)
    return (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(data),
            hashlib.sha256(data).hexdigest(), features_of(media, payload), None)


def features(df: DataFrame, media_col: str = "media", keep: tuple[str, ...] = ("doc_id", "n_bytes")) -> DataFrame:
    """`keep` and what the stored bytes say: payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256,
    feature and error.

    The payload is read back through the packet table. A file that can't be read, null and empty ones included,
    has an error that says why, and its payload and feature are null; other rows' error is null. Repeated rows
    give repeated results, an empty table none.
    """
    schema = ("payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, "
              "feature string, error string")
    return map_rows(df, media_col, schema, lambda: _feature_row, list(keep))
