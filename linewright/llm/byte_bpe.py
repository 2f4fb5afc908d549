"""Byte-level BPE encoding and decoding in linear time (operator 10).

Bytes are mapped to Latin-1 so that one Aho-Corasick automaton over the vocabulary reports every token that
occurs in a piece. Encoding takes the longest token at each place and steps back to a shorter one when two
neighbours could not stand beside each other in a merge-ordered encoding. Whether two tokens may be
neighbours is found by undoing their merges along the seam, and is memoised.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable

import ahocorasick
import regex
from pyspark.sql import DataFrame

from linewright.llm.base import Memo, map_rows, worker_cache

#: Bytes of a worker's memo of pieces, and entries of that of token pairs, at which they are emptied.
MEMO_BYTES, MEMO_PAIRS = 128 << 20, 800_000


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Ranks of a rank file: base64 token and rank per line."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}


class ByteBpe:
    """Encoder and decoder for one vocabulary of ranks and one splitting pattern; no special tokens."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks = ranks
        self.token = {r: t for t, r in ranks.items()}
        self.find = regex.compile(pattern).findall
        self.trie = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.trie.add_word(token.decode("latin-1"), (len(token), rank))
        self.trie.make_automaton()
        self._split: dict[int, tuple[int, int] | None] = {}
        self._pair: dict[int, bool] = {}
        #: Tokens that no merge makes; only a piece that equals one gets it.
        self.unmade = frozenset(r for r in self.token if self.split(r) is None)
        self._piece = Memo(MEMO_BYTES)

    def merged(self, data: bytes, below: int) -> list[int]:
        """Tokens after all merges of rank under `below`, in rank order, leftmost first."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best, at = below, -1
            for i in range(len(parts) - 1):
                rank = self.ranks.get(parts[i] + parts[i + 1], below)
                if rank < best:
                    best, at = rank, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def split(self, rank: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; itself twice for a byte, None if no merge makes it."""
        if rank not in self._split:
            data = self.token[rank]
            parts = [rank, rank] if len(data) == 1 else self.merged(data, rank)
            self._split[rank] = (parts[0], parts[1]) if len(parts) == 2 else None
        return self._split[rank]

    def compatible(self, left: int, right: int) -> bool:
        """Whether the merges leave these two as neighbours when they encode their joint bytes."""
        known = self._pair.get(left << 32 | right)
        if known is None:
            if len(self._pair) >= MEMO_PAIRS:
                self._pair.clear()
            known = self._pair[left << 32 | right] = self._holds(left, right)
        return known

    def _holds(self, left: int, right: int) -> bool:
        # The seam is crossed if some merge across it comes before the merges that hide it on either side.
        # Undo the latest merge on either side, step by step; `limit` is the rank that a crossing must beat.
        a, b, limit = left, right, 1 << 62
        while True:
            crossing = self.ranks.get(self.token[a] + self.token[b])
            if crossing is not None and crossing < limit and self.split(crossing) == (a, b):
                return False
            open_a, open_b = len(self.token[a]) > 1, len(self.token[b]) > 1
            if open_a and (a > b or not open_b):
                limit = a
                a = self.split(a)[1]
            elif open_b:
                limit = b + 1
                b = self.split(b)[0]
            else:
                return True

    def encode_piece(self, data: bytes) -> list[int]:
        """Ids of one piece: the piece itself if it is a token, else by backtracking."""
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        plain = data.decode("latin-1")
        pair = self._pair
        ids: list[int] = []
        last = -1
        for _, (_, rank) in self.trie.iter_long(plain):  # longest tokens end to end; most pieces need no more
            if rank in self.unmade:
                break
            if last >= 0:
                known = pair.get(last << 32 | rank)
                if not known and (known is not None or not self.compatible(last, rank)):
                    break
            ids.append(rank)
            last = rank
        else:
            return ids
        n = len(data)
        starts: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        for end, item in self.trie.iter(plain):  # ends ascend, so each list ascends by length
            starts[end + 1 - item[0]].append(item)
        dead = bytearray(n + 1)
        ids = []
        tried: list[int] = []  # for each chosen token, its index in the list of its place
        pos, k = 0, len(starts[0]) - 1
        while pos < n:
            here = starts[pos]
            last = ids[-1] if ids else -1
            while k >= 0:
                size, rank = here[k]
                if not dead[pos + size] and rank not in self.unmade:
                    if last < 0:
                        break
                    known = pair.get(last << 32 | rank)
                    if known or (known is None and self.compatible(last, rank)):
                        break
                k -= 1
            if k >= 0:
                ids.append(rank)
                tried.append(k)
                pos += size
                if pos < n:
                    k = len(starts[pos]) - 1
            else:
                dead[pos] = 1
                pos -= len(self.token[ids.pop()])
                k = tried.pop() - 1
        return ids

    def piece(self, piece: str) -> tuple[int, ...]:
        """Ids of one piece, which are memoised."""
        return self._piece.put(piece, tuple(self.encode_piece(piece.encode())))

    def encode(self, text: str) -> list[int]:
        known, out = self._piece.held.get, []
        for p in self.find(text):
            out.extend(known(p) or self.piece(p))
        return out

    def decode(self, ids: list[int]) -> bytes:
        token = self.token
        return b"".join([token[i] for i in ids])


def _encoder(ranks: bytes, pattern: str) -> ByteBpe:
    return worker_cache(("bpe", hashlib.sha256(ranks).digest(), pattern), lambda: ByteBpe(read_ranks(ranks), pattern))


def _work(shared, pattern: str, ids: bool) -> Callable[[], Callable[[bytes], tuple]]:
    def make() -> Callable[[bytes], tuple]:
        bpe = _encoder(shared.value, pattern)

        def digest(data: bytes) -> tuple:
            codes = bpe.encode(data.decode("utf-8", "replace"))
            plain = hashlib.sha256(bpe.decode(codes)).hexdigest()
            joined = ",".join(map(str, codes)).encode()
            row = (len(codes), hashlib.sha256(joined).hexdigest(), plain)
            return (*row, codes) if ids else row

        return digest

    return make


def encode(
    df: DataFrame,
    vocabulary: str,
    pattern: str,
    text_col: str = "text",
    keep: tuple[str, ...] = ("doc_id",),
    ids: bool = True,
) -> DataFrame:
    """Encode every whole text and decode it again; a row for each row of df.

    Columns: `keep`, n_tokens, ids_sha256 (of the decimal ids joined by commas), decoded_sha256 and, with
    `ids`, the ids. `vocabulary` is the path of a rank file, read on the driver and broadcast: its size is
    that of one vocabulary, whatever the corpus. Null and empty texts have no tokens; bytes that are no UTF-8
    are read as U+FFFD. Repeated rows give repeated results; an empty table gives none; other columns of df are
    neither read nor returned.
    """
    with open(vocabulary, "rb") as f:
        shared = df.sparkSession.sparkContext.broadcast(f.read())
    schema = "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids
    return map_rows(df, text_col, schema, _work(shared, pattern, ids), list(keep))


def decode(df: DataFrame, vocabulary: str, ids_col: str = "ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Bytes of every row's ids, as column `decoded`: none for null ids, null if an id is null or not in the vocabulary.

    Repeated rows give repeated results; an empty table gives none.
    """
    from pyspark.sql import functions as F

    with open(vocabulary, "rb") as f:
        shared = df.sparkSession.sparkContext.broadcast(f.read())

    @F.udf("binary", useArrow=True)
    def bytes_of(ids):
        token = worker_cache(("bpe-tokens", hashlib.sha256(shared.value).digest()), lambda: {r: t for t, r in read_ranks(shared.value).items()})
        parts = [None if i is None else token.get(int(i)) for i in ids] if ids is not None else []
        return None if None in parts else b"".join(parts)

    return df.select(*[df[c] for c in keep], bytes_of(df[ids_col]).alias("decoded"))
