"""Chat formatting with offset-aligned loss masks (operator 4).

A whole conversation is rendered into one string, encoded once with offsets, and the sorted spans of its
turns are intersected with the sorted spans of the tokens by binary search. The template's control strings
are special tokens, so no token reaches across the edge of a turn; inside texts they are escaped.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linewright.llm.base import slices, worker_cache

#: The template: BEGIN, then for each turn HEAD role BODY text END.
BEGIN, HEAD, BODY, END = "<s>", "[INST]", "[/INST]", "</s>"
CONTROL = (BEGIN, HEAD, BODY, END)
#: Before a character of a text that the template takes for itself.
ESCAPE = "\\"


class Escaper:
    """Puts ESCAPE behind the first character of every control string, and doubles it where it stands itself."""

    def __init__(self, control: Iterable[str]) -> None:
        longest = sorted(set(control), key=lambda s: (-len(s), s))
        self.special = re.compile("|".join(map(re.escape, [ESCAPE, *longest])))

    def escape(self, text: str) -> str:
        return self.special.sub(lambda m: m[0][0] + ESCAPE + m[0][1:], text)

    @staticmethod
    def unescape(text: str) -> str:
        # An escape stands behind a character; it goes, and of a pair of escapes one stays.
        return re.sub(r"(?s)(.)\\", r"\1", text) if ESCAPE in text else text


class Rendered(NamedTuple):
    text: str
    spans: list[tuple[int, int]]  # of the escaped texts that are learned, in code points


def render(turns: list[tuple[str, str]], escaper: Escaper, learned: frozenset[str]) -> Rendered:
    parts, at, spans = [BEGIN], len(BEGIN), []
    for role, text in turns:
        name, body = escaper.escape(role), escaper.escape(text)
        at += len(HEAD) + len(name) + len(BODY)
        if role in learned:
            spans.append((at, at + len(body)))
        at += len(body) + len(END)
        parts += [HEAD, name, BODY, body, END]
    return Rendered("".join(parts), spans)


TURN = re.compile(f"(?s){re.escape(HEAD)}(.*?){re.escape(BODY)}(.*?){re.escape(END)}")


def parse(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) pairs of a rendered conversation."""
    return [(Escaper.unescape(a), Escaper.unescape(b)) for a, b in TURN.findall(formatted[len(BEGIN) :])]


def mask_tokens(starts: np.ndarray, ends: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """Flags of the tokens that meet a span; both sorted, and tokens of one character may share its offsets."""
    mask = np.zeros(len(starts), bool)
    if spans:
        a = np.array(spans)
        first = np.searchsorted(ends, a[:, 0], "right")
        last = np.searchsorted(starts, a[:, 1], "left")
        for i, j in zip(first.tolist(), last.tolist(), strict=True):
            mask[i:j] = True
    return mask


def masked_text(formatted: str, starts: np.ndarray, ends: np.ndarray, mask: np.ndarray) -> str:
    """The code points under the mask, each once, unescaped run by run."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], mask.view(np.int8), [0]))))
    return "".join(
        Escaper.unescape(formatted[starts[i] : ends[j - 1]]) for i, j in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)
    )


class Encoder:
    """A public tokenizer whose special tokens are its own and the template's."""

    def __init__(self, vocabulary: str) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import AddedToken, Tokenizer

        self.tokenizer = Tokenizer.from_str(vocabulary)
        own = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.tokenizer.add_special_tokens([AddedToken(c, normalized=False, special=True) for c in CONTROL])
        self.escaper = Escaper([*CONTROL, *own])

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Ids, starts and ends of the tokens of each text."""
        out = []
        for e in self.tokenizer.encode_batch(texts, add_special_tokens=False):
            offsets = np.array(e.offsets, np.int32).reshape(-1, 2)
            out.append((np.array(e.ids, np.int32), offsets[:, 0], offsets[:, 1]))
        return out


OUTPUT = "formatted string, ids array<int>, starts array<int>, ends array<int>, mask array<boolean>"


def _lists(arrays: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, arrays)])
    flat = np.concatenate(arrays) if arrays else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, kind))


def conversations(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turns): the turns of each conversation as (turn, role, text), sorted; null roles and texts are empty.

    Bytes that are no UTF-8 become U+FFFD.
    """
    each = F.struct(rows[turn].alias("turn"), F.make_valid_utf8(F.coalesce(rows[role], F.lit(""))).alias("role"),
                    F.make_valid_utf8(F.coalesce(rows[text], F.lit(""))).alias("text"))
    return rows.groupBy(rows[conv].alias(conv)).agg(F.sort_array(F.collect_list(each)).alias("turns"))


def format_conversations(
    rows: DataFrame, vocabulary: str, conv: str = "conv_id", turn: str = "turn", role: str = "role",
    text: str = "text", learned: tuple[str, ...] = ("assistant",),
) -> DataFrame:
    """A row for each conversation: conv, formatted, and its token ids, starts, ends and loss mask.

    `rows` has a row for each turn. Turns are ordered by turn number, null first; equal numbers, repeated
    rows included, all stay, by role and text. Null roles and texts are empty; a null conversation is one
    like any other; other columns are not read. Starts and ends are code points of `formatted`. The mask is
    true for tokens of texts whose role is in `learned`. A conversation is rendered whole in one task, as
    the format asks; different conversations are dealt by a shuffle of their rows. `vocabulary` is the path
    of a tokenizer file, read on the driver and broadcast: one vocabulary, whatever the corpus.
    """
    spark = rows.sparkSession
    with open(vocabulary, encoding="utf-8") as f:
        shared = spark.sparkContext.broadcast(f.read())
    grouped = conversations(rows, conv, turn, role, text)
    names = [conv, "formatted", "ids", "starts", "ends", "mask"]
    kind = grouped.schema[conv].dataType.simpleString()
    wanted = frozenset(learned)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            encoder = worker_cache(("chat", hash(shared.value)), lambda: Encoder(shared.value))
            talks = [[(t["role"], t["text"]) for t in turns] for turns in batch.column(1).to_pylist()]
            rendered = [render(t, encoder.escaper, wanted) for t in talks]
            encoded = encoder.encode([r.text for r in rendered])
            masks = [mask_tokens(s, e, r.spans) for (_, s, e), r in zip(encoded, rendered, strict=True)]
            columns = [_lists([x[i] for x in encoded], pa.int32()) for i in range(3)]
            flags = [m.astype(bool) for m in masks]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([r.text for r in rendered], pa.string()), *columns, _lists(flags, pa.bool_())], names=names
            )

    return grouped.mapInArrow(run, f"{conv} {kind}, {OUTPUT}")


def read_back(formatted: DataFrame, conv: str = "conv_id") -> DataFrame:
    """What formatted conversations say of themselves: turns from the string, learned text from tokens and mask.

    Columns: conv, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_tokens, loss_tokens.
    """
    kind = formatted.schema[conv].dataType.simpleString()
    names = [conv, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_tokens", "loss_tokens"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for i, text in enumerate(batch.column(1).to_pylist()):
                starts, ends, mask = (batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in (3, 4, 5))
                turns = parse(text)
                loss = masked_text(text, starts, ends, mask.astype(bool))
                said = "".join(f"{r}\n{t}\n" for r, t in turns)
                rows.append((len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss),
                             hashlib.sha256(loss.encode()).hexdigest(), len(text), len(starts), int(mask.sum())))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
            made = [pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made], names=names)

    return formatted.select(conv, "formatted", "ids", "starts", "ends", "mask").mapInArrow(
        run, f"{conv} {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long, loss_tokens long"
    )
