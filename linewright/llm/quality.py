"""Naive Bayes support vectors for text quality (operator 5).

Indicators of n-grams are scaled by the log ratio of their smoothed counts in either class; a linear model with
hinge loss is fitted to the scaled, length-normalised rows by dual coordinate descent, and its margin is turned
into a probability on rows left out of the fit. The n-grams are those of three bytes, and those of several
lengths over the text's words as classes: a word equal to the one before, any other word, and the text's edges.
"""

from __future__ import annotations

import operator
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linewright.llm.base import map_rows
from linewright.llm.labelled import drawn, fold, labels_by_id, with_texts

#: Bits of hashed byte trigrams, then of hashed word-class n-grams, and the orders of the latter.
BITS, CLASS_BITS, ORDERS = 18, 16, (2, 3, 4, 6, 9, 14)
WIDTH = (1 << BITS) + (1 << CLASS_BITS)
#: Classes of words and edges.
OTHER, SAME, BEGIN, END = range(4)
#: Bounds of the labelled rows that are fitted on the driver, and of their features together.
SAMPLE_ROWS, FEATURES = 6000, 32_000_000


def classes_of(text: bytes) -> np.ndarray:
    """The word classes of a text between its edges."""
    words = text.split()
    out = np.full(len(words) + 2, OTHER, np.uint64)
    out[0], out[-1] = BEGIN, END
    out[2:-1] = np.fromiter(map(operator.eq, words[1:], words), bool, max(0, len(words) - 1))
    return out


def indicators(text: bytes, seen: np.ndarray) -> np.ndarray:
    """Sorted features of a text; `seen` is a cleared array of WIDTH flags, and is left cleared."""
    a = np.frombuffer(text, np.uint8).astype(np.uint32)
    if len(a) >= 3:
        seen[((a[:-2] << 16 | a[1:-1] << 8 | a[2:]) * np.uint32(2654435761)) >> np.uint32(32 - BITS)] = True
    classes = classes_of(text)
    for n in ORDERS:
        if len(classes) >= n:
            grams = np.full(len(classes) - n + 1, n, np.uint64)
            for k in range(n):
                grams = grams << np.uint64(2) | classes[k : len(classes) - n + 1 + k]
            mixed = grams * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - CLASS_BITS)
            seen[(1 << BITS) + mixed.astype(np.int64)] = True
    found = np.flatnonzero(seen)
    seen[found] = False
    return found


class Model:
    """Log-count ratios times weights, bias, and the slope and offset of the probability."""

    def __init__(self, ratios: np.ndarray, weights: np.ndarray, bias: float) -> None:
        self.ratios, self.weights, self.bias, self.slope, self.offset = ratios, weights, bias, 1.0, 0.0

    def margin(self, x: np.ndarray) -> float:
        scaled = self.ratios[x]
        return float(self.weights[x] @ scaled) / (float(np.sqrt(scaled @ scaled)) or 1.0) + self.bias

    def score(self, x: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(x) + self.offset, -30, 30))))


def log_count_ratios(rows: list[np.ndarray], labels: np.ndarray, smooth: float = 1.0) -> np.ndarray:
    counts = [np.full(WIDTH, smooth), np.full(WIDTH, smooth)]
    for x, y in zip(rows, labels, strict=True):
        counts[y][x] += 1
    n1 = int(labels.sum())
    return np.log(counts[1] / (n1 + 2 * smooth)) - np.log(counts[0] / (len(rows) - n1 + 2 * smooth))


def scaled(x: np.ndarray, ratios: np.ndarray) -> np.ndarray:
    """A row's log-count ratios at unit length."""
    v = ratios[x]
    return v / (float(np.sqrt(v @ v)) or 1.0)


def costs(labels: np.ndarray, cost: float) -> np.ndarray:
    """Greatest dual variable of each row: both classes weigh alike."""
    return cost / (2 * np.where(labels == 1, labels.mean(), 1 - labels.mean()))


def fit_dual(
    rows: list[np.ndarray], labels: np.ndarray, ratios: np.ndarray, cost: float = 1.0, rounds: int = 12
) -> tuple[Model, np.ndarray]:
    """The model of least |weights|^2 / 2 + the rows' costs of hinge loss, and the dual variables.

    Coordinate steps on the dual variables in seeded order, each held between zero and the row's cost; the bias
    is the weight of a column of ones.
    """
    values, sign, top = [scaled(x, ratios) for x in rows], np.where(labels == 1, 1.0, -1.0), costs(labels, cost)
    steep = [float(v @ v) + 1 for v in values]
    model, dual, random = Model(ratios, np.zeros(len(ratios)), 0.0), np.zeros(len(rows)), np.random.default_rng(7)
    for _ in range(rounds):
        for i in random.permutation(len(rows)):
            x, v = rows[i], values[i]
            slope = sign[i] * (float(model.weights[x] @ v) + model.bias) - 1
            step = min(max(dual[i] - slope / steep[i], 0.0), top[i]) - dual[i]
            if step:
                dual[i] += step
                model.weights[x] += step * sign[i] * v
                model.bias += step * sign[i]
    return model, dual


def calibrate(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve through margins, with smoothed targets, by Newton's method."""
    n1, n0 = labels.sum(), (1 - labels).sum()
    goal = np.where(labels == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    at = np.array([1.0, float(np.log((n1 + 1) / (n0 + 1)))])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(at[0] * margins + at[1], -30, 30)))
        w = p * (1 - p) + 1e-9
        down = np.array([((p - goal) * margins).sum() + 1e-3 * at[0], (p - goal).sum()])
        bend = np.array([[(w * margins**2).sum() + 1e-3, (w * margins).sum()], [(w * margins).sum(), w.sum() + 1e-6]])
        step = np.linalg.solve(bend, down)
        at -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return float(max(at[0], 1e-3)), float(at[1])


def train(rows: list[np.ndarray], labels: np.ndarray) -> Model:
    """A model of 0/1 labels. Without rows of both classes every text scores the smoothed share of label 1."""
    n1 = int(labels.sum())
    if not 0 < n1 < len(rows):
        model = Model(np.zeros(WIDTH), np.zeros(WIDTH), 0.0)
        model.slope, model.offset = 1.0, float(np.log((n1 + 1) / (len(rows) - n1 + 1)))
        return model
    margins = np.zeros(len(rows))
    part = np.arange(len(rows)) % 4
    for k in range(4):  # margins of rows that the fit has not seen
        out = part == k
        own = [rows[i] for i in np.flatnonzero(~out)]
        if 0 < labels[~out].sum() < len(own):
            model, _ = fit_dual(own, labels[~out], log_count_ratios(own, labels[~out]))
            margins[out] = [model.margin(rows[i]) for i in np.flatnonzero(out)]
    model, _ = fit_dual(rows, labels, log_count_ratios(rows, labels))
    model.slope, model.offset = calibrate(margins, labels)
    return model


def fit(
    docs: DataFrame, labels: DataFrame, usable=None, doc_id: str = "doc_id", text: str = "text",
    label_id: str = "doc_id", label: str = "quality", most: int = SAMPLE_ROWS, most_features: int = FEATURES,
) -> Model:
    """Fit on at most `most` labelled rows, drawn by a hash of the id, whose id column satisfies `usable`.

    Rows are taken in that order until their features reach `most_features`. Null ids and labels are left out;
    of contrary labels of an id the lower counts, and of different texts the least; repeated rows count once;
    ids without a document are ignored. Empty tables give a model that scores every text alike.
    """
    known = labels_by_id(labels, label_id, label)
    sample = drawn(known if usable is None else known.filter(usable(F.col("_lw_id"))), "_lw_id", most)

    def make() -> Callable[[bytes], tuple]:
        seen = np.zeros(WIDTH, bool)
        return lambda t: (indicators(t, seen).astype(np.int32).tobytes(),)

    got = map_rows(with_texts(sample, docs, doc_id, text), "_lw_text", "x binary", make, ["_lw_id", "_lw_label"])
    rows, known_labels, size = [], [], 0
    for row in got.orderBy(F.xxhash64("_lw_id"), "_lw_id").toLocalIterator():
        rows.append(np.frombuffer(row["x"], np.int32))
        known_labels.append(row["_lw_label"])
        size += len(rows[-1])
        if size > most_features:
            break
    return train(rows, np.array(known_labels, np.int64))


def score(
    df: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",), column: str = "score"
) -> DataFrame:
    """`keep` and a score from 0 to 1 for every whole text, higher for label 1; null counts as empty text.

    The model, of fixed width, is broadcast. One row for each row of df, repeated ones included, without a shuffle;
    an empty table gives none.
    """
    used = model.ratios * model.weights
    held = np.flatnonzero(model.ratios)
    shared = df.sparkSession.sparkContext.broadcast(
        (held.astype(np.int32), model.ratios[held].astype(np.float32), used[held].astype(np.float32),
         model.bias, model.slope, model.offset)
    )

    def make() -> Callable[[bytes], tuple]:
        at, ratios, products, bias, slope, offset = shared.value
        square, product = np.zeros(WIDTH), np.zeros(WIDTH)
        square[at], product[at] = ratios.astype(float) ** 2, products
        seen = np.zeros(WIDTH, bool)

        def one(t: bytes) -> tuple:
            x = indicators(t, seen)
            margin = product[x].sum() / (np.sqrt(square[x].sum()) or 1.0) + bias
            return (float(1 / (1 + np.exp(-np.clip(slope * margin + offset, -30, 30)))),)

        return one

    return map_rows(df, text, f"{column} double", make, list(keep))


def held_out(doc_id) -> object:
    """Rows that no model may learn labels from."""
    return fold(doc_id, 5) == 0
