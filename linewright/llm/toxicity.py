"""Non-negative positive-unlabelled learning of toxicity (operator 6).

Only confirmed toxic texts and unlabelled ones are used. The risk of a linear model with logistic loss is
estimated as prior * R_p(+) + max(0, R_u(-) - prior * R_p(-)); while the bracket is negative, the step goes
up its slope instead. Features are hashed indicators that a word, or a word beginning, stands in at least one,
two or three different words of a text; all of them take part. Weights are not negative, so no word excuses
another, and their sum is charged, which leaves few of them.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linewright.llm.base import Memo, map_rows
from linewright.llm.decontamination import words_of
from linewright.llm.labelled import drawn, fold, labels_by_id, with_texts

#: Bounds of the confirmed and the unlabelled rows that are fitted on the driver, and of all their features together.
POSITIVE_ROWS, UNLABELLED_ROWS, FEATURES = 4000, 8000, 48_000_000
#: Bits of a hashed feature.
BITS = 20
#: Lengths in bytes of the word beginnings (a whole word counts too), and numbers of different words of an indicator.
BEGINNINGS, TIMES = (3, 4, 5, 6, 7, 8, 9, 10), (1, 2, 3)
#: Charge of the weights' sum, for one toxic text; it falls with the root of their number.
CHARGE = 0.004


def grams_of(word: bytes) -> list[int]:
    """32-bit hashes of a word and of its beginnings."""
    return [zlib.crc32(b"=" + word), *(zlib.crc32(word[:n]) for n in BEGINNINGS if n <= len(word))]


def place(gram: int) -> int:
    return (gram * 0x85EBCA6B & 0xFFFFFFFF) >> (32 - BITS)


def turned(times: int) -> int:
    """What a number of words changes of a gram's place."""
    return times * 0x3C6EF & (1 << BITS) - 1


def feature(gram: int, times: int) -> int:
    """The hashed indicator of a gram in at least so many different words."""
    return place(gram) ^ turned(times)


def features_of(text: bytes) -> np.ndarray:
    """Hashed features of a text, sorted and distinct."""
    found = [g for w in set(words_of(text)) for g in grams_of(w)]
    grams, times = np.unique(np.array(found, np.uint64), return_counts=True)
    places = (grams * np.uint64(0x85EBCA6B) & np.uint64(0xFFFFFFFF)) >> np.uint64(32 - BITS)
    made = [places[times >= t] ^ np.uint64(turned(t)) for t in TIMES]
    return np.unique(np.concatenate(made)).astype(np.int32)


class Model:
    """Weights of hashed features (others weigh nothing), and a bias."""

    def __init__(self, features: np.ndarray, weights: np.ndarray, bias: float) -> None:
        self.features, self.weights, self.bias = features, weights, bias


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def risk(z_p: np.ndarray, z_u: np.ndarray, prior: float) -> tuple[float, float]:
    """prior * R_p(+), and the bracket R_u(-) - prior * R_p(-), of margins under logistic loss."""
    return prior * np.logaddexp(0, -z_p).mean(), np.logaddexp(0, z_u).mean() - prior * np.logaddexp(0, z_p).mean()


def slopes(z_p: np.ndarray, z_u: np.ndarray, prior: float, whole: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Derivatives of the non-negative risk by each margin; with a negative bracket, of the bracket's negative.

    With `whole` the bracket counts as it is.
    """
    down_p, down_u = prior * sigmoid(z_p) / len(z_p), sigmoid(z_u) / len(z_u)
    if whole or risk(z_p, z_u, prior)[1] >= 0:
        return -prior * sigmoid(-z_p) / len(z_p) - down_p, down_u
    return down_p, -down_u


class Rows:
    """Rows of sorted distinct features, end to end; and which of a few chosen features they hold."""

    def __init__(self, rows: list[np.ndarray]) -> None:
        self.rows, self.row, self.column, self.size = rows, np.zeros(0, np.int64), np.zeros(0, np.int64), 0

    def choose(self, column: np.ndarray, size: int) -> None:
        """Hold the features whose `column` is not negative; it tells their place among `size` weights."""
        held = [c[c >= 0] for c in (column[x] for x in self.rows)]
        self.row = np.repeat(np.arange(len(held)), [*map(len, held)])
        self.column, self.size = np.concatenate(held), size

    def margins(self, weights: np.ndarray, bias: float) -> np.ndarray:
        return np.bincount(self.row, weights[self.column], len(self.rows)) + bias

    def chosen_slopes(self, by_row: np.ndarray) -> np.ndarray:
        return np.bincount(self.column, by_row[self.row], self.size)

    def all_slopes(self, by_row: np.ndarray, into: np.ndarray) -> None:
        for x, s in zip(self.rows, by_row.tolist(), strict=True):
            into[x] += s


def train(
    positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float,
    steps: int = 8, most: int = 1000, rounds: int = 150, rate: float = 0.03,
) -> Model:
    """Least charged non-negative risk. Without texts of both sets every text scores the prior.

    In each step the slopes of all features are found, and up to `most` of those whose weight should leave zero
    join the weights that did; these are fitted on by full-batch Adam with the charge as a proximal step. Features
    whose slope is under the charge stay at zero, as the least risk asks.
    """
    bias = float(np.log(prior / (1 - prior)))
    if not sum(map(len, positive)) or not sum(map(len, unlabelled)):
        return Model(np.zeros(0, np.int64), np.zeros(0), bias)
    charge = CHARGE / np.sqrt(len(positive))
    x_p, x_u, column = Rows(positive), Rows(unlabelled), np.full(1 << BITS, -1, np.int32)
    chosen, weights = np.zeros(0, np.int64), np.zeros(0)
    for _ in range(steps):
        z_p, z_u = x_p.margins(weights, bias), x_u.margins(weights, bias)
        s_p, s_u = slopes(z_p, z_u, prior, whole=True)
        slope = np.zeros(1 << BITS)
        x_p.all_slopes(s_p, slope)
        x_u.all_slopes(s_u, slope)
        wanted = np.flatnonzero((slope < -charge) & (column < 0))
        stay = (weights > 0) | (slope[chosen] < -charge)
        new = wanted[np.argsort(slope[wanted], kind="stable")[:most]]
        chosen, weights = np.concatenate((chosen[stay], new)), np.concatenate((weights[stay], np.zeros(len(new))))
        column[:] = -1
        column[chosen] = np.arange(len(chosen))
        for x in (x_p, x_u):
            x.choose(column, len(chosen))
        at, first, second = np.append(weights, bias), 0.0, 0.0
        free = np.append(np.full(len(chosen), charge), 0.0)
        for t in range(1, rounds + 1):
            s_p, s_u = slopes(x_p.margins(at[:-1], at[-1]), x_u.margins(at[:-1], at[-1]), prior)
            down = np.append(x_p.chosen_slopes(s_p) + x_u.chosen_slopes(s_u), s_p.sum() + s_u.sum())
            first, second = 0.9 * first + 0.1 * down, 0.99 * second + 0.01 * down**2
            step = rate * min(1.0, 2 / np.sqrt(t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-6)
            at = at - step * (first / (1 - 0.9**t) + free)
            at[:-1] = np.maximum(at[:-1], 0)
        weights, bias = at[:-1], float(at[-1])
    kept = np.flatnonzero(weights)
    kept = kept[np.argsort(chosen[kept])]
    return Model(chosen[kept], weights[kept], bias)


def fit(
    docs: DataFrame, labels: DataFrame, usable=None, doc_id: str = "doc_id", text: str = "text",
    label_id: str = "doc_id", label: str = "toxic", prior: float | None = None,
    most_positive: int = POSITIVE_ROWS, most_unlabelled: int = UNLABELLED_ROWS, most_features: int = FEATURES,
) -> Model:
    """Fit on confirmed toxic rows, whose id satisfies `usable`, and on unlabelled documents.

    Both are bounded and drawn by a hash of the id; unlabelled are any documents, whatever their labels. Rows
    are taken in that order until their features reach `most_features`. `prior` is the share of toxic texts; if
    not given, their share of the usable labels. Null ids and labels are left out; of contrary labels of an id
    the lower counts, and of different texts the least; repeated rows count once. Empty tables give a model
    that scores every text with the prior.
    """
    known = labels_by_id(labels, label_id, label)
    known = known if usable is None else known.filter(usable(F.col("_lw_id")))
    if prior is None:
        n, n1 = known.agg(F.count("*"), F.sum("_lw_label")).first()
        prior = (n1 + 1) / (n + 2) if n else 0.05
    prior = min(max(prior, 0.01), 0.5)
    toxic = drawn(known.filter("_lw_label = 1").select("_lw_id"), "_lw_id", most_positive)
    any_of = drawn(docs.select(docs[doc_id].alias("_lw_id")).filter("_lw_id is not null").distinct(), "_lw_id", most_unlabelled)
    sets = toxic.withColumn("_lw_set", F.lit(1)).unionByName(any_of.withColumn("_lw_set", F.lit(2)))
    sample = sets.groupBy("_lw_id").agg(F.sum("_lw_set").alias("_lw_set"))  # 3: of both
    got = map_rows(with_texts(sample, docs, doc_id, text), "_lw_text", "x binary",
                   lambda: lambda t: (features_of(t).tobytes(),), ["_lw_id", "_lw_set"])
    positive, unlabelled, size = [], [], 0
    for row in got.orderBy(F.xxhash64("_lw_id"), "_lw_id").toLocalIterator():
        x = np.frombuffer(row["x"], np.int32)
        size += len(x)
        if size > most_features:
            break
        if row["_lw_set"] & 1:
            positive.append(x)
        if row["_lw_set"] & 2:
            unlabelled.append(x)
    return train(positive, unlabelled, prior)


def score(
    df: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",), column: str = "score"
) -> DataFrame:
    """`keep` and a score from 0 to 1 for every whole text, higher for toxic; null counts as empty text.

    The model has as many weights as are not zero. One row for each row of df, repeated ones included, without
    a shuffle; an empty table gives none.
    """
    weights, bias = dict(zip(model.features.tolist(), model.weights.tolist(), strict=True)), model.bias

    near, shift = {f ^ turned(t) for f in weights for t in TIMES}, 32 - BITS

    def make() -> Callable[[bytes], tuple]:
        memo = Memo()

        def found(t: bytes) -> Iterator[int]:
            seen: dict[int, int] = {}
            known = memo.held.get
            for w in set(words_of(t)):
                grams = known(w)
                if grams is None:
                    grams = memo.put(w, tuple([g for g in grams_of(w) if (g * 0x85EBCA6B & 0xFFFFFFFF) >> shift in near]))  # place(g)
                for g in grams:
                    n = seen[g] = seen.get(g, 0) + 1
                    if n in TIMES:
                        yield feature(g, n)

        def one(t: bytes) -> tuple:
            z = bias + sum(weights.get(f, 0.0) for f in sorted(set(found(t))))
            return (float(sigmoid(np.float64(z))),)

        return one

    return map_rows(df, text, f"{column} double", make, list(keep))


def held_out(doc_id) -> object:
    """Rows that no model may learn labels from."""
    return fold(doc_id, 3) == 1
