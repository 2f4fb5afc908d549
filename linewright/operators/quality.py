"""How much a text says, and how much of it a shorter form keeps."""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from linewright.functions import classify as C
from linewright.functions import skeleton as S
from linewright.functions import text as T
from linewright.operators.lines import explode_lines

#: Limits of the gate: least entropy, greatest compression ratio, least diversity, and bytes below which all pass.
LEAST_ENTROPY, MOST_RATIO, LEAST_DIVERSITY, SMALL = 3.5, 3.0, 0.25, 50


def byte_measures(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, entropy, ratio): bits a byte, and bytes per byte of a fast zlib stream; an empty text has 0 and 1.

    Counting bytes is a histogram over each text, which rows of bytes would make dear: Arrow batches, no shuffle.
    """
    schema = StructType([docs.schema[key], StructField("entropy", DoubleType()), StructField("ratio", DoubleType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            entropy, ratio = [], []
            for data in batch.column(1).cast(pa.binary()).to_pylist():
                p = np.bincount(np.frombuffer(data or b"", np.uint8)) / max(1, len(data or b""))
                p = p[p > 0]
                entropy.append(float(-(p * np.log2(p)).sum()) if len(p) else 0.0)
                ratio.append(len(data) / len(zlib.compress(data, 1)) if data else 1.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(entropy, pa.float64()), pa.array(ratio, pa.float64())], names=schema.names)

    return docs.select(key, text).mapInArrow(run, schema)


def lexical_diversity(text: Column) -> Column:
    return T.let(T.words(text), lambda w: F.when(F.size(w) == 0, 0.0).otherwise(F.size(F.array_distinct(w)) / F.size(w)))


def gate(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score, size): entropy over 8, at most 1, of texts that pass the gate; null for the others. Small texts score 1."""
    measured = docs.select(key, F.octet_length(F.col(text)).alias("size"), lexical_diversity(F.col(text)).alias("diversity")).join(byte_measures(docs, key, text), key)
    passes = (F.col("entropy") >= LEAST_ENTROPY) & (F.col("ratio") <= MOST_RATIO) & (F.col("diversity") >= LEAST_DIVERSITY)
    score = F.when(F.col("size") < SMALL, 1.0).when(passes, F.least(F.col("entropy"), F.lit(8.0)) / 8)
    return measured.select(key, score.alias("score"), "size")


def preservation(original: Column, compressed: Column) -> Column:
    """Share of the original's distinct targets that the compressed text contains; 1 without targets.

    Targets that are targets of the compressed text too are in it; only the others are searched for.
    """
    targets, kept = F.array_distinct(T.preservation_targets(original)), T.preservation_targets(T.text_of(compressed))

    def share(t: Column) -> Column:
        lost = F.filter(F.array_except(t, kept), lambda x: ~F.contains(T.text_of(compressed), x))
        return F.when(F.size(t) == 0, 1.0).otherwise((F.size(t) - F.size(lost)) / F.size(t))

    return T.let(targets, share)


def srcr(original: Column, compressed: Column) -> Column:
    """(srcr, preservation, compression): what is kept times what is saved; (0, 1, 0) for texts too small or no shorter."""
    a, b = F.octet_length(original), F.octet_length(compressed)
    saved = F.when(a > 0, F.greatest(1.0 - b / a, F.lit(0.0))).otherwise(0.0)
    kept = F.when((a < 50) | (b >= a), 1.0).otherwise(preservation(original, compressed))
    compression = F.when((a < 50) | (b >= a), 0.0).otherwise(saved)
    return F.struct((kept * compression).alias("srcr"), kept.alias("preservation"), compression.alias("compression"))


def template_concentration(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, share, aggressive) over rows of lines: the share of the commonest template, and whether it stands for nearly all.

    That is: at least five lines that are not blank, 80 % of them of one template, of lengths within 30 %. Of
    equally common templates the first in order counts.
    """
    lines = rows.filter(~C.is_blank(F.col("line")))
    each = lines.select(key, S.aggressive_skeleton(F.col("line")).alias("t"), F.octet_length("line").alias("n"))
    groups = each.groupBy(key, "t").agg(F.count("*").alias("k"), F.min("n").alias("low"), F.max("n").alias("high"))
    total = groups.groupBy(key).agg(F.sum("k").alias("total"), F.max_by(F.struct("k", "low", "high"), F.struct("k", "t")).alias("top"))
    near = (F.col("top.low") > 0) & (F.col("top.low") * 10 >= F.col("top.high") * 7)
    dense = (F.col("total") >= 5) & (F.col("top.k") * 5 >= F.col("total") * 4) & near
    return total.select(key, (F.col("top.k") / F.col("total")).alias("share"), dense.alias("aggressive"))


def prefix_concentration(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, prefix) of texts where one leading token begins over half of at least five lines that have one."""
    each = rows.select(key, T.leading_token(F.col("line")).alias("p")).filter("p is not null")
    groups = each.groupBy(key, "p").agg(F.count("*").alias("k"))
    top = groups.groupBy(key).agg(F.sum("k").alias("total"), F.max_by(F.struct("p", "k"), F.struct("k", "p")).alias("top"))
    return top.filter((F.col("total") >= 5) & (F.col("top.k") / F.col("total") > 0.5)).select(key, F.col("top.p").alias("prefix"))


def looks_like_content(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, content): whether a text is source rather than command output, by its structure."""
    rows = explode_lines(docs, key, text)
    c = F.col("line")
    each = rows.select(key, C.content_class(c).alias("class"), c.alias("line"), (c.contains("warning:") | c.startswith("  --> ")).alias("warns"))
    full = F.col("class") != "blank"
    sums = each.groupBy(key).agg(
        F.count("*").alias("n"), F.count_if(full).alias("full"), F.count_if("warns").alias("warnings"),
        F.sum(F.when(full, F.octet_length("line"))).alias("chars"), F.sum(F.when(full, C.count_of(F.col("line"), C.STRUCTURAL))).alias("marks"),
        F.count_if(F.col("class").isin("definition", "import")).alias("defs"))
    good = ((F.col("n") >= 20) & (F.col("full") >= 10) & (F.col("warnings") < 3) & (F.col("marks") / F.greatest("chars", F.lit(1)) >= 0.02)
            & (F.col("defs") > F.floor(F.col("full") / 10)))
    return sums.select(key, F.coalesce(good, F.lit(False)).alias("content"))


def token_overlap(pairs: DataFrame, keys: tuple[str, ...], prediction: str = "prediction", truth: str = "truth") -> DataFrame:
    """(keys, f1, exact): overlap of the normalised words as multisets, and equality of the normalised texts."""
    p, t = normalised(F.col(prediction)), normalised(F.col(truth))
    sides = pairs.select(*keys, p.alias("p"), t.alias("t"))
    words = sides.select(*keys, F.explode(F.concat(F.transform("p", lambda w: F.struct(w.alias("w"), F.lit(1).alias("a"), F.lit(0).alias("b"))),
                                                   F.transform("t", lambda w: F.struct(w.alias("w"), F.lit(0).alias("a"), F.lit(1).alias("b"))))).alias("x"))
    counts = words.groupBy(*keys, F.col("x.w").alias("w")).agg(F.least(F.sum("x.a"), F.sum("x.b")).alias("n"))
    same = counts.groupBy(*keys).agg(F.sum("n").alias("same"))
    both = sides.join(same, list(keys), "left").withColumn("same", F.coalesce("same", F.lit(0)))
    equal = (F.array_join("p", " ") == F.array_join("t", " ")).cast("double")
    f1 = F.when((F.size("p") == 0) | (F.size("t") == 0), (F.size("p") == F.size("t")).cast("double")).when(F.col("same") == 0, 0.0).otherwise(
        2.0 * F.col("same") / (F.size("p") + F.size("t")))
    return both.select(*keys, f1.alias("f1"), equal.alias("exact"))


def normalised(text: Column) -> Column:
    """Words of a text in lower case, without ASCII punctuation and English articles."""
    bare = F.regexp_replace(F.lower(T.text_of(text)), r"[!-/:-@\[-`{-~]", "")
    return F.filter(T.words(F.regexp_replace(bare, r"(?U)\b(a|an|the)\b", " ")), lambda w: w != "")


# Signs that a reply refuses to answer.
REFUSALS = ("cannot", "don't know", "do not know", "no answer", "not in the context", "not provided", "not mentioned",
            "unanswerable", "no information", "not in the passage")


def refuses(text: Column) -> Column:
    found = F.lit(False)
    for mark in REFUSALS:
        found = found | F.lower(text).contains(mark)
    return found


def retention(trials: DataFrame, condition: str, baseline: str, least: float = 95.0) -> DataFrame:
    """Means of f1 and cost by condition, against those of the baseline: change of cost and retention of f1 in percent."""
    means = trials.groupBy(condition).agg(F.avg("f1").alias("f1"), F.avg("cost").alias("cost"), F.count("*").alias("n"))
    base = means.filter(F.col(condition) == baseline).select(F.col("f1").alias("f0"), F.col("cost").alias("c0"))
    kept = F.when(F.col("f0") > 0, F.col("f1") / F.col("f0") * 100).otherwise(0.0)
    return means.crossJoin(F.broadcast(base)).select(
        condition, F.round("f1", 6).alias("f1"), F.round("cost", 6).alias("cost"), "n",
        F.round((F.col("cost") - F.col("c0")) / F.col("c0") * 100, 6).alias("delta"), F.round(kept, 6).alias("retention"),
        F.when(kept >= least, "PASS").otherwise("FAIL").alias("verdict"))


def call_matches(samples: DataFrame, key: str) -> DataFrame:
    """(key, f1) of samples with `expected` and `predicted`, arrays of (name, arguments as a JSON object).

    Each expected call takes the first predicted one that is free, has its name and all its arguments: equal
    values, numbers within a millionth, or equal texts. Greedy matching is a loop within a row: Arrow batches.
    """
    import json

    def same(a, b) -> bool:
        if a == b or str(a) == str(b):
            return True
        numbers = isinstance(a, (int, float)) and isinstance(b, (int, float))
        return numbers and abs(float(a) - float(b)) < 1e-6

    def fits(want: dict, got: dict) -> bool:
        if want["name"] != got["name"]:
            return False
        a, b = json.loads(want["arguments"] or "{}"), json.loads(got["arguments"] or "{}")
        return isinstance(b, dict) and all(k in b and same(v, b[k]) for k, v in a.items())

    def f1(want: list, got: list) -> float:
        if not want or not got:
            return float(not want and not got)
        free = list(got)
        hits = 0
        for w in want:
            at = next((i for i, g in enumerate(free) if fits(w, g)), None)
            if at is not None:
                free.pop(at)
                hits += 1
        return 2 * hits / (len(want) + len(got))

    schema = StructType([samples.schema[key], StructField("f1", DoubleType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [f1(w or [], g or []) for w, g in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=schema.names)

    return samples.select(key, "expected", "predicted").mapInArrow(run, schema)


def usage(rows: DataFrame, weight: int = 4, by: tuple[str, ...] = ()) -> DataFrame:
    """Requests, tokens, weighted cost and mean savings, in all or by some columns."""
    sums = (F.count("*").alias("requests"), F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"))
    grouped = rows.groupBy(*by).agg(*sums, F.coalesce(F.avg("savings_pct"), F.lit(0.0)).alias("avg_savings"))
    return grouped.withColumn("weighted_cost", F.col("prompt_tokens") + weight * F.col("completion_tokens"))


