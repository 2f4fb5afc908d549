"""Shortening of prose, replies and structured results. Every compressor gives null where it does not help."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from linewright.functions import text as T
from linewright.operators.runs import by, joined

# Marks of code, and phrases that say little, in the order in which they are removed.
CODE_MARKS = ("```", "//", "/*", "src/", ".rs:", ".py:", ".md")
PHRASES = (
    r"\b(Let me (analyze|look|check|review|see|think|consider)\b[^.]*\.)",
    r"\b(I (?:can|would|will) need to)[^.]*\.",
    r"\b(In order to)[^.]*\.",
    r"\b(First(?:,|ly)? let me)[^.]*\.",
    r"\b(Based on (?:the|this|my|our))[^.]*\.?",
    r"\b(This means that)[^.]*\.",
    r"\b(The (?:next|final|first) step)[^.]*\.",
    r"\b(Now I(?: can| will|'ll| need to| should))[^.,;]*[,;.]?",
    r"\b(Alright|Okay|So,?|Well,?|Now,?)\s*",
    r"\bessentially|basically|simply|actually|obviously|clearly|currently\b",
)
# Fixed value: how a definition begins.
SIGNATURE = r"^\s*(?:pub\s+)?(?:fn|def|class|fun|function)\s+(\w+)"


def has_code(text: Column) -> Column:
    found = F.lit(False)
    for mark in CODE_MARKS:
        found = found | text.contains(mark)
    return found


def without_phrases(text: Column) -> Column:
    for p in PHRASES:
        text = F.regexp_replace(text, "(?iuU)" + p, " ")
    return F.array_join(T.words(text), " ")


def compress_reasoning(text: Column, symbols: Column | None = None) -> Column:
    """Prose of 200 bytes or more without code, less its empty phrases, if that is under 60 % of it.

    `symbols`, an array in order of use, are put in brackets first.
    """
    marked = apply_dictionary(text, symbols) if symbols is not None else text
    made = without_phrases(marked)
    fits = (F.octet_length(text) >= 200) & ~has_code(text)
    return F.when(fits, F.when(F.octet_length(made) < F.octet_length(text) * 0.6, made))


def apply_dictionary(text: Column, symbols: Column) -> Column:
    return F.aggregate(symbols, text, lambda t, s: F.replace(t, s, F.concat(F.lit("["), s, F.lit("]"))))


def build_dictionary(symbols: DataFrame, column: str = "symbol") -> DataFrame:
    """(symbol, frequency) of symbols that occur more than once."""
    return symbols.groupBy(F.col(column).alias("symbol")).agg(F.count("*").alias("frequency")).filter("frequency > 1")


def extract_phrases(docs: DataFrame, key: str = "doc_id", text: str = "text", within: int = 15) -> DataFrame:
    """(key, name, phrase): of the first lines, each signature's name and 40 characters of the first real line after it."""
    rows = docs.select(key, F.posexplode(F.slice(T.lines(F.col(text)), 1, within)).alias("line_no", "line"))
    t = T.trim(F.col("line"))
    marked = rows.withColumn("t", t).withColumn("name", F.regexp_extract("t", SIGNATURE, 1))
    placed = marked.withColumn("k", F.sum((F.col("name") != "").cast("int")).over(by(key)))
    named = F.max("name").over(Window.partitionBy(key, "k"))
    after = placed.withColumn("of", named).filter((F.col("k") > 0) & (F.col("name") == "") & (F.octet_length("t") > 5) & ~F.col("t").startswith("use "))
    return after.groupBy(key, "k").agg(F.first("of").alias("name"), F.min_by(F.substring("t", 1, 40), "line_no").alias("phrase")).select(key, "name", "phrase")


def compress_reply(docs: DataFrame, keys: tuple[str, ...], text: str = "text") -> DataFrame:
    """(keys, text) of replies that get shorter: as a whole, or prose between code fences piece by piece.

    Code keeps its opening fence and loses its closing one; prose of under 50 bytes stays.
    """
    whole = docs.select(*keys, F.col(text).alias("_lw_text"), compress_reasoning(F.col(text)).alias("_lw_whole"))
    rows = whole.filter("_lw_whole is null").select(*keys, F.posexplode(T.lines(F.col("_lw_text"))).alias("line_no", "line"))
    fence = F.regexp_replace("line", r"(?U)^\s+", "").startswith("```")
    order = Window.partitionBy(*keys).orderBy("line_no")
    placed = rows.withColumn("fence", fence).withColumn("part", F.sum(F.col("fence").cast("int")).over(order))
    inside = placed.filter(~(F.col("fence") & (F.col("part") % 2 == 0)))
    parts = inside.groupBy(*keys, "part").agg(F.concat(joined(F.col("line_no"), F.col("line"), "\n"), F.lit("\n")).alias("body"))
    short = F.when(~F.col("body").contains("```") & (F.octet_length("body") >= 50), compress_reasoning(F.col("body")))
    made = parts.withColumn("short", short).withColumn("size", F.octet_length(F.coalesce("short", "body"))).withColumn(
        "out", F.when(F.col("short").isNotNull(), F.concat("short", F.lit("\n"))).otherwise(F.col("body")))
    glued = made.groupBy(*keys).agg(joined(F.col("part"), F.col("out"), "").alias("text"), F.sum("size").alias("size"),
                                    F.sum(F.octet_length("body")).alias("was")).filter("size < was").select(*keys, "text")
    return whole.filter("_lw_whole is not null").select(*keys, F.col("_lw_whole").alias("text")).unionByName(glued)


def erase_common_words(docs: DataFrame, keys: tuple[str, ...], text: str = "text", budget: float = 50.0) -> DataFrame:
    """(keys, text) of texts that get shorter when their commonest words are erased, `budget` bits of them.

    A word costs minus the binary logarithm of its share of the text; the cheapest go first, of equal ones the
    earlier. Words of up to two bytes, and those with digits or brackets, stay. A gap is one underscore.
    A text's words are counted within its row, in Arrow batches, so nothing is shuffled.
    """
    body = F.col(text)
    words = T.words(body)
    fit = docs.filter((F.octet_length(body) >= 100) & body.rlike(r"(?U)\s") & (F.size(words) >= 10))
    source = fit.select(*keys, F.octet_length(body).alias("was"), words.alias("words"))
    held, width = re.compile(r"[0-9(){}\[\]<>=:;]"), len(keys)

    def erased(found: list[str]) -> str:
        counts = Counter(found)
        cost = {w: -math.log2(n / len(found)) for w, n in counts.items()}
        free = {w for w in counts if len(w.encode()) > 2 and not held.search(w)}
        gone, spent = set(), 0.0
        for i in sorted((i for i, w in enumerate(found) if w in free), key=lambda i: (cost[found[i]], i)):
            if spent >= budget:
                break
            gone.add(i)
            spent += cost[found[i]]
        return " ".join("_" if i in gone else w for i, w in enumerate(found) if i not in gone or i - 1 not in gone)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [erased(w) for w in batch.column(width + 1).to_pylist()]
            short = [i for i, (t, was) in enumerate(zip(texts, batch.column(width).to_pylist(), strict=True)) if len(t.encode()) < was]
            at = pa.array(short, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in range(width)), pa.array([texts[i] for i in short], pa.string())], names=[*keys, "text"])

    return source.mapInArrow(run, StructType([*(source.schema[k] for k in keys), StructField("text", StringType())]))


def minify_json(text: Column) -> Column:
    """JSON of over 500 bytes without white space between its parts, where that is shorter; else the text."""
    t = T.trim(text)
    made = F.try_parse_json(text).cast("string")
    fits = (F.octet_length(text) > 500) & (t.startswith("{") | t.startswith("[")) & (F.octet_length(made) < F.octet_length(text))
    return F.when(fits, made).otherwise(text)


def hoist_invariants(text: Column) -> Column:
    """A JSON array of objects as a header of the keys equal in all and a line of the rest for each; null if not shorter.

    At least 500 bytes, three objects and two keys in the first; values of over 50 bytes are not hoisted.
    """
    t = T.trim(text)
    rows = F.from_json(text, "array<map<string,string>>")
    first = F.get(rows, F.lit(0))
    keys = F.array_sort(F.map_keys(first))
    same = F.filter(keys, lambda k: F.forall(rows, lambda r: F.map_contains_key(r, k) & F.try_element_at(r, k).eqNullSafe(F.try_element_at(first, k)))
                    & (F.octet_length(F.coalesce(F.try_element_at(first, k), F.lit("null"))) <= 50))
    pair = lambda r, k: F.concat(k, F.lit("="), F.coalesce(F.try_element_at(r, k), F.lit("null")))
    header = F.concat(F.lit("[S] "), F.array_join(F.transform(same, lambda k: pair(first, k)), ","), F.lit("\n"))
    line = lambda r, i: F.concat((i + 1).cast("string"), F.lit(":"), F.array_join(
        F.transform(F.filter(F.array_sort(F.map_keys(r)), lambda k: ~F.array_contains(same, k)), lambda k: pair(r, k)), ","), F.lit("\n"))
    made = F.concat(header, F.array_join(F.transform(rows, line), ""))
    fits = (t.startswith("[") & t.endswith("]") & (F.octet_length(text) >= 500) & (F.size(rows) >= 3) & (F.size(keys) >= 2)
            & F.forall(rows, lambda r: r.isNotNull()) & (F.size(same) * 10 >= F.size(keys)) & (F.size(same) > 0))
    return F.when(fits, F.when(F.octet_length(made) < F.octet_length(text), made))


def load_dictionary(symbols: DataFrame, most: int = 200) -> DataFrame:
    """The `most` commonest symbols of build_dictionary, ties by name: what a session takes along."""
    return symbols.orderBy(F.desc("frequency"), "symbol").limit(most)


def _after(line: Column, word: Column, most: int) -> Column:
    """What follows a word up to a full stop or semicolon, or `most` characters of it."""
    rest = F.substring(line, F.instr(line, word) + F.length(word), F.length(line))
    return F.substring(T.trim(F.when(rest.rlike("[.;]"), F.regexp_extract(rest, r"^[^.;]*", 0)).otherwise(F.substring(rest, 1, most))), 1, most)


def _first_with(lines: Column, phrases: tuple[str, ...], made) -> Column:
    """made(line, phrase) of the first line that gives something for the first phrase that does."""
    options = F.array(*map(F.lit, phrases))
    each = F.transform(lines, lambda x: F.get(F.filter(F.transform(options, lambda p: made(x, p)), lambda v: v.isNotNull() & (v != "")), F.lit(0)))
    return F.get(F.filter(each, lambda v: v.isNotNull()), F.lit(0))


def dialogue_state(text: Column) -> Column:
    """Goal, blocker, command, result and next step that a reply names, as one line; null unless two are found.

    Of prose of 200 bytes and five lines or more, without code marks.
    """
    fits = (F.octet_length(text) >= 200) & ~text.contains("```") & ~text.contains("//") & ~text.contains("/*")
    return F.when(fits, T.let(T.lines(text), lambda lines: F.when(F.size(lines) >= 5, _state_line(text, lines))))


def _state_line(text: Column, lines: Column) -> Column:
    low = lambda x: F.lower(T.trim(x))

    def labelled(x: Column, p: Column) -> Column:
        rest = T.trim(F.regexp_replace(T.trim(x), r"^[^:]*:", ""))
        return F.when(F.startswith(low(x), p) & x.contains(":") & (rest != "") & (F.octet_length(rest) < 100), F.substring(rest, 1, 80))

    says = lambda most: lambda x, p: F.when(F.contains(F.lower(x), p), _after(F.lower(x), p, most))
    whole = lambda x: F.substring(T.trim(x), 1, 80)
    goal = F.coalesce(_first_with(lines, ("goal:", "aim:", "objective:"), labelled),
                      _first_with(lines, ("i will", "i need to", "i should", "let me", "going to fix"), says(60)))
    blocker = F.coalesce(_first_with(lines, ("issue:", "problem:", "error:", "bug:", "blocker:", "failing:"), labelled),
                         whole(F.get(F.filter(lines, lambda x: x.contains("E0") | x.contains("error[E") | x.contains("FAILED")), F.lit(0))))
    ran = ("ran cargo", "running cargo", "trying cargo", "ran `", "running `", "trying `", "`cargo", "`pytest", "`npm", "`go test")
    sentence = lambda x: F.regexp_extract(F.regexp_replace(T.trim(x), "^`+|`+$", ""), r"^[^.;]*", 0)
    tool = lambda x, p: F.when(F.contains(F.lower(x), p), F.substring(T.trim(F.regexp_extract(
        F.substring(x, F.instr(F.lower(x), p), F.length(x)), r"^[^.;]*", 0)), 1, 60))
    command = F.coalesce(_first_with(lines, ran, lambda x, p: F.when(F.contains(low(x), p), T.trim(sentence(x)))),
                         _first_with(lines, ("cargo", "pytest", "npm", "go test", "make"), tool))
    result = F.coalesce(_first_with(lines, ("result", "output", "returned", "complete", "finished"), labelled),
                        whole(F.get(F.filter(lines, lambda x: F.lower(x).contains("failed") | F.lower(x).contains("passed")), F.lit(0))))
    step = _first_with(F.reverse(lines), ("next:", "next step:", "final step:", "then i", "next i", "finally"),
                       lambda x, p: F.when(F.contains(low(x), p), _after(low(x), p, 60)))

    def named_as(name: str):
        return lambda x: F.when(F.coalesce(x, F.lit("")) != "", F.concat(F.lit(f"{name}="), x))

    named = [T.let(v, named_as(k)) for k, v in (
        ("goal", goal), ("blocker", blocker), ("command", command), ("result", result), ("next", step))]
    fields = F.filter(F.array(*named), lambda v: v.isNotNull())
    made = T.let(fields, lambda f: F.when(F.size(f) >= 2, F.concat(F.lit("[STATE] "), F.array_join(f, " | "))))
    return T.let(made, lambda m: F.when(F.octet_length(m) < F.octet_length(text), m))


def best_of(original: Column, *candidates: Column) -> Column:
    """The candidate that saves most bytes; of equal ones the earlier; null without one that saves any."""
    names = [f"c{i}" for i in range(len(candidates))]
    bound = F.struct(original.alias("o"), *[c.alias(n) for c, n in zip(candidates, names, strict=True)])
    return T.let(bound, lambda b: _best(b["o"], [b[n] for n in names]))


def _best(original: Column, candidates: list[Column]) -> Column:
    saved = [F.when(c.isNotNull(), F.greatest(F.octet_length(original) - F.octet_length(c), F.lit(0))) for c in candidates]
    most = F.greatest(*saved) if len(saved) > 1 else saved[0]
    chosen = F.lit(None).cast("string")
    for c, s in reversed(list(zip(candidates, saved, strict=True))):
        chosen = F.when(s == most, c).otherwise(chosen)
    return F.when(most > 0, chosen)




def compress_bodies(bodies: DataFrame, key: str = "id", body: str = "body", least: int = 300) -> DataFrame:
    """(key, body) of JSON replies whose first choice's text was long enough and got shorter; bodies under 500 bytes stay."""
    content = F.get_json_object(body, "$.choices[0].message.content")
    long = bodies.select(key, F.col(body).alias("_lw_body"), content.alias("text")).filter(
        (F.octet_length("_lw_body") >= 500) & (F.octet_length("text") > least))
    short = compress_reply(long, (key,)).withColumnRenamed("text", "_lw_short")
    quoted = lambda c: F.regexp_extract(F.to_json(F.struct(F.col(c).alias("x"))), r'(?s)^\{"x":(.*)\}\z', 1)
    made = long.join(short, key).select(key, F.replace("_lw_body", quoted("text"), quoted("_lw_short")).alias("body"))
    return made.filter(F.get_json_object("body", "$.choices[0].message.content").isNotNull())

