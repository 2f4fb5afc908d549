"""Lines, words, tokens and stems as Column expressions.

Null texts are empty. Lengths that a rule states are bytes unless its name says characters. White space is
the Unicode property, which the built-in trim does not know.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Suffixes in the order in which they are tried.
SUFFIXES = ("ing", "tion", "sion", "ment", "ness", "able", "ible", "ful", "less", "ly", "ed", "es", "er", "or", "al",
            "ic", "en", "ive", "ize", "ise")
# Words before a function's name.
MODIFIERS = ("def", "fn", "function", "pub", "private", "protected", "static", "async", "export", "default", "const",
             "let", "var", "class", "struct", "enum", "trait", "impl", "interface", "type")
# Words that are no identifiers worth guarding.
COMMON_WORDS = (
    "def", "class", "import", "return", "self", "None", "True", "False", "if", "for", "while", "try", "except",
    "finally", "with", "as", "from", "not", "and", "or", "in", "is", "pass", "break", "continue", "elif", "else",
    "raise", "yield", "lambda", "fn", "pub", "let", "mut", "use", "mod", "struct", "enum", "impl", "trait", "where",
    "match", "ref", "move", "async", "await", "unsafe", "type", "const", "static", "macro", "crate", "super", "Self",
    "var", "func", "int", "str", "bool", "nil", "uint", "float64", "string", "int32", "int64", "error", "err", "null",
    "undefined", "typeof", "instanceof", "new", "this", "void", "any", "unknown", "never", "assert", "assertEq", "get",
    "set", "has", "add", "del", "len", "cap", "max", "min", "all", "map", "sum", "abs", "hex", "ord", "pow", "range",
    "sorted", "input", "open", "list", "dict", "tuple", "print", "printf", "println", "require", "module", "exports",
    "function", "console", "log",
)
# Endings of source paths worth fetching.
SOURCE_ENDINGS = (".rs", ".py", ".ts", ".js", ".go", ".java", ".rs:", ".py:")

TOKEN_SPLIT = r"[^\p{IsAlphabetic}\p{N}_]+"
IDENTIFIER = r"[A-Za-z_][A-Za-z0-9_]{2,39}"
SIGNATURE = r"^\s*(pub\s+)?(fn|def|class|struct|enum|trait|function|func)\s+(\w+)"


def let(value: Column, made) -> Column:
    """made(value) with the value computed once, however often `made` uses it."""
    return F.get(F.transform(F.array(value), made), F.lit(0))


def text_of(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def trim(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+\z", "")


def trim_end(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\s+\z", "")


def lines(text: Column) -> Column:
    """Lines without their ends; a final line end adds no empty line, and an empty text has no lines."""
    body = text_of(text)
    pieces = F.split(F.regexp_replace(body, r"\n\z", ""), "\n", -1)
    return F.when(body == "", F.array().cast("array<string>")).otherwise(
        F.transform(pieces, lambda x: F.regexp_replace(x, r"\r\z", "")))


def words(c: Column) -> Column:
    return F.filter(F.split(text_of(c), r"(?U)\s+"), lambda w: w != "")


def pieces(c: Column) -> Column:
    """Runs of letters, digits and underscores of any script."""
    return F.filter(F.split(text_of(c), TOKEN_SPLIT), lambda w: w != "")


def identifiers(c: Column) -> Column:
    """Lower-cased ASCII identifiers of 3 to 40 bytes among the pieces."""
    kept = F.filter(pieces(c), lambda w: w.rlike(rf"^{IDENTIFIER}\z"))
    return F.transform(kept, F.lower)


def first_identifier(c: Column) -> Column:
    """The first of the identifiers; null without any. The rest of the text is not cut up."""
    part = r"[\p{IsAlphabetic}\p{N}_]"
    return F.nullif(F.lower(F.regexp_extract(text_of(c), f"(?<!{part}){IDENTIFIER}(?!{part})", 0)), F.lit(""))


def stem(word: Column) -> Column:
    """The word without the first suffix that fits; a word of up to three bytes stays."""
    return let(F.lower(trim(word)), stem_of)


def stem_of(w: Column) -> Column:
    """The stem of a lower-cased word without spaces around it, which each rule names: a column to be read, not one to be made."""
    n = F.length(w)
    rule = F.when(F.octet_length(w) <= 3, w)
    for s in SUFFIXES:
        rule = rule.when(w.endswith(s) & (F.octet_length(w) > len(s) + 2), F.substring(w, F.lit(1), n - len(s)))
    plural = w.endswith("s") & ~w.endswith("ss") & (F.octet_length(w) > 3)
    return rule.when(plural, F.substring(w, F.lit(1), n - 1)).otherwise(w)


def stems(c: Column) -> Column:
    return F.transform(identifiers(c), stem_of)


def trigrams(token: Column) -> Column:
    t = F.lower(token)
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.length(t) - 2, F.lit(1))), lambda i: F.substring(t, i, F.lit(3)))
    return F.when(F.length(t) <= 3, F.array(t)).otherwise(grams)


def memory_tokens(c: Column) -> Column:
    kept = F.filter(pieces(c), lambda w: (F.octet_length(w) >= 3) & w.rlike(r"\p{IsAlphabetic}"))
    return F.transform(kept, F.lower)


def preservation_targets(c: Column) -> Column:
    return F.filter(pieces(c), lambda w: F.octet_length(w) >= 4)


def code_tokens(c: Column, least: int = 3) -> Column:
    """ASCII identifiers of at least `least` bytes, as they stand."""
    return F.filter(pieces(c), lambda w: (F.octet_length(w) >= least) & w.rlike(r"^[A-Za-z_][A-Za-z0-9_]*\z"))


def loose_identifiers(c: Column) -> Column:
    return F.filter(pieces(c), lambda w: (F.octet_length(w) >= 2) & w.rlike(r"^[\p{IsAlphabetic}_]"))


def primary_identifier(text: Column, file_stem: Column) -> Column:
    """The first piece that looks like a name: mixed case, an underscore or six bytes; else the first; else 'unknown'."""
    kept = F.filter(pieces(text), lambda w: F.octet_length(w).between(3, 40) & w.rlike(r"^[\p{IsAlphabetic}_]")
                    & (w != file_stem) & ~(w.rlike(r"^[a-z]+\z") & (F.octet_length(w) < 5)))
    liked = F.filter(kept, lambda w: w.rlike(r"\p{Lu}") | w.contains("_") | (F.octet_length(w) >= 6))
    return F.coalesce(F.get(liked, F.lit(0)), F.get(kept, F.lit(0)), F.lit("unknown"))


def interesting(word: Column) -> Column:
    """3 to 40 bytes, begins with a letter, no common word; an all-lower-case word needs an underscore."""
    plain = word.rlike(r"^[\p{Ll}_]+\z")
    return (F.octet_length(word).between(3, 40) & word.rlike(r"^\p{IsAlphabetic}") & ~word.isin(*COMMON_WORDS)
            & (~plain | word.contains("_")))


def first_path(c: Column) -> Column:
    """The first word with a path separator, without quotes around it and numbers after it; null without one."""
    bare = F.transform(words(c), lambda w: F.regexp_replace(w, r"""^["'`(),:;]+|["'`(),:;]+\z""", ""))
    paths = F.filter(bare, lambda w: w.rlike(r"[/\\]") & (F.octet_length(w) >= 3))
    clean = F.filter(F.transform(paths, lambda w: F.regexp_replace(w, r"[.,:;0-9]+\z", "")), lambda w: F.octet_length(w) >= 3)
    return F.get(clean, F.lit(0))


def source_mentions(c: Column, most: int = 3) -> Column:
    """The first `most` source paths that a text mentions."""
    bare = F.transform(words(c), lambda w: F.regexp_replace(w, r"""^['"`()\[\]{},.]+|['"`()\[\]{},.]+\z""", ""))
    ends = lambda w: F.exists(F.array(*map(F.lit, SOURCE_ENDINGS)), lambda e: F.endswith(w, e))
    return F.slice(F.filter(bare, lambda w: w.contains("/") & ends(w)), 1, most)


def is_sed_pattern(w: Column) -> Column:
    """s or y, a delimiter that is no letter or digit, and at least two of it; five bytes at least."""
    mark = F.substring(w, 2, 1)
    uses = (F.length(w) - F.length(F.replace(w, mark, F.lit(""))))
    return (F.octet_length(w) >= 5) & w.rlike(r"^[sy][^A-Za-z0-9]") & (uses >= 2)


def sed_target(c: Column) -> Column:
    """The file of a sed command: the first word that is no flag, quoted text or pattern and has / \\ or a dot."""
    kept = F.filter(words(c), lambda w: ~w.rlike("""^[-'"]""") & ~is_sed_pattern(w) & w.rlike(r"[/\\.]"))
    bare = F.filter(F.transform(kept, lambda w: F.regexp_replace(w, """^['";]+|['";]+\\z""", "")), lambda w: F.octet_length(w) >= 3)
    return F.when(F.lower(c).contains("sed"), F.get(bare, F.lit(0)))


def leading_token(line: Column) -> Column:
    """What stands before the first colon of a trimmed line, if it has 2 to 119 bytes."""
    t = trim(line)
    head = trim(F.substring_index(t, ":", 1))
    return F.when(t.contains(":") & F.octet_length(head).between(2, 119), head)


def timestamp_remainder(line: Column) -> Column:
    """After a time of day, the next 30 characters without digits, spaces and colons at their end; else empty."""
    t = trim(line)
    rest = F.when(t.rlike(r"^[0-9]{2}:[0-9]{2}:[0-9]{2}\.") & (F.octet_length(t) > 12), F.regexp_replace(F.substring(t, F.lit(9), F.length(t)), r"^\.[0-9]*", "")).otherwise(
        F.substring(t, F.lit(9), F.length(t)))
    cut = F.substring(trim(rest), 1, 30)
    return F.when(t.rlike(r"^[0-9]{2}:[0-9]{2}:[0-9]{2}"), F.regexp_replace(cut, r"[0-9 :]+\z", "")).otherwise("")


def function_name(signature: Column) -> Column:
    """The first word of a signature that is a name and no modifier; else empty."""
    names = F.filter(F.split(trim(signature), r"[( {]"), lambda w: trim(w).rlike(r"^[\p{IsAlphabetic}\p{N}_]+\z") & ~trim(w).isin(*MODIFIERS))
    return F.coalesce(F.get(names, F.lit(0)), F.lit(""))


def signature_name(line: Column) -> Column:
    """The name that a definition line defines; empty if it defines none."""
    return F.regexp_extract(line, SIGNATURE, 3)


def djb2(text: Column) -> Column:
    """The unsigned 64-bit sum h * 33 + byte from 5381 on, as a decimal; 0 for empty text, null for null."""
    body = F.encode(text, "utf-8")
    byte = lambda i: F.conv(F.hex(F.substring(body, i, 1)), 16, 10).cast("int")
    step = lambda h, i: F.pmod(h * 33 + byte(i), F.lit("18446744073709551616").cast("decimal(38,0)")).cast("decimal(30,0)")
    summed = F.aggregate(F.sequence(F.lit(1), F.octet_length(text)), F.lit(5381).cast("decimal(30,0)"), step)
    return F.when(text.isNotNull(), F.when(F.octet_length(text) == 0, F.lit(0)).otherwise(summed).cast("decimal(20,0)"))


def change_key(file: Column, content: Column) -> Column:
    """Keys of a change: of file and content, and of the content alone."""
    return F.struct(F.xxhash64(file, content).alias("file_hash"), F.xxhash64(content).alias("content_hash"))


def cache_key(*parts: Column) -> Column:
    """One key of a request's parts; a null part differs from an empty one."""
    return F.sha2(F.to_json(F.struct(*[p.cast("string").alias(f"p{i}") for i, p in enumerate(parts)]), {"ignoreNullFields": "false"}), 256)
