"""Vectors of the text functions, classes and skeletons."""

import pytest
from pyspark.sql import functions as F

from linewright import config
from linewright.functions import classify as C
from linewright.functions import skeleton as S
from linewright.functions import text as T


def apply(spark, values, made, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.x for r in rows.select("i", made(F.col("v")).alias("x")).orderBy("i").collect()]


def test_lines(spark):
    got = apply(spark, ["", "\n", "a", "a\n", "a\n\n", "a\r\nb", None], T.lines)
    assert got == [[], [""], ["a"], ["a"], ["a", ""], ["a", "b"], []]


@pytest.mark.parametrize(("word", "stem"), [("running", "runn"), ("go", "go"), ("classes", "class"), ("glass", "glass"), ("cats", "cat"), ("nation", "nation"), ("station", "sta"), ("able", "able")])
def test_stem(spark, word, stem):
    assert apply(spark, [word], T.stem) == [stem]


def test_tokens(spark):
    assert apply(spark, ["Foo_bar x1 é_x caféx a-b1c 9abc _ok", None], T.identifiers) == [["foo_bar", "b1c", "_ok"], []]
    assert apply(spark, ["validate", "ab"], T.trigrams) == [["val", "ali", "lid", "ida", "dat", "ate"], ["ab"]]
    assert apply(spark, ["été 12 abc 1234"], T.memory_tokens) == [["été", "abc"]]
    assert apply(spark, ["err_42 ab été fn"], T.preservation_targets) == [["err_42", "été"]]
    assert apply(spark, ["see `src/main.rs:42`, then", "none"], T.first_path) == ["src/main.rs", None]
    assert apply(spark, ["sed -i s/a/b/ lib/x.py", "sed 's/a/b/' y.txt", "no"], T.sed_target) == ["lib/x.py", "y.txt", None]
    assert apply(spark, ["src/a.rs, (b/c.py) d.rs e/f.txt"], T.source_mentions) == [["src/a.rs", "b/c.py"]]
    assert apply(spark, ["pub fn merge(a, b) {", "def  x"], T.function_name) == ["merge", "x"]
    assert apply(spark, ["12:34:56.789 job 17 done 4", "12:34:56 up", "no"], T.timestamp_remainder) == ["job 17 done", "up", ""]
    assert apply(spark, ["src/a.rs: x", "a: x", "no"], T.leading_token) == ["src/a.rs", None, None]


def test_line_rules(spark):
    lines = ["error[E0308]: x", "  --> src/a.rs", "-----", "[###] 40%", "test a ... ok", "not ok", "Compiling x", "ab", "   ", "plain line"]
    assert apply(spark, lines, C.is_error) == [True, True, False, False, False, False, False, False, False, False]
    assert apply(spark, lines, C.is_summary) == [False, False, False, False, True, False, True, False, False, False]
    assert apply(spark, lines, C.should_drop) == [False, False, True, True, False, False, False, True, True, False]
    assert apply(spark, ["\x1b[1;31mred\x1b[0m \x1b]0;title\x07x\x1b(By"], C.strip_ansi) == ["red xBy"]


def test_classes(spark):
    lines = ["", "----", "// note", "use std::x;", "fn main() {", "error: bad", "3 passed, 1 failed", "let x = 1", "plain words"]
    assert apply(spark, lines, C.content_class) == ["blank", "separator", "comment", "import", "definition", "error", "summary", "definition", "code"]
    lines = ["", "====", "error: x", "warning: y", "test result: ok", "running 3 tests", "   Compiling foo v1", "module something long", "x y"]
    assert apply(spark, lines, C.output_class) == [
        "blank", "separator", "error", "warning", "summary", "summary", "progress", "prefix", "code"]
    assert apply(spark, ["x" * 50, "é" * 60], lambda c: C.truncate_line(c, 40)) == ["x" * 20 + "... (50 chars)", "é" * 10 + "... (120 chars)"]


def test_definition_of(spark):
    rows = spark.createDataFrame([("foo", "fn foo(x)"), ("foo", "new foo(x)"), ("foo", "a.foo(x)"), ("foo", "foo"), ("foo", "foo -> bar"), ("foo", "call foo;")], "p string, l string")
    assert [r[0] for r in rows.select(C.is_definition_of(F.col("p"), F.col("l"))).collect()] == [True, False, False, False, True, False]


@pytest.mark.parametrize(("line", "plain", "wide"), [
    ("id 550e8400-e29b-41d4-a716-446655440000 x", "id {uuid} x", "{w} {uuid} x"), ("commit deadbeef1 done", "commit {hash} done", "{w} {hash} {w}"),
    ("v 1.2.3 ok", "v {ver} ok", "v {ver} {w}"), ("worker-12 up", "{w}-{n} up", "{w}-{n} {w}"), ("took 42 ms", "took {n} ms", "{w} {n} {w}"),
    ("[####...] 50%", "{progress} {n}%", "{progress} {n}%"), ("a   b\tc", "a b c", "a b c"), ("ABC", "abc", "{w}"), ("1.2345678.3", "{ver}", "{ver}"),
    ("Compiling serde v1.0.200", "compiling serde v{ver}", "{w} {w} v{ver}"), ("error[E0308]: src/a/b", "error[e0308]: src/a/b", "{w}[e0308]: {w}/a/b"), ("[#]", "[#]", "[#]"),
])
def test_skeletons(spark, line, plain, wide):
    assert apply(spark, [line], S.skeleton) == [plain] and apply(spark, [line], S.aggressive_skeleton) == [wide]


def test_settings():
    assert config.mode() == config.Setting("strict", "default") and config.mode("odd").value == "reactive"
    assert config.mode(None, {"mode": "fast"}, {"mode": "strict"}) == config.Setting("fast", "project")
    got = config.features("+editMerge,-compress", {"healEdit": False}, {"healEdit": True, "priorInjection": True})
    assert (got["editMerge"].value, got["compress"].source, got["healEdit"].source, got["priorInjection"].source, got["convWindow"].source) == (True, "env", "project", "global", "default")
