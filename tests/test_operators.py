"""Fixtures of the operators: what must stay, what must shrink, and invariants."""

import json

import pytest
from pyspark.sql import functions as F

from linewright.functions import text as T
from linewright.functions import udtf
from linewright.operators import code, compress, convo, events, folds, guard, index, memory, quality, runs, session, sift
from linewright.operators.lines import explode_lines, explode_stems
from linewright.plans import history
from linewright.sources import files
from linewright.streaming import stateful


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def one(frame, column="text"):
    return {r.doc_id: r[column] for r in frame.collect()}


SAME = "\n".join(f"   Compiling serde v1.0.{i}" for i in range(30))
MIXED = "\n".join(f"   Compiling {n} v1.{i}.0" for i, n in enumerate("alpha beta gamma delta zeta theta iota kappa".split() * 3))
OKS = "\n".join(f"test test_{i} ... ok" for i in range(15))
BLOCK = "\n".join([*(f"   Compiling dep v1.0.{i}" for i in range(50)), "", "error[E0308]: mismatched types", "  --> src/main.rs:1:2", "   expected u8", "", *(f"   Compiling dep v2.0.{i}" for i in range(50))])
TABLE = "\n".join(f"{'%04d' % (i * 7919 % 10000)}  user{i % 3}  running  job" for i in range(12))


def test_compression_ratios(spark):
    got = one(sift.format_output(docs(spark, SAME, MIXED, OKS, BLOCK, '{"a": 1}\n\n----\n{"b": 2}', "@@ -1 +1 @@\n+x\n ctx\n ctx\n ctx\n-y")))
    assert len(got[0]) < 0.5 * len(SAME) and len(got[1]) < 0.2 * len(MIXED) and got[2] == "[15 ok]"
    assert "E0308" in got[3] and "expected u8" in got[3] and len(got[3]) < 0.3 * len(BLOCK)
    assert got[4] == '{"a": 1}\n{"b": 2}' and got[5] == "@@ -1 +1 @@\n+x\n[3 identical context lines]\n-y\n"


def test_table_columns(spark):
    got = sift.format_output(docs(spark, TABLE)).first()
    assert got.strategy == "tabular" and not any(w.isdigit() for w in got.text.split())
    assert sift.without_noise(["a b", "c d"], [False, False]) is None


def test_groups(spark):
    rows = sift.classified(sift.clean_lines(docs(spark, "a.rs: got 1\na.rs: got 2\nb.rs: got 3\n\n----\nother line"), "doc_id", "text"), "doc_id")
    got = [(r.sample, r.n, r.prefixes) for r in sift.skeleton_groups(rows, "doc_id").orderBy("first").collect()]
    assert got == [("a.rs: got 1", 2, ["a.rs"]), ("b.rs: got 3", 1, ["b.rs"]), ("other line", 1, [])]
    singles = spark.createDataFrame([(0, i, f"12:00:0{i} restart job {i}", 1, False, []) for i in range(6)] + [(0, 9, "end", 1, False, [])],
                                    "doc_id long, first int, sample string, n long, is_error boolean, prefixes array<string>")
    timed = [(r.sample, r.n) for r in sift.timed_runs(singles, "doc_id").orderBy("first").collect()]
    assert timed == [('[6 items matching prefix: "restart job"]', 6), ("end", 1)]


def test_results_keep_errors_and_never_grow(spark):
    small = "short"
    content = "use a\nuse b\n\n\n" + "\n".join(f"fn f{i}(x: u8) {{ g(x); }}\n\n\n// note" for i in range(30))
    texts = [small, SAME, BLOCK, content, "word " * 80]
    got = one(sift.compress_results(docs(spark, *texts)))
    assert all(len(got[i].encode()) <= len(t.encode()) for i, t in enumerate(texts)) and got[0] == small and "E0308" in got[2]
    condensed = one(sift.compress_content(docs(spark, content)))[0]
    assert condensed.startswith("[2 imports]\n\nfn f0") and "note" not in condensed


def test_error_runs_and_collapse(spark):
    text = "\n".join(["start of the log here", "error: one", "error: two", "warning: three", "", "", *["test a ... ok"] * 4, *[f"   Compiling dep{i}" for i in range(5)], *[f"tail {i} of a long line" for i in range(8)]])
    got = one(runs.compress_output(docs(spark, text)))[0]
    assert got.split("\n")[1:5] == ["error: one", "  [error: 2 additional lines]", "", "[4 ok]"] and "[5 Compiling ...] (5 lines)" in got
    rows = explode_lines(docs(spark, "a\n\n\nb\nok\nok\nok"), "doc_id", "text")
    assert [r.line for r in runs.gate_runs(rows, "doc_id").orderBy("line_no").collect()] == ["a", "", "", "b", "[3 ok]"]


def test_function_end(spark):
    rows = explode_lines(docs(spark, "fn a() {\n  x\n\n  y\n# c\n}\nz"), "doc_id", "text")
    starts = spark.createDataFrame([(0, 1, 0)], "doc_id long, start int, indent int")
    assert runs.function_ends(rows, starts, "doc_id").first()["end"] == 3


def test_srcr(spark):
    rows = spark.createDataFrame([("alpha beta gamma delta " * 4, "alpha beta"), ("short", "s"), ("x" * 60, "y" * 70)], "a string, b string")
    got = [r[0] for r in rows.select(quality.srcr(F.col("a"), F.col("b"))).collect()]
    assert got[0].preservation == 0.5 and abs(got[0].srcr - 0.5 * (1 - 10 / 92)) < 1e-9 and tuple(got[1]) == (0, 1, 0) and tuple(got[2]) == (0, 1, 0)


def test_reasoning(spark):
    verbose = "Let me check this first. I will need to look. In order to see it we go. " * 4 + "done"
    rows = spark.createDataFrame([(verbose,), ("Let me check.",), (verbose + "```",), ("Something is here and stays. " * 10,)], "t string")
    got = [r[0] for r in rows.select(compress.compress_reasoning(F.col("t"))).collect()]
    assert got[0] == "done" and got[1] is None and got[2] is None and got[3] is None
    fenced = spark.createDataFrame([(1, verbose + "\n```\ncode();\n```\n" + verbose)], "k int, text string")
    assert compress.compress_reply(fenced, ("k",)).first().text == "done\n```\ncode();\ndone\n"


def test_bodies(spark):
    said = "Let me check this first. I will need to look. " * 12 + 'a "quoted" end'
    bodies = spark.createDataFrame([(1, json.dumps({"choices": [{"message": {"content": said}}]})), (2, json.dumps({"choices": []})), (3, "no json " * 100)], "id int, body string")
    got = compress.compress_bodies(bodies).collect()
    assert len(got) == 1 and json.loads(got[0].body)["choices"][0]["message"]["content"] == 'a "quoted" end'


def test_json_and_state(spark):
    rows = [{"kind": "file", "size": i, "note": "n" * 40, "nul": None} for i in range(12)]
    text = json.dumps(rows)
    got = spark.createDataFrame([(text,), (json.dumps([{"a": i, "b": -i} for i in range(60)]),)], "t string").select(compress.hoist_invariants(F.col("t"))).collect()
    assert got[0][0].startswith(f"[S] kind=file,note={'n' * 40},nul=null\n1:size=0\n") and got[1][0] is None
    state = "Goal: fix merge\nproblem: E0308 here\nran `cargo test` twice\nresult: 3 failed\nnext: look at x; then\n" + "pad " * 50
    got = spark.createDataFrame([(state,), ("no state here\n" * 30,)], "t string").select(compress.dialogue_state(F.col("t"))).collect()
    assert got[0][0] == "[STATE] goal=fix merge | blocker=E0308 here | command=ran `cargo test` twice | result=3 failed | next=look at x" and got[1][0] is None


def test_conversation_rules(spark):
    schema = "conv_id long, turn long, role string, text string, tool_call_id string, tool_calls array<struct<id:string,name:string,arguments:string>>"
    call = lambda *ids: [(i, "f", "{}") for i in ids]
    rows = spark.createDataFrame([
        (1, 0, "user", "hi", None, []), (1, 1, "assistant", "", None, call("a")), (1, 2, "tool", "r", "a", []), (1, 3, "assistant", "", None, call("a", "b")),
        (1, 4, "tool", "r", "a", []), (1, 5, "tool", "r", "b", []), (1, 6, "assistant", "", None, []), (1, 7, "assistant", "", None, [])], schema)
    kept = convo.drop_reused_calls(rows)
    assert sorted(r.turn for r in kept.collect()) == [0, 1, 2, 3, 5, 6, 7]
    assert [c.id for c in kept.filter("turn = 3").first().tool_calls] == ["b"]
    assert sorted(r.turn for r in convo.drop_empty_replies(kept).collect()) == [0, 1, 2, 3, 5, 7]
    again = spark.createDataFrame([(1, 0, "user", "x"), (1, 1, "user", "x"), (1, 2, "tool", "x"), (1, 3, "tool", "x"), (1, 4, "user", "")], "conv_id long, turn long, role string, text string")
    assert sorted(r.turn for r in convo.drop_repeats(again).collect()) == [0, 2, 3, 4]


def test_index_and_guard(spark):
    found = index.postings(docs(spark, "fn running() {}\nuse it", "running here", "nothing"))
    assert {r.phrase for r in found.filter("doc_id = 0").collect()} == {"runn", "use"} and found.filter("phrase = 'runn' and doc_id = 0").first().is_def == 1
    stats = index.doc_stats(docs(spark, "fn running() {}\nuse it", "running here", "nothing"), found)
    assert [r.doc_id for r in index.search(found, stats, "runn", 5).collect()] == [0, 1]
    assert index.search(found, stats, "ru", 5).count() == 0 and index.search(found, stats, 'runn" OR x', 5).count() == 2
    assert [r.doc_id for r in index.references(found, "Running", 0).collect()] == [1]
    names = spark.createDataFrame([("running",), ("runn",), ("vec",), ("zzz",)], "name string")
    assert {r.name for r in guard.unknown_names(names, found).collect()} == {"running", "zzz"}
    talk = spark.createDataFrame([(1, 0, "see src/a.rs for merge_rows and src/a.rs"), (1, 1, "nothing")], "conv_id long, turn long, text string")
    bad = spark.createDataFrame([("src/a.rs", "merge_rows")], "file string, identifier string")
    assert guard.annotate(talk, bad).first().text == "see src/a.rs /* -merge_rows/**/ for merge_rows and src/a.rs"


def test_code(spark):
    text = "fn used() {}\nfn lonely_one() {}\nused()\nconst MAX_SIZE = 1"
    got = {r.name: r.confidence for r in code.dead_names(docs(spark, text)).collect()}
    assert got["lonely_one"] == "medium" and got["MAX_SIZE"] == "high" and "used" not in got
    named = spark.createDataFrame([(0, text, "a_test.rs")], "doc_id long, text string, file string")
    assert {r.confidence for r in code.dead_names(named, file="file").collect()} == {"low"}
    big = "\n".join(["pub fn x() {}"] * 50 + ["// TODO"] * 20 + ["line"] * 200)
    assert [r.risk for r in code.file_risk(docs(spark, "fn a() {}\n// test", big, "")).orderBy("doc_id").collect()] == ["low", "high", "low"]
    notes = spark.createDataFrame([("'old' → 'new'",), ("change 'a' to 'b'",), ("s/x/y/",)], "n string")
    assert [[(f.old, f.new) for f in r[0]][0] for r in notes.select(code.extract_fixes(F.col("n"))).collect()] == [("old", "new"), ("a", "b"), ("x", "y")]


def test_events(spark):
    rows = spark.createDataFrame([("f", "parse", False)] * 3 + [("f", "parse", True)] * 2 + [("f", "unwrap", False)] * 2, "file string, identifier string, success boolean")
    got = {r.identifier: (r.risk, r.fails) for r in events.failure_risk(rows, ("file",)).collect()}
    assert got == {"parse": (0.6, 3), "unwrap": (1.0, 3)}
    turns = spark.createDataFrame([("k", i, h, 100) for i, h in enumerate([10, 20, 30, 85, 85, 85, 85, 85])], "k string, seq int, hit int, total int")
    assert [r.paused for r in events.feedback(turns, "k", ("seq",)).orderBy("seq").collect()] == [True, True, True, True, True, True, True, False]


def test_memory(spark):
    rows = spark.createDataFrame([(1, "alpha beta"), (2, "gamma delta"), (3, "")], "item_id long, text string")
    assert memory.recall(rows, "alpha beta", 1).first().item_id == 1
    pairs = memory.cooccurrence(rows, "item_id", "text")
    assert [(r.a, r.b, r.n) for r in pairs.orderBy("a").collect()] == [("alpha", "beta", 1), ("gamma", "delta", 1)]
    assert [(r.token, r.n) for r in memory.predict(pairs, "beta", 5).collect()] == [("alpha", 1)]


def event(role, **more):
    return json.dumps({"type": "message", "message": {"role": role, **more}})


def call(ident, name, **args):
    return event("assistant", content=[{"type": "toolCall", "id": ident, "name": name, "arguments": args}])


def answer(ident, name, text):
    return event("toolResult", toolCallId=ident, toolName=name, content=[{"type": "text", "text": text}])


def test_session(spark):
    log = [event("user")] * 3 + ["no json", call("1", "read", path="src/a.rs"), answer("1", "read", "été"), call("2", "read", path="src/a.rs"), answer("2", "read", "été"),
           call("3", "edit", file="a.rs", edits=[{"oldText": "x\ny", "newText": "z"}]), answer("3", "edit", "done"), answer("3", "edit", "again"),
           call("4", "bash", command="cargo test"), answer("4", "bash", "test a FAILED\nx"), event("user"), call("5", "bash", command="cargo test"), answer("5", "bash", "test result: ok")]
    lines = spark.createDataFrame([("s", i, v) for i, v in enumerate(log)], "session string, seq int, value string")
    state = session.states(lines)
    r = state.first()
    assert (r.turns, [(x.size, x.is_rerun) for x in r.reads], [(e.line, e.attempt, e.success) for e in r.edits], [(e.turn, e.summary) for e in r.errors], r.last_pass) == (
        4, [(5, False), (5, True)], [("x", 1, True)], [(3, "test a FAILED")], True)
    block = session.state_block(state).first().block
    assert block == '[state]\nturn: 4\nreads: a.rs(5b)[re-read]\ntests: PASS — test result: ok\nedits: L1 "…x\ny…"→"…z…"✓\nerror[t3]: test a FAILED\nsession: 4 turns, 1 files read (1 re-reads), 1 edits\n'


def test_calls(spark):
    schema = "k int, expected array<struct<name:string,arguments:string>>, predicted array<struct<name:string,arguments:string>>"
    rows = spark.createDataFrame([(1, [("f", '{"a": 1}')], [("f", '{"a": 1.0, "b": 2}')]), (2, [("f", "{}")], []), (3, [], []), (4, [("f", "{}"), ("g", "{}")], [("g", "{}")])], schema)
    assert {r.k: round(r.f1, 3) for r in quality.call_matches(rows, "k").collect()} == {1: 1.0, 2: 0.0, 3: 1.0, 4: 0.667}


def test_folders(spark, tmp_path):
    for name, data in (("a.rs", b"fn a() {}"), (".hidden/b.rs", b"x"), ("target/c.rs", b"x"), ("d.bin", b"x"), ("e.py", b"\xff\xfe"), ("sub/f.md", "é".encode())):
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_bytes(data)
    got = files.read_folder(spark, str(tmp_path))
    assert {r.path.rsplit("/", 1)[1]: r.text for r in got.collect()} == {"a.rs": "fn a() {}", "f.md": "é"}
    files.append_events(spark.createDataFrame([("edit", "a"), ("veto", "b")], "event string, file string"), str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).filter("event = 'veto'").count() == 1
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "c")], "k int, v string")
    assert sorted(r.v for r in files.upsert(old, new, ("k",)).collect()) == ["a", "c"]


def test_table_functions(spark):
    udtf.register(spark)
    assert [r.line for r in spark.sql("select * from split_lines('a\\nb\\n') order by line_no").collect()] == ["a", "b"]
    assert [r.identifier for r in spark.sql("select * from scan_identifiers('Foo bar2 x') order by place").collect()] == ["foo", "bar2"]


def test_log_files_and_their_tail(spark, tmp_path):
    lines = ['{"event": "stream_usage", "prompt_tokens": 5, "timestamp": 1}', "no json", '{"event": "other"}', '{"event": "proxy_response", "savings_pct": 1.5}']
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "a.jsonl").write_text("\n".join(lines))
    want = [("proxy_response", None, 1.5), ("stream_usage", 5, None)]
    rows = lambda d: sorted((r.event, r.prompt_tokens, r.savings_pct) for r in d.collect())
    assert rows(files.read_log(spark, str(tmp_path / "log"))) == want
    assert rows(stateful.run(files.tail_log(spark, str(tmp_path / "log")))) == want


def test_sets_of_questions_and_calls(spark, tmp_path):
    questions = [{"context": f"c{i}", "question": f"q{i}", "answers": {"text": [f"a{i}", "x"] if i % 3 else []}} for i in range(12)]
    (tmp_path / "q.json").write_text("\n".join(map(json.dumps, questions)))
    got = files.read_questions(spark, str(tmp_path / "q.json"), 6).collect()
    assert sorted((r.context, r.expected, r.unanswerable) for r in got) == sorted(
        [("c1", "a1", False), ("c2", "a2", False), ("c4", "a4", False), ("c0", None, True), ("c3", None, True), ("c6", None, True)])
    reply = 'So: <tool_call>\n{"name": "f", "arguments": {"x": 1}}\n</tool_call> <tool_call>{"name": "g"}</tool_call>'
    talk = lambda *turns: [{"from": a, "value": b} for a, b in turns]
    samples = [{"tools": "[{}]", "conversations": talk(("system", "s"), ("human", "ask"), ("gpt", reply), ("gpt", "no"))},
               {"tools": "[]", "conversations": talk(("human", "ask"), ("gpt", reply))}, {"tools": "[{}]", "conversations": talk(("human", "ask"), ("gpt", "no call"))},
               {"tools": "[{}]", "conversations": talk(("gpt", reply))}]
    (tmp_path / "c.json").write_text("\n".join(map(json.dumps, samples)))
    got = files.read_calls(spark, str(tmp_path / "c.json")).collect()
    assert [(r["query"], [(c.name, c.arguments) for c in r.expected]) for r in got] == [("ask", [("f", '{"x":1}'), ("g", None)])]


def test_memories_are_numbered_by_time(spark, tmp_path):
    rows = spark.createDataFrame([((i * 37) % 100, f"m{i}", 7) for i in range(100)], "ts long, content string, id long").repartition(5)
    files.replace_memories(rows, str(tmp_path / "m"))
    got = files.read_memories(spark, str(tmp_path / "m")).orderBy("id").collect()
    assert [r.id for r in got] == list(range(1, 101)) and [r.ts for r in got] == list(range(100)) and got[0].error_flag == 0


def test_written_indexes_and_lines(spark, tmp_path):
    posts = spark.createDataFrame([(i, f"p{i % 7}") for i in range(50)], "doc_id long, phrase string")
    files.write_index(posts, str(tmp_path / "i"), 3)
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "i")).collect())) == sorted(map(tuple, posts.collect()))
    files.write_jsonl(posts.coalesce(1), str(tmp_path / "l"), 20)
    parts = sorted(len(p.read_text().splitlines()) for p in (tmp_path / "l").glob("*.json"))
    assert parts == [10, 20, 20]


def test_small_functions(spark):
    row = spark.range(1).select(
        files.rendered(F.array(F.lit("a"), F.lit("b")), "Names").alias("a"), files.rendered(F.array().cast("array<string>"), "Names").alias("b"),
        files.rendered(F.array(F.lit("a")), "x", "json").alias("c"), files.rendered(F.array(F.lit("a"), F.lit("b")), "x", "compact").alias("d"),
        files.fits(F.lit("\u00e9"), 2).alias("e"), files.fits(F.lit("\u00e9"), 1).alias("f"),
        T.signature_name(F.lit("  pub fn name_1(x) {")).alias("g"), T.signature_name(F.lit("no")).alias("h"),
        (T.change_key(F.lit("a"), F.lit("x"))["content_hash"] == T.change_key(F.lit("b"), F.lit("x"))["content_hash"]).alias("i"),
        (T.change_key(F.lit("a"), F.lit("x"))["file_hash"] == T.change_key(F.lit("b"), F.lit("x"))["file_hash"]).alias("j"),
        T.djb2(F.lit("")).cast("string").alias("k"), T.djb2(F.lit("\u00e9" * 40)).cast("string").alias("l"), T.djb2(F.lit(None).cast("string")).alias("m")).first()
    h = 5381
    for b in ("\u00e9" * 40).encode():
        h = (h * 33 + b) % 2**64
    assert tuple(row) == ("Names:\n  a\n  b", "Names: (none)", '["a"]', "a\nb", True, False, "name_1", "", True, False, "0", str(h), None)


def test_maintenance_waits_longer_after_slow_rounds():
    took, now, waited = iter([10, 61, 100, 100, 100, 100, 100, 5, 1]), [0.0], []
    stateful.rounds_of(lambda: now.__setitem__(0, now[0] + next(took)), 9, waited.append, lambda: now[0])
    assert waited == [120, 120, 240, 480, 960, 1800, 1800, 1800, 120]


def test_a_stream_without_a_reason_is_ended(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, "half", False), ("a", 2, "done", True), ("b", 1, 'x"finish_reason":"sto', False), ("b", 2, 'p"', True), ("c", 1, "open", False)],
                                 "stream string, seq long, chunk string, last boolean")
    rows.write.parquet(str(tmp_path / "s"))
    found = stateful.run(stateful.finished_streams(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "s")))).collect()
    assert {r.stream: (r.finished, r.terminator) for r in found} == {"a": (False, stateful.TERMINATOR), "b": (True, None)}


def test_folds_of_odd_tables(spark):
    rows = spark.createDataFrame([(None, 1, 5), ("a", 1, 1), ("a", 1, 1), ("a", 3, 2), (None, 0, 7)], "k string, i int, v int")
    total = lambda d: sorted(((r.k, r.i, r.s) for r in folds.ordered_fold(d, "k", ("i",), ("v",), "s int", lambda: 0, lambda s, v: (s + v, (s + v,))).collect()), key=repr)
    assert total(rows) == sorted([(None, 0, 7), (None, 1, 12), ("a", 1, 1), ("a", 1, 2), ("a", 3, 4)], key=repr)
    assert total(rows.filter("false")) == []


def test_of_several_versions_the_newest_is_indexed(spark, tmp_path):
    build = lambda d: d.select("doc_id", F.explode(F.split("text", " ")).alias("phrase"))
    schema = "doc_id long, text string, at long"
    for n, batch in enumerate(([(1, "old words", 1), (1, "new words", 2), (2, "two", 1)], [(2, "three", 5), (2, "stale", 4)])):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "docs"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "docs"))
        found = stateful.maintain_index(stream, str(tmp_path / "index"), build, order="at")
        want = [[(1, "new"), (1, "words"), (2, "two")], [(1, "new"), (1, "words"), (2, "three")]][n]
        assert sorted((r.doc_id, r.phrase) for r in found.collect()) == want


def test_streamed_means_at_a_limit_are_those_of_the_batch(spark, tmp_path):
    hits = [18.0] * 4 + [0.0, 0.0, 5.0, 16.0, 6.0, 18.0]  # the last means but one: 0.3, as sums from the left have it a little less
    rows = spark.createDataFrame([(1, i, h, 18.0) for i, h in enumerate(hits)], "k long, seq long, hit double, total double")
    rows.write.parquet(str(tmp_path / "s"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "s"))
    got = [r.paused for r in stateful.run(stateful.feedback(stream, "k", "seq")).orderBy("seq").collect()]
    assert got == [r.paused for r in events.feedback(rows, "k", ("seq",)).orderBy("seq").collect()] == [False] * 8 + [True] * 2


def test_pulls_of_a_long_log_cost_its_different_pairs(spark, monkeypatch):
    rows = spark.range(2000).select(F.concat(F.lit("t"), (F.col("id") % 4).cast("string")).alias("a"), F.concat(F.lit("t"), (F.col("id") % 5).cast("string")).alias("b"), F.col("id").alias("seq"))
    sizes, keep = [], memory.kept
    monkeypatch.setattr(memory, "kept", lambda d: (out := keep(d), sizes.append(out.count()))[0])
    got = {r.token: list(r.vector) for r in memory.hebbian(rows, dimensions=8).collect()}
    vector = {r.t: list(r.v) for r in spark.createDataFrame([(f"t{i}",) for i in range(5)], "t string").select("t", memory.token_vector(F.col("t"), 8).alias("v")).collect()}
    for a, b in ((f"t{i % 4}", f"t{i % 5}") for i in range(2000)):
        vector[a] = [int(x + 0.1 * y) for x, y in zip(vector[a], vector[b], strict=True)]
    assert got == vector and max(sizes) <= 20 * 8


def plain_pulls(spark, pairs, dimensions):
    """Vectors after pulls one by one."""
    tokens = spark.createDataFrame([(t,) for t in {t for p in pairs for t in p}], "t string")
    vector = {r.t: list(r.v) for r in tokens.select("t", memory.token_vector(F.col("t"), dimensions).alias("v")).collect()}
    for a, b in pairs:
        vector[a] = [int(x + 0.1 * y) for x, y in zip(vector[a], vector[b], strict=True)]
    return vector


def test_each_user_is_pulled_under_its_own_name(spark, tmp_path):
    users = [3, 53, 103, 1003, 3, 49, 50, 99, 100, 53, 7, 57, 3]
    spark.createDataFrame([(i, u, f"kind{i % 3}") for i, u in enumerate(users)], "event_id long, user_id long, event_type string").write.parquet(str(tmp_path / "events.parquet"))
    want = plain_pulls(spark, [p for i, u in enumerate(users) for p in ((f"kind{i % 3}", f"user{u}"), (f"user{u}", f"kind{i % 3}"))], memory.DIMENSIONS)
    got = history.pulled_vectors(spark, str(tmp_path)).collect()
    assert len(got) == len(set(users)) + 3 and {r.token: list(r.vector) for r in got} == want


@pytest.mark.parametrize("block", [1, 16, 4096])
def test_pulls_in_blocks_are_those_one_by_one(spark, block):
    names = [None, *(f"w{i}" for i in range(25))]
    pairs = [(names[i * i % 26], names[(i * 7 + i // 26) % 26]) for i in range(400)]
    rows = spark.createDataFrame([(a, b, 3 * i - 50) for i, (a, b) in enumerate(pairs)], "a string, b string, seq long")
    got = memory.hebbian(rows, dimensions=40, block=block).collect()
    want = plain_pulls(spark, pairs, 40)
    assert len(got) == len(want) and {r.token: list(r.vector) for r in got} == want
    assert memory.hebbian(rows.limit(0), dimensions=40, block=block).collect() == []


def test_pairs_with_a_few_tokens_are_those_of_all_pairs(spark):
    texts = docs(spark, "and the cat and the dog", "the the tion", "of no use, no pairs here at all", "the", None, "", "tion " * 3 + "and ünder the")
    few = memory.asked_tokens(spark, "the, and the tion")
    assert few == ["the", "and", "the", "tion"]
    every = memory.cooccurrence(texts, "doc_id", "text")
    rows = lambda d: sorted(map(tuple, d.collect()))
    pairs = memory.cooccurrence_with(texts, "text", few)
    assert rows(pairs) == rows(every.filter(F.col("a").isin(few) | F.col("b").isin(few)))
    assert rows(memory.predict(pairs, "the, and the tion", 20)) == rows(memory.predict(every, "the, and the tion", 20))
    assert "Window" not in pairs._jdf.queryExecution().optimizedPlan().toString()


def test_stems_are_made_once_a_word(spark):
    rows = docs(spark, "Running  tests_2 of ab ünder 9lives x", "plainness; classes\nmovies Übung naïve", "1abc " + "z" * 41, "", None)
    plan = rows.select(T.stem(F.col("text")).alias("s"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") == 1
    want = [(r.doc_id, w) for r in rows.select("doc_id", T.stems(F.col("text")).alias("s")).collect() for w in r.s]
    assert sorted(map(tuple, explode_stems(rows, "text", "doc_id").collect())) == sorted(want) and (0, "runn") in want
    assert all(r.a == r.b for r in rows.select(T.first_identifier(F.col("text")).alias("a"), F.get(T.identifiers(F.col("text")), F.lit(0)).alias("b")).collect())


def test_postings_are_made_once_for_validated_reads(spark):
    posts = index.postings(docs(spark, "parser parses", "parser", "lexer parser"))
    found = guard.validated(spark.createDataFrame([(0, "parser")], "doc_id long, phrase string"), posts, keep=lambda p: F.length(p) > 3)
    assert "Generate" not in found._jdf.queryExecution().optimizedPlan().toString()
