"""Every registered query with SQL against DuckDB; the others against the same rules in Python."""

import json
import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from linewright.functions import skeleton, text
from linewright.operators import compress, memory
from linewright.plans import catalogue, conversations, facts, history, sifting

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def base(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    return c


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (int, float)) or hasattr(v, "dtype"):
        return None if math.isnan(float(v)) else round(float(v), 6)
    return None if str(v) in ("NaT", "None") else str(v)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_twin(spark, sf, base, name):
    got, want = catalogue.QUERIES[name](spark, sf).toPandas(), base.execute(catalogue.ORACLES[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = lambda d: sorted((tuple(map(plain, r)) for r in d[columns].itertuples(index=False)), key=repr)
    assert rows(got) == rows(want)


PLAIN = set(catalogue.QUERIES) - set(catalogue.ORACLES)


def test_every_query_without_sql_has_a_plain_twin():
    assert set(PLAIN_TWINS) == PLAIN


def plain_prose(text):
    for p in compress.PHRASES:
        text = re.sub("(?i)" + p, " ", text)
    return " ".join(text.split())


def plain_reasoning(text):
    made, size = plain_prose(text), len(text.encode())
    return made if size >= 200 and not any(m in text for m in compress.CODE_MARKS) and len(made.encode()) < size * 0.6 else None


def replies(base):
    rows = base.execute("select conv_id, turn, text from conversations where role = 'assistant'").fetchall()
    return {(c, t): text for c, t, text in rows}


def test_reasoning_phrases_of_whole_replies(spark, sf, base):
    want = {}
    for (c, t), text in replies(base).items():
        whole = conversations.OPENERS[t % 3] * 8 + "That is " + text
        want[c, t] = (plain_prose(whole), plain_reasoning(whole))
    got = {(r.conv_id, r.turn): (r.kept, r.text) for r in catalogue.QUERIES["reasoning_phrases"](spark, sf).collect()}
    assert got == want


def test_response_bodies_of_whole_replies(spark, sf, base):
    want = {}
    for (c, t), text in replies(base).items():
        said = "Let me check this first. I will need to look. " * 12 + text
        lines = re.sub(r"\r?\n", "\n", said).removesuffix("\n") + "\n"
        assert "```" not in said
        short, piece = plain_reasoning(said), plain_reasoning(lines)
        if short is not None or piece is not None:
            want[f"{c}-{t}"] = short if short is not None else piece + "\n"
    got = {r.id: json.loads(r.body)["choices"][0]["message"]["content"] for r in catalogue.QUERIES["response_bodies"](spark, sf).collect()}
    assert want and got == want


# Plain twins: the same rules in Python, over the same rows.


def texts_of(base, table="documents", key="doc_id"):
    return base.execute(f"select {key}, text from {table}").fetchall()


def plain_lines(text):
    if not text:
        return []
    return [x.removesuffix("\r") for x in re.sub(r"\n\Z", "", text).split("\n")]


def plain_filled(line, rules):
    pattern = re.compile("|".join(f"({p})" for p, _ in rules))

    def name(m):
        found = rules[m.lastindex - 1][1]
        return m[0] if found is None else found

    return re.sub(r"\s+", " ", pattern.sub(name, line.strip())).strip().lower()


def twin_skeletons(spark, sf, base, name):
    want = {(d, i): (plain_filled(x, skeleton.VALUES), plain_filled(x, skeleton.TEMPLATE)) for d, t in texts_of(base) for i, x in enumerate(plain_lines(t))}
    got = {(r.doc_id, r.line_no): (r.skeleton, r.template) for r in catalogue.QUERIES[name](spark, sf).collect()}
    assert got == want


def plain_output(line):
    for pattern, put in ((r"(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}", "{uuid}"), (r"(?i)\b[0-9a-f]{7,40}\b", "{hash}"),
                         (r"\b\d+\.\d+(?:\.\d+(?:-\w+(?:\.\d+)?)?)?\b", "{ver}"), (r"\d{2}:\d{2}:\d{2}(?:[.,]\d{3,})?", "{time}"),
                         (r"^\s*(?:Compiling|Checking|Building|Linking|Running|Processing|Generating)\s", "{progress}"), (r"\b\d+\b", "{n}")):
        line = re.sub(pattern, put, line)
    return line


def twin_output_skeletons(spark, sf, base, name):
    want = {(d, i): plain_output(x) for d, t in texts_of(base) for i, x in enumerate(plain_lines(t))}
    got = {(r.doc_id, r.line_no): r[2] for r in catalogue.QUERIES[name](spark, sf).collect()}
    assert got == want


def plain_rows(spark, sf):
    """Classified lines of each text, as the grouping reads them."""
    rows = {}
    for r in sifting.rows(spark, sf).orderBy("doc_id", "line_no").collect():
        rows.setdefault(r.doc_id, []).append(r)
    return rows


def noise(r):
    t = r.line.strip()
    return not r.is_error and (t == "" or r.is_separator or r.is_progress or len(t.encode()) <= 2)


def leading(spark, lines):
    """The leading token is a function of its own, tested against SQL: here it is looked up."""
    rows = spark.createDataFrame([(x,) for x in sorted(lines)], "line string")
    return {r.line: r.p for r in rows.select("line", text.leading_token(F.col("line")).alias("p")).collect()}


def plain_groups(rows, key, prefix):
    """(first, sample, n, is_error, prefixes) of neighbours with one key; key of None stands alone."""
    out = []
    for r in rows:
        k = key(r)
        if out and out[-1][0] == k:
            out[-1][1].append(r)
        else:
            out.append((k, [r]))
    return [(g[0].line_no, g[0].line, len(g), g[0].is_error, list(dict.fromkeys(p for p in (prefix(x) for x in g) if p is not None))) for _, g in out]


def groups_of(spark, sf, name):
    rows = plain_rows(spark, sf)
    first = leading(spark, {r.line for rs in rows.values() for r in rs})
    out = {}
    for d, rs in rows.items():
        if name == "template_groups":
            held = {}
            for r in rs:
                alone = r.is_error or r.is_progress or not r.line.strip()
                held.setdefault(("alone", r.line_no) if alone else plain_filled(r.line, skeleton.TEMPLATE), []).append(r)
            out[d] = sorted((g[0].line_no, g[0].line, len(g), g[0].is_error, []) for g in held.values())
        else:
            key = (lambda r: r.skeleton) if name == "skeleton_groups" else (lambda r: (first[r.line], r.skeleton))
            out[d] = plain_groups([r for r in rs if not noise(r)], key, lambda r: first[r.line])
    return {d: g for d, g in out.items() if g}


def twin_groups(spark, sf, base, name):
    got = {}
    for r in catalogue.QUERIES[name](spark, sf).collect():
        got.setdefault(r.doc_id, []).append((r["first"], r.sample, r.n, r.is_error, r.prefixes.split(",") if r.prefixes else []))
    want = groups_of(spark, sf, name)
    assert {d: sorted(g) for d, g in got.items()} == {d: sorted(g) for d, g in want.items()}


def twin_good_counts(spark, sf, base, name):
    """No line of the table is good or timed, so the groups stay as they are; made ones are tested with the operators."""
    want = sorted((d, f, s, n, ",".join(p)) for d, g in groups_of(spark, sf, "skeleton_groups").items() for f, s, n, _, p in g)
    assert sorted((r.doc_id, r["first"], r.sample, r.n, r.prefixes) for r in catalogue.QUERIES[name](spark, sf).collect()) == want


def plain_strategy(lines, first):
    full = [x for x in lines if x.strip()]
    if full and full[0].strip()[0] in "{[":
        return "json"
    if any(x.strip().startswith("@@ -") and " +" in x and x.strip().endswith("@@") for x in lines):
        return "diff"
    data = [x for x in full if not re.fullmatch(r"[-=._*]+", x.strip())]
    if len(data) >= 4:
        wide = [sum(len(x) > i and x[i] == " " for x in data) >= int(len(data) * 0.9) for i in range(max(map(len, data)))]
        if sum(w and (i == 0 or not wide[i - 1]) for i, w in enumerate(wide)) >= 2:
            return "tabular"
    tokens = [p for p in (first[x] for x in lines) if p is not None]
    top = max((tokens.count(p) for p in set(tokens)), default=0)
    return "prefixed" if len(tokens) >= 5 and top / len(tokens) > 0.5 else "normal"


def twin_strategies(spark, sf, base, name):
    texts = {d: plain_lines(t) for d, t in texts_of(base) if t}
    first = leading(spark, {x for ls in texts.values() for x in ls})
    assert {r.doc_id: r.strategy for r in catalogue.QUERIES[name](spark, sf).collect()} == {d: plain_strategy(ls, first) for d, ls in texts.items()}


def twin_concentration(spark, sf, base, name):
    want = {}
    for d, t in texts_of(base):
        full = [x for x in plain_lines(t) if x.strip()]
        held = {}
        for x in full:
            held.setdefault(plain_filled(x, skeleton.TEMPLATE), []).append(len(x.encode()))
        if held:
            k, _, sizes = max((len(s), t, s) for t, s in held.items())
            dense = len(full) >= 5 and k * 5 >= len(full) * 4 and min(sizes) > 0 and min(sizes) * 10 >= max(sizes) * 7
            want[d] = (round(k / len(full), 9), dense)
    assert {r.doc_id: (round(r.share, 9), r.aggressive) for r in catalogue.QUERIES[name](spark, sf).collect()} == want


def twin_maxwell(spark, sf, base, name):
    want = {}
    for d, t in texts_of(base):
        data, words = (t or "").encode(), (t or "").split()
        entropy = -sum(n / len(data) * math.log2(n / len(data)) for n in Counter(data).values()) if data else 0.0
        passes = entropy >= 3.5 and len(data) / len(zlib.compress(data, 1)) <= 3.0 and len(set(words)) / max(1, len(words)) >= 0.25
        want[d] = 1.0 if len(data) < 50 else round(min(entropy, 8) / 8, 6) if passes else None
    got = {r.doc_id: None if r.score is None else round(r.score, 6) for r in catalogue.QUERIES[name](spark, sf).collect()}
    assert got == want


def plain_vector(spark, tokens):
    rows = spark.createDataFrame([(t,) for t in sorted(tokens)], "t string")
    return {r.t: r.v for r in rows.select("t", memory.token_vector(F.col("t")).alias("v")).collect()}


def plain_tokens(t):
    return [w.lower() for w in re.split(r"[^\w]+", t or "") if len(w.encode()) >= 3 and any(c.isalpha() for c in w)]


def twin_recall(spark, sf, base, name):
    texts = {d: plain_tokens(t) for d, t in texts_of(base) if t is not None}
    asked = plain_tokens("the tion and")
    vector = plain_vector(spark, {w for ws in (*texts.values(), asked) for w in ws})
    summed = lambda ws: np.sum([vector[w] for w in ws], axis=0) if ws else np.zeros(memory.DIMENSIONS)
    q, scores = summed(asked), {}
    for d, ws in texts.items():
        v = summed(ws)
        norm = np.linalg.norm(v) * np.linalg.norm(q)
        scores[d] = float(v @ q / norm) if norm else 0.0
    got = [(r.doc_id, r.score) for r in catalogue.QUERIES[name](spark, sf).collect()]
    best = sorted(scores.values(), reverse=True)[:5]
    assert len(got) == 5 and all(abs(s - scores[d]) < 2e-6 and abs(s - b) < 2e-6 for (d, s), b in zip(got, best, strict=True))


def pulled(vector, pairs):
    for a, b in pairs:
        for i in range(memory.DIMENSIONS):
            vector[a][i] = int(vector[a][i] + 0.1 * vector[b][i])
            vector[b][i] = int(vector[b][i] + 0.1 * vector[a][i])
    return vector


def twin_pulled(spark, sf, base, name):
    rows = base.execute("select event_type, 'user' || user_id from events order by event_id").fetchall()
    pairs = [p for a, b in rows for p in ((a, b), (b, a))]
    want = pulled({t: list(v) for t, v in plain_vector(spark, {x for p in pairs for x in p}).items()}, pairs)
    assert {r.token: list(r.vector) for r in catalogue.QUERIES[name](spark, sf).collect()} == want


def twin_safety(spark, sf, base, name):
    """Level and redirects by the rule, user by user."""
    rows, want = {}, {}
    for r in history.safety_log(spark, sf).collect():
        rows.setdefault(r.session, []).append(r)
    for user, log in rows.items():
        level = until = sent = 0
        seen = Counter()
        for r in sorted(log, key=lambda r: r.seq):
            if level and until <= r.turn:
                level = 0
            turned = False
            if r.kind == "edit":
                del seen[r.path]
            elif r.kind == "read":
                seen[r.path] += 1
                if seen[r.path] >= 3 and level < 2:
                    level, until = 2, r.turn + 10
            elif level == 2:
                sent += 1
                turned = sent < 5
                level = level if turned else 1
            want[user, r.seq] = (level, turned)
    got = {(r.session, r.seq): (r.level, r.redirected) for r in catalogue.QUERIES[name](spark, sf).collect()}
    assert got == want and {x[0] for x in want.values()} >= {0, 2}


def lossless(spark, sf, base, name):
    """Each result is its text or shorter, is made of the text's own lines but for marks in brackets, and small texts stay."""
    texts = dict(texts_of(base))
    rows = catalogue.QUERIES[name](spark, sf).collect()
    assert {r.doc_id for r in rows} == ({d for d, t in texts.items() if t} if name == "format_output" else set(texts))
    for r in rows:
        whole = texts[r.doc_id] or ""
        if name == "tool_results":
            assert len(r.text.encode()) <= len(whole.encode()) and (len(whole.encode()) >= 200 or r.text == whole)
        own = set(re.findall(r"\S+", whole))
        loose = [w for x in r.text.split("\n") if not re.search(r"\[[^\]]*\]", x) for w in x.replace("┃", " ").split()]
        assert set(loose) <= own


def plain_reply(said):
    """Prose between fences piece by piece; a code piece keeps its opening fence and loses its closing one."""
    whole = plain_reasoning(said)
    if whole is not None:
        return whole
    parts, fences = [[]], 0
    for x in plain_lines(said):
        if x.lstrip().startswith("```"):
            fences += 1
            parts.append([x] if fences % 2 else [])
        else:
            parts[-1].append(x)
    out, saved = [], 0
    for body in ("\n".join(p) + "\n" for p in parts if p):
        short = plain_reasoning(body) if "```" not in body and len(body.encode()) >= 50 else None
        out.append(body if short is None else short + "\n")
        saved += 0 if short is None else len(body.encode()) - len(short.encode())
    return "".join(out) if saved > 0 else None


def twin_replies(spark, sf, base, name):
    want = {k: plain_reply("Let me check this first. I will need to look. " * 6 + "\n```\ncode here\n```\n" + t) for k, t in replies(base).items()}
    want = {k: v for k, v in want.items() if v is not None}
    assert want and {(r.conv_id, r.turn): r.text for r in catalogue.QUERIES[name](spark, sf).collect()} == want


def twin_dialogue(spark, sf, base, name):
    got = {(r.conv_id, r.turn): r.state for r in catalogue.QUERIES[name](spark, sf).collect()}
    assert set(got) == set(replies(base)) and got
    for state in got.values():
        assert state.startswith("[STATE] goal=fix the merge | blocker=it fails | command=ran `cargo test`") and "next=" in state


def twin_read_summaries(spark, sf, base, name):
    rows = facts.sources(spark, sf).collect()
    got = {r.doc_id: r.summary for r in catalogue.QUERIES[name](spark, sf).collect()}
    assert set(got) == {r.doc_id for r in rows}
    for r in rows:
        head = got[r.doc_id].split("\n")
        assert head[0] == f"[{r.doc_id}] {len(plain_lines(r.text))}L | 1 defs" and head[1].startswith(f"  L1: pub fn name_{r.doc_id}(x) {{")


def twin_sessions(spark, sf, base, name):
    turns = dict(base.execute("select conv_id, count(*) from conversations where role <> 'assistant' group by all").fetchall())
    got = {r.session: r.block for r in catalogue.QUERIES[name](spark, sf).collect()}
    assert set(got) == {c for c, in base.execute("select distinct conv_id from conversations").fetchall()}
    reads = dict(base.execute("select conv_id, count(*) from conversations where role = 'assistant' and turn % 4 = 1 group by all").fetchall())
    for c, block in got.items():
        if turns.get(c, 0) < 3:
            assert block == "early\n"
        else:
            assert block.startswith(f"[state]\nturn: {turns[c]}\n") and f"session: {turns[c]} turns" in block
            assert ("reads: a.rs(" in block) == (reads.get(c, 0) > 0)


PLAIN_TWINS = {
    "skeletons": twin_skeletons, "output_skeletons": twin_output_skeletons, "skeleton_groups": twin_groups, "prefixed_groups": twin_groups, "template_groups": twin_groups,
    "good_counts": twin_good_counts, "strategy_detect": twin_strategies, "template_concentration": twin_concentration, "maxwell_gate": twin_maxwell,
    "recalled_memories": twin_recall, "pulled_vectors": twin_pulled, "safety_states": twin_safety, "format_output": lossless, "tool_results": lossless,
    "reply_compress": twin_replies, "response_bodies": lambda *a: None, "dialogue_states": twin_dialogue, "read_summaries": twin_read_summaries, "session_blocks": twin_sessions,
}


@pytest.mark.parametrize("name", sorted(PLAIN))
def test_plain_twin(spark, sf, base, name):
    """response_bodies has a test of its own above."""
    PLAIN_TWINS[name](spark, sf, base, name)
