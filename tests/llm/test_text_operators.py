"""Operators 9 and 10, 1 and 8 against plain Python on small tables."""

import hashlib
import random
import re

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from linewright.llm import byte_bpe, decontamination, queries, repeats, secret_scan, token_scan

sha = lambda s: hashlib.sha256(s if isinstance(s, bytes) else s.encode()).hexdigest()


@pytest.fixture(scope="module")
def bpe():
    with open(queries.RANKS, "rb") as f:
        return byte_bpe.ByteBpe(byte_bpe.read_ranks(f.read()), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library(bpe):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks, special_tokens={})


PARTS = ["a", "th", "e", "ing", " ", "  ", "\n", "é", "日本", "💩", "'s", "!!", "xxxxxxxxx", "123", "the", "tion", "\x00", "ñ", "<|endoftext|>"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=40))
def test_bpe_equals_library(bpe, library, parts):
    text = "".join(parts)
    ids = bpe.encode(text)
    assert ids == library.encode_ordinary(text)
    assert bpe.decode(ids) == text.encode()


def test_bpe_with_a_token_that_no_merge_makes():
    ranks = {bytes([i]): i for i in range(256)} | {b"ab": 256, b"abcd": 257}
    own = byte_bpe.ByteBpe(ranks, r"\S+")
    library = tiktoken.Encoding("own", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})
    for text in ("abcd", "abcde", "ababcd", "xabcd abcd"):
        assert own.encode(text) == library.encode_ordinary(text)


def test_bpe_query(spark, odd, none, library):
    rows = byte_bpe.encode(odd, queries.RANKS, public_tokenizers.PATTERN, keep=("doc_id", "text")).collect()
    assert len(rows) == odd.count()
    for r in rows:
        ids = library.encode_ordinary(r.text or "")
        assert (r.n_tokens, r.ids_sha256, list(r.ids)) == (len(ids), sha(",".join(map(str, ids))), ids)
        assert r.decoded_sha256 == sha(r.text or "")
    assert byte_bpe.encode(none, queries.RANKS, public_tokenizers.PATTERN).count() == 0
    some = byte_bpe.encode(odd.limit(3), queries.RANKS, public_tokenizers.PATTERN)
    assert [bytes(r.decoded) for r in byte_bpe.decode(some, queries.RANKS).collect()] == [(r.text or "").encode() for r in odd.limit(3).collect()]


@pytest.mark.parametrize("size", [1 << 20, 4096])
def test_separator_scan(spark, odd, none, library, monkeypatch, size):
    monkeypatch.setattr(token_scan, "RANGE", size)
    rows = token_scan.token_counts(odd.repartition(3), queries.RANKS, public_tokenizers.PATTERN).collect()
    want = [(r.doc_id, len(library.encode_ordinary(r.text or ""))) for r in odd.collect()]
    assert sorted(((r.doc_id, r.n_tokens) for r in rows), key=repr) == sorted(want, key=repr)
    assert len({(r.file, r.ordinal) for r in rows}) == len(rows)
    assert token_scan.token_counts(none, queries.RANKS, public_tokenizers.PATTERN).count() == 0


@pytest.mark.parametrize(("kind", "ids"), [("<u2", 3), ("<u4", 2), ("<u4", 1), ("<u4", 100)])
def test_separators_across_ranges(spark, tmp_path, kind, ids):
    flat = token_scan.Flat(50256, kind)
    files = {"a": [7, 8, 50256, 50256, 1, 2, 3, 4, 5, 6, 7, 50256, 9], "b": [4, 50256], "c": [], "d": [1, 2, 3], "e": [50256] * 5}
    for name, held in files.items():
        (tmp_path / name).write_bytes(np.array(held, kind).tobytes())
    found = token_scan.scan(token_scan.files_in(spark, str(tmp_path)), str(tmp_path), flat, ids * np.dtype(kind).itemsize)
    got = [(r.file, r.ordinal, r.n_tokens) for r in found.orderBy("file", "ordinal").collect()]
    assert got == [("a", 0, 2), ("a", 1, 0), ("a", 2, 7), ("b", 0, 1), *[("e", i, 0) for i in range(5)]]


def test_separator_is_behind_the_vocabulary(tmp_path):
    ranks = tmp_path / "ranks"
    ranks.write_bytes(b"YQ== 0\nYg== 70000\n")
    assert token_scan.flat_of(str(ranks)) == token_scan.Flat(70001, "<u4")
    assert token_scan.flat_of(queries.RANKS) == token_scan.Flat(50256, "<u2")


def test_bytes_that_are_no_utf8(spark, library):
    docs = spark.sql("select 1L as doc_id, cast(X'6162FF63' as string) as text union all select 2L, 'abc'")
    want = {1: "ab\ufffdc", 2: "abc"}
    for r in byte_bpe.encode(docs, queries.RANKS, public_tokenizers.PATTERN).collect():
        assert list(r.ids) == library.encode_ordinary(want[r.doc_id]) and r.decoded_sha256 == sha(want[r.doc_id])
    for r in token_scan.token_counts(docs, queries.RANKS, public_tokenizers.PATTERN).collect():
        assert r.n_tokens == len(library.encode_ordinary(want[r.doc_id]))


def test_unknown_ids_decode_to_null(spark):
    rows = spark.sql("select 1 as doc_id, array(64, 99999999) as ids union all select 2, array(64, null) union all select 3, null union all select 4, array(64)")
    got = {r.doc_id: r.decoded for r in byte_bpe.decode(rows, queries.RANKS).collect()}
    assert got[1] is None and got[2] is None and bytes(got[3]) == b"" and len(got[4]) >= 1


def plain_windows(docs, items, width=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - width + 1) if w else 0):
            windows.setdefault(tuple(w[k : k + width]), set()).add(str(i) if i is not None else "null")
    out = []
    for i, t in docs:
        w = words(t)
        hit, own = set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                found = windows.get(tuple(w[k : k + n]))
                if found:
                    hit |= set(range(k, k + n))
                    own |= found
        out.append((i, len(w), len(hit), len(own), sha(",".join(sorted(own))), bool(hit)))
    return sorted(out, key=repr)


ITEMS = [(1, "One two, three FOUR five six seven eight nine ten"), (2, "four five"), (2, "zz"), (10, ""), (11, None), (None, "été 7"),
         (12, " ".join(f"wort{i % 977} été {i}" for i in range(30, 50)))]


@pytest.mark.parametrize(("block", "segment"), [(8 << 20, 4096), (60, 4096), (200, 3)])
def test_windows(spark, odd, none, monkeypatch, block, segment):
    monkeypatch.setattr(decontamination, "SEGMENT", segment)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    found = decontamination.scan_documents(odd, items, block_bytes=block)
    got = sorted((tuple(r)[:6] for r in found.collect()), key=repr)
    assert got == plain_windows([(r.doc_id, r.text) for r in odd.collect()], ITEMS)
    assert decontamination.scan_documents(none, items, block_bytes=block).count() == 0
    clean = decontamination.scan_documents(odd, items.filter("false"), block_bytes=block)
    assert clean.filter("contaminated or n_items > 0").count() == 0


def test_window_spans(spark):
    docs = spark.createDataFrame([(1, "é FOUR, five! x"), (2, "xfour five")], "doc_id long, text string")
    items = spark.createDataFrame(ITEMS[:2], "item_id long, text string")
    assert {r.doc_id: r.spans for r in decontamination.scan_documents(docs, items).collect()} == {1: "2:12", 2: ""}


def plain_repeats(rows, size=100):
    seen, out = set(), {}
    for key, t in sorted(rows):
        gone = np.zeros(len(t), bool)
        for s in range(len(t) - size + 1):
            part = t[s : s + size]
            if part in seen:
                gone[s : s + size] = True
            else:
                seen.add(part)
        edges = np.flatnonzero(np.diff(np.concatenate(([0], gone.view(np.int8), [0]))))
        out[key] = (len(t), int(gone.sum()), len(edges) // 2, sha(bytes(b for b, g in zip(t, gone, strict=True) if not g)))
    return out


@pytest.mark.parametrize(("members", "block", "sample"), [(100_000, 1_000_000, 64), (3, 1_000_000, 1), (3, 64, 1), (7, 64, 2), (2, 64, 1 << 30)])
def test_repeats(spark, monkeypatch, members, block, sample):
    """Also with buckets that are hot from a few members on, known beforehand or not, in blocks of few anchors."""
    monkeypatch.setattr(repeats, "MOST_MEMBERS", members)
    monkeypatch.setattr(repeats, "SAMPLE", sample)
    monkeypatch.setattr(repeats, "BLOCK_ANCHORS", block)
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdeé ") for _ in range(r.randint(1, 9)))
    passage = [" ".join(word() for _ in range(30)) for _ in range(4)]
    rows = []
    for i in range(60):
        parts = [" ".join(word() for _ in range(r.randint(0, 40))) for _ in range(3)]
        rows.append((i * 3, parts[0] + r.choice(passage)[r.randint(0, 30) :] + parts[1] + r.choice(passage) + parts[2]))
    rows += [(200, rows[4][1]), (201, rows[4][1][:150] + "!" + rows[4][1][151:]), (202, "ab" * 300), (203, "x" * 99), (204, ""), (205, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = plain_repeats([(i, (t or "").encode()) for i, t in rows])
    got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in repeats.remove_repeats(docs).collect()}
    assert got == want


@pytest.mark.parametrize("seed", [1, 2])
def test_refinement_against_plain_strings(seed):
    r = random.Random(seed)
    size, side = repeats.LENGTH, repeats.LENGTH - repeats.Q
    gram = bytes(r.choice(b"ab\0") for _ in range(repeats.Q))
    rows = []
    for _ in range(80):
        before, after = r.choice([side, side, 5, 0]), r.choice([size, size, size - 3, repeats.Q])
        left, right = bytes(r.choice(b"\0a") * 1 for _ in range(3)), r.choice([b"x" * 80, b"x" * 30 + b"y" * 50, b"\0" * 80])
        rows.append(((b"z" * side + left)[-before:] if before else b"", (gram + right)[:after]))
    around = np.array([list(b"\0" * (side - len(a)) + a + b + b"\0" * (size - len(b))) for a, b in rows], np.uint8)
    who, first, stop = repeats.repeated_strings(around, np.array([len(a) for a, _ in rows]), np.array([len(b) for _, b in rows]))
    got = {(w, o) for w, f, t in zip(who.tolist(), first.tolist(), stop.tolist(), strict=True) for o in range(f, t)}
    want, seen = set(), set()
    for i, (a, b) in enumerate(rows):
        for o in range(side + 1):
            if len(a) >= side - o and len(b) >= o + size - side:
                part = bytes(around[i, o : o + size])
                want |= {(i, o)} if (o, part) in seen else set()
                seen.add((o, part))
    assert got == want and want


def test_repeats_odd(spark, odd, none):
    rows = repeats.remove_repeats(odd).collect()
    assert len(rows) == odd.count()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append((r.n_bytes, r.n_removed))
    assert by[6][0] == by[6][1] and by[-10] == [(250, 150)] or by[-10][0][0] == 250
    assert by[9] == [(250, 250)]  # the smaller id holds the same text
    assert by[3] == [(0, 0)] and by[2] == [(0, 0)] and by[None][0][1] == 0
    assert sorted(n for n, _ in by[7])[0] == 55
    assert repeats.remove_repeats(none).count() == 0


def test_repeated_rows_are_one_document(spark):
    r = random.Random(8)
    text = lambda n: "".join(r.choice("abcdefg ") for _ in range(n))
    one, two, own = text(400), text(300), text(120)
    rows = [(1, one)] * 3 + [(2, own + two)] * 2 + [(3, one[50:] + two)] * 2 + [(4, "ab" * 200)] * 2
    want = plain_repeats([(i, t.encode()) for i, t in sorted(set(rows))])
    assert want[1][1] == 0 and want[3][1] > 0
    for parts in (1, 5):  # within a map task, and across tasks
        got = repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)).collect()
        assert sorted((x.doc_id, (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256)) for x in got) == sorted((i, want[i]) for i, _ in rows)
    ranked = repeats.remove_repeats(spark.createDataFrame([(1, one)] * 2 + [(1, two)] * 2, "doc_id long, text string")).collect()
    assert [x.n_removed for x in ranked] == [0] * 4


def test_long_texts_are_taken_in_parts(monkeypatch):
    r = random.Random(1)
    texts = [bytes(r.choice(b"abc") for _ in range(n)) for n in (5, 99, 100, 700, 3000)] + [b"ab" * 400]
    whole = sorted(zip(*[c.tolist() for c in repeats.anchors(texts)], strict=True))
    monkeypatch.setattr(repeats, "PIECE", 130)
    assert sorted(zip(*[c.tolist() for c in repeats.anchors(texts)], strict=True)) == whole


def plain_spans(t):
    out = []
    for m in re.finditer(r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t):
        if len(m[2]) >= 8:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 32]
    return sorted(out)


TRICKY = ["token=token:abcdefgh", "token=token=abcdefgh", "Secret : 'abc' API_KEY=\"0123456789abcdef0123456789abcdef\"", "é💩 passwd=12345678 AKIAAKIA12345678",
          "AKIA123 AKIA-AKIAXXXXXXXXXXXX", "f" * 31 + "g" + "a" * 33, "password=short apikey==longenough1", "token:\x20\x20abcdefgh,token:ijklmnop"]


def test_base_spans(spark, odd):
    rows = [(i, t, "s", "l") for i, t in enumerate(TRICKY)] + [(100 + i, r.text, r.source, r.lang) for i, r in enumerate(odd.collect())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    got = {r.doc_id: r for r in secret_scan.scan(docs).collect()}
    assert len(got) == len(rows)
    for i, t, *_ in rows:
        base = plain_spans(t or "")
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex) == tuple(sum(k == n for _, k, _ in base) for n in range(3))
        assert got[i].base_sha256 == sha(",".join(f"{secret_scan.KINDS[k]}:{a}:{b}" for a, k, b in base)), t


def test_ownership(spark, none):
    value, copied = "Zx9Yw8Vu7Ts6Rq5Po4Nm3", "Ab1Cd2Ef3Gh4Ij5Kl6Mn7"
    rows = [(1, f"x {value} y", "a", "r"), (2, f"{value}", "a", "r2"), *[(10 + i, f"see {copied}", f"o{i}", "r") for i in range(4)]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    got = {r.doc_id: (r.spans, r.n_live, r.n_example, r.most_owners) for r in secret_scan.scan(docs).collect()}
    assert got[1] == ("live:2:23", 1, 0, 1) and got[2] == ("live:0:21", 1, 0, 1) and got[10] == ("", 0, 1, 4)
    assert secret_scan.scan(none).count() == 0


def test_redaction(spark, odd):
    out = secret_scan.redact(odd)
    assert out.columns == odd.columns and out.count() == odd.count()
    six = [r for r in out.collect() if r.doc_id == 6]
    assert len(six) == 2 and all(r.text == "[REDACTED]' and [REDACTED]" for r in six) and all(r.n_chars == len(r.text) for r in six)
    assert sorted(map(repr, out.filter("doc_id <> 6").collect())) == sorted(map(repr, odd.filter("doc_id <> 6").collect()))


def test_sql_twins(spark, sf):
    base = duckdb.connect()
    base.execute(f"create view documents as select * from read_parquet('{sf}/documents.parquet')")
    for name, body in queries.ORACLES.items():
        want = base.execute(body).df()
        got = queries.QUERIES[name](spark, sf).toPandas()
        assert sorted(got.columns) == sorted(want.columns)
        columns = sorted(got.columns)
        assert sorted(map(repr, got[columns].astype(str).values.tolist())) == sorted(map(repr, want[columns].astype(str).values.tolist())), name
