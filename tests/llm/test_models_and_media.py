"""Operators 3 to 7 and the pipeline: round trips, brute force and held-out accuracy."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from linewright.llm import chat_format, components, matroska, quality, queries, simhash, toxicity
from linewright.llm.base import table
from linewright.llm.labelled import with_texts

sha = lambda s: hashlib.sha256(s if isinstance(s, bytes) else s.encode()).hexdigest()


def test_media_round_trip(spark, odd, none):
    stored = matroska.store(odd, keep=("doc_id", "text"))
    for r in matroska.features(stored, keep=("doc_id", "text", "n_bytes")).collect():
        data = (r.text or "").encode()
        padded = data + b"\xff" * (576 * max(1, -(-len(data) // 576)) - len(data))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(data), len(padded), sha(padded))
        assert r.tail_crc32 == zlib.crc32(padded[-32:])
    assert matroska.store(none).count() == 0
    rows = matroska.packets(matroska.store(odd.filter("doc_id = 1"))).collect()
    assert len(rows) == 1 and rows[0].size == 576 and rows[0].error is None


def test_media_packets_and_cues():
    data = bytes(random.Random(1).randrange(256) for _ in range(576 * 200))
    file = matroska.write_matroska(data)
    media = matroska.read_matroska(file)
    assert matroska.payload_of(file, media) == data
    assert {p.lacing for p in media.packets} == set(matroska.LACINGS)
    time = 0
    for p in media.packets:
        assert p.timestamp_ns == time
        time += p.size * 125_000
    assert media.duration_ns == time
    for _, track, at in media.cues:
        assert track == 1 and file[at : at + 4] == b"\x1f\x43\xb6\x75"


def test_media_of_other_writers():
    m = matroska
    block = lambda head, body: head + body
    group = m.element(m.BLOCK_GROUP, m.element(m.BLOCK, b"\x81\x00\x05\x00abc") + m.element(m.REFERENCE_BLOCK, b"\x01"))
    cluster = m.CLUSTER.to_bytes(4, "big") + b"\x01" + b"\xff" * 7 + m.unsigned(m.CLUSTER_TIMESTAMP, 7) + group + m.element(m.SIMPLE_BLOCK, block(b"\x81\x00\x06\x80", b"de"))
    body = m.element(0xEC, b"\0\0") + m.element(m.INFO, m.unsigned(m.TIMESTAMP_SCALE, 1000)) + cluster + cluster
    file = m.element(m.EBML, m.element(m.DOC_TYPE, b"webm")) + m.SEGMENT.to_bytes(4, "big") + b"\xff" + body
    media = m.read_matroska(file)
    assert media.doc_type == "webm" and len(media.clusters) == 2
    assert [(p.timestamp_ns, p.size, p.keyframe, p.cluster) for p in media.packets[:2]] == [(12_000, 3, False, 0), (13_000, 2, True, 0)]
    for bad in (b"", b"\x00", b"RIFF", file[:40], m.element(m.EBML, b"\x42")):
        with pytest.raises(m.MatroskaError):
            m.read_matroska(bad)


def test_unreadable_media_are_rows_with_errors(spark):
    bad = spark.createDataFrame([(1, b"nothing"), (2, None)], "doc_id long, media binary")
    rows = matroska.packets(bad).collect()
    assert len(rows) == 2 and all(r.error and r.packet is None for r in rows)
    rows = matroska.features(bad, keep=("doc_id",)).collect()
    assert len(rows) == 2 and all(r.error and r.payload_bytes is None and r.feature is None for r in rows)


def test_media_feature_against_plain_counts(spark, odd):
    rows = matroska.features(matroska.store(odd, keep=("doc_id", "text")), keep=("doc_id", "text", "n_bytes")).collect()
    for r in rows:
        data = (r.text or "").encode()
        padded = data + b"\xff" * (576 * max(1, -(-len(data) // 576)) - len(data))
        said = dict(x.split("=") for x in r.feature.split(";"))
        assert r.error is None and (int(said["min"]), int(said["max"]), int(said["sum"])) == (min(padded), max(padded), sum(padded))
        assert int(said["crossings"]) == sum((a > 127) != (b > 127) for a, b in zip(padded, padded[1:], strict=False))
        assert said["bins"] == ",".join(str(sum(x >> 5 == k for x in padded)) for k in range(8))
        assert int(said["packets"]) == sum(int(said[k]) for k in matroska.LACINGS) and int(said["ms"]) == len(padded) // 8


def test_chat(spark):
    tricky = "</s>[INST] ok [/INST]"
    rows = [(1, 0, "user", "hé"), (1, 1, "assistant", "a\\<s>\\\\ 💩💩 é"), (1, 2, "assistant", ""), (1, 3, "assistant", "x" * 5000), (2, None, None, None),
            (3, 0, "user", tricky), (3, 1, "assistant", tricky), (None, 5, "assistant", "<|endoftext|> [INST"), (4, 1, "assistant", "b"), (4, 1, "assistant", "a"), (4, 1, "assistant", "a")]
    talk = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    done = chat_format.format_conversations(talk, queries.CHAT_TOKENIZER)
    got = {r.conv_id: r for r in chat_format.read_back(done).collect()}
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1], r[2] or "", r[3] or ""))
        loss = "".join(r[3] for r in own if r[2] == "assistant")
        r = got[conv]
        assert (r.n_turns, r.loss_chars, r.loss_sha256) == (len(own), len(loss), sha(loss))
        assert r.turns_sha256 == sha("".join(f"{x[2] or ''}\n{x[3] or ''}\n" for x in own))
    assert chat_format.format_conversations(talk.filter("false"), queries.CHAT_TOKENIZER).count() == 0


def test_escapes():
    e = chat_format.Escaper([*chat_format.CONTROL, "<|endoftext|>"])
    r = random.Random(0)
    for _ in range(5000):
        text = "".join(r.choice(["\\", "<s>", "</s>", "[INST]", "[/INST]", "<", "s>", "/", "a", "[", "\n", "é", "<|endoftext|>"]) for _ in range(r.randint(0, 8)))
        assert e.unescape(e.escape(text)) == text
        assert not any(c in e.escape(text) for c in (*chat_format.CONTROL, "<|endoftext|>"))


def plain_fingerprint(t):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    if not words:
        return 0
    shingles = [" ".join(words)] if len(words) < 4 else [" ".join(words[i : i + 4]) for i in range(len(words) - 3)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints(spark, odd):
    for r in simhash.near_duplicates(odd.select("*"), id_col="doc_id").join(odd.select("doc_id", "text"), "doc_id").filter("doc_id not in (6, 7)").collect():
        assert int(r.fingerprint, 16) == plain_fingerprint(r.text)


def plain_classes(values, radius=4):
    above = list(range(len(values)))

    def root(i):
        while above[i] != i:
            i = above[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= radius:
                a, b = root(i), root(j)
                above[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(values))]


@pytest.mark.parametrize("tree", [512, 3])
def test_links(spark, monkeypatch, tree):
    monkeypatch.setattr(simhash, "TREE", tree)
    r = random.Random(2)
    centres = [r.getrandbits(64) for _ in range(6)]
    values = [c ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 6))) for c in centres for _ in range(60)] + [0, (1 << 64) - 1]
    rows = spark.createDataFrame([(i, simhash.signed(v)) for i, v in enumerate(values)], "doc_id long, fingerprint long").repartition(3)
    found = rows.join(simhash.classes(rows), "fingerprint").select("doc_id", "component_id").collect()
    assert {x.doc_id: x.component_id for x in found} == dict(enumerate(plain_classes(values)))


def test_buckets_split_by_free_bits():
    r = random.Random(3)
    values = sorted({sum(1 << b for b in r.sample(range(40), 3)) for _ in range(400)})
    some = simhash.bucket_links(np.array(values, np.uint64), list(range(40)), 4, most=20)
    links = {tuple(sorted(x)) for x in some}
    want = plain_classes(values)
    above = {v: v for v in values}
    def root(v):
        while above[v] != v:
            v = above[v]
        return v
    for a, b in links:
        x, y = root(a), root(b)
        above[max(x, y)] = min(x, y)
    assert [root(v) for v in values] == [values[i] for i in want]


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (None, 3)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_one_value_in_all_rows(spark):
    """A hub of near copies, and copies of one text, with the same result as brute force."""
    r = random.Random(6)
    hub = r.getrandbits(64)
    values = [hub ^ (1 << i % 64) ^ (1 << (i * 7 + 3) % 64) for i in range(300)] + [hub] * 500 + [r.getrandbits(64) for _ in range(40)]
    rows = spark.createDataFrame([(i, simhash.signed(v)) for i, v in enumerate(values)], "doc_id long, fingerprint long").repartition(3)
    found = simhash.join_groups(rows, simhash.classes(rows), "fingerprint", "n").collect()
    assert {x.doc_id: x.component_id for x in found} == dict(enumerate(plain_classes(values)))


def test_few_links_are_joined_without_rounds(spark, monkeypatch):
    numbers = np.random.default_rng(5).integers(-40, 40, (60, 2)).tolist() + [[i, i + 1] for i in range(100, 400)] + [[7, 7], [None, 3]]
    links = spark.createDataFrame([tuple(x) for x in numbers], "a long, b long")
    few = components.components(links)
    assert "Exchange" not in few._jdf.queryExecution().executedPlan().toString()
    rows = lambda d: sorted(map(tuple, d.collect()))
    got = rows(few)
    monkeypatch.setattr(components, "DRIVER_LINKS", 0)
    assert got == rows(components.components(links)) and dict(got)[400] == 100


def test_components_of_texts(spark, odd):
    rows = [r for r in odd.collect() if r.doc_id is not None and r.doc_id not in (6, 7)]
    prints = [plain_fingerprint(r.text) for r in rows]
    ids = sorted(range(len(rows)), key=lambda i: rows[i].doc_id)
    classes = plain_classes([prints[i] for i in ids])
    want = {rows[i].doc_id: rows[ids[c]].doc_id for i, c in zip(ids, classes, strict=True)}
    docs = spark.createDataFrame(rows, odd.schema)
    assert {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()} == want


def test_keep_one(spark, odd, none):
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    ids = sorted((r.doc_id for r in kept.collect()), key=repr)
    assert ids.count(6) == 1 and ids.count(7) == 1 and 1 in ids and 9 not in ids and -10 in ids
    assert {2, 3} & set(ids) == {2}
    assert simhash.keep_one(none).count() == 0


def small_rows(seed, n=60, width=40):
    r = np.random.default_rng(seed)
    labels = (r.random(n) < 0.7).astype(np.int64)
    rows = [np.unique(r.integers(0, width, 8) + (width // 4) * y) for y in labels]
    return rows, labels, r.normal(size=quality.WIDTH)


def test_dual_coordinate_descent_separates():
    r = np.random.default_rng(1)
    rows = [np.unique(r.integers(0, 50, 10) + (50 if i % 2 else 0)) for i in range(80)]
    labels = np.arange(80) % 2
    model = quality.train(rows, labels)
    scores = np.array([model.score(x) for x in rows])
    assert scores[labels == 1].min() > 0.5 > scores[labels == 0].max()


@pytest.mark.parametrize("seed", [1, 2])
def test_hinge_loss_against_another_solver(seed):
    """Projected gradient steps on the dense dual problem reach the same value, and so does the primal one."""
    rows, labels, ratios = small_rows(seed)
    model, dual = quality.fit_dual(rows, labels, ratios, rounds=400)
    top, sign = quality.costs(labels, 1.0), np.where(labels == 1, 1.0, -1.0)
    x = np.zeros((len(rows), 60))
    for i, held in enumerate(rows):
        x[i, held] = quality.scaled(held, ratios)
    x = np.hstack([x, np.ones((len(rows), 1))]) * sign[:, None]
    kernel, other = x @ x.T, np.zeros(len(rows))
    rate = 1 / np.linalg.eigvalsh(kernel)[-1]
    for _ in range(60_000):
        other = np.clip(other - rate * (kernel @ other - 1), 0, top)
    value = lambda d: d.sum() - d @ kernel @ d / 2
    w = np.append(model.weights[:60], model.bias)
    primal = w @ w / 2 + (top * np.maximum(0, 1 - x @ w)).sum()
    assert (dual >= 0).all() and (dual <= top + 1e-12).all() and 0 < (dual == top).sum() < len(rows)
    assert value(dual) == pytest.approx(value(other), rel=1e-4) and primal == pytest.approx(value(dual), rel=1e-3)


def test_quality_features_are_indicators_of_ngrams():
    seen = np.zeros(quality.WIDTH, bool)
    text = b"so so so it is \xc3\xa9"
    a, b, c, d = quality.BEGIN, quality.OTHER, quality.SAME, quality.END
    assert quality.classes_of(text).tolist() == [a, b, c, c, b, b, b, d]
    assert quality.classes_of(b"").tolist() == [a, d]
    got = quality.indicators(text, seen).tolist()
    symbols, want = [a, b, c, c, b, b, b, d], set()
    for i in range(len(text) - 2):
        want.add((int.from_bytes(text[i : i + 3], "big") * 2654435761 & 0xFFFFFFFF) >> (32 - quality.BITS))
    for n in quality.ORDERS:
        for i in range(len(symbols) - n + 1):
            g = n
            for x in symbols[i : i + n]:
                g = g << 2 | x
            want.add((1 << quality.BITS) + ((g * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> (64 - quality.CLASS_BITS)))
    assert got == sorted(want) and not seen.any()


def test_toxicity_features_against_plain_ones(spark, odd):
    for t in [(r.text or "")[:3000].encode() for r in odd.collect()] + [b"Aber aberration abernathy ab, ABER"]:
        words = set(re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), t)))
        want = set()
        for g in {g for w in words for g in toxicity.grams_of(w)}:
            want |= {toxicity.feature(g, n) for n in toxicity.TIMES if sum(g in toxicity.grams_of(w) for w in words) >= n}
        assert toxicity.features_of(t).tolist() == sorted(want)


@pytest.mark.parametrize("shift", [0.0, -6.0])
def test_risk_and_its_slopes(shift):
    """Against the definition, and against differences; a low margin everywhere makes the bracket negative."""
    r, prior = np.random.default_rng(3), 0.3
    z_p, z_u = r.normal(size=7) - shift, r.normal(size=11) + shift
    loss = lambda z: sum(np.log1p(np.exp(-x)) for x in z) / len(z)
    first, bracket = toxicity.risk(z_p, z_u, prior)
    assert first == pytest.approx(prior * loss(z_p)) and bracket == pytest.approx(loss(-z_u) - prior * loss(-z_p))
    assert (bracket < 0) == (shift < 0)
    goal = (lambda p, u: sum(toxicity.risk(p, u, prior))) if bracket >= 0 else (lambda p, u: -toxicity.risk(p, u, prior)[1])
    s_p, s_u = toxicity.slopes(z_p, z_u, prior)
    step = lambda n, i: 1e-6 * (np.arange(n) == i)
    for i in range(7):
        assert s_p[i] == pytest.approx((goal(z_p + step(7, i), z_u) - goal(z_p - step(7, i), z_u)) / 2e-6, abs=1e-6)
    for i in range(11):
        assert s_u[i] == pytest.approx((goal(z_p, z_u + step(11, i)) - goal(z_p, z_u - step(11, i))) / 2e-6, abs=1e-6)


def test_slopes_of_rows():
    r = np.random.default_rng(4)
    rows = [np.unique(r.integers(0, 1 << toxicity.BITS, n)).astype(np.int32) for n in (5, 0, 9)]
    held = toxicity.Rows(rows)
    dense = np.zeros((3, 1 << toxicity.BITS))
    for i, x in enumerate(rows):
        dense[i, x] = 1
    into = np.zeros(1 << toxicity.BITS)
    held.all_slopes(np.array([0.5, 7.0, -1.0]), into)
    assert np.allclose(into, np.array([0.5, 7.0, -1.0]) @ dense)
    chosen = np.unique(np.concatenate(rows))[::2]
    column = np.full(1 << toxicity.BITS, -1, np.int32)
    column[chosen] = np.arange(len(chosen))
    held.choose(column, len(chosen))
    w = r.normal(size=len(chosen))
    assert np.allclose(held.margins(w, 2.0), dense[:, chosen] @ w + 2.0)
    assert np.allclose(held.chosen_slopes(np.array([1.0, 2.0, 3.0])), np.array([1.0, 2.0, 3.0]) @ dense[:, chosen])


def scores_of(model, rows):
    weight = np.zeros(1 << toxicity.BITS)
    weight[model.features] = model.weights
    return toxicity.sigmoid(np.array([weight[x].sum() + model.bias for x in rows]))


def test_risk_never_learns_negatives():
    r = np.random.default_rng(2)
    toxic = [np.unique(np.append(r.integers(0, 500, 20), 999)) for _ in range(60)]
    clean = [np.unique(r.integers(0, 500, 20)) for _ in range(540)]
    model = toxicity.train(toxic[:30], [*clean, *toxic], 0.1)
    assert 999 in model.features.tolist() and (model.weights > 0).all()
    assert scores_of(model, toxic).min() > 0.6 > 0.4 > scores_of(model, clean).max()


def test_toxic_words_of_a_rare_language_count():
    r = np.random.default_rng(4)
    clean = [np.unique(r.integers(0, 5000, 20)) for _ in range(3000)]
    often = [np.unique([*r.integers(0, 5000, 20), *((7 * i + np.arange(7)) % 196 + 6000)]) for i in range(588)]
    rare = [np.unique([*r.integers(0, 5000, 20), 9000]) for _ in range(24)]
    model = toxicity.train([*often[:294], *rare[:12]], [*clean, *often, *rare], 0.17)
    assert 9000 in model.features.tolist()
    assert scores_of(model, rare[12:]).min() > 0.7 and scores_of(model, often).min() > 0.7 and (scores_of(model, clean) > 0.7).sum() < 30


def test_samples_are_bounded(spark):
    docs = spark.createDataFrame([(i % 50, f"word{i} of many") for i in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    sample = labels.selectExpr("doc_id as _lw_id", "quality as _lw_label")
    found = with_texts(sample, docs, "doc_id", "text").collect()
    assert sorted((r["_lw_id"], r["_lw_text"]) for r in found) == sorted((i, min(f"word{j} of many" for j in range(i, 400, 50))) for i in range(50))
    assert quality.fit(docs, labels, most_features=30).score(np.array([1])) >= 0
    assert toxicity.fit(docs, labels, label="quality", most_features=30).bias < 1


@pytest.mark.parametrize(("kind", "label", "least", "recall", "precision"), [(quality, "quality", 0.3, 0.97, 0.97), (toxicity, "toxic", 0.7, 0.9, 0.95)])
def test_held_out(spark, kind, label, least, recall, precision):
    """The smaller tables have some dozen toxic labels, and in some languages too few to learn from."""
    folder = "/root/testdata/sf0.1"
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    model = kind.fit(docs, labels, usable=lambda i: ~kind.held_out(i))
    rows = kind.score(docs, model).join(labels, "doc_id").filter(kind.held_out(F.col("doc_id"))).collect()
    hits = sum(r.score >= least and r[label] == 1 for r in rows)
    assert all(0 <= r.score <= 1 for r in rows)
    assert hits / sum(r[label] for r in rows) >= recall and hits / max(1, sum(r.score >= least for r in rows)) >= precision


@pytest.mark.parametrize(("kind", "label"), [(quality, "quality"), (toxicity, "toxic")])
def test_models_on_odd_tables(spark, odd, none, kind, label):
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1), (6, 1), (99, 0), (9, 1), (9, 1)], f"doc_id long, {label} int")
    for some in (labels, labels.filter("false"), labels.filter(f"{label} = 1")):
        rows = kind.score(odd, kind.fit(odd, some)).collect()
        assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    assert kind.score(none, kind.fit(none, labels)).count() == 0


def test_pipeline_stages(spark, odd, none, sf):
    assert [n for n, _ in corpus_pipeline.STAGES][0] == "toxicity" and len(corpus_pipeline.STAGES) == 5
    for docs in (odd, none):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, sf)
            assert out.columns == odd.columns, name
            assert out.count() <= docs.count()
    assert corpus_pipeline.STAGES[-1][1](spark, odd, sf).count() == odd.count()


def test_pipeline_run(spark, sf):
    done = corpus_pipeline.run(spark, sf).collect()
    docs = {r.doc_id: r.text for r in table(spark, sf, "documents").collect()}
    assert 0 < len(done) < len(docs) and len({r.doc_id for r in done}) == len(done)
    untouched = [r for r in done if r.decoded_sha256 == sha(docs[r.doc_id])]
    assert len(untouched) >= 0.9 * len(done)
    fingerprints = [plain_fingerprint(docs[r.doc_id]) for r in done]
    assert all((a ^ b).bit_count() > 4 for i, a in enumerate(fingerprints) for b in fingerprints[:i])


def test_every_query_has_its_columns(spark, sf):
    want = {
        "op1": "doc_id n_assign n_access n_hex base_sha256 spans", "op2": "doc_id n_tokens", "op3": "doc_id n_bytes payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 feature",
        "op4": "conv_id n_turns turns_sha256 loss_chars loss_sha256 formatted_chars", "op5": "doc_id held_out score predicted", "op6": "doc_id held_out score predicted",
        "op7": "doc_id fingerprint component_id", "op8": "doc_id n_bytes n_removed n_spans kept_sha256",
        "op9": "doc_id n_words n_hit n_items items_sha256 contaminated", "op10": "doc_id n_tokens ids_sha256 decoded_sha256",
    }
    for name, query in queries.QUERIES.items():
        frame = query(spark, sf)
        assert set(want[name.split("_")[0]].split()) <= set(frame.columns), name
        assert frame.count() > 0
