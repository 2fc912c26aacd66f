from __future__ import annotations

import random

import numpy as np
import pytest
from brute import chunks, lines, strings

from millrace.llm.line_dedup import dedup_lines, op5_line_dedup
from millrace.llm.repeats import Judged, whole_groups
from millrace.llm.substring_dedup import boundaries, dedup_substrings, gear, op2_substring_dedup
from millrace.llm.suffix_dedup import Hot, collection, dedup_strings, op10_suffix_dedup, oversized, repeated_part, segments


def documents(spark, sf):
    return [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]


def test_op10_equals_brute_force(spark, sf):
    want = strings([(k, t.encode()) for k, t in documents(spark, sf)])
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in op10_suffix_dedup(spark, sf).collect()}
    assert got == want
    assert any(v[1] for v in want.values())


def test_op5_equals_brute_force(spark, sf):
    want = lines(documents(spark, sf))
    got = {r.doc_id: (r.n_lines, r.n_removed, r.n_spans, r.kept_sha256) for r in op5_line_dedup(spark, sf).collect()}
    assert got == want


EDGE = [(1, None), (2, ""), (3, "a" * 5000), (4, "a" * 5000), (5, "x\n\n\n\n\ny"), (6, "short"), (7, "ünï" * 200), (7, "ünï" * 200), (None, "ünï" * 200), (None, None)]


@pytest.mark.parametrize("kind", ["strings", "lines", "chunks"])
def test_edge_rows(spark, kind):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in EDGE], "doc_id long, text string, _key string, n_spans long")
    out = {"strings": dedup_strings, "lines": dedup_lines, "chunks": dedup_substrings}[kind](docs).collect()
    assert len(out) == len(EDGE)
    order = sorted(range(len(EDGE)), key=lambda i: (EDGE[i][0] is not None, EDGE[i][0] or 0, EDGE[i][1] is not None, EDGE[i][1] or ""))
    texts = [(n, EDGE[i][1] or "") for n, i in enumerate(order)]
    if kind == "strings":
        want = strings([(n, t.encode()) for n, t in texts])
        assert {r._key: (r.n_bytes, r.n_spans) for r in out} == {k: (v[0], v[2]) for k, v in want.items()}
        assert {r._key: r.n_bytes - len(r.kept) for r in out} == {k: v[1] for k, v in want.items()}
    if kind == "lines":
        want = lines(texts)
        assert {r._key: (r.n_lines, r.n_removed, r.n_spans) for r in out} == {k: v[:3] for k, v in want.items()}


@pytest.mark.parametrize("op", [dedup_strings, dedup_lines, dedup_substrings])
def test_empty_table(spark, op):
    assert op(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_small_alphabet_strings(spark):
    rnd = random.Random(3)
    docs = [(i, "".join(rnd.choice("ab") for _ in range(rnd.randint(0, 120)))) for i in range(60)]
    got = {r._key: (r.n_bytes, r.n_bytes - len(r.kept), r.n_spans) for r in dedup_strings(spark.createDataFrame(docs, "doc_id long, text string"), length=9, k=3).collect()}
    assert got == {k: v[:3] for k, v in strings([(k, t.encode()) for k, t in docs], 9).items()}


def test_oversized_groups_are_dealt_out_by_window(spark):
    rnd = random.Random(4)
    text = lambda n: "".join(rnd.choice("abcdefghijklmnop") for _ in range(n))
    passage = text(350)
    docs = [(i, text(rnd.randint(0, 150)) + passage[rnd.randint(0, 9) :] + text(rnd.randint(0, 150))) for i in range(150)] + [(1000 + i, text(400)) for i in range(20)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = {k: v[:3] for k, v in strings([(k, t.encode()) for k, t in docs]).items()}
    for bound in (0, 2000, 1 << 20):
        got = {r._key: (r.n_bytes, r.n_bytes - len(r.kept), r.n_spans) for r in dedup_strings(df, bound=bound).collect()}
        assert got == want, bound


def test_windows_of_a_group_over_the_bound_never_reach_one_collection():
    import pyarrow as pa

    n = 40
    batch = pa.record_batch({"route": pa.array([1] * n + [2] * 2), "digest": pa.array([(i << 10) | 60 for i in range(n + 2)]), "_key": pa.array(range(n + 2)), "a": pa.array([0] * (n + 2), pa.int32())})
    j = Judged(batch)
    assert oversized(j, 100, 159 * n - 1).tolist() == [True] * n + [False] * 2
    assert not oversized(j, 100, 159 * n).any()


def test_no_repeated_window_is_cut_off():
    rnd = random.Random(8)
    for _ in range(40):
        texts = ["".join(rnd.choice("abc") for _ in range(rnd.randint(6, 20))).encode() for _ in range(8)]
        data, lens = np.frombuffer(b"".join(texts), np.uint8), np.array([len(t) for t in texts])
        order = np.array(rnd.sample(range(8), 8))
        got = {order[t]: (int(a), int(n)) for t, a, n in zip(*repeated_part(data, (np.cumsum(lens) - lens)[order], lens[order], 6), strict=True)}
        windows = [[t[i : i + 6] for i in range(len(t) - 5)] for t in texts]
        every = sum(windows, [])
        for i, w in enumerate(windows):
            at = [j for j, x in enumerate(w) if every.count(x) > 1]
            assert got.get(i) == ((at[0], at[-1] - at[0] + 6) if at else None)


def test_collection_is_sorted_with_its_common_prefixes():
    rnd = random.Random(5)
    for _ in range(50):
        texts = ["".join(rnd.choice("ab") for _ in range(rnd.randint(1, 12))).encode() for _ in range(rnd.randint(1, 6))]
        data, lens = np.frombuffer(b"".join(texts), np.uint8), np.array([len(t) for t in texts])
        which, size, lcp = collection(data, np.r_[0, np.cumsum(lens)[:-1]], lens)
        got = [tuple(texts[w][len(texts[w]) - z :]) + (-1, w) for w, z in zip(which.tolist(), size.tolist(), strict=True)]
        assert got == sorted(tuple(t[len(t) - j :]) + (-1, i) for i, t in enumerate(texts) for j in range(len(t) + 1))
        for a, b, n in zip(got, got[1:], lcp[1:].tolist(), strict=False):
            common = next(i for i in range(len(a)) if i >= len(b) or a[i] != b[i] or a[i] < 0)
            assert common == n


def test_equal_windows_share_an_anchor_even_with_hot_ones():
    rnd = random.Random(7)
    texts = ["".join(rnd.choice("abc") for _ in range(rnd.randint(0, 60))).encode() for _ in range(20)]
    data, offs = np.frombuffer(b"".join(texts), np.uint8), np.r_[0, np.cumsum([len(t) for t in texts])]
    plain, *_ = segments(data, offs, 10, 3, Hot(np.zeros(0, np.uint64)))
    values, counts = np.unique(plain, return_counts=True)
    h, row, start, n = segments(data, offs, 10, 3, Hot(values[counts > np.median(counts)]))
    seen: dict[bytes, set[int]] = {}
    for x, s, k in zip(h.tolist(), start.tolist(), n.tolist(), strict=True):
        for o in range(k):
            seen.setdefault(data[s + o : s + o + 10].tobytes(), set()).add(x)
    assert int(n.sum()) == sum(max(0, len(t) - 9) for t in texts)
    assert all(len(v) == 1 for v in seen.values())


def test_op2_equals_brute_force_under_any_partitioning(spark, sf):
    docs = documents(spark, sf)
    want = chunks([(k, t.encode()) for k, t in docs])
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in op2_substring_dedup(spark, sf).collect()}
    assert got == want and any(v[1] for v in want.values())
    table = spark.createDataFrame(docs, "doc_id long, text string")
    for parts in (1, 7):
        out = dedup_substrings(table.repartition(parts, "text")).collect()
        assert {r._id: (r.n_bytes, r.n_bytes - len(r.kept), r.n_spans) for r in out} == {k: v[:3] for k, v in want.items()}


def test_chunks_resist_shifts(spark):
    rnd = random.Random(9)
    word = lambda letters: "".join(rnd.choice(letters) for _ in range(rnd.randint(3, 8)))
    text = lambda n, letters: " ".join(word(letters) for _ in range(n))
    docs, n = [], 60
    for i in range(n):
        passage = text(55, "abcdefghij")
        docs += [(3 * i, f"{text(40, 'klmnopqrst')} {passage} {text(30, 'klmnopqrst')}"), (3 * i + 1, f"{text(13, 'klmnopqrst')} {passage} x"), (3 * i + 2, text(200, "klmnopqrst"))]
    out = {r._id: r.n_bytes - len(r.kept) for r in dedup_substrings(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert all(out[i] == 0 for i in out if i % 3 != 1)
    assert sum(out[3 * i + 1] > 0 for i in range(n)) >= 0.95 * n


def test_exact_copies_go_whole_behind_any_neighbour(spark):
    rnd = random.Random(17)
    text = lambda n: "".join(rnd.choice("abcdefghij klmnopqrst") for _ in range(n))
    copies = [text(n) for n in (5, 20, 40, 63, 64, 100, 150, 400) for _ in range(20)]
    docs = [(i, x) for n, c in enumerate(copies) for i, x in ((4 * n, text(rnd.randint(1, 90))), (4 * n + 1, c), (4 * n + 2, text(rnd.randint(1, 90))), (4 * n + 3, c))]
    for parts in (1, 3):
        df = spark.createDataFrame(docs, "doc_id long, text string").repartition(parts)
        out = {r._id: (r.n_bytes, len(r.kept)) for r in dedup_substrings(df).collect()}
        assert all(out[4 * n + 3] == (len(c), 0) for n, c in enumerate(copies))
        assert all(out[4 * n + 1] == (len(c), len(c)) for n, c in enumerate(copies))


def test_the_gear_hash_starts_anew_in_each_row():
    rnd = np.random.default_rng(2)
    data = rnd.integers(0, 256, 400).astype(np.uint8)
    offs = np.array([0, 0, 1, 3, 3, 40, 80, 80, 399, 400, 400])
    want = np.concatenate([gear(data[a:b]) for a, b in zip(offs[:-1], offs[1:], strict=True) if b > a])
    assert (gear(data, offs) == want).all()


def test_chunks_tile_every_row():
    rnd = np.random.default_rng(1)
    data = rnd.integers(97, 110, 5000).astype(np.uint8)
    offs = np.array([0, 0, 10, 3000, 3000, 5000])
    a, b = boundaries(data, offs, 16, 5, 256)
    assert (a[1:] == b[:-1]).all() and a[0] == 0 and b[-1] == 5000 and (b - a).max() <= 256
    assert set(offs.tolist()) <= set(a.tolist()) | {5000}
    h = 0
    for x in data[:40].tolist():
        h = ((h << 1) + int(gear(np.array([x], np.uint8))[0])) & 0xFFFFFFFF
    assert h == int(gear(data[:40])[-1])


def test_groups_are_never_split():
    import pyarrow as pa

    x = [1, 1, 2, 3, 3, 3, 3, 3, 4, 5, 5]
    for size in range(1, 6):
        parts = [pa.record_batch({"g": pa.array(x[i : i + size])}) for i in range(0, len(x), size)]
        got = [b.column("g").to_pylist() for b in whole_groups(iter(parts), "g")]
        assert sum(got, []) == x
        assert all(p[-1] != q[0] for p, q in zip(got, got[1:], strict=False))
