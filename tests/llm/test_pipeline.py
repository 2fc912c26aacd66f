from __future__ import annotations

import tracemalloc
from collections import defaultdict

import numpy as np
import pyarrow as pa
from brute import lines, near_classes
from pyspark.sql import functions as F

import corpus_pipeline
from millrace.llm import decontaminate, minhash


def test_stages_one_by_one(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    cols = docs.columns
    (_, identify), (_, dedup_lines), (_, near), (_, clean), (_, pack) = corpus_pipeline.STAGES

    kept = identify(spark, docs, sf)
    assert kept.columns == cols and kept.count() >= 0.98 * docs.count()

    kept = spark.createDataFrame(kept.collect(), kept.schema)
    after = dedup_lines(spark, kept, sf)
    assert after.columns == cols
    before = {r.doc_id: r.text or "" for r in kept.collect()}
    want = lines(list(before.items()))
    for r in after.collect():
        assert len((r.text or "").split("\n")) >= want[r.doc_id][0] - want[r.doc_id][1]
        assert r.n_chars == len(r.text)
    after = spark.createDataFrame(after.collect(), after.schema)

    texts = [(r.doc_id, r.text) for r in after.collect()]
    roots = near_classes(texts)
    single = near(spark, after, sf)
    assert single.columns == cols
    assert {r.doc_id for r in single.collect()} == {k for k, v in roots.items() if k == v}
    single = spark.createDataFrame(single.collect(), single.schema)

    items = [decontaminate.normalised(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    rest = {r.doc_id for r in clean(spark, single, sf).collect()}
    for r in single.collect():
        if any(i in decontaminate.normalised(r.text or "") for i in items):
            assert r.doc_id not in rest
    assert len(rest) >= 0.9 * single.count()

    packed = pack(spark, single, sf).collect()
    seqs = defaultdict(int)
    for r in packed:
        seqs[r.sequence_id] += r.length
    assert max(seqs.values()) <= 4096 and {r.doc_id for r in packed} == {r.doc_id for r in single.collect()}


def odd_ids(spark, sf, texts):
    """Rows of the documents' schema with these (doc_id, text, lang)."""
    schema = spark.read.parquet(f"{sf}/documents.parquet").schema
    values = lambda i, t, lang: {"doc_id": i, "text": t, "lang": lang, "n_chars": len(t) if t is not None else None}
    return spark.createDataFrame([tuple(values(*x).get(c) for c in schema.names) for x in texts], schema)


def test_near_dedup_with_repeated_and_null_ids(spark, sf):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(40)) for x in "abcd")
    rows = [(7, a, "x"), (7, a, "x"), (8, b, "p"), (8, b + " end", "q"), (9, c, "x"), (None, d, "x"), (None, d, "y"), (None, d + " end", "x"), (None, c, "x"), (10, None, "x"), (10, None, "y"), (None, None, "x")]
    out = corpus_pipeline.dedup_near(spark, odd_ids(spark, sf, rows), sf)
    assert out.columns == spark.read.parquet(f"{sf}/documents.parquet").columns
    got = [(r.doc_id, r.text) for r in out.collect()]
    assert sorted(got, key=str) == sorted([(7, a), (8, b), (None, c), (None, d), (10, None), (10, None), (None, None)], key=str)


def test_line_dedup_with_repeated_and_null_ids(spark, sf):
    p, q = "one\ntwo\nthree", "four\nfive\nsix"
    rows = [(5, p, "x"), (5, p, "y"), (6, f"{q}\nu", "x"), (6, f"{q}\nv", "y"), (6, f"{q}\nz", "w"), (None, f"{q}\nn", "x"), (None, f"m\n{p}", "y"), (8, f"{q}\nt", "x"), (8, f"{p}\ns", "y"), (9, None, "x")]
    out = corpus_pipeline.dedup_lines(spark, odd_ids(spark, sf, rows), sf)
    assert out.columns == spark.read.parquet(f"{sf}/documents.parquet").columns
    got = sorted(((r.doc_id, r.text, r.lang, r.n_chars) for r in out.collect()), key=str)
    want = [(None, f"{q}\nn", "x"), (None, f"m\n{p}", "y"), (6, "u", "x"), (6, "v", "y"), (6, "z", "w"), (8, "t", "x"), (8, "s", "y"), (9, None, "x")]
    # two equal rows: either may be the later one
    assert [g for g in got if g[0] != 5] == sorted([(*w, len(w[1]) if w[1] is not None else None) for w in want], key=str)
    assert [g[:2] for g in got if g[0] == 5] == [(5, ""), (5, "")]  # the null row comes first and holds the lines


def test_repeated_rows_keep_their_lines_once(spark, sf):
    p = "one\ntwo\nthree"
    out = corpus_pipeline.dedup_lines(spark, odd_ids(spark, sf, [(5, p, "x"), (5, p, "x"), (5, f"{p}\nend", "x")]), sf)
    assert sorted((r.text, r.n_chars) for r in out.collect()) == [("", 0), ("end", 3), (p, len(p))]


def test_stages_with_clashing_columns_and_odd_rows(spark, sf):
    """Columns of any name come through every stage; null, empty, repeated and very long texts too; an empty table stays empty."""
    names = ["score", "lang_pred", "ambiguous", "kept", "_kept_id", "_gone_id", "_key", "_text", "_doc", "_id", "doc", "spans", "b", "sequence_id", "cell"]
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(60)
    odd = odd_ids(spark, sf, [(None, None, "en"), (None, "", "en"), (3, "", None), (3, "", None), (4, "the and of that " * 20000, "en")]).select(docs.columns)
    rows = docs.unionByName(odd)
    for i, n in enumerate(names):
        rows = rows.withColumn(n, F.lit(f"x{i}"))
    total = rows.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, rows, sf)
        assert out.columns == rows.columns, name
        got = out.collect()
        assert 0 < len(got) <= total and all(r[n] == f"x{i}" for r in got for i, n in enumerate(names)), name
        assert stage(spark, rows.limit(0), sf).collect() == [], name
    packed = corpus_pipeline.pack(spark, rows, sf).collect()
    assert sum(r.start == 0 for r in packed) == total
    assert corpus_pipeline.pack(spark, rows.limit(0), sf).collect() == []


def test_run_equals_the_stages(spark, sf):
    out = corpus_pipeline.run(spark, sf).collect()
    assert out and out[0].asDict().keys() == {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"}


def test_a_large_cell_is_cut_into_shingles_part_by_part():
    rnd = np.random.default_rng(1)
    texts = [" ".join(map(str, rnd.integers(0, 10**9, 1600))) for _ in range(500)]
    texts[499] = texts[7]
    cell = pa.RecordBatch.from_arrays([pa.array(np.zeros(500, np.int64)), pa.array(np.arange(500)), pa.array(np.arange(500)), pa.array([i in (7, 8) for i in range(500)]), pa.array(texts)], names=["cell", "_key", "root", "ask", "_text"])
    tracemalloc.start()
    out = [r for b in minhash._linked(0.8)(iter([cell])) for r in b.to_pylist()]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert out == [{"a": 7, "b": 499}]
    assert peak < 15 * sum(map(len, texts))
    data, offs = minhash.text_bytes(cell.column("_text"))
    assert all(np.array_equal(x, y) for x, y in zip(minhash.elements(data, offs), minhash.shingles(data, offs)[:3], strict=True))


def test_stages_hand_over_batches_of_few_bytes(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    long = spark.range(0, 6000, 1, 1).selectExpr("id", "repeat('abcdefghij', 300) AS t")

    def measured(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes]), pa.array([b.num_rows])], names=["n", "rows"])

    for _, stage in corpus_pipeline.STAGES:
        spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
        stage(spark, docs.limit(5), sf)
        got = long.mapInArrow(measured, "n long, rows long").collect()
        assert sum(r.rows for r in got) == 6000 and max(r.n for r in got) < 5 << 20
