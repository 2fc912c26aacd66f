"""Queries that SQL cannot express, against plain Python over the same tables."""

from __future__ import annotations

import hashlib
import html
import math
import re
import unicodedata
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from millrace import queries as Q
from millrace.functions import spans as S
from millrace.functions import text as X
from millrace.operators import select
from millrace.sources import readers


@pytest.fixture(scope="module")
def docs(spark, sf):
    return [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]


@pytest.fixture(scope="module")
def pairs(spark, sf):
    rows = {(r.conv_id, r.turn): r.text or "" for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()}
    return {k: (t, rows[k[0], k[1] + 1]) for k, t in rows.items() if (k[0], k[1] + 1) in rows}


def test_numbers(spark, sf, docs):
    number = re.compile(r"(?<![A-Za-z0-9_])[-+]?\d[\d,.:/%+\-]*\d|(?<![A-Za-z0-9_])[-+]?\d(?![0-9])", re.ASCII)
    sign = re.compile(r"(?<![A-Za-z0-9_])[+\-±−＋－]\s*(?=[0-9])")
    got = {r.doc_id: (r.numbers, r.signs, r.units) for r in Q.queries()["numeric_values"](spark, sf).collect()}
    assert got == {i: (len(number.findall(t)), len(sign.findall(t)), len(S.units_of(t))) for i, t in docs}
    assert sum(n for n, *_ in got.values()) > 10


def test_degenerate_turns(spark, sf, pairs):
    def reasons(s, t):
        t = t.strip()
        if not t:
            return "empty"
        out = ["character_repetition"] if re.search(r"(.)\1{4,}", re.sub(r"\s+", "", t)) else []
        out += ["phrase_repetition"] if re.search(r"(.{2,12})(?:[\s,.!?~·ㆍ-]*\1){3,}", t) else []
        return ",".join(out + (["excessive_length"] if len(t) > max(48, 3 * len(s.strip()) + 10) else []))

    got = {(r.conv_id, r.turn): r.reasons for r in Q.queries()["degenerate_turns"](spark, sf).collect()}
    assert got == {k: reasons(*v) for k, v in pairs.items()} and any(got.values())


def test_chrf_and_bleu_statistics(spark, sf, pairs):
    m, h, r = Counter(), Counter(), Counter()
    for b, a in pairs.values():  # the reply is the output, the turn before it the reference
        a, b = "".join(a.split()), "".join(b.split())
        for n in range(1, 7):
            x, y = (Counter(t[i : i + n] for i in range(len(t) - n + 1)) for t in (a, b))
            m[n] += sum((x & y).values())
            h[n] += sum(x.values())
            r[n] += sum(y.values())
    p, q = (sum(m[n] / d[n] for n in range(1, 7)) / 6 for d in (h, r))
    assert Q.queries()["chrf_scores"](spark, sf).first().chrf == pytest.approx(500 * p * q / (4 * p + q), abs=1e-4)
    stats = defaultdict(Counter)
    for (_, turn), (b, a) in pairs.items():
        a, b = ([c for c in t if not c.isspace()] for t in (a, b))
        c = stats[turn >= 4]
        c["h"], c["r"] = c["h"] + len(a), c["r"] + len(b)
        for n in range(1, 5):
            x, y = (Counter(tuple(t[i : i + n]) for i in range(len(t) - n + 1)) for t in (a, b))
            c[f"m{n}"] += sum((x & y).values())
            c[f"t{n}"] += sum(x.values())
    for row in Q.queries()["bleu_scores"](spark, sf).collect():
        c = stats[row.late]
        want = math.exp(min(0.0, 1 - c["r"] / c["h"])) * math.exp(sum(math.log(c[f"m{n}"] / c[f"t{n}"]) for n in range(1, 5)) / 4)
        assert row.by_character == pytest.approx(100 * want, abs=1e-4)


def test_span_caps_equal_a_pass_in_order(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang", "source", F.length("text").alias("n"), select.seeded("greedy", F.col("doc_id").cast("string")).alias("rank")).collect()
    used, want = Counter(), set()
    for r in sorted(rows, key=lambda r: r["rank"]):
        if r.n is not None and used[r.lang, r.source, int(math.log2(r.n + 1))] < 2:
            used[r.lang, r.source, int(math.log2(r.n + 1))] += 1
            want.add(r.doc_id)
    got = {r.doc_id for r in Q.queries()["greedy_span_caps"](spark, sf).collect() if r.n is not None}
    assert got == want


def test_budget_samples_are_whole(spark, sf):
    assert Q.queries()["budget_sample"](spark, sf).count() == 100
    few = spark.range(1000).select("id", F.concat(F.lit("t"), F.col("id") % 7).alias("t"))
    for seed in "abcdef":
        out = select.sample_to_budget(few, F.col("t"), 300, seed)
        assert out.count() == 300
    assert select.sample_to_budget(few, F.col("t"), 5000, "x").count() == 1000 and select.sample_to_budget(few.limit(0), F.col("t"), 5, "x").count() == 0


def test_approximate_distinct_is_near(spark, sf):
    exact = {r.source: r.n for r in spark.read.parquet(f"{sf}/documents.parquet").groupBy("source").agg(F.count_distinct("text").alias("n")).collect()}
    for r in Q.queries()["approximate_distinct"](spark, sf).collect():
        assert abs(r.texts - exact[r.source]) <= max(1, 0.03 * exact[r.source])
    many = spark.range(200_000).select(F.hll_sketch_estimate(F.hll_sketch_agg(F.col("id").cast("string"), 14)).alias("n")).first().n
    assert abs(many - 200_000) <= 0.03 * 200_000


def test_pages_and_segments(spark, sf, docs):
    for r in spark.read.parquet(f"{sf}/pages.parquet").select("html", readers.visible_text("html").alias("t")).limit(40).collect():
        plain = re.sub(r"(?is)<(script|style|template|noscript|head)\b.*?</\1\s*>|<!--.*?-->", " ", r.html)
        assert r.t == " ".join(html.unescape(re.sub(r"<[^>]+>", " ", plain)).split())
    got = {r.doc_id: (r.segments, r.longest) for r in Q.queries()["text_segments"](spark, sf).collect()}
    for i, t in docs:
        parts = readers.segment(t)
        assert got.get(i, (0, None)) == (len(parts), max(map(len, parts), default=None))
        assert all(2 <= len(p) <= 400 for p in parts) and len("".join("".join(parts).split())) >= len("".join(t.split())) - t.count("\n") - t.count(". ") - 2


def test_normal_forms_that_change_a_text(spark):
    texts = ["é ﬁ ｶﾞ", "ＡＢＣ　１２", "①²½", "가", "ΐ ŉ", "  a 　b "]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", X.canonical_text(F.col("t")).alias("c"), X.canonical_nfkc(F.col("t")).alias("k"), X.comparison_key(F.col("t")).alias("p"), X.surface_key(F.col("t")).alias("s"))
    for r in df.collect():
        assert r.c == " ".join(unicodedata.normalize("NFC", r.t).split()) and r.k == " ".join(unicodedata.normalize("NFKC", r.t).split())
        n = unicodedata.normalize("NFKC", r.t)
        assert r.p == "".join(c for c in n if unicodedata.category(c)[0] not in "PSZC")
        assert r.s == "".join(c for c in r.k if unicodedata.category(c)[0] in "LN").casefold()


def test_split_fractions(spark, sf, docs):
    got = {r.doc_id: r.u for r in Q.queries()["split_fraction"](spark, sf).collect()}
    for i, t in docs:
        key = " ".join(unicodedata.normalize("NFKC", t).split())
        assert got[i] == int(hashlib.sha256(key.encode()).hexdigest()[:16], 16) / 2**64
