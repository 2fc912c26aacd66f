from __future__ import annotations

import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from millrace import queries
from millrace.functions import spans as S
from millrace.functions import text as X
from millrace.operators import audit, dedup, evaluate, generate, glossary, leakage, quality, select
from millrace.plans import prepare
from millrace.sources import readers, sinks
from millrace.streaming import queue


def one(spark, *values, **cols):
    """The named expressions over one row of string columns a, b, c."""
    df = spark.createDataFrame([values], ", ".join(f"{c} string" for c in "abc"[: len(values)]))
    return df.select(*[v.alias(k) for k, v in cols.items()]).first().asDict()


@pytest.fixture(autouse=True)
def columns(spark):
    """A, B and C are columns a, b and c; they can be made only while a session runs."""
    globals().update(A=F.col("a"), B=F.col("b"), C=F.col("c"))


def test_normal_forms_and_scripts(spark):
    r = one(spark, "  ｶﾞ　が x ", nfc=X.canonical_text(A), nfkc=X.canonical_nfkc(A), key=X.comparison_key(A), kana=X.kana_count(A), visible=X.visible_length(A))
    assert r == {"nfc": "ｶﾞ が x", "nfkc": "ガ が x", "key": "ガがx", "kana": 3, "visible": 5}
    r = one(spark, "한국어 日本 カナ abc 1", scripts=X.scripts_in(A), foreign=X.foreign_scripts(A, ["ja"]), none=X.foreign_scripts(A, []), mono=X.is_monolingual(A, ["any"]))
    assert r == {"scripts": ["han", "hangul", "kana", "latin"], "foreign": ["hangul", "latin"], "none": [], "mono": True}
    assert one(spark, "甘い 香り が a b 가 나", x=X.collapse_spaces(A), n=X.spurious_spaces(A)) == {"x": "甘い香りが a b 가 나", "n": 2}
    with pytest.raises(ValueError):
        X.resolve_scripts(["klingon"])


def test_registers(spark):
    for text, lang, level in (("감사합니다.", "ko", 2), ("하십시오!", "ko", 3), ("한다", "ko", 1), ("そうです。", "ja", 2), ("いたします", "ja", 3), ("hello", "en", 0), ("음", "ko", 0)):
        assert one(spark, text, r=X.register(A, lang))["r"] == level


def test_repetition_and_degeneration(spark):
    assert one(spark, "abcabcabcabcabc", r=X.excessive_repetition(A))["r"]
    assert not one(spark, "abcabcabcab", r=X.excessive_repetition(A))["r"]
    assert one(spark, "aaaaaaaaaaaab", r=X.excessive_repetition(A, phrases=False))["r"]
    assert one(spark, "hi", "", r=X.degeneration_reasons(A, B))["r"] == ["empty"]
    assert "excessive_length" in one(spark, "hi", "ab cd ef gh " * 10, r=X.degeneration_reasons(A, B))["r"]
    for source, output, reason in (("マジ", "안 돼, 안 돼, 안 돼, 안 돼, 안 돼", "phrase_repetition"), ("x", "haha, haha, haha, haha", "phrase_repetition"), ("ああ", "아" + "~" * 48, "character_repetition"), ("短い", "가" * 60, "excessive_length")):
        assert reason in one(spark, source, output, r=X.degeneration_reasons(A, B))["r"]
    assert one(spark, "x", " " * 60, r=X.degeneration_reasons(A, B))["r"] == ["empty"] and one(spark, "안녕", "こんにちは", r=X.degeneration_reasons(A, B))["r"] == []


def test_numbers_signs_units(spark):
    r = one(spark, "값 38,720원, -5 and ±３ at 10:30, utf8 v2", n=X.numeric_tokens(A), s=X.sign_markers(A), u=S.unit_tokens(A))
    assert r == {"n": ["38720", "-5", "3", "10:30"], "s": ["-", "±"], "u": ["won"]}
    assert S.units_of("5 mg/L and 3 config 7g x 원조 8 levels") == ["milligram_per_litre", "gram"]
    r = one(spark, "1 2", "2 3", "2 9", x=X.numeric_corruption(A, B, C))
    assert r["x"].asDict() == {"invented": 1, "dropped": 0}


def test_bags(spark):
    bag = lambda c: F.split(c, " ")
    assert one(spark, "a a b", "a b b", f=X.bag_f1(bag(A), bag(B)), j=X.bag_jaccard(bag(A), bag(B)), o=X.bag_overlap(bag(A), bag(B))) == {"f": pytest.approx(2 / 3), "j": 0.5, "o": 2}
    none = F.array().cast("array<string>")
    assert one(spark, "a", f=X.bag_f1(none, none), g=X.bag_f1(bag(A), none), j=X.bag_jaccard(none, none)) == {"f": 1.0, "g": 0.0, "j": 1.0}


def test_shingles_and_splits(spark):
    r = one(spark, "ab cd efg", "abc", "", x=X.char_shingles(A), y=X.char_shingles(B), z=X.char_shingles(C))
    assert r == {"x": ["abcde", "bcdef", "cdefg"], "y": ["abc"], "z": []}
    import hashlib

    u = int.from_bytes(hashlib.sha256(b"key").digest()[:8], "big") / 2**64
    assert one(spark, "key", u=X.unit_fraction(A))["u"] == u
    rows = spark.range(20000).select(X.split_of(F.col("id").cast("string"), 0.1, 0.05).alias("s")).groupBy("s").count().collect()
    n = {r["s"]: r["count"] for r in rows}
    assert abs(n["validation"] - 2000) < 200 and abs(n["test"] - 1000) < 150
    with pytest.raises(ValueError):
        X.split_of(A, 0.4, 0.2)


def test_spans_of_localised_strings(spark):
    text = '{ DATETIME($date, month: "long", year: "numeric") } { -brand(case: "accusative") } %CasterName %2$Spx &#39; &#x27;'
    found = {(s.kind, s.surface) for s in S.candidates(text)}
    assert {("placeable", '{ DATETIME($date, month: "long", year: "numeric") }'), ("placeable", '{ -brand(case: "accusative") }'), ("entity", "&#39;"), ("entity", "&#x27;")} <= found
    assert {("percent_placeholder", "%CasterName"), ("printf", "%2$S")} <= found and ("percent_placeholder", "%C") not in found
    assert [(s.kind, s.surface) for s in S.disjoint(S.candidates('API foo.bar $5 - 10 v2 <a title="x>y">'))] == [
        ("identifier", "API"), ("identifier", "foo.bar"), ("number", "$5 - 10"), ("identifier", "v2"), ("html", '<a title="x>y">'),
    ]
    assert [s.kind for s in S.candidates("{ open ${A} \\${B} <slot_1> < b")] == ["template", "identifier"]
    assert S.compared("{ $VERSION } ${BUILD_ID} &Aacute;", "{ $version } ${build_id} &aacute;") == (0.0, True)
    score, critical = S.compared('<a title="{ $name }">{ $name }</a>', '<a title="{ $other }">{ $name }</a>')
    assert score < 1 and critical
    assert S.compared("none", "here") == (1.0, False) and S.keys_of("5 kg AB-12", numbers=False) == ["identifier\0AB-12"]


def test_masks_and_shared_slots(spark):
    source = "용량은 50MB, 약은 250mg이며 https://example.com/issues/102181에서 확인한다."
    text, slots = S.mask_text(source)
    assert set(slots.values()) == {"50MB", "250mg", "https://example.com/issues/102181"} and "에서 확인한다" in text
    assert S.restore_text(text, slots) == (source, [])
    assert S.restore_text("lost", {"<slot_0>": "x"}) == ("lost", ["<slot_0>"])
    text, slots = S.mask_text("배송비는 12,500원이고 수량은 3개이며 용량은 250mg이다.")
    assert "원" in text and "개" in text and set(slots.values()) == {"12,500", "3", "250mg"}
    a, b = S.share_slots("코드 A-0, 값 0과 10을 확인한다.", "コードA-0、値0と10を確認する。")
    assert a.count("<slot_") == b.count("<slot_") == 3 and "<slot_<slot_" not in a + b
    many = " ".join(f"{i}.5" for i in range(80))
    masked = S.mask(A)
    r = one(spark, many, m=masked, back=S.restored(masked["text"], masked["slots"]))
    assert len(r["m"]["slots"]) == 64 and r["back"] == many
    r = one(spark, "a {x} 5", "b {x} 6", "c {y} 5", same=S.similarity(A, B), other=S.similarity(A, C), spans=S.spans(A))
    assert r["same"].asDict() == {"score": pytest.approx(1 / 3), "critical": False} and r["other"]["critical"]
    assert [(s.start, s.end, s.kind, s.key) for s in r["spans"]] == [(2, 5, "placeholder", "placeholder\0{x}"), (6, 7, "number", "number\0005")]
    assert one(spark, "a {x}", "{x} b", r=S.shared_slots(A, B))["r"].asDict() == {"a": "a <slot_0>", "b": "<slot_0> b"}
    none = one(spark, None, "x", m=S.mask(A), s=S.shared_slots(A, B), k=S.tokens(A))
    assert none["m"]["text"] is None and none["s"].asDict() == {"a": None, "b": "x"} and none["k"] == []


def test_length_scores_and_frames(spark):
    assert one(spark, "a b c d", "abcd", r=X.length_score(A, B))["r"] == 1.0
    assert one(spark, '값은 "0.5 mg"이고 3개다.', r=X.skeleton(A))["r"] == "값은 <Q>이고 #개다."
    assert one(spark, "「괄호」 “섞인'", r=X.skeleton(A), q=X.quoted_spans(A)) == {"r": "「괄호」 <Q>", "q": ["“섞인'"]}


def test_pair_quality_rules(spark):
    rows = [
        ("안녕하세요 여러분", "みなさんこんにちは", None), ("가", "あ", "expressive_v1"), ("가", "あ", None), ("같은 글입니다", "같은 글입니다", None), ("안녕하세요", "全然日本語漢字漢字漢字漢字漢字", None),
        ("hello there", "みなさん", None), ("안녕 \x01 하세요", "こんにちは", None), ("가나다라마바사", "あ", None), ("야" * 20, "あいうえお", "expressive_v1"),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, ko string, ja string, p string")
    out = {r.i: r for r in quality.assess(df, "ko", "ja", profile="p").collect()}
    assert out[0].accepted and out[0].score == 100
    assert out[1].accepted and out[1].score == 100
    assert out[2].rejections == ["too_short"] and out[2].score == 55
    assert "identical_text" in out[3].rejections and "ja_script_mismatch" in out[3].rejections
    assert "ja_no_kana" in out[4].warnings
    assert out[5].rejections == ["ko_script_mismatch"]
    assert out[6].rejections == ["control_characters"]
    assert set(out[7].rejections) == {"too_short", "length_ratio"}
    assert out[8].rejections == [] and out[8].accepted
    assert [r.i for r in quality.gate(quality.assess(df, "ko", "ja"), False).orderBy("i").collect()] == [0, 1, 2, 3, 4, 5, 7, 8]
    with pytest.raises(ValueError):
        quality.Policy(most_ratio=1)


def test_ui_reasons(spark):
    cases = {
        ("", "x", "r"): "empty", ("가" * 801, "あ", "r"): "too_long", ("abc def", "ABC def", "r"): "missing_expected_script", ("가!", "あいう", "r"): "too_short", ("가나", "あいうえおかきくけこさ", "r"): "length_ratio",
        ("가나 {x}", "あい {y}", "r"): "placeholder_mismatch", ("가나 <B id='x'>", "<b> あい", "r"): None, ("가나 1", "あい 2", "r"): "number_mismatch", ("파일a", "あい", "menu.key"): "access_key", ("파일a", "あい", "menu"): None,
        ("가あ 나", "가あ  나", "r"): "identical", ("가나다", "あいう", "r"): None, ("가나다 { $a }", "あいう {$a}", None): None,
    }
    df = spark.createDataFrame(list(cases), "a string, b string, c string")
    assert {(r.a, r.b, r.c): r.x for r in df.withColumn("x", quality.ui_reason(A, B, C)).collect()} == cases


def test_guard_keeps_endpoints_on_one_side(spark):
    rnd = random.Random(1)
    rows = [(i, f"s{rnd.randrange(40)}", f"t{rnd.randrange(40)}", rnd.choice(["train", "test"])) for i in range(300)]
    df = spark.createDataFrame(rows, "line int, ea string, eb string, split string")
    kept = dedup.guarded(df, "split", ["ea", "eb"], ["line"]).collect()
    sides: dict[str, set[str]] = {}
    for r in kept:
        for e in (r.ea, r.eb):
            sides.setdefault(e, set()).add(r.split)
    assert kept and all(len(v) == 1 for v in sides.values())


def test_first_owner_caps_and_matching(spark):
    df = spark.createDataFrame([(3, "x"), (1, "x"), (2, "y"), (2, "y")], "line int, t string")
    assert sorted(r.line for r in dedup.first_owner(df, F.col("t"), ["line"]).collect()) == [1, 2, 2]
    rnd = random.Random(2)
    rows = [(f"f{rnd.randrange(6)}", f"s{rnd.randrange(3)}", i) for i in range(200)]
    df = spark.createDataFrame(rows, "frame string, style string, i int")
    rank = select.seeded("x", F.col("i").cast("string"))
    got = {r.i for r in select.frame_caps(df, ["style"], ["frame"], 12, 4, rank).collect()}
    order = [r for r in df.withColumn("r", rank).orderBy("r").collect()]
    frames, styles, want = Counter(), Counter(), set()
    for r in order:
        if frames[r.style, r.frame] < 4 and styles[r.style] < 12:
            frames[r.style, r.frame] += 1
            styles[r.style] += 1
            want.add(r.i)
    assert got == want
    edges = [(f"a{rnd.randrange(30)}", f"b{rnd.randrange(30)}", rnd.random(), i) for i in range(150)]
    df = spark.createDataFrame(edges, "s string, t string, score double, i int")
    got = {r.i for r in select.unique_matching(df, "s", "t", "score", F.col("i")).collect()}
    used, want = set(), set()
    for s, t, _, i in sorted(edges, key=lambda e: (-e[2], e[3])):
        if ("s", s) not in used and ("t", t) not in used:
            used |= {("s", s), ("t", t)}
            want.add(i)
    assert got == want


def test_matching_takes_every_round_it_needs(spark, monkeypatch):
    n = 33
    block = spark.createDataFrame([(f"s{i:02}", f"t{j:02}", 1.0) for i in range(n) for j in range(n)], "s string, t string, dice double")
    by_text = F.concat_ws("\0", "s", "t")  # a match a round
    assert {(r.s[1:], r.t[1:]) for r in select.unique_matching(block, "s", "t", "dice", by_text).collect()} == {(f"{i:02}", f"{i:02}") for i in range(n)}
    with pytest.raises(RuntimeError, match="edges are left"):
        select.unique_matching(block, "s", "t", "dice", by_text, most_rounds=3)
    monkeypatch.setattr(queries, "_mined", lambda spark, d: block)
    got = queries.greedy_matching(spark, "").collect()
    assert len(got) == len({r.s for r in got}) == len({r.t for r in got}) == n
    order = block.orderBy(select.seeded("matching", F.col("s"), F.col("t"))).collect()
    used, want = set(), set()
    for r in order:
        if r.s not in used and r.t not in used:
            used |= {r.s, r.t}
            want.add((r.s, r.t))
    assert {(r.s, r.t) for r in got} == want


def test_leaks(spark):
    items = spark.createDataFrame([("1", "김칫국부터 마시지 마."), ("2", "전혀 다른 문장입니다")], "item_id string, text string")
    rows = spark.createDataFrame([(10, "또 김칫국부터 마시지 마…"), (11, "관계없는 줄")], "doc_id int, text string")
    out = leakage.leaks(items, rows).collect()
    assert [(r.item_id, r.doc_id, r.containment, r.exact) for r in out] == [("1", 10, 1.0, True)]
    rnd = random.Random(9)
    texts = [(i, "".join(rnd.choice("abcd") for _ in range(rnd.randint(1, 30)))) for i in range(60)]
    df = spark.createDataFrame(texts, "doc_id int, text string")
    held = df.filter("doc_id < 20").withColumnRenamed("doc_id", "item_id")
    grams = lambda t: {t[i : i + 3] for i in range(len(t) - 2)} if len(t) > 3 else {t}
    for least in (0.3, 0.6, 1.0):
        want = {(i, j, len(grams(s) & grams(t)), s in t and grams(s) <= grams(t)) for i, s in texts[:20] for j, t in texts if len(grams(s) & grams(t)) >= least * len(grams(s))}
        for sent in (0, 10**6):  # by a join, and by one pass
            assert {(r.item_id, r.doc_id, r.shared, r.exact) for r in leakage.leaks(held, df, least=least, most_sent=sent).collect()} == want
    assert leakage.leaks(held.limit(0), df).collect() == [] and leakage.leaks(held, df.limit(0)).collect() == []
    cases = spark.createDataFrame([("c", "x", "ko", "ja", "a b", "c d")], "id string, category string, source_language string, target_language string, source string, reference string")
    assert [(r.item_id, r.language) for r in leakage.holdout_items(cases).collect()] == [("c#source", "ko"), ("c#reference", "ja")]


def test_contamination(spark):
    f = lambda d=("ko", "ja"): leakage.contamination(A, B, d)
    rules = lambda a, b: [x.rule for x in one(spark, a, b, f=f())["f"]]
    assert rules("씨 발 진짜", "種まきだ") == ["known_literal_mistranslation", "profanity_intensity_lost"]
    assert one(spark, "씨발 덥다", "種まき暑い", r=leakage.repaired(A, B))["r"] == "くそ暑い"
    assert one(spark, "좆 덥다", "種 暑い", r=leakage.repaired(A, B))["r"] is None and one(spark, "덥다", "種まき", r=leakage.repaired(A, B))["r"] is None
    assert [x.evidence for x in one(spark, "개새끼 닥쳐", "犬だ", f=f())["f"]] == [["개새끼", "犬"], ["개새끼", "닥쳐"]]
    assert rules("붕어빵 먹자", "たい焼きを食べよう") == []
    assert rules("아빠랑 붕어빵이네", "たい焼きだね") == ["literal_idiom"]
    assert rules("개 소리가 들려", "犬の声がする") == [] and rules("개소리 마", "犬の声") == ["dog_prefix_literal"] and rules("새끼 개", "子犬") == []
    assert rules("닥쳐", "静かに") == ["profanity_intensity_lost"] and rules("닥쳐", "黙れ") == []
    assert one(spark, "a", "b", f=f(("en", "de")))["f"] is None
    assert one(spark, "x", s=leakage.screen(A, (), ("a",)))["s"] == "unscreened"


def test_audits(spark):
    df = spark.createDataFrame([("f", 1), ("f", 2), ("g", 2), ("g", None)], "file string, n int")
    out = {(r.file, r.is_total): (r.rows, r.s) for r in audit.with_total(df, "file", F.count("*").alias("rows"), F.sum("n").alias("s")).collect()}
    assert out == {("f", 0): (2, 3), ("g", 0): (2, 2), (None, 1): (4, 5)}
    values = [5, 1, 9, 7, 3, 3, 8]
    df = spark.createDataFrame([(v,) for v in values], "v int")
    got = audit.index_percentiles(df, "v", [0.1, 0.5, 0.95]).first()
    assert [got.p10, got.p50, got.p95] == [sorted(values)[round((len(values) - 1) * s)] for s in (0.1, 0.5, 0.95)]
    w = audit.water_fill({"big": 1000, "small": 10}, 5.0, 2.0)
    assert sum(w.values()) == pytest.approx(1) and w["small"] <= 2.0 * 10 / 1010 + 1e-9
    seen = spark.createDataFrame([("en", "a", 1), ("en", "b", 30)], "lang string, token string, n long")
    voc = spark.createDataFrame([("a",), ("b",), ("c",)], "token string")
    assert audit.exposure_buckets(seen, voc, ["lang"]).first().asDict() == {"lang": "en", "tokens": 31, "unseen": 1, "once": 1, "under_10": 1, "under_25": 1}


def test_chrf(spark):
    df = spark.createDataFrame([("the cat", "the cat"), ("ab", "ab")], "h string, r string")
    assert evaluate.chrf(df, "h", "r", []).first().chrf == 100
    assert evaluate.chrf(spark.createDataFrame([("xyz", "abc")], "h string, r string"), "h", "r", []).first().chrf == 0


def test_refinement_never_gets_worse(spark):
    state = spark.createDataFrame([(1, "a", 0.9), (2, "b", 0.1), (3, "c", 0.5)], "id int, text string, score double")
    revise = lambda df: df.withColumn("text", F.concat("text", F.lit("!")))
    score = lambda df: df.withColumn("score", F.when(F.col("id") == 2, F.col("_old") + 0.3).otherwise(F.col("_old") - 0.2))
    out = {r.id: (r.text, round(r.score, 2), r.stop_reason) for r in evaluate.refine(state, revise, score, 0.8, 0.05, 5).collect()}
    assert out == {1: ("a", 0.9, "accepted"), 2: ("b!!!", 1.0, "accepted"), 3: ("c", 0.5, "no_gain")}


def test_record_expansion():
    ex = lambda o, p=(("ko", "ja"), ("en", "ru")): readers.expand(json.dumps(o), list(p))
    assert ex({"ko": "가", "ja": "あ"})["pairs"] == [{"lang_a": "ko", "text_a": "가", "lang_b": "ja", "text_b": "あ", "metadata": "{}"}]
    assert len(ex({"ko": ["가", "나"], "ja": ["あ", "い"], "en": "x", "ru": "я"})["pairs"]) == 3
    nested = {"metadata": {"domain": "a", "bad": 1}, "records": [{"ko": "가", "ja": "あ", "domain": None}], "ru-en": {"items": [{"source": "я", "target": "x"}]}}
    got = ex(nested)["pairs"]
    assert json.loads(got[0]["metadata"]) == {"domain": None}
    assert (got[1]["lang_a"], got[1]["text_a"]) == ("en", "x")
    assert ex({"ko": "가"})["issues"] == ["missing_side"] and ex({"ko": "", "ja": "x"})["issues"] == ["empty_text"] and ex({"ko": 1, "ja": "x"})["issues"] == ["non_string_text"]
    assert readers.expand("{", [("ko", "ja")])["issues"] == ["invalid_json"] and ex([])["issues"] == ["no_pair"] and ex("x")["issues"] == ["not_an_object"]
    assert readers.normalize_pairs([("ko", "ja"), ("ja", "ko"), ("ko", "ja"), ("en", "de")]) == [("ko", "ja"), ("en", "de")]


def test_readers_and_pipeline(spark, tmp_path):
    good = [json.dumps({"ko": f"안녕하세요 여러분 {i}번째 문장", "ja": f"みなさんこんにちは{i}番目の文です"}, ensure_ascii=False) for i in range(40)]
    (tmp_path / "in.jsonl").write_bytes("﻿".encode() + "\n".join([*good, good[0], "{broken", '{"ko": "", "ja": "あ"}', ""]).encode() + b"\n\xff\xfe bad\n")
    raw = readers.json_lines(spark, str(tmp_path / "in.jsonl"))
    assert {r.status: r["count"] for r in raw.groupBy("status").count().collect()} == {"ok": 42, "invalid_json": 1, "blank": 1, "invalid_utf8": 1}
    rows = prepare.records(spark, [str(tmp_path / "in.jsonl")], [("ko", "ja")])
    assert {r.issue for r in rows.filter("issue IS NOT NULL").collect()} == {"invalid_json", "invalid_utf8", "empty_text"}
    out = prepare.prepared(rows, ("ko", "ja"), validation=0.2, test=0.2)
    got = out.collect()
    assert 20 <= len(got) <= 40 and len({r.text_a for r in got}) == len(got)
    target = str(tmp_path / "set")
    sinks.publish(out.select("text_a", "text_b", "score", "split"), target, ["split"])
    assert spark.read.parquet(target).count() == len(got)
    with pytest.raises(FileExistsError):
        sinks.publish(out.select("text_a", "split"), target, ["split"])
    with pytest.raises(Exception, match="bad line"):
        readers.json_lines(spark, str(tmp_path / "in.jsonl"), strict=True).collect()


def test_monolingual_and_segments(spark, tmp_path):
    (tmp_path / "mono/ko/deep").mkdir(parents=True)
    (tmp_path / "mono/ja").mkdir()
    (tmp_path / "mono/ko/deep/a.txt").write_text("한 문장. 두 문장.\n\n셋")
    (tmp_path / "mono/ja/b.jsonl").write_text('{"text": "あ。"}\n{"no": 1}\n{bad')
    rows = readers.monolingual(spark, str(tmp_path / "mono"))
    assert Counter((r.language, r.status) for r in rows.collect()) == {("ko", "ok"): 2, ("ko", "blank"): 1, ("ja", "ok"): 1, ("ja", "missing_key"): 1, ("ja", "malformed"): 1}
    assert prepare.foundation(rows).filter("language = 'ko'").count() == 1
    parts = readers.segment("One two three. " * 50 + "x" * 900, most=100)
    assert all(2 <= len(p) <= 100 for p in parts) and "".join(parts).replace(" ", "") == ("One two three. " * 50 + "x" * 900).replace(" ", "")


def test_archives_messages_and_pages(spark, tmp_path):
    import zipfile

    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("x/1.json", '{"a": {"b": "c"}}')
        z.writestr("x/2.txt", "no")
    got = readers.archive_members(spark, str(tmp_path / "a.zip"), suffix=".json").collect()
    assert [(r.member, bytes(r.content)) for r in got] == [("x/1.json", b'{"a": {"b": "c"}}')]
    assert readers.messages('{"a": {"b": "c"}, "d": "e", "n": 1}', "json") == {"a/b": "c", "d": "e"}
    assert readers.messages("# c\nk = v\n  more\nj=w", "ftl") == {"k": "v more", "j": "w"}
    assert readers.messages("! c\nk = v\n", "properties") == {"k": "v"}
    df = spark.createDataFrame([("<html><head><title>t</title></head><body>a &amp; <script>x</script> b</body></html>",), (None,)], "a string")
    assert [r.t for r in df.select(readers.visible_text("a").alias("t")).collect()] == ["a & b", None]


def test_queue_resumes_and_refuses_other_settings(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    (tmp_path / "in").mkdir()
    row = lambda i, **k: json.dumps({"id": f"r{i}", "source_lang": "ko", "target_lang": "ja", "source": f"문장 {i}"} | k, ensure_ascii=False)
    (tmp_path / "in/1.jsonl").write_text("\n".join([row(1), row(2, translation="済"), "{bad", row(3, source="")]))
    gate = lambda df: df.withColumn("reasons", F.array().cast("array<string>"))
    step = lambda df: queue.outcome(queue.parsed(df), gate)
    first = queue.run(spark, src, out, ck, step, model="m")
    assert first == [{"part": 0, "accepted": 1, "skipped_existing": 1, "error": 2}]
    (tmp_path / "in/2.jsonl").write_text(row(4))
    assert queue.run(spark, src, out, ck, step, model="m") == [{"part": 1, "accepted": 1}]
    assert queue.run(spark, src, out, ck, step, model="m") == []
    assert {r.part: r["rows"] for r in queue.integrity(spark, out).collect()} == {0: 4, 1: 1}
    with pytest.raises(ValueError):
        queue.run(spark, src, out, ck, step, model="other")


def test_glossary(spark):
    terms = {"machine": "Maschine", "machine learning": "maschinelles Lernen", "日本": "Japan"}
    m = glossary.Matcher(terms)
    assert [t for *_, t in m.find("machine learning machines machine 日本語")] == ["machine learning", "machine", "日本"]
    assert glossary.substitute("a machine", terms) == ("a <term_0>", {"<term_0>": "Maschine"})
    rows = spark.createDataFrame([("the machine", "die Maschine"), ("the machine", "nichts"), ("machine and 日本", "Maschine und Japan")], "s string, t string")
    got = sorted(tuple(x.source for x in r.terms) for r in glossary.hints(rows, "s", "t", terms).collect())
    assert got == [("machine",), ("日本", "machine")]
    p = glossary.Morphemes(("는", "을"))
    assert p.rejoin("나 는 밥 을 먹는다") == "나는 밥을 먹는다" and p.hole("는 간다") and p.stranded("나 는 간다") == ["는"]
    assert one(spark, "나 는 밥 을 먹는다", r=p.column(A))["r"] == "나는 밥을 먹는다"
    assert glossary.rewrite("밥 먹었어요.", {"어요": "어라", "었어요": "었당께"}) == "밥 먹었당께." and glossary.rewrite("음", {"어요": "x"}) is None


def test_generators(spark):
    rows = spark.createDataFrame([(i, f"source {i}", f"value {i}, then more words, here {i}") for i in range(200)], "id int, s string, t string")
    a, b = (sorted(map(str, generate.revisions(rows, "id", "s", "t").collect())) for _ in range(2))
    out = generate.revisions(rows, "id", "s", "t").collect()
    assert a == b and {r.kind for r in out} == set(generate.CORRUPTIONS)
    assert all(r.changed == (r.draft.strip() != r.t) for r in out) and all(r.draft == r.s for r in out if r.kind == "copy_source")
    only = generate.revisions(rows, "id", "s", "t", {"number": 1.0}).collect()
    assert all(r.kind == "number" and r.changed for r in only)
    with pytest.raises(ValueError):
        generate.revisions(rows, "id", "s", "t", {"nothing": 1.0})
    pairs = spark.createDataFrame([(f"s{i}", f"t{i}") for i in range(300)], "s string, t string")
    got = generate.concatenate(pairs, "s", "t").collect()
    assert {r.sentences for r in got} == {2, 3, 4} and all([x[1:] for x in r.s.split()] == [x[1:] for x in r.t.split()] for r in got)
    assert len({x for r in got for x in r.s.split()}) == sum(r.sentences for r in got) > 200
    made = generate.frames(spark, [("a {x} {y}", "b {x} {y}")], {"x": [("1", "eins"), ("2", "zwei")], "y": [("p", "q"), ("r", "s")]}, 3)
    assert made.count() == 3
    with pytest.raises(ValueError):
        generate.frames(spark, [("a {x}", "b")], {"x": [("1", "2")]}, 3)
    n = generate.numbers(spark, {k: 20 for k in generate.NUMBER_KINDS}, {k: ("a {v}", "b {v}") for k in generate.NUMBER_KINDS}).collect()
    assert Counter(r.kind for r in n) == {k: 20 for k in generate.NUMBER_KINDS} and len({r.source for r in n}) == len(n)
    for r in n:
        assert r.value and r.source[2:] == r.target[2:] == r.value
    with pytest.raises(ValueError, match="quotas"):
        generate.numbers(spark, {"technical": 500}, {"technical": ("a {v}", "b {v}")})
    with pytest.raises(Exception, match="numbers differ"):
        generate.numbers(spark, {"cardinal": 5}, {"cardinal": ("a {v}", "b 3")}).collect()


def test_manifests_rewrites_and_discovery(spark, tmp_path):
    rows = spark.range(50).selectExpr("id", "concat('t', id) AS t").repartition(3)
    path = str(tmp_path / "json")
    found = sinks.publish_json(rows, path)
    assert sum(f["rows"] for f in found.values()) == 50 and sinks.verified(spark, path).collect() == []
    with pytest.raises(FileExistsError):
        sinks.publish_json(rows, path)
    victim, other = sorted(tmp_path.joinpath("json").glob("part-*"))[:2]
    before = sinks.fingerprints(spark, path + "/part-*").collect()
    victim.write_text(victim.read_text() + '{"id": 99}\n')
    other.unlink()
    for p in tmp_path.joinpath("json").glob(".*.crc"):  # the file system's own check
        p.unlink()
    assert {r.problem for r in sinks.verified(spark, path).collect()} == {"digest", "missing"}
    after = sinks.fingerprints(spark, path + "/part-*")
    assert sorted(r.change for r in sinks.changed(spark.createDataFrame(before), after).collect()) == ["changed", "removed"]
    kept = str(tmp_path / "set")
    rows.write.parquet(kept)
    for n in (20, 30):
        sinks.rewrite(spark, kept, lambda df, n=n: df.filter(F.col("id") < n))
        assert spark.read.parquet(kept).count() == n
    (tmp_path / "mono/ko").mkdir(parents=True)
    (tmp_path / "mono/not-a-code").mkdir()
    (tmp_path / "mono/fr").mkdir()
    for name, text in (("ko/a.txt", "x"), ("ko/b.md", "x"), ("ko/c.jsonl", ""), ("fr/a.txt", "x"), ("not-a-code/a.txt", "x"), ("top.txt", "x")):
        (tmp_path / "mono" / name).write_text(text)
    found = readers.discover(spark, str(tmp_path / "mono"), ["ko", "ja"])
    assert {r.path.rsplit("mono/", 1)[1]: r.reason for r in found.collect()} == {"ko/a.txt": None, "ko/b.md": "suffix", "ko/c.jsonl": "empty", "fr/a.txt": "not_configured", "not-a-code/a.txt": "not_a_language", "top.txt": "top_level_file"}
    assert readers.without_data(found, ["ko", "ja"]) == ["ja"] and readers.foundation_languages(["ko", "kj", "ko", "ja"], ["kj"]) == ["ko", "ja"]
    (tmp_path / "k.jsonl").write_text('{"ko": "가", "ja": "あ"}\n{"x": 1}\n')
    (tmp_path / "l.jsonl").write_text('{"en": "a"}\n')
    lines = readers.json_lines(spark, str(tmp_path / "k.jsonl"), str(tmp_path / "l.jsonl"))
    assert {r.file[-7:]: (r.lines, r.expanding, r.usable) for r in readers.expands(lines, [("ko", "ja")]).collect()} == {"k.jsonl": (2, 1, True), "l.jsonl": (1, 0, False)}


def test_source_marks_are_cleaned(spark):
    r = one(spark, "&name1& (가)/(나) 안녕*", ">>12 > hello https://a.b/c  there", "これは12 「x", t=readers.cleaned(A, "transcript"), f=readers.cleaned(B, "forum"), v=readers.cleaned(C, "verse"))
    assert r == {"t": "안녕", "f": "> hello there", "v": "これは 「x"}
    df = spark.createDataFrame([(["short", "a longer line >>3", "a longer line"],)], "c array<string>")
    assert [x.text for x in readers.dialogue_lines(df, "c").collect()] == ["a longer line"]


def test_recovery_reasons(spark):
    rows = [(1, "나 는 밥을 먹는다", "私は ご飯を 食べる"), (2, "는 간다 오늘", "行くよ今日"), (3, None, "あいう"), (4, "나는 밥을 먹는다", "私はご飯を食べる"), (5, "나는 abc 먹는다", "私は食べるよ")]
    df = spark.createDataFrame(rows, "line int, ko string, ja string")
    out = {r.line: r.drop_reason for r in prepare.recovered(df, "ko", "ja", ("ko", "ja"), glossary.Morphemes(("는",))).collect()}
    assert out == {1: None, 2: "lost_word", 3: "missing_side", 4: "duplicate", 5: "foreign_script"}
