from __future__ import annotations

import json
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from millrace.functions import text as X
from millrace.operators import audit, evaluate, glossary, leakage, shards, tokens
from millrace.plans import build, prepare
from millrace.sources import checkpoints, readers
from millrace.streaming import queue


def test_generated_audit(spark):
    rows = [(f'값은 "{i}"이다', "あ") for i in range(4)] + [("같은 글", "あ"), ("같은 글", "い"), ("", "x"), ("a", None)]
    r = shards.generated_audit(spark.createDataFrame(rows, "s string, t string"), "s", "t", ["ko"], ["ja"]).first()
    assert (r.rows, r.unreadable, r.sources, r.skeletons, r.quoted, r.quoted_unique, r.max_targets) == (8, 2, 5, 2, 4, 4, 2)
    assert r.skeleton_ttr == round(2 / 6, 8) and r.duplicate_source == round(1 / 6, 8) and r.conflicting_source == 0.2 and r.foreign_target == 0
    assert r.violations == ["skeleton_ttr", "duplicate_source", "conflicting_source"]
    none = shards.generated_audit(spark.createDataFrame([], "s string, t string"), "s", "t").first()
    assert none.rows == 0 and none.violations == ["usable_rows"] and none.quoted_ttr == 1.0
    with pytest.raises(ValueError):
        shards.Thresholds(least_skeleton_ttr=2.0)


def test_recovery_select_equals_a_pass_in_order(spark):
    checkpoints.ensure(spark)
    rnd = random.Random(5)
    rows = [(i, f"s{rnd.randrange(15)}", f"t{rnd.randrange(15)}", rnd.choice([None, rnd.random()]) if rnd.random() < 0.2 else rnd.random()) for i in range(120)]
    df = spark.createDataFrame(rows, "i int, s string, t string, score double")
    got = {r.i: r.drop_reason for r in shards.recovery_select(df, "s", "t", "score", 0.2, most_targets=9).collect()}
    many = {s for s, n in Counter(s for _, s, _, v in rows if v is not None).items() if n > 9}
    want, used_s, used_t = {}, set(), set()
    for i, s, t, v in sorted(rows, key=lambda r: -(r[3] or 0)):
        if v is None:
            want[i] = "missing_score"
        elif s in many:
            want[i] = "fan_out"
        elif v < 0.2:
            want[i] = "below_threshold"
        elif s in used_s or t in used_t:
            want[i] = "lost"
        else:
            used_s.add(s)
            used_t.add(t)
            want[i] = None
    assert {i: "lost" if r in ("duplicate_source", "duplicate_target") else r for i, r in got.items()} == want
    assert {"fan_out", "below_threshold", "lost", None} <= set(want.values())


def test_verified_joins(spark):
    a = spark.createDataFrame([("G1", "1", "x"), ("G1", "2", "y"), ("G2", "1", "z"), ("G3", "1", "w")], "chapter string, verse string, text string")
    b = spark.createDataFrame([("G1", "2", "Y"), ("G1", "1", "X"), ("G2", "1", "Z"), ("G2", "2", "-"), ("G3", "1", "W")], "chapter string, verse string, text string")
    out = shards.aligned(a, b, "chapter", "verse", excluded=F.col("chapter") == "G3")
    assert sorted((r.a, r.b) for r in out.collect()) == [("x", "X"), ("y", "Y")]
    assert shards.one_sided(a.selectExpr("chapter || verse AS k"), b.selectExpr("chapter || verse AS k"), "k").first().asDict() == {"only_a": 0, "only_b": 1}
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id int, t string")
    fixes = spark.createDataFrame([(2, "B")], "id int, t string")
    assert sorted((r.id, r.t, r.was_corrected) for r in shards.corrected(rows, fixes, "id", ["t"]).collect()) == [(1, "a", False), (2, "B", True)]
    with pytest.raises(Exception, match="corrected twice"):
        shards.corrected(rows, fixes.union(fixes), "id", ["t"]).collect()
    assert shards.still_there(rows, fixes, "id").count() == 1


def test_judgments(spark):
    kind = "i int, label boolean, j array<struct<intent_score:int,grammar_score:double,spelling_score:int,slots_score:int,language_identification:string>>"
    good = (1, 4.0, 2, 1, "target")
    rows = [(0, True, [good, good]), (1, True, [good]), (2, False, None), (3, True, [good, (2, 1.0, 2, 1, "target"), None]), (4, False, [good, (1, 4.0, 2, 0, "target")]), (5, True, [good, (1, 4.0, 2, 0, "target")]), (6, True, [good, good, (0, 3.0, None, 0, "x")])]
    out = spark.createDataFrame(rows, kind).select("i", shards.judged(F.col("j"), F.col("label")).alias("ok"))
    assert {r.i: r.ok for r in out.collect()} == {0: True, 1: False, 2: False, 3: False, 4: True, 5: False, 6: True}


def test_pieces(spark):
    pieces = ["▁한국", "漢字", "ひらがな", "カタカナ", "12", "abc", "é", "ab1", "<s>", "▁", "!", "가あ", ""]
    df = spark.createDataFrame([(p,) for p in pieces], "p string").select("p", tokens.piece_class(F.col("p")).alias("c"), tokens.hangul_parts(F.col("p")).alias("h"))
    out = {r.p: (r.c, tuple(r.h)) for r in df.collect()}
    assert [out[p][0] for p in pieces] == ["hangul", "han", "hiragana", "katakana", "digit", "latin", "latin", "mixed", "special", "special", "other", "mixed", "special"]
    code = ord("국") - 0xAC00
    assert out["▁한국"][1] == (code // 588 + 1, code % 588 // 28 + 1, code % 28 + 1) and out["abc"][1] == (0, 0, 0)


def test_terms(spark):
    r = spark.createDataFrame([("데이터베이스를 사용한다 그리고 서버에서 서버가 라면", "サーバー と 機械学習 の 本")], "a string, b string")
    r = r.select(X.korean_terms(F.col("a")).alias("k"), X.japanese_terms(F.col("b")).alias("j")).first()
    assert r.k == ["데이터베이스", "서버", "라면"] and r.j == ["サーバー", "機械学習"]


def test_hints_and_drafts_come_apart_again(spark):
    df = spark.createDataFrame([([("a b", "c"), ("d", "e f")], "the text <seg> x"), ([], "plain"), ([], "<glossary> no end")], "terms array<struct<source:string,target:string>>, t string")
    out = df.withColumn("p", X.hint_parts(X.hint_prefix(F.col("terms"), F.col("t")))).collect()
    assert all(r.p.terms == r.terms and r.p.text == r.t for r in out)
    r = spark.createDataFrame([("s", "d <draft> e")], "a string, b string").select(X.revision_parts(X.revision_input(F.col("a"), F.col("b"))).alias("x"), X.revision_parts(F.col("a")).alias("y"), X.preview(F.col("b"), 5).alias("v")).first()
    assert r.x.asDict() == {"source": "s", "draft": "d <draft> e"} and r.y.asDict() == {"source": "s", "draft": None} and r.v == "d <d…"


def test_bleu(spark):
    df = spark.createDataFrame([("the cat sat on the mat .", "the cat sat on the mat ."), ("a b c d e", "a b c d f")], "h string, r string")
    got = evaluate.bleu(df, "h", "r", []).first()
    m, t = [11, 9, 7, 5], [12, 10, 8, 6]
    assert got.bleu == pytest.approx(100 * math.exp(sum(math.log(x / y) for x, y in zip(m, t, strict=True)) / 4), abs=1e-5)
    short = spark.createDataFrame([("a b c d", "a b x d e f")], "h string, r string")
    want = 100 * math.exp(1 - 6 / 4) * math.exp(sum(map(math.log, (3 / 4, 1 / 3, 1 / (2 * 2), 1 / (4 * 1)))) / 4)
    assert evaluate.bleu(short, "h", "r", []).first().bleu == pytest.approx(want, abs=1e-5)
    assert evaluate.bleu(spark.createDataFrame([("x", "y")], "h string, r string"), "h", "r", []).first().bleu == 0
    assert evaluate.bleu_tokens("Hello, world! 3.5-4 it's", False) == ["Hello", ",", "world", "!", "3.5", "-", "4", "it's"]
    d = evaluate.deltas(spark.createDataFrame([("a", "x", 1.0), ("b", "x", 3.5), ("b", "y", 2.0)], "system string, g string, v double"), "system", "a", ["g"], "v")
    assert {(r.system, r.g): r.delta for r in d.collect()} == {("b", "x"): 2.5, ("b", "y"): None}


def test_prepare_counters_and_source_only_languages(spark, tmp_path):
    good = [json.dumps({"ko": f"안녕하세요 여러분 {i}번째 문장", "ja": f"みなさんこんにちは{i}番目の文です"}, ensure_ascii=False) for i in range(30)]
    bad = [good[0], json.dumps({"ko": "", "ja": "あいう"}, ensure_ascii=False), json.dumps({"ko": "가" * 20, "ja": "あ" * 20}, ensure_ascii=False), "{broken", json.dumps({"ko": " ".join(f"단어{i}" for i in range(30)), "ja": "、".join(f"言葉{i}の" for i in range(30))}, ensure_ascii=False), "[1]"]
    (tmp_path / "a.jsonl").write_bytes("\n".join([*good, *bad]).encode() + b"\n\xff\n")
    (tmp_path / "synthetic-b.jsonl").write_text("\n".join(json.dumps({"ko": f"합성된 문장입니다 {i}", "ja": f"合成された文です{i}"}, ensure_ascii=False) for i in range(5)))
    lines = readers.json_lines(spark, str(tmp_path))
    pairs = prepare.records(spark, [str(tmp_path)], [("ko", "ja")])
    steps = prepare.judged(pairs, ("ko", "ja"), validation=0.2, test=0.2, approximate=False, most_tokens=60, source_only=("ja",))
    out = {(r.file or "").rsplit("/", 1)[-1]: r for r in prepare.counters(lines, pairs, steps).collect()}
    a, all_ = out["a.jsonl"], out[""]
    assert (a.physical_lines, a.invalid_json, a.invalid_utf8, a.missing_text, a.invalid_record) == (37, 1, 1, 1, 1)
    assert a.excessive_repetition == 1 and a.quality_filtered >= 1 and a.duplicates == 1 and (a.too_long, a.quality_filtered) == (1, 1)
    assert all_.is_total == 1 and all_.physical_lines == 42 and all_.synthetic_pairs == 5 and all_.forward_only_pairs == all_.valid_pairs
    assert all_.train + all_.validation + all_.test == all_.valid_pairs == 35 - all_.split_conflicts
    kept = steps["kept"].collect()
    assert {(r.lang_a, r.lang_b) for r in kept} == {("ja", "ko")} and all(r.split == "train" for r in kept if r.synthetic)
    assert prepare.training_lines(steps["kept"]).count() == 2 * all_.train


def test_queue_gates_and_isolation(spark, tmp_path):
    rows = [("숫자 5를 보세요", "数字5を見てください"), ("숫자 5를 보세요", "数字6を見てください"), ("{x} 값을 보세요", "値を見てください"), ("안녕하세요 여러분", "안녕하세요 여러분"), ("안녕하세요", None), ("안녕하세요 여러분", "全部漢字文字列")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, source string, translation string")
    out = {r.i: r.reasons for r in queue.forward_reasons(df, ("ko", "ja")).collect()}
    assert out[0] == [] and out[1] == ["number_mismatch", "structured_mismatch"] and out[2] == ["structured_mismatch"] and out[4] == ["empty_translation"]
    assert "identical_text" in out[3] and {"target_language", "target_japanese_kana", "pair_score"} <= set(out[3]) and "target_japanese_kana" in out[5]
    r = spark.range(1).select(queue.roundtrip_reasons(F.lit(0.4), F.lit(0.9), F.lit(1.0), F.lit(True)).alias("x"), queue.roundtrip_reasons(F.lit(0.9), F.lit(1.0), F.lit(1.0), F.lit(False)).alias("y")).first()
    assert r.x == ["roundtrip_score", "roundtrip_number_mismatch", "roundtrip_structured_mismatch"] and r.y == []

    def translate(texts):
        if any("bad" in t for t in texts):
            raise ValueError("no")
        return [t.upper() for t in texts]

    texts = [f"t{i}" if i % 7 else f"bad{i}" for i in range(30)]
    got, errors = queue.resilient(translate, texts, 8)
    assert got == [t.upper() if "bad" not in t else None for t in texts] and all((e == "ValueError: no") == ("bad" in t) for e, t in zip(errors, texts, strict=True))
    made = queue.translated(spark.createDataFrame([(t,) for t in [*texts, ""]], "source string"), translate).collect()
    assert {r.source: (r.translation, r.failure) for r in made}[""] == (None, "empty_source") and sum(r.failure == "ValueError: no" for r in made) == 5
    ck = str(tmp_path / "ck")
    with queue.sole_writer(spark, ck), pytest.raises(RuntimeError, match="another run"), queue.sole_writer(spark, ck):
        pass
    with queue.sole_writer(spark, ck):
        pass


def test_summaries(spark):
    done = spark.createDataFrame([("accepted", 0), ("accepted", 2), ("no_gain", 1)], "stop_reason string, revisions int")
    r = evaluate.refinement_summary(done).first()
    assert (r.sentences, r.revisions_total, r.unrevised_sentences, r.stop_reasons, r.revisions_per_sentence) == (3, 3, 1, {"accepted": 2, "no_gain": 1}, 1.0)
    assert evaluate.refinement_summary(done.limit(0)).first().sentences == 0
    df = spark.createDataFrame([("a", "ko-ja", "x", "가나", "가나"), ("a", "ko-ja", "y", "가나", "다라")], "system string, direction string, category string, h string, r string")
    out = {r.category: r.chrf for r in evaluate.by_category(df, "h", "r", "system", "direction", "category").collect()}
    assert out["x"] == 100 and out["y"] == 0 and 0 < out[None] < 100
    pairs = spark.createDataFrame([("s1", "씨발", "種まき"), ("s1", "안녕", "こんにちは"), ("s2", "닥쳐", "静か")], "source string, a string, b string")
    found = pairs.withColumn("f", leakage.contamination(F.col("a"), F.col("b"), ("ko", "ja")))
    assert {(r.source, r.rule): (r.findings, r.most_confident) for r in leakage.findings_by(found, "f", ["source"]).collect()} == {
        ("s1", "known_literal_mistranslation"): (1, 0.95), ("s1", "profanity_intensity_lost"): (1, 0.45), ("s2", "profanity_intensity_lost"): (1, 0.45),
    }


def test_glossary_columns(spark):
    df = spark.createDataFrame([("a machine here",), (None,)], "t string").select(glossary.substituted({"machine": "Maschine"})("t").alias("m"))
    assert [(r.m.text, r.m.slots) for r in df.collect()] == [("a <term_0> here", {"<term_0>": "Maschine"}), (None, None)]
    assert glossary.morphemes("ko").rejoin("나 는 밥 을") == "나는 밥을" and glossary.morphemes("de") is None and glossary.morphemes("kj").stranded("x は 는") == ["は", "는"]


def test_builders(spark):
    files = lambda rows: spark.createDataFrame(rows, "path string, content string")
    ko = files([("a.ftl", "# c\nhello = 안녕하세요\nsave.key = 저장\nbad = {x} 값\ndup = 안녕하세요"), ("b.ftl", "only = 하나")])
    ja = files([("a.ftl", "hello = こんにちは\nsave.key = 保存\nbad = {y} 値\ndup = こんにちは\nmore = 追加")])
    pairs = build.joined_messages(build.parsed_messages(ko, "ftl"), build.parsed_messages(ja, "ftl"))
    out = build.user_interface(pairs)
    assert {r.resource_id: r.reason for r in out.collect()} == {"a.ftl::hello": "internal_exact_duplicate", "a.ftl::dup": None, "a.ftl::save.key": "access_key", "a.ftl::bad": "placeholder_mismatch"}
    assert {r.reason: r.n for r in build.report(out).collect()}["kept"] == build.accepted(out).count() == 1
    deep = build.parsed_messages(files([("p", '{"contents": {"x": {"k": "값"}}, "other": {"k": "y"}}')]), "json", "contents").collect()
    assert [(r.key, r.text) for r in deep] == [("x/k", "값")]

    kind = "id string, scenario string, intent string, utt string, slot_method array<struct<slot:string,method:string>>, judgments array<struct<intent_score:int,grammar_score:int,spelling_score:int,slots_score:int,language_identification:string>>"
    good, slot = [(1, 4, 2, 1, "target")] * 3, [("time", "translation")]
    a = [("1", "s", "i", "가", slot, good), ("2", "s", "i", "나", slot, good), ("3", "s", "i", "다", [("t", "localization")], good), ("4", "s", "i", "라", slot, good), ("5", "s", "i", "마", slot, good[:1]), ("6", "s", "i", " ", None, good), ("7", "s", "i", "가", slot, good), ("9", "s", "i", "x", slot, good), ("10", "s", "i", "아", None, good)]
    b = [("1", "s", "i", "あ", slot, good), ("2", "s", "j", "い", slot, good), ("3", "s", "i", "う", slot, good), ("4", "s", "i", "え", [("time", "unchanged")], good), ("5", "s", "i", "お", slot, good), ("6", "s", "i", "か", None, good), ("7", "s", "i", "あ", slot, good), ("8", "s", "i", "き", slot, good), ("10", "s", "i", "く", slot, good)]
    out = build.utterances(spark.createDataFrame(a, kind), spark.createDataFrame(b, kind))
    assert {r.resource_id: r.reason for r in out.collect()} == {
        "1": None, "2": "scenario_or_intent_mismatch", "3": "locale_specific_slot_localization", "4": "slot_method_mismatch", "5": "judgment_quality", "6": "empty", "7": "internal_exact_duplicate", "10": "slot_label_mismatch",
    }

    parts = spark.createDataFrame([("GEN.1.1", 2, "말씀이다"), ("GEN.1.1", 1, "태초에"), ("GEN.1.2", 1, "그리고"), ("GEN.2.1", 1, "둘째"), ("PSA.1.1", 1, "시편")], "verse_id string, position int, text string")
    x = build.merged_verses(parts)
    y = spark.createDataFrame([("GEN.1.1", "初めに"), ("GEN.1.2", "a"), ("GEN.2.1", "二"), ("GEN.2.2", "三"), ("PSA.1.1", "詩編")], "verse_id string, text string")
    assert {(r.resource_id, r.a, r.reason) for r in build.verses(x, y).collect()} == {("GEN.1.1", "태초에 말씀이다", None), ("GEN.1.2", "그리고", "missing_expected_script_or_too_short")}


def test_checked_pairs_signatures_and_metadata(spark):
    df = spark.createDataFrame([("5 kg and -3", "5 kg und -3"), ("5 kg", "6 kg я"), ("x", "y")], "s string, o string")
    out = {r.s: r for r in audit.checked(df, "s", "o", ["latin"]).collect()}
    assert out["5 kg and -3"].passed and out["x"].passed and out["x"].number.f1 == 1.0
    bad = out["5 kg"]
    assert not bad.passed and bad.number.f1 == 0 and not bad.number.ok and bad.unit.ok and bad.foreign == ["cyrillic"]
    r = audit.preservation(df, "s", "o", ["latin"]).first()
    assert (r.sentences, r.number_violations, r.unit_violations, r.script_violations, r.foreign_scripts) == (3, 1, 0, 1, ["cyrillic"])
    sig = lambda t: spark.createDataFrame([(t,)], "t string").select(X.minhash_signature(X.char_shingles(F.col("t")), 64).alias("m"), X.minhash_native(X.char_shingles(F.col("t"))).alias("one")).first()
    a, b = sig("the quick brown fox jumps over the lazy dog again and again"), sig("the quick brown fox jumps over the lazy dog again and again!")
    assert len(a.m) == 64 and a.m[0] == a.one and sum(x == y for x, y in zip(a.m, b.m, strict=True)) > 50
    meta = lambda t: spark.createDataFrame([(t,)], "t string").select(readers.metadata_of(F.col("t")).alias("m")).first().m
    assert meta('{"domain": "a", "category": null}') == {"domain": "a"} and meta("{}") == {}
    for wrong in ('{"bad": 1}', "[1]", None):
        with pytest.raises(Exception, match="metadata"):
            meta(wrong)
