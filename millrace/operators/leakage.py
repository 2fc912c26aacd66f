"""Held-out items that a corpus holds, wholly or in part; contamination rules; term-pair screens."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import text as X

SENT = 2_000_000  #: characters of held-out items up to which all of them are sent to the executors
RARITY_IN = 32  #: one row in so many tells how rare a shingle is


def holdout_items(cases: DataFrame, languages: list[str] | None = None) -> DataFrame:
    """Two items per case, its source and its reference: (item_id, category, language, text)."""
    side = lambda n: F.struct(F.concat(F.coalesce(F.col("id"), F.concat(F.lit("case-"), F.xxhash64("source", "reference").cast("string"))), F.lit(f"#{n}")).alias("item_id"), F.col("category"), F.col(f"{'source' if n == 'source' else 'target'}_language").alias("language"), F.col(n).alias("text"))
    out = cases.select(F.inline(F.array(side("source"), side("reference"))))
    return out.filter(F.col("language").isin(*languages)) if languages else out


def _grams(key: Column, size: int) -> Column:
    return F.array_distinct(F.when(F.length(key) <= size, F.array(key)).otherwise(X.ngrams(key, size)))


def leaks(
    items: DataFrame, rows: DataFrame, item: str = "item_id", row: str = "doc_id", text: str = "text", size: int = 3, least: float = 0.6, normal: bool = True,
    most_sent: int = SENT,
) -> DataFrame:
    """(item, row, shared, item_shingles, containment, exact) of each pair with enough of the item's shingles in the row.

    Items of at most ``most_sent`` characters in all, which is counted first, are
    sent to the executors and every row is held against all of them in one pass.
    Beyond that both sides meet by a join.
    """
    key = lambda t: X.comparison_key(t, normal)
    held = items.select(F.col(item).alias("_item"), key(F.col(text)).alias("_ikey")).filter("length(_ikey) > 0")
    keys = rows.select(F.col(row).alias("_row"), key(F.col(text)).alias("_rkey"))
    total = held.agg(F.sum(F.length("_ikey"))).first()[0]
    out = _scanned(held, keys, size, least) if (total or 0) <= most_sent else _met(held, keys, size, least)
    return out.withColumnsRenamed({"_item": item, "_row": row})


def _scanned(held: DataFrame, keys: DataFrame, size: int, least: float) -> DataFrame:
    """Every row against an inverted index of the items' shingles."""
    known = [(r["_item"], r["_ikey"]) for r in held.collect()]  # bounded by the caller
    kinds = held.schema["_item"].dataType, keys.schema["_row"].dataType
    kind = to_arrow_type(kinds[0])
    names = ["_item", "_row", "shared", "item_shingles", "exact"]

    def grams(t: str) -> set[str]:
        return {t} if len(t) <= size else {t[i : i + size] for i in range(len(t) - size + 1)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: dict[str, list[int]] = {}
        n = np.zeros(len(known), np.int64)
        for i, (_, t) in enumerate(known):
            for g in grams(t):
                at.setdefault(g, []).append(i)
                n[i] += 1
        index = {g: np.array(v) for g, v in at.items()}
        for batch in batches:
            where, which, shared = [], [], []
            for j, t in enumerate(batch.column("_rkey").to_pylist()):
                hits = [index[g] for g in grams(t) if g in index] if t else []
                if hits:
                    counts = np.bincount(np.concatenate(hits), minlength=len(known))
                    enough = np.flatnonzero(counts / n >= least)
                    where += [j] * len(enough)
                    which += enough.tolist()
                    shared += counts[enough].tolist()
            text = batch.column("_rkey")
            exact = [c == n[i] and known[i][1] in text[j].as_py() for j, i, c in zip(where, which, shared, strict=True)]
            columns = [
                pa.array([known[i][0] for i in which], kind), batch.column("_row").take(pa.array(where, pa.int64())), pa.array(shared, pa.int64()),
                pa.array(n[which] if which else [], pa.int32()), pa.array(exact, pa.bool_()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    fields = [T.StructField("_item", kinds[0]), T.StructField("_row", kinds[1]), *T.StructType.fromDDL("shared long, item_shingles int, exact boolean").fields]
    found = keys.mapInArrow(run, T.StructType(fields)) if known else keys.sparkSession.createDataFrame([], T.StructType(fields))
    return found.select("_item", "_row", "shared", "item_shingles", (F.col("shared") / F.col("item_shingles")).alias("containment"), "exact")


def _met(held: DataFrame, keys: DataFrame, size: int, least: float) -> DataFrame:
    """Items and rows that share enough rare shingles, then compared in full.

    Of an item's n shingles a row may lack ``spare``, so of any m it holds m -
    spare. Only the item's rarest 2 * spare + 1 are looked up. How rare a
    shingle is comes from a part of the rows, which decides how many pairs meet
    and nothing else.
    """
    held = held.withColumn("_igrams", _grams(F.col("_ikey"), size)).withColumn("_n", F.size("_igrams"))
    spare = F.col("_n") - F.greatest(F.lit(1), F.ceil(F.col("_n") * F.lit(least) - F.lit(1e-9)))
    index = held.select("_item", "_n", spare.alias("_spare"), F.explode("_igrams").alias("_g"))
    some = keys.filter(F.pmod(F.xxhash64("_row"), F.lit(RARITY_IN)) == 0).select(F.explode(_grams(F.col("_rkey"), size)).alias("_g"))
    often = some.join(index.select("_g").distinct(), "_g").groupBy("_g").agg(F.count("*").alias("_often"))
    ranked = index.join(often, "_g", "left").withColumn("_at", F.row_number().over(W.partitionBy("_item").orderBy(F.coalesce("_often", F.lit(0)), "_g")))
    rare = ranked.filter(F.col("_at") <= 2 * F.col("_spare") + 1)
    rare = rare.select("_g", "_item", (F.least("_n", 2 * F.col("_spare") + 1) - F.col("_spare")).alias("_least"))
    probe = keys.select("_row", F.explode(_grams(F.col("_rkey"), size)).alias("_g"))
    near = probe.join(rare, "_g").groupBy("_item", "_row").agg(F.count("*").alias("_met"), F.first("_least").alias("_least"))
    both = near.filter("_met >= _least").select("_item", "_row").join(keys, "_row").join(held, "_item")
    grams = F.size(F.filter("_igrams", lambda g: F.contains("_rkey", g)))
    shared = F.when(F.length("_rkey") <= size, F.array_contains("_igrams", F.col("_rkey")).cast("int")).when(F.length("_ikey") >= size, grams).otherwise(F.lit(0))
    both = both.withColumn("shared", shared.cast("long")).filter(F.col("shared") / F.col("_n") >= least)
    exact = (F.col("shared") == F.col("_n")) & F.contains("_rkey", F.col("_ikey"))
    return both.select("_item", "_row", "shared", F.col("_n").alias("item_shingles"), (F.col("shared") / F.col("_n")).alias("containment"), exact.alias("exact"))


def worst(found: DataFrame, item: str, row: str, most: int = 5) -> DataFrame:
    """The most similar rows of each item."""
    w = W.partitionBy(item).orderBy(F.desc("containment"), row)
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most)


def leak_summary(items: DataFrame, found: DataFrame, item: str, category: Column) -> DataFrame:
    """Items, leaked items and their share by category; a leaked item fails the gate."""
    leaked = found.select(item).distinct().withColumn("_leaked", F.lit(1))
    out = items.withColumn("category", category).join(leaked, item, "left").groupBy("category").agg(F.count("*").alias("items"), F.count("_leaked").alias("leaked"))
    return out.withColumn("rate", F.round(F.col("leaked") / F.col("items"), 8)).withColumn("failed", F.col("leaked") > 0)


# Korean idioms and expletives whose word-for-word Japanese marks a spoilt pair.
LITERALS = (("씨발", "種まき"), ("시발", "種まき"), ("씨발", "種の足"), ("시발", "種の足"), ("좆", "種"))
IDIOMS = (
    ("같은 값이면 다홍치마", "紅スカート", ()), ("붕어빵", "たい焼き", ("닮", "판박이", "똑같", "빼닮", "랑 붕어빵", "와 붕어빵", "과 붕어빵")), ("식은 죽 먹기", "冷めた粥", ()), ("발 벗고 나서", "足を脱いで", ()),
    ("눈코 뜰 새", "目と鼻を開ける", ()), ("바가지를 쓰", "ひさごをかぶ", ()), ("미역국을 먹", "わかめスープを飲", ()), ("국수를 먹", "そうめんを食べ", ()),
)
DOG_WORDS = ("개새끼", "개자식", "개놈", "개년", "개소리", "개수작")


# Korean expletives, and Japanese marks of which any one keeps the force of a text.
PROFANITY = (
    "씨발", "시발", "씨팔", "좆", "존나", "졸라", "개새끼", "새끼야", "새끼들아", "이새끼", "저새끼", "그새끼", "병신", "지랄", "닥쳐", "미친놈", "미친년", "썅",
    "빌어먹을", "엿먹",
)
VULGAR = (
    "くそ", "クソ", "糞", "ちくしょう", "畜生", "ふざけ", "うざ", "きも", "黙れ", "死ね", "野郎", "馬鹿", "ばか", "バカ", "あほ", "アホ", "てめえ", "てめー", "やがる",
    "しやがれ", "ぶっ", "クソッ", "ちっ", "最悪", "むかつく",
)
REPAIRS = (("種まき", "くそ"), ("種の足", "くそ"))
MARKS = r"[.,!?~·・…\-_*]+"
FINDINGS = "array<struct<rule:string,confidence:double,evidence:array<string>>>"


def spaced(t: Column, normal: bool = True) -> Column:
    """Runs of one character and marks between characters folded, blanks kept."""
    folded = F.regexp_replace(X.nfkc(t) if normal else t, r"(?d)(.)\1{2,}", "$1")
    return X.squeeze(F.regexp_replace(folded, MARKS, ""))


def contamination(
    source: Column, target: Column, direction: tuple[str, str], profanity: tuple[str, ...] = PROFANITY, vulgar: tuple[str, ...] = VULGAR, normal: bool = True
) -> Column:
    """Findings (rule, confidence, evidence) of a pair; null where a direction has no rules, which is not clean."""
    if direction != ("ko", "ja"):
        return F.lit(None).cast(FINDINGS)

    def finding(when: Column, rule: str, sure: float, seen: Column) -> Column:
        return F.when(when, F.struct(F.lit(rule).alias("rule"), F.lit(sure).alias("confidence"), seen.alias("evidence")))

    def found(near: Column, s: Column, t: Column) -> Column:
        word = lambda w: F.lit(_fold(w))
        out = []
        for a, b in LITERALS:
            both = F.contains(s, word(a)) & F.contains(t, word(b))
            out.append(finding(both, "known_literal_mistranslation", 0.95, F.array(F.lit(a), F.lit(b))))
        for a, b, marks in IDIOMS:
            sense = _any(s, [_fold(m) for m in marks]) if marks else F.lit(True)
            out.append(finding(F.contains(s, word(a)) & F.contains(t, word(b)) & sense, "literal_idiom", 0.85, F.array(F.lit(a), F.lit(b))))
        dogs, curses = _held(near, DOG_WORDS), _held(s, profanity)
        out.append(finding((F.size(dogs) > 0) & F.contains(t, F.lit("犬")), "dog_prefix_literal", 0.75, F.concat(dogs, F.array(F.lit("犬")))))
        out.append(finding((F.size(curses) > 0) & ~_any(t, [_fold(w) for w in vulgar]), "profanity_intensity_lost", 0.45, curses))
        return F.array_compact(F.array(*out)).cast(FINDINGS)

    tight = lambda t: F.regexp_replace(t, X.WS, "")
    folded = F.struct(spaced(source, normal).alias("s"), spaced(target, normal).alias("t"))
    flat = lambda f: F.struct(f["s"].alias("near"), tight(f["s"]).alias("s"), tight(f["t"]).alias("t"))
    return X.let(X.let(folded, flat), lambda f: found(f["near"], f["s"], f["t"]))


def _held(t: Column, words: tuple[str, ...]) -> Column:
    """Those of the words, folded, that a folded text holds, in the list's order."""
    if not words:
        return F.array().cast("array<string>")
    return F.array_compact(F.array(*[F.when(F.contains(t, F.lit(_fold(w))), F.lit(_fold(w))) for w in words]))


def _any(t: Column, words: list[str]) -> Column:
    """Whether a text holds one of the words."""
    out = F.lit(False)
    for w in words:
        out = out | F.contains(t, F.lit(w))
    return out


def _fold(w: str) -> str:
    import re
    import unicodedata

    w = re.sub(r"(.)\1{2,}", r"\1", unicodedata.normalize("NFKC", w))
    return re.sub(r"\s+", "", re.sub(r"[.,!?~·・…\-_*]+", "", w))


def strongest(findings: Column) -> Column:
    """The finding of highest confidence, the first of equals."""
    top = F.array_max(F.transform(findings, lambda f: f["confidence"]))
    return F.get(F.filter(findings, lambda f: f["confidence"] == top), F.lit(0))


def repaired(source: Column, target: Column, replacements: tuple[tuple[str, str], ...] = REPAIRS, direction: tuple[str, str] = ("ko", "ja"), normal: bool = True) -> Column:
    """The target with certain replacements applied in order; null where that is no sure repair.

    They are tried only where the pair has a literal finding, and the result is
    assessed again: with any finding left, the pair goes to a person.
    """
    fixed = target
    for a, b in replacements:
        fixed = F.replace(fixed, F.lit(a), F.lit(b))
    found = contamination(source, target, direction, normal=normal)
    literal = F.coalesce(F.exists(found, lambda x: x["rule"] == "known_literal_mistranslation"), F.lit(False))
    return F.when(literal & (fixed != target) & (F.size(contamination(source, fixed, direction, normal=normal)) == 0), fixed)


def screen(text: Column, first: tuple[str, ...], second: tuple[str, ...]) -> Column:
    """unscreened without terms (never clean), flagged where both lists have a term in the text, else clear."""
    if not first or not second:
        return F.lit("unscreened")
    has = lambda ws: _any(F.lower(text), [w.lower() for w in ws])
    return F.when(has(first) & has(second), F.lit("flagged")).otherwise(F.lit("clear"))


def findings_by(rows: DataFrame, findings: str, by: list[str]) -> DataFrame:
    """Findings by rule and group, the rows that have them and the highest confidence; rows without rules are not counted."""
    one = rows.select(*by, F.explode(findings).alias("_f")).select(*by, "_f.rule", "_f.confidence")
    return one.groupBy(*by, "rule").agg(F.count("*").alias("findings"), F.max("confidence").alias("most_confident"))


def screen_counts(rows: DataFrame, text: Column, first: tuple[str, ...], second: tuple[str, ...]) -> DataFrame:
    """(list, marker, n): in how many flagged rows each marker of the two lists stands."""
    low = F.lower(text)
    seen = lambda name, ws: [F.when(F.contains(low, F.lit(w.lower())), F.struct(F.lit(name).alias("list"), F.lit(w).alias("marker"))) for w in ws]
    flagged = rows.filter(screen(text, first, second) == "flagged")
    return flagged.select(F.inline(F.array_compact(F.array(*seen("first", first), *seen("second", second))))).groupBy("list", "marker").agg(F.count("*").alias("n"))
