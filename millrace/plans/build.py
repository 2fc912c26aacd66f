"""Verified parallel text from sources whose sides are joined by ids: messages, utterances and verses.

Every builder gives its candidates with ``reason``: null for rows that stay,
else the first test they fail; ``report`` counts them.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..operators import dedup, quality, shards
from ..sources import readers


def _once(rows: DataFrame, reason: Column, order: list[str], normal: bool = True) -> DataFrame:
    """Adds ``reason``, and ``internal_exact_duplicate`` for later rows of a pair among those without one."""
    out = rows.withColumn("reason", reason)
    key = F.sha2(dedup.pair_key(F.col("a"), F.col("b"), normal), 256)
    out = out.withColumn("_key", F.when(F.col("reason").isNull(), key))
    first = out.filter("reason IS NULL").groupBy("_key").agg(F.min(F.struct(*order)).alias("_first"))
    out = out.join(first, "_key", "left")
    late = F.col("_first").isNotNull() & (F.struct(*order) != F.col("_first"))
    return out.withColumn("reason", F.when(late, "internal_exact_duplicate").otherwise(F.col("reason"))).drop("_key", "_first")


def report(candidates: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Rows by reason, ``kept`` for those that stay, for each of ``by``."""
    return candidates.groupBy(*(by or []), F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


def accepted(candidates: DataFrame) -> DataFrame:
    return candidates.filter("reason IS NULL").drop("reason")


_MESSAGES = T.MapType(T.StringType(), T.StringType())


def parsed_messages(files: DataFrame, kind: str, below: str | None = None) -> DataFrame:
    """(path, key, text) of the messages of files (path, content); ``below`` names the object of a JSON file that holds them."""

    @F.pandas_udf(_MESSAGES)
    def run(s: pd.Series) -> pd.Series:
        inside = lambda t: json.dumps(json.loads(t).get(below, {})) if below and t else t
        return s.map(lambda t: readers.messages(inside(t), kind))

    return files.select("path", F.explode(run(F.col("content"))).alias("key", "text"))


def joined_messages(a: DataFrame, b: DataFrame) -> DataFrame:
    """(resource_id, a, b) of messages (path, key, text) that both sides have under one path and key."""
    both = a.select("path", "key", F.col("text").alias("a")).join(b.select("path", "key", F.col("text").alias("b")), ["path", "key"])
    return both.select(F.concat_ws("::", "path", "key").alias("resource_id"), "a", "b")


def user_interface(pairs: DataFrame, expected: tuple[str, str] | None = None, normal: bool = True) -> DataFrame:
    """Candidates of (resource_id, a, b) strings by the rules of user-interface text."""
    clean = pairs.withColumns({"a": X.canonical_text(F.col("a"), normal), "b": X.canonical_text(F.col("b"), normal)})
    scripts = expected or (quality.EXPECTED["ko"], quality.EXPECTED["ja"])
    reason = quality.ui_reason(F.col("a"), F.col("b"), F.col("resource_id"), scripts, normal=normal)
    return _once(clean, reason, ["resource_id"], normal)


def utterances(a: DataFrame, b: DataFrame, normal: bool = True) -> DataFrame:
    """Candidates of utterances (id, scenario, intent, utt, slot_method, judgments) of two locales, joined by id.

    Scenario, intent and the bags of slot labels and methods must agree, no slot
    may have been localised, and both sides' judgments must pass.
    """
    slots = lambda x: F.filter(F.coalesce(x["slot_method"], F.array().cast("array<struct<slot:string,method:string>>")), lambda s: s["slot"].isNotNull() & (s["slot"] != ""))
    labels = lambda x: F.array_sort(F.transform(slots(x), lambda s: s["slot"]))
    full = lambda x: F.filter(slots(x), lambda s: s["method"].isNotNull() & (s["method"] != ""))
    methods = lambda x: F.array_sort(F.transform(full(x), lambda s: F.concat_ws("\0", s["slot"], s["method"])))
    localised = lambda x: F.coalesce(F.exists(x["slot_method"], lambda s: F.coalesce(s["method"] == "localization", F.lit(False))), F.lit(False))
    side = lambda t, n: t.select("id", F.struct(*[c for c in t.columns if c != "id"]).alias(n))
    x, y = F.col("_x"), F.col("_y")
    both = side(a, "_x").join(side(b, "_y"), "id")
    ok = lambda z: shards.judged(z["judgments"], F.size(labels(z)) > 0)
    text = lambda z: X.canonical_text(F.coalesce(z["utt"], F.lit("")), normal)
    rows = both.select(F.col("id").cast("string").alias("resource_id"), text(x).alias("a"), text(y).alias("b"), "_x", "_y")
    reason = (
        F.when(~(x["scenario"].eqNullSafe(y["scenario"]) & x["intent"].eqNullSafe(y["intent"])), "scenario_or_intent_mismatch")
        .when(localised(x) | localised(y), "locale_specific_slot_localization").when(labels(x) != labels(y), "slot_label_mismatch")
        .when(methods(x) != methods(y), "slot_method_mismatch").when(~ok(x) | ~ok(y), "judgment_quality").when((F.col("a") == "") | (F.col("b") == ""), "empty")
    )
    out = _once(rows, reason, ["resource_id"], normal)
    return out.select("resource_id", "a", "b", x["scenario"].alias("scenario"), x["intent"].alias("intent"), "reason")


# Books whose verses are counted differently by the two editions.
SHIFTED_BOOKS = ("PSA", "JOL", "MAL")


def verses(a: DataFrame, b: DataFrame, expected: tuple[str, str] | None = None, excluded: tuple[str, ...] = SHIFTED_BOOKS, normal: bool = True) -> DataFrame:
    """Candidates of verses (verse_id, text) joined by id, only in chapters that both sides number alike."""
    scripts = expected or (quality.EXPECTED["ko"], quality.EXPECTED["ja"])
    chapter = F.substring_index("verse_id", ".", 2)
    left, right = (t.withColumn("chapter", chapter) for t in (a, b))
    rows = shards.aligned(left, right, "chapter", "verse_id", excluded=F.substring_index("chapter", ".", 1).isin(*excluded))
    rows = rows.select(F.col("verse_id").alias("resource_id"), X.canonical_text(F.col("a"), normal).alias("a"), X.canonical_text(F.col("b"), normal).alias("b"))
    poor = (F.length("a") < 2) | (F.length("b") < 2) | ~F.col("a").rlike(scripts[0]) | ~F.col("b").rlike(scripts[1])
    return _once(rows, F.when(poor, "missing_expected_script_or_too_short"), ["resource_id"], normal)


def merged_verses(parts: DataFrame) -> DataFrame:
    """(verse_id, text): the parts (verse_id, position, text) of a verse in order, as one."""
    some = F.array_sort(F.collect_list(F.struct("position", "text")))  # a few parts a verse
    return parts.groupBy("verse_id").agg(X.squeeze(F.array_join(F.transform(some, lambda p: p["text"]), " ")).alias("text"))
