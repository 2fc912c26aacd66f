"""The main pipelines: raw records to a split, deduplicated, scored dataset; monolingual text; shard recovery."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.spans import shared_slots
from ..operators import audit, dedup, quality
from ..sources import readers


def records(spark: SparkSession, paths: list[str], languages: list[tuple[str, str]]) -> DataFrame:
    """(file, status, pair fields, issue) of every line of JSON-lines files: one row a pair or a problem."""
    raw = readers.json_lines(spark, *paths).filter("status <> 'blank'")
    x = readers.pairs_of(F.col("value"), readers.normalize_pairs(languages))
    rows = raw.withColumn("_x", F.when(F.col("status") == "ok", x)).withColumn("digest", F.sha2(X.strip(F.col("value")), 256))
    pairs = rows.select("file", "digest", F.size("_x.pairs").alias("n_pairs"), F.posexplode("_x.pairs").alias("ordinal", "p")).select("file", "digest", "n_pairs", "ordinal", "p.*", F.lit(None).cast("string").alias("issue"))
    bad = rows.filter("status <> 'ok'").select("file", "digest", F.col("status").alias("issue")).unionByName(rows.select("file", "digest", F.explode("_x.issues").alias("issue")))
    return pairs.unionByName(bad, allowMissingColumns=True)


# What a line, a rejection and a warning is counted as.
ISSUES = {
    "invalid_json": "invalid_json", "invalid_utf8": "invalid_utf8", "not_an_object": "invalid_record", "no_pair": "invalid_record", "missing_side": "missing_text", "empty_text": "missing_text",
    "non_string_text": "non_string", "invalid_language": "invalid_language", "length_mismatch": "unaligned_lists", "too_deep": "invalid_record",
}
REASONS = {
    "too_short": "too_short", "identical_text": "identical_text", "length_ratio": "length_ratio_outlier", "ko_script_mismatch": "language_mismatch", "ja_script_mismatch": "language_mismatch",
    "control_characters": "control_characters", "excessive_repetition": "excessive_repetition",
}
WARNINGS = {"structured_span_mismatch": "structured_span_warnings", "ja_no_kana": "ja_no_kana_warnings"}
COUNTERS = (
    "physical_lines", "valid_pairs", "invalid_json", "invalid_utf8", "invalid_record", "missing_text", "non_string", "invalid_language", "unaligned_lists", "duplicates", "quality_filtered", "too_short",
    "identical_text", "length_ratio_outlier", "language_mismatch", "control_characters", "excessive_repetition", "structured_span_warnings", "ja_no_kana_warnings", "split_conflicts", "too_long",
    "train", "validation", "test", "ko_tokens", "ja_tokens", "quality_score_sum", "synthetic_pairs", "forward_only_pairs",
)
ORDER = ["file", "digest", "ordinal"]


def source_first(rows: DataFrame, source_only: list[str]) -> DataFrame:
    """Sides swapped so that a language that is only ever a source stands first; ``forward_only`` marks its pairs."""
    swap = F.col("lang_b").isin(*source_only) if source_only else F.lit(False)
    side = lambda c, x, y: F.when(swap, F.col(f"{c}_{y}")).otherwise(F.col(f"{c}_{x}"))
    sides = [c[:-2] for c in rows.columns if c.endswith("_a") and f"{c[:-2]}_b" in rows.columns]
    new = {f"{c}_{x}": side(c, x, y) for c in sides for x, y in ("ab", "ba")}
    out = rows.select(*[new.get(c, F.col(c)).alias(c) for c in rows.columns])
    return out.withColumn("forward_only", F.col("lang_a").isin(*source_only) if source_only else F.lit(False))


def judged(
    pairs: DataFrame, languages: tuple[str, str], policy: quality.Policy | None = None, validation: float = 0.005, test: float = 0.005, approximate: bool = True,
    synthetic_prefix: str = "synthetic", filter_quality: bool = True, tokens: Callable[[Column], Column] | None = None, most_tokens: int | None = None,
    source_only: tuple[str, ...] = (),
) -> dict[str, DataFrame]:
    """What is left after each step: ``assessed``, ``good``, ``short`` enough, ``guarded`` and ``kept`` pairs.

    A line with several pairs is split by the line, a single pair by its source,
    a synthetic one is for training; an endpoint is never on two sides. Sides
    are swapped and long rows go before any endpoint is reserved. ``tokens``
    gives a text's token list, single characters unless it is given.
    """
    a, b = languages
    tokens = tokens or (lambda t: F.split(X.tokenizer_text(t), ""))
    assessed = quality.assess(pairs.filter((F.col("lang_a") == a) & (F.col("lang_b") == b)), "text_a", "text_b", languages, policy)
    good = source_first(quality.gate(assessed, filter_quality), list(source_only))
    good = good.withColumns({"tokens_a": F.size(tokens(F.col("text_a"))), "tokens_b": F.size(tokens(F.col("text_b")))})
    short = good if most_tokens is None else good.filter((F.col("tokens_a") <= most_tokens) & (F.col("tokens_b") <= most_tokens))
    name = F.element_at(F.split("file", "/"), -1)
    flag = F.coalesce(F.try_variant_get(F.try_parse_json("metadata"), "$.synthetic", "boolean"), F.lit(False)) | name.startswith(synthetic_prefix)
    ends = {f"end_{x}": dedup.endpoint(F.col(f"lang_{x}"), F.col(f"text_{x}"), approximate=approximate) for x in "ab"}
    out = short.withColumn("synthetic", flag).withColumns(ends)
    key = F.when(F.col("n_pairs") > 1, F.col("digest")).otherwise(F.col("end_a"))
    out = out.withColumn("split", F.when(F.col("synthetic"), F.lit("train")).otherwise(X.split_of(key, validation, test)))
    guarded = dedup.guarded(out, "split", ["end_a", "end_b"], ORDER)
    lines = guarded.dropDuplicates(ORDER)  # a line that a file repeats has one place in the order
    kept = dedup.first_owner(lines, F.concat("lang_a", F.lit("\0"), "lang_b", F.lit("\0"), dedup.pair_key(F.col("text_a"), F.col("text_b"))), ORDER)
    return {"assessed": assessed, "good": good, "short": short, "guarded": guarded, "kept": kept}


def prepared(pairs: DataFrame, languages: tuple[str, str], **options) -> DataFrame:
    """Accepted pairs with score, split, synthetic and forward-only flags, registers and protected texts."""
    out = judged(pairs, languages, **options)["kept"]
    slots = shared_slots(X.canonical_text(F.col("text_a")), X.canonical_text(F.col("text_b")))
    level = lambda x: F.coalesce(*[F.when(F.col(f"lang_{x}") == n, X.register(F.col(f"text_{x}"), n)) for n in languages], F.lit(0))
    return out.withColumns({"protected": slots, "register_a": level("a"), "register_b": level("b")})


def counters(lines: DataFrame, pairs: DataFrame, steps: dict[str, DataFrame]) -> DataFrame:
    """The counters of a run, by file and (``is_total`` 1) over all files.

    ``lines`` has a row per line and its file, ``pairs`` are all of ``records``
    and ``steps`` what ``judged`` gives. What a step lost is what it took in
    less what it let through; each step is one aggregate with a map-side part.
    """
    n = lambda c: F.coalesce(F.count_if(c), F.lit(0))
    of = lambda names, column, table: {new: [old for old, x in table.items() if x == new] for new in names}
    issue = {k: n(F.col("issue").isin(*v)) for k, v in of(dict.fromkeys(ISSUES.values()), "issue", ISSUES).items()}
    has = lambda column, olds: F.exists(column, lambda r: r.isin(*olds))
    reason = {k: n(has("rejections", v)) for k, v in of(dict.fromkeys(REASONS.values()), "rejections", REASONS).items()}
    warning = {k: n(has("warnings", v)) for k, v in of(WARNINGS.values(), "warnings", WARNINGS).items()}
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    kept = {"valid_pairs": F.count("*"), **{k: n(F.col("split") == k) for k in ("train", "validation", "test")}, "ko_tokens": total("tokens_a"), "ja_tokens": total("tokens_b")}
    kept |= {"quality_score_sum": total("score"), "synthetic_pairs": n(F.col("synthetic")), "forward_only_pairs": n(F.col("forward_only"))}
    parts = [
        (lines, {"physical_lines": F.count("*")}), (pairs, issue), (steps["assessed"], {"_assessed": F.count("*"), **reason, **warning}),
        (steps["good"], {"_good": F.count("*")}), (steps["short"], {"_short": F.count("*")}), (steps["guarded"], {"_guarded": F.count("*")}), (steps["kept"], kept),
    ]
    out = None
    for rows, aggs in parts:
        one = audit.with_total(rows, "file", *[v.cast("long").alias(k) for k, v in aggs.items()]).withColumn("file", F.coalesce("file", F.lit("")))
        out = one if out is None else out.join(one, ["file", "is_total"], "left")
    out = out.fillna(0)
    lost = {"quality_filtered": ("_assessed", "_good"), "too_long": ("_good", "_short"), "split_conflicts": ("_short", "_guarded"), "duplicates": ("_guarded", "valid_pairs")}
    out = out.withColumns({k: F.col(x) - F.col(y) for k, (x, y) in lost.items()})
    return out.select(F.when(F.col("is_total") == 0, F.col("file")).alias("file"), "is_total", *COUNTERS)


def training_lines(kept: DataFrame) -> DataFrame:
    """(language, text): both sides of the training pairs, what a tokenizer is trained on."""
    train = kept.filter("split = 'train'")
    return train.select(F.inline(F.array(*[F.struct(F.col(f"lang_{x}").alias("language"), X.tokenizer_text(F.col(f"text_{x}")).alias("text")) for x in "ab"])))


def both_ways(rows: DataFrame, forward_only: str = "forward_only") -> DataFrame:
    """The rows and, unless they are forward only, their reverse."""
    back = rows.filter(~F.col(forward_only)).select(F.col("lang_b").alias("lang_a"), F.col("text_b").alias("text_a"), F.col("lang_a").alias("lang_b"), F.col("text_a").alias("text_b"), *[c for c in rows.columns if c not in ("lang_a", "text_a", "lang_b", "text_b")])
    return rows.unionByName(back)


def foundation(rows: DataFrame, most: int = 400, least: int = 2, validation: float = 0.005) -> DataFrame:
    """Monolingual (language, text) as segments, one of each per language, with a split; no test part."""
    usable = rows.filter("status = 'ok'").withColumn("text", X.tokenizer_text(F.col("text"))).filter(F.col("text").rlike(r"[^\p{C}]"))
    parts = usable.select("language", F.explode(readers.segments(F.col("text"))).alias("text"))
    one = parts.groupBy("language", "text").agg(F.count("*").alias("copies"))
    return one.withColumn("split", X.split_of(F.concat("language", F.lit("\0"), "text"), validation, 0.0))


def recovered(rows: DataFrame, a: str, b: str, languages: tuple[str, str], morphemes=None, most_density: float = 0.2, policy: quality.Policy | None = None) -> DataFrame:
    """Rows of a damaged shard with their first reason to go (null if none); the order of the tests matters.

    Unparsable or one-sided rows, lost words, too many stray spaces, empty
    after repair, foreign scripts, quality, repeated pairs.
    """
    ta, tb = F.col(a), F.col(b)
    fixed = rows.withColumns({"_a": morphemes.column(ta) if morphemes else ta, "_b": tb})
    hole = F.split(F.trim(ta), r"\s+")[0].isin(*morphemes.tokens) if morphemes else F.lit(False)
    stray = X.spurious_spaces(F.col("_a")) + X.spurious_spaces(F.col("_b"))
    density = stray / F.greatest(F.lit(1), X.visible_length(F.col("_a")) + X.visible_length(F.col("_b")))
    flat = fixed.withColumns({"_hole": hole, "_density": density}).withColumns({"_a": X.canonical_text(X.collapse_spaces(F.col("_a"))), "_b": X.canonical_text(X.collapse_spaces(F.col("_b")))})
    judged = quality.assess(flat, "_a", "_b", languages, policy)
    reason = (
        F.when(ta.isNull() | tb.isNull(), "missing_side").when(F.col("_hole"), "lost_word").when(F.col("_density") > most_density, "too_many_spaces").when((F.col("_a") == "") | (F.col("_b") == ""), "empty")
        .when((F.size(X.foreign_scripts(F.col("_a"), [languages[0]])) > 0) | (F.size(X.foreign_scripts(F.col("_b"), [languages[1]])) > 0), "foreign_script").when(~F.col("accepted"), "quality")
    )
    out = judged.withColumn("drop_reason", reason)
    order = [c for c in ("file", "line") if c in rows.columns] or ["_a"]
    first = out.filter("drop_reason IS NULL").groupBy("_a", "_b").agg(F.min(F.struct(*order)).alias("_f"))
    out = out.join(first, ["_a", "_b"], "left")
    late = F.col("drop_reason").isNull() & (F.struct(*order) != F.col("_f"))
    return out.withColumn("drop_reason", F.when(late, "duplicate").otherwise(F.col("drop_reason"))).select(*rows.columns, F.col("_a").alias(f"clean_{a}"), F.col("_b").alias(f"clean_{b}"), "drop_reason")
