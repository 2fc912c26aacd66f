"""Pair quality: reasons to reject or to warn, and a score; profiles that waive narrow reasons; UI string rules."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

# Points that a reason takes from 100.
PENALTIES = {
    "too_short": 45, "length_ratio": 25, "identical_text": 50, "ko_script_mismatch": 35, "ja_script_mismatch": 35,
    "control_characters": 40, "excessive_repetition": 40, "structured_span_mismatch": 10, "ja_no_kana": 10,
}
EXPRESSIVE, WAIVED = "expressive_v1", ("too_short", "excessive_repetition")


@dataclass(frozen=True)
class Policy:
    """Thresholds of the pair rules, and switches for what an input needs not (normal forms, spans, phrases)."""

    least_chars: int = 2
    most_ratio: float = 5.0
    least_fraction: float = 0.10
    least_letters: int = 4
    kana_letters: int = 12
    identical: bool = True
    scripts: bool = True
    controls: bool = True
    repetition: bool = True
    phrases: bool = True
    normal: bool = True
    spans: bool = True

    def __post_init__(self):
        if self.least_chars < 1 or self.most_ratio <= 1 or not 0 <= self.least_fraction <= 1 or self.least_letters < 1 or self.kana_letters < 1:
            raise ValueError("thresholds out of range")


def reasons(a: Column, b: Column, languages: tuple[str, str], p: Policy, keys: tuple[Column, Column] | None = None) -> tuple[Column, Column, dict[str, Column]]:
    """(rejections, warnings, measures) of a pair of canonical texts; ``keys`` are their surface keys."""
    na, nb = X.visible_length(a), X.visible_length(b)
    ratio = F.greatest(na, nb) / F.greatest(F.lit(1), F.least(na, nb))
    la, lb = X.letter_count(a), X.letter_count(b)
    fa, fb = X.language_fraction(a, languages[0]), X.language_fraction(b, languages[1])
    ka, kb = keys or (X.surface_key(a, p.normal), X.surface_key(b, p.normal))
    no = F.lit(False)
    rules = (
        ("too_short", (na < p.least_chars) | (nb < p.least_chars)),
        ("length_ratio", ratio > p.most_ratio),
        ("identical_text", (ka != "") & (ka == kb) if p.identical else no),
        ("ko_script_mismatch", (la >= p.least_letters) & (fa < p.least_fraction) if p.scripts else no),
        ("ja_script_mismatch", (lb >= p.least_letters) & (fb < p.least_fraction) if p.scripts else no),
        ("control_characters", X.has_control(a) | X.has_control(b) if p.controls else no),
        ("excessive_repetition", X.excessive_repetition(a, p.phrases) | X.excessive_repetition(b, p.phrases) if p.repetition else no),
    )
    soft = [("length_ratio", (ratio > min(2.5, p.most_ratio)) & (ratio <= p.most_ratio))]
    if languages[1] == "ja":
        soft.append(("ja_no_kana", (lb >= p.kana_letters) & (X.kana_count(b) == 0) & (X.script_count(b, "han") >= 4)))
    if p.spans:
        from ..functions.spans import similarity

        soft.append(("structured_span_mismatch", X.let(similarity(a, b), lambda s: s["critical"] | (s["score"] < 0.5))))
    pick = lambda rs: F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rs]))
    return pick(rules), pick(soft), {"chars_a": na, "chars_b": nb, "length_ratio": ratio, "fraction_a": fa, "fraction_b": fb}


def _points(names: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in PENALTIES.items() for x in kv])
    return F.aggregate(names, F.lit(0), lambda s, n: s + table[n])


def assess(pairs: DataFrame, a: str, b: str, languages: tuple[str, str] = ("ko", "ja"), policy: Policy | None = None, profile: str | None = None) -> DataFrame:
    """Adds rejections, warnings, the measures, score (0 to 100) and accepted.

    ``profile`` names a column; rows that say ``expressive_v1`` are excused
    from being short or repetitive, and get those points back.
    """
    p = policy or Policy()
    ca, cb = F.col("_canonical_a"), F.col("_canonical_b")
    out = pairs.withColumns({"_canonical_a": X.canonical_text(F.col(a), p.normal), "_canonical_b": X.canonical_text(F.col(b), p.normal)})
    out = out.withColumns({"_key_a": X.surface_key(ca, p.normal), "_key_b": X.surface_key(cb, p.normal)})
    bad, soft, measures = reasons(ca, cb, languages, p, (F.col("_key_a"), F.col("_key_b")))
    out = out.withColumns(measures | {"rejections": bad, "warnings": soft}).drop("_canonical_a", "_canonical_b", "_key_a", "_key_b")
    score = F.greatest(F.lit(0), 100 - _points(F.col("rejections")) - _points(F.col("warnings")))
    out = out.withColumn("score", score)
    if profile:
        waived = F.filter("rejections", lambda r: r.isin(*WAIVED))
        mine = F.coalesce(F.col(profile) == EXPRESSIVE, F.lit(False))
        out = out.withColumn("score", F.when(mine & (F.size(waived) > 0), F.least(F.lit(100), F.col("score") + _points(waived))).otherwise(F.col("score")))
        out = out.withColumn("rejections", F.when(mine, F.array_except("rejections", F.array(*map(F.lit, WAIVED)))).otherwise(F.col("rejections")))
    return out.withColumn("accepted", F.size("rejections") == 0)


def gate(assessed: DataFrame, quality: bool = True) -> DataFrame:
    """Accepted rows; with ``quality=False`` only control characters still reject."""
    return assessed.filter("accepted" if quality else "NOT array_contains(rejections, 'control_characters')")


# What a user-interface string holds besides words, and the scripts its two sides must show.
PLACEHOLDER = (
    r"\{\s*[$-]?[A-Za-z_][A-Za-z0-9_.:-]*\s*\}|\{\p{Nd}+\}|%(?:\p{Nd}+\$)?[A-Za-z]|\$\{[A-Za-z_][A-Za-z0-9_.:-]*\}|"
    r"</?[A-Za-z][^>]*>|&[A-Za-z][A-Za-z0-9]+;"
)
EXPECTED = {"ko": r"[\x{AC00}-\x{D7A3}]", "ja": r"[\x{3040}-\x{30FF}\x{3400}-\x{9FFF}]"}
ACCESS_KEYS = ("accesskey", ".key", "/keybinding")


def placeholder_bag(t: Column) -> Column:
    """Sorted placeholders of a text; a tag counts by its name alone."""
    tag = r"^</?([A-Za-z][A-Za-z0-9:-]*).*$"
    plain = lambda x: F.when(x.startswith("<"), F.concat(F.lit("<"), F.lower(F.regexp_replace(x, f"(?s){tag}", "$1")), F.lit(">"))).otherwise(x)
    return F.array_sort(F.transform(F.regexp_extract_all(t, F.lit(PLACEHOLDER), F.lit(0)), lambda x: F.replace(plain(x), F.lit(" "), F.lit(""))))


def ui_reason(
    a: Column, b: Column, resource: Column | None = None, expected: tuple[str, str] = (EXPECTED["ko"], EXPECTED["ja"]), most: int = 800, normal: bool = True
) -> Column:
    """The first rule that a pair of user-interface strings breaks; null if none.

    ``resource`` is the string's id, by which access keys are told; ``expected``
    are patterns of which each side must hold one.
    """
    na, nb = F.length(a), F.length(b)
    ratio = na / F.greatest(nb, F.lit(1))
    shown = lambda t: F.length(F.regexp_replace(t, r"[^\p{L}\p{N}_]", ""))
    digits = lambda t: F.array_sort(F.regexp_extract_all(t, F.lit(r"\p{Nd}+"), F.lit(0)))
    same = lambda t: X.casefold(X.canonical_text(t)) if normal else F.lower(X.canonical_text(t, False))
    low = F.lower(F.coalesce(resource, F.lit(""))) if resource is not None else F.lit("")
    access = F.lit(False)
    for term in ACCESS_KEYS:
        access = access | F.contains(low, F.lit(term))
    empty = F.coalesce(a, F.lit("")) == ""
    return (
        F.when(empty | (F.coalesce(b, F.lit("")) == ""), "empty")
        .when((na > most) | (nb > most), "too_long")
        .when(~a.rlike(expected[0]) | ~b.rlike(expected[1]), "missing_expected_script")
        .when(F.least(shown(a), shown(b)) < 2, "too_short")
        .when((ratio < 0.2) | (ratio > 5.0), "length_ratio")
        .when(placeholder_bag(a) != placeholder_bag(b), "placeholder_mismatch")
        .when(digits(a) != digits(b), "number_mismatch")
        .when(access & (F.greatest(na, nb) <= 3), "access_key")
        .when(same(a) == same(b), "identical")
    )
