"""Counters, percentiles, template collapse, token exposure and budgets, each in one or two aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X


def with_total(rows: DataFrame, by: str, *aggs: Column) -> DataFrame:
    """Aggregates of each group and of all rows, in one pass; ``is_total`` marks the latter."""
    return rows.groupingSets([[by], []], by).agg(F.grouping(by).cast("int").alias("is_total"), *aggs)


def rate(hits: Column, n: Column) -> Column:
    """A share rounded to eight places, 0 without rows."""
    return F.when(n > 0, F.round(hits / n, 8)).otherwise(F.lit(0.0))


def distinct_up_to(value: Column, most: int) -> Column:
    """The exact number of distinct values, null beyond ``most``."""
    n = F.count_distinct(value)
    return F.when(n <= most, n)


def nearest_rank(value: str, *shares: float) -> list[Column]:
    return [F.expr(f"percentile_disc({s}) WITHIN GROUP (ORDER BY {value})").alias(f"p{round(s * 100)}") for s in shares]


def index_percentiles(rows: DataFrame, value: str, shares: list[float], by: list[str] | None = None) -> DataFrame:
    """Percentiles at index round((n - 1) * share), half to even: counts of distinct values, then running sums.

    The window runs over distinct values with their counts, not over rows.
    """
    by = by or []
    counts = rows.filter(F.col(value).isNotNull()).groupBy(*by, value).count()
    w = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))
    run = counts.withColumn("_hi", F.sum("count").over(w.orderBy(value))).withColumn("_n", F.sum("count").over(w))
    pick = [F.max(F.when((F.bround((F.col("_n") - 1) * F.lit(s)) < F.col("_hi")) & (F.bround((F.col("_n") - 1) * F.lit(s)) >= F.col("_hi") - F.col("count")), F.col(value))).alias(f"p{round(s * 100)}") for s in shares]
    return run.groupBy(*by).agg(*pick)


def template_audit(rows: DataFrame, source: str, target: str) -> DataFrame:
    """One row: distinct skeletons per row, duplicate pairs, sources with several targets, largest fan-out."""
    base = rows.select(X.skeleton(F.col(source)).alias("k"), F.col(source).alias("s"), F.col(target).alias("t"))
    pairs = base.groupBy("k", "s", "t").agg(F.count("*").alias("n"))
    sources = pairs.groupBy("s").agg(F.sum("n").alias("n"), F.count("*").alias("targets")).agg(F.count("*").alias("sources"), F.count_if(F.col("targets") > 1).alias("conflicting"), F.max("targets").alias("max_fan_out"))
    frames = pairs.groupBy("k").agg(F.sum("n").alias("n")).agg(F.count("*").alias("skeletons"), F.max("n").alias("largest"))
    whole = pairs.agg(F.sum("n").alias("rows"), F.count("*").alias("distinct_pairs"))
    one = whole.crossJoin(sources).crossJoin(frames)  # three single rows
    return one.select("rows", "skeletons", "largest", rate(F.col("skeletons"), F.col("rows")).alias("skeleton_ttr"), rate(F.col("rows") - F.col("distinct_pairs"), F.col("rows")).alias("duplicate_rate"), rate(F.col("conflicting"), F.col("sources")).alias("conflict_rate"), "max_fan_out")


def top(rows: DataFrame, value: Column, most: int, name: str = "value") -> DataFrame:
    """The most frequent values; ties by value."""
    return rows.select(value.alias(name)).groupBy(name).agg(F.count("*").alias("n")).orderBy(F.desc("n"), name).limit(most)


def exposure(rows: DataFrame, tokens: str, by: list[str]) -> DataFrame:
    """How often each token was seen: (by.., token, n)."""
    return rows.select(*by, F.explode(tokens).alias("token")).groupBy(*by, "token").agg(F.count("*").alias("n"))


def exposure_buckets(seen: DataFrame, vocabulary: DataFrame, by: list[str]) -> DataFrame:
    """Tokens never seen, seen once, 1 to 9 and 1 to 24 times, for each group, over a whole vocabulary.

    Absent tokens are counted as the vocabulary's size less those that are
    there, so groups and vocabulary are never multiplied.
    """
    words = vocabulary.select("token").distinct()
    size = words.agg(F.count("*").alias("_size"))
    n = F.when(F.col("_known"), F.col("n"))
    marked = seen.join(words.withColumn("_known", F.lit(True)), "token", "left")
    buckets = {"once": n == 1, "under_10": n.between(1, 9), "under_25": n.between(1, 24)}
    per = marked.groupBy(*by).agg(F.coalesce(F.sum(n), F.lit(0)).alias("tokens"), F.count_if(n > 0).alias("_types"), *[F.count_if(c).alias(k) for k, c in buckets.items()])
    return per.crossJoin(size).select(*by, "tokens", (F.col("_size") - F.col("_types")).alias("unseen"), *buckets)  # size is a single row


def required_characters(rows: DataFrame, text: Column, least: int = 25, reserved: str = "") -> DataFrame:
    """Characters seen at least ``least`` times, no white space and none reserved."""
    c = F.explode(F.split(F.regexp_replace(text, X.WS, ""), "")).alias("character")
    out = rows.select(c).filter("character <> ''").groupBy("character").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    return out.filter(~F.col("character").isin(*reserved)) if reserved else out


def sampling_weights(counts: DataFrame, n: str, alpha: float = 0.5) -> DataFrame:
    """n ** alpha over its sum, and whether a group is far smaller than the largest; a row per group."""
    w = W.partitionBy(F.lit(0))
    out = counts.withColumn("weight", F.pow(n, F.lit(alpha)) / F.sum(F.pow(n, F.lit(alpha))).over(w))
    return out.withColumn("share", F.col(n) / F.sum(n).over(w)).withColumn("scarce", F.col(n) * 20 < F.max(n).over(w))


def budgets(parallel: DataFrame, language: str, n: str, ratio: float, present: DataFrame) -> DataFrame:
    """Monolingual budget of each present language: ratio times its parallel rows, else times their mean."""
    mean = parallel.agg(F.avg(n).alias("_mean"))
    out = present.join(parallel, language, "left").crossJoin(mean)
    return out.select(language, F.floor(F.coalesce(n, "_mean") * F.lit(ratio)).alias("budget"))


def synthetic_budget(rows: DataFrame, synthetic: Column, ratio: float) -> DataFrame:
    """Synthetic rows that may be added: ratio times the real ones, less those there are, 0 at least."""
    real, have = F.count_if(~synthetic), F.count_if(synthetic)
    return rows.agg(real.alias("real"), have.alias("synthetic"), F.greatest(F.lit(0).cast("bigint"), F.floor(real * F.lit(ratio)) - have).alias("budget"))


def water_fill(sizes: dict[str, int], temperature: float, most_repeats: float) -> dict[str, float]:
    """Temperature weights of sources, none drawn more than ``most_repeats`` times its size; the excess goes to the others."""
    total = sum(sizes.values())
    weight = {k: v ** (1 / temperature) for k, v in sizes.items() if v}
    fixed: dict[str, float] = {}
    while True:
        free = {k: w for k, w in weight.items() if k not in fixed}
        left = 1 - sum(fixed.values())
        norm = sum(free.values())
        share = {k: left * w / norm for k, w in free.items()} if norm else {}
        over = {k: most_repeats * sizes[k] / total for k, s in share.items() if s * total > most_repeats * sizes[k]}
        if not over or len(over) == len(free):
            return {k: v / max(sum((fixed | share).values()), 1e-12) for k, v in (fixed | share).items()}
        fixed |= over


def checked(rows: DataFrame, source: str, output: str, scripts: list[str], normal: bool = True, units: bool = True) -> DataFrame:
    """Adds ``sign``, ``number`` and ``unit`` (F1 of the bags, and whether they are equal), ``foreign`` scripts and ``passed`` to each row."""
    from ..functions.spans import unit_tokens

    s, o = F.col(source), F.col(output)
    bags = {"sign": (X.sign_markers(s, normal), X.sign_markers(o, normal)), "number": (X.numeric_tokens(s, normal), X.numeric_tokens(o, normal))}
    if units:
        bags["unit"] = (unit_tokens(s), unit_tokens(o))
    cols = {k: F.struct(X.bag_f1(a, b).alias("f1"), (F.array_sort(a) == F.array_sort(b)).alias("ok")) for k, (a, b) in bags.items()}
    out = rows.withColumns(cols | {"foreign": X.foreign_scripts(o, scripts)})
    passed = F.size("foreign") == 0
    for k in bags:
        passed = passed & F.col(f"{k}.ok")
    return out.withColumn("passed", passed)


def preservation(rows: DataFrame, source: str, output: str, scripts: list[str], normal: bool = True, units: bool = True) -> DataFrame:
    """One row: mean F1 of signs, units and numbers times 100, violations, rows with foreign scripts and these scripts."""
    aggs = [F.count("*").alias("sentences")]
    for k in ("sign", "number", "unit") if units else ("sign", "number"):
        aggs += [F.round(F.avg(f"{k}.f1") * 100, 6).alias(f"{k}_f1"), F.count_if(~F.col(f"{k}.ok")).alias(f"{k}_violations")]
    seen = F.array_sort(F.array_distinct(F.flatten(F.collect_set("foreign"))))  # sets of a few script names
    return checked(rows.select(source, output), source, output, scripts, normal, units).agg(
        *aggs, F.count_if(F.size("foreign") > 0).alias("script_violations"), seen.alias("foreign_scripts")
    )
