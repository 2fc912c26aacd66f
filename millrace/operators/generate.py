"""Synthetic rows: concatenations, corrupted drafts, slot-filled frames, numbers; every row from its own seed.

A row's randomness is a hash of the seed and its key, so a lost task makes the
same rows again. Parity with another generator's random numbers is no aim.
"""

from __future__ import annotations

import itertools
import random
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .select import seeded

# How often each kind of damage is done.
CORRUPTIONS = {"number": 0.26, "drop_clause": 0.16, "truncate": 0.12, "repeat": 0.10, "copy_source": 0.06, "swap": 0.10, "identity": 0.20}


def corrupt(kind: str, source: str, text: str, rnd: random.Random) -> str:
    """One kind of damage to a translation; the text itself where it gives no hold."""
    clauses = [c for c in re.split(r"(?<=[,;、，。.!?！？])\s*", text) if c]
    if kind == "copy_source":
        return source
    if kind == "number" and (found := list(re.finditer(r"\d+", text))):
        m = rnd.choice(found)
        return f"{text[: m.start()]}{int(m[0]) + rnd.randint(1, 9)}{text[m.end() :]}"
    if kind == "drop_clause" and len(clauses) > 1:
        del clauses[rnd.randrange(len(clauses))]
    elif kind == "swap" and len(clauses) > 1:
        i = rnd.randrange(len(clauses) - 1)
        clauses[i], clauses[i + 1] = clauses[i + 1], clauses[i]
    elif kind == "truncate" and len(text) >= 8:
        return text[: rnd.randint(len(text) // 4, 3 * len(text) // 4)].strip()
    elif kind == "repeat" and len(text) >= 6:
        n = rnd.randint(2, 6)
        i = rnd.randrange(max(1, len(text) - n))
        return text[: i + n] + text[i : i + n] * rnd.randint(4, 6) + text[i + n :]
    elif kind not in CORRUPTIONS:
        raise ValueError(kind)
    else:
        return text
    return " ".join(c.strip() for c in clauses)


def revisions(rows: DataFrame, key: str, source: str, target: str, weights: dict[str, float] | None = None, seed: str = "revision") -> DataFrame:
    """(.., kind, draft, changed): each translation with one corruption, drawn by weight; a draft of nothing is the text itself."""
    weights = weights or CORRUPTIONS
    if set(weights) - set(CORRUPTIONS) or sum(weights.values()) <= 0:
        raise ValueError(f"weights of {sorted(CORRUPTIONS)} are wanted, with a positive sum")
    kinds, shares = list(weights), list(weights.values())

    @F.pandas_udf("kind string, draft string, changed boolean")
    def run(k: pd.Series, s: pd.Series, t: pd.Series) -> pd.DataFrame:
        out = []
        for a, x, y in zip(k, s, t, strict=True):
            rnd = random.Random(f"{seed}\0{a}")
            kind, y = rnd.choices(kinds, shares)[0], y or ""
            draft = corrupt(kind, x or "", y, rnd)
            kind, draft = (kind, draft) if draft.strip() else ("identity", y)
            out.append((kind, draft, draft.strip() != y.strip()))
        return pd.DataFrame(out, columns=["kind", "draft", "changed"])

    return rows.withColumn("_r", run(F.col(key).cast("string"), F.col(source), F.col(target))).select(*rows.columns, "_r.*")


def concatenate(rows: DataFrame, source: str, target: str, least: int = 2, most: int = 4, most_chars: int = 480, separator: str = " ", seed: str = "concat") -> DataFrame:
    """Unrelated pairs joined ``least`` to ``most`` at a time, at most ``most_chars`` characters a side.

    Rows are dealt to groups of about the middle size by a seeded hash, larger
    groups are cut at ``most``; what is left under ``least`` joins nothing. No
    global order is needed and no pair is used twice.
    """
    if least < 2 or most < least:
        raise ValueError("at least two rows are joined, and no fewer at most")
    from pyspark.sql import Window as W

    n = rows.count()
    ranked = rows.withColumn("_rank", seeded(seed, F.col(source), F.col(target)))
    ranked = ranked.withColumn("_g", F.pmod(F.xxhash64("_rank"), F.lit(max(1, 2 * n // (least + most)))))
    slot = ranked.withColumn("_p", F.floor((F.row_number().over(W.partitionBy("_g").orderBy("_rank")) - 1) / most))
    parts = F.array_sort(F.collect_list(F.struct("_rank", F.col(source).alias("s"), F.col(target).alias("t"))))  # ``most`` rows
    agg = slot.groupBy("_g", "_p").agg(parts.alias("x")).filter(F.size("x") >= least)
    side = lambda c, name: F.array_join(F.transform("x", lambda v: v[c]), separator).alias(name)
    out = agg.select(side("s", source), side("t", target), F.size("x").alias("sentences"))
    return out.filter((F.length(source) <= most_chars) & (F.length(target) <= most_chars))


def frames(spark: SparkSession, templates: list[tuple[str, str]], slots: dict[str, list[tuple[str, str]]], most_frame: int, seed: str = "frames") -> DataFrame:
    """Templates filled with all combinations of their slots' values, the first ``most_frame`` of each in seeded order.

    Slot tables are configuration; a template whose slots differ on both sides is an error.
    """
    rows = []
    for i, (a, b) in enumerate(templates):
        names = re.findall(r"\{(\w+)\}", a)
        if sorted(names) != sorted(re.findall(r"\{(\w+)\}", b)):
            raise ValueError(f"slots differ in template {i}")
        if len(names) < 1:
            raise ValueError(f"no slot in template {i}")
        for values in itertools.product(*(slots[n] for n in names)):
            left, right = ({n: v[k] for n, v in zip(names, values, strict=True)} for k in (0, 1))
            rows.append((i, a.format(**left), b.format(**right)))
    from .dedup import capped

    df = spark.createDataFrame(rows, "frame int, source string, target string").distinct()
    return capped(df, ["frame"], [seeded(seed, F.col("source"), F.col("target"))], most_frame).drop("rank")


NUMBER_KINDS = ("cardinal", "percentage", "currency", "date", "time", "measurement", "range", "identifier", "technical")


def _numbers(spark: SparkSession, quotas: dict[str, int], templates: dict[str, tuple[str, str]], seed: int) -> DataFrame:
    total = sum(quotas.values())
    edges = list(itertools.accumulate(quotas.values()))
    kinds = list(quotas)
    i = F.col("id")
    kind = F.lit(kinds[-1])
    for k, e in reversed(list(zip(kinds, edges, strict=True))):
        kind = F.when(i < e, F.lit(k)).otherwise(kind)
    h = lambda n, salt: F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), i), F.lit(n))
    pad = lambda c, n: F.lpad(c.cast("string"), n, "0")
    value = {
        "cardinal": (h(10**6, 1) + 1).cast("string"), "percentage": F.concat(h(100, 2), F.lit("."), h(10, 3), F.lit("%")), "currency": F.format_number((h(10**6, 4) + 1) * 10, 0), "date": F.concat_ws("-", h(60, 5) + 1970, pad(h(12, 6) + 1, 2), pad(h(28, 7) + 1, 2)),
        "time": F.concat_ws(":", pad(h(24, 8), 2), pad(h(60, 9), 2)), "measurement": F.concat(h(999, 10) + 1, F.lit(" kg")), "range": F.concat(h(50, 11) + 1, F.lit("-"), h(50, 12) + 51), "identifier": F.concat(F.lit("ID-"), pad(h(10**6, 13), 6)), "technical": F.concat(h(128, 14) + 1, F.lit(" GB")),
    }
    v = F.lit(None).cast("string")
    for k in kinds:
        v = F.when(kind == k, value[k]).otherwise(v)
    side = lambda n: F.replace(F.create_map(*[F.lit(x) for k in kinds for x in (k, templates[k][n])])[F.col("kind")], F.lit("{v}"), F.col("value"))
    out = spark.range(total).select(kind.alias("kind"), v.alias("value")).select("kind", "value", side(0).alias("source"), side(1).alias("target"))
    return out.dropDuplicates(["source", "target"])


def numbers(spark: SparkSession, quotas: dict[str, int], templates: dict[str, tuple[str, str]], seed: int = 0) -> DataFrame:
    """Pairs whose two sides hold the same values, exactly ``quotas`` of each kind and none twice.

    More are drawn until every quota is met; a kind that 30 times its quota does
    not fill is an error. A pair whose sides hold other numbers is one as well.
    """
    from .dedup import capped

    for factor in (2, 8, 30):
        drawn = _numbers(spark, {k: n * factor for k, n in quotas.items()}, templates, seed)
        out = capped(drawn, ["kind"], [seeded(str(seed), F.col("source"), F.col("target"))], max(quotas.values(), default=0))
        quota = F.create_map(*[F.lit(x) for kv in quotas.items() for x in kv]) if quotas else None
        out = out.filter(F.col("rank") <= quota[F.col("kind")]).drop("rank") if quotas else out.drop("rank")
        have = {r["kind"]: r["n"] for r in out.groupBy("kind").agg(F.count("*").alias("n")).collect()}  # a row per kind
        if all(have.get(k, 0) == n for k, n in quotas.items()):
            return same_numbers(out, "source", "target", "value")
    raise ValueError(f"quotas cannot be met: {have} of {quotas}")


def same_numbers(rows: DataFrame, source: str, target: str, value: str) -> DataFrame:
    """The rows, or an error where the sides' numbers differ or a side lacks its value."""
    bag = lambda c: F.array_sort(F.regexp_extract_all(F.col(c), F.lit(r"\p{Nd}+"), F.lit(0)))
    kept = F.contains(F.col(source), F.col(value)) & F.contains(F.col(target), F.col(value))
    wrong = F.raise_error(F.concat(F.lit("numbers differ: "), F.col(source), F.lit(" / "), F.col(target)))
    return rows.withColumn(source, F.when((bag(source) == bag(target)) & kept, F.col(source)).otherwise(wrong))


def challenge(seeds: DataFrame, a: str, b: str) -> tuple[DataFrame, DataFrame]:
    """Training rows, and two challenge cases of each held-out seed, one per direction."""
    train = seeds.filter("split = 'train'").drop("split")
    held = seeds.filter("split = 'challenge'")
    case = lambda s, t, i: F.struct(F.concat(F.col("id"), F.lit(i)).alias("id"), F.lit(s).alias("source_language"), F.lit(t).alias("target_language"), F.col(s).alias("source"), F.col(t).alias("reference"))
    return train, held.select(F.inline(F.array(case(a, b, f"-{a}-{b}"), case(b, a, f"-{b}-{a}"))))


def unique_or_fail(rows: DataFrame, key: Column, name: str) -> DataFrame:
    """The rows, or an error that names a repeated key."""
    twice = rows.groupBy(key.alias("k")).count().filter("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"repeated {name}: {twice[0]['k']}")
    return rows
