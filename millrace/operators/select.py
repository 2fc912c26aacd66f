"""Capped and ranked selection: seeded orders, best of a source, greedy matchings, alignment and mining."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .dedup import capped


def seeded(seed: str, *parts: Column) -> Column:
    """A rank that looks random and depends on nothing but the seed and the row."""
    return F.sha2(F.concat_ws("\0", F.lit(seed), *parts), 256)


def fraction(seed: str, t: Column) -> Column:
    """The first 64 bits of the rank as a fraction of 1, for sampling by threshold."""
    return F.conv(F.substring(seeded(seed, t), 1, 16), 16, 10).cast("decimal(20,0)").cast("double") / F.lit(float(2**64))


def frame_caps(rows: DataFrame, outer: list[str], frame: list[str], most_outer: int, most_frame: int, rank: Column) -> DataFrame:
    """At most so many rows a frame, then a style or region; equal to the greedy pass as frames lie within styles."""
    ranked = rows.withColumn("_rank", rank)
    inner = capped(ranked, [*outer, *frame], [F.col("_rank")], most_frame, "_n")
    return capped(inner, outer, [F.col("_rank")], most_outer, "_n").drop("_n", "_rank")


def greedy_caps(rows: DataFrame, keys: list[str], most: int, rank: Column, group: list[str]) -> DataFrame:
    """Greedy caps on several keys at once: a row stays if none of its keys is full, and only kept rows fill them.

    Sequential by nature. ``group`` names columns that no key crosses; each
    group is one task, so it must be bounded (a template's rows, say).
    """
    ranked = rows.withColumn("_rank", rank)

    def keep(pdf: pd.DataFrame) -> pd.DataFrame:
        used: dict[tuple, int] = {}
        ok = []
        for r in pdf.sort_values("_rank").itertuples():
            mine = [(k, v) for k in keys for v in (getattr(r, k) if isinstance(getattr(r, k), list | tuple) or hasattr(getattr(r, k), "tolist") else [getattr(r, k)])]
            if all(used.get(x, 0) < most for x in mine):
                for x in mine:
                    used[x] = used.get(x, 0) + 1
                ok.append(r.Index)
        return pdf.loc[ok]

    return ranked.groupBy(*group).applyInPandas(keep, ranked.schema).drop("_rank")


def best_of(rows: DataFrame, by: str, order: list[Column]) -> DataFrame:
    """The best row of each group."""
    return capped(rows, [by], order, 1, "_n").drop("_n")


def unique_matching(edges: DataFrame, source: str, target: str, score: str, tie: Column, most_rounds: int | None = None) -> DataFrame:
    """The greedy one-to-one matching by score, without a sequential pass.

    In every round the edges that are first for both their ends are taken and
    all others at these ends go, until no edge is left. The set is the one that
    a pass over all edges in order would keep. Each round is cut off with a
    checkpoint. A tie that is hashed over the edge keeps the rounds few where
    many edges have one score; one in the order of the ends takes a round for
    each match. Edges without an end or a score match nothing. Edges left after ``most_rounds`` rounds are an error, never a part.
    """
    edges = edges.filter(F.col(source).isNotNull() & F.col(target).isNotNull() & F.col(score).isNotNull())
    left = edges.withColumn("_tie", tie).checkpoint()
    taken = None
    n = 0
    while not left.isEmpty():
        if n == most_rounds:
            raise RuntimeError(f"unique_matching: edges are left after {n} rounds")
        n += 1
        # the struct's smallest value is the best edge: score descending, then tie
        key = F.struct((-F.col(score)).alias("s"), F.col("_tie").alias("t"))
        a = left.groupBy(source).agg(F.min(key).alias("_a"))
        b = left.groupBy(target).agg(F.min(key).alias("_b"))
        first = left.join(a, source).join(b, target).filter((F.col("_a") == key) & (F.col("_b") == key)).select(*left.columns).checkpoint()
        if first.isEmpty():
            raise RuntimeError("unique_matching: no edge is first for both its ends; the tie must order all edges")
        taken = first if taken is None else taken.unionByName(first)
        left = left.join(first.select(source), source, "left_anti").join(first.select(target), target, "left_anti").select(*left.columns).checkpoint()
    return edges.limit(0) if taken is None else taken.drop("_tie")


def sample_to_budget(rows: DataFrame, t: Column, budget: int, seed: str) -> DataFrame:
    """Exactly ``budget`` rows (all, if fewer) with the smallest ranks: a threshold first, the cut on what it leaves.

    Rows of one text share their rank, so a threshold may leave too few; it is
    raised until enough are left.
    """
    ranked = rows.withColumn("_u", fraction(seed, t))
    n = rows.count()
    share = 1.2 * budget / max(n, 1) + 1e-3
    while share < 1 and ranked.filter(F.col("_u") < share).limit(min(budget, n)).count() < min(budget, n):
        share *= 2
    near = ranked.filter(F.col("_u") < share) if share < 1 else ranked
    return near.orderBy("_u", t).limit(budget).drop("_u")


def examples(rows: DataFrame, by: list[str], order: list[Column], most: int = 3) -> DataFrame:
    return capped(rows, by, order, most)


# mining -----------------------------------------------------------------------------


def term_pairs(rows: DataFrame, source_terms: str, target_terms: str, least: int = 2, least_dice: float = 0.0) -> DataFrame:
    """(s, t, together, n_s, n_t, dice) of terms that share rows: Dice = 2 * together / (n_s + n_t).

    Terms are distinct within a row; pairs arise within rows only.
    """
    sets = rows.select(F.array_distinct(source_terms).alias("a"), F.array_distinct(target_terms).alias("b"))
    ns = sets.select(F.explode("a").alias("s")).groupBy("s").agg(F.count("*").alias("n_s"))
    nt = sets.select(F.explode("b").alias("t")).groupBy("t").agg(F.count("*").alias("n_t"))
    both = sets.select(F.explode("a").alias("s"), "b").select("s", F.explode("b").alias("t")).groupBy("s", "t").agg(F.count("*").alias("together")).filter(F.col("together") >= least)
    out = both.join(ns, "s").join(nt, "t").withColumn("dice", 2.0 * F.col("together") / (F.col("n_s") + F.col("n_t")))
    return out.filter(F.col("dice") >= least_dice)


def mutual_best(pairs: DataFrame, margin: float = 0.0) -> DataFrame:
    """Pairs that are each other's best, by Dice, then count, then terms."""
    order = lambda other: [F.desc("dice"), F.desc("together"), other]
    a = W.partitionBy("s").orderBy(*order("t"))
    b = W.partitionBy("t").orderBy(*order("s"))
    ranked = pairs.withColumn("_a", F.row_number().over(a)).withColumn("_b", F.row_number().over(b)).withColumn("_next", F.lead("dice").over(a))
    return ranked.filter((F.col("_a") == 1) & (F.col("_b") == 1) & ((F.col("dice") - F.coalesce("_next", F.lit(-1.0))) > margin)).drop("_a", "_b", "_next")


def longest_first(terms: DataFrame, source: str, target: str) -> DataFrame:
    """One target a source term, longest sources first in the result's order column."""
    one = capped(terms, [source], [F.length(target).desc(), F.col(target)], 1, "_n").drop("_n")
    return one.withColumn("priority", -F.length(source))


def rerank(candidates: DataFrame, by: str, score: Column, position: str) -> DataFrame:
    """The candidate of highest score, the earlier one of equals."""
    return best_of(candidates.withColumn("score", score), by, [F.desc("score"), F.col(position)])


def consensus(candidates: DataFrame, by: str, position: str, bag: str) -> DataFrame:
    """Minimum Bayes risk: each candidate's mean bag F1 with its rivals; a source has few candidates."""
    from ..functions.text import bag_f1

    other = candidates.select(by, F.col(position).alias("_p"), F.col(bag).alias("_b"))
    both = candidates.join(other, by).filter(F.col(position) != F.col("_p"))
    means = both.groupBy(by, position).agg(F.avg(bag_f1(F.col(bag), F.col("_b"))).alias("utility"))
    return best_of(candidates.join(means, [by, position], "left").fillna({"utility": 1.0}), by, [F.desc("utility"), F.col(position)])


def batches(rows: DataFrame, t: str, size: int) -> DataFrame:
    """Length buckets for batching: (bucket, slot) so that texts of one bucket are of like length."""
    return rows.withColumn("bucket", F.floor(F.log2(F.greatest(F.length(t), F.lit(1))))).withColumn("slot", F.pmod(F.xxhash64(t), F.lit(size)))


