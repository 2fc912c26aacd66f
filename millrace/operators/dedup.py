"""First-owner dedup, anti joins against a corpus, and splits that keep one text on one side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X


def first_owner(rows: DataFrame, key: Column, order: list[str]) -> DataFrame:
    """One row of each key, the first in the order.

    An aggregate with a map-side part over (key, order) finds the owners, so a
    key with a third of all rows is reduced before the shuffle; only their
    order columns travel.
    """
    keyed = rows.withColumn("_key", F.sha2(key, 256))
    owner = keyed.groupBy("_key").agg(F.min(F.struct(*order)).alias("_first")).select(*[F.col(f"_first.{c}").alias(f"_o_{c}") for c in order])
    same = [F.col(c).eqNullSafe(F.col(f"_o_{c}")) for c in order]
    return keyed.join(owner, same, "left_semi").drop("_key")


def pair_key(a: Column, b: Column, normal: bool = True) -> Column:
    return F.concat(X.dedup_key(a, normal), F.lit("\0"), X.dedup_key(b, normal))


def not_in(rows: DataFrame, corpus: DataFrame, key: Column, corpus_key: Column) -> DataFrame:
    """Rows whose key no corpus row has."""
    return rows.withColumn("_k", F.sha2(key, 256)).join(corpus.select(F.sha2(corpus_key, 256).alias("_k")).distinct(), "_k", "left_anti").drop("_k")


def approximate_key(t: Column, normal: bool = True, size: int = 5) -> Column:
    """A split key that near copies mostly share: the text itself if short, else one min-wise hash of its shingles."""
    n = X.split_key(t, normal)
    short = F.length(F.replace(n, F.lit(" "), F.lit(""))) <= size
    return F.when(short, F.concat(F.lit("exact\0"), n)).otherwise(F.concat(F.lit("minhash\0"), X.minhash_native(X.char_shingles(t, size, normal))))


def endpoint(language: Column, t: Column, normal: bool = True, approximate: bool = False) -> Column:
    key = approximate_key(t, normal) if approximate else X.split_key(t, normal)
    return F.sha2(F.concat(language, F.lit("\0"), key), 256)


def guarded(pairs: DataFrame, split: str, ends: list[str], order: list[str]) -> DataFrame:
    """Pairs none of whose endpoints belongs to another split.

    An endpoint belongs to the split of the first row, by ``order``, that holds
    it. That is a function of the rows alone, not of the order of arrival.
    """
    first = F.min(F.struct(*order, F.col(split).alias("_split")))
    held = None
    for c in ends:
        part = pairs.select(F.col(c).alias("_e"), *order, split)
        held = part if held is None else held.unionByName(part)
    owner = held.groupBy("_e").agg(first.alias("_f")).select("_e", F.col("_f._split").alias("_owner"))
    out = pairs
    for c in ends:
        out = out.join(owner.withColumnRenamed("_e", c).withColumnRenamed("_owner", f"_own_{c}"), c)
    for c in ends:
        out = out.filter(F.col(f"_own_{c}") == F.col(split)).drop(f"_own_{c}")
    return out.select(*pairs.columns)


def capped(rows: DataFrame, by: list[str], order: list[Column], most: int, name: str = "rank") -> DataFrame:
    """At most ``most`` rows of each group in the order; the window keeps no more than that (a limit below the shuffle)."""
    w = W.partitionBy(*by).orderBy(*order)
    return rows.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= most)


def low_fan_out(rows: DataFrame, source: str, most: int) -> DataFrame:
    """Rows of sources with at most ``most`` rows; counts are aggregated, not windowed."""
    many = rows.groupBy(source).count().filter(F.col("count") > most).select(source)
    return rows.join(many, source, "left_anti").select(*rows.columns)
