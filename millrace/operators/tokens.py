"""What a tokenizer's pieces are exposed to: by direction, in bytes, over both training stages; piece features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BYTE = r"^<0x[0-9A-Fa-f]{2}>$"


def by_direction(pairs: DataFrame, a: str, b: str, tokens_a: str, tokens_b: str) -> DataFrame:
    """(direction, token, n): how often a piece is a target; each pair is a target both ways."""
    ends = F.array(
        F.struct(F.concat_ws("-", a, b).alias("direction"), F.col(tokens_b).alias("t")), F.struct(F.concat_ws("-", b, a).alias("direction"), F.col(tokens_a).alias("t"))
    )
    one = pairs.select(F.inline(ends)).select("direction", F.explode("t").alias("token"))
    return one.groupBy("direction", "token").agg(F.count("*").alias("n"))


def byte_fallback(seen: DataFrame, by: list[str], token: str = "token", n: str = "n", most: float | None = None) -> DataFrame:
    """Tokens, byte pieces among them and their rate by group; with ``most``, whether the gate holds."""
    bytes_ = F.coalesce(F.sum(F.when(F.col(token).rlike(BYTE), F.col(n))), F.lit(0))
    out = seen.groupBy(*by).agg(F.sum(n).alias("tokens"), bytes_.alias("byte_tokens"))
    out = out.withColumn("byte_rate", F.round(F.col("byte_tokens") / F.greatest(F.col("tokens"), F.lit(1)), 8))
    return out if most is None else out.withColumn("passed", F.col("byte_rate") <= most)


def both_stages(parallel: DataFrame, mono: DataFrame, rare: int = 25) -> DataFrame:
    """(token, parallel, mono, total, rescued, rare) of (token, n) counts of two stages: is a piece learnt at all?

    ``rescued`` pieces are rare in the parallel text and not any more with both.
    """
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    out = parallel.select("token", F.col("n").alias("_p")).join(mono.select("token", F.col("n").alias("_m")), "token", "full")
    out = out.select("token", zero("_p").alias("parallel"), zero("_m").alias("mono")).withColumn("total", F.col("parallel") + F.col("mono"))
    return out.withColumn("rescued", (F.col("parallel") < rare) & (F.col("total") >= rare)).withColumn("rare", F.col("total") < rare)


def within_length(rows: DataFrame, tokens: list[str], most: int) -> DataFrame:
    """Rows none of whose token lists is longer than ``most``; they go before anything else is reserved for them."""
    ok = F.lit(True)
    for c in tokens:
        ok = ok & (F.size(c) <= most)
    return rows.filter(ok)


# Code-point ranges of piece classes.
RANGES = {
    "hangul": r"\x{AC00}-\x{D7A3}\x{1100}-\x{11FF}", "han": r"\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}", "hiragana": r"\x{3040}-\x{309F}",
    "katakana": r"\x{30A0}-\x{30FF}\x{31F0}-\x{31FF}",
}


def piece_class(piece: Column) -> Column:
    """special, mixed, other or the one class of a piece's characters."""
    surface = F.regexp_replace(piece, r"[▁\s]", "")
    rest = "".join(RANGES.values())
    classes = [*RANGES.items(), ("digit", r"\p{Nd}"), ("latin", r"\p{IsLatin}&&[^" + rest + "]")]
    other = r"[^" + rest + r"\p{Nd}\p{IsLatin}]"
    found = F.array_compact(F.array(*[F.when(surface.rlike(f"[{r}]"), F.lit(k)) for k, r in classes], F.when(surface.rlike(other), F.lit("other"))))
    special = (piece.startswith("<") & piece.endswith(">")) | (surface == "")
    return F.when(special, "special").when(F.size(found) > 1, "mixed").otherwise(F.get(found, F.lit(0)))


def hangul_parts(piece: Column) -> Column:
    """(onset, vowel, coda) of a piece's last Hangul syllable, from 1; zeros without one."""
    last = F.regexp_extract(piece, r"([\x{AC00}-\x{D7A3}])[^\x{AC00}-\x{D7A3}]*$", 1)
    code = F.conv(F.hex(F.encode(last, "UTF-16BE")), 16, 10).cast("int") - 0xAC00
    part = lambda x: F.when(last == "", F.lit(0)).otherwise(x.cast("int") + 1)
    return F.struct(part(F.floor(code / 588)).alias("onset"), part(F.floor(code % 588 / 28)).alias("vowel"), part(code % 28).alias("coda"))
