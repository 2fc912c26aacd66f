"""Glossaries: loading, longest-first matching with script-aware borders, hints, and placeholders."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import SCRIPTS, SPACELESS

MOST_TERMS = 200_000  #: terms that one broadcast matcher may hold; a larger glossary is refused

_TIGHT = re.compile("[" + re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: chr(int(m[1], 16)), "".join(SCRIPTS[s] for s in (*SPACELESS, "hangul"))) + "]")


def load(spark: SparkSession, path: str) -> DataFrame:
    """(source_lang, source, target_lang, target) of a JSON list of surfaces by language; entries need two."""
    raw = spark.read.option("multiLine", "true").option("wholetext", "true").text(path)
    entries = raw.select(F.explode(F.from_json("value", "array<map<string,string>>")).alias("e")).filter(F.size("e") >= 2)
    sides = entries.select(F.monotonically_increasing_id().alias("i"), F.explode("e").alias("lang", "text")).filter(F.trim("text") != "")
    other = sides.toDF("i", "target_lang", "target")
    return sides.toDF("i", "source_lang", "source").join(other, "i").filter("source_lang <> target_lang").drop("i")


class Matcher:
    """Finds terms from the longest on, none inside another; a term of spaced scripts needs borders."""

    def __init__(self, terms: dict[str, str]):
        if len(terms) > MOST_TERMS:
            raise ValueError("glossary too large to broadcast")
        self.terms = terms
        self.tree: dict = {}
        for t in terms:
            node = self.tree
            for c in t:
                node = node.setdefault(c, {})
            node[""] = t

    def find(self, text: str) -> list[tuple[int, int, str]]:
        hits = []
        for i in range(len(text)):
            node, j = self.tree, i
            while j < len(text) and text[j] in node:
                node = node[text[j]]
                j += 1
                if "" in node and self.bordered(text, i, j):
                    hits.append((i, j, node[""]))
        taken, out = [], []
        for a, b, t in sorted(hits, key=lambda h: (h[0] - h[1], h[0])):
            if all(b <= x or a >= y for x, y in taken):
                taken.append((a, b))
                out.append((a, b, t))
        return sorted(out)

    @staticmethod
    def bordered(text: str, a: int, b: int) -> bool:
        word = lambda c: bool(c) and (c.isalnum() or c == "_") and not _TIGHT.match(c)
        left = a == 0 or not (word(text[a - 1]) and word(text[a]))
        right = b == len(text) or not (word(text[b - 1]) and word(text[b]))
        return left and right


MATCHES = T.ArrayType(T.StructType([T.StructField("source", T.StringType()), T.StructField("target", T.StringType()), T.StructField("start", T.IntegerType())]))


def terms_in(terms: dict[str, str]):
    """Matches of a bounded glossary in a text column."""

    @F.pandas_udf(MATCHES)
    def run(s: pd.Series) -> pd.Series:
        m = Matcher(terms)
        return s.map(lambda t: [{"source": x, "target": terms[x], "start": a} for a, _, x in m.find(t or "")])

    return run


def substitute(text: str, terms: dict[str, str], most: int = 64, matcher: Matcher | None = None) -> tuple[str, dict[str, str]]:
    """Placeholders for source terms, and what each stands for in the target language."""
    out, at, slots = [], 0, {}
    for a, b, t in (matcher or Matcher(terms)).find(text)[:most]:
        slot = f"<term_{len(slots)}>"
        slots[slot] = terms[t]
        out += [text[at:a], slot]
        at = b
    return "".join(out) + text[at:], slots


def substituted(terms: dict[str, str], most: int = 64):
    """``substitute`` of a text column, as (text, slots); the glossary's trie is built once a task."""

    @F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("slots", T.MapType(T.StringType(), T.StringType()))]))
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        matcher = Matcher(terms)
        for s in parts:
            made = [substitute(t, terms, most, matcher) if t is not None else (None, None) for t in s]
            yield pd.DataFrame(made, columns=["text", "slots"], dtype=object)

    return run


def hints(rows: DataFrame, source: str, target: str, terms: dict[str, str], most: int = 3) -> DataFrame:
    """Hints of terms found on both sides, the rarest first, at most ``most`` a row; rows without one go."""
    found = rows.withColumn("_m", F.filter(terms_in(terms)(F.col(source)), lambda m: F.contains(F.col(target), m["target"])))
    found = found.filter(F.size("_m") > 0)
    names = F.array_distinct(F.transform("_m", lambda m: m["source"]))
    counts = {r["t"]: r["n"] for r in found.select(F.explode(names).alias("t")).groupBy("t").agg(F.count("*").alias("n")).collect()}  # no more rows than terms

    @F.pandas_udf("array<struct<n:bigint,source:string,target:string>>")
    def rarest(s: pd.Series) -> pd.Series:
        return s.map(lambda ms: [{"n": n, "source": x, "target": y} for n, x, y in sorted({(counts[m["source"]], m["source"], m["target"]) for m in ms})[:most]])

    return found.withColumn("terms", rarest("_m")).drop("_m")


def from_corpus(rows: DataFrame, source: str, target: str, least: int = 2, most: int = 24) -> DataFrame:
    """Short pairs as glossary entries, the first target of a source wins."""
    fit = rows.filter(F.length(source).between(least, most) & F.length(target).between(least, most))
    return fit.groupBy(source).agg(F.min(F.struct(*[c for c in ("line",) if c in rows.columns], target)).alias("_t")).select(source, F.col(f"_t.{target}").alias(target))


# Function morphemes that cannot stand by themselves, by language.
ORPHANS = {
    "ko": ("의", "는", "을", "를", "에", "에서", "에게", "에게서", "한테", "께", "께서", "으로", "이랑", "부터", "까지", "처럼", "이라서", "이라고", "이라는"),
    "ja": ("は", "が", "を", "に", "へ", "と", "の", "から", "まで", "より", "のは", "には", "とは", "では", "への", "からは"),
}
ORPHANS["kj"] = ORPHANS["ko"] + ORPHANS["ja"]


def morphemes(language: str) -> Morphemes | None:
    """Those of a language; none for a language without a table, which is then not checked."""
    return Morphemes(ORPHANS[language]) if language in ORPHANS else None


class Morphemes:
    """Function morphemes that a segmenter cut off: found, joined to the word before, or reported as holes."""

    def __init__(self, tokens: tuple[str, ...]):
        self.tokens = frozenset(tokens)

    def stranded(self, text: str) -> list[str]:
        return [t for t in text.split()[1:] if t in self.tokens]

    def rejoin(self, text: str) -> str:
        out: list[str] = []
        for t in text.split():
            if out and t in self.tokens:
                out[-1] += t
            else:
                out.append(t)
        return " ".join(out)

    def hole(self, text: str) -> bool:
        """A morpheme at the very start has lost its word."""
        words = text.split()
        return bool(words) and words[0] in self.tokens

    def column(self, t: Column) -> Column:
        """``rejoin`` natively, over the array of words."""
        parts = F.split(F.trim(t), r"\s+")
        glue = lambda s, w: F.when(w.isin(*self.tokens) & (s != ""), F.concat(s, w)).when(s == "", w).otherwise(F.concat(s, F.lit(" "), w))
        return F.aggregate(parts, F.lit(""), glue)


def rewrite(text: str, endings: dict[str, str]) -> str | None:
    """A table-driven rewrite of a sentence's end, the longest ending first; None where no rule fits."""
    body = text.rstrip(".!?。！？ ")
    for e in sorted(endings, key=len, reverse=True):
        if body.endswith(e):
            return body[: len(body) - len(e)] + endings[e] + text[len(body) :]
    return None


def groups(terms: list[tuple[str, str]]) -> dict[str, list[str]]:
    out: dict[str, list[str]] = defaultdict(list)
    for a, b in terms:
        out[a].append(b)
    return dict(out)
