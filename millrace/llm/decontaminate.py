"""Benchmark decontamination by pigeonhole edit matching.

Texts and items are compared as lower-case words with single blanks between
them. An item of m characters may differ from a passage by e = floor(m *
``rate``) edits. It is split into e + 1 pieces of near equal length; a passage
within e edits must hold one of them exactly (the pigeonhole principle). Exact
piece hits are found with one automaton over all pieces, hits of an item that
point to about the same place are merged to one window, and each window is
verified with Myers' bit-parallel distance. ``hits`` are (document, item,
start, end, distance), as offsets into the normalised text: the best passage of
a window, then the best ones before and after it, as long as there are any.

An item of fewer than ``least`` characters is searched as well, but as it
stands and as whole words: an edit would make another item of it.

Items are taken in blocks of at most ``block`` characters, one pass over the
texts each, so the automaton sent to the executors has a fixed bound however
many items there are. Texts are scanned whole and never shuffled.

Defined results: null or empty texts have no hit; items that are null or hold
no word are not searched; equal items hit under each of their ids; rows with null or repeated ids are documents
of their own and keep their id; empty tables give an empty result; other
columns do not matter.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

RATE, LEAST, BLOCK = 1 / 16, 24, 1 << 20
_WORDS = re.compile(r"[^\W_]+")


def normalised(text: str) -> str:
    return " ".join(_WORDS.findall(text.lower()))


def split(item: str, budget: int) -> list[tuple[int, str]]:
    """(offset, piece) of budget + 1 pieces whose lengths differ by one at most."""
    cut = [len(item) * i // (budget + 1) for i in range(budget + 2)]
    return [(a, item[a:b]) for a, b in zip(cut, cut[1:], strict=False)]


def masks(item: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(item):
        out[c] = out.get(c, 0) | 1 << i
    return out


def best_end(peq: dict[str, int], m: int, text: str, budget: int) -> tuple[int, int] | None:
    """(distance, end) of the best match of an item of m characters anywhere in text, if within budget.

    Myers' algorithm: vertical differences of a whole column in two integers of m bits.
    """
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, found = full, 0, m, None
    get = peq.get
    for j, c in enumerate(text):
        eq = get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv)
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph <<= 1
        pv = ((mh << 1) | ~(xv | ph)) & full
        mv = ph & xv & full
        if score <= budget and (found is None or score < found[0]):
            found = score, j + 1
    return found


class Index:
    """All pieces of a block of items in one automaton."""

    def __init__(self, items: list[tuple[object, str]], rate: float, least: int = LEAST):
        import ahocorasick

        self.items = items
        self.budget = [int(len(t) * rate) if len(t) >= least else 0 for _, t in items]
        self.whole = [len(t) < least for _, t in items]
        at: dict[str, list[tuple[int, int]]] = {}
        for i, (_, t) in enumerate(items):
            for offset, piece in split(t, self.budget[i]):
                at.setdefault(piece, []).append((i, offset))
        self.tree = ahocorasick.Automaton()
        for piece, where in at.items():
            self.tree.add_word(piece, (len(piece), where))
        self.tree.make_automaton()
        self.masks: dict[int, tuple[dict[str, int], dict[str, int]]] = {}

    def hits(self, text: str) -> Iterator[tuple[object, int, int, int]]:
        """(item, start, end, distance) of the passages of a normalised text."""
        near: dict[int, list[int]] = {}
        for last, (n, where) in self.tree.iter(text):
            for i, offset in where:
                near.setdefault(i, []).append(last + 1 - n - offset)
        for i, starts in near.items():
            name, item = self.items[i]
            m, e = len(item), self.budget[i]
            if self.whole[i]:
                yield from ((name, a, a + m, 0) for a in starts if text[a - 1 : a] in ("", " ") and text[a + m : a + m + 1] in ("", " "))
                continue
            if i not in self.masks:
                self.masks[i] = masks(item), masks(item[::-1])
            for a, b in windows(sorted(starts), m, e, len(text)):
                yield from ((name, *p) for p in passages(self.masks[i], m, e, text, a, b))


def passages(both: tuple[dict[str, int], dict[str, int]], m: int, e: int, text: str, a: int, b: int) -> Iterator[tuple[int, int, int]]:
    """(start, end, distance): the best passage of text[a:b], and those of what lies before and after it."""
    left = [(a, b)]
    while left:
        a, b = left.pop()
        got = best_end(both[0], m, text[a:b], e) if b - a >= m - e else None
        if got:
            end = a + got[1]
            back = best_end(both[1], m, text[a:end][::-1][: m + e], e)
            start = end - (back[1] if back else m)
            yield start, end, got[0]
            left += [(end, b), (a, start)]


def windows(starts: list[int], m: int, e: int, size: int) -> list[tuple[int, int]]:
    """Merged text ranges that hold every passage whose start is within e of a proposed one."""
    out: list[list[int]] = []
    for s in starts:
        a, b = max(0, s - e), min(size, s + m + 2 * e)
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return [(a, b) for a, b in out if b - a >= m - e]


def blocks(benchmark: DataFrame, item_col: str, text_col: str, block: int) -> Iterator[list[tuple[object, str]]]:
    """The items, in order, in blocks of at most ``block`` characters; fetched one partition at a time."""
    now, size = [], 0
    for r in benchmark.select(F.col(item_col).alias("i"), F.col(text_col).alias("t")).filter("t IS NOT NULL").toLocalIterator():
        t = normalised(r["t"])
        if not t:
            continue
        if now and size + len(t) > block:
            yield now
            now, size = [], 0
        now.append((r["i"], t))
        size += len(t)
    if now:
        yield now


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", rate: float = RATE, least: int = LEAST, block: int = BLOCK) -> DataFrame:
    """(doc_id, item_id, start, end, distance), one row per verified window."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("t"))
    kinds = f"doc_id {dict(rows.dtypes)['doc_id']}, item_id {dict(benchmark.dtypes)[item_col]}, start long, end long, distance int"
    kind = to_arrow_type(benchmark.schema[item_col].dataType)
    out = None
    for items in blocks(benchmark, item_col, item_text, block):
        found = rows.mapInArrow(_search(items, rate, least, kind), kinds)
        out = found if out is None else out.unionByName(found)
    return rows.sparkSession.createDataFrame([], kinds) if out is None else out


def _search(items: list[tuple[object, str]], rate: float, least: int, kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(items, rate, least)
        for batch in batches:
            row, found = [], []
            for i, t in enumerate(batch.column("t")):
                t = t.as_py()
                for h in index.hits(normalised(t)) if t else ():
                    row.append(i)
                    found.append(h)
            item, start, end, distance = zip(*found, strict=True) if found else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(row, pa.int64())), pa.array(item, kind), pa.array(start, pa.int64()), pa.array(end, pa.int64()), pa.array(distance, pa.int32())], names=["doc_id", "item_id", "start", "end", "distance"])

    return run


def flagged(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", rate: float = RATE, least: int = LEAST, block: int = BLOCK) -> DataFrame:
    """The rows of ``docs`` without any hit, all columns kept; filtered where they lie, no shuffle."""
    out = docs
    for items in blocks(benchmark, item_col, item_text, block):
        out = out.filter(_clean(items, rate, least)(F.col(text_col)))
    return out


def _clean(items: list[tuple[object, str]], rate: float, least: int):
    @F.pandas_udf("boolean")
    def clean(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        index = Index(items, rate, least)
        for s in texts:
            yield pd.Series([not t or next(index.hits(normalised(t)), None) is None for t in s], dtype=bool)

    return clean


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document and item that it holds: doc_id, item_id, distance, n_hits, start, end of the best."""
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    found = matches(docs, benchmark)
    best = F.min(F.struct("distance", "start", "end")).alias("m")
    return found.groupBy("doc_id", "item_id").agg(best, F.count("*").alias("n_hits")).select("doc_id", "item_id", F.col("m.distance").alias("distance"), "n_hits", F.col("m.start").alias("start"), F.col("m.end").alias("end"))
