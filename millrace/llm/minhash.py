"""MinHash near-dedup with DartMinHash signatures.

A document is a weighted set: its distinct five-word shingles (lower-case
words; a document of one to four words is one shingle), each weighted by how
often it occurs. An element's weight axis is cut into regions, [0, finest) and
then doubling ones; into each region up to the element's weight darts are
thrown by a hashed Poisson process. A dart has a rank, a place on the weight
axis (one beyond the weight misses) and one of ``k`` coordinates. A coordinate
keeps the dart of smallest rank, so two documents agree there with the
probability of their weighted Jaccard similarity, for any non-negative weights.
Only about k * (ln k + 5) darts a document hit; where a coordinate stays
empty, the process is continued.

1. Documents with the same words form one class; its smallest key stands for
   it from here on.
2. Signatures are cut into bands. Documents that share a band form a bucket;
   buckets with the same members are one.
3. A bucket is a cell, or if it is large, several cells of its members by hash,
   each with the bucket's smallest key as well. In a cell the exact weighted
   Jaccard similarity decides, by an inverted index over the cell's shingles: the
   smallest key is compared with all, then every member outside the largest
   component so far with all. Only a spanning forest of links leaves the cell.
4. Where a bucket of several cells still has members outside its largest
   component, those are compared with its members of all other cells.
   So every two documents that share a band and are not connected by links
   have been compared.

The work is linear in a group whose members link to each other. Only members of
a large bucket that link with next to nothing there cost a comparison with all
of it; no pairs are emitted for that either.

Defined results: texts that are null or hold no word link with nothing; rows
with null or repeated ids are documents of their own, nulls first, then by text;
an empty table gives an empty result; other columns do not matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._kernel import Spans, lowered, mix, runs, words
from ._spark import KEY, TEXT, checkpoint, keyed, named, slices, stored, text_bytes
from .components import components
from .repeats import whole_groups

SHINGLE, SIMILARITY = 5, 0.8
COORDINATES, ROWS = 64, 4
CELL, CELL_ELEMENTS = 1024, 1 << 22  #: members and shingles of a cell; a larger bucket has several
TOGETHER = 1 << 20  #: bytes of text whose shingles are taken at once

_STEP, _REGION, _PLACE = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xA24BAED4963EE407, 0xD6E8FEB86659FD93))


def shingles(data: np.ndarray, offs: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, element, weight, fingerprint of each row's words): the distinct shingles of each row and how often they occur.

    Elements are sorted by row. The fingerprint is 0 for rows without a word.
    """
    n = len(offs) - 1
    x = lowered(data)
    start, end, row = words(x, offs)
    h = Spans(x)(start, end)
    prints = np.zeros(n, np.uint64)
    if not len(h):
        return row, h, np.zeros(0), prints
    first = runs(row)
    count = np.diff(np.r_[first, len(row)])
    at = np.arange(len(row)) - np.repeat(first, count)
    prints[row[first]] = mix(np.add.reduceat(mix(h + at.astype(np.uint64) * _STEP), first)) | np.uint64(1)
    if len(h) >= size:
        s = h[: len(h) - size + 1].copy()
        for i in range(1, size):
            s = s * np.uint64(0xD1342543DE82EF95) + h[i : len(h) - size + 1 + i]
        inside = row[: len(s)] == row[size - 1 :]
        s, r = mix(s[inside]), row[: len(inside)][inside]
    else:
        s, r = h[:0], row[:0]
    short = row[first][count < size]
    s, r = np.r_[s, prints[short]], np.r_[r, short]
    order = np.lexsort((s, r))
    s, r = s[order], r[order]
    head = np.flatnonzero(np.r_[True, (s[1:] != s[:-1]) | (r[1:] != r[:-1])])
    return r[head], s[head], np.diff(np.r_[head, len(s)]).astype(float), prints


def elements(data: np.ndarray, offs: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, element, weight) as ``shingles`` gives them, from ``TOGETHER`` bytes of text at a time, a longer text by itself."""
    out, at, n = [], 0, len(offs) - 1
    while at < n:
        end = max(at + 1, int(np.searchsorted(offs, offs[at] + TOGETHER, "right")) - 1)
        row, element, weight, _ = shingles(data[offs[at] : offs[end]], offs[at : end + 1] - offs[at], size)
        out.append((row + at, element, weight))
        at = end
    row, element, weight = (np.concatenate(x) for x in zip(*out, strict=True))
    return row, element, weight


def _uniform(seed: np.ndarray) -> np.ndarray:
    return ((seed >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def darts(row: np.ndarray, element: np.ndarray, weight: np.ndarray, n: int, k: int = COORDINATES, finest: float = 1.0) -> np.ndarray:
    """(n, k) uint32 signatures of rows given by their weighted elements; rows of no weight get zeros.

    ``finest`` is the width of the lowest region, the same for all documents
    that are to be compared; a small part of the usual weight keeps few darts
    from missing. Within a region ranks arrive in order: arrival i comes an
    exponential step, by the region's width, after arrival i - 1.
    """
    some = weight > 0
    row, element, weight = row[some], element[some], weight[some].astype(float)
    none = np.iinfo(np.uint64).max
    best = np.full(n * k, none, np.uint64)
    total = np.bincount(row, weight, minlength=n)
    limit = k * (math.log(k) + 5) / np.where(total > 0, total, 1)
    regions = np.ones(len(row), np.int64)
    wide = weight > finest
    regions[wide] += np.ceil(np.log2(weight[wide] / finest)).astype(np.int64)
    of = np.repeat(np.arange(len(row)), regions)
    nth = np.arange(len(of)) - np.repeat(np.cumsum(regions) - regions, regions)
    low = np.where(nth > 0, finest * 2.0 ** (nth - 1), 0.0)
    width = np.where(nth > 0, low, finest)
    region_row, seed_of = row[of], mix(element[of] + nth.astype(np.uint64) * _REGION)
    reach = (weight[of] - low) / width  # a dart at a larger part of the region misses
    e, rank, arrival = np.arange(len(of)), np.zeros(len(of)), np.zeros(len(of), np.uint64)
    waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    while len(e):
        seed = mix(seed_of[e] + arrival * _STEP)
        before, rank = rank, rank - np.log(_uniform(seed)) / width[e]
        hit = rank <= limit[region_row[e]]
        if not hit.all():
            miss = ~hit
            waiting.append((e[miss], before[miss], arrival[miss]))
            e, rank, arrival, seed = e[hit], rank[hit], arrival[hit], seed[hit]
        inside = np.flatnonzero((reach[e] >= 1) | (_uniform(mix(seed ^ _PLACE)) < reach[e]))
        which = mix(seed[inside])
        packed = rank[inside].astype(np.float32).view(np.uint32).astype(np.uint64) << np.uint64(32)
        place = region_row[e[inside]] * k + ((which >> np.uint64(32)) % np.uint64(k)).astype(np.int64)
        np.minimum.at(best, place, packed | (which & np.uint64(0xFFFFFFFF)))
        arrival = arrival + np.uint64(1)
        if not len(e):
            open_ = np.unique(np.flatnonzero(best == none) // k)
            open_ = open_[total[open_] > 0]
            if not len(open_):
                break
            more = np.zeros(n, bool)
            more[open_] = True
            limit[open_] *= 2
            e, rank, arrival = (np.concatenate(x) for x in zip(*waiting, strict=True))
            again = more[region_row[e]]
            e, rank, arrival = e[again], rank[again], arrival[again]
            waiting = []
    sig = (best & np.uint64(0xFFFFFFFF)).astype(np.uint32).reshape(n, k)
    sig[total == 0] = 0
    return sig


def bands(sig: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """(n, k / rows) int64 bucket hashes, different for different bands."""
    n, k = sig.shape
    x = sig.astype(np.uint64).reshape(n, k // rows, rows)
    h = np.broadcast_to(np.arange(1, k // rows + 1, dtype=np.uint64) * _STEP, x.shape[:2]).copy()
    for i in range(rows):
        h = mix(h * np.uint64(0xD1342543DE82EF95) + x[:, :, i])
    return h.view(np.int64)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for s in slices(batch):
            row, element, weight, prints = shingles(s.data, s.offs)
            b = bands(darts(row, element, weight, len(s)))
            size = np.bincount(row, minlength=len(s))
            lists = pa.ListArray.from_arrays(np.arange(0, b.size + 1, b.shape[1], dtype=np.int32), b.ravel())
            columns = [s.keys, prints.view(np.int64), size, lists]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[KEY, "print", "size", "buckets"])


class Index:
    """The similarity of a document of a cell with all others at once."""

    def __init__(self, row: np.ndarray, element: np.ndarray, weight: np.ndarray, n: int):
        order = np.argsort(element, kind="stable")
        head = runs(element[order])
        times = np.diff(np.r_[head, len(order)])
        self.n, self.total = n, np.bincount(row, weight, minlength=n)
        at = np.empty(len(order), np.int64)
        at[order] = np.repeat(np.arange(len(head)), times)
        shared = times[at] > 1  # others add nothing in common
        self.of, self.own, mine = at[shared], weight[shared], row[shared]
        self.first = np.searchsorted(mine, np.arange(n + 1))
        self.head, self.times = head, times
        self.row, self.weight = row[order], weight[order]

    def similar(self, x: int) -> np.ndarray:
        """Weighted Jaccard similarity of x with each document."""
        mine = slice(self.first[x], self.first[x + 1])
        of, times = self.of[mine], self.times[self.of[mine]]
        at = np.arange(times.sum()) + np.repeat(self.head[of] - (np.cumsum(times) - times), times)
        common = np.bincount(self.row[at], np.minimum(np.repeat(self.own[mine], times), self.weight[at]), minlength=self.n)
        either = self.total + self.total[x] - common
        return common / np.where(either > 0, either, 1)


def forest(keys: np.ndarray, labels: np.ndarray, ask: np.ndarray, index: Index, similarity: float) -> list[tuple[int, int]]:
    """Links that join all that is alike: each pair joins two components, given and grown by ``labels``.

    Members marked in ``ask`` are compared with all, the smallest key first. If
    all are marked, those within the component that is largest at the time
    need no turn: whatever lies outside it has one.
    """
    labels, open_, out, every = labels.copy(), ask.copy(), [], bool(ask.all())
    x = int(np.argmin(np.where(ask, keys, np.iinfo(np.int64).max)))
    while True:
        open_[x] = False
        near = np.flatnonzero((index.similar(x) >= similarity - 1e-12) & (labels != labels[x]))
        for y in near:
            if labels[y] != labels[x]:
                out.append((int(keys[x]), int(keys[y])))
                labels[labels == labels[y]] = labels[x]
        size = np.bincount(labels)
        left = np.flatnonzero(open_ & (labels != size.argmax()) if every else open_)
        if not len(left) or size.max() == len(labels):
            return out
        x = int(left[0])


def _linked(similarity: float):
    """Links of whole cells (cell, _key, root, ask, _text): those of the same root need no link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, "cell"):
            data, offs = text_bytes(t.column(TEXT))
            keys, root, ask = (t.column(c).to_numpy(zero_copy_only=False) for c in (KEY, "root", "ask"))
            head = runs(t.column("cell").to_numpy())
            until = np.r_[head[1:], t.num_rows]
            out: list[tuple[int, int]] = []
            at = 0
            while at < len(head):  # some cells at a time
                end = max(at + 1, int(np.searchsorted(offs[until], offs[head[at]] + TOGETHER, "right")))
                a, b = head[at], until[end - 1]
                row, element, weight = elements(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
                for i, j in zip(head[at:end], until[at:end], strict=True):
                    if not ask[i:j].any() or root[i:j].min() == root[i:j].max():
                        continue
                    x, y = np.searchsorted(row, [i - a, j - a])
                    index = Index(row[x:y] - (i - a), element[x:y], weight[x:y], j - i)
                    out += forest(keys[i:j], np.unique(root[i:j], return_inverse=True)[1], ask[i:j], index, similarity)
                at = end
            ends = np.array(out, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(ends.min(1)), pa.array(ends.max(1))], names=["a", "b"])

    return run


def _links(cells: DataFrame, rows: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) within cells (bucket, part, _key, root, ask)."""
    dealt = rows.select(KEY, TEXT).join(cells, KEY).select(F.xxhash64("bucket", "part").alias("cell"), KEY, "root", "ask", TEXT)
    return stored(dealt.repartition("cell").sortWithinPartitions("cell").mapInArrow(_linked(similarity), "a long, b long"), "links")


def _part(parts: str | F.Column) -> F.Column:
    return F.pmod(F.xxhash64(KEY, F.lit(7)), parts)


def _rest(wide: DataFrame, links: DataFrame, cell: int) -> DataFrame:
    """Cells for the members of wide buckets that are outside their bucket's largest component, with those of all other parts."""
    root = components(links)
    state = wide.join(root, F.col(KEY) == F.col("node"), "left").select("bucket", "parts", KEY, F.coalesce("root", KEY).alias("root"))
    state = checkpoint(state)
    sizes = state.groupBy("bucket", "root").agg(F.count("*").alias("m"))
    main = sizes.groupBy("bucket").agg(F.max(F.struct("m", "root")).alias("most"), F.sum("m").alias("n"))
    main = main.select("bucket", F.col("most.root").alias("main"), F.ceil((F.col("n") - F.col("most.m")) / cell).cast("int").alias("asks")).filter("asks > 0")
    both = state.join(main, "bucket")
    mine = F.pmod(F.xxhash64(KEY, F.lit(11)), "asks").cast("int")
    ask = both.filter("root <> main").select("bucket", KEY, "root", F.lit(True).alias("ask"), mine.alias("p"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("q"))
    all_ = both.select("bucket", KEY, "root", F.lit(False).alias("ask"), F.explode(F.sequence(F.lit(0), F.col("asks") - 1)).alias("p"), _part("parts").cast("int").alias("q"))
    return ask.union(all_).select("bucket", F.struct("p", "q").alias("part"), KEY, "root", "ask")


def classes(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, cell: int = CELL
) -> DataFrame:
    """(_key, _id, class_key, kept) of each document: its near-duplicate class by its smallest member, and whether it is that one."""
    rows = keyed(docs, id_col, text_col)
    signed = stored(rows.select(KEY, TEXT).mapInArrow(_signed, f"{KEY} long, print long, size long, buckets array<long>"), "signatures")
    known = signed.filter("print <> 0").withColumn("check", F.xxhash64("buckets"))
    copies = known.groupBy("print", "check").agg(F.min(KEY).alias("rep"))
    reps = known.join(copies, F.col(KEY) == F.col("rep"), "left_semi")
    banded = reps.select(KEY, "size", F.explode("buckets").alias("bucket"))
    shared = banded.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1").select("bucket")
    members = stored(banded.join(shared, "bucket"), "buckets")

    once, again = F.bit_xor(F.xxhash64(KEY)).alias("x"), F.bit_xor(F.xxhash64(KEY, F.lit(1))).alias("y")
    sets = members.groupBy("bucket").agg(F.count("*").alias("n"), F.sum("size").alias("elements"), F.min(KEY).alias("pivot"), once, again)
    parts = F.ceil(F.greatest(F.col("n") / cell, F.col("elements") / CELL_ELEMENTS)).cast("int").alias("parts")
    sets = sets.groupBy("n", "elements", "pivot", "x", "y").agg(F.min("bucket").alias("bucket")).select("bucket", "pivot", parts)
    held = stored(members.select(KEY, "bucket").join(sets, "bucket"), "cells")
    cells = held.select("bucket", _part("parts").alias("part"), KEY, F.col(KEY).alias("root"), F.lit(True).alias("ask"))
    wide = held.filter("parts > 1").select("bucket", "parts", KEY, "pivot")
    pivots = wide.filter(F.col(KEY) == F.col("pivot")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    pivots = pivots.filter(F.col("part") != _part("parts")).select("bucket", "part", KEY, F.col(KEY).alias("root"), F.lit(True).alias("ask"))
    links = _links(cells.union(pivots), rows, similarity)
    if not wide.isEmpty():
        links = links.union(_links(_rest(wide, links, cell), rows, similarity))
    root = components(links)

    class_of = copies.join(root, F.col("rep") == F.col("node"), "left").select("print", "check", F.coalesce("root", "rep").alias("class_key"))
    out = signed.select(KEY, "print", F.xxhash64("buckets").alias("check")).join(class_of, ["print", "check"], "left")
    class_key = F.coalesce("class_key", KEY).alias("class_key")
    return named(rows, out.select(KEY, class_key).withColumn("kept", F.col(KEY) == F.col("class_key")))


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: doc_id, class_id (smallest doc_id of its near-duplicates), kept."""
    out = classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select(F.col("_id").alias("doc_id"), F.col("class_key").alias("class_id"), "kept")
