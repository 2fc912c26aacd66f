"""Later occurrences of equal content, shared by the exact dedup operators.

A piece is a hashed part of a document: ``route`` (its first hash, by which
pieces are dealt), ``digest`` (54 bits of its second, and its length in the low
10), the document's key and its start ``a``. Of equal pieces the one with the
smallest (key, a) is the first; all others are later occurrences.

Skew: each mapper keeps one piece per content and slice of text for the
shuffle. The rest are later occurrences whatever the other mappers hold, so
they are marked (``a`` is stored as -1 - a), dealt at random and never meet in
one task. A content therefore has at most one competing row per slice, however
often it occurs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._kernel import merged, mix
from ._spark import KEY, TEXT, Slice, named, slices, text_bytes

PIECES = "route long, digest long, _key long, a int"
LONGEST = 1023

Cut = Callable[[Slice], tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]


def collapsed(group: np.ndarray, digest: np.ndarray, keys: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    """Pieces of one slice, all but the first of each content marked as later."""
    n = (b - a).astype(np.uint64)
    if len(n) and int(n.max()) > LONGEST:
        raise ValueError(f"a piece is longer than {LONGEST}")
    digest = (digest & ~np.uint64(LONGEST)) | n
    order = np.lexsort((a, keys, digest, group))
    g, d = group[order], digest[order]
    later = np.zeros(len(order), bool)
    later[1:] = (g[1:] == g[:-1]) & (d[1:] == d[:-1])
    k, a = keys[order], a[order]
    route = np.where(later, mix(k.astype(np.uint64) * np.uint64(0x9E3779B1) + a.astype(np.uint64)), g)
    return pa.RecordBatch.from_arrays([pa.array(route.view(np.int64)), pa.array(d.view(np.int64)), pa.array(k), pa.array(np.where(later, -1 - a, a).astype(np.int32))], names=["route", "digest", KEY, "a"])


def pieces(docs: DataFrame, cut: Cut) -> DataFrame:
    """The pieces that ``cut`` makes of each slice: (group, digest, row, a, b) with 64-bit hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in slices(batch):
                group, digest, row, a, b = cut(s)
                if len(group):
                    yield collapsed(group, digest, s.keys[row], a, b)

    return docs.select(KEY, TEXT).mapInArrow(run, PIECES)


class Judged:
    """Whole groups of pieces: which are later, which is the first of its content, and each group's contents."""

    def __init__(self, t: pa.RecordBatch):
        self.route, digest, self.key, a = (t.column(c).to_numpy() for c in ("route", "digest", KEY, "a"))
        self.n = digest & LONGEST
        marked = a < 0
        self.a = np.where(marked, -1 - a, a).astype(np.int64)
        own = np.flatnonzero(~marked)
        o = own[np.lexsort((self.a[own], self.key[own], digest[own], self.route[own]))]
        group = np.ones(len(o), bool)
        group[1:] = self.route[o][1:] != self.route[o][:-1]
        content = group.copy()
        content[1:] |= digest[o][1:] != digest[o][:-1]
        self.later = np.r_[np.flatnonzero(marked), o[~content]]
        self.first = o[content]
        which = np.cumsum(group) - 1
        contents = np.bincount(which[content], minlength=len(o) and which[-1] + 1)
        self.contents = contents[which[content]]  # of the group of each first


def whole_groups(batches: Iterator[pa.RecordBatch], by: str) -> Iterator[pa.RecordBatch]:
    """Batches of a partition sorted by ``by``, re-cut so that no group spans two of them."""
    held: list[pa.RecordBatch] = []
    value = None
    for batch in batches:
        if not batch.num_rows:
            continue
        x = batch.column(by).to_numpy()
        last = int(np.searchsorted(x, x[-1], "left"))
        if last == 0 and held and value == x[0]:
            held.append(batch)
            continue
        if last:
            held.append(batch.slice(0, last))
        if held:
            yield _joined(held)
        held, value = [batch.slice(last)], x[-1]
    if held:
        yield _joined(held)


def _joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return parts[0] if len(parts) == 1 else pa.concat_batches(parts)


def dealt(found: DataFrame) -> DataFrame:
    """Pieces by route, sorted by it, one task a partition."""
    return found.repartition("route").sortWithinPartitions("route")


def later_spans(found: DataFrame) -> DataFrame:
    """(_key, a, b) of every later occurrence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, "route"):
            j = Judged(t)
            a = j.a[j.later]
            yield pa.RecordBatch.from_arrays([pa.array(j.key[j.later]), pa.array(a.astype(np.int32)), pa.array((a + j.n[j.later]).astype(np.int32))], names=[KEY, "a", "b"])

    return dealt(found).mapInArrow(run, "_key long, a int, b int")


def by_document(spans: DataFrame) -> DataFrame:
    """(_key, spans): the ranges of each document; there are at most as many as its text has bytes."""
    return spans.groupBy(KEY).agg(F.collect_list(F.struct("a", "b")).alias("spans"))


def ranges(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(offsets, a, b) of a list column of (a, b) structs, without those whose third field is true; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = np.nan_to_num(pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(float)).astype(np.int64)
    flat = column.flatten()
    a, b = (flat.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(2))
    offs = np.r_[0, np.cumsum(lengths)]
    if flat.type.num_fields > 2:
        use = ~flat.field(2).to_numpy(zero_copy_only=False)
        offs, a, b = np.r_[0, np.cumsum(use)][offs], a[use], b[use]
    return offs, a, b


def texts(rows: DataFrame) -> DataFrame:
    """Key and text of every row; used for every join, so that one shuffle of the texts serves them all."""
    return rows.select(KEY, TEXT)


def without(rows: DataFrame, *spans: DataFrame, least: int = 0) -> DataFrame:
    """(_key, _id, n_bytes, n_spans, kept binary): the documents without their spans.

    Each table of spans is (_key, spans), one row per document. Texts are
    shuffled once, by key. A span with a true third field is left alone, and so
    is a merged one of fewer than ``least`` bytes unless it is the whole document.
    """
    out = texts(rows)
    names = [f"_s{i}" for i in range(len(spans))]
    for c, s in zip(names, spans, strict=True):
        out = out.join(s.withColumnRenamed(s.columns[1], c), KEY, "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = text_bytes(batch.column(TEXT))
            lists = [ranges(batch.column(c)) for c in names]
            kept: list[bytes] = []
            counts: list[int] = []
            for i in range(batch.num_rows):
                raw = data[offs[i] : offs[i + 1]].tobytes()
                a = np.concatenate([x[1][x[0][i] : x[0][i + 1]] for x in lists])
                if len(a):
                    a, b = merged(a, np.concatenate([x[2][x[0][i] : x[0][i + 1]] for x in lists]))
                    long = (b - a >= least) | (b - a == len(raw))
                    a, b = a[long], b[long]
                    edges = [0, *np.stack([a, b], 1).ravel().tolist(), len(raw)]
                    raw = b"".join(raw[x:y] for x, y in zip(edges[::2], edges[1::2], strict=True))
                kept.append(raw)
                counts.append(len(a))
            yield pa.RecordBatch.from_arrays([batch.column(KEY), pa.array(np.diff(offs)), pa.array(counts, pa.int64()), pa.array(kept, pa.binary())], names=[KEY, "n_bytes", "n_spans", "kept"])

    return named(rows, out.mapInArrow(run, "_key long, n_bytes long, n_spans long, kept binary"))
