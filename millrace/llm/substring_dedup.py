"""Substring dedup by content-defined chunking.

A gear rolling hash over the last 32 bytes of the same text marks boundaries;
where they lie depends on nearby bytes alone, never on another document, so an
insertion moves at most the chunks it touches and equal texts have equal chunks. A boundary closer than ``least`` bytes to the candidate before it is
skipped, a chunk longer than ``most`` is cut every ``most`` bytes from its
start. Each chunk has a 128-bit digest; of equal chunks the one with the
smallest (id, start) is the first. Later ones are merged with their neighbours
and a merged run of at least ``min_run`` bytes is removed, or one of any length
that is the whole document; other shorter runs (stray common chunks) stay.

Defined results: a null or empty text has no chunk; rows with null or repeated
ids are documents of their own, nulls first, then by text; an empty table
gives an empty result; other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._kernel import Spans, byte_values, merged, runs
from ._spark import KEY, Slice, keyed
from .repeats import by_document, later_spans, pieces, whole_groups, without

LEAST, MEAN_BITS, MOST, MIN_RUN = 8, 5, 256, 64


def gear(data: np.ndarray, offs: np.ndarray | None = None) -> np.ndarray:
    """The 32-bit gear hash at every byte: h = (h << 1) + G[byte], by doubling over its 32-byte window, anew in each row."""
    h = (byte_values(7)[data] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    size = 1
    while size < 32:
        h[size:] += h[:-size] << np.uint32(size)
        size *= 2
    if offs is not None:
        # what the bytes before a row add to its first ones is their hash, shifted
        rows = np.unique(offs[1:-1])
        rows = rows[(rows > 0) & (rows < len(data))]
        n = np.minimum(31, np.diff(np.r_[rows, len(data)]))
        i = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        before = np.repeat(h[rows - 1], n)
        h[np.repeat(rows, n) + i] -= before << (i + 1).astype(np.uint32)
    return h


def boundaries(data: np.ndarray, offs: np.ndarray, least: int, bits: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of the chunks of all rows, in order."""
    h = gear(data, offs)
    cut = np.flatnonzero(h >> np.uint32(32 - bits) == 0) + 1
    ends = np.union1d(cut, offs)
    row_edge = np.isin(ends, offs, assume_unique=True)
    near = np.r_[False, np.diff(ends) < least] & ~row_edge
    # a candidate right after a row's start is judged by the distance to that start as well
    ends = ends[~near]
    start, end = ends[:-1], ends[1:]
    n = np.maximum(1, -(-(end - start) // most))
    which = np.repeat(np.arange(len(start)), n)
    part = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
    a = start[which] + part * most
    return a, np.minimum(a + most, end[which])


def cut_chunks(least: int, bits: int, most: int):
    def cut(s: Slice):
        z = np.zeros(0, np.int64)
        if not len(s.data):
            return z.astype(np.uint64), z.astype(np.uint64), z, z, z
        a, b = boundaries(s.data, s.offs, least, bits, most)
        row = np.searchsorted(s.offs, a, "right") - 1
        base = s.offs[row]
        return Spans(s.data, 0)(a, b), Spans(s.data, 1)(a, b), row, a - base, b - base

    return cut


def _long_runs(min_run: int):
    """Of each document's later chunks, the merged runs of at least ``min_run`` bytes, and those at its start: they may be all of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, KEY):
            k, a, b = (t.column(c).to_numpy() for c in (KEY, "a", "b"))
            keys, starts, ends = [], [], []
            at = np.r_[runs(k), len(k)]
            for i, j in zip(at[:-1], at[1:], strict=True):
                x, y = merged(a[i:j], b[i:j])
                long = (y - x >= min_run) | (x == 0)
                keys.append(np.full(int(long.sum()), k[i]))
                starts.append(x[long])
                ends.append(y[long])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(starts).astype(np.int32)), pa.array(np.concatenate(ends).astype(np.int32))], names=[KEY, "a", "b"])

    return run


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, bits: int = MEAN_BITS, most: int = MOST, min_run: int = MIN_RUN) -> DataFrame:
    """(_key, _id, n_bytes, n_spans, kept binary) of each document."""
    rows = keyed(docs, id_col, text_col)
    later = later_spans(pieces(rows, cut_chunks(least, bits, most)))
    spans = later.repartition(KEY).sortWithinPartitions(KEY).mapInArrow(_long_runs(min_run), "_key long, a int, b int")
    return without(rows, by_document(spans), least=min_run)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: bytes, removed bytes, removed runs and the digest of what stays."""
    out = dedup_substrings(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select(F.col("_id").alias("doc_id"), "n_bytes", (F.col("n_bytes") - F.length("kept")).cast("long").alias("n_removed"), "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
