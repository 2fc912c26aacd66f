"""Line dedup: repeated windows of three consecutive lines.

Lines end at ``\\n``; blank lines count. Every window of ``window``
consecutive lines is hashed (128 bits over its bytes). Of equal windows
anywhere in the table the one with the smallest (id, line) stays, the
positions that all the others cover are merged and removed. Windows are
judged on the input, not on what is left.

Defined results: a null or empty text is one empty line; a document of fewer
lines than a window has none and stays whole; rows with null or repeated ids
are documents of their own, nulls first, then by text; an empty table gives an
empty result; other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._kernel import Spans
from ._spark import DOC, KEY, TEXT, Slice, keyed, named, text_bytes, whole_rows
from .repeats import by_document, later_spans, pieces, ranges

NEWLINE = 10


def line_table(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of every line; each row has one more line than newlines."""
    cut = np.flatnonzero(data == NEWLINE)
    row = np.searchsorted(offs, cut, "right") - 1
    n = np.arange(len(offs) - 1)
    start = np.r_[offs[:-1], cut + 1]
    end = np.r_[cut, offs[1:]]
    row_s, row_e = np.r_[n, row], np.r_[row, n]
    s, e = np.lexsort((start, row_s)), np.lexsort((end, row_e))
    return start[s], end[e], row_s[s]


def cut_windows(window: int):
    def cut(s: Slice):
        start, end, row = line_table(s.data, s.offs)
        if len(start) < window:
            z = np.zeros(0, np.int64)
            return z.astype(np.uint64), z.astype(np.uint64), z, z, z
        ok = np.flatnonzero(row[: len(row) - window + 1] == row[window - 1 :])
        a, b = start[ok], end[ok + window - 1]
        first = np.searchsorted(row, np.arange(len(s)))
        line = ok - first[row[ok]]
        return Spans(s.data, 0)(a, b), Spans(s.data, 1)(a, b), row[ok], line, line + window

    return cut


COUNTS = "n_lines long, n_removed long, n_spans long, kept string"


def _without_lines(carried: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(TEXT)
            data, offs = text_bytes(column)
            known = column.is_valid().to_pylist()
            at, a, b = ranges(batch.column("spans"))
            kept, n_lines, n_removed, n_spans = [], [], [], []
            for i in range(batch.num_rows):
                raw = data[offs[i] : offs[i + 1]].tobytes()
                if at[i] == at[i + 1]:  # nothing goes
                    n_lines.append(raw.count(b"\n") + 1)
                    n_removed.append(0)
                    n_spans.append(0)
                else:
                    lines = raw.split(b"\n")
                    gone = np.zeros(len(lines) + 1, np.int64)
                    np.add.at(gone, a[at[i] : at[i + 1]], 1)
                    np.add.at(gone, b[at[i] : at[i + 1]], -1)
                    gone = np.cumsum(gone)[:-1] > 0
                    n_lines.append(len(lines))
                    n_removed.append(int(gone.sum()))
                    n_spans.append(int((np.diff(np.r_[0, gone.astype(np.int8)]) == 1).sum()))
                    raw = b"\n".join(x for x, g in zip(lines, gone, strict=True) if not g)
                kept.append(raw.decode("utf-8", "replace") if known[i] else None)
            counts = [pa.array(x, pa.int64()) for x in (n_lines, n_removed, n_spans)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in carried), *counts, pa.array(kept, pa.string())], names=[*carried, "n_lines", "n_removed", "n_spans", "kept"]
            )

    return run


def _removed(rows: DataFrame, carried: list[str], window: int) -> DataFrame:
    """``carried`` columns of rows with ``_key`` and ``_text``, and the counts; the texts are shuffled once."""
    spans = by_document(later_spans(pieces(rows, cut_windows(window))))
    out = rows.select(*carried, TEXT).join(spans, KEY, "left")
    schema = T.StructType([*(rows.schema[c] for c in carried), *T.StructType.fromDDL(COUNTS).fields])
    return out.mapInArrow(_without_lines(carried), schema)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 3) -> DataFrame:
    """(_key, _id, n_lines, n_removed, n_spans, kept string) of each document; ``kept`` is null where the text is."""
    rows = keyed(docs, id_col, text_col)
    return named(rows, _removed(rows, [KEY], window))


def stripped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", count_col: str | None = None, window: int = 3) -> DataFrame:
    """The rows of ``docs``, each once and with all its columns, with what stays as its text.

    ``count_col`` holds the characters of the text and follows where it changes.
    """
    rows = whole_rows(docs, id_col, text_col)
    out = _removed(rows, [KEY, DOC], window)
    old = F.col(DOC).getField(count_col) if count_col else None
    n = F.when(F.col("n_removed") > 0, F.length("kept").cast(docs.schema[count_col].dataType)).otherwise(old) if count_col else None
    new = {text_col: F.col("kept")} | ({count_col: n} if count_col else {})
    return out.select(*[new.get(c, F.col(DOC).getField(c)).alias(c) for c in docs.columns])


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: lines, removed lines, removed runs and the digest of what stays."""
    out = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select(F.col("_id").alias("doc_id"), "n_lines", "n_removed", "n_spans", F.sha2(F.coalesce("kept", F.lit("")), 256).alias("kept_sha256"))


ORACLE = """
WITH parts AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
lines AS (SELECT doc_id, len(ls) AS n, ls, unnest(range(len(ls))) AS i FROM parts),
wins AS (SELECT doc_id, i, ls[i + 1] || chr(10) || ls[i + 2] || chr(10) || ls[i + 3] AS w FROM lines WHERE i + 3 <= n),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY w ORDER BY doc_id, i) AS r FROM wins) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, i + d AS i FROM later, (VALUES (0), (1), (2)) t(d)),
flagged AS (SELECT l.doc_id, l.n, l.i, l.ls[l.i + 1] AS line, g.i IS NOT NULL AS out_, lag(g.i IS NOT NULL, 1, false) OVER (PARTITION BY l.doc_id ORDER BY l.i) AS before_
            FROM lines l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.i = g.i)
SELECT doc_id, max(n)::BIGINT AS n_lines, count(*) FILTER (out_)::BIGINT AS n_removed, count(*) FILTER (out_ AND NOT before_)::BIGINT AS n_spans,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT out_), '')) AS kept_sha256
FROM flagged GROUP BY doc_id
"""
