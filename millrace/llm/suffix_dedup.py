"""Suffix-array dedup: repeated byte strings of a fixed length, found exactly.

1. Every window of ``length`` bytes has an anchor, its leftmost smallest
   ``k``-gram hash. The windows that share an anchor position form one segment.
   Equal windows have equal anchors at the same place, so they meet when
   segments are grouped by anchor.
2. Segments of equal content collapse: all but the first are later occurrences
   as they stand. Where a group has several contents, the first segment of each
   goes on, with its bytes.
3. The segments of a task form a text collection. Windows at either end of a
   segment whose hash no other window has cannot repeat and are cut off, which
   leaves some segments with nothing. Of the rest the Burrows-Wheeler transform
   and the longest common prefixes are built column by column: each round
   inserts one symbol of every segment, from the last to the first, reads the
   columns from sequential files in a temporary folder and writes them anew; a
   column is in memory while its round runs, so a collection is bounded.
   Neighbours in suffix order with a common prefix of ``length`` or more hold
   the same window; all but the earliest are later occurrences.
4. A group of more than ``bound`` bytes (a passage that very many documents
   share) is not built by one task: its windows are hashed (118 bits), equal
   ones of a slice of text meet before the shuffle, and the rest are dealt by
   their hash.

Anchors that turn up very often in a sample rank behind all others. That
balances the groups, it never changes a result: the order is the same for all.

Defined results: a null text is empty; a text shorter than ``length`` stays
whole; rows with null or repeated ids are documents of their own, nulls first,
then by text; an empty table gives an empty result; other columns do not
matter.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._kernel import Spans, kgrams, runs, sliding_min
from ._spark import KEY, Slice, keyed, slices, text_bytes
from .repeats import Judged, by_document, collapsed, dealt, pieces, texts, whole_groups, without

LENGTH, GRAM = 100, 32
POS_BITS = 22
COLLECTION = 2 << 20  #: symbols of one collection; the windows of a larger group are dealt out
SAMPLE_IN, HOT_SHARE, HOT_MOST = 32, 2000, 4096


class Hot:
    """Membership in a small set of anchors, by a table of their low bits first."""

    def __init__(self, values: np.ndarray):
        self.values = np.sort(values.astype(np.uint64))
        self.table = np.zeros(1 << 16, bool)
        self.table[(self.values & np.uint64(0xFFFF)).astype(np.int64)] = True

    def mark(self, h: np.ndarray) -> np.ndarray:
        """Positions of h that hold a hot value."""
        if not len(self.values):
            return np.zeros(0, np.int64)
        near = np.flatnonzero(self.table[(h & np.uint64(0xFFFF)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.values, h[near]), len(self.values) - 1)
        return near[self.values[at] == h[near]]


def segments(data: np.ndarray, offs: np.ndarray, length: int, k: int, hot: Hot) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, row, first window's start, windows) of each segment, in order of place."""
    z = np.zeros(0, np.int64)
    if len(data) < length:
        return z.astype(np.uint64), z, z, z
    if len(data) >= 1 << POS_BITS:
        return _long(data, offs, length, k, hot)
    h = kgrams(data, k)
    rank = (h >> np.uint64(1)) >> np.uint64(POS_BITS) << np.uint64(POS_BITS)
    rank[hot.mark(h)] |= np.uint64(1 << 63)
    rank |= np.arange(len(h), dtype=np.uint64)
    anchor = (sliding_min(rank, length - k + 1) & np.uint64((1 << POS_BITS) - 1)).astype(np.int64)
    n = len(anchor)  # windows, were there no rows
    row = np.repeat(np.arange(len(offs) - 1), np.diff(offs))[:n]
    ok = np.arange(n) + length <= offs[row + 1]
    new = np.empty(n, bool)
    new[0] = True
    new[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])
    ok_new = new & ok
    start = np.flatnonzero(ok_new)
    if not len(start):
        return z.astype(np.uint64), z, z, z
    # the windows of a run end where the next run or the row's last window ends
    until = np.r_[np.flatnonzero(new), n]
    stop = until[np.searchsorted(until, start, "right")]
    stop = np.minimum(stop, offs[row[start] + 1] - length + 1)
    return h[anchor[start]], row[start], start, stop - start


def _long(data, offs, length, k, hot):
    """A text of more than 4 MB, in overlapping parts: the anchors are the same, a run is at most cut in two."""
    out = []
    step = (1 << POS_BITS) - length
    for row in range(len(offs) - 1):
        for at in range(int(offs[row]), max(int(offs[row + 1]) - length + 1, int(offs[row])), step):
            part = data[at : min(at + step + length - 1, int(offs[row + 1]))]
            h, _, start, n = segments(part, np.array([0, len(part)]), length, k, hot)
            out.append((h, np.full(len(h), row), start + at, n))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else segments(data[:0], offs[:1], length, k, hot)


def cut_segments(length: int, k: int, hot: Hot):
    def cut(s: Slice):
        h, row, start, n = segments(s.data, s.offs, length, k, hot)
        a = start - s.offs[row]
        return h, Spans(s.data)(start, start + n + length - 1), row, a, a + n

    return cut


class Columns:
    """The columns of a collection in files: every round reads the old ones in order and writes new ones.

    Two files a column take turns and stay open; they only grow.
    """

    def __init__(self, folder: str, **columns: np.ndarray):
        self.turn, self.sizes = 0, {}
        self.types = {k: x.dtype for k, x in columns.items()}
        self.files = {(k, i): open(os.path.join(folder, f"{k}{i}"), "w+b", buffering=0) for k in columns for i in (0, 1)}  # noqa: SIM115
        self.write(**columns)

    def read(self, *names: str) -> list[np.ndarray]:
        out = []
        for k in names:
            f, x = self.files[k, self.turn], np.empty(self.sizes[k], self.types[k])
            f.seek(0)
            if f.readinto(x) != x.nbytes:
                raise OSError(f"{k} is cut short")
            out.append(x)
        return out

    def write(self, **columns: np.ndarray) -> None:
        self.turn = 1 - self.turn
        for k, x in columns.items():
            f = self.files[k, self.turn]
            f.seek(0)
            if f.write(x) != x.nbytes:
                raise OSError(f"{k} is cut short")
            self.sizes[k] = len(x)

    def close(self) -> None:
        for f in self.files.values():
            f.close()


PLACE = 24  #: bits of a place in the transform; the symbol lies above them
_PLACES = np.uint32((1 << PLACE) - 1)


def _common(occurs: np.ndarray, at: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    """1 + the smallest common prefix between the places of the symbol occurrences at - 1 and at."""
    a, b = (occurs[at - 1] & _PLACES).astype(np.int64) + 1, (occurs[at] & _PLACES).astype(np.int64) + 1
    by = np.argsort(a, kind="stable")
    least = np.minimum.reduceat(np.r_[lcp, lcp[:1]], np.stack([a[by], b[by]], 1).ravel())[::2]
    out = np.empty(len(at), lcp.dtype)
    out[by] = least + 1
    return out


def collection(data: np.ndarray, start: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffix order of the texts data[start:start+lens]: (text, suffix length, common prefix with the one before).

    Column-wise: round j inserts the suffix of length j of every text that has
    one. Ends of text differ from each other and precede all symbols. Next to
    the transform and the common prefixes lies ``occurs``, the transform's
    places sorted by symbol, from which the place of a suffix follows without
    counting anew.
    """
    n, rounds = len(start), int(lens.max(initial=0))
    used = np.flatnonzero(np.bincount(data, minlength=256))
    if len(used) > 255 or int(lens.sum()) + n >= 1 << PLACE:
        raise ValueError("a collection holds at most 255 different symbols and 16 million of them")
    symbol = np.zeros(256, np.uint8)
    symbol[used] = np.arange(1, len(used) + 1)
    text = symbol[data]
    kind = np.uint8 if rounds < 255 else np.uint32
    end = start + lens
    bwt = np.where(lens > 0, text[np.maximum(end - 1, 0)], 0).astype(np.uint8)
    occurs = np.sort((bwt.astype(np.uint32) << np.uint32(PLACE)) | np.arange(n, dtype=np.uint32))
    with tempfile.TemporaryDirectory() as folder:
        files = Columns(folder, bwt=bwt, lcp=np.zeros(n, kind), occurs=occurs)
        pos = np.arange(n)
        for j in range(1, rounds + 1):
            bwt, lcp, occurs = files.read("bwt", "lcp", "occurs")
            act = np.flatnonzero(lens >= j)
            ask = (text[end[act] - j].astype(np.uint32) << np.uint32(PLACE)) | pos[act].astype(np.uint32)
            by = np.argsort(ask)
            act = act[by]
            t = np.searchsorted(occurs, ask[by])
            done = int(np.searchsorted(occurs, np.uint32(1 << PLACE)))
            place = t + (n - done)
            pos[act] = place
            size = len(bwt) + len(act)
            old = np.ones(size, bool)
            old[place] = False
            new_bwt, new_lcp = np.empty(size, np.uint8), np.zeros(size, kind)
            new_bwt[old], new_lcp[old] = bwt, lcp
            new_bwt[place] = np.where(lens[act] > j, text[np.maximum(end[act] - j - 1, 0)], 0)
            both = np.sort(np.r_[t, t[t + 1 < len(occurs)] + 1])
            touched = both[np.r_[True, both[1:] != both[:-1]]]
            prior = np.maximum(touched - 1, 0)
            same = (touched > 0) & (occurs[touched] >> np.uint32(PLACE) == occurs[prior] >> np.uint32(PLACE))
            new_lcp[touched[~same] + (n - done)] = 0
            if same.any():
                new_lcp[touched[same] + (n - done)] = _common(occurs, touched[same], lcp)
            moved = np.flatnonzero(old).astype(np.uint32)[occurs & _PLACES] | (occurs & ~_PLACES)
            fresh = np.sort((new_bwt[place].astype(np.uint32) << np.uint32(PLACE)) | place.astype(np.uint32))
            at = np.searchsorted(moved, fresh) + np.arange(len(fresh))
            keep = np.ones(size, bool)
            keep[at] = False
            new_occurs = np.empty(size, np.uint32)
            new_occurs[at], new_occurs[keep] = fresh, moved
            files.write(bwt=new_bwt, lcp=new_lcp, occurs=new_occurs)
        bwt, lcp, occurs = files.read("bwt", "lcp", "occurs")
        files.close()
    rank = np.empty(len(bwt), np.int32)
    rank[occurs & _PLACES] = np.arange(len(bwt), dtype=np.int32)
    which, size = np.empty(len(bwt), np.int32), np.zeros(len(bwt), np.int32)
    pos = np.arange(n)
    which[:n] = pos
    for j in range(1, rounds + 1):  # walk back through the finished transform to name its suffixes
        act = np.flatnonzero(lens >= j)
        pos[act] = rank[pos[act]]  # n ends of text come first, as many as finished texts
        which[pos[act]], size[pos[act]] = act, j
    return which, size, lcp


def later_windows(data: np.ndarray, start: np.ndarray, lens: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, offset) of the windows that an earlier text holds too; texts are in order of place."""
    which, size, lcp = collection(data, start, lens)
    whole = np.flatnonzero(size >= length)
    if not len(whole):
        z = np.zeros(0, np.int64)
        return z, z
    head = np.flatnonzero(lcp[whole] < length)  # shorter suffixes never lie between equal windows
    first = np.repeat(np.minimum.reduceat(which[whole], head), np.diff(np.r_[head, len(whole)]))
    again = whole[which[whole] != first]
    return which[again].astype(np.int64), (lens[which[again]] - size[again]).astype(np.int64)


def repeated_part(data: np.ndarray, start: np.ndarray, lens: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, offset, length) of what lies between the first and the last window of a text whose hash another window has too.

    Texts without such a window are left out; equal windows have equal hashes,
    so none that repeats is lost.
    """
    n = lens - length + 1
    head = np.cumsum(n) - n
    row = np.repeat(np.arange(len(n)), n)
    at = np.arange(len(row)) - head[row]
    h = kgrams(data, length)[start[row] + at]
    order = np.argsort(h)
    same = h[order][1:] == h[order][:-1]
    again = np.zeros(len(h), bool)
    again[order[1:][same]] = again[order[:-1][same]] = True
    first = np.minimum.reduceat(np.where(again, at, len(h)), head)
    last = np.maximum.reduceat(np.where(again, at, -1), head)
    text = np.flatnonzero(last >= 0)
    return text, first[text], (last - first)[text] + length


def _compare(groups: pa.RecordBatch, length: int) -> pa.RecordBatch:
    """Spans of the later windows of one or more whole groups of segments."""
    k, a = groups.column(KEY).to_numpy(), groups.column("a").to_numpy()
    order = np.lexsort((a, k))
    data, offs = text_bytes(groups.column("bytes"))
    k, a, start, lens = k[order], a[order].astype(np.int64), offs[:-1][order], np.diff(offs)[order]
    text, skipped, lens = repeated_part(data, start, lens, length)
    k, a, start = k[text], a[text] + skipped, start[text] + skipped
    if int(lens.sum()) <= COLLECTION:
        who, at = later_windows(data, start, lens, length)
    else:  # exact as well: equal windows have equal hashes, so they share a part
        row = np.repeat(np.arange(len(lens)), lens - length + 1)
        at = np.arange(len(row)) - np.repeat(np.cumsum(lens - length + 1) - (lens - length + 1), lens - length + 1)
        place = start[row] + at
        part = (Spans(data)(place, place + length) % np.uint64(-(-len(row) * length // COLLECTION))).astype(np.int64)
        by = np.argsort(part, kind="stable")
        found = []
        for x in np.split(by, runs(part[by])[1:]):
            w, _ = later_windows(data, place[x], np.full(len(x), length), length)
            found.append(x[w])
        found = np.concatenate(found)
        who, at = row[found], at[found]
    o = np.lexsort((at, who))
    who, at = who[o], at[o]
    new = np.flatnonzero(np.r_[True, (who[1:] != who[:-1]) | (at[1:] != at[:-1] + 1)]) if len(who) else who
    last = np.r_[new[1:], len(who)] - 1 if len(who) else who
    w = who[new]
    return pa.RecordBatch.from_arrays([pa.array(k[w]), pa.array((a[w] + at[new]).astype(np.int32)), pa.array((a[w] + at[last] + length).astype(np.int32))], names=[KEY, "a", "b"])


def hot_anchors(rows: DataFrame, length: int, k: int) -> Hot:
    """At most 4,096 anchors that hold more than one in 2,000 segments of a sample of one document in 32."""
    found = pieces(rows.filter(F.pmod(F.xxhash64(KEY), F.lit(SAMPLE_IN)) == 0), cut_segments(length, k, Hot(np.zeros(0, np.uint64))))
    counts = found.filter("a >= 0").groupBy("route").agg(F.count("*").alias("n"))
    top = counts.filter("n >= 64").orderBy(F.desc("n"), "route").limit(HOT_MOST).collect()
    if not top:
        return Hot(np.zeros(0, np.uint64))
    least = max(64, sum(r["n"] for r in top) // HOT_SHARE)
    return Hot(np.array([r["route"] for r in top if r["n"] >= least], np.int64).view(np.uint64))


def oversized(j: Judged, length: int, bound: int) -> np.ndarray:
    """For the first of each content: whether its group's contents have more than ``bound`` bytes together."""
    if not len(j.first):
        return np.zeros(0, bool)
    head = runs(j.route[j.first])
    size = np.add.reduceat(j.n[j.first] + length - 1, head)
    return np.repeat(size > bound, np.diff(np.r_[head, len(j.first)]))


def window_pieces(s: Slice, row: np.ndarray, a: np.ndarray, b: np.ndarray, length: int) -> pa.RecordBatch:
    """The windows of the ranges [a, b) of a slice's rows, as pieces of no length of their own."""
    n = b - a - length + 1
    row = np.repeat(row, n)
    at = np.repeat(a, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    place = s.offs[row] + at
    hashes = (Spans(s.data, which)(place, place + length) for which in (0, 1))
    return collapsed(*hashes, s.keys[row].astype(np.int64), at, at)


def later_of(windows: pa.RecordBatch, length: int) -> pa.RecordBatch:
    """Spans of the later windows of whole groups of window pieces, touching ones merged."""
    j = Judged(windows)
    k, a = j.key[j.later], j.a[j.later]
    o = np.lexsort((a, k))
    k, a = k[o], a[o]
    new = np.flatnonzero(np.r_[True, (k[1:] != k[:-1]) | (a[1:] > a[:-1] + length)]) if len(k) else o
    last = np.r_[new[1:], len(k)] - 1 if len(k) else o
    return pa.RecordBatch.from_arrays([pa.array(k[new]), pa.array(a[new].astype(np.int32)), pa.array((a[last] + length).astype(np.int32))], names=[KEY, "a", "b"])


def dedup_strings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, k: int = GRAM, bound: int = COLLECTION) -> DataFrame:
    """(_key, _id, n_bytes, n_spans, kept binary) of each document without its later strings of ``length`` bytes."""
    if not 1 <= k <= length:
        raise ValueError("k must be between 1 and length")
    if bound > COLLECTION:
        raise ValueError(f"bound must be at most {COLLECTION}")
    rows = keyed(docs, id_col, text_col)
    hot = hot_anchors(rows, length, k)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Byte ranges of later segments, and of the first of each content where a group has several; grp 0: its windows are dealt out."""
        for t in whole_groups(batches, "route"):
            j = Judged(t)
            compare, wide = j.first[j.contents > 1], oversized(j, length, bound)[j.contents > 1]
            both = np.r_[j.later, compare]
            a = j.a[both]
            group = np.r_[np.zeros(len(j.later), np.int64), np.where(wide, 0, j.route[compare])]
            yield pa.RecordBatch.from_arrays([pa.array(j.key[both]), pa.array(a.astype(np.int32)), pa.array((a + j.n[both] + length - 1).astype(np.int32)), pa.array(np.arange(len(both)) >= len(j.later)), pa.array(group)], names=[KEY, "a", "b", "compare", "grp"])

    judged = dealt(pieces(rows, cut_segments(length, k, hot))).mapInArrow(judge, "_key long, a int, b int, compare boolean, grp long")
    marks = judged.groupBy(KEY).agg(F.collect_list(F.struct("a", "b", "compare", "grp")).alias("marks"))
    marked = texts(rows).join(marks, KEY, "inner")

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(group, key, a, bytes) of the segments to compare; of oversized groups the windows, with a digest and no bytes."""
        for batch in batches:
            for s in slices(batch):
                lists = batch.column("marks").slice(s.rows.start, len(s))
                flat, lens = lists.flatten(), pc.list_value_length(lists).to_numpy(zero_copy_only=False)
                a, b, compare, grp = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(4))
                row = np.repeat(np.arange(len(s)), lens)[compare]
                grp, a, b = grp[compare], a[compare].astype(np.int64), b[compare].astype(np.int64)
                wide = grp == 0
                if wide.any():
                    w = window_pieces(s, row[wide], a[wide], b[wide], length)
                    yield pa.RecordBatch.from_arrays([w.column("route"), w.column(KEY), w.column("a"), pa.nulls(w.num_rows, pa.binary()), w.column("digest")], names=names)
                    grp, row, a, b = grp[~wide], row[~wide], a[~wide], b[~wide]
                yield pa.RecordBatch.from_arrays([pa.array(grp), pa.array(s.keys[row], pa.int64()), pa.array(a.astype(np.int32)), _cut(s.data, s.offs[row] + a, s.offs[row] + b), pa.nulls(len(grp), pa.int64())], names=names)

    names = ["grp", KEY, "a", "bytes", "digest"]
    parts = marked.mapInArrow(fetch, "grp long, _key long, a int, bytes binary, digest long")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for t in whole_groups(batches, "grp"):
            single = t.column("bytes").is_null()
            if t.column("bytes").null_count:
                w = t.filter(single)
                yield later_of(pa.RecordBatch.from_arrays([w.column("grp"), w.column("digest"), w.column(KEY), w.column("a")], names=["route", "digest", KEY, "a"]), length)
                t = t.filter(pc.invert(single))
                if not t.num_rows:
                    continue
            n = t.column("bytes").nbytes
            if held and size + n > COLLECTION:
                yield _compare(pa.concat_batches(held), length)
                held, size = [], 0
            for p in _by_group(t, COLLECTION):
                held.append(p)
                size += p.column("bytes").nbytes
                if size > COLLECTION // 2:
                    yield _compare(pa.concat_batches(held), length)
                    held, size = [], 0
        if held:
            yield _compare(pa.concat_batches(held), length)

    windows = parts.repartition("grp").sortWithinPartitions("grp").mapInArrow(compare, "_key long, a int, b int")
    return without(rows, marks, by_document(windows))


def _cut(data: np.ndarray, x: np.ndarray, y: np.ndarray) -> pa.Array:
    n = y - x
    offs = np.r_[0, np.cumsum(n)]
    index = np.arange(offs[-1]) + np.repeat(x - offs[:-1], n)
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(offs.astype(np.int32)), pa.py_buffer(data[index])])


def _by_group(t: pa.RecordBatch, limit: int) -> Iterator[pa.RecordBatch]:
    """Runs of whole groups of about ``limit`` / 2 bytes."""
    at = np.r_[runs(t.column("grp").to_numpy()), t.num_rows]
    lens = np.r_[0, np.cumsum(np.diff(text_bytes(t.column("bytes"))[1]))]
    first = 0
    for j in range(1, len(at)):
        if j == len(at) - 1 or lens[at[j + 1]] - lens[at[first]] > limit // 2:
            yield t.slice(at[first], at[j] - at[first])
            first = j


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: bytes, removed bytes, maximal removed runs and the digest of what stays."""
    out = dedup_strings(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select(F.col("_id").alias("doc_id"), "n_bytes", (F.col("n_bytes") - F.length("kept")).cast("long").alias("n_removed"), "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
