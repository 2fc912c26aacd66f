"""Packing by shortest-pack-first over the length histogram.

1. Every document becomes token ids and an end id. Pieces of exactly one
   sequence are cut from its front; what is left is one more piece, shorter
   than a sequence.
2. The histogram of the other pieces' lengths (at most one row per length) goes
   to the driver. Lengths are placed from the longest to the shortest, each on the
   pack that is shortest so far, updating the counts of packing patterns, never
   single pieces.
3. Patterns join back to pieces by rank: the r-th piece of a length takes the
   r-th place for that length. Ranks are counted per length and hash part; a
   length has the more parts the more pieces it has, so one that holds a third
   of all is not ranked in one task. A piece that fills a sequence has no rank:
   its sequence follows from where it is stored, so sequence ids have gaps.

Defined results: a null or empty text has the end id alone; rows with null or
repeated ids are documents of their own; an empty table gives an empty result;
other columns do not matter.
"""

from __future__ import annotations

import heapq
import re
import unicodedata
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._kernel import runs
from ._spark import KEY, TEXT, keyed, named, slices, stored

SEQUENCE, END = 4096, 2
RANKED, PARTS = 4096, 1 << 16  #: pieces of a length that are ranked together at least, and parts of all lengths at most
CACHE = 400_000
AT_ONCE = 8 << 20  #: bytes of text whose words are encoded together
FIELDS = [KEY, "start", "length", "ids_crc32", "doc_tokens", "ids"]

_PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+")  # the vocabulary's own word pattern, over ASCII
_ODD = ("\x1c", "\x1d", "\x1e", "\x1f", "<|"), ("\x85", "Σ")  # where words may not be encoded one by one: in any text, in others than ASCII
_BYTES = str.maketrans({b: chr(256 + i) for i, b in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b))})  # the vocabulary's letter for each byte


def _odd(text: str) -> bool:
    plain, other = _ODD
    if text.isascii():
        return any(x in text for x in plain)
    return any(x in text for x in (*plain, *other)) or not unicodedata.is_normalized("NFC", text)


class Encoder:
    """Ids of a word-level vocabulary file, equal to encoding the whole text; words are remembered.

    The pattern never joins characters across white space, so the distinct
    words of many texts are encoded once each and put together by index. The
    memory holds two generations of ``CACHE`` words.
    """

    def __init__(self, path: str):
        import tokenizers

        self.whole = tokenizers.Tokenizer.from_file(path)
        self.model = self.whole.model
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _ids(self, text: str) -> bytes:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _word(self, word: str) -> bytes:
        got = self.old.get(word)
        if got is None:
            if word.isascii():
                got = array("I", [t.id for p in _PARTS.findall(word) for t in self.model.tokenize(p)]).tobytes()
            elif word.isalpha():
                letters = word.encode().decode("latin-1").translate(_BYTES)
                got = array("I", [t.id for t in self.model.tokenize(letters)]).tobytes()
            else:
                got = self._ids(word)
        if len(self.young) >= CACHE:
            self.old, self.young = self.young, {}
        self.young[word] = got
        return got

    def many(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets): unsigned 32-bit ids of all texts, those of text i at offsets[i] to offsets[i + 1]."""
        odd = {i: t for i, t in enumerate(texts) if _odd(t)}
        words = pc.utf8_split_whitespace(pa.array(["" if i in odd else t.lower() for i, t in enumerate(texts)], pa.large_string()))
        coded = words.flatten().dictionary_encode()
        get, word = self.young.get, self._word
        found = [get(w) or word(w) for w in coded.dictionary.to_numpy(zero_copy_only=False)]
        size = np.fromiter(map(len, found), np.int64, len(found)) // 4
        first = np.cumsum(size) - size
        which = coded.indices.to_numpy()
        n = size[which]
        ends = np.r_[0, np.cumsum(n)]
        at = np.arange(ends[-1]) + np.repeat(first[which] - ends[:-1], n)
        ids, offs = np.frombuffer(b"".join(found), "<u4")[at], ends[words.offsets.to_numpy() - words.offsets[0].as_py()]
        if odd:
            parts = [np.frombuffer(self._ids(odd[i]), "<u4") if i in odd else ids[offs[i] : offs[i + 1]] for i in range(len(texts))]
            ids, offs = np.concatenate(parts), np.r_[0, np.cumsum([len(p) for p in parts])]
        return ids, offs

    def __call__(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        return self.many([text])[0].tobytes()


class Patterns:
    """Packing patterns: (count, lengths from the left)."""

    def __init__(self, size: int):
        self.size = size
        self.packs: list[tuple[int, tuple[int, ...]]] = []

    def sequences(self) -> int:
        return sum(n for n, _ in self.packs)


def shortest_first(histogram: dict[int, int], size: int) -> Patterns:
    """Shortest-pack-first: longest lengths first, each on the shortest pack; counts move, not pieces."""
    at: dict[int, list[tuple[int, tuple[int, ...]]]] = defaultdict(list)  # packs by filled length
    fill: list[int] = []  # a heap of those lengths

    def put(length: int, n: int, pack: tuple[int, ...]) -> None:
        if not at[length]:
            heapq.heappush(fill, length)
        at[length].append((n, pack))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        grown = []
        while left:
            while fill and not at[fill[0]]:
                heapq.heappop(fill)
            if not fill or fill[0] + length > size:
                grown.append((length, left, (length,)))
                break
            now = fill[0]
            n, pack = at[now].pop()
            use = min(n, left)
            if use < n:
                at[now].append((n - use, pack))
            grown.append((now + length, use, (*pack, length)))
            left -= use
        for g in grown:
            put(*g)
    out = Patterns(size)
    out.packs = sorted(((n, p) for x in at.values() for n, p in x), key=lambda x: (-sum(x[1]), x[1]))
    return out


def tokens(rows: DataFrame, path: str, end: int, size: int, ids: bool) -> DataFrame:
    """(_key, start, length, ids_crc32, doc_tokens, ids) of each piece; ``ids`` are null unless asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(path)
        tail = np.array([end], "<u4").tobytes()
        for batch in batches:
            for s in slices(batch, limit=AT_ONCE):
                got, offs = encode.many([t or "" for t in batch.column(TEXT).slice(s.rows.start, len(s)).to_numpy(zero_copy_only=False)])
                n = np.diff(offs) + 1  # with the end id
                pieces = -(-n // size)
                row = np.repeat(np.arange(len(n)), pieces)
                start = (np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * size
                length = np.minimum(size, n[row] - start)
                last = start + length == n[row]
                raw = memoryview(got).cast("B")
                begin = offs[row] + start
                bounds = zip((4 * begin).tolist(), (4 * (begin + length - last)).tolist(), last.tolist(), strict=True)
                parts = [raw[a:b].tobytes() + tail if z else raw[a:b] for a, b, z in bounds]
                columns = [s.keys[row], start, length, [zlib.crc32(p) for p in parts], n[row]]
                held = pa.array([bytes(p) for p in parts], pa.binary()) if ids else pa.nulls(len(row), pa.binary())
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns), held], names=FIELDS)

    return rows.select(KEY, TEXT).mapInArrow(run, "_key long, start long, length long, ids_crc32 long, doc_tokens long, ids binary")


def slots(found: Patterns) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per length: (first rank, first sequence, offset) of each run of places, in rank order."""
    places: dict[int, list[list[int]]] = defaultdict(list)
    base = 0
    for n, pack in found.packs:
        at = 0
        for length in pack:
            have = places[length]
            have.append([have[-1][0] + have[-1][3] if have else 0, base, at, n])
            at += length
        base += n
    return {k: tuple(np.array(v, np.int64)[:, :3].T) for k, v in places.items()}


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", size: int = SEQUENCE, end: int = END, ids: bool = True) -> DataFrame:
    """(_key, _id, start, length, ids_crc32, doc_tokens, ids, sequence_id, offset) of every piece."""
    rows = keyed(docs, id_col, text_col)
    pieces = stored(tokens(rows, path, end, size, ids), "pieces")  # texts are encoded once
    short = pieces.filter(F.col("length") < size)
    total = {r["length"]: r["count"] for r in short.groupBy("length").count().collect()}  # a row per length
    found = shortest_first(total, size)
    place = slots(found)
    most = max(RANKED, sum(total.values()) // PARTS)
    parts = {n: -(-c // most) for n, c in total.items()}
    split = rows.sparkSession.createDataFrame(list(parts.items()), "length long, _parts int")
    short = short.join(F.broadcast(split), "length").withColumn("b", F.pmod(F.xxhash64(KEY, "start"), "_parts").cast("int"))
    before = {n: np.zeros(k + 1, np.int64) for n, k in parts.items()}
    for r in short.groupBy("length", "b").count().collect():  # at most a row per length and PARTS more
        before[r["length"]][r["b"] + 1] = r["count"]
    for x in before.values():
        np.cumsum(x, out=x)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Ranks within (length, bucket), whose rows are together and in order; a place for each rank."""
        last, seen = -1, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            length, b = (batch.column(c).to_numpy().astype(np.int64) for c in ("length", "b"))
            mine = length << 32 | b
            rank = np.arange(len(mine))
            head = runs(mine)
            rank -= np.repeat(head, np.diff(np.r_[head, len(mine)]))
            rank[mine == last] += seen
            last, seen = mine[-1], int(rank[-1]) + 1
            sequence, offset = np.empty(len(mine), np.int64), np.empty(len(mine), np.int64)
            head = runs(length)
            for i, j in zip(head, np.r_[head[1:], len(length)], strict=True):
                first, start, at = place[int(length[i])]
                k = before[int(length[i])][b[i:j]] + rank[i:j]
                x = np.searchsorted(first, k, "right") - 1
                sequence[i:j], offset[i:j] = start[x] + k - first[x], at[x]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in FIELDS), pa.array(sequence), pa.array(offset)], names=[*FIELDS, "sequence_id", "offset"])

    columns = "_key long, start long, length long, ids_crc32 long, doc_tokens long, ids binary, sequence_id long, offset long"
    dealt = short.select(*FIELDS, "b").repartition("length", "b").sortWithinPartitions("length", "b", KEY, "start")
    whole = pieces.filter(F.col("length") == size)
    whole = whole.select(*FIELDS, (F.monotonically_increasing_id() + found.sequences()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return named(rows, dealt.mapInArrow(assign, columns).union(whole))


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


CONTRACT = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    out = pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_vocabulary(), ids=False)
    return out.select(F.col("_id").alias("doc_id"), *CONTRACT)
