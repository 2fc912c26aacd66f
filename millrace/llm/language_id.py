"""Language ID by error-correcting output codes.

Every language has a codeword of +1 and -1 bits; a logistic classifier over
hashed character 1- to 4-grams predicts each bit. Decoding sums a loss for
every bit, weighted by how well that bit's classifier did on held-back rows,
and takes the nearest codeword. The score is the softmax of the negative
losses; a row is ambiguous where the runner-up is close.

The classifiers are fitted on the driver from a bounded sample of labelled
rows: about ``per_language`` rows of every language, fewer where that would be
more than ``most_rows`` in all, but never fewer than ``FEWEST``. Which rows those are follows from their ids
alone. Texts are scored whole, one pass, no shuffle.

Defined results: a text that is null or holds no letter is ``und`` with score
0; rows keep their order and any id, null or repeated; no labelled rows give
``und`` for all; an empty table gives an empty result; other columns do not
matter, those named like a result give way to it.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._kernel import lowered
from ._spark import TEXT, slices

BUCKETS = 1 << 12
ORDERS = (1, 2, 3, 4)
PER_LANGUAGE, MOST_ROWS, FEWEST = 1000, 20_000, 20
RESULTS = ("lang_pred", "score", "ambiguous")
UND = "und"
LETTERS = r"\p{L}"


def ngram_counts(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """(rows, BUCKETS) float32: hashed n-gram counts as square roots, each row of length 1.

    Bytes of other kinds than letters become one blank; n-grams across rows
    are left out.
    """
    n = len(offs) - 1
    x = lowered(data)
    blank = (x < 97) | ((x > 122) & (x < 128))
    x = np.where(blank, np.uint8(32), x).astype(np.uint32)
    row = np.repeat(np.arange(n), np.diff(offs))
    out = np.zeros((n, BUCKETS), np.float32)
    flat = np.zeros(n * BUCKETS, np.int64)
    h = np.zeros(len(x), np.uint32)
    for order in ORDERS:
        if len(x) < order:
            break
        h = h[: len(x) - order + 1] * np.uint32(0x01000193) + (x[order - 1 :] + np.uint32(1)) * np.uint32(0x9E3779B1)
        inside = row[: len(h)] == row[order - 1 :]
        slot = ((h ^ np.uint32(order * 0x05EBCA6B)) * np.uint32(0xC2B2AE35)) >> np.uint32(20)
        keep = inside if order > 1 else inside & (x != 32)
        flat += np.bincount(row[: len(h)][keep] * BUCKETS + slot[keep], minlength=n * BUCKETS)
    out = np.sqrt(flat.reshape(n, BUCKETS).astype(np.float32))
    return out / np.maximum(np.sqrt((out * out).sum(1, keepdims=True)), 1e-9)


def codewords(k: int, seed: int = 7) -> np.ndarray:
    """(k, bits) of +1 and -1: all splits up to 7 languages, else random columns with distant rows."""
    if k <= 2:
        return np.array([[1.0], [-1.0]])[:k]
    if k <= 7:
        cols = [c for c in itertools.product((1.0, -1.0), repeat=k) if c[0] > 0 and -1.0 in c]
        return np.array(cols).T
    bits, rnd, best = 4 * int(np.ceil(np.log2(k))) + 7, np.random.default_rng(seed), (-1, None)
    for _ in range(200):
        c = rnd.choice((1.0, -1.0), (k, bits))
        far = min(int((c[i] != c[i + 1 :]).sum(1).min()) for i in range(k - 1))
        if far > best[0] and (np.abs(c.sum(0)) < k).all():
            best = far, c
    return best[1]


@dataclass
class Model:
    """Weights of the bit classifiers, the codewords, each bit's weight in decoding and the softmax's slope."""

    languages: list[str]
    weights: np.ndarray
    bias: np.ndarray
    codes: np.ndarray
    trust: np.ndarray
    slope: float

    def losses(self, x: np.ndarray) -> np.ndarray:
        """(rows, languages): the weighted logistic loss against each codeword."""
        margin = x @ self.weights + self.bias
        near, far = np.logaddexp(0, -margin), np.logaddexp(0, margin)
        return (near * self.trust) @ (self.codes > 0).T + (far * self.trust) @ (self.codes < 0).T

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(language, probability, runner-up's probability)."""
        z = -self.losses(x) * self.slope
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        best = p.argmax(1)
        top = p[np.arange(len(p)), best]
        p[np.arange(len(p)), best] = 0
        return best, top, p.max(1)


def fit(x: np.ndarray, y: np.ndarray, languages: list[str], rounds: int = 300, rate: float = 20.0, ridge: float = 1e-5) -> Model:
    """Full-batch gradient steps with momentum; a fifth of the rows weighs the bits and sets the slope."""
    codes = codewords(len(languages))
    back = np.arange(len(x)) % 5 == 4
    if back.all() or not back.any() or len(np.unique(y[~back])) < len(languages):
        back[:] = False
    tx, t = x[~back], codes[y[~back]].astype(np.float32)
    share = np.bincount(y[~back], minlength=len(languages))
    each = (len(tx) / np.maximum(share, 1) / len(languages))[y[~back]].astype(np.float32)[:, None]
    w, b = np.zeros((x.shape[1], t.shape[1]), np.float32), np.zeros(t.shape[1], np.float32)
    vw, vb = np.zeros_like(w), np.zeros_like(b)
    for _ in range(rounds):
        g = -t / (1 + np.exp(np.clip(t * (tx @ w + b), -30, 30))) * each / len(tx)
        vw = 0.9 * vw - rate * 0.1 * (tx.T @ g + ridge * w)
        vb = 0.9 * vb - rate * 0.1 * g.sum(0)
        w, b = w + vw, b + vb
    vx, vy = (x[back], y[back]) if back.any() else (x, y)
    right = ((vx @ w + b) * codes[vy] > 0).mean(0)
    trust = np.maximum(np.log((right + 0.01) / (1.01 - right)), 0.05)
    model = Model(languages, w, b, codes, trust / trust.sum() * len(trust), 1.0)
    losses = model.losses(vx)
    def cost(s: float) -> float:
        z = -losses * s
        return float((np.logaddexp.reduce(z, axis=1) - z[np.arange(len(vy)), vy]).mean())

    model.slope = min((0.25, 0.5, 1.0, 2.0, 4.0, 8.0), key=cost)
    return model


def train(
    labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE, most_rows: int = MOST_ROWS
) -> Model | None:
    """A model of the labelled rows, from about ``per_language`` rows of each language and ``most_rows`` in all."""
    rows = labelled.filter(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    counts = rows.groupBy(F.col(lang_col).alias("lang")).count().collect()  # a row per language
    if not counts:
        return None
    each = max(FEWEST, min(per_language, most_rows // len(counts)))
    shares = [(r["lang"], int(min(1.0, each / r["count"]) * (1 << 30)) + 1) for r in counts]
    share = rows.sparkSession.createDataFrame(shares, "lang string, share long")
    draw = F.pmod(F.xxhash64(F.lit(11), F.col(id_col).cast("string")), F.lit(1 << 30)).alias("draw")
    sample = rows.select(draw, F.col(text_col).alias(TEXT), F.col(lang_col).alias("lang")).join(F.broadcast(share), "lang").filter("draw < share")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in slices(batch, key=None, limit=1 << 18):
                for i, j in _rows(len(s)):
                    part = batch.slice(s.rows.start + i, j - i)
                    x = ngram_counts(s.data[s.offs[i] : s.offs[j]], s.offs[i : j + 1] - s.offs[i])
                    x = np.minimum(np.round(x * 1024), 65535).astype("<u2")
                    yield pa.RecordBatch.from_arrays([part.column("lang"), part.column("draw"), pa.array([r.tobytes() for r in x], pa.binary())], names=["lang", "draw", "x"])

    got = sample.select("lang", "draw", TEXT).mapInArrow(features, "lang string, draw long, x binary").toLocalIterator()
    got = sorted((r["lang"], r["draw"], r["x"]) for r in got)
    if not got:
        return None
    languages = sorted({g[0] for g in got})
    place = {v: i for i, v in enumerate(languages)}
    y = np.array([place[g[0]] for g in got])
    order = np.random.default_rng(5).permutation(len(y))
    x = np.empty((len(y), BUCKETS), np.float32)
    for i, k in enumerate(order):
        x[i] = np.frombuffer(got[k][2], "<u2")
    x /= 1024
    return fit(x, y[order], languages)


def identify(docs: DataFrame, model: Model | None, text_col: str = "text", keep: dict[str, Column] | None = None, margin: float = 0.2) -> DataFrame:
    """The columns of ``keep`` and lang_pred, score, ambiguous for every row."""
    keep = keep if keep is not None else {c: F.col(f"`{c}`") for c in docs.columns if c not in RESULTS}
    names = list(keep)
    rows = docs.select(*[v.alias(k) for k, v in keep.items()], F.col(text_col).cast("string").alias("_lid_text"), F.coalesce(F.col(text_col).rlike(LETTERS), F.lit(False)).alias("_lid_any"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            letters = batch.column("_lid_any").to_numpy(zero_copy_only=False)
            for s in slices(batch, "_lid_text", None, 1 << 18):
                some = letters[s.rows]
                if model is None:
                    lang, top, close = [UND] * len(s), np.zeros(len(s)), np.ones(len(s), bool)
                else:
                    parts = [model.decode(ngram_counts(s.data[s.offs[i] : s.offs[j]], s.offs[i : j + 1] - s.offs[i])) for i, j in _rows(len(s))]
                    best, top, second = (np.concatenate(p) for p in zip(*parts, strict=True))
                    close = ~some | (top - second < margin)
                    lang = [model.languages[b] if ok else UND for b, ok in zip(best, some, strict=True)]
                    top = np.where(some, top, 0.0)
                part = batch.slice(s.rows.start, len(s))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(lang, pa.string()), pa.array(top, pa.float64()), pa.array(close)], names=[*names, "lang_pred", "score", "ambiguous"])

    results = T.StructType.fromDDL("lang_pred string, score double, ambiguous boolean")
    return rows.mapInArrow(run, T.StructType([*(rows.schema[c] for c in names), *results.fields]))


def _rows(n: int, most: int = 256) -> list[tuple[int, int]]:
    return [(i, min(i + most, n)) for i in range(0, n, most)]


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that no model may learn from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score, ambiguous."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs.filter(~held_out()))
    return identify(docs, model, keep={"doc_id": F.col("doc_id"), "held_out": held_out()})
