"""Toxicity by FTRL-proximal logistic regression over hashed word features.

Features of a text: words, their first four, six and eight bytes (stems), word
pairs and pairs with one word between (skip-grams), hashed to ``1 << bits``
slots. Each feature counts once per text; the per-coordinate rates and the L1 term of FTRL-proximal
leave most weights at zero, so what is sent to the executors is a short sparse
list.

The model is fitted on the driver in one order of a bounded sample of labelled
rows (``most_rows``); the slope and shift of the final logistic are fitted on
logits that each fold of them gets from the other folds.

Defined results: null and empty texts get the score of no evidence; any id,
null or repeated, keeps its row; no labelled row gives score 0 for all; an
empty table gives an empty result; other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._kernel import Spans, lowered, mix, words
from ._spark import TEXT, slices
from .language_id import held_out

BITS = 20
MOST_ROWS = 12_000
STEMS = (4, 6, 8)
FOLDS, CUT, BETA = 3, 0.7, 2.0


def features(data: np.ndarray, offs: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(row, slot) of every feature occurrence."""
    x = lowered(data)
    start, end, row = words(x, offs)
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    spans = Spans(x)
    h = spans(start, end)
    stems = [mix(spans(start, np.minimum(end, start + n)) + np.uint64(n)) for n in STEMS]
    parts, rows = [h, *stems], [row] * (1 + len(stems))
    for gap in (1, 2):
        if len(h) > gap:
            same = row[gap:] == row[:-gap]
            parts.append(mix(h[:-gap] * np.uint64(3) + h[gap:] + np.uint64(gap))[same])
            rows.append(row[gap:][same])
    slot = (np.concatenate(parts) >> np.uint64(64 - bits)).astype(np.int64)
    return np.concatenate(rows), slot


@dataclass
class Model:
    """The nonzero weights, as (slots, values), and the final logistic."""

    slots: np.ndarray
    values: np.ndarray
    slope: float
    shift: float
    bits: int = BITS

    def table(self) -> np.ndarray:
        out = np.zeros(1 << self.bits, np.float32)
        out[self.slots] = self.values
        return out

    def logits(self, row: np.ndarray, slot: np.ndarray, n: int, table: np.ndarray) -> np.ndarray:
        """Per row, the sum of the weights of its distinct features."""
        w = table[slot]
        told = np.flatnonzero(w)
        both = np.unique(row[told] << self.bits | slot[told])
        return np.bincount(both >> self.bits, table[both & ((1 << self.bits) - 1)], minlength=n)

    def score(self, logit: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * logit + self.shift, -40, 40)))


def ftrl(rows: list[np.ndarray], y: np.ndarray, bits: int, alpha: float = 0.3, beta: float = 1.0, l1: float | None = None, l2: float = 1.0, passes: int = 4, seed: int = 3) -> np.ndarray:
    """The weights after ``passes`` over the rows, each an array of distinct slots; classes weigh the same.

    ``l1`` follows the root of the number of rows, up to 15.
    """
    l1 = min(15.0, max(1.0, 0.27 * len(rows) ** 0.5)) if l1 is None else l1
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)
    bias_z = bias_n = 0.0
    rnd = np.random.default_rng(seed)
    weigh = np.where(y == 1, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
    for _ in range(passes):
        for i in rnd.permutation(len(rows)):
            f = rows[i]
            zf, nf = z[f], n[f]
            w = np.where(np.abs(zf) <= l1, 0.0, -(zf - np.sign(zf) * l1) / ((beta + np.sqrt(nf)) / alpha + l2))
            bias = -bias_z / ((beta + np.sqrt(bias_n)) / alpha)
            g = (1 / (1 + np.exp(-np.clip(bias + w.sum(), -30, 30))) - y[i]) * weigh[i]
            z[f] += g - (np.sqrt(nf + g * g) - np.sqrt(nf)) / alpha * w
            n[f] += g * g
            bias_z += g - (np.sqrt(bias_n + g * g) - np.sqrt(bias_n)) / alpha * bias
            bias_n += g * g
    return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, float]:
    """Slope and shift of a one-variable logistic regression with balanced classes, by Newton steps."""
    c = np.where(y == 1, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
    t = np.zeros(2)
    a = np.stack([x, np.ones_like(x)], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ t, -30, 30)))
        grad = a.T @ (c * (p - y)) + ridge * t
        hess = (a * (c * p * (1 - p))[:, None]).T @ a + ridge * np.eye(2)
        step = np.linalg.solve(hess, grad)
        t -= step
        if np.abs(step).max() < 1e-6:
            break
    return float(t[0]), float(t[1])


def boundary(x: np.ndarray, y: np.ndarray, beta: float = BETA) -> float:
    """The middle of the logits between which a cut has the best F-beta: a missed row weighs more than a wrong one."""
    order = np.argsort(-x, kind="stable")
    hits = np.cumsum(y[order])
    f = (1 + beta * beta) * hits / (np.arange(1, len(x) + 1) + beta * beta * y.sum())
    ends = np.r_[x[order][1:] < x[order][:-1], True]  # cuts lie between different logits
    best = int(np.flatnonzero(ends & (f >= f[ends].max() - 1e-12))[0])
    low = x[order][best + 1] if best + 1 < len(x) else x[order][best] - 1
    return float((x[order][best] + low) / 2)


def fit(rows: list[np.ndarray], y: np.ndarray, bits: int = BITS, folds: int = FOLDS) -> Model:
    """Weights from all rows; the final logistic from the logits that each fold gets from the others.

    Its slope is a logistic fit, its shift puts the cut of best F2 at ``CUT``.
    """
    x = np.zeros(len(rows))
    for k in range(folds):
        out = np.arange(len(rows)) % folds == k
        if out.all() or not out.any():
            continue
        w = ftrl([r for r, o in zip(rows, out, strict=True) if not o], y[~out], bits)
        x[out] = [w[r].sum() for r, o in zip(rows, out, strict=True) if o]
    slope, shift = 1.0, 0.0
    if len(np.unique(y)) == 2:
        slope = max(logistic(x, y)[0], 1e-3)
        shift = float(np.log(CUT / (1 - CUT))) - slope * boundary(x, y)
    w = ftrl(rows, y, bits)
    slots = np.flatnonzero(w)
    return Model(slots, w[slots].astype(np.float32), slope, shift, bits)


def train(labelled: DataFrame, id_col: str, text_col: str, label_col: str, most_rows: int = MOST_ROWS, bits: int = BITS) -> Model | None:
    """A model from about ``most_rows`` labelled rows, those with the smallest hashed ids."""
    rows = labelled.filter(F.col(label_col).isin(0, 1) & F.col(text_col).isNotNull())
    n = rows.count()
    if not n:
        return None
    draw = F.pmod(F.xxhash64(F.lit(13), F.col(id_col).cast("string")), F.lit(1 << 30))
    sample = rows.filter(draw <= int(min(1.0, most_rows / n) * (1 << 30))).select(draw.alias("draw"), F.col(text_col).alias(TEXT), F.col(label_col).cast("int").alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in slices(batch, key=None):
                row, slot = features(s.data, s.offs, bits)
                both = np.unique(row * (1 << bits) + slot)
                cut = np.searchsorted(both, np.arange(1, len(s)) * (1 << bits))
                each = [(x & ((1 << bits) - 1)).astype("<u4").tobytes() for x in np.split(both, cut)]
                part = batch.slice(s.rows.start, len(s))
                yield pa.RecordBatch.from_arrays([part.column("draw"), part.column("y"), pa.array(each, pa.binary())], names=["draw", "y", "f"])

    got = sorted(((r["draw"], r["y"], r["f"]) for r in sample.mapInArrow(run, "draw long, y int, f binary").toLocalIterator()))
    return fit([np.frombuffer(f, "<u4").astype(np.int64) for _, _, f in got], np.array([y for _, y, _ in got], float), bits)


def scored(docs: DataFrame, model: Model | None, text_col: str, keep: dict) -> DataFrame:
    """The columns of ``keep`` and a score of every row's whole text."""
    rows = docs.select(*[v.alias(k) for k, v in keep.items()], F.col(text_col).cast("string").alias("_tox_text"))
    names = list(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = model.table() if model else None
        for batch in batches:
            for s in slices(batch, "_tox_text", None):
                if model is None:
                    score = np.zeros(len(s))
                else:
                    row, slot = features(s.data, s.offs, model.bits)
                    score = model.score(model.logits(row, slot, len(s), table))
                part = batch.slice(s.rows.start, len(s))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(score)], names=[*names, "score"])

    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in names) + ", score double")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted (score >= 0.7)."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").alias("_label_id"), "toxic")
    learn = docs.filter(~held_out()).select("doc_id", "text").join(labels, F.col("doc_id") == F.col("_label_id"))
    model = train(learn, "doc_id", "text", "toxic")
    out = scored(docs, model, "text", {"doc_id": F.col("doc_id"), "held_out": held_out()})
    return out.withColumn("predicted", (F.col("score") >= CUT).cast("int"))
