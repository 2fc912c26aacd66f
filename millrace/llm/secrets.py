"""Secret scans: fixed patterns, and a character convolutional network over every other candidate.

The patterns give the base spans. Every other token of ``TOKEN`` with a digit
or with letters of both cases is a candidate; the network reads the token and
its surroundings: 32 characters before, 64 of the token and 16 after them. A
longer token is read through several such windows, each 32 on from the last,
and has the highest of their probabilities. Each part has its own pooled
features of one convolution. The network is plain numpy.

It learns on the driver from labelled findings: base spans and other tokens of
a bounded sample of documents (``sample`` rows, ``per_text`` tokens of each),
and made-up findings and harmless look-alikes of known formats. A held-back
fifth calibrates the logits (a logistic fit) and sets the threshold: the
highest that keeps a recall of ``RECALL`` among its findings, whatever it is,
but for the look-alikes: where findings and these are apart, it lies between.
Then all base spans of all whole texts are scored, and where the threshold
keeps fewer than ``RECALL`` of these, it is lowered until it does. So the
weights and the calibration come from the sample, the recall from every row.

Spans are code points, end exclusive, as ``kind:start:end``. Texts are scanned
whole, one pass, no shuffle.

Defined results: a null text is empty and has no span; rows keep any id, null
or repeated; an empty table gives an empty result; other columns do not matter.
"""

from __future__ import annotations

import bisect
import itertools
import random
import re
import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .toxicity import logistic

KINDS = ("assign", "access", "hex", "model")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")  # whole runs, so shorter ones are no match
HEX = re.compile(r"[0-9a-f]{24,}")
STARTS = ("password", "passwd", "secret", "token", "apikey", "api_key")
TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{8,}")
BEFORE, INSIDE, AFTER, STEP = 32, 64, 16, 32
WIDTH, EMBED, FILTERS = 5, 8, 16
SAMPLE, PER_TEXT, MADE, RECALL = 2000, 8, 3000, 0.95
AT_ONCE = 4096  #: candidates whose windows are held together
TOP, STEPS = 40, 50  #: calibrated logits are cut off at +-TOP and counted in steps of 1 / STEPS


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the pattern matches, in order."""
    out = []
    low = text.lower()
    if any(s in low for s in STARTS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def free(spans: Iterator[re.Match], base: list[tuple[int, int, int]]) -> Iterator[re.Match]:
    """Those of the matches, which are in order, that overlap no base span."""
    taken = sorted((a, b) for a, _, b in base)
    starts, until = [a for a, _ in taken], [0, *itertools.accumulate((b for _, b in taken), max)]
    return (m for m in spans if until[bisect.bisect_left(starts, m.end())] <= m.start())


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Other tokens that may be secrets; none overlaps a base span."""
    out = []
    for m in free(TOKEN.finditer(text), base):
        t = m[0]
        if any(c in string.digits for c in t) or (not t.islower() and not t.isupper() and not t[1:].islower()):
            out.append((m.start(), m.end()))
    return out


def windows(text: str, start: int, end: int) -> list[bytes]:
    """Character codes of the three parts, 0 for padding and 1 for other scripts; several windows for a long token."""
    out = []
    for at in range(start, max(end - INSIDE, start) + STEP, STEP) if end - start > INSIDE else (start,):
        until = min(end, at + INSIDE)
        x = text[max(0, at - BEFORE) : at].rjust(BEFORE, "\0") + text[at:until].ljust(INSIDE, "\0") + text[until : until + AFTER].ljust(AFTER, "\0")
        out.append(x.encode("latin-1", "replace"))
    return out


def window(text: str, start: int, end: int) -> bytes:
    return windows(text, start, end)[0]


def codes(windows: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(windows), np.uint8).reshape(len(windows), BEFORE + INSIDE + AFTER).astype(np.int64)
    return np.where(x == 0, 0, np.where((x >= 32) & (x < 127), x - 30, 1))


SYMBOLS = 97
PARTS = ((0, BEFORE), (BEFORE, BEFORE + INSIDE), (BEFORE + INSIDE, BEFORE + INSIDE + AFTER))


@dataclass
class Network:
    """Embedding, one convolution with a maximum and a mean per part, one logistic unit; the calibration and the threshold."""

    embed: np.ndarray
    kernel: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    shift: float
    slope: float = 1.0
    offset: float = 0.0
    threshold: float = 0.5

    def _forward(self, x: np.ndarray):
        e = self.embed[x]
        n = len(x)
        cols = np.lib.stride_tricks.sliding_window_view(np.pad(e, ((0, 0), (WIDTH // 2, WIDTH // 2), (0, 0))), WIDTH, axis=1)
        cols = cols.transpose(0, 1, 3, 2).reshape(n, x.shape[1], WIDTH * EMBED)
        h = np.maximum(cols @ self.kernel + self.bias, 0)
        top = [h[:, a:b].argmax(1) + a for a, b in PARTS]
        pooled = [np.take_along_axis(h, t[:, None, :], 1)[:, 0] for t in top] + [h[:, a:b].mean(1) for a, b in PARTS]
        return cols, h, top, np.concatenate(pooled, 1)

    def logits(self, x: np.ndarray) -> np.ndarray:
        return self._forward(x)[3] @ self.out + self.shift

    def calibrated(self, x: np.ndarray) -> np.ndarray:
        parts = [self.logits(x[i : i + 256]) for i in range(0, len(x), 256)]
        z = np.concatenate(parts) if parts else np.zeros(0)
        return np.clip(self.slope * z + self.offset, -TOP, TOP)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.calibrated(x)))

    def highest(self, read: list[list[bytes]]) -> np.ndarray:
        """The highest calibrated logit of each token's windows."""
        if not read:
            return np.zeros(0)
        return np.maximum.reduceat(self.calibrated(codes(list(itertools.chain.from_iterable(read)))), np.cumsum([0, *map(len, read[:-1])]))


def fit(x: np.ndarray, y: np.ndarray, passes: int = 6, batch: int = 64, rate: float = 0.01, seed: int = 1) -> Network:
    """Adam on the log loss of four fifths; the rest calibrates."""
    rnd = np.random.default_rng(seed)
    net = Network(rnd.normal(0, 0.3, (SYMBOLS, EMBED)), rnd.normal(0, (2 / (WIDTH * EMBED)) ** 0.5, (WIDTH * EMBED, FILTERS)), np.zeros(FILTERS), rnd.normal(0, 0.1, 6 * FILTERS), 0.0)
    back = np.arange(len(x)) % 5 == 4
    tx, ty = x[~back], y[~back]
    names = ("embed", "kernel", "bias", "out")
    m, v, step = {k: 0.0 for k in (*names, "shift")}, {k: 0.0 for k in (*names, "shift")}, 0
    weigh = np.where(ty == 1, 0.5 / max(ty.mean(), 1e-9), 0.5 / max(1 - ty.mean(), 1e-9))
    for _ in range(passes):
        order = rnd.permutation(len(tx))
        for at in range(0, len(order), batch):
            i = order[at : at + batch]
            cols, h, top, f = net._forward(tx[i])
            d = (1 / (1 + np.exp(-np.clip(f @ net.out + net.shift, -30, 30))) - ty[i]) * weigh[i] / len(i)
            df = d[:, None] * net.out
            dh = np.zeros_like(h)
            for p, (a, b) in enumerate(PARTS):
                np.put_along_axis(dh, top[p][:, None, :], np.take_along_axis(dh, top[p][:, None, :], 1) + df[:, None, p * FILTERS : (p + 1) * FILTERS], 1)
                dh[:, a:b] += df[:, None, (3 + p) * FILTERS : (4 + p) * FILTERS] / (b - a)
            dh *= h > 0
            g = {"out": f.T @ d, "shift": d.sum(), "bias": dh.sum((0, 1)), "kernel": np.einsum("ntc,ntf->cf", cols, dh, optimize=True)}
            dc = (dh @ net.kernel.T).reshape(len(i), x.shape[1], WIDTH, EMBED)
            de = np.zeros((len(i), x.shape[1] + WIDTH - 1, EMBED))
            for w in range(WIDTH):
                de[:, w : w + x.shape[1]] += dc[:, :, w]
            g["embed"] = np.zeros_like(net.embed)
            np.add.at(g["embed"], tx[i], de[:, WIDTH // 2 : WIDTH // 2 + x.shape[1]])
            step += 1
            for k, grad in g.items():
                m[k] = 0.9 * m[k] + 0.1 * grad
                v[k] = 0.999 * v[k] + 0.001 * grad * grad
                setattr(net, k, getattr(net, k) - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8))
    hx, hy = x[back], y[back]
    if len(np.unique(hy)) == 2:
        net.slope, net.offset = logistic(net.logits(hx), hy)
        found = np.sort(net.probability(hx)[hy == 1])
        least = found[int(np.floor((1 - RECALL) * len(found)))]
        below = net.probability(hx)[hy == 0]
        below = below[below < least].max(initial=0.0)
        net.threshold = float((least + below) / 2 if below < 0.5 < least else least)
    return net


def made_up(n: int, seed: int = 4) -> list[tuple[bytes, int]]:
    """Labelled findings of known formats, and harmless tokens that look alike, amid random words."""
    rnd = random.Random(seed)
    pick = lambda s, k: "".join(rnd.choice(s) for _ in range(k))
    low, up, num = string.ascii_lowercase, string.ascii_uppercase, string.digits
    mixed, hexa = low + up + num, num + "abcdef"
    secrets = (
        lambda: "ghp_" + pick(mixed, 36), lambda: "sk_live_" + pick(mixed, 24), lambda: "xoxb-" + pick(num, 12) + "-" + pick(mixed, 24), lambda: "AIza" + pick(mixed + "_-", 35),
        lambda: pick(mixed + "+/", 40), lambda: "eyJ" + pick(mixed, 30) + "=", lambda: pick(hexa.upper(), 32), lambda: "glpat-" + pick(mixed + "_-", 20), lambda: "key-" + pick(hexa, 32),
    )
    harmless = (
        lambda: "-".join(pick(hexa, k) for k in (8, 4, 4, 4, 12)), lambda: f"{pick(low, 6)}/{pick(low, 7)}/{pick(low, 5)}-{pick(num, 2)}", lambda: pick(num, rnd.randint(16, 19)), lambda: f"20{pick(num, 2)}-0{rnd.randint(1, 9)}-1{pick(num, 1)}T10-{pick(num, 2)}-{pick(num, 2)}",
        lambda: "".join(pick(low, rnd.randint(3, 7)).capitalize() for _ in range(4)), lambda: "_".join(pick(low, rnd.randint(3, 8)) for _ in range(4)) + pick(num, 1), lambda: pick(low, rnd.randint(16, 24)) + pick(num, 1), lambda: "=" * rnd.randint(8, 20) + pick(num, 3) + "-" * 9,
        lambda: pick(low, 9).capitalize() + "-" + pick(low, 9).capitalize(),
    )
    words = lambda k: " ".join(pick(low, rnd.randint(1, 9)) for _ in range(k))
    leads = ("", "key ", "auth: ", "Authorization: Bearer ", "credential=", "use ", "export KEY=", "pwd: ")
    out = []
    for i in range(n):
        y = i % 2
        t = rnd.choice(secrets if y else harmless)()
        before = words(6) + " " + (rnd.choice(leads) if y or rnd.random() < 0.1 else "")
        text = before + t + " " + words(4)
        out.append((window(text, len(before), len(before) + len(t)), y))
    return out


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, per_text: int = PER_TEXT, made: int = MADE) -> Network:
    rows = docs.filter(F.col(text_col).isNotNull())
    n = max(rows.count(), 1)
    draw = F.pmod(F.xxhash64(F.lit(19), F.col(id_col).cast("string")), F.lit(1 << 30))
    some = rows.filter(draw < int(min(1.0, sample / n) * (1 << 30))).select(draw.alias("draw"), F.col(text_col).cast("string").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for d, t in zip(batch.column("draw").to_pylist(), batch.column("t").to_pylist(), strict=True):
                base = base_spans(t)
                out += [(d, window(t, a, b), 1) for a, _, b in base[:per_text]]
                other = candidates(t, base)[:per_text] + [m.span() for m in itertools.islice(free(re.finditer(r"\S{8,}", t), base), 2)]
                out += [(d, window(t, a, b), 0) for a, b in other]
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.binary()), pa.array([o[2] for o in out], pa.int32())], names=["draw", "w", "y"])

    got = sorted((r["draw"], r["w"], r["y"]) for r in some.mapInArrow(run, "draw long, w binary, y int").toLocalIterator())
    both = [(bytes(w), y) for _, w, y in got] + made_up(made)
    random.Random(2).shuffle(both)
    return settled(docs, fit(codes([w for w, _ in both]), np.array([y for _, y in both], float)), text_col)


def settled(docs: DataFrame, net: Network, text_col: str = "text") -> Network:
    """``net``, its threshold lowered until it keeps ``RECALL`` of the base spans of all whole texts.

    They are counted by their calibrated logits, so the threshold lies up to a
    step below the highest that does; without base spans it stays.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, read = np.zeros(2 * TOP * STEPS + 1, np.int64), []
        for batch in batches:
            for t in batch.column("t"):
                text = t.as_py() or ""
                for a, _, b in base_spans(text):
                    read.append(windows(text, a, b))
                    if len(read) == AT_ONCE:
                        counts += _steps(net.highest(read))
                        read = []
        counts += _steps(net.highest(read))
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], names=["step", "n"])

    found = docs.select(F.col(text_col).cast("string").alias("t")).mapInArrow(run, "step long, n long")
    found = sorted((x["step"], x["n"]) for x in found.groupBy("step").agg(F.sum("n").alias("n")).collect())  # a row per step
    below, allowed = 0, int((1 - RECALL) * sum(n for _, n in found))
    for step, n in found:
        below += n
        if below > allowed:
            net.threshold = min(net.threshold, float(1 / (1 + np.exp(TOP - step / STEPS + 1e-9))))
            break
    return net


def _steps(logits: np.ndarray) -> np.ndarray:
    return np.bincount(np.floor((logits + TOP) * STEPS).astype(np.int64), minlength=2 * TOP * STEPS + 1)


def scan(docs: DataFrame, net: Network | None, text_col: str = "text", keep: dict | None = None) -> DataFrame:
    """The columns of ``keep`` and ``found``: (kind, start, end, surface) of every span, base ones first at equal starts."""
    keep = keep if keep is not None else {c: F.col(c) for c in docs.columns}
    names = list(keep)
    rows = docs.select(*[v.alias(k) for k, v in keep.items()], F.col(text_col).cast("string").alias("_scan_text"))
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("surface", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, ask = [], []
            texts = [t.as_py() or "" for t in batch.column("_scan_text")]
            for i, t in enumerate(texts):
                base = base_spans(t)
                found.append(base)
                if net is not None:
                    ask += [(i, a, b) for a, b in candidates(t, base)]
            for at in range(0, len(ask), AT_ONCE):
                some = ask[at : at + AT_ONCE]
                read = [windows(texts[i], a, b) for i, a, b in some]
                for (i, a, b), q in zip(some, 1 / (1 + np.exp(-net.highest(read))), strict=True):
                    if q >= net.threshold:
                        found[i].append((a, 3, b))
            out = [[{"kind": KINDS[k], "start": a, "end": b, "surface": t[a:b]} for a, k, b in sorted(f)] for f, t in zip(found, texts, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(out, kind)], names=[*names, "found"])

    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in names) + ", found array<struct<kind:string,start:int,end:int,surface:string>>")


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_model."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = scan(docs, train(docs), keep={"doc_id": F.col("doc_id")})
    count = lambda k: F.size(F.filter("found", lambda s: s["kind"] == k)).cast("long")
    joined = lambda x: F.array_join(F.transform(x, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("found", lambda s: s["kind"] != "model")
    return found.select("doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"), count("model").alias("n_model"))
