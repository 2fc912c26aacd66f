"""Embedding near-dedup by cross-polytope hashing.

Vectors are padded to a power of two, flipped by random signs and rotated by
fast Hadamard transforms, three times over. The hash is the nearest vertex of
the cross-polytope: the coordinate of largest magnitude and its sign. A table
joins ``per_table`` of them to one code; besides its own bucket a vector probes
those where one hash takes its runner-up. All members of a bucket are compared
with the bucket's own members and probing visitors in blocks; each pair that
meets is verified by cosine in double precision.

Equal vectors collapse first, so a vector with a million copies is compared
once. Buckets of more than ``block`` rows are dealt over several tasks, block
against block. A pair that meets in several buckets counts in the first only,
which either side can tell from the codes of both. A task emits, per vector, how
many it is linked to and the smallest it reaches there, never the pairs of a
group.

Defined results: a vector that is null, empty, zero, or holds null or
non-finite components, or one of another length than most, is linked only with
none; rows with null or repeated ids are vectors of their own, nulls first;
an empty table gives an empty result; other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._kernel import runs
from ._spark import KEY, checkpoint, numbered, stored
from .components import components
from .repeats import whole_groups

COSINE = 0.9
TABLES, PER_TABLE, PROBES, ROUNDS, BLOCK = 6, 2, 3, 3, 512


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of every row; the row length is a power of two."""
    n, d = x.shape
    size = 1
    while size < d:
        y = x.reshape(n, d // (2 * size), 2, size)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], 2).reshape(n, d)
        size *= 2
    return x


def codes(x: np.ndarray, tables: int = TABLES, per_table: int = PER_TABLE, probes: int = PROBES, seed: int = 17) -> np.ndarray:
    """(rows, tables, probes) bucket codes, a vector's own first, then by the loss of taking a runner-up."""
    n, d = x.shape
    size = 1 << max(1, (d - 1).bit_length())
    rnd = np.random.default_rng(seed)
    wide = np.zeros((n, size))
    wide[:, :d] = x
    out = np.zeros((n, tables, probes), np.int64)
    for t in range(tables):
        best, second, gap = [], [], []
        for _ in range(per_table):
            y = wide
            for _ in range(ROUNDS):
                y = hadamard(y * rnd.choice((1.0, -1.0), size)) / np.sqrt(size)
            m = np.abs(y)
            top = np.argpartition(-m, 1, axis=1)[:, :2]
            v = np.take_along_axis(m, top, 1)
            swap = v[:, 1] > v[:, 0]
            top[swap], v[swap] = top[swap][:, ::-1], v[swap][:, ::-1]
            vertex = 2 * top + (np.take_along_axis(y, top, 1) < 0)
            best.append(vertex[:, 0])
            second.append(vertex[:, 1])
            gap.append(v[:, 0] - v[:, 1])
        order = np.argsort(np.stack(gap, 1), axis=1)
        for p in range(min(probes, per_table + 1)):
            code = np.zeros(n, np.int64)
            for j in range(per_table):
                pick = best[j] if p == 0 else np.where(order[:, p - 1] == j, second[j], best[j])
                code = code * (2 * size) + pick
            out[:, t, p] = code
        out[:, t, per_table + 1 :] = out[:, t, :1]
    return out


def usable(lists: pa.Array, d: int) -> tuple[np.ndarray, np.ndarray]:
    """(mask, rows as doubles) of the vectors of d finite components that are not all zero."""
    lens = np.nan_to_num(pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(float), nan=-1).astype(int)
    fit = lens == d
    flat = lists.filter(pa.array(fit)).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(int(fit.sum()), d) if d else np.zeros((int(fit.sum()), 0))
    with np.errstate(all="ignore"):
        good = np.isfinite(x).all(1) & (x != 0).any(1) if d else np.zeros(len(x), bool)
    mask = fit.copy()
    mask[fit] = good
    return mask, x[good]


def units(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _coded(d: int, kind: str, tables: int, per_table: int, probes: int):
    """One row per vector and bucket it is in or probes: (bucket, own, key, copies, vector, codes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                batch = whole.slice(at, 2048)
                mask, x = usable(batch.column("v"), d)
                if not len(x):
                    continue
                key = batch.column(KEY).to_numpy()[mask]
                c = codes(units(x), tables, per_table, probes)
                flat = c.reshape(len(x), -1)
                table = np.repeat(np.arange(tables), probes)
                fresh = np.ones(flat.shape, bool)
                for p in range(1, probes):
                    fresh[:, p::probes] = np.all([c[:, :, p] != c[:, :, q] for q in range(p)], axis=0)
                row, col = np.nonzero(fresh)
                bucket = flat[row, col] * tables + table[col]
                raw = [v.tobytes() for v in x.astype(kind)]
                copies = batch.column("copies").to_numpy()[mask]
                code = [v.astype("<i4").tobytes() for v in flat]
                yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(col % probes == 0), pa.array(key[row]), pa.array(copies[row]), pa.array([raw[i] for i in row], pa.binary()), pa.array([code[i] for i in row], pa.binary())], names=["bucket", "own", KEY, "copies", "vector", "codes"])

    return run


def _meet(d: int, kind: str, tables: int, probes: int, cosine: float):
    """Within (bucket, i, j): own members of block i against all rows of block j; (key, links, smallest key reached)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, "task"):
            at = np.r_[runs(t.column("task").to_numpy()), t.num_rows]
            out: list[list[np.ndarray]] = [[], [], []]
            for a, b in zip(at[:-1], at[1:], strict=True):
                if b - a > 1:
                    for c, v in zip(out, _pairs(t.slice(a, b - a), d, kind, tables, probes, cosine), strict=True):
                        c.append(v)
            if out[0]:
                key, n, low = (np.concatenate(c) for c in out)
                yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(n, pa.int64()), pa.array(low, pa.int64())], names=[KEY, "n", "low"])

    return run


def _pairs(g: pa.RecordBatch, d: int, kind: str, tables: int, probes: int, cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    key, copies, bucket = (g.column(c).to_numpy() for c in (KEY, "copies", "bucket"))
    own, left, right = (g.column(c).to_numpy(zero_copy_only=False) for c in ("own", "left", "right"))
    x = units(np.frombuffer(b"".join(g.column("vector").to_pylist()), kind).reshape(len(key), d).astype(np.float64))
    c = np.frombuffer(b"".join(g.column("codes").to_pylist()), "<i4").reshape(len(key), tables, probes)
    p, q = np.flatnonzero(own & left), np.flatnonzero(right)
    near = x[p] @ x[q].T >= cosine
    i, j = np.nonzero(near)
    a, b = p[i], q[j]
    # own against own: each pair once; own against visitor: the visitor is the other
    keep = (key[a] != key[b]) & (~own[b] | (key[a] < key[b]))
    a, b = a[keep], b[keep]
    table = int(bucket[0] % tables)
    met = np.zeros(len(a), bool)
    for t in range(table):
        met |= (c[a, t, :1] == c[b, t]).any(1) | (c[b, t, :1] == c[a, t]).any(1)
    # both visit each other's bucket: the smaller code counts
    visitor = ~own[b]
    back = visitor & (c[b, table, :1] == c[a, table]).any(1)
    met |= back & (c[b, table, 0] < c[a, table, 0])
    a, b = a[~met], b[~met]
    who, other = np.r_[a, b], np.r_[b, a]
    order = np.argsort(who, kind="stable")
    who, other = who[order], other[order]
    head = runs(who)
    if not len(head):
        z = np.zeros(0, np.int64)
        return z, z, z
    low = key.copy()  # the smallest key that each row reaches within this task
    while True:
        new = np.minimum(low[who], low[other])
        if (new == low[who]).all():
            break
        np.minimum.at(low, who, new)
    return key[who[head]], np.add.reduceat(copies[other], head), low[who[head]]


def near_vectors(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE, tables: int = TABLES, per_table: int = PER_TABLE, probes: int = PROBES, block: int = BLOCK) -> DataFrame:
    """(_key, _id, n_links, component_key, kept) of each vector."""
    rows = table.select(F.col(id_col).alias("_id"), F.col(vector_col).cast("array<double>").alias("v"))
    n, named, distinct = rows.agg(F.count("*"), F.count("_id"), F.countDistinct("_id")).first()
    if n == named == distinct and dict(rows.dtypes)["_id"] in ("bigint", "int"):
        rows = rows.select(F.col("_id").cast("long").alias(KEY), "_id", "v")
    else:
        rows = numbered(rows, [F.col("_id").asc_nulls_first(), F.xxhash64("v"), F.col("v").cast("string")])
    size = rows.filter("v IS NOT NULL AND size(v) > 0").groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    d = size["d"] if size else 1
    whole = F.coalesce((F.size("v") == d) & F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != float("inf"))) & F.exists("v", lambda e: e != 0), F.lit(False))
    rows = rows.withColumn("ok", whole)
    same = F.transform("v", lambda e: e + F.lit(0.0))  # -0.0 and 0.0 are one value
    good = rows.filter("ok").select(KEY, same.alias("v"))
    first = stored(good.groupBy("v").agg(F.min(KEY).alias("rep"), F.count("*").alias("copies")), "vectors")
    kind = "<f4" if dict(table.dtypes)[vector_col] == "array<float>" else "<f8"
    coded = first.select(F.col("rep").alias(KEY), "v", "copies").mapInArrow(_coded(d, kind, tables, per_table, probes), f"bucket long, own boolean, {KEY} long, copies long, vector binary, codes binary")
    counts = coded.groupBy("bucket").agg(F.count("*").alias("m"), F.count_if("own").alias("mine")).filter("mine > 0 AND m > 1")
    blocks = F.ceil(F.col("m") / F.lit(block)).cast("int")
    part = F.pmod(F.xxhash64(KEY), F.col("blocks")).cast("int")
    dealt = coded.join(counts.select("bucket", blocks.alias("blocks")), "bucket").withColumn("part", part)
    one = F.sequence(F.lit(0), F.col("blocks") - 1)
    left = dealt.filter("own").withColumn("i", F.col("part")).withColumn("j", F.explode(one)).withColumn("left", F.lit(True)).withColumn("right", F.col("i") == F.col("j"))
    right = dealt.withColumn("j", F.col("part")).withColumn("i", F.explode(one)).withColumn("right", F.lit(True)).withColumn("left", F.lit(False)).filter("NOT own OR i <> j")
    tasks = left.unionByName(right).withColumn("task", F.xxhash64("bucket", "i", "j"))
    cols = ["task", "bucket", "own", KEY, "vector", "codes", "copies", "left", "right"]
    met = tasks.select(*cols).repartition("task").sortWithinPartitions("task", "bucket").mapInArrow(_meet(d, kind, tables, probes, cosine), f"{KEY} long, n long, low long")
    met = checkpoint(met)
    links = met.groupBy(KEY).agg(F.sum("n").alias("n"))
    root = components(met.select(F.col(KEY).alias("a"), F.col("low").alias("b")))
    of_rep = first.join(links.withColumnRenamed(KEY, "rep"), "rep", "left").join(root, F.col("rep") == F.col("node"), "left")
    of_rep = of_rep.select("v", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "rep").alias("component_key"))
    out = rows.filter("ok").select(KEY, "_id", same.alias("v")).join(of_rep, "v").select(KEY, "_id", F.col("n_links").cast("long").alias("n_links"), "component_key")
    out = out.unionByName(rows.filter("NOT ok").select(KEY, "_id", F.lit(0).cast("long").alias("n_links"), F.col(KEY).alias("component_key")))
    return out.withColumn("kept", F.col(KEY) == F.col("component_key"))


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    out = near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return out.select(F.col("_id").alias("vec_id"), "n_links", F.col("component_key").alias("component_id"), "kept")
