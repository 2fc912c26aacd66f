"""Writers: datasets by split, published in one step; manifests and fingerprints."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def publish(rows: DataFrame, path: str, by: list[str] | None = None, most_rows: int = 1_000_000) -> str:
    """Written beside the target, then renamed to it; a target with content is refused."""
    spark = rows.sparkSession
    fs, target = _fs(spark, path)
    if fs.exists(target) and fs.listStatus(target):
        raise FileExistsError(path)
    staging = f"{path.rstrip('/')}.staging"
    rows.write.option("maxRecordsPerFile", most_rows).partitionBy(*(by or [])).mode("overwrite").parquet(staging)
    if fs.exists(target):
        fs.delete(target, False)
    if not fs.rename(_fs(spark, staging)[1], target):
        raise OSError(f"cannot publish {path}")
    return path


def manifest(rows: DataFrame, by: str, **config) -> dict:
    """Rows by group and a digest of the canonical configuration; a row per group comes to the driver."""
    import hashlib

    canon = json.dumps(config, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    return {"config": config, "counts": {r[by]: r["n"] for r in rows.groupBy(by).agg(F.count("*").alias("n")).collect()}, "fingerprint": hashlib.sha256(canon.encode()).hexdigest()}


def fingerprints(spark: SparkSession, *paths: str) -> DataFrame:
    """(path, length, sha256) of files."""
    return spark.read.format("binaryFile").load(list(paths)).select("path", "length", F.sha2("content", 256).alias("sha256"))


def publish_json(rows: DataFrame, path: str, most_rows: int = 1_000_000) -> dict:
    """JSON lines published in one step, with ``_manifest.json`` beside them: each file's rows and SHA-256."""
    spark = rows.sparkSession
    fs, target = _fs(spark, path)
    if fs.exists(target) and fs.listStatus(target):
        raise FileExistsError(path)
    staging = f"{path.rstrip('/')}.staging"
    rows.write.option("maxRecordsPerFile", most_rows).option("ignoreNullFields", "false").mode("overwrite").json(staging)
    found = {r["name"]: {"rows": r["rows"], "sha256": r["sha256"]} for r in _files(spark, staging).collect()}  # a row per file
    out = fs.create(_fs(spark, f"{staging}/_manifest.json")[1], False)
    out.write(bytearray(json.dumps(found, sort_keys=True).encode()))
    out.close()
    if fs.exists(target):
        fs.delete(target, False)
    if not fs.rename(_fs(spark, staging)[1], target):
        raise OSError(f"cannot publish {path}")
    return found


def _files(spark: SparkSession, path: str) -> DataFrame:
    """(name, rows, sha256) of the JSON-lines files of a folder."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(path)
    sums = raw.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("sha256"))
    lines = spark.read.option("pathGlobFilter", "part-*").text(path).groupBy(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("name"))
    return sums.join(lines.agg(F.count("*").alias("rows")), "name", "left").fillna({"rows": 0})


def verified(spark: SparkSession, path: str) -> DataFrame:
    """(name, problem) of files that are missing, unknown or differ from the manifest; empty if all is well."""
    fs, place = _fs(spark, f"{path.rstrip('/')}/_manifest.json")
    stream = fs.open(place)  # readers pass over names with an underscore
    try:
        found = json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()
    want = spark.createDataFrame([(k, v["rows"], v["sha256"]) for k, v in found.items()], "name string, _rows long, _sha string")
    both = want.join(_files(spark, path), "name", "full")
    problem = F.when(F.col("sha256").isNull(), "missing").when(F.col("_sha").isNull(), "unknown").when(F.col("sha256") != F.col("_sha"), "digest").when(F.col("rows") != F.col("_rows"), "rows")
    return both.select("name", problem.alias("problem")).filter("problem IS NOT NULL")


def changed(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, change) between two ``fingerprints``: added, removed or changed files; none means nothing has to be built anew."""
    both = before.select("path", F.col("sha256").alias("_a")).join(after.select("path", F.col("sha256").alias("_b")), "path", "full")
    state = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(F.col("_a") != F.col("_b"), "changed")
    return both.select("path", state.alias("change")).filter("change IS NOT NULL")


def rewrite(spark: SparkSession, path: str, change) -> str:
    """A Parquet dataset replaced by ``change`` of its first version, which is kept as <path>.original.

    A second rewrite starts from that original again, so caps never compound.
    """
    fs, target = _fs(spark, path)
    _, kept = _fs(spark, f"{path.rstrip('/')}.original")
    staging = f"{path.rstrip('/')}.staging"
    change(spark.read.parquet(str(kept) if fs.exists(kept) else path)).write.mode("overwrite").parquet(staging)
    if fs.exists(kept):
        fs.delete(target, True)
    elif not fs.rename(target, kept):
        raise OSError(f"cannot keep {path}")
    if not fs.rename(_fs(spark, staging)[1], target):
        raise OSError(f"cannot publish {path}")
    return path
