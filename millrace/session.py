"""Session defaults: adaptive execution, UTC, sizes that follow the input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(app: str = "millrace", **conf: str) -> SparkSession:
    """A session with the defaults; ``conf`` (dots as double underscores) wins."""
    b = SparkSession.builder.appName(app)
    for k, v in (DEFAULTS | {k.replace("__", "."): v for k, v in conf.items()}).items():
        b = b.config(k, v)
    return b.getOrCreate()


def spread(scan: DataFrame) -> DataFrame:
    """A scan of fewer partitions than there are cores, dealt to all of them; any larger one as it is.

    A small file is one task however much is to be computed for its rows.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(cores)
