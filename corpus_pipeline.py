"""A training corpus from raw documents, as stages that are written and read again.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import decontaminate, language_id, line_dedup, minhash, packing
from millrace.llm._spark import KEY, TEXT, restored, small_batches, stored, whole_rows

LEAST_SCORE = 0.4


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language: those without a letter go, and those between two codewords.

    Rows are judged by their text alone: ids may be null or repeated, columns
    may have any names; null and empty texts go; without labelled rows all go.
    """
    small_batches(spark)
    model = language_id.train(docs.filter(~language_id.held_out()))
    out = language_id.identify(docs, model, keep={"doc": F.struct(*[F.col(f"`{c}`") for c in docs.columns])})
    keep = (F.col("lang_pred") != language_id.UND) & ~(F.col("ambiguous") & (F.col("score") < LEAST_SCORE))
    return out.filter(keep).select(*[F.col("doc").getField(c).alias(c) for c in docs.columns])


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later copies of three-line windows; the character counts follow.

    Each row stays a row, whatever its id: rows with null or repeated ids are
    judged one by one, in the order of id, nulls first, then text. A null text
    stays null.
    """
    small_batches(spark)
    return line_dedup.stripped(docs, count_col="n_chars" if "n_chars" in docs.columns else None)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group: the one with the smallest id, nulls first, then by text.

    Rows that share an id, or have none, are judged one by one; texts that are
    null or without a word are nobody's copies and all stay.
    """
    small_batches(spark)
    rows = whole_rows(docs)
    gone = minhash.classes(rows, KEY, TEXT).filter("NOT kept").select(KEY)
    return restored(rows.join(gone, KEY, "left_anti"), docs.columns)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; null and empty texts hold none, ids and other columns do not matter."""
    small_batches(spark)
    return decontaminate.flagged(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token pieces of all documents and their places in sequences; a null or empty text is its end id alone."""
    small_batches(spark)
    out = packing.pack(docs, packing.default_vocabulary(), ids=False)
    return out.select(F.col("_id").alias("doc_id"), *packing.CONTRACT)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", identify),
    ("line dedup", dedup_lines),
    ("MinHash near-dedup", dedup_near),
    ("benchmark decontamination", decontaminated),
    ("packing", pack),
]

ORACLE_SQL = None  # classifiers, signatures, edit distances and a tokenizer are beyond SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each but the last written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.split()[0].lower())
    return STAGES[-1][1](spark, docs, sf_dir)
