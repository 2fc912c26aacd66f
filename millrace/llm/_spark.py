"""Session helpers of the training-data operators: row keys, shared tables, batches."""

from __future__ import annotations

import gc
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEY, TEXT, DOC = "_key", "_text", "_doc"
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 4 << 20  #: of an Arrow batch; the JVM, the pipe and the Python worker each hold one


def small_batches(spark: SparkSession, most: int = BATCH_BYTES) -> None:
    """Have this session hand rows to Python in batches of about ``most`` bytes, a longer row by itself; every row is handed over.

    The limit by rows alone lets a batch grow with its texts. It holds from now
    on, as plans are executed after a stage has returned; a lower one stays.
    """
    now = spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch()
    if not 0 < now <= most:
        spark.conf.set(BATCH, str(most))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Only a single-process local session without that setting gets a temporary
    folder; on a cluster the missing setting is an error.
    """
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="millrace-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(found)
    return found


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage into the shared folder; Spark removes the files with the last reference."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Have the driver collect its garbage, so that Spark's cleaner drops shuffle and checkpoint files of finished rounds."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


_tables: list[str] = []


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows written as Parquet to the shared folder and read back; ``discard`` removes them."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _tables.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession) -> int:
    """Remove all intermediate tables of this driver; results that were not written yet are lost with them."""
    n = len(_tables)
    while _tables:
        path = spark._jvm.org.apache.hadoop.fs.Path(_tables.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return n


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(``_key`` long, ``_text``) of each row, ``_key`` unique and ordered as the ids, and the id where it differs.

    With unique integer ids the id is the key and there is no third column
    (``_id``); ``named`` restores it. Otherwise (null or repeated
    ids) rows are numbered by id, nulls first, then text, so that every row
    stays a document of its own. Extra columns are dropped here, whatever
    their names.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias(TEXT))
    if _unique(rows):
        return rows.select(F.col("_id").cast("long").alias(KEY), TEXT).filter(F.col(KEY).isNotNull())
    return numbered(rows, [F.col("_id").asc_nulls_first(), F.col(TEXT).asc_nulls_first()])


def _unique(rows: DataFrame) -> bool:
    """Whether ``_id`` is an integer, nowhere null and never repeated."""
    if dict(rows.dtypes)["_id"] not in ("bigint", "int", "smallint", "tinyint"):
        return False
    n, known, distinct = rows.agg(F.count("*"), F.count("_id"), F.countDistinct("_id")).first()
    return n == known == distinct


def whole_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(``_key`` as ``keyed`` gives it, ``_text``, ``_doc``: the struct of all columns but the text) of each row.

    For stages that return whole rows: what an operator decides on ``_key`` and
    ``_text`` comes back by ``_key``, which no two rows share, and the text
    travels once. ``restored`` gives the columns back.
    """
    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col]).alias(DOC)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias(TEXT), rest)
    if _unique(rows):
        return rows.select(F.col("_id").cast("long").alias(KEY), TEXT, DOC)
    return numbered(rows, [F.col("_id").asc_nulls_first(), F.col(TEXT).asc_nulls_first()]).select(KEY, TEXT, DOC)


def restored(rows: DataFrame, columns: list[str], text_col: str = "text") -> DataFrame:
    """The columns that ``whole_rows`` took in."""
    return rows.select(*[(F.col(TEXT) if c == text_col else F.col(DOC).getField(c)).alias(c) for c in columns])


def named(rows: DataFrame, out: DataFrame) -> DataFrame:
    """``out`` with the id of each ``_key`` of ``rows`` as second column."""
    rest = [c for c in out.columns if c != KEY]
    if "_id" not in rows.columns:
        return out.select(KEY, F.col(KEY).alias("_id"), *rest)
    return out.join(rows.select(KEY, "_id"), KEY).select(KEY, "_id", *rest)


def numbered(rows: DataFrame, order: list[Column]) -> DataFrame:
    """``_key`` 0.. in the given order, without a single sorting task: ranges are sorted, counted and shifted."""
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    ranged = stored(ranged, "numbered")
    part = F.shiftright("_at", 33).cast("int")
    counts = {r[0]: r[1] for r in ranged.groupBy(part.alias("p")).count().collect()}  # a row per partition
    base, at = {}, 0
    for p in sorted(counts):
        base[p], at = at, at + counts[p]
    shift = ranged.sparkSession.createDataFrame(list(base.items()), "_part int, _shift long")  # a row per partition
    low = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    placed = ranged.join(F.broadcast(shift), part == F.col("_part"))
    return placed.select((low + F.col("_shift")).alias(KEY), *rows.columns)


class Slice:
    """A run of rows of an Arrow batch: keys, their concatenated UTF-8 bytes and the offsets of each row."""

    __slots__ = ("keys", "data", "offs", "rows")

    def __init__(self, keys: np.ndarray, data: np.ndarray, offs: np.ndarray, rows: slice):
        self.keys, self.data, self.offs, self.rows = keys, data, offs, rows

    def __len__(self) -> int:
        return len(self.offs) - 1


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    n = len(column)
    offs = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and len(data) else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def slices(batch: pa.RecordBatch, text: str = TEXT, key: str | None = KEY, limit: int = 1 << 20):
    """Slices of at most ``limit`` bytes, a longer text by itself; every row is in exactly one."""
    data, offs = text_bytes(batch.column(text))
    keys = batch.column(key).to_numpy(zero_copy_only=False) if key else np.arange(len(offs) - 1)
    at, n = 0, len(offs) - 1
    while at < n:
        end = max(at + 1, int(np.searchsorted(offs, offs[at] + limit, "right")) - 1)
        yield Slice(keys[at:end], data[offs[at] : offs[end]], offs[at : end + 1] - offs[at], slice(at, end))
        at = end
