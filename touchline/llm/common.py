"""Shared folder, table hand-over and bounded broadcast for the operators of this subpackage."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python task works on at once (one longer document is worked on alone).
SLICE_BYTES = 1 << 20
#: Rows of up to 16 bytes that may be broadcast (some 64 MB as a hash table); beyond it the join shuffles.
BROADCAST_IDS = 1_000_000
#: Bytes of a Parquet row group: what a writing task holds in memory.
ROW_GROUP = 16 << 20
#: Rows of an Arrow batch between Spark and Python, at most.
BATCH_ROWS = 1000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def small_batches(spark: SparkSession) -> None:
    """Texts go to Python in batches of BATCH_ROWS rows at most: with long ones, Spark's default of 10,000 can fill a worker."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name, "10000")) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Where it is unset, a local session (tests) gets one; a cluster is refused."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="spark-shared-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    small_batches(spark)
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("parquet.block.size", ROW_GROUP).parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.stored_at = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete tables of stored() that no later plan reads."""
    for df in tables:
        jvm = df.sparkSession.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def only_ids(df: DataFrame, ids: DataFrame, key: str, n_ids: int, limit: int = BROADCAST_IDS) -> DataFrame:
    """Rows of df whose key is in ids (one column, the same name): ids are broadcast up to limit rows, else both sides shuffle."""
    return df.join(F.broadcast(ids) if n_ids <= limit else ids.hint("merge"), key, "left_semi")


def text_key(text: Column) -> Column:
    """A number for a text, null as empty: with the id it names a row, so rows that repeat an id are told apart."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def by_rows(docs: DataFrame, rows: DataFrame, id_col: str, text_col: str, how: str, limit: int = BROADCAST_IDS) -> DataFrame:
    """docs with (left_semi) or without (left_anti) the rows named in rows, a stored table of two columns: id, text_key.

    Up to limit rows are broadcast, so docs doesn't move; else both sides shuffle. A null id matches null; all columns
    of docs stay, whatever their names.
    """
    names = [f"__{i}_{uuid.uuid4().hex}" for i in range(2)]
    same = F.col(id_col).eqNullSafe(F.col(names[0])) & (text_key(F.col(text_col)) == F.col(names[1]))
    n, rows = rows.count(), rows.toDF(*names)
    return docs.join(F.broadcast(rows) if n <= limit else rows.hint("merge"), same, how)


def without_rows(docs: DataFrame, gone: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return by_rows(docs, stored(gone.distinct(), "gone"), id_col, text_col, "left_anti")


def slices(batches: Iterable[pa.RecordBatch], column: str = "text", size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that the texts of each piece have at most size bytes, or are one document. Nulls become empty."""
    for batch in batches:
        i = batch.schema.get_field_index(column)
        text = pc.fill_null(batch.column(i), "").cast(pa.large_string())
        batch = pa.RecordBatch.from_arrays(
            [text if k == i else c for k, c in enumerate(batch.columns)], names=batch.schema.names
        )
        lengths = pc.binary_length(text).to_numpy(zero_copy_only=False)
        first, total = 0, 0
        for k, n in enumerate(lengths.tolist()):
            if total and total + n > size:
                yield batch.slice(first, k - first)
                first, total = k, 0
            total += n
        if first < batch.num_rows:
            yield batch.slice(first)


def tidy() -> None:
    """At the end of a task: the worker process stays for later stages, its free memory should not."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # only some C libraries have it
        ctypes.CDLL(None).malloc_trim(0)
