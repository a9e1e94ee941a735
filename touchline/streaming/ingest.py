"""Streaming ingest: files that have settled, each processed once across restarts."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupStateTimeout
from pyspark.sql.types import StructType

from touchline.config import Ingest
from touchline.operators.ingest import ingest_candidates, latest_ledger, unprocessed, with_fingerprint
from touchline.sources.readers import list_files


def file_stream(spark: SparkSession, root: str, per_trigger: int = 1000) -> DataFrame:
    """path, size, mtime of new files under root; contents are pruned from the scan."""
    stream = spark.readStream.format("binaryFile").option("recursiveFileLookup", True).option("maxFilesPerTrigger", per_trigger)
    files = stream.schema("path string, modificationTime timestamp, length bigint, content binary").load(root)
    return files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))


def poll_once(spark: SparkSession, root: str, snapshots: str, number: int) -> None:
    """Write what lies under root now as poll `number`: path, size, mtime_ns. A poll that has been written stays as it is.

    Spark lists the files and leaves out names that begin with a dot or an underscore.
    """
    at = f"{snapshots}/poll_no={number}"
    if not complete(spark, at):
        files = list_files(spark, root).select("path", "size", (F.unix_micros("mtime") * 1000).alias("mtime_ns"))
        files.write.mode("overwrite").parquet(at)


def poll_stream(spark: SparkSession, root: str, snapshots: str) -> DataStreamWriter:
    """A stream that polls root at every trigger: set its trigger's interval and its checkpoint, then start it.

    The batch's number is the poll's, and a poll once written isn't listed again, so a restart neither skips nor repeats one.
    """
    ticks = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 1).option("numPartitions", 1).load()
    return ticks.writeStream.foreachBatch(lambda _, number: poll_once(spark, root, snapshots, number))


def snapshot_stream(spark: SparkSession, snapshots: str) -> DataFrame:
    """path, size, mtime_ns, poll_no of the polls of poll_stream(), for stable_stream(). The folder must hold a poll."""
    return spark.readStream.schema("path string, size bigint, mtime_ns bigint, poll_no bigint").parquet(snapshots)


def stable_stream(snapshots: DataFrame, cfg: Ingest = Ingest(), time: str | None = None, delay: str = "1 minute", forget_ms: int = 3_600_000) -> DataFrame:
    """path, poll_no, size of files that have kept their size for cfg.checks polls; snapshots: path, poll_no, size.

    Where snapshots has mtime_ns, that of the reporting poll comes along. A poll that comes twice counts once.

    State of a path: last poll, size, run, polls, whether it is settled: reported, polled 10 * checks times in vain, or
    missing in a poll. With time (a timestamp column of snapshots), the watermark, delay behind, drives expiry: a path that
    isn't polled for forget_ms loses its state, and starts anew if it comes again. Without it, states stay.
    """
    more = [c for c in ("mtime_ns",) if c in snapshots.columns]
    columns = ["path", "poll_no", "size", *more]

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last, size, run, polls, done = state.get if state.exists else (-1, -1, 0, 0, False)
        out = []
        parts = list(parts)
        for poll, now, *rest in sorted(tuple(map(int, row)) for part in parts for row in part[columns[1:]].itertuples(index=False)):
            if poll == last:
                continue
            polls += 1
            done = done or polls > 10 * cfg.checks or (last >= 0 and poll != last + 1)
            run = run + 1 if now == size and now > 0 else 0
            last, size = poll, now
            if run == cfg.checks and not done:
                out.append((key[0], poll, now, *rest))
                done = True
        state.update((last, size, run, polls, done))
        if time is not None:
            seen = max(int(part[time].max().timestamp() * 1000) for part in parts)
            state.setTimeoutTimestamp(max(seen, state.getCurrentWatermarkMs()) + forget_ms)
        yield pd.DataFrame(out, columns=columns)

    rows = snapshots if time is None else snapshots.withWatermark(time, delay)
    expiry = GroupStateTimeout.NoTimeout if time is None else GroupStateTimeout.EventTimeTimeout
    schema = ", ".join(f"{c} {'string' if c == 'path' else 'bigint'}" for c in columns)
    return rows.groupBy("path").applyInPandasWithState(step, schema, "last bigint, size bigint, run int, polls int, done boolean", "append", expiry)


def without_repeats(files: DataFrame, time: str = "seen", delay: str = "1 hour") -> DataFrame:
    """Files in flight once: the same path and fingerprint within the delay counts as one."""
    return files.withWatermark(time, delay).dropDuplicatesWithinWatermark(["path", "fp_key"])


def complete(spark: SparkSession, path: str) -> bool:
    """Whether a table at path has been written to its end."""
    marker = spark._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
    return marker.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(marker)


#: What a ledger keeps of a file; rows are dealt to so many folders by path, so that a batch reads only those of its paths.
RECORD, LEDGER_BUCKETS = "path string, size bigint, mtime_ns bigint, ctime_ns bigint, ino bigint, dev bigint, processed_at timestamp", 64


def _bucket(path: str = "path") -> Column:
    return F.pmod(F.xxhash64(path), F.lit(LEDGER_BUCKETS)).cast("int")


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """RECORD, batch, bucket of the ledger that process_once() keeps at path; none if there is no batch yet."""
    schema, entries = f"{RECORD}, batch bigint, bucket int", f"{path}/entries"
    folder = spark._jvm.org.apache.hadoop.fs.Path(entries)
    if not folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(folder):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", entries).parquet(entries)


def process_once(process: Callable[[DataFrame], DataFrame | None], ledger_path: str, cfg: Ingest = Ingest()) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: candidates that the ledger doesn't hold as they are now are processed, then recorded.

    The ledger holds the last version of each path. A batch takes three steps, each a table below ledger_path that bears the
    batch's number and is complete or void: claims (the files it takes), results (what process returns), entries (the ledger).
    A batch that is run again after a failure goes on behind its last complete step. What process returns, a DataFrame, is so
    kept once; a process that returns None and acts otherwise is repeated if it fails, and is not once it has returned and
    the (empty) results stand.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        claims, results, entries = (f"{ledger_path}/{step}/batch={number}" for step in ("claims", "results", "entries"))
        if complete(spark, entries):
            return
        if not complete(spark, claims):
            files = with_fingerprint(ingest_candidates(batch, cfg)).where("fp_key IS NOT NULL").dropDuplicates(["path", "fp_key"])
            names = files.select("path", _bucket().alias("bucket")).distinct().persist()
            try:
                buckets = [r["bucket"] for r in names.select("bucket").distinct().collect()]  # at most LEDGER_BUCKETS
                ledger = read_ledger(spark, ledger_path).where(F.col("bucket").isin(buckets)).join(names.select("path").hint("merge"), "path", "left_semi")
                last = latest_ledger(ledger.withColumn("processed_at", F.struct("batch", "mtime_ns")))
                unprocessed(files, last).write.mode("overwrite").parquet(claims)
            finally:
                names.unpersist()
        claimed = spark.read.parquet(claims)
        if not complete(spark, results):
            kept = None if claimed.isEmpty() else process(claimed)
            (claimed.limit(0).select("path") if kept is None else kept).write.mode("overwrite").parquet(results)
        _record(claimed, entries)

    return run


def _record(claimed: DataFrame, entries: str) -> None:
    wanted = [f for f in StructType.fromDDL(RECORD).fields if f.name != "processed_at"]
    columns = [(F.col(f.name) if f.name in claimed.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in wanted]
    rows = claimed.select(*columns, F.current_timestamp().alias("processed_at"), _bucket().alias("bucket"))
    rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(entries)


def read_results(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What process returned in all complete batches, with the batch's number."""
    return spark.read.schema(f"{schema}, batch bigint").option("basePath", f"{path}/results").parquet(f"{path}/results")
