"""Writing in steps: batches in, sorted runs on shared storage, one sorted result at the end."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

from pyspark import InheritableThread, StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..errors import NoSortKeys, SchemaMismatch, WriterClosed
from ..functions.keys import SortKey, checked_keys, orders
from ..operators.merge import union_runs
from ..plans.progress import FinishProgress, Handler, no_progress, phase_of, progress_rows
from ..plans.runs import DEFAULT_RUN_ROWS, FlushThreshold, estimated_bytes, run_name
from ..sources.parquet import write_sorted, write_sorted_groups


def _at(spark: SparkSession, path: str):
    """Hadoop's file system and path."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def _size(spark: SparkSession, path: str) -> int:
    system, where = _at(spark, path)
    return int(system.getContentSummary(where).getLength())


def _delete(spark: SparkSession, path: str) -> None:
    system, where = _at(spark, path)
    system.delete(where, True)


def _while_writing(spark: SparkSession, write: Callable[[], None]) -> Iterator[float]:
    """The share of tasks done in the last stage of the jobs that ``write`` starts, again and again; at its end 1."""
    context, group, failed = spark.sparkContext, uuid.uuid4().hex, []

    def run() -> None:
        context.setJobGroup(group, "sorted write")
        try:
            write()
        except BaseException as e:  # raised again below, in the caller's thread
            failed.append(e)

    thread = InheritableThread(target=run)
    thread.start()
    while thread.is_alive():
        thread.join(0.2)
        tracker = context.statusTracker()
        jobs = [tracker.getJobInfo(j) for j in tracker.getJobIdsForGroup(group)]
        stages = [tracker.getStageInfo(max(j.stageIds)) for j in jobs if j and j.stageIds and j.status == "RUNNING"]
        shares = [s.numCompletedTasks / s.numTasks for s in stages if s and s.numTasks > 1]
        yield 0.99 * max(shares) if len(shares) == 1 and len(jobs) > 1 else 0.0
    if failed:
        raise failed[0]
    yield 1.0


@dataclass(frozen=True)
class WriterOptions:
    threshold: FlushThreshold = FlushThreshold()
    run_dir: str | None = None
    run_options: dict = field(default_factory=dict)
    merge_sort: bool = False


class SortingWriter:
    """Globally sorted output from batches in any order.

    A batch with the fixed schema is kept until the threshold is reached after it; then the kept batches become one sorted
    run in ``run_dir`` (shared storage).  ``finish`` merges the runs and deletes them.  Batches without rows are ignored.  A
    batch is evaluated once: what is counted is what becomes part of a run.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, keys: Sequence[SortKey], options: WriterOptions | None = None):
        if not keys:
            raise NoSortKeys("at least one sort key is needed")
        self.spark, self.path, self.schema, self.keys = spark, path, schema, checked_keys(schema, keys)
        self.options = options or WriterOptions()
        self.run_dir = self.options.run_dir or f"{path}.runs-{uuid.uuid4().hex}"
        self.key_values: dict[str, str] = {}
        self.in_progress_rows = self.in_progress_bytes = self.num_run_files = self.bytes_written = 0
        self._kept: list[DataFrame] = []
        self._closed = False

    def append_key_value(self, key: str, value: str) -> None:
        self.key_values[key] = value

    def write(self, batch: DataFrame) -> None:
        self._open()
        batch = batch.persist(StorageLevel.MEMORY_AND_DISK)
        found = batch.agg(F.count("*").alias("n"), F.sum(estimated_bytes(batch.schema)).alias("b")).first()
        if not found["n"]:
            batch.unpersist()
            return
        plain = lambda s: [(f.name, f.dataType.simpleString()) for f in s.fields]
        if plain(batch.schema) != plain(self.schema):
            raise SchemaMismatch(f"the batch has {plain(batch.schema)}, the writer {plain(self.schema)}")
        self._kept.append(batch)
        self.in_progress_rows += found["n"]
        self.in_progress_bytes += found["b"]
        if self.options.threshold.should_flush(self.in_progress_rows, self.in_progress_bytes):
            self.flush_buffer()

    def flush_buffer(self) -> None:
        """Make a run of what is kept; nothing kept: nothing happens."""
        self._open()
        if self._kept:
            run = union_runs(self._kept).orderBy(*orders(self.keys))
            run.write.mode("overwrite").options(**self.options.run_options).parquet(f"{self.run_dir}/{run_name(self.num_run_files)}")
            for batch in self._kept:
                batch.unpersist()
            self.num_run_files += 1
            self._kept, self.in_progress_rows, self.in_progress_bytes = [], 0, 0

    def finish(self, row_group: int | None = None, handler: Handler = no_progress, one_file: bool = False, mode: str = "errorifexists") -> int:
        """Write the result; returns its rows.  Without runs the handler is told of nothing.

        The handler is told of each output batch as soon as the share of the writing tasks that have ended passes it.
        """
        self._open()
        self.flush_buffer()
        self._closed = True
        paths = [f"{self.run_dir}/{run_name(i)}" for i in range(self.num_run_files)]
        merged = self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)
        total = merged.count() if paths else 0
        left = progress_rows(total, row_group or DEFAULT_RUN_ROWS, self.num_run_files)
        for share in _while_writing(self.spark, lambda: write_sorted(merged, self.path, self.keys, one_file, row_group, self.key_values, mode, self.options.merge_sort)):
            while left and left[0].rows_written <= share * total:
                handler(left.pop(0))
        self.bytes_written = _size(self.spark, self.path)
        for path in [*paths, *([self.run_dir] if self.options.run_dir is None else [])]:
            _delete(self.spark, path)
        return total

    def _open(self) -> None:
        if self._closed:
            raise WriterClosed("the writer is finished")


class SortedGroupsWriter:
    """Row groups of ``group_rows`` rows, each sorted by itself, from batches in the order they are written."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, keys: Sequence[SortKey], group_rows: int):
        if not keys:
            raise NoSortKeys("at least one sort key is needed")
        self.spark, self.path, self.schema, self.keys, self.group_rows = spark, path, schema, checked_keys(schema, keys), group_rows
        self._kept: list[DataFrame] = []
        self._parts = 0
        self._closed = False

    def write(self, batch: DataFrame) -> None:
        if self._closed:
            raise WriterClosed("the writer is closed")
        if [(f.name, f.dataType) for f in batch.schema.fields] != [(f.name, f.dataType) for f in self.schema.fields]:
            raise SchemaMismatch("the batch has another schema than the writer")
        self._kept.append(batch.withColumn("__batch", F.lit(len(self._kept))))

    def flush(self) -> None:
        """Write what is kept, its last row group short."""
        if self._kept:
            staged = union_runs(self._kept)
            write_sorted_groups(staged, self.path, self.keys, self.group_rows, [SortKey("__batch"), *self.keys], mode="append" if self._parts else "errorifexists")
            self._kept, self._parts = [], self._parts + 1

    def close(self) -> None:
        if not self._parts and not self._kept:
            self.spark.createDataFrame([], self.schema).write.parquet(self.path)
        self.flush()
        self._closed = True


def stream_runs(stream: DataFrame, run_dir: str, keys: Sequence[SortKey], checkpoint: str, **trigger) -> StreamingQuery:
    """Each micro-batch becomes one sorted run ``run_{id}.parquet``; a replayed batch overwrites its own run."""
    checked_keys(stream.schema, keys)

    def one(batch: DataFrame, ident: int) -> None:
        batch.orderBy(*orders(keys)).write.mode("overwrite").parquet(f"{run_dir}/{run_name(ident)}")

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def merge_stream_runs(spark: SparkSession, run_dir: str, path: str, keys: Sequence[SortKey], one_file: bool = False) -> None:
    """The closing batch job: all runs into one sorted output."""
    write_sorted(spark.read.parquet(f"{run_dir}/run_*.parquet"), path, keys, one_file)


__all__ = ["FinishProgress", "SortedGroupsWriter", "SortingWriter", "WriterOptions", "merge_stream_runs", "phase_of", "stream_runs"]
