"""Planning runs: thresholds, assignment of batches to runs, batch sizes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows that make a run or an output batch, rows of a row group, least rows of a read batch.
DEFAULT_RUN_ROWS, DEFAULT_ROW_GROUP, LEAST_READ_BATCH = 1_000_000, 1_048_576, 1024


@dataclass(frozen=True)
class FlushThreshold:
    """A run ends with the batch that brings it to ``max_rows`` rows or ``max_bytes`` bytes, whichever is given and comes first."""

    max_rows: int | None = DEFAULT_RUN_ROWS
    max_bytes: int | None = None

    def __post_init__(self):
        if self.max_rows is None and self.max_bytes is None:
            raise ValueError("a threshold needs rows, bytes, or both")

    @classmethod
    def rows(cls, n: int) -> FlushThreshold:
        return cls(n, None)

    @classmethod
    def bytes(cls, n: int) -> FlushThreshold:
        return cls(None, n)

    @classmethod
    def either(cls, rows: int, size: int) -> FlushThreshold:
        return cls(rows, size)

    def should_flush(self, rows: int, size: int) -> bool:
        return (self.max_rows is not None and rows >= self.max_rows) or (self.max_bytes is not None and size >= self.max_bytes)


def assign_runs(batches: DataFrame, threshold: FlushThreshold, cuts: tuple[int, ...] = ()) -> DataFrame:
    """``batches`` (``batch_no``, ``n_rows``, ``n_bytes``; a row a batch) with ``run_id``.

    Counters start anew after each flush, so this is a fold in the order of batches: one task streams over them, a row a
    batch, and holds the counters alone.  Where all batches have the same rows, :func:`uniform_runs` needs no fold.  A batch
    in ``cuts`` is followed by a manual flush.  Batches without rows never end a run.
    """
    cut = frozenset(cuts)

    def fold(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = rows = size = 0
        for part in parts:
            runs = []
            for number, n, b in zip(*(c.to_pylist() for c in part.columns), strict=True):
                rows, size = rows + n, size + b
                runs.append(run)
                if (n > 0 and threshold.should_flush(rows, size)) or (number in cut and rows > 0):
                    run, rows, size = run + 1, 0, 0
            yield pa.record_batch([*part.columns, pa.array(runs, pa.int64())], ["batch_no", "n_rows", "n_bytes", "run_id"])

    sized = batches.select(*[F.col(c).cast("long").alias(c) for c in ("batch_no", "n_rows", "n_bytes")])
    return sized.repartition(1).sortWithinPartitions("batch_no").mapInArrow(fold, "batch_no long, n_rows long, n_bytes long, run_id long")


def uniform_runs(batch_no: Column, batch_rows: int, max_rows: int) -> Column:
    """The run of a batch when all batches have ``batch_rows`` rows: no fold, and no exchange."""
    return F.floor(batch_no / -(-max_rows // batch_rows))


def estimated_bytes(schema: T.StructType) -> Column:
    """Bytes of a row, documented estimate: fixed widths (8 where unknown) and the lengths of strings and binaries."""
    width = {T.ByteType: 1, T.BooleanType: 1, T.ShortType: 2, T.IntegerType: 4, T.FloatType: 4, T.DateType: 4}
    total = F.lit(0).cast("long")
    for f in schema.fields:
        if isinstance(f.dataType, T.StringType | T.BinaryType):
            total = total + F.coalesce(F.octet_length(f"`{f.name}`"), F.lit(0))
        elif isinstance(f.dataType, T.ArrayType):
            total = total + F.greatest(F.size(f"`{f.name}`"), F.lit(0)) * width.get(type(f.dataType.elementType), 8)
        else:
            total = total + width.get(type(f.dataType), 8)
    return total


def read_batch_rows(output_batch: int, runs: int) -> int:
    """Rows to read at once from each of ``runs`` runs."""
    return max(LEAST_READ_BATCH, output_batch // max(1, runs))


def run_name(n: int) -> str:
    return f"run_{n}.parquet"
