"""Order verification."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.keys import SortKey, checked_keys, compare
from .sort import with_position

#: Rows of a chunk that neighbours are looked for in; rows of a batch, for the places in a report.
CHUNK, BATCH = 1_000_000, 1024


@dataclass(frozen=True)
class Report:
    """What a check found; positions count from 1, batches of BATCH rows and the rows in them from 0."""

    sorted: bool
    rows: int
    position: int | None = None
    column: str | None = None
    previous: str | None = None
    current: str | None = None

    @property
    def batches(self) -> int:
        return -(-self.rows // BATCH)

    @property
    def batch(self) -> int | None:
        return None if self.position is None else (self.position - 1) // BATCH

    @property
    def row_in_batch(self) -> int | None:
        return None if self.position is None else (self.position - 1) % BATCH

    def text(self) -> str:
        if self.sorted:
            return f"sorted: {self.rows} rows in {self.batches} batches"
        return f"not sorted: row {self.position} (batch {self.batch}, row {self.row_in_batch} in it), column {self.column}: {self.previous} before {self.current}"


def neighbours(df: DataFrame, arrival: Sequence[SortKey], keys: Sequence[SortKey], chunk: int = CHUNK) -> DataFrame:
    """``pos``, the key as ``cur`` and that of the row before as ``prev``, and ``has_prev``.

    Rows are compared inside chunks of positions; the last row of a chunk is copied to the next one as its predecessor.
    """
    checked_keys(df.schema, keys)
    key = F.struct(*[k.column().alias(k.name) for k in keys])
    placed = with_position(df, arrival, "__pos").select(F.col("__pos").alias("pos"), key.alias("cur"))
    own = placed.withColumn("__chunk", F.floor((F.col("pos") - 1) / chunk)).withColumn("__copy", F.lit(False))
    copies = placed.where(F.col("pos") % chunk == 0).withColumn("__chunk", F.floor(F.col("pos") / chunk)).withColumn("__copy", F.lit(True))
    w = Window.partitionBy("__chunk").orderBy("pos")
    pairs = own.unionByName(copies).withColumn("prev", F.lag("cur").over(w)).withColumn("has_prev", F.row_number().over(w) > 1)
    return pairs.where(~F.col("__copy")).select("pos", "prev", "cur", "has_prev")


def violations(df: DataFrame, arrival: Sequence[SortKey], keys: Sequence[SortKey], chunk: int = CHUNK) -> DataFrame:
    """Rows that come before their predecessor: ``pos``, ``key_index`` (first differing key), ``prev``, ``cur``.  Equal keys pass."""
    sign, place = compare(keys, "prev", "cur")
    pairs = neighbours(df, arrival, keys, chunk).where("has_prev")
    return pairs.withColumn("__sign", sign).withColumn("key_index", place).where("__sign > 0").select("pos", "key_index", "prev", "cur")


def shown(value) -> object:
    """A value as text, null as NULL."""
    return F.coalesce(value.cast("string"), F.lit("NULL"))


def first_violation(df: DataFrame, arrival: Sequence[SortKey], keys: Sequence[SortKey], chunk: int = CHUNK) -> DataFrame:
    """At most one row: ``pos``, ``column``, ``previous``, ``current`` of the first violation."""
    first = violations(df, arrival, keys, chunk).orderBy("pos").limit(1)
    pick = lambda side: F.coalesce(*[F.when(F.col("key_index") == i, shown(F.col(side)[k.name])) for i, k in enumerate(keys)])
    column = F.coalesce(*[F.when(F.col("key_index") == i, F.lit(k.name)) for i, k in enumerate(keys)])
    return first.select("pos", column.alias("column"), pick("prev").alias("previous"), pick("cur").alias("current"))


def check_sorted(df: DataFrame, arrival: Sequence[SortKey], keys: Sequence[SortKey]) -> Report:
    rows = df.count()
    if not keys:
        return Report(True, rows)
    found = first_violation(df, arrival, keys).first()
    return Report(True, rows) if found is None else Report(False, rows, found["pos"], found["column"], found["previous"], found["current"])


#: Types whose neighbours Arrow compares as Spark does.
FLAT = (T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType, T.StringType, T.BinaryType, T.DateType, T.TimestampType, T.TimestampNTZType)


def _before(key: SortKey, a: pa.Array, b: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Of each pair of values: whether ``b`` belongs before ``a``, and whether they are equal."""
    plain = lambda x: np.asarray(pc.fill_null(x, False).to_numpy(zero_copy_only=False), bool)
    null_a, null_b = plain(a.is_null()), plain(b.is_null())
    less, same = plain(pc.less(b, a)), plain(pc.equal(a, b))
    if pa.types.is_floating(a.type):  # NaN is the largest, and equal to itself
        nan_a, nan_b = plain(pc.is_nan(a)), plain(pc.is_nan(b))
        less, same = np.where(nan_a, ~nan_b, less & ~nan_b), (nan_a & nan_b) | same
    same = np.where(null_a | null_b, null_a & null_b, same)
    less = ~same & (~less if key.descending else less)
    return np.where(null_a, ~null_b & (not key.nulls_first), np.where(null_b, key.nulls_first, less)), same


def _unsorted_neighbours(keys: Sequence[SortKey]):
    """Rows in file order: the first and the last row of each stretch of a file, and each row before which a later one lies."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks()
            n = rows.num_rows
            at, file = np.asarray(rows["__row"]), rows["__file"].combine_chunks()
            follows = np.asarray(pc.equal(file.slice(1), file.slice(0, n - 1)).to_numpy(zero_copy_only=False), bool) & (at[1:] == at[:-1] + 1)
            bad, open_ = np.zeros(n - 1, bool), np.ones(n - 1, bool)
            for k in keys:
                c = rows[k.name].combine_chunks()
                before, same = _before(k, c.slice(0, n - 1), c.slice(1))
                bad |= open_ & before
                open_ &= same
            bad &= follows
            cut = np.flatnonzero(~follows)
            # Both rows of a violation, and both sides of each end of a stretch.
            wanted = np.unique(np.concatenate([np.flatnonzero(bad), np.flatnonzero(bad) + 1, cut, cut + 1, [0] if held is None else []])).astype(np.int64)
            if len(wanted):
                yield rows.take(pa.array(wanted)).combine_chunks().to_batches()[0]
            held = rows.slice(n - 1).combine_chunks().to_batches()[0]
        if held is not None:
            yield held

    return work


def check_path(spark: SparkSession, path: str, keys: Sequence[SortKey]) -> Report:
    """Check Parquet files in the order of their names and of the rows in them; only key columns are read.

    Neighbours are compared where they are read; only violations and the ends of splits are sorted and compared across
    splits.  Keys of nested types are compared by positions over all rows instead.
    """
    df = spark.read.parquet(path)
    total = df.count()
    if not keys:
        return Report(True, total)
    checked_keys(df.schema, keys)
    named = list(dict.fromkeys(k.name for k in keys))
    rows = df.select(*[F.col(f"`{n}`") for n in named], F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row"))
    order = [SortKey("__file"), SortKey("__row")]
    if not all(isinstance(df.schema[n].dataType, FLAT) for n in named):
        return check_sorted(rows, order, keys)
    found = rows.mapInArrow(_unsorted_neighbours(keys), rows.schema).dropDuplicates(["__file", "__row"])
    worst = violations(found, order, keys).orderBy("pos").limit(1)
    # The rows kept are neighbours in the files or ends of stretches, so each violation among them is one.
    at = with_position(found, order, "__pos").join(worst.select(F.col("pos").alias("__pos")), "__pos").select("__file", "__row").first()
    if at is None:
        return Report(True, total)
    shown_row = first_violation(found, order, keys).first()
    before = rows.where(F.col("__file") < at["__file"]).count() if at["__row"] >= 0 else 0
    return Report(False, total, before + at["__row"] + 1, shown_row["column"], shown_row["previous"], shown_row["current"])
