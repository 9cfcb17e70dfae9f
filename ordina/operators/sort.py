"""Sorting, exact positions, extremes, chunks and splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import SortKey, checked_keys, orders, total_order


def sort_global(df: DataFrame, keys: Sequence[SortKey]) -> DataFrame:
    """Rows in the keys' order over all partitions; ties in no given order; an empty input stays empty."""
    return df.orderBy(*orders(checked_keys(df.schema, keys)))


def sort_runs(df: DataFrame, keys: Sequence[SortKey], run_col: str) -> DataFrame:
    """Each run sorted by itself: rows of a run meet in one partition, sorted by (run, keys)."""
    return df.repartition(run_col).sortWithinPartitions(run_col, *orders(checked_keys(df.schema, keys)))


def with_position(df: DataFrame, keys: Sequence[SortKey], name: str = "pos") -> DataFrame:
    """``df`` with each row's place (from 1) in the keys' order, ties broken by all other columns.

    Rows are range-partitioned and sorted once; a row's place is its place in its partition plus the rows of the
    partitions before, so no task ever sees all rows.  Range bounds are sampled, hence the partitions are persisted
    between the two uses (lost blocks are recomputed with the same bounds).
    """
    full = total_order(df.columns, checked_keys(df.schema, keys), df.schema)
    ordered = df.repartitionByRange(*orders(full)).sortWithinPartitions(*orders(full))
    # The upper 31 bits are the partition, the lower 33 count its rows in order.
    placed = ordered.withColumn("__id", F.monotonically_increasing_id()).persist(StorageLevel.MEMORY_AND_DISK)
    part = F.shiftright("__id", 33)
    sizes = placed.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    starts = sizes.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    joined = placed.withColumn("__part", part).join(F.broadcast(starts), "__part")
    return joined.withColumn(name, F.col("__start") + F.col("__id").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("__part", "__id", "__start")


def extremes(df: DataFrame, keys: Sequence[SortKey], by: Sequence[str] = ()) -> DataFrame:
    """First and last key (structs ``min_key``, ``max_key``) in the keys' order and the rows, for each group; null of no rows.

    A null in ``by`` is a group like any other.  Ascending keys take one aggregation with partial results; with a descending
    key a group is sorted once and its first and last rows are aggregated.
    """
    checked_keys(df.schema, keys)
    key = F.struct(*[k.column().alias(k.name) for k in keys])
    if all(not k.descending for k in keys):
        rank = F.struct(*[x for k in keys for x in (F.when(k.column().isNull(), 0 if k.nulls_first else 2).otherwise(1).alias(f"n_{k.name}"), k.column().alias(k.name))])
        return df.groupBy(*by).agg(F.min_by(key, rank).alias("min_key"), F.max_by(key, rank).alias("max_key"), F.count("*").alias("n_rows"))
    if not by:
        end = lambda turned, name: df.orderBy(*orders(turned)).limit(1).select(key.alias(name), F.lit(1).alias("__one"))
        counts = df.agg(F.count("*").alias("n_rows")).withColumn("__one", F.lit(1))
        both = counts.join(end(keys, "min_key"), "__one", "left").join(end([k.reversed() for k in keys], "max_key"), "__one", "left")
        return both.select("min_key", "max_key", "n_rows")
    group = Window.partitionBy(*by)
    placed = df.select(*by, key.alias("__key"), F.row_number().over(group.orderBy(*orders(keys))).alias("__k"), F.count("*").over(group).alias("__n"))
    ends = placed.where("__k = 1 or __k = __n").groupBy(*by)
    one = lambda place: F.first(F.when(F.col("__k") == place, F.col("__key")), ignorenulls=True)
    return ends.agg(one(F.lit(1)).alias("min_key"), one(F.col("__n")).alias("max_key"), F.max("__n").alias("n_rows"))


def output_batches(df: DataFrame, keys: Sequence[SortKey], size: int) -> DataFrame:
    """``pos`` and ``batch`` (from 0): full batches of ``size`` rows in order, the last one short."""
    return with_position(df, keys).withColumn("batch", F.floor((F.col("pos") - 1) / size))


def sorted_groups(df: DataFrame, arrival: Sequence[SortKey], keys: Sequence[SortKey], size: int) -> DataFrame:
    """``group_id`` and ``group_pos``: chunks of ``size`` rows by arrival, each sorted by the keys, ties by arrival."""
    checked_keys(df.schema, keys)
    grouped = with_position(df, arrival, "__at").withColumn("group_id", F.floor((F.col("__at") - 1) / size))
    w = Window.partitionBy("group_id").orderBy(*orders(keys), "__at")
    return grouped.withColumn("group_pos", F.row_number().over(w).cast("long")).drop("__at")


def sorted_groups_by_batch(df: DataFrame, batch_col: str, keys: Sequence[SortKey], size: int) -> DataFrame:
    """As :func:`sorted_groups`, but batches are sorted when they arrive, so a chunk takes the least rows left of a batch."""
    checked_keys(df.schema, keys)
    staged = with_position(df, [SortKey(batch_col), *keys], "__at").withColumn("group_id", F.floor((F.col("__at") - 1) / size))
    w = Window.partitionBy("group_id").orderBy(*orders(keys), "__at")
    return staged.withColumn("group_pos", F.row_number().over(w).cast("long")).drop("__at")


def split_at(df: DataFrame, arrival: Sequence[SortKey], at: int) -> tuple[DataFrame, DataFrame]:
    """The first ``at`` rows and the rest; ``at`` beyond the rows leaves the second part empty."""
    placed = with_position(df, arrival, "__at")
    return placed.where(F.col("__at") <= max(0, at)).drop("__at"), placed.where(F.col("__at") > max(0, at)).drop("__at")
