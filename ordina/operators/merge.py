"""Merging sorted runs."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import SchemaMismatch
from ..functions.keys import SortKey, checked_keys
from .sort import extremes, sort_global


def same_schema(runs: Sequence[DataFrame]) -> None:
    """Names, types and their order must be equal; whether a column may hold nulls does not count."""
    plain = lambda d: [(f.name, f.dataType.simpleString()) for f in d.schema.fields]
    for i, run in enumerate(runs[1:], 1):
        if plain(run) != plain(runs[0]):
            raise SchemaMismatch(f"run {i} has {plain(run)}, run 0 has {plain(runs[0])}")


def union_runs(runs: Sequence[DataFrame], checked: bool = True) -> DataFrame:
    """All rows of all runs, duplicates kept; empty runs count for nothing."""
    if not runs:
        raise ValueError("no batches to merge")
    if checked:
        same_schema(runs)
    return reduce(DataFrame.union, runs)


def merge_runs(runs: Sequence[DataFrame], keys: Sequence[SortKey], checked: bool = True) -> DataFrame:
    """All rows of the runs in the keys' order.  Spark merges by a range exchange and a sort; runs need not be sorted."""
    return sort_global(union_runs(runs, checked), keys)


def merge_runs_with_extremes(runs: Sequence[DataFrame], keys: Sequence[SortKey], checked: bool = True) -> tuple[DataFrame, DataFrame]:
    """The merged rows, and one row with their first and last key (nulls if all runs are empty)."""
    whole = union_runs(runs, checked)
    return sort_global(whole, keys), extremes(whole, keys)


def run_manifest(df: DataFrame, keys: Sequence[SortKey], run_col: str) -> DataFrame:
    """A row for each run: its first and last key and its rows."""
    checked_keys(df.schema, keys)
    return extremes(df, keys, [run_col])


def overlap_clusters(manifest: DataFrame, lo: str = "lo", hi: str = "hi", ident: str = "run_id") -> DataFrame:
    """Manifest rows with ``cluster``: runs in activation order (by ``lo``), a new cluster where a run starts after all before have ended.

    Runs of different clusters share no key range, so clusters can be merged one by one.  A manifest has one row a run.
    """
    before = Window.orderBy(lo, hi, ident).rowsBetween(Window.unboundedPreceding, -1)
    so_far = Window.orderBy(lo, hi, ident).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = manifest.withColumn("__most", F.max(hi).over(before))
    fresh = F.when(F.col("__most").isNull() | (F.col(lo) > F.col("__most")), 1).otherwise(0)
    return marked.withColumn("__new", fresh).withColumn("cluster", F.sum("__new").over(so_far)).drop("__most", "__new")
