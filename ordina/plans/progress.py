"""Progress of a merge."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from enum import Enum

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


class FinishPhase(Enum):
    COPY_THROUGH = "CopyThrough"
    MERGING = "Merging"


@dataclass(frozen=True)
class FinishProgress:
    rows_written: int
    batches_written: int
    total_rows: int
    num_runs: int
    phase: FinishPhase

    @property
    def fraction_complete(self) -> float:
        return 1.0 if self.total_rows == 0 else self.rows_written / self.total_rows


Handler = Callable[[FinishProgress], None]


def no_progress(_: FinishProgress) -> None:
    """The handler that does nothing."""


def phase_of(runs: int) -> FinishPhase | None:
    """One run is copied, more are merged; without runs there is nothing to report."""
    return None if runs == 0 else FinishPhase.COPY_THROUGH if runs == 1 else FinishPhase.MERGING


def progress_rows(total: int, batch: int, runs: int) -> list[FinishProgress]:
    """What a handler is told: once after each output batch."""
    phase = phase_of(runs)
    return [] if phase is None else [FinishProgress(min(total, (i + 1) * batch), i + 1, total, runs, phase) for i in range(-(-total // batch))]


def progress_frame(batches: DataFrame, runs: int) -> DataFrame:
    """``batches``: ``batch`` and its ``n_rows`` (a row an output batch).  Adds running totals and the fraction complete."""
    w = Window.orderBy("batch").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows, total = F.sum("n_rows").over(w), F.sum("n_rows").over(Window.partitionBy())
    out = batches.select("batch", rows.alias("rows_written"), F.row_number().over(Window.orderBy("batch")).cast("long").alias("batches_written"), total.alias("total_rows"))
    out = out.withColumn("num_runs", F.lit(runs).cast("long")).withColumn("phase", F.lit(p.value if (p := phase_of(runs)) else None).cast("string"))
    return out.withColumn("fraction_complete", F.when(F.col("total_rows") == 0, 1.0).otherwise(F.col("rows_written") / F.col("total_rows")))
