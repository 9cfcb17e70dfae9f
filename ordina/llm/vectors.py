"""What the two vector searches share: valid vectors as packed rows, tiles of queries against tiles of vectors, best k."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Of one tile of vectors and one tile of queries; together they bound what a task holds.
VECTORS_A_TILE, LEAST_A_TILE, QUERIES_A_TILE = 32_768, 2_048, 4_096


def matrices(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of columns ``vec_id`` and ``embedding``: for each length of vectors, ids and a matrix of doubles.

    Rows with a null id, a null or empty vector, or a null or non-finite component take no part.
    """
    col, ids = batch.column("embedding"), batch.column("vec_id")
    sizes = pc.fill_null(pc.list_value_length(col), 0).to_numpy(zero_copy_only=False)
    usable = (sizes > 0) & np.asarray(pc.is_valid(ids).to_numpy(zero_copy_only=False))
    for n in np.unique(sizes[usable]).tolist():
        at = np.flatnonzero((sizes == n) & usable)
        flat = pc.list_flatten(col.take(pa.array(at)))
        values = pc.fill_null(flat.cast(pa.float64()), float("nan")).to_numpy(zero_copy_only=False).reshape(-1, n)
        good = np.isfinite(values).all(axis=1)
        if good.any():
            yield ids.take(pa.array(at[good])).to_numpy(zero_copy_only=False), np.ascontiguousarray(values[good])


def packed(rows: np.ndarray) -> pa.Array:
    """The rows of a matrix as a binary column."""
    raw, width = np.ascontiguousarray(rows), rows.strides[0] if len(rows) else 0
    width = raw.dtype.itemsize * raw.shape[1]
    offsets = np.arange(len(raw) + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), len(raw), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(raw.tobytes())])


def unpacked(column: pa.ChunkedArray | pa.Array, dtype=np.float64) -> np.ndarray:
    """The matrix again."""
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), dtype).reshape(len(rows), -1)


def repeats_dropped(df: DataFrame) -> DataFrame:
    """Rows of one id and the same vector count once; different vectors under one id all count."""
    return df.dropDuplicates(["vec_id", "raw"])


def tiles(n: int, at_once: int, least: int, slots: int) -> int:
    """How many tiles n rows are dealt to: small ones while there are fewer tiles than task slots, then full ones."""
    return max(1, -(-n // at_once), min(slots, -(-n // least)))


def in_tiles(queries: DataFrame, data: DataFrame, keys: list[str], work: Callable[[pa.Table, pa.Table], pa.Table]) -> DataFrame:
    """``work`` on each tile of queries and tile of vectors with equal ``keys``; gives ``query_id``, ``vec_id``, ``score``."""
    kind = "double" if "double" in (work.__doc__ or "") else "long"

    def guarded(q: pa.Table, d: pa.Table) -> pa.Table:
        if not q.num_rows or not d.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64() if kind == "double" else pa.int64())})
        return work(q, d)

    return queries.groupBy(*keys).cogroup(data.groupBy(*keys)).applyInArrow(guarded, f"query_id long, vec_id long, score {kind}")


def best_k(found: DataFrame, k: int) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: the k highest scores of each query, ties to the smaller vec_id."""
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def top_rows(rows: np.ndarray, scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of each row's k best, of parallel arrays (row, score, id): higher score, then smaller id."""
    order = np.lexsort((ids, -scores, rows))
    sorted_rows = rows[order]
    first = np.searchsorted(sorted_rows, sorted_rows, side="left")
    return order[np.arange(len(order)) - first < k]
