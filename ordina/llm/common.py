"""Helpers shared by the corpus operators: tables, shared storage, Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, read by Spark from wherever ``sf_dir`` is."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``); a private one only where that is unset and the master is local."""
    got = spark.conf.get("spark.checkpoint.dir", None)
    if not got:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        got = getattr(spark, "_ordina_dir", None) or tempfile.mkdtemp(prefix="ordina-")
        spark._ordina_dir = got
    return got


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: lineage ends there, and a lost executor costs nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    got = spark.read.schema(schema).parquet(path)
    got._ordina_path = path
    return got


def drop_tables(*written: DataFrame) -> None:
    """Delete tables of :func:`materialize` that nothing will read again."""
    for df in written:
        spark, path = df.sparkSession, df._ordina_path
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def shielded(df: DataFrame, replaced: Sequence[str] = (), **more: Column) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with its columns under neutral names, and those names by the old ones; columns to be replaced are left out.

    ``more`` are columns of ``df`` to have besides, under the names given.

    So no column of the input can clash with those an operator joins or adds on its way.
    """
    gone = {c.lower() for c in replaced}
    names = {c: f"input{i}__" for i, c in enumerate(df.columns) if c.lower() not in gone}
    return df.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()], *[v.alias(n) for n, v in more.items()]), names


def restored(df: DataFrame, names: dict[str, str], changed: dict[str, Column], added: dict[str, Column]) -> DataFrame:
    """The columns of :func:`shielded` under their old names, some of them ``changed``, and those ``added``."""
    return df.select(*[changed.get(c, F.col(n)).alias(c) for c, n in names.items()], *[v.alias(c) for c, v in added.items()])


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def byte_slices(batch: pa.RecordBatch, column: str, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that ``column`` has about ``most`` bytes in each slice (one row may hold more)."""
    if not batch.num_rows:
        return
    lengths = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), np.int64)
    part = (np.cumsum(lengths) - lengths) // most
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        yield batch.slice(a, b - a)


def text_columns(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text, so that other columns, whatever their names, never reach the operator."""
    return df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))


def joined_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all strings of a column one after the other, and where each begins and ends (n + 1 numbers); null: empty."""
    column = pc.fill_null(column, "").cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit integers."""
    x = x.astype(np.uint64, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    return x ^ (x >> np.uint64(31))


#: A side of a join is broadcast only if its counted rows take at most this; beyond it Spark shuffles, with the same result.
BROADCAST_BYTES = 16 << 20


def small_side(df: DataFrame, row_bytes: Column) -> DataFrame:
    """``df`` (already written) marked for broadcast if the sum of ``row_bytes`` over its rows is small, else as it is."""
    size = df.agg(F.sum(row_bytes.cast("long"))).first()[0] or 0
    return F.broadcast(df) if size <= BROADCAST_BYTES else df
