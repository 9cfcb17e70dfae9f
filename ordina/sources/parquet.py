"""Parquet in and out: scans, sort specs in metadata, sorted sinks."""

from __future__ import annotations

import json
import math
import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager, nullcontext

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..errors import NoSortKeys
from ..functions.keys import SortKey, checked_keys, orders, parse_sort_key, total_order
from ..plans.runs import DEFAULT_ROW_GROUP, estimated_bytes

SPEC = "ordina.sort_key"
#: Bytes of rows, by the documented estimate and 16 a column, that one task sorts for a sink of one file.
RANGE_BYTES = 64 << 20


def scan(spark: SparkSession, *paths: str) -> DataFrame:
    """All rows of Parquet files; Spark prunes columns and pushes filters down."""
    return spark.read.parquet(*paths)


def scan_in_order(spark: SparkSession, *paths: str) -> DataFrame:
    """All rows with ``__file`` and ``__row``, which together give the order in which they lie in the files."""
    return spark.read.parquet(*paths).select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row"))


def total_rows(spark: SparkSession, *paths: str) -> int:
    """Rows, from footers alone: the scan reads no column."""
    return spark.read.parquet(*paths).count()


def with_spec(df: DataFrame, keys: Sequence[SortKey], key_values: dict[str, str] | None = None) -> DataFrame:
    """``df`` with its sort keys (and other texts) in its columns' metadata, which Parquet files keep."""
    for i, k in enumerate(checked_keys(df.schema, keys)):
        old = df.schema[k.name].metadata or {}
        df = df.withMetadata(k.name, {**old, SPEC: json.dumps({"place": i, "key": k.text()})})
    if key_values:
        first = df.schema.fields[0]
        df = df.withMetadata(first.name, {**(first.metadata or {}), "ordina.key_values": json.dumps(key_values)})
    return df


def spec_of(df: DataFrame) -> list[SortKey]:
    """The sort keys in the metadata of ``df``'s columns; an error if there are none."""
    found = [(json.loads(f.metadata[SPEC]), f.name) for f in df.schema.fields if SPEC in (f.metadata or {})]
    if not found:
        raise NoSortKeys("the files declare no sort keys")
    keys = [(spec["place"], name, parse_sort_key("x:" + ":".join(spec["key"].rsplit(":", 2)[1:]))) for spec, name in found]
    return [SortKey(name, k.descending, k.nulls_first) for _, name, k in sorted(keys, key=lambda x: x[0])]


def _file_system(path: str):
    """The file system of a path, by pyarrow, and the path there."""
    from pyarrow import fs

    path = path.replace("file:///", "/")
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def footer_spec(path: str) -> list[SortKey]:
    """The ``sorting_columns`` in the footer of one Parquet file (of its first row group), whoever wrote it; [] if there are none.

    Only the footer is read, through pyarrow's file systems.  Keys are top-level columns.
    """
    import pyarrow.parquet as pq

    where, inner = _file_system(path)
    with where.open_input_file(inner) as f:
        meta = pq.ParquetFile(f).metadata
    if not meta.num_row_groups:
        return []
    return [SortKey(meta.schema.column(c.column_index).path.split(".")[0], c.descending, c.nulls_first) for c in meta.row_group(0).sorting_columns]


def declared_spec(spark: SparkSession, path: str) -> list[SortKey]:
    """The sort keys that files declare: by their columns' metadata, or else by the footer of the first file."""
    df = spark.read.parquet(path)
    try:
        return spec_of(df)
    except NoSortKeys:
        for name in sorted(df.inputFiles())[:1]:
            if keys := footer_spec(name.replace("file:///", "/")):
                return keys
        raise


def key_values_of(df: DataFrame) -> dict[str, str]:
    return json.loads((df.schema.fields[0].metadata or {}).get("ordina.key_values", "{}")) if df.schema.fields else {}


def spec_warnings(spark: SparkSession, paths: Sequence[str]) -> list[str]:
    """A warning for each file whose declared keys are not those of the first file."""
    def of(path: str) -> list[SortKey] | None:
        try:
            return declared_spec(spark, path)
        except NoSortKeys:
            return None

    first = of(paths[0])
    return [f"{p}: declares {[k.text() for k in own] if own else 'no keys'}, not those of {paths[0]}" for p in paths[1:] if (own := of(p)) != first]


def group_options(df: DataFrame, rows: int) -> dict[str, str]:
    """Writer options for row groups of ``rows`` rows, whatever their bytes: Parquet also ends a group at a size, so that is raised.

    The size follows from the widest row by the documented estimate; a group is held in memory until it is full.
    """
    widest = df.agg(F.max(estimated_bytes(df.schema))).first()[0] or 0
    size = max(128 << 20, 2 * rows * (widest + 16 * len(df.columns)))
    return {"parquet.block.row.count.limit": str(rows), "parquet.block.size": str(size), "parquet.memory.pool.ratio": "0.95"}


@contextmanager
def one_ordered_partition(df: DataFrame, keys: Sequence[SortKey]) -> Iterator[DataFrame]:
    """``df`` in the keys' order as one partition, for a task that writes one file.

    Up to RANGE_BYTES that task sorts.  More is dealt by ranges of keys (ties by all other columns) to tasks that sort about as
    much each and write it to the shared folder; the one task only reads those files, one after the other, so its memory
    does not grow with the input.  (Coalescing sorted partitions would do, but Spark may take one near the task first.)
    The folder goes at the end.  Reads go through pyarrow's file systems.
    """
    spark, plain = df.sparkSession, df.schema
    size = df.agg(F.sum(estimated_bytes(plain) + 16 * len(df.columns))).first()[0] or 0
    if size <= RANGE_BYTES:
        yield df.coalesce(1).sortWithinPartitions(*orders(keys))
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = tempfile.mkdtemp(prefix="ordina-")
    folder = f"{shared}/ranges-{uuid.uuid4().hex}"
    dealt = df.repartitionByRange(math.ceil(size / RANGE_BYTES), *orders(total_order(df.columns, keys, plain)))
    kind = "spark.sql.parquet.outputTimestampType"
    before = spark.conf.get(kind)
    spark.conf.set(kind, "TIMESTAMP_MICROS")
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    try:
        try:
            dealt.sortWithinPartitions(*orders(keys)).write.parquet(folder)
        finally:
            spark.conf.set(kind, before)
        # Files are named by their range.
        names = sorted(spark.read.parquet(folder).inputFiles(), key=lambda x: x.rsplit("/", 1)[-1])
        yield spark.range(1).coalesce(1).mapInArrow(_reader(names, plain), plain)
    finally:
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def _reader(names: Sequence[str], plain: StructType):
    """What reads the rows of Parquet files in the order of ``names``."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(plain)

    def read(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.parquet as pq

        for _ in batches:
            for name in names:
                where, inner = _file_system(name)
                with where.open_input_file(inner) as f:
                    for batch in pq.ParquetFile(f).iter_batches(8192):
                        yield from pa.Table.from_batches([batch]).cast(schema).to_batches()

    return read


def write_sorted(df: DataFrame, path: str, keys: Sequence[SortKey], one_file: bool = False, row_group: int | None = None, key_values: dict[str, str] | None = None, mode: str = "errorifexists", merge_sort: bool = False, **options: str) -> None:
    """Write all rows in the keys' order: files in range order, or one file (:func:`one_ordered_partition`).

    ``merge_sort`` is accepted and changes nothing: how a sort spills is Spark's business.  An empty input gives a valid
    empty file.  Spark refuses to overwrite a path it reads from.
    """
    checked_keys(df.schema, keys)
    limit = group_options(df, row_group) if row_group else {}
    with one_ordered_partition(df, keys) if one_file else nullcontext(df.orderBy(*orders(keys))) as ordered:
        with_spec(ordered, keys, key_values).write.mode(mode).options(**{**limit, **options}).parquet(path)


def write_sorted_groups(df: DataFrame, path: str, keys: Sequence[SortKey], group_rows: int = DEFAULT_ROW_GROUP, arrival: Sequence[SortKey] | None = None, mode: str = "errorifexists", **options: str) -> None:
    """Write row groups of ``group_rows`` rows by arrival, each sorted by the keys.

    Without ``arrival``, ``df`` must come from :func:`scan_in_order`.  Whole groups stay together in a file: rows are dealt
    by ranges of groups, so many tasks write at once and every row group but the last is full.  A file takes one group, so
    that no row group can reach into two of them.
    """
    from ..operators.sort import with_position

    arrival = arrival or [SortKey("__file"), SortKey("__row")]
    checked_keys(df.schema, keys)
    placed = with_position(df, arrival, "__at").withColumn("__group", F.floor((F.col("__at") - 1) / group_rows))
    ranged = placed.repartitionByRange("__group").sortWithinPartitions("__group", *orders(keys), "__at")
    out = ranged.drop("__at", "__group", *[k.name for k in arrival if k.name.startswith("__")])
    limit = {**group_options(df, group_rows), "maxRecordsPerFile": str(group_rows)}
    with_spec(out, keys).write.mode(mode).options(**{**limit, **options}).parquet(path)


def write_with_footer(df: DataFrame, path: str, keys: Sequence[SortKey], row_group: int = DEFAULT_ROW_GROUP, key_values: dict[str, str] | None = None) -> None:
    """One file with ``sorting_columns`` and key-values in its footer, which Spark's writer cannot set.

    One task streams the sorted rows through pyarrow into a temporary name and renames it at the end; ``path`` must be in
    a file system that this task and its readers share.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    keys, path = checked_keys(df.schema, keys), path.removeprefix("file://")
    names, plain = df.columns, to_arrow_schema(df.schema)

    def write(batches: Iterator) -> Iterator:
        import os
        import uuid

        import pyarrow as pa
        import pyarrow.parquet as pq

        temporary, rows, pending = f"{path}.{uuid.uuid4().hex}", 0, []
        schema = plain.with_metadata({**(plain.metadata or {}), **{k.encode(): v.encode() for k, v in (key_values or {}).items()}})
        places = [pq.SortingColumn(names.index(k.name), k.descending, k.nulls_first) for k in keys]
        os.makedirs(os.path.dirname(temporary) or ".", exist_ok=True)
        try:
            with pq.ParquetWriter(temporary, schema, sorting_columns=places) as writer:
                for batch in batches:
                    rows += batch.num_rows
                    pending.append(pa.Table.from_batches([batch]).cast(schema))
                    held = pa.concat_tables(pending)
                    while held.num_rows >= row_group:
                        writer.write_table(held.slice(0, row_group), row_group_size=row_group)
                        held = held.slice(row_group)
                    pending = [held]
                if pending and pending[0].num_rows:
                    writer.write_table(pending[0], row_group_size=row_group)
            os.replace(temporary, path)
        finally:
            if os.path.exists(temporary):
                os.remove(temporary)
        yield pa.record_batch([pa.array([rows], pa.int64())], ["rows"])

    with one_ordered_partition(df, keys) as ordered:
        written = ordered.mapInArrow(write, "rows long").collect()
    if not written:
        # A frame known to be empty has no task; one row's task writes the empty file.
        df.sparkSession.range(1).coalesce(1).mapInArrow(lambda batches: (x for _ in [list(batches)] for x in write(iter(()))), "rows long").collect()
