"""Queries of the ordering operators over the driver's tables, and their SQL.

Order is made visible as values (positions, runs, groups), and every position breaks ties by all other columns.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.keys import SortKey
from ..operators import check, merge
from ..operators.sort import extremes, output_batches, sort_runs, sorted_groups, sorted_groups_by_batch, split_at, with_position
from ..sources.parquet import declared_spec, scan_in_order, write_sorted, write_sorted_groups, write_with_footer
from ..streaming.writer import SortingWriter, WriterOptions
from .progress import progress_frame
from .runs import FlushThreshold, assign_runs, estimated_bytes

BATCH = 1024
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

LINEITEM = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")
ORDERS = ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
EVENTS = ("event_id", "ts", "user_id", "event_type", "value", "props")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _sql_order(keys: list[SortKey], columns: tuple[str, ...]) -> str:
    named = {k.name for k in keys}
    parts = [f"{k.name} {'DESC' if k.descending else 'ASC'} NULLS {'FIRST' if k.nulls_first else 'LAST'}" for k in keys]
    return ", ".join([*parts, *(f"{c} ASC NULLS LAST" for c in columns if c not in named)])


def _add(name: str, query: Callable[[SparkSession, str], DataFrame], sql: str | None) -> None:
    QUERIES[name] = query
    if sql:
        ORACLES[name] = sql


def _sorted(name: str, table: str, columns: tuple[str, ...], keys: list[SortKey], shown: tuple[str, ...], derived: dict[str, str] | None = None) -> None:
    derived = derived or {}
    everything = (*columns, *derived)

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = _table(spark, sf_dir, table).select(*columns, *[F.expr(e).alias(c) for c, e in derived.items()])
        return with_position(df, keys).select(*shown, "pos")

    extra = "".join(f", {e} AS {c}" for c, e in derived.items())
    _add(name, query, f"WITH t AS (SELECT {', '.join(columns)}{extra} FROM {table}) SELECT {', '.join(shown)}, row_number() OVER (ORDER BY {_sql_order(keys, everything)}) AS pos FROM t")


_KEYS = [SortKey("l_shipdate"), SortKey("l_orderkey"), SortKey("l_linenumber")]
_sorted("sort_global_multi", "lineitem", LINEITEM, _KEYS, ("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice"))
_sorted("sort_desc_multi", "lineitem", LINEITEM, [SortKey("l_quantity", True), SortKey("l_returnflag", True)], ("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag"))
for _d in (False, True):
    for _n in (False, True):
        _sorted(f"sort_{'desc' if _d else 'asc'}_nulls_{'first' if _n else 'last'}", "lineitem", LINEITEM, [SortKey("q", _d, _n), SortKey("f", not _d, not _n)], ("l_orderkey", "l_linenumber", "q", "f"), {"q": "CASE WHEN l_linenumber = 1 THEN NULL ELSE l_quantity END", "f": "CASE WHEN l_returnflag = 'N' THEN NULL ELSE l_returnflag END"})
_sorted("sort_by_int", "lineitem", LINEITEM, [SortKey("l_linenumber")], ("l_orderkey", "l_linenumber"))
_sorted("sort_by_bigint", "orders", ORDERS, [SortKey("o_custkey", True)], ("o_orderkey", "o_custkey"))
_sorted("sort_by_double", "orders", ORDERS, [SortKey("o_totalprice")], ("o_orderkey", "o_totalprice"))
_sorted("sort_by_string", "orders", ORDERS, [SortKey("o_orderpriority"), SortKey("o_orderstatus", True)], ("o_orderkey", "o_orderpriority"))
_sorted("sort_by_text", "documents", ("doc_id", "text"), [SortKey("text")], ("doc_id",))
_sorted("sort_by_timestamp", "events", EVENTS, [SortKey("ts", True)], ("event_id",))
_sorted("sort_by_boolean", "orders", ORDERS, [SortKey("dear", True)], ("o_orderkey", "dear"), {"dear": "o_totalprice > 100000"})
_sorted("sort_by_array", "embeddings", ("vec_id", "embedding", "label"), [SortKey("embedding")], ("vec_id",))
_sorted("sort_event_stream", "events", EVENTS, [SortKey("event_type"), SortKey("ts"), SortKey("event_id")], ("event_id", "event_type"))


def merge_sorted_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "lineitem").withColumn("run_id", F.col("l_orderkey") % 8)
    merged = merge.union_runs([rows.where("run_id < 4"), rows.where("run_id >= 4")])
    return with_position(merged, _KEYS).select("l_orderkey", "l_linenumber", "run_id", "pos")


_add("merge_sorted_runs", merge_sorted_runs, f"SELECT l_orderkey, l_linenumber, l_orderkey % 8 AS run_id, row_number() OVER (ORDER BY {_sql_order(_KEYS, LINEITEM)}) AS pos FROM lineitem")


def sort_within_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 8).alias("run_id"), "o_totalprice", "o_orderkey")
    placed = sort_runs(rows, [SortKey("o_totalprice", True), SortKey("o_orderkey")], "run_id").withColumn("at", F.monotonically_increasing_id())
    return placed.select("run_id", "o_orderkey", F.row_number().over(Window.partitionBy("run_id").orderBy("at")).cast("long").alias("pos"))


_add("sort_within_runs", sort_within_runs, "SELECT o_orderkey % 8 AS run_id, o_orderkey, row_number() OVER (PARTITION BY o_orderkey % 8 ORDER BY o_totalprice DESC NULLS LAST, o_orderkey) AS pos FROM orders")


def run_extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "orders").withColumn("run_id", F.col("o_orderkey") % 16)
    found = merge.run_manifest(rows, [SortKey("o_custkey"), SortKey("o_orderkey")], "run_id")
    return found.select("run_id", F.col("min_key.o_custkey").alias("lo_cust"), F.col("min_key.o_orderkey").alias("lo_order"), F.col("max_key.o_custkey").alias("hi_cust"), F.col("max_key.o_orderkey").alias("hi_order"), "n_rows")


_add("run_extremes", run_extremes, """WITH t AS (SELECT o_orderkey % 16 AS run_id, o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_orderkey % 16 ORDER BY o_custkey, o_orderkey) AS k, count(*) OVER (PARTITION BY o_orderkey % 16) AS n FROM orders)
SELECT run_id, max(CASE WHEN k = 1 THEN o_custkey END) AS lo_cust, max(CASE WHEN k = 1 THEN o_orderkey END) AS lo_order, max(CASE WHEN k = n THEN o_custkey END) AS hi_cust, max(CASE WHEN k = n THEN o_orderkey END) AS hi_order, max(n) AS n_rows FROM t GROUP BY run_id""")


def run_extremes_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 4).alias("run_id"), F.expr("CASE WHEN o_orderstatus = 'O' THEN NULL ELSE o_totalprice END").alias("price"), "o_orderkey")
    found = extremes(rows, [SortKey("price", True, True), SortKey("o_orderkey")], ["run_id"])
    return found.select("run_id", F.col("min_key.price").alias("first_price"), F.col("min_key.o_orderkey").alias("first_order"), F.col("max_key.price").alias("last_price"), F.col("max_key.o_orderkey").alias("last_order"), "n_rows")


_add("run_extremes_mixed", run_extremes_mixed, """WITH s AS (SELECT o_orderkey % 4 AS run_id, CASE WHEN o_orderstatus = 'O' THEN NULL ELSE o_totalprice END AS price, o_orderkey FROM orders),
t AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY price DESC NULLS FIRST, o_orderkey) AS k, count(*) OVER (PARTITION BY run_id) AS n FROM s)
SELECT run_id, max(CASE WHEN k = 1 THEN price END) AS first_price, max(CASE WHEN k = 1 THEN o_orderkey END) AS first_order, max(CASE WHEN k = n THEN price END) AS last_price, max(CASE WHEN k = n THEN o_orderkey END) AS last_order, max(n) AS n_rows FROM t GROUP BY run_id""")


def run_extremes_null_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "orders").select(F.expr("CASE WHEN o_orderkey % 5 > 0 THEN o_orderkey % 5 END").alias("run_id"), "o_totalprice", "o_orderkey")
    found = extremes(rows, [SortKey("o_totalprice", True), SortKey("o_orderkey")], ["run_id"])
    return found.select("run_id", F.col("min_key.o_orderkey").alias("first_order"), F.col("max_key.o_orderkey").alias("last_order"), "n_rows")


_add("run_extremes_null_group", run_extremes_null_group, """WITH s AS (SELECT CASE WHEN o_orderkey % 5 > 0 THEN o_orderkey % 5 END AS run_id, o_totalprice, o_orderkey FROM orders),
t AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY o_totalprice DESC NULLS LAST, o_orderkey) AS k, count(*) OVER (PARTITION BY run_id) AS n FROM s)
SELECT run_id, max(CASE WHEN k = 1 THEN o_orderkey END) AS first_order, max(CASE WHEN k = n THEN o_orderkey END) AS last_order, max(n) AS n_rows FROM t GROUP BY run_id""")


def _batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _table(spark, sf_dir, "events").select(*EVENTS)
    return events.groupBy(F.floor(F.col("event_id") / BATCH).alias("batch_no")).agg(F.count("*").alias("n_rows"), F.sum(estimated_bytes(events.schema)).alias("n_bytes"))


_BATCH_SQL = f"b AS (SELECT cast(floor(event_id / {BATCH}) AS BIGINT) AS batch_no, count(*) AS n_rows, cast(sum(32 + strlen(event_type) + strlen(props)) AS BIGINT) AS n_bytes FROM events GROUP BY 1), o AS (SELECT *, row_number() OVER (ORDER BY batch_no) AS k FROM b)"


def _assigned(name: str, threshold: FlushThreshold) -> None:
    tests = [f"{c} >= {m}" for c, m in (("{r}", threshold.max_rows), ("{s}", threshold.max_bytes)) if m is not None]
    full = lambda r, s: "(" + " OR ".join(tests).format(r=r, s=s) + ")"
    sql = f"""WITH RECURSIVE {_BATCH_SQL},
f AS (SELECT k, batch_no, n_rows, n_bytes, cast(0 AS BIGINT) AS run_id, n_rows AS r, n_bytes AS s FROM o WHERE k = 1
UNION ALL SELECT o.k, o.batch_no, o.n_rows, o.n_bytes, f.run_id + CASE WHEN {full('f.r', 'f.s')} THEN 1 ELSE 0 END, CASE WHEN {full('f.r', 'f.s')} THEN 0 ELSE f.r END + o.n_rows, CASE WHEN {full('f.r', 'f.s')} THEN 0 ELSE f.s END + o.n_bytes FROM f JOIN o ON o.k = f.k + 1)
SELECT batch_no, n_rows, n_bytes, run_id FROM f"""
    _add(name, lambda spark, sf_dir: assign_runs(_batches(spark, sf_dir), threshold), sql)


_assigned("run_assignment_rows", FlushThreshold.rows(2500))
_assigned("run_assignment_bytes", FlushThreshold.bytes(200_000))
_assigned("run_assignment_either", FlushThreshold.either(3000, 150_000))


def run_overlap_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "orders").withColumn("run_id", F.floor(F.col("o_orderkey") / 400) * 2 + (F.col("o_orderkey") % 7 == 0).cast("int"))
    found = merge.run_manifest(rows, [SortKey("o_orderkey")], "run_id")
    return merge.overlap_clusters(found.select("run_id", F.col("min_key.o_orderkey").alias("lo"), F.col("max_key.o_orderkey").alias("hi")))


_add("run_overlap_clusters", run_overlap_clusters, """WITH m AS (SELECT cast(floor(o_orderkey / 400) AS BIGINT) * 2 + CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 0 END AS run_id, min(o_orderkey) AS lo, max(o_orderkey) AS hi FROM orders GROUP BY 1),
p AS (SELECT *, max(hi) OVER (ORDER BY lo, hi, run_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS most FROM m)
SELECT run_id, lo, hi, cast(sum(CASE WHEN most IS NULL OR lo > most THEN 1 ELSE 0 END) OVER (ORDER BY lo, hi, run_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cluster FROM p""")


def output_row_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = output_batches(_table(spark, sf_dir, "lineitem"), _KEYS, 10_000)
    return done.groupBy("batch").agg(F.count("*").alias("n_rows"), F.min("pos").alias("lo"), F.max("pos").alias("hi"), F.sum("l_orderkey").alias("orderkeys"))


_add("output_row_groups", output_row_groups, f"""WITH t AS (SELECT l_orderkey, row_number() OVER (ORDER BY {_sql_order(_KEYS, LINEITEM)}) AS pos FROM lineitem)
SELECT cast(floor((pos - 1) / 10000) AS BIGINT) AS batch, count(*) AS n_rows, min(pos) AS lo, max(pos) AS hi, cast(sum(l_orderkey) AS BIGINT) AS orderkeys FROM t GROUP BY 1""")


def sorted_groups_arrival(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sorted_groups(_table(spark, sf_dir, "events"), [SortKey("event_id")], [SortKey("user_id"), SortKey("value", True)], 1500).select("event_id", "group_id", "group_pos")


_add("sorted_groups_arrival", sorted_groups_arrival, """WITH a AS (SELECT *, row_number() OVER (ORDER BY event_id) AS arr FROM events), g AS (SELECT *, cast(floor((arr - 1) / 1500) AS BIGINT) AS group_id FROM a)
SELECT event_id, group_id, row_number() OVER (PARTITION BY group_id ORDER BY user_id NULLS LAST, value DESC NULLS LAST, arr) AS group_pos FROM g""")


def sorted_groups_batch_aware(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "events").select(F.floor(F.col("event_id") / BATCH).alias("b"), "user_id", "event_id")
    return sorted_groups_by_batch(rows, "b", [SortKey("user_id"), SortKey("event_id")], 1500).select("event_id", "group_id", "group_pos")


_add("sorted_groups_batch_aware", sorted_groups_batch_aware, f"""WITH a AS (SELECT event_id, user_id, row_number() OVER (ORDER BY cast(floor(event_id / {BATCH}) AS BIGINT), user_id NULLS LAST, event_id) AS arr FROM events), g AS (SELECT *, cast(floor((arr - 1) / 1500) AS BIGINT) AS group_id FROM a)
SELECT event_id, group_id, row_number() OVER (PARTITION BY group_id ORDER BY user_id NULLS LAST, event_id) AS group_pos FROM g""")


def split_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = split_at(_table(spark, sf_dir, "events"), [SortKey("event_id")], 700)
    return left.select("event_id", F.lit("left").alias("side")).unionByName(right.select("event_id", F.lit("right").alias("side")))


_add("split_batch", split_batch, "SELECT event_id, CASE WHEN row_number() OVER (ORDER BY event_id) <= 700 THEN 'left' ELSE 'right' END AS side FROM events")

_EVENT_KEYS = [SortKey("event_type"), SortKey("value", True)]


def order_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = check.violations(_table(spark, sf_dir, "events"), [SortKey("event_id")], _EVENT_KEYS, chunk=1000)
    return found.select("pos", F.col("key_index").cast("long").alias("key_index"), F.col("prev.event_type").alias("prev_type"), F.col("cur.event_type").alias("cur_type"))


_LAG = "WITH l AS (SELECT row_number() OVER w AS pos, lag(event_type) OVER w AS pt, lag(value) OVER w AS pv, event_type, value FROM events WINDOW w AS (ORDER BY event_id))"
_BAD = "pos > 1 AND (pt > event_type OR (pt = event_type AND pv < value))"
_add("order_violations", order_violations, f"{_LAG} SELECT pos, cast(CASE WHEN pt > event_type THEN 0 ELSE 1 END AS BIGINT) AS key_index, pt AS prev_type, event_type AS cur_type FROM l WHERE {_BAD}")


def first_violation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return check.first_violation(_table(spark, sf_dir, "events"), [SortKey("event_id")], [SortKey("event_type")], chunk=1000)


_add("first_violation", first_violation, f"{_LAG} SELECT pos, 'event_type' AS column, pt AS previous, event_type AS current FROM l WHERE pos > 1 AND pt > event_type ORDER BY pos LIMIT 1")


def finish_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "orders")
    batches = rows.groupBy(F.floor(F.col("o_orderkey") / BATCH).alias("batch_no")).agg(F.count("*").alias("n_rows"), F.lit(0).alias("n_bytes"))
    runs = assign_runs(batches, FlushThreshold.rows(2000)).agg(F.max("run_id")).first()[0] + 1
    sizes = output_batches(rows, [SortKey("o_orderkey")], 4000).groupBy("batch").agg(F.count("*").alias("n_rows"))
    return progress_frame(sizes, runs)


_add("finish_progress", finish_progress, f"""WITH RECURSIVE o AS (SELECT *, row_number() OVER (ORDER BY batch_no) AS k FROM (SELECT cast(floor(o_orderkey / {BATCH}) AS BIGINT) AS batch_no, count(*) AS n FROM orders GROUP BY 1)),
f AS (SELECT k, cast(0 AS BIGINT) AS run_id, n AS r FROM o WHERE k = 1 UNION ALL SELECT o.k, f.run_id + CASE WHEN f.r >= 2000 THEN 1 ELSE 0 END, CASE WHEN f.r >= 2000 THEN 0 ELSE f.r END + o.n FROM f JOIN o ON o.k = f.k + 1),
t AS (SELECT cast(floor((row_number() OVER (ORDER BY o_orderkey) - 1) / 4000) AS BIGINT) AS batch FROM orders), b AS (SELECT batch, count(*) AS n FROM t GROUP BY 1),
c AS (SELECT batch, cast(sum(n) OVER (ORDER BY batch) AS BIGINT) AS rows_written, row_number() OVER (ORDER BY batch) AS batches_written, cast(sum(n) OVER () AS BIGINT) AS total_rows FROM b)
SELECT *, (SELECT max(run_id) + 1 FROM f) AS num_runs, 'Merging' AS phase, cast(rows_written AS DOUBLE) / total_rows AS fraction_complete FROM c""")


def _folder(spark: SparkSession, name: str) -> str:
    """A new place for what a round trip writes: in the shared folder, or in a private one where none is set and the master is local."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = tempfile.mkdtemp(prefix="ordina-")
    return f"{shared}/{name}-{uuid.uuid4().hex}"


def _in_file_order(spark: SparkSession, path: str, column: str) -> DataFrame:
    """What was written, with each row's place in the order of files and of rows in them."""
    placed = with_position(scan_in_order(spark, path).select(column, "__file", "__row"), [SortKey("__file"), SortKey("__row")])
    return placed.select(column, "pos")


def roundtrip_sorted_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches through the writer and its runs, and the result read back in file order."""
    rows, path = _table(spark, sf_dir, "orders"), _folder(spark, "sorted")
    writer = SortingWriter(spark, path, rows.schema, [SortKey("o_totalprice", True), SortKey("o_orderkey")], WriterOptions(FlushThreshold.rows(4000)))
    for i in range(3):
        writer.write(rows.where(F.col("o_orderkey") % 3 == i))
    writer.finish()
    return _in_file_order(spark, path, "o_orderkey")


_add("roundtrip_sorted_write", roundtrip_sorted_write, "SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC NULLS LAST, o_orderkey) AS pos FROM orders")


def roundtrip_sorted_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file, written by the plain sink."""
    path = _folder(spark, "sorted-file")
    write_sorted(_table(spark, sf_dir, "events"), path, [SortKey("event_type", True), SortKey("event_id")], one_file=True, row_group=1000)
    return _in_file_order(spark, path, "event_id")


_add("roundtrip_sorted_file", roundtrip_sorted_file, "SELECT event_id, row_number() OVER (ORDER BY event_type DESC NULLS LAST, event_id) AS pos FROM events")


def roundtrip_sorted_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of 1500 rows by arrival, each sorted, read back in file order."""
    path = _folder(spark, "sorted-groups")
    write_sorted_groups(_table(spark, sf_dir, "events"), path, [SortKey("user_id"), SortKey("event_id")], 1500, [SortKey("event_id")])
    return _in_file_order(spark, path, "event_id")


_add("roundtrip_sorted_groups", roundtrip_sorted_groups, """WITH g AS (SELECT event_id, user_id, cast(floor((row_number() OVER (ORDER BY event_id) - 1) / 1500) AS BIGINT) AS group_id FROM events)
SELECT event_id, row_number() OVER (ORDER BY group_id, user_id NULLS LAST, event_id) AS pos FROM g""")


def roundtrip_footer_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file with its keys in the footer, read back by the order that the footer declares."""
    path = _folder(spark, "footer") + ".parquet"
    write_with_footer(_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), path, [SortKey("o_custkey"), SortKey("o_orderkey")], 2000)
    return with_position(spark.read.parquet(path), declared_spec(spark, path)).select("o_orderkey", "pos")


_add("roundtrip_footer_file", roundtrip_footer_file, "SELECT o_orderkey, row_number() OVER (ORDER BY o_custkey NULLS LAST, o_orderkey) AS pos FROM orders")


def total_rows_by_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "lineitem").groupBy((F.col("l_orderkey") % 8).alias("run_id")).agg(F.count("*").alias("n_rows"))


_add("total_rows_by_run", total_rows_by_run, "SELECT l_orderkey % 8 AS run_id, count(*) AS n_rows FROM lineitem GROUP BY 1")
