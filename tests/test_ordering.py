import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from ordina.cli import main, parser
from ordina.errors import NoSortKeys, SchemaMismatch, WriterClosed
from ordina.functions.keys import SortKey, checked_keys, parse_memory_size, parse_sort_key
from ordina.operators.check import check_path, check_sorted, violations
from ordina.operators.merge import merge_runs, merge_runs_with_extremes, overlap_clusters
from ordina.operators.sort import extremes, sort_global, sorted_groups_by_batch, split_at, with_position
from ordina.plans.progress import FinishPhase, FinishProgress, progress_rows
from ordina.plans.runs import FlushThreshold, assign_runs, read_batch_rows, uniform_runs
from ordina.sources.parquet import declared_spec, footer_spec, key_values_of, scan_in_order, spec_of, spec_warnings, total_rows, write_sorted, write_sorted_groups, write_with_footer
from ordina.streaming.writer import SortedGroupsWriter, SortingWriter, WriterOptions, merge_stream_runs, stream_runs

# The small frames in these tests and their orders are facts that any right sort, merge or check gives.
ID = [SortKey("id")]
PEOPLE = "id int, name string"


def frame(spark, rows, schema=PEOPLE):
    return spark.createDataFrame(rows, schema)


def pairs(text):
    return [(int(a), b) for a, b in (x.split(":") for x in text.split())]


def ids(df):
    return [r["id"] for r in df.collect()]


def test_grammar():
    assert parse_sort_key("a:desc:true") == SortKey("a", True, True)
    assert parse_sort_key("a:ASC") == SortKey("a")
    for bad in ("a", "a:up", "a:asc:maybe", ":asc", "a:asc:true:x"):
        with pytest.raises(ValueError):
            parse_sort_key(bad)
    assert [parse_memory_size(x) for x in ("5B", "2kb", "1 MB", "3GB")] == [5, 2048, 1 << 20, 3 << 30]
    for bad in ("5", "1.5MB", "MB", "1TB"):
        with pytest.raises(ValueError):
            parse_memory_size(bad)


def test_keys_are_checked(spark):
    df = spark.sql("select 1 as a, map(1, 2) as m")
    for keys, error in (([], NoSortKeys), ([SortKey("b")], ValueError), ([SortKey("A")], ValueError), ([SortKey("m")], ValueError)):
        with pytest.raises(error):
            checked_keys(df.schema, keys)


def test_every_placement_of_nulls_and_odd_doubles(spark):
    rng = random.Random(3)
    pool = [None, float("nan"), math.inf, -math.inf, 0.0, -0.0, 1.5, -2.0]
    rows = [(rng.choice([None, 1, 2]), rng.choice(pool), i) for i in range(200)]
    df = frame(spark, rows, "a int, b double, i int")
    for da, na, db, nb in itertools.product((False, True), repeat=4):
        keys = [SortKey("a", da, na), SortKey("b", db, nb)]
        placed = with_position(df, keys)
        assert violations(placed, [SortKey("pos")], keys, chunk=37).count() == 0
        assert sorted(r["pos"] for r in placed.collect()) == list(range(1, 201))
    assert violations(df, [SortKey("i")], [SortKey("a")], chunk=7).count() > 0


def test_sort_and_merge(spark):
    assert ids(sort_global(frame(spark, pairs("3:c 1:a 2:b")), ID)) == [1, 2, 3]
    assert ids(sort_global(frame(spark, []), ID)) == []
    a, b = frame(spark, [(1, "wyatt"), (3, "evan"), (5, None)]), frame(spark, [(2, "alice"), (4, "bob"), (6, "david")])
    assert [tuple(r) for r in merge_runs([a, b, frame(spark, [])], ID).collect()] == [(1, "wyatt"), (2, "alice"), (3, "evan"), (4, "bob"), (5, None), (6, "david")]
    with pytest.raises(ValueError):
        merge_runs([], ID)
    with pytest.raises(SchemaMismatch):
        merge_runs([a, b.withColumnRenamed("name", "n")], ID)
    assert ids(merge_runs([a, b.withColumnRenamed("name", "n")], ID, checked=False)) == [1, 2, 3, 4, 5, 6]
    merged, ends = merge_runs_with_extremes([a, b], ID)
    assert merged.count() == 6 and (ends.first()["min_key"]["id"], ends.first()["max_key"]["id"]) == (1, 6)
    none = extremes(frame(spark, []), [SortKey("id", True)]).first()
    assert none["min_key"] is None and none["n_rows"] == 0
    two = frame(spark, [(3, "b"), (1, "c"), (2, "a"), (2, "b")])
    assert [tuple(r) for r in sort_global(two, [SortKey("id", True), SortKey("name", True)]).collect()] == [(3, "b"), (2, "b"), (2, "a"), (1, "c")]


def test_clusters(spark):
    got = overlap_clusters(frame(spark, [(0, 1, 5), (1, 4, 8), (2, 9, 12), (3, 12, 20), (4, 30, 31)], "run_id int, lo int, hi int"))
    assert {r["run_id"]: r["cluster"] for r in got.collect()} == {0: 1, 1: 1, 2: 2, 3: 2, 4: 3}


def test_runs(spark):
    sizes = [3, 2, 3, 2, 7, 1, 1, 1]
    batches = frame(spark, [(i, n, 10 * n) for i, n in enumerate(sizes)], "batch_no long, n_rows long, n_bytes long")
    runs = lambda t, cuts=(): [r["run_id"] for r in assign_runs(batches, t, cuts).orderBy("batch_no").collect()]
    assert runs(FlushThreshold.rows(3)) == [0, 1, 1, 2, 2, 3, 3, 3]
    assert runs(FlushThreshold.bytes(60)) == [0, 0, 0, 1, 1, 2, 2, 2]
    assert runs(FlushThreshold.either(1000, 1)) == list(range(8))
    assert runs(FlushThreshold(), (1, 4)) == [0, 0, 1, 1, 1, 2, 2, 2]
    assert [r[0] for r in spark.range(7).select(uniform_runs(F.col("id"), 1024, 2500)).collect()] == [0, 0, 0, 1, 1, 1, 2]
    assert read_batch_rows(100_000, 3) == 33_333 and read_batch_rows(10, 0) == 1024
    with pytest.raises(ValueError):
        FlushThreshold(None, None)


def test_progress():
    assert progress_rows(5, 2, 0) == []
    got = progress_rows(5, 2, 3)
    assert [p.rows_written for p in got] == [2, 4, 5] and got[-1].fraction_complete == 1.0 and got[0].phase is FinishPhase.MERGING
    assert progress_rows(1, 2, 1)[0].phase is FinishPhase.COPY_THROUGH
    assert FinishProgress(0, 0, 0, 1, FinishPhase.MERGING).fraction_complete == 1.0


def test_groups_and_split(spark):
    rows = [(0, *r) for r in pairs("3:c 1:a 4:d")] + [(1, *r) for r in pairs("2:b 5:e")] + [(2, *r) for r in pairs("6:f 0:z")] + [(3, *r) for r in pairs("8:h 7:g 9:i")] + [(4, 10, "j")]
    got = sorted_groups_by_batch(frame(spark, rows, "b int, id int, name string"), "b", ID, 2).orderBy("group_id", "group_pos").collect()
    assert [r["id"] for r in got] == [1, 3, 2, 4, 0, 5, 6, 7, 8, 9, 10]
    five = frame(spark, [(i, "x") for i in range(1, 6)])
    assert [tuple(d.count() for d in split_at(five, ID, at)) for at in (3, 5, 10)] == [(3, 2), (5, 0), (5, 0)]


def test_sinks(spark, tmp_path):
    import glob

    import pyarrow.parquet as pq

    rows = frame(spark, [(i * 7919 % 1000, str(i)) for i in range(1000)])
    path = str(tmp_path / "one")
    write_sorted(rows, path, [SortKey("id", True)], one_file=True, row_group=100, key_values={"made": "here"})
    (file,) = glob.glob(f"{path}/*.parquet")
    assert pq.ParquetFile(file).num_row_groups == 10 and pq.read_table(file)["id"].to_pylist() == list(range(999, -1, -1))
    back = spark.read.parquet(path)
    assert spec_of(back) == [SortKey("id", True)] and key_values_of(back) == {"made": "here"} and total_rows(spark, path) == 1000
    assert check_path(spark, path, [SortKey("id", True)]).sorted and not check_path(spark, path, ID).sorted
    groups = str(tmp_path / "groups")
    write_sorted_groups(scan_in_order(spark, path), groups, ID, 250)
    for f in glob.glob(f"{groups}/*.parquet"):
        pf = pq.ParquetFile(f)
        for g in range(pf.num_row_groups):
            own = pf.read_row_group(g)["id"].to_pylist()
            assert own == sorted(own) and len(own) == 250
    footer = str(tmp_path / "footer.parquet")
    write_with_footer(rows, footer, ID, 300, {"k": "v"})
    meta = pq.ParquetFile(footer).metadata
    assert meta.num_row_groups == 4 and meta.metadata[b"k"] == b"v" and meta.row_group(0).sorting_columns[0].column_index == 0
    write_sorted(frame(spark, []), str(tmp_path / "empty"), ID)
    assert spark.read.parquet(str(tmp_path / "empty")).count() == 0
    write_sorted(rows, str(tmp_path / "other"), ID)
    assert spec_warnings(spark, [path, path]) == [] and len(spec_warnings(spark, [path, str(tmp_path / "other")])) == 1
    with pytest.raises(NoSortKeys):
        spec_of(rows)


def test_row_groups_of_wide_rows_are_cut_by_rows_alone(spark, tmp_path):
    import glob

    import pyarrow.parquet as pq

    # 150,000 rows of over 1,000 bytes are more than the 128 MB at which a row group would otherwise end.
    rows = spark.range(200_000).selectExpr("id as at", "cast(pmod(xxhash64(id), 1000000) as int) as id", "repeat(sha2(cast(id as string), 512), 8) as name")
    path = str(tmp_path / "wide")
    write_sorted_groups(rows, path, ID, 150_000, [SortKey("at")], compression="none")
    sizes = []
    for f in glob.glob(f"{path}/*.parquet"):
        pf = pq.ParquetFile(f)
        for g in range(pf.num_row_groups):
            own = pf.read_row_group(g, columns=["id", "at"])
            assert own["id"].to_pylist() == sorted(own["id"].to_pylist()) and len({x // 150_000 for x in own["at"].to_pylist()}) == 1
            sizes.append(own.num_rows)
    assert sorted(sizes) == [50_000, 150_000]


def test_footers_of_others_and_of_empty_tables(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    empty, other = str(tmp_path / "empty.parquet"), str(tmp_path / "other.parquet")
    write_with_footer(frame(spark, []), empty, ID)
    assert spark.read.parquet(empty).count() == 0 and footer_spec(empty) == []
    pq.write_table(pa.table({"name": ["b", "a"], "id": [1, 2]}), other, sorting_columns=[pq.SortingColumn(1), pq.SortingColumn(0, True, True)])
    assert declared_spec(spark, other) == [SortKey("id"), SortKey("name", True, True)]
    assert main(["check", other], spark) == 0
    assert list(tmp_path.glob("*.parquet.*")) == []


def test_check_path_over_splits_and_files(spark, tmp_path):
    rng = random.Random(5)
    for turn in range(12):
        values = [rng.choice([None, 1.0, 2.0, float("nan"), -0.0, 0.0]) for _ in range(60)]
        key = SortKey("v", rng.random() < 0.5, rng.random() < 0.5)
        df = frame(spark, [(v, i) for i, v in enumerate(values)], "v double, i int")
        path = str(tmp_path / f"p{turn}")
        (df.repartition(3) if turn % 3 == 0 else df.orderBy(key.order()).coalesce(2) if turn % 3 == 1 else df.coalesce(1)).write.option("parquet.block.row.count.limit", 7).parquet(path)
        placed = scan_in_order(spark, path)
        slow = check_sorted(placed.select("v", "__file", "__row"), [SortKey("__file"), SortKey("__row")], [key])
        assert check_path(spark, path, [key]) == slow, (turn, key)


def test_extremes_of_null_groups(spark):
    df = frame(spark, [(1, 5), (1, 7), (None, 3), (None, None)], "g int, id int")
    got = {r["g"]: (r["min_key"]["id"], r["max_key"]["id"], r["n_rows"]) for r in extremes(df, [SortKey("id", True)], ["g"]).collect()}
    assert got == {1: (7, 5, 2), None: (3, None, 2)}
    assert extremes(df.where("false"), [SortKey("id", True)]).collect()[0]["n_rows"] == 0


def test_writer_counts_bytes_and_deletes_runs(spark, tmp_path):
    w = SortingWriter(spark, str(tmp_path / "out"), frame(spark, []).schema, ID, WriterOptions(FlushThreshold.rows(2)))
    w.write(frame(spark, pairs("3:c 1:a")))
    # A batch that is not deterministic is written as it was counted.
    w.write(spark.range(50).selectExpr("cast(id as int) as id", "cast(rand() as string) as name").where("name < '0.5'"))
    kept = spark.read.parquet(f"{w.run_dir}/run_1.parquet").count()
    assert w.finish() == kept + 2 and w.bytes_written == sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet"))
    assert not list(tmp_path.glob("out.runs*"))


def test_writer_spills_and_merges(spark, tmp_path):
    w = SortingWriter(spark, str(tmp_path / "out"), frame(spark, []).schema, ID, WriterOptions(FlushThreshold.rows(3)))
    for b in ("9:i 7:g 5:e", "3:c 1:a", "8:h 6:f 4:d", "2:b 0:z"):
        w.write(frame(spark, pairs(b)))
    w.write(frame(spark, []))
    assert (w.num_run_files, w.in_progress_rows) == (2, 2)
    with pytest.raises(SchemaMismatch):
        w.write(frame(spark, [(1,)], "id int"))
    told = []
    assert w.finish(row_group=4, handler=told.append, one_file=True) == 10
    assert [p.rows_written for p in told] == [4, 8, 10] and told[0].num_runs == 3
    assert ids(spark.read.parquet(str(tmp_path / "out"))) == list(range(10))
    with pytest.raises(WriterClosed):
        w.write(frame(spark, pairs("1:a")))
    with pytest.raises(NoSortKeys):
        SortingWriter(spark, "x", frame(spark, []).schema, [])
    m = SortingWriter(spark, str(tmp_path / "none"), frame(spark, []).schema, ID)
    m.flush_buffer()
    assert m.finish(handler=told.append) == 0 and len(told) == 3
    g = SortedGroupsWriter(spark, str(tmp_path / "g"), frame(spark, []).schema, ID, 2)
    g.write(frame(spark, pairs("3:c 1:a 4:d")))
    g.flush()
    g.close()
    assert sorted(ids(spark.read.parquet(str(tmp_path / "g")))) == [1, 3, 4]


def test_stream_of_runs(spark, tmp_path):
    src = str(tmp_path / "src")
    for i in range(2):
        frame(spark, [(i + 2 * k, "x") for k in range(5)][::-1]).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(PEOPLE).option("maxFilesPerTrigger", 1).parquet(src)
    query = stream_runs(stream, str(tmp_path / "runs"), ID, str(tmp_path / "cp"))
    query.awaitTermination()
    merge_stream_runs(spark, str(tmp_path / "runs"), str(tmp_path / "all"), ID, one_file=True)
    assert ids(spark.read.parquet(str(tmp_path / "all"))) == list(range(10))


def test_stream_batches_of_several_partitions_are_one_run(spark, tmp_path):
    src = str(tmp_path / "src")
    frame(spark, [(k * 7919 % 1000, "x") for k in range(1000)]).repartition(4).write.parquet(src)
    stream_runs(spark.readStream.schema(PEOPLE).parquet(src), str(tmp_path / "runs"), ID, str(tmp_path / "cp")).awaitTermination()
    assert check_path(spark, str(tmp_path / "runs" / "run_0.parquet"), ID).sorted


def test_check_reports_the_first_differing_key(spark):
    df = frame(spark, [(1, "b"), (1, "a"), (0, "c")]).withColumn("n", F.monotonically_increasing_id())
    found = check_sorted(df, [SortKey("n")], [SortKey("id"), SortKey("name")])
    assert (found.sorted, found.position, found.column, found.previous, found.current) == (False, 2, "name", "b", "a")
    assert check_sorted(df, [SortKey("n")], []).sorted


def test_command_lines(spark, tmp_path, capsys):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    frame(spark, pairs("3:c 1:a 2:b")).write.parquet(src)
    assert main(["sort", src, "-o", out, "-s", "id:desc", "--max-memory-bytes", "1MB", "--merge-sort"], spark) == 0
    assert main(["check", out], spark) == 0
    assert main(["check", out, "-s", "id:asc"], spark) == 1
    assert main(["check", str(tmp_path / "missing")], spark) == 2
    assert main(["sort", src, "-o", src, "-s", "id:asc"], spark) == 2
    assert parser().parse_args(["sort", "a", "-o", "b", "--max-memory-rows", "7"]).max_memory_rows == 7


def test_one_file_is_not_sorted_by_one_task(spark, tmp_path, monkeypatch):
    from ordina.sources import parquet

    monkeypatch.setattr(parquet, "RANGE_BYTES", 4000)
    rows = spark.range(1000).selectExpr("id * 7919 % 1000 as id", "timestamp_seconds(id) as at", "if(id % 3 = 0, null, id % 5) as k")
    keys = [SortKey("k", True), SortKey("id")]
    with parquet.one_ordered_partition(rows, keys) as ordered:
        assert "Sort" not in ordered._jdf.queryExecution().executedPlan().toString() and ordered.rdd.getNumPartitions() == 1
        got = [tuple(r) for r in ordered.collect()]
    assert got == sorted(map(tuple, rows.collect()), key=lambda r: (r[2] is None, -(r[2] or 0), r[0]))
