"""Command lines: ``python -m ordina.cli sort INPUT -o OUTPUT -s key ...`` and ``python -m ordina.cli check INPUT``."""

from __future__ import annotations

import argparse
import os
import sys
import time

from pyspark.sql import SparkSession

from .functions.keys import checked_keys, parse_memory_size, parse_sort_key
from .operators.check import check_path
from .plans.runs import DEFAULT_RUN_ROWS, FlushThreshold
from .sources.parquet import declared_spec, spec_warnings, write_sorted
from .streaming.writer import SortingWriter, WriterOptions


def threshold(rows: int | None, size: int | None) -> FlushThreshold:
    return FlushThreshold(rows if rows or size else DEFAULT_RUN_ROWS, size)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="ordina", description="Sort Parquet data, and check its order.")
    commands = top.add_subparsers(dest="command", required=True)
    for name in ("sort", "check"):
        p = commands.add_parser(name)
        p.add_argument("input")
        p.add_argument("-s", "--sort-columns", action="append", type=parse_sort_key, default=[], metavar="name:asc|desc[:nulls_first]", help="default: the keys that the files declare")
        if name == "sort":
            p.add_argument("-o", "--output", required=True)
            p.add_argument("--max-memory-rows", type=int, help="rows of a sorted run; with this or the next the input goes through runs on disk")
            p.add_argument("--max-memory-bytes", type=parse_memory_size, help="bytes of a sorted run (a number with B, KB, MB or GB)")
            p.add_argument("--row-group", type=int)
            p.add_argument("--one-file", action="store_true")
            p.add_argument("--merge-sort", action="store_true", help="accepted; Spark decides how it spills")
    return top


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    given = parser().parse_args(args)
    if "://" not in given.input and not os.path.exists(given.input):
        print(f"no such file: {given.input}", file=sys.stderr)
        return 2
    spark = spark or SparkSession.builder.appName("ordina").config("spark.sql.caseSensitive", "true").getOrCreate()
    df = spark.read.parquet(given.input)
    keys = checked_keys(df.schema, given.sort_columns or declared_spec(spark, given.input))
    if given.command == "check":
        files = sorted(df.inputFiles())
        for warning in spec_warnings(spark, files) if not given.sort_columns and len(files) > 1 else ():
            print(f"warning: {warning}", file=sys.stderr)
        report = check_path(spark, given.input, keys)
        print(report.text())
        return 0 if report.sorted else 1
    if os.path.abspath(given.output) == os.path.abspath(given.input):
        print("the output is the input", file=sys.stderr)
        return 2
    began = time.time()
    if given.max_memory_rows or given.max_memory_bytes:
        # Each input file is a batch; a run ends with the file that reaches the threshold.
        writer = SortingWriter(spark, given.output, df.schema, keys, WriterOptions(threshold(given.max_memory_rows, given.max_memory_bytes), merge_sort=given.merge_sort))
        for name in sorted(df.inputFiles()):
            writer.write(spark.read.schema(df.schema).parquet(name))
        writer.finish(given.row_group, lambda p: print(f"\r{p.rows_written} of {p.total_rows} rows ({p.fraction_complete:.0%})", end="", file=sys.stderr), given.one_file, "overwrite")
    else:
        write_sorted(df, given.output, keys, given.one_file, given.row_group, mode="overwrite", merge_sort=given.merge_sort)
    print(f"{spark.read.parquet(given.output).count()} rows in {time.time() - began:.1f} s to {given.output}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
