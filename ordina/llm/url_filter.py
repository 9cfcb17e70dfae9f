"""Operator 10 (native): URL rules by a sorted sweep over reversed hosts.

A rule (host, path, verdict) fits its host and all subdomains when the url's path starts with the rule's path; of those
that fit the longest host + path wins, then the longer host, then the smaller text.  Hosts become keys
``reversed labels + '.'``: the hosts under a rule are then the interval of keys that start with the rule's key, and
intervals nest.  Distinct hosts are cut into ranges of keys, and sorted there with the rule hosts whose interval meets the
range; the sweep keeps, for each depth of nesting, the rule host opened last, which is the stack of active rules once those
that no longer cover the key are dropped.  Urls then meet their host's stack by an equi-join (which Spark may split when one host is very common)
and the paths of the stack are compared.

Null url, or one without ``://``: host and path are empty and no rule fits.  Repeated rows: each is judged by itself.
Repeated rules count once; rules with a null host, path or verdict are ignored.  No rules: everything gets the default.
Other columns of the input are kept, whatever their names; those named like the added ones are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, restored, shielded, table

#: The rules of the query.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
ADDED = ("host", "path", "rule", "verdict")


def parse(url: Column) -> tuple[Column, Column]:
    """Host and path of a url column."""
    whole = F.lit(2**31 - 1)
    rest = F.when(F.instr(url, "://") > 0, F.substring_index(F.substring(url, F.instr(url, "://") + 3, whole), "#", 1))
    rest = F.coalesce(F.substring_index(rest, "?", 1), F.lit(""))
    host = F.substring_index(rest, "/", 1)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return lower, F.substring(rest, F.length(host) + 1, whole)


def host_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def sweep(hosts: DataFrame, rules: DataFrame, per_range: int = 100_000) -> DataFrame:
    """``hosts``: distinct ``host``.  ``rules``: ``host``, ``path``, ``verdict``.  Returns ``host`` and its ``stack`` of rules.

    Ranges of about ``per_range`` keys decide where work goes, not the result; a rule host that reaches into several ranges
    is opened in each.
    """
    opened = rules.distinct().groupBy("host").agg(F.sort_array(F.collect_list(F.struct("path", "verdict"))).alias("own"))
    opened = opened.select(host_key(F.col("host")).alias("key"), F.size(F.split("host", r"\.")).alias("depth"), F.struct("host", "own").alias("open"))
    depths = sorted(r[0] for r in opened.select("depth").distinct().collect())  # a number for each count of labels
    keys = hosts.select("host", host_key(F.col("host")).alias("key"))
    if not depths:
        return keys.select("host", F.expr("cast(array() as array<struct<host:string,own:array<struct<path:string,verdict:string>>>>)").alias("stack"))
    n = max(1, -(-keys.count() // per_range))
    # Bounds of ranges are sampled, so what they gave is written once.
    keys = materialize(keys.repartitionByRange(n, "key").withColumn("range", F.spark_partition_id()), "url-hosts")
    bounds = keys.groupBy("range").agg(F.min("key").alias("lo"), F.max("key").alias("hi"))  # a row for per_range hosts
    bounds = F.array(*[F.struct(*[F.lit(r[c]).alias(c) for c in ("range", "lo", "hi")]) for r in bounds.collect()] or [F.lit(None).cast("struct<range:int,lo:string,hi:string>")])
    meets = lambda r: (r["hi"] >= F.col("key")) & ((r["lo"] <= F.col("key")) | F.startswith(r["lo"], F.col("key")))
    opened = opened.withColumn("range", F.explode(F.transform(F.filter(bounds, meets), lambda r: r["range"])))
    opened = opened.select("range", "key", F.lit(0).alias("kind"), "depth", "open", F.lit(None).cast("string").alias("host"))
    events = opened.unionByName(keys.select("range", "key", F.lit(1).alias("kind"), F.lit(0).alias("depth"), F.lit(None).cast(opened.schema["open"].dataType).alias("open"), "host"))
    so_far = Window.partitionBy("range").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    for d in depths:
        events = events.withColumn(f"slot{d}", F.last(F.when((F.col("kind") == 0) & (F.col("depth") == d), F.struct("key", "open")), ignorenulls=True).over(so_far))
    live = [F.when(F.startswith(F.col("key"), F.col(f"slot{d}.key")), F.col(f"slot{d}.open")) for d in depths]
    return events.where("kind = 1").select("host", F.filter(F.array(*live), lambda x: x.isNotNull()).alias("stack"))


def judge_urls(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` (host + path of the winner, else null) and ``verdict``."""
    rows, names = shielded(pages, ADDED, url=F.col(f"`{url_col}`").cast("string"))
    host, path = parse(F.col("url"))
    urls = rows.withColumns({"host": host, "path": path}).drop("url")
    rules = rules.select("host", "path", "verdict").dropna()
    stacks = sweep(urls.select("host").distinct(), rules).where(F.size("stack") > 0)
    flat = F.flatten(F.transform("stack", lambda s: F.transform(F.filter(s["own"], lambda r: F.startswith(F.col("path"), r["path"])), lambda r: F.struct(
        (F.length(s["host"]) + F.length(r["path"])).alias("n"), F.length(s["host"]).alias("h"), F.concat(s["host"], r["path"]).alias("rule"), r["verdict"].alias("verdict")))))
    out = urls.join(stacks, "host", "left").withColumn("best", F.array_max(flat))
    return restored(out, names, {}, {"host": F.col("host"), "path": F.col("path"), "rule": F.col("best.rule"), "verdict": F.coalesce("best.verdict", F.lit(default))})


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


ORACLE = r"""
WITH u AS (SELECT page_id, coalesce(CASE WHEN contains(url, '://') THEN regexp_extract(substring(url, instr(url, '://') + 3), '^[^?#]*') END, '') AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             substring(rest, length(regexp_extract(rest, '^[^/]*')) + 1) AS path FROM u),
r(rhost, rpath, rverdict) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
m AS (SELECT p.*, rhost || rpath AS rule, rverdict,
             row_number() OVER (PARTITION BY page_id, host, path ORDER BY length(rhost || rpath) DESC, length(rhost) DESC) AS k
      FROM p JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT p.page_id, p.host, p.path, m.rule, coalesce(m.rverdict, 'allow') AS verdict
FROM p LEFT JOIN m ON m.page_id = p.page_id AND m.host = p.host AND m.path = p.path AND m.k = 1
"""
