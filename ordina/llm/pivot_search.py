"""Operator 9: exact top-k inner products over a pivot-distance index.

Largest inner product becomes smallest distance by one more coordinate: with M the greatest length of a vector, a vector
x gets ``sqrt(M^2 - |x|^2)`` and a query 0; then ``|q' - x'|^2 = |q|^2 + M^2 - 2 q.x``.

Index: each vector is keyed by its nearest pivot and its distance to it; equal-width rings of distances round a pivot are
the blocks (a ring with many vectors is dealt to several blocks), each with its exact least and greatest distance.
Search, first round: a query visits the annuli nearest to its own distance from each pivot until k + 1 vectors must
have been seen; its k-th score gives a radius.  Second round: the annuli expand to all others whose triangle-inequality
bound ``|d(q, pivot) - d(x, pivot)|`` is within that radius, and inside a block only the sorted run within it is scored.
Nothing beyond it can enter the answer, so the result is exact whatever the pivots, which come from a bounded sample
(at most PIVOTS rows).

Scores are integers: exact in doubles while they stay below 2^53, and in Python's integers beyond (then kept within a
long).  Null, empty or non-finite vectors and null ids take no part; vectors of different lengths never meet.  Rows of one
id and the same scaled vector count once; different ones under one id all count, as queries (of one list) and as
candidates, but never meet each other.  Ties go to the smaller vec_id; an empty table gives an empty result.  Only the id
and the vector are read, so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table
from .vectors import QUERIES_A_TILE, best_k, in_tiles, matrices, packed, repeats_dropped, tiles, top_rows, unpacked

K, QUERY_EVERY, SCALE, PIVOTS, A_PIVOT, A_BLOCK, RINGS, META_AT_ONCE = 5, 50, 256.0, 256, 2048, 2048, 8, 20_000


def exact_scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer inner products of all rows, as signed longs."""
    if max(np.abs(q).max(initial=0), 1) * max(np.abs(x).max(initial=0), 1) * q.shape[1] < 2**53:
        return (q @ x.T).astype(np.int64)
    wide = [[sum(int(a) * int(b) for a, b in zip(r, c, strict=True)) for c in x] for r in q]
    return np.array([[max(-(2**63), min(2**63 - 1, v)) for v in r] for r in wide], np.int64).reshape(len(q), len(x))


def scaled_vectors(df: DataFrame, scale: float = SCALE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id``, ``dim``, ``raw`` (floor(scale * x) as doubles), ``length2``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, x in matrices(batch):
                x = np.floor(np.clip(x * scale, -1e150, 1e150))
                yield pa.record_batch([pa.array(ids), pa.array(np.full(len(ids), x.shape[1], np.int32)), packed(x), pa.array((x * x).sum(axis=1))], ["vec_id", "dim", "raw", "length2"])

    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("embedding"))
    return repeats_dropped(rows.mapInArrow(work, "vec_id long, dim int, raw binary, length2 double"))


def pivot_table(vectors: DataFrame, n: int) -> dict[int, np.ndarray]:
    """Pivots by length of vectors: at most PIVOTS rows, chosen by a hash of the id."""
    rows = vectors.select("dim", "raw").orderBy(F.xxhash64("vec_id")).limit(max(4, min(PIVOTS, n // A_PIVOT))).collect()
    found: dict[int, list] = {}
    for r in rows:
        found.setdefault(r["dim"], []).append(np.frombuffer(r["raw"], np.float64))
    return {d: np.unique(np.stack(v), axis=0) for d, v in found.items()}


def distances(x: np.ndarray, pivots: np.ndarray, most2: float, queries: bool) -> np.ndarray:
    """Of augmented vectors (queries: last coordinate 0) from augmented pivots."""
    p2, x2 = (pivots**2).sum(axis=1), (x**2).sum(axis=1)
    ps = np.sqrt(np.maximum(0, most2 - p2))
    xs = np.zeros(len(x)) if queries else np.sqrt(np.maximum(0, most2 - x2))
    return np.sqrt(np.maximum(0, x2[:, None] + p2 - 2 * (x @ pivots.T) + (xs[:, None] - ps) ** 2))


class PivotIndex:
    """The index of one table of scaled vectors: ``blocks`` (rows with their block) and ``meta`` (a row for each block)."""

    def __init__(self, vectors: DataFrame):
        self.spark = vectors.sparkSession
        self.vectors = vectors
        top = vectors.agg(F.count("*").alias("n"), F.max("length2").alias("m")).first()
        self.n, self.most2 = top["n"], float(top["m"] or 0)
        self.pivots = pivot_table(vectors, self.n)
        keyed = materialize(self._keyed(vectors), "pivot-keys")
        sizes = keyed.groupBy("dim", "pivot", "ring").agg(F.count("*").alias("n"))
        parts = F.pmod(F.xxhash64("vec_id"), F.ceil(F.col("n") / A_BLOCK)).cast("int").alias("part")
        # A row for each ring round each pivot, of which there are a bounded number: the vectors of a hot ring need not meet.
        self.blocks = keyed.join(F.broadcast(sizes), ["dim", "pivot", "ring"]).select("dim", "pivot", "ring", parts, "vec_id", "raw", "dist")
        self.meta = materialize(self.blocks.groupBy("dim", "pivot", "ring", "part").agg(F.min("dist").alias("lo"), F.max("dist").alias("hi"), F.count("*").alias("n")), "annuli")

    def _keyed(self, vectors: DataFrame) -> DataFrame:
        pivots, most2 = self.pivots, self.most2
        width = max(np.sqrt(most2) / RINGS, 1e-9)

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                dims = batch.column("dim").to_numpy()
                for dim in np.unique(dims).tolist():
                    part = batch.take(pa.array(np.flatnonzero(dims == dim)))
                    x = unpacked(part.column("raw"))
                    d = distances(x, pivots.get(dim, np.zeros((1, dim))), most2, False)
                    near = d.argmin(axis=1)
                    r = d[np.arange(len(x)), near]
                    yield pa.record_batch([part.column("dim"), pa.array(near.astype(np.int32)), pa.array((r // width).astype(np.int32)), part.column("vec_id"), part.column("raw"), pa.array(r)], ["dim", "pivot", "ring", "vec_id", "raw", "dist"])

        return vectors.select("vec_id", "dim", "raw").mapInArrow(work, "dim int, pivot int, ring int, vec_id long, raw binary, dist double")

    def _visits(self, queries: DataFrame, k: int) -> DataFrame:
        """Blocks to visit.  ``queries`` without ``radius``: those nearest until k + 1 vectors are seen; with it: the rest within it.

        The table of blocks (one row for A_BLOCK vectors or ring) is used META_AT_ONCE rows at a time.
        """
        pivots, most2, first = self.pivots, self.most2, "radius" not in queries.columns
        meta = self.meta.toPandas() if self.meta.count() <= META_AT_ONCE else None
        if meta is None:
            return self._visits_by_join(queries, k)
        by_dim = {d: g.reset_index(drop=True) for d, g in meta.groupby("dim")}

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                dims = batch.column("dim").to_numpy()
                for dim in np.unique(dims).tolist():
                    whole = batch.take(pa.array(np.flatnonzero(dims == dim)))
                    m = by_dim[dim]
                    lo, hi, pv, n = (m[c].to_numpy() for c in ("lo", "hi", "pivot", "n"))
                    for at in range(0, whole.num_rows, 256):
                        part = whole.slice(at, 256)
                        d = distances(unpacked(part.column("raw")), pivots.get(dim, np.zeros((1, dim))), most2, True)[:, pv]
                        gap = np.maximum(0, np.maximum(lo - d, d - hi))
                        order = np.argsort(gap + 1e-6 * d, axis=1)
                        seen = np.cumsum(n[order], axis=1) - n[order] < k + 1
                        early = np.zeros_like(seen)
                        np.put_along_axis(early, order, seen, axis=1)
                        pick = early if first else ~early & (gap <= part.column("radius").to_numpy()[:, None])
                        row, col = np.nonzero(pick)
                        got = part.take(pa.array(row))
                        columns = [got.column("dim"), *[pa.array(m[c].to_numpy()[col].astype(np.int32)) for c in ("pivot", "ring", "part")], got.column("vec_id"), got.column("raw"), pa.array(d[row, col]), pa.array(np.full(len(row), np.inf)) if first else got.column("radius")]
                        yield pa.record_batch(columns, ["dim", "pivot", "ring", "part", "vec_id", "raw", "own", "radius"])

        return queries.mapInArrow(work, "dim int, pivot int, ring int, part int, vec_id long, raw binary, own double, radius double")

    def _visits_by_join(self, queries: DataFrame, k: int) -> DataFrame:
        """For more blocks than are held at once: every block within the radius, by an equi-join on (dim, pivot); the first round takes the query's nearest ring round each pivot that has k + 1 vectors."""
        pivots, most2, first = self.pivots, self.most2, "radius" not in queries.columns

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                dims = batch.column("dim").to_numpy()
                for dim in np.unique(dims).tolist():
                    part = batch.take(pa.array(np.flatnonzero(dims == dim)))
                    d = distances(unpacked(part.column("raw")), pivots.get(dim, np.zeros((1, dim))), most2, True)
                    row, col = np.divmod(np.arange(d.size), d.shape[1])
                    got = part.take(pa.array(row))
                    yield pa.record_batch([got.column("dim"), pa.array(col.astype(np.int32)), got.column("vec_id"), got.column("raw"), pa.array(d.ravel()), pa.array(np.full(len(row), np.inf)) if first else got.column("radius")], ["dim", "pivot", "vec_id", "raw", "own", "radius"])

        rows = queries.mapInArrow(work, "dim int, pivot int, vec_id long, raw binary, own double, radius double")
        gap = F.greatest(F.lit(0.0), F.col("lo") - F.col("own"), F.col("own") - F.col("hi"))
        joined = rows.join(self.meta, ["dim", "pivot"])
        if first:
            near = rows.join(self.meta.where(F.col("n") > k), ["dim", "pivot"]).groupBy("vec_id").agg(F.min_by(F.struct("pivot", "ring", "part"), gap).alias("home"))
            joined = joined.join(near, "vec_id").where((F.col("pivot") == F.col("home.pivot")) & (F.col("ring") == F.col("home.ring")) & (F.col("part") == F.col("home.part")))
        else:
            joined = joined.where(gap <= F.col("radius"))
        return joined.select("dim", "pivot", "ring", "part", "vec_id", "raw", "own", "radius")

    def _scored(self, visits: DataFrame, down: int, k: int) -> DataFrame:
        visits = visits.withColumn("down", F.pmod(F.xxhash64("vec_id"), F.lit(down)).cast("int"))
        data = self.blocks.withColumn("down", F.explode(F.sequence(F.lit(0), F.lit(down - 1))))

        def work(q: pa.Table, d: pa.Table) -> pa.Table:
            """long"""
            d = d.take(pa.array(np.argsort(d.column("dist").to_numpy(), kind="stable")))
            qv, dv, r = unpacked(q.column("raw")), unpacked(d.column("raw")), d.column("dist").to_numpy()
            qid, did, own, radius = (t.column(c).to_numpy() for t, c in ((q, "vec_id"), (d, "vec_id"), (q, "own"), (q, "radius")))
            start, end = np.searchsorted(r, own - radius, side="left"), np.searchsorted(r, own + radius, side="right")
            out = []
            for at in range(0, len(qid), 128):
                a, b = start[at : at + 128], end[at : at + 128]
                lo, hi = int(a.min()), int(b.max())
                if hi <= lo:
                    continue
                score, place = exact_scores(qv[at : at + 128], dv[lo:hi]), np.arange(lo, hi)
                row, col = np.nonzero((place >= a[:, None]) & (place < b[:, None]) & (did[lo:hi] != qid[at : at + 128, None]))
                keep = top_rows(row, score[row, col], did[lo + col], k)
                out.append((qid[at + row[keep]], did[lo + col[keep]], score[row[keep], col[keep]]))
            x, y, s = (np.concatenate(v) for v in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3
            return pa.table({"query_id": pa.array(x), "vec_id": pa.array(y), "score": pa.array(s)})

        return in_tiles(visits, data, ["dim", "pivot", "ring", "part", "down"], work)

    def top(self, queries: DataFrame, k: int = K) -> DataFrame:
        """``queries``: rows of :func:`scaled_vectors`.  ``query_id``, ``rank``, ``vec_id``, ``score``."""
        queries = queries.select("vec_id", "dim", "raw", "length2")
        down = tiles(queries.count(), QUERIES_A_TILE, QUERIES_A_TILE, 1)
        early = materialize(best_k(self._scored(self._visits(queries, k), down, k), k), "early")
        marks = early.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("mark"))
        # Squared distances are differences of sums of about most2; each is off by some most2 * 2^-50, its root by at most
        # the root of that, which is below 1e-7 of the greatest length.  The radius is widened by more.
        reach = F.sqrt(F.greatest(F.lit(0.0), F.col("length2") + self.most2 - 2 * F.col("mark"))) * (1 + 1e-9) + 1e-5 + 3e-7 * self.most2**0.5
        wider = queries.join(marks, "vec_id", "left").withColumn("radius", F.when(F.col("mark").isNull(), float("inf")).otherwise(reach))
        late = self._scored(self._visits(wider.select("vec_id", "dim", "raw", "radius"), k), down, k)
        return best_k(early.select("query_id", "vec_id", "score").unionByName(late).distinct(), k)


def op9_pivot_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = materialize(scaled_vectors(table(spark, sf_dir, "embeddings")), "scaled-vectors")
    return PivotIndex(vectors).top(vectors.where(f"vec_id % {QUERY_EVERY} = 0"))
