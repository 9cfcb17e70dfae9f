"""Operator 1: approximate nearest neighbours by randomly rotated one-bit codes.

Index: a unit vector is turned by a seeded random rotation; the signs of its D coordinates are packed into D bits, and
``align``, the inner product of the vector with its code (the corner of the cube, scaled to length 1), is the correction
scalar.  For a turned unit query q, ``<code, q> / align`` estimates the cosine without bias; its error is at most
``EPSILON * sqrt((1 - align^2) / align^2 / (D - 1))`` but for a chance that falls with EPSILON squared.

Search: tiles of queries meet tiles of vectors.  In each, a query's k-th highest lower bound is the mark; vectors whose
upper bound reaches it are scored again by the exact cosine of the original vectors in double precision.  The best k of
all tiles are the answer.  Every row is indexed and no candidate list is capped.

Null, empty, zero or non-finite vectors and null ids take no part; vectors of different lengths never meet.  Rows of one id
and the same vector count once; different vectors under one id all count, as queries (of one list) and as candidates, but
never meet each other.  Ties go to the smaller vec_id.  Empty table: empty result.  Only the id and the vector are read, so
other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, partitions, table
from .vectors import LEAST_A_TILE, QUERIES_A_TILE, VECTORS_A_TILE, best_k, in_tiles, matrices, packed, repeats_dropped, tiles, top_rows, unpacked

EPSILON, SEED, K, QUERY_EVERY = 3.0, 7, 5, 50


@lru_cache(maxsize=4)
def rotation(dim: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(SEED + dim).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def encode(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed sign bits and correction scalars of the rows."""
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    turned = unit @ rotation(vectors.shape[1])
    return np.packbits(turned > 0, axis=1), np.abs(turned).sum(axis=1) / np.sqrt(vectors.shape[1])


def error_bound(align: np.ndarray, dim: int) -> np.ndarray:
    spread = np.sqrt(np.maximum(0, 1 - align**2)) / align
    return spread * (min(1.0, EPSILON / np.sqrt(dim - 1)) if dim > 1 else 1.0) + 1e-9


def build_index(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id``, ``dim``, ``raw`` (doubles), ``code`` (bits), ``align`` of every vector that can take part."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, x in matrices(batch):
                size = np.abs(x).max(axis=1)
                ids, x = ids[size > 0], x[size > 0]
                scaled = x / size[size > 0][:, None]  # no overflow or underflow in the norms
                if len(x):
                    code, align = encode(scaled)
                    yield pa.record_batch([pa.array(ids), pa.array(np.full(len(ids), x.shape[1], np.int32)), packed(x), packed(code), pa.array(align)], ["vec_id", "dim", "raw", "code", "align"])

    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("embedding"))
    return repeats_dropped(rows.mapInArrow(work, "vec_id long, dim int, raw binary, code binary, align double"))


def search_tile(q: pa.Table, d: pa.Table, k: int) -> pa.Table:
    """double scores: the best k of one tile of vectors for each query of one tile."""
    qv, dv = unpacked(q.column("raw")), unpacked(d.column("raw"))
    dim = dv.shape[1]
    qid, did = q.column("vec_id").to_numpy(), d.column("vec_id").to_numpy()
    qs, ds = (v / np.abs(v).max(axis=1, keepdims=True) for v in (qv, dv))
    qn, dn = np.linalg.norm(qs, axis=1), np.linalg.norm(ds, axis=1)
    align = d.column("align").to_numpy()
    bits = np.unpackbits(unpacked(d.column("code"), np.uint8), axis=1)[:, :dim].astype(np.float32)
    signs, bound = (2 * bits - 1) / np.float32(np.sqrt(dim)), error_bound(align, dim).astype(np.float32)
    turned, inverse = ((qs / qn[:, None]) @ rotation(dim)).astype(np.float32), (1 / align).astype(np.float32)
    out = []
    for at in range(0, len(qid), 256):
        guess = turned[at : at + 256] @ signs.T * inverse
        lower = guess - bound
        lower[did == qid[at : at + 256, None]] = -np.inf
        most = min(k, len(did))
        mark = np.partition(lower, len(did) - most, axis=1)[:, len(did) - most]
        row, col = np.nonzero(guess + bound >= mark[:, None])
        own = did[col] != qid[at + row]
        row, col = row[own], col[own]
        score = np.empty(len(row))
        for b in range(0, len(row), 1 << 16):
            r, c = at + row[b : b + (1 << 16)], col[b : b + (1 << 16)]
            score[b : b + (1 << 16)] = np.einsum("ij,ij->i", qs[r], ds[c]) / (qn[r] * dn[c])
        keep = top_rows(row, score, did[col], k)
        out.append((qid[at + row[keep]], did[col[keep]], score[keep]))
    a, b, s = (np.concatenate(x) for x in zip(*out, strict=True))
    return pa.table({"query_id": pa.array(a), "vec_id": pa.array(b), "score": pa.array(s)})


def nearest(index: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """``index`` and ``queries``: rows of :func:`build_index`.  ``query_id``, ``rank``, ``vec_id``, ``score`` (cosine)."""
    slots = partitions(index.sparkSession)
    across, down = tiles(index.count(), VECTORS_A_TILE, LEAST_A_TILE, slots), tiles(queries.count(), QUERIES_A_TILE, QUERIES_A_TILE, 1)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    q = queries.select("dim", "vec_id", "raw").withColumn("down", own(down)).withColumn("across", every(across))
    d = index.withColumn("across", own(across)).withColumn("down", every(down))

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        """double"""
        return search_tile(left, right, k)

    return best_k(in_tiles(q, d, ["dim", "across", "down"], work), k)


def op1_one_bit_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = materialize(build_index(table(spark, sf_dir, "embeddings")), "one-bit-codes")
    return nearest(index, index.where(f"vec_id % {QUERY_EVERY} = 0"))
