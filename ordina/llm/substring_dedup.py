"""Operator 5: exact removal of repeated passages by difference-cover anchors.

Words are what white space (ASCII) separates.  A window is WINDOW consecutive words; each word covered by a window whose
words also start earlier (smaller doc_id, or earlier in the same document) goes.

Anchors: positions are covered modulo PERIOD by COVER, a difference cover: for any two positions i and j there is a shift
below PERIOD that takes both into the cover.  Two equal windows therefore hold, at the same shift, equal anchors of
``WINDOW - PERIOD + 1`` words, and only anchors (4 of 13 positions) are hashed and shuffled.  Anchors seen twice are
extended: every window that holds one is hashed by 96 bits, and the earliest start of each hash is left alone.

A slice of documents first settles its own repeats and sends on one row for each distinct hash, so a passage that a third
of all rows share is one entry a slice and never a hot group.  Entries travel packed, by ranges of hashes; texts are
shuffled once, by document, and that exchange serves both the extension and the removal.

Windows are taken for equal by 96 bits: polynomial hashes of the words (modulo 2^64, then mixed), 64 bits of one and 32 of
another; words themselves are not compared, so two different windows are confused with a chance of about 2^-96 a pair.

Null or wordless text: no words.  Null doc_id: the row is returned whole and takes no part.  Rows repeated with one id and
text stand at the same place, so neither is earlier than the other.  Empty table: empty result.  Only the id and the text
are read, so other columns cannot clash.  There are as many buckets as keep the text of one at about A_BUCKET bytes; a task
holds a bucket (or one longer document) and, for a slice of SLICE bytes at a time, about 100 times that in working arrays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_slices, mix64, partitions, table, text_columns

WINDOW, PERIOD, COVER, SLICE = 20, 13, (0, 1, 3, 9), 1 << 20
#: Bytes of text that a bucket has on average, at most.
A_BUCKET = 32 << 20
_SPACE = np.isin(np.arange(256), [32, *range(9, 14)])
_BYTE = np.random.default_rng(3).integers(0, 2**64, 256, np.uint64)
_BASES = [int(x) | 5 for x in np.random.default_rng(4).integers(0, 2**62, 3)]
PACKED = "kind int, bucket long, n int, blob binary"
_PACKED = pa.schema([("kind", pa.int32()), ("bucket", pa.int64()), ("n", pa.int32()), ("blob", pa.binary())])


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def _runs(values: np.ndarray, base: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of values[starts:ends] for each pair, by one prefix sum."""
    up, down = _powers(base, len(values)), _powers(pow(base, -1, 1 << 64), len(values))
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up, out=total[1:])
    return mix64((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


class Slice:
    """Words of a slice of texts: their hashes, and the first and last word of each text (``begin``, n + 1 numbers)."""

    def __init__(self, texts: list[bytes | None]):
        flat = b" ".join([t or b"" for t in texts]) + b" "
        raw = np.frombuffer(flat, np.uint8)
        word = ~_SPACE[raw]
        edge = np.diff(np.concatenate(([False], word)).astype(np.int8))
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.words = _runs(_BYTE[raw], _BASES[0], starts, ends) if len(starts) else np.zeros(0, np.uint64)
        place = np.cumsum([0, *[len(t or b"") + 1 for t in texts]])
        self.begin = np.searchsorted(starts, place)
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.begin))

    def windows(self, at: np.ndarray, length: int, which: int) -> np.ndarray:
        return _runs(self.words, _BASES[which], at, at + length)


def _pack(kind: int, buckets: np.ndarray, columns: list[np.ndarray]) -> pa.RecordBatch:
    """A row for each bucket with the columns' values for it, one column after the other."""
    order = np.argsort(buckets, kind="stable")
    found, first = np.unique(buckets[order], return_index=True)
    ends = np.append(first[1:], len(order))
    ready = [c[order].astype("<i8") if c.dtype.itemsize == 8 else c[order].astype("<i4") for c in columns]
    blobs = [b"".join([c[a:b].tobytes() for c in ready]) for a, b in zip(first, ends, strict=True)]
    return pa.record_batch([pa.array(np.full(len(found), kind, np.int32)), pa.array(found.astype(np.int64)), pa.array((ends - first).astype(np.int32)), pa.array(blobs, pa.binary())], schema=_PACKED)


def _unpack(rows: pa.Table, kind: int, wide: int, narrow: int = 1) -> list[np.ndarray]:
    """``wide`` columns of eight bytes and ``narrow`` ones of four, of all rows of a kind."""
    rows = rows.filter(pc.equal(rows.column("kind"), kind))
    parts: list[list[np.ndarray]] = [[] for _ in range(wide + narrow)]
    for n, blob in zip(rows.column("n").to_pylist(), rows.column("blob").to_pylist(), strict=True):
        for k in range(wide):
            parts[k].append(np.frombuffer(blob, "<i8", n, k * 8 * n))
        for k in range(narrow):
            parts[wide + k].append(np.frombuffer(blob, "<i4", n, wide * 8 * n + k * 4 * n))
    return [np.concatenate([*p, np.zeros(0, np.int64 if k < wide else np.int32)]) for k, p in enumerate(parts)]


def _bucket(h: np.ndarray, n: int) -> np.ndarray:
    return ((h.view(np.uint64) >> np.uint64(33)) % np.uint64(n)).astype(np.int64)


def _home(doc: np.ndarray, th: np.ndarray, n: int) -> np.ndarray:
    """The bucket of a document's text; the JVM computes the same number."""
    return ((doc ^ th) & 0x7FFFFFFFFFFFFFFF) % n


def _anchors(buckets: int):
    """Documents to packed rows: kind 0, anchors for their bucket of hashes; kind 1, positions settled here for their home."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length = WINDOW - PERIOD + 1
        for batch in batches:
            for part in byte_slices(batch, "text", SLICE):
                s = Slice(part.column("text").cast(pa.binary()).to_pylist())
                ids, th = (part.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "th"))
                at = np.arange(len(s.words))
                pos = at - s.begin[s.doc]
                long_enough = np.diff(s.begin)[s.doc] >= WINDOW
                at = at[long_enough & np.isin(pos % PERIOD, COVER) & (s.begin[s.doc + 1] - at >= length)]
                h = s.windows(at, length, 1).view(np.int64) if len(at) else np.zeros(0, np.int64)
                order = np.argsort(h, kind="stable")
                new = np.concatenate(([True], h[order][1:] != h[order][:-1]))[: len(order)]
                twice = ~new | ~np.append(new[1:], True)[: len(order)]
                d, p = s.doc[at], (at - s.begin[s.doc[at]]).astype(np.int32)
                one, many = np.sort(order[new]), np.sort(order[twice])
                yield _pack(0, _bucket(h[one], buckets), [h[one], ids[d[one]], th[d[one]], p[one]])
                if len(many):
                    yield _pack(1, _home(ids[d[many]], th[d[many]], buckets), [ids[d[many]], th[d[many]], p[many]])

    return work


def _met_anchors(buckets: int):
    """A bucket of hashes: positions of anchors that came from two slices or more, for their homes; kind 1 passes."""

    def work(rows: pa.Table) -> pa.Table:
        h, ids, th, p = _unpack(rows, 0, 3)
        order = np.argsort(h, kind="stable")
        new = np.concatenate(([True], h[order][1:] != h[order][:-1]))[: len(order)]
        many = np.sort(order[~new | ~np.append(new[1:], True)[: len(order)]])
        out = [rows.filter(pc.equal(rows.column("kind"), 1)).select(_PACKED.names).cast(_PACKED)]
        if len(many):
            out.append(pa.Table.from_batches([_pack(1, _home(ids[many], th[many], buckets), [ids[many], th[many], p[many]])]))
        return pa.concat_tables(out)

    return work


def _marks(rows: pa.Table, kind: int) -> dict[tuple[int, int], np.ndarray]:
    """Positions by document (id and hash of the text)."""
    ids, th, p = _unpack(rows, kind, 2)
    order = np.lexsort((th, ids))
    ids, th, p = ids[order], th[order], p[order]
    cut = np.flatnonzero((ids[1:] != ids[:-1]) | (th[1:] != th[:-1])) + 1
    return {(int(ids[a]), int(th[a])): p[a:b] for a, b in zip([0, *cut], [*cut, len(ids)], strict=True) if b > a}


def _extended(buckets: int):
    """A home's documents and anchor positions: windows round the anchors; kind 2 for buckets of hashes, kind 3 settled here."""

    def work(docs: pa.Table, rows: pa.Table) -> pa.Table:
        out, found = [_PACKED.empty_table()], []
        marks = _marks(rows, 1)
        keys = list(zip(docs.column("doc_id").to_pylist(), docs.column("th").to_pylist(), strict=True))
        docs = docs.take(pa.array([i for i, k in enumerate(keys) if k in marks], pa.int64()))
        for batch in docs.combine_chunks().to_batches():
            for part in byte_slices(batch, "text", SLICE):
                s = Slice(part.column("text").cast(pa.binary()).to_pylist())
                ids, th = (part.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "th"))
                wanted = np.zeros(len(s.words) + PERIOD + 1, np.int32)
                for i, key in enumerate(zip(ids.tolist(), th.tolist(), strict=True)):
                    a = np.unique(marks[key]) + s.begin[i]
                    np.add.at(wanted, np.maximum(a - PERIOD + 1, s.begin[i]), 1)
                    np.add.at(wanted, a + 1, -1)
                at = np.flatnonzero(np.cumsum(wanted[: len(s.words)]) > 0)
                at = at[at + WINDOW <= s.begin[s.doc[at] + 1]]
                if not len(at):
                    continue
                d = s.doc[at]
                second = (s.windows(at, WINDOW, 2) >> np.uint64(32)).astype(np.uint32).view(np.int32)
                found.append((s.windows(at, WINDOW, 1).view(np.int64), second, ids[d], th[d], (at - s.begin[d]).astype(np.int32)))
        if found:
            h1, h2, ids, th, p = (np.concatenate(c) for c in zip(*found, strict=True))
            # Back in the order of documents and places, in which they compress well.
            first, later = (np.sort(x) for x in _split(h1, h2, ids, p))
            out.append(pa.Table.from_batches([_pack(2, _bucket(h1[first], buckets), [h1[first], ids[first], th[first], p[first], h2[first]])]))
            if len(later):
                out.append(pa.Table.from_batches([_pack(3, _home(ids[later], th[later], buckets), [ids[later], th[later], p[later]])]))
        return pa.concat_tables(out)

    return work


def _split(h1: np.ndarray, h2: np.ndarray, ids: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of equal hashes: one entry at the earliest place for each, and those that start later than it.

    Others at the earliest place itself (repeated rows of a document) are in the first lot, too.
    """
    order = np.lexsort((p, ids, h2, h1))
    a, b, i, q = h1[order], h2[order], ids[order], p[order]
    new = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))[: len(order)]
    head = np.flatnonzero(new)[np.cumsum(new) - 1] if len(order) else np.zeros(0, np.int64)
    later = (i != i[head]) | (q != q[head])
    return order[~later], order[later]


def _earliest(buckets: int):
    """A bucket of hashes: starts of windows that start earlier elsewhere, for their homes; kind 3 passes."""

    def work(rows: pa.Table) -> pa.Table:
        h1, ids, th, p, h2 = _unpack(rows, 2, 3, 2)
        later = np.sort(_split(h1, h2, ids, p)[1])
        out = [rows.filter(pc.equal(rows.column("kind"), 3)).select(_PACKED.names).cast(_PACKED)]
        if len(later):
            out.append(pa.Table.from_batches([_pack(3, _home(ids[later], th[later], buckets), [ids[later], th[later], p[later]])]))
        return pa.concat_tables(out)

    return work


def _kept(docs: pa.Table, rows: pa.Table) -> pa.Table:
    """A home's documents without the words covered by the starts."""
    marks, n_words, n_gone, texts = _marks(rows, 3), [], [], []
    for key, text in zip(zip(docs.column("doc_id").to_pylist(), docs.column("th").to_pylist(), strict=True), docs.column("text").cast(pa.binary()).to_pylist(), strict=True):
        words = (text or b"").split()
        n_words.append(len(words))
        if (at := marks.get(key)) is not None:
            cover = np.zeros(len(words) + 1, np.int32)
            np.add.at(cover, at, 1)
            np.add.at(cover, at + WINDOW, -1)
            words = [words[i] for i in np.flatnonzero(np.cumsum(cover[:-1]) == 0).tolist()]
        n_gone.append(n_words[-1] - len(words))
        texts.append(b" ".join(words))
    return pa.table({"doc_id": docs.column("doc_id"), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_gone, pa.int64()), "text": pa.array(texts, pa.binary()).cast(pa.string())})


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n_words``, ``n_removed``, ``text`` (the kept words joined by one space), a row for each row of ``df``."""
    docs = text_columns(df, id_col, text_col).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(partitions(df.sparkSession), -(-size // A_BUCKET))
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("th"))
    home = F.coalesce("doc_id", F.lit(0)).bitwiseXOR(F.col("th")).bitwiseAND(F.lit(0x7FFFFFFFFFFFFFFF))
    homes = docs.withColumn("bucket", home % n).repartition(n, "bucket")
    sent = docs.where("doc_id is not null").mapInArrow(_anchors(n), PACKED)
    met = sent.groupBy("bucket").applyInArrow(_met_anchors(n), PACKED)
    windows = homes.groupBy("bucket").cogroup(met.groupBy("bucket")).applyInArrow(_extended(n), PACKED)
    lost = windows.groupBy("bucket").applyInArrow(_earliest(n), PACKED)
    return homes.groupBy("bucket").cogroup(lost.groupBy("bucket")).applyInArrow(_kept, "doc_id long, n_words long, n_removed long, text string")


def op5_cover_anchor_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = remove_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


#: Brute force in SQL: every window's words, and all windows that start earlier.
ORACLE = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
p AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM w WHERE len(ws) >= 20),
k AS (SELECT doc_id, i, row_number() OVER (PARTITION BY array_to_string(ws[i : i + 19], ' ') ORDER BY doc_id, i) AS place FROM p),
c AS (SELECT DISTINCT doc_id, i + d AS j FROM k, range(20) AS t(d) WHERE place > 1),
u AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS j FROM w),
kept AS (SELECT u.doc_id, string_agg(word, ' ' ORDER BY j) AS t FROM u ANTI JOIN c USING (doc_id, j) GROUP BY u.doc_id),
gone AS (SELECT doc_id, count(*) AS n FROM c GROUP BY doc_id)
SELECT w.doc_id, cast(len(ws) AS BIGINT) AS n_words, coalesce(gone.n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept ON kept.doc_id = w.doc_id LEFT JOIN gone ON gone.doc_id = w.doc_id
"""
