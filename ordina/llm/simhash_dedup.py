"""Operator 6: SimHash near-duplicates over an inverted index of byte positions with count filtering.

Two 64-bit fingerprints that differ in at most 3 bits differ in at most 3 of their 8 bytes, so they share at least 5
bytes at the same positions (the guaranteed minimum).  Any 5 of 8 positions hold 3 of positions 0-3 or 3 of positions
4-7; the index therefore has one posting for each of the 8 triples inside those halves (position triple + its bytes).
Inside a posting list the shared positional bytes of each pair are tallied; pairs reaching 5 are verified bit by bit.

A posting list returns only links that join two so far separate parts of it (at most its length less one), never all
pairs.  Lists longer than ``tile`` are cut into tiles and every pair of tiles is its own piece of work, so no list, and
no third of all rows in one list, has to be in one task; nothing is dropped.  Identical fingerprints are one node.

Null or wordless text: fingerprint zero, linked like any other.  Null doc_id: the row gets its fingerprint and component
(null only if no document of the component has an id).  Repeated rows: one row out for each row in.  Empty table: empty.

Where documents are to be one at a Jaccard similarity of their shingles (the pipeline: five words, 0.8), 3 bits miss most pairs:
:func:`similar_documents` finds all of them.  Two sets that similar share one of the least hashes of each, of which there
are ``n - ceil(similarity * n) + 1``.  Of two sets that meet there the differing bits of a sketch are counted; few enough,
the whole sets are compared.  A sketch deals the hashes to SKETCH bins.  That of a set of up to SMALL hashes says whether a
bin has an odd number of them, that of a larger set is a bit of the bin's least hash; a shingle that only one set has changes
one bit at most, and at similarity 0.8 a tenth of the bits of larger sets differ, give or take.  First each set is tried against one of those that share a hash, another for each hash; then those still in different components are tried against each other.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import byte_slices, drop_tables, materialize, mix64, partitions, shielded, small_side, table, text_columns
from .components import connected_components

SHINGLE, DISTANCE, SHARED, SEED = 3, 3, 5, 42
TRIPLES = [t for half in (range(4), range(4, 8)) for t in combinations(half, 3)]


def fingerprint(text: str | bytes | None, shingle: int = SHINGLE) -> int:
    """Unsigned fingerprint of one text."""
    raw = text.encode() if isinstance(text, str) else text or b""
    words = raw.translate(_LOWER).split()
    if not words:
        return 0
    flat = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(shingle, len(words))
    digest = xxhash.xxh64_digest
    votes, n = np.zeros(64, np.int64), len(words) - k + 1
    for at in range(0, n, 1 << 14):
        a, b = starts[at : min(n, at + (1 << 14))].tolist(), ends[at + k - 1 : at + k - 1 + (1 << 14)].tolist()
        got = np.frombuffer(b"".join([digest(flat[i:j], SEED) for i, j in zip(a, b, strict=True)]), np.uint8)
        votes += np.unpackbits(got.reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > n).tobytes(), "big")


_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id``, ``fp`` (the fingerprint as a signed long) of every whole text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch, "text"):
                fps = np.array([fingerprint(t, shingle) for t in part.column("text").cast(pa.binary()).to_pylist()], np.uint64)
                yield pa.record_batch([part.column("doc_id"), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.mapInArrow(work, "doc_id long, fp long")


def shared_bytes(x: np.ndarray) -> np.ndarray:
    """How many of the 8 bytes are zero in each XOR, that is, equal in both fingerprints."""
    low = np.uint64(0x7F7F7F7F7F7F7F7F)
    return np.bitwise_count(~(((x & low) + low) | x | low))


def joining_links(left: np.ndarray, right: np.ndarray | None, distance: int = DISTANCE, shared: int = SHARED) -> list[tuple[int, int]]:
    """Links of a posting list (or between two tiles of one) that join two parts not yet joined by earlier ones."""
    nodes = left if right is None else np.concatenate((left, right))
    label, found = np.arange(len(nodes)), []
    for i in range(len(left)):
        lo = i + 1 if right is None else len(left)
        x = nodes[lo:] ^ nodes[i]
        near = lo + np.flatnonzero((shared_bytes(x) >= shared) & (np.bitwise_count(x) <= distance))
        while len(near := near[label[near] != label[i]]):
            j = near[0]
            found.append((int(nodes[i]), int(nodes[j])))
            label[label == label[j]] = label[i]
    return found


def posting_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (key, tile_a, tile_b): the posting lists one after the other, however batches cut them."""
    rest: list[np.ndarray] = []

    def links(rows: np.ndarray) -> pa.RecordBatch:
        out: list[tuple[int, int]] = []
        cut = np.flatnonzero(np.any(rows[1:, :3] != rows[:-1, :3], axis=1)) + 1
        starts, ends = np.concatenate(([0], cut)), np.concatenate((cut, [len(rows)]))
        for k in np.flatnonzero(ends - starts > 1):
            own = rows[starts[k] : ends[k]]
            fps = own[:, 4].astype(np.int64).view(np.uint64)
            if own[0, 1] == own[0, 2]:
                out += joining_links(fps, None)
            else:
                first = own[:, 3] == own[0, 1]
                out += joining_links(fps[first], fps[~first])
        ab = np.array(out, np.uint64).reshape(-1, 2).view(np.int64)
        return pa.record_batch([pa.array(ab[:, 0]), pa.array(ab[:, 1])], ["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1)
        rest.append(rows)
        if np.array_equal(rest[0][0, :3], rows[-1, :3]):
            continue
        rows = np.concatenate(rest)
        last = np.flatnonzero(np.any(rows[:, :3] != rows[-1, :3], axis=1))[-1] + 1
        rest = [rows[last:]]
        yield links(rows[:last])
    if rest:
        yield links(np.concatenate(rest))


def fingerprint_links(nodes: DataFrame, tile: int = 8192) -> DataFrame:
    """``nodes``: distinct ``fp``.  Returns links ``a``, ``b`` that connect exactly what all links within DISTANCE connect."""
    byte = lambda i: F.shiftrightunsigned("fp", 8 * i).bitwiseAND(F.lit(255))
    keys = [F.lit(k << 24).cast("long") + byte(a) * 65536 + byte(b) * 256 + byte(c) for k, (a, b, c) in enumerate(TRIPLES)]
    postings = nodes.select("fp", F.explode(F.array(*keys)).alias("key"))
    long_lists = postings.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > tile).withColumn("tiles", F.ceil(F.col("n") / tile).cast("long"))
    postings = postings.join(long_lists.select("key", "tiles"), "key", "left").withColumn("tiles", F.coalesce("tiles", F.lit(1).cast("long")))
    postings = postings.withColumn("tile", F.pmod(F.xxhash64("fp"), F.col("tiles")))
    dealt = postings.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
    dealt = dealt.select("key", F.least("tile", "other").alias("tile_a"), F.greatest("tile", "other").alias("tile_b"), "tile", "fp")
    dealt = dealt.repartition(partitions(nodes.sparkSession), "key", "tile_a", "tile_b").sortWithinPartitions("key", "tile_a", "tile_b")
    return dealt.mapInArrow(posting_links, "a long, b long")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``fp``, ``component_id`` (smallest doc_id reachable over links), one row for each row of ``df``."""
    fps = materialize(fingerprints(text_columns(df, id_col, text_col)), "fingerprints")
    nodes = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprint-nodes")
    roots = connected_components(fingerprint_links(nodes)).toDF("fp", "root")
    known = nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = known.groupBy("root").agg(F.min("least").alias("component_id"))
    return fps.join(known.join(least, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def shingle_set(text: bytes | None, shingle: int) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles; none of a null or wordless text."""
    words = (text or b"").translate(_LOWER).split()
    k = min(shingle, len(words))
    if not k:
        return np.zeros(0, np.uint64)
    got = b"".join([xxhash.xxh64_digest(b" ".join(words[i : i + k]), SEED) for i in range(len(words) - k + 1)])
    return np.unique(np.frombuffer(got, np.uint64))


#: Bits of a sketch; hashes of a small set; the most bits that may differ between larger ones: a tenth and five deviations.
SKETCH, SMALL, MOST_BITS = 256, 300, 51


def sketch(hashes: np.ndarray) -> np.ndarray:
    """SKETCH bits as four longs: of each bin of hashes whether their number is odd, or for a large set a bit of the least."""
    where = (mix64(hashes) >> np.uint64(56)).astype(np.int64)
    if len(hashes) <= SMALL:
        return np.packbits((np.bincount(where, minlength=SKETCH) & 1).astype(np.uint8)).view(np.int64)
    bits = np.zeros(SKETCH, np.uint8)
    found, first = np.unique(where, return_index=True)
    bits[found] = mix64(hashes[first]) & np.uint64(1)
    return np.packbits(bits).view(np.int64)


def similar_documents(df: DataFrame, shingle: int, similarity: float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``component_id`` (smallest doc_id reachable over pairs of this Jaccard similarity), a row for each row of ``df``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch, "text"):
                sets = [shingle_set(t, shingle) for t in part.column("text").cast(pa.binary()).to_pylist()]
                n = [len(s) for s in sets]
                same = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64).view(np.int64)
                least = [m - math.ceil(similarity * m - 1e-9) + 1 if m else 0 for m in n]
                lists = lambda parts, kind: pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, parts)]), pa.int32()), pa.array(np.concatenate([*parts, np.zeros(0, kind)]).astype(kind)))
                # The first of a set by hash, and all of it in 32 bits, which is enough between two sets.
                first = lists([s[:m].view(np.int64) for s, m in zip(sets, least, strict=True)], np.int64)
                whole = lists([np.unique((s >> np.uint64(32)).astype(np.uint32)).view(np.int32) for s in sets], np.int32)
                bits = np.stack([sketch(s) for s in sets])
                yield pa.record_batch([part.column("doc_id"), pa.array(same), pa.array(n, pa.int32()), *[pa.array(bits[:, i]) for i in range(4)], first, whole], ["doc_id", "same", "n", *BITS, "first", "hashes"])

    schema = "doc_id long, same long, n int, s0 long, s1 long, s2 long, s3 long, first array<long>, hashes array<int>"
    sets = materialize(text_columns(df, id_col, text_col).mapInArrow(work, schema), "shingle-sets")
    nodes = materialize(sets.groupBy("same").agg(F.min("doc_id").alias("least")), "shingle-nodes")
    entries = sets.where("n > 0").select("same", "n", *BITS, F.posexplode("first").alias("at", "hash"))
    # Most hashes are in one set only; only the others are kept.
    # Each hash has a head of its own, so that a set of a large group meets many of the others.
    entries = entries.withColumn("order", F.xxhash64("same", "hash"))
    shared = entries.groupBy("hash").agg(F.min("same").alias("lo"), F.max("same").alias("hi"), F.min("order").alias("head")).where("lo <> hi")
    shared = materialize(shared.select("hash", "head"), "shingle-shared")
    entries = entries.join(small_side(shared, F.lit(32)), "hash").withColumn("head", F.col("order") == F.col("head")).drop("order")
    entries = materialize(entries.distinct(), "shingle-entries")
    x, y = entries.toDF(*[f"x_{c}" for c in entries.columns]), entries.toDF(*[f"y_{c}" for c in entries.columns])
    differing = sum((F.bit_count(F.col(f"x_{b}").bitwiseXOR(F.col(f"y_{b}"))) for b in BITS), F.lit(0))
    # At the first hash that two sets share, what is left of both must be enough.
    share = similarity / (1 + similarity) * (F.col("x_n") + F.col("y_n")) - 1e-6
    enough = F.least(F.col("x_n") - F.col("x_at"), F.col("y_n") - F.col("y_at")) >= share
    # No more bits can differ than the sets have shingles that are not in both.
    apart = F.floor((1 - similarity) / (1 + similarity) * (F.col("x_n") + F.col("y_n")) + 1e-6)
    small, large = F.greatest("x_n", "y_n") <= SMALL, F.least("x_n", "y_n") > SMALL
    likely = (F.col("x_hash") == F.col("y_hash")) & enough & F.when(small, differing <= apart).when(large, differing <= F.least(F.lit(MOST_BITS), apart)).otherwise(True)
    pair = lambda j: j.select(F.least("x_same", "y_same").alias("a"), F.greatest("x_same", "y_same").alias("b")).distinct()
    stars = materialize(pair(x.join(y.where("y_head"), likely & ~F.col("x_head"))), "shingle-stars")
    first = _alike(stars, sets, similarity)
    labels = connected_components(first).toDF("same", "label")
    labelled = entries.join(small_side(labels, F.lit(32)), "same", "left").withColumn("label", F.coalesce("label", "same"))
    mixed = labelled.groupBy("hash").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("hash")
    labelled = materialize(labelled.join(mixed, "hash", "left_semi"), "shingle-mixed")
    x, y = labelled.toDF(*[f"x_{c}" for c in labelled.columns]), labelled.toDF(*[f"y_{c}" for c in labelled.columns])
    once = (F.col("x_same") < F.col("y_same")) & (F.col("x_label") != F.col("y_label"))
    second = materialize(pair(x.join(y, likely & once)).join(stars, ["a", "b"], "left_anti"), "shingle-pairs")
    roots = connected_components(first.unionByName(_alike(second, sets, similarity))).toDF("same", "root")
    known = nodes.join(roots, "same", "left").withColumn("root", F.coalesce("root", "same"))
    least = known.groupBy("root").agg(F.min("least").alias("component_id"))
    found = materialize(sets.select("doc_id", "same").join(known.join(least, "root").select("same", "component_id"), "same").select("doc_id", "component_id"), "shingle-components")
    drop_tables(sets, nodes, shared, entries, stars, labelled, second)
    return found


BITS = ("s0", "s1", "s2", "s3")


def _alike(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Of pairs ``a``, ``b`` those whose whole sets are similar enough."""
    ends = materialize(pairs.select(F.explode(F.array("a", "b")).alias("same")).distinct(), "shingle-ends")
    whole = sets.select("same", "hashes").join(small_side(ends, F.lit(16)), "same", "left_semi").groupBy("same").agg(F.first("hashes").alias("hashes"))
    whole = materialize(whole, "shingle-whole")
    both = pairs.join(whole.toDF("a", "ha"), "a").join(whole.toDF("b", "hb"), "b").select("a", "b", (F.size("ha") + F.size("hb")).alias("n"), F.size(F.array_intersect("ha", "hb")).alias("both"))
    links = materialize(both.where(F.col("both") >= similarity * (F.col("n") - F.col("both")) - 1e-6).select("a", "b"), "shingle-links")
    drop_tables(ends, whole)
    return links


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: float | None = None) -> DataFrame:
    """``df`` with one row of each group: that of the smallest id; its repeated rows count as copies and go, too.

    Groups are those of :func:`similar_documents` where a ``similarity`` of sets of ``shingle`` words is given, else those of
    :func:`near_duplicates`.  Rows with a null id stay: nothing says which of them came first.
    """
    found = near_duplicates(df, id_col, text_col) if similarity is None else similar_documents(df, shingle, similarity, id_col, text_col)
    lost = found.where("doc_id is not null and doc_id <> component_id").select("doc_id").distinct()
    rows, names = shielded(df, ident=F.col(f"`{id_col}`").cast("long"), mark=F.xxhash64(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))))
    rows = rows.join(lost, F.col("ident") == F.col("doc_id"), "left_anti")
    # Ids that come more than once are few; only their rows are numbered.
    twice = rows.where("ident is not null").groupBy("ident").count().where("count > 1").select(F.col("ident").alias("twice"))
    first = Window.partitionBy("ident").orderBy("mark")
    repeated = rows.join(twice, F.col("ident") == F.col("twice"), "left_semi").withColumn("k", F.row_number().over(first)).where("k = 1").drop("k")
    kept = rows.join(twice, F.col("ident") == F.col("twice"), "left_anti").unionByName(repeated)
    return kept.select(*[F.col(n).alias(c) for c, n in names.items()])


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
