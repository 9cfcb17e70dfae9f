"""Operator 7: byte-level BPE encoding and decoding by ranked merges folded with Spark's higher-order functions.

A slice of documents (SLICE bytes of text) is split into pieces.  Its distinct pieces go by a hash to buckets, where the
pieces of all slices meet, so that each distinct piece of the corpus is folded once: ``aggregate`` folds over its bytes;
its state is the bounds of the tokens so far and the rank of each adjacent pair, and a step merges the leftmost pair of
least rank and looks up the two pairs that arise.  Ranks are a literal: an array, indexed by a hash, of small maps from
bytes to rank, since a map's lookup in Spark walks its keys.  Decoding concatenates the binary pieces of the ids, looked up
in a literal array of the vocabulary, again once for each distinct piece.  Ids and decoded bytes go back to their slices,
where those of the documents are put together.  The slices' own numbers (places in the list of pieces) never meet the
buckets: documents are split twice, once for the pieces and once for the numbers, and only those are shuffled.

Both readings must cut the same slices: a slice is known by its partition, its place in it and a hash of its ids and
lengths, and a slice that finds no pieces for itself is an error, not a wrong result.

Texts are split by classes of characters over whole arrays (``piece_starts``); another pattern than the known one is left to
``regex``.  The fold is quadratic in a piece's length, so pieces over LONGEST bytes take the same merges from a heap, in Python.

Null or empty text: no ids.  Null doc_id: encoded like others.  Repeated rows: each encoded.  Empty table: empty result.
Only the id and the text are read, so other columns cannot clash.
"""

from __future__ import annotations

import base64
import contextlib
import ctypes
import hashlib
import heapq
import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_slices, partitions, table

BUCKETS, LONGEST, NONE = 1 << 14, 128, 2**31 - 1
#: Bytes of text whose pieces are numbered together: a slice ends with the text that reaches this.  Most buckets of pieces.
SLICE, BUCKETS_MOST = 12 << 20, 1 << 16


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@lru_cache(maxsize=2)
def ranks_of(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def rank_literal(spark: SparkSession, path: str) -> Column:
    """The ranks as array<map<binary,int>>, a map for each value of ``pmod(hash(bytes), BUCKETS)``.

    A scalar subquery: evaluated once, it is a literal in the plan that runs.
    """
    ranks = ranks_of(path)
    rows = [(k, v) for k, v in ranks.items()]
    frame = spark.createDataFrame(rows, "k binary, v int").select(F.pmod(F.hash("k"), F.lit(BUCKETS)).alias("h"), "k", "v")
    lists: list[dict[str, int]] = [{} for _ in range(BUCKETS)]
    for h, k, v in frame.collect():  # the vocabulary, 50,000 rows whatever the corpus
        lists[h][base64.b64encode(k).decode()] = v
    parsed = F.from_json(F.lit(json.dumps(lists)), "array<map<string,int>>")
    maps = F.transform(parsed, lambda m: F.map_from_entries(F.transform(F.map_entries(m), lambda e: F.struct(F.unbase64(e["key"]), e["value"]))))
    return spark.range(1).select(maps.alias("ranks")).scalar()


def token_literal(spark: SparkSession, path: str) -> Column:
    """The vocabulary as array<binary>: the bytes of each id, null where an id has none."""
    ranks = ranks_of(path)
    tokens: list[str | None] = [None] * (max(ranks.values(), default=-1) + 1)
    for k, v in ranks.items():
        tokens[v] = base64.b64encode(k).decode()
    parsed = F.from_json(F.lit(json.dumps(tokens)), "array<string>")
    return spark.range(1).select(F.transform(parsed, lambda t: F.unbase64(t)).alias("tokens")).scalar()


def joined_tokens(ids: Column, tokens: Column) -> Column:
    """The bytes of a piece's ids, concatenated."""
    return F.aggregate(ids, F.lit(b""), lambda acc, i: F.concat(acc, F.get(tokens, i)))


def _let(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def folded_ids(word: Column, rank_map: Column) -> Column:
    """Ids of a byte string (a lambda's variable): array<int>."""
    def rank(start: Column, end: Column) -> Column:
        # Cut twice, which costs less than a lambda to name the piece.
        piece = F.substring(word, start + 1, end - start)
        return F.coalesce(F.try_element_at(rank_map[F.pmod(F.hash(piece), F.lit(BUCKETS))], piece), F.lit(NONE))

    n = F.length(word)
    bounds = F.sequence(F.lit(0), n)
    pairs = F.transform(F.sequence(F.lit(0), n - 2), lambda i: rank(i, i + 2))
    none = F.array().cast("array<int>")

    def step(acc: Column, _: Column) -> Column:
        b, r = acc["b"], acc["r"]

        def merged(k: Column) -> Column:
            """Without the k-th pair (from 1): its middle bound goes, its neighbours reach over the whole of it."""
            new = lambda _, i: F.when(i == k - 2, rank(b[k - 2], b[k + 1])).when(i == k - 1, rank(b[k - 1], b[k + 2])).when(i < k - 2, r[i]).otherwise(r[i + 1])
            left = F.when(F.size(r) < 2, none).otherwise(F.transform(F.slice(r, F.lit(1), F.size(r) - 1), new))
            return F.struct(F.filter(b, lambda _, i: i != k).alias("b"), left.alias("r"))

        least = F.array_min(r)
        return F.when(F.coalesce(least, F.lit(NONE)) == NONE, acc).otherwise(_let(F.array_position(r, least).cast("int"), merged))

    final = F.aggregate(F.sequence(F.lit(2), n), F.struct(bounds.alias("b"), pairs.alias("r")), step, lambda acc: F.transform(F.slice(acc["b"], F.lit(1), F.size(acc["b"]) - 1), lambda s, i: rank(s, acc["b"][i + 1])))
    whole = rank(F.lit(0), n)
    return F.when(n > LONGEST, F.lit(None).cast("array<int>")).otherwise(_let(whole, lambda w: F.when(w != NONE, F.array(w)).otherwise(final)))


def merged_by_heap(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges, in n log n steps."""
    n = len(word)
    end, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        r, i, stop = heapq.heappop(heap)
        if not alive[i] or end[i] >= n or end[end[i]] != stop:
            continue
        j = end[i]
        alive[j], end[i] = False, stop
        if stop < n:
            before[stop] = i
            if (r := ranks.get(word[i : end[stop]])) is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        if (p := before[i]) >= 0 and (r := ranks.get(word[p:stop])) is not None:
            heapq.heappush(heap, (r, p, stop))
    return [ranks[word[i : end[i]]] for i in range(n) if alive[i]]


SLICED = "slice long, bucket int, docs array<bigint>, valid array<boolean>, counts array<int>, codes binary, places binary, words binary, lengths binary"
FOLDED = "slice long, bucket int, n int, sizes binary, ids binary, lengths binary, decoded binary"

#: The pattern that ``piece_starts`` splits by, and its contractions.
KNOWN_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
#: Characters of Unicode's White_Space property.
WHITE_SPACE = (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
OTHER, LETTER, NUMBER, SPACE, END = range(5)


@lru_cache(maxsize=1)
def character_classes() -> np.ndarray:
    """The class of every code point."""
    import regex

    every = np.concatenate((np.arange(0xD800, dtype="<u4"), np.arange(0xE000, 0x110000, dtype="<u4"))).tobytes().decode("utf-32-le")
    classes = np.zeros(0x110000, np.uint8)
    for kind, found in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
        for m in regex.finditer(found, every):
            low = ord(m[0][0])
            # A run within ``every`` may pass over the surrogates, which are no letters.
            classes[low : ord(m[0][-1]) + 1] = kind
    classes[0xD800:0xE000] = OTHER
    classes[list(WHITE_SPACE)] = SPACE
    return classes


def piece_starts(points: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where KNOWN_PATTERN's matches begin, for texts one after the other, each followed by one code point at ``ends``.

    Of a run of white space the last character is a piece of its own, or the head of the next piece if it is a blank,
    unless the text ends there.  An apostrophe that begins a piece takes a contraction's letters and no more.
    """
    kinds = character_classes()[points]
    kinds[ends] = END
    before, after = np.concatenate(([END], kinds[:-1])).astype(np.uint8), np.concatenate((kinds[1:], [END])).astype(np.uint8)
    white = kinds == SPACE
    # A blank is the head of what follows it.
    blank = np.concatenate(([False], ((points == 0x20) & white)[:-1]))
    starts = np.where(white, (before != SPACE) | (after < SPACE), (kinds != before) & ~blank)
    starts |= kinds == END
    quotes = np.flatnonzero((points == ord("'")) & starts & (after == LETTER))
    for letters in CONTRACTIONS:
        here = quotes[quotes + len(letters) < len(points)]
        for j, letter in enumerate(letters, 1):
            here = here[points[here + j] == ord(letter)]
        starts[here + 1] = False
        starts[here + len(letters) + 1] |= kinds[here + len(letters) + 1] == LETTER
    return np.flatnonzero(starts)


def split_pieces(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Pieces of all texts one after the other (binary), a zero byte after each text, and how many each text has of them."""
    import regex

    texts = pc.fill_null(texts, "")
    if pattern() != KNOWN_PATTERN:
        found = [[*regex.findall(pattern(), t), "\0"] for t in texts.to_pylist()]
        return pa.array([p.encode() for f in found for p in f], pa.binary()), np.array([len(f) for f in found], np.int64)
    joined = "\0".join([*texts.to_pylist(), ""])
    points = np.frombuffer(joined.encode("utf-32-le"), "<u4")
    ends = np.cumsum(pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64) + 1) - 1
    starts = piece_starts(points, ends)
    raw = np.frombuffer(joined.encode(), np.uint8)
    places = starts if len(raw) == len(points) else np.flatnonzero((raw & 0xC0) != 0x80)[starts]
    offsets = np.append(places, len(raw)).astype(np.int32)
    pieces = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(raw)])
    return pieces, np.diff(np.searchsorted(starts, ends, "right"), prepend=0)


def _little_memory() -> None:
    """Arrow's own pool and the C library keep what was freed; several workers of an executor would each keep their most."""
    pa.set_memory_pool(pa.system_memory_pool())
    with contextlib.suppress(OSError, AttributeError):  # where the C library has no such call
        ctypes.CDLL(None).malloc_trim(0)


def _arrays(columns: list[tuple[str, pa.DataType, list]]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(values, kind) for _, kind, values in columns], [name for name, _, _ in columns])


def _slice(ident: int, ids: list[pa.Array], pieces: list[pa.Array], counts: list[np.ndarray], buckets: int, numbers: bool) -> Iterator[pa.RecordBatch]:
    """Of one slice either its numbers (a row) or its distinct pieces (a row for each bucket)."""
    coded = pa.chunked_array(pieces).dictionary_encode()
    words = coded.chunk(0).dictionary
    where = np.fromiter((zlib.crc32(w) for w in words.to_pylist()), np.int64, len(words)) % buckets
    order = np.argsort(where, kind="stable")
    docs, sizes = pa.concat_arrays(ids), np.concatenate(counts)
    mark = zlib.crc32(np.asarray(pc.fill_null(docs, 0)).tobytes(), zlib.crc32(sizes.tobytes()))
    ident = (ident << 32) | mark
    none: list = [None]
    if numbers:
        # Without the zero byte that follows each text.
        codes = np.concatenate([np.delete(c.indices.to_numpy(zero_copy_only=False), np.cumsum(n) - 1) for c, n in zip(coded.chunks, counts, strict=True)])
        place = np.empty(len(order), "<u4")
        place[order] = np.arange(len(order), dtype="<u4")
        yield _arrays([
            ("slice", pa.int64(), [ident]), ("bucket", pa.int32(), none), ("docs", pa.list_(pa.int64()), [np.asarray(pc.fill_null(docs, 0))]),
            ("valid", pa.list_(pa.bool_()), [pc.is_valid(docs).to_pylist()]), ("counts", pa.list_(pa.int32()), [(sizes - 1).astype(np.int32)]),
            ("codes", pa.binary(), [_compressed(codes)]), ("places", pa.binary(), [_compressed(place)]), ("words", pa.binary(), none), ("lengths", pa.binary(), none),
        ])
        return
    found, first = np.unique(where[order], return_index=True)
    ends = np.append(first[1:], len(order))
    words = words.take(pa.array(order))
    lengths = np.asarray(pc.binary_length(words), "<u4")
    raw = np.frombuffer(words.buffers()[2], np.uint8) if len(words) and words.buffers()[2] else np.zeros(0, np.uint8)
    at = np.append(0, np.cumsum(lengths, dtype=np.int64))
    for x in range(0, len(found), 1024):
        own = list(zip(first[x : x + 1024].tolist(), ends[x : x + 1024].tolist(), strict=True))
        yield _arrays([
            ("slice", pa.int64(), [ident] * len(own)), ("bucket", pa.int32(), found[x : x + 1024].astype(np.int32)), ("docs", pa.list_(pa.int64()), none * len(own)),
            ("valid", pa.list_(pa.bool_()), none * len(own)), ("counts", pa.list_(pa.int32()), none * len(own)), ("codes", pa.binary(), none * len(own)), ("places", pa.binary(), none * len(own)),
            ("words", pa.binary(), [_compressed(raw[at[i] : at[j]]) for i, j in own]), ("lengths", pa.binary(), [_compressed(lengths[i:j]) for i, j in own]),
        ])


def _sliced(buckets: int, numbers: bool):
    """Batches of documents to the numbers, or to the distinct pieces, of slices of about SLICE bytes of text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _little_memory()
        context = TaskContext.get()
        ident = (context.partitionId() if context else 0) << 8
        held, size = ([], [], []), 0
        for batch in batches:
            for few in byte_slices(batch, "text"):
                pieces, own = split_pieces(few.column("text"))
                for values, value in zip(held, (few.column("doc_id"), pieces, own), strict=True):
                    values.append(value)
                size += pieces.buffers()[2].size
                if size >= SLICE:
                    yield from _slice(ident, *held, buckets, numbers)
                    held, size, ident = ([], [], []), 0, ident + 1
        if held[0]:
            yield from _slice(ident, *held, buckets, numbers)
        held = None
        _little_memory()

    return work


def _met(rows: pa.Table) -> pa.Table:
    """A bucket: its distinct pieces, and for each slice their places in the slice's order."""
    _little_memory()
    lengths = [_numbers(x) for x in rows.column("lengths").to_pylist()]
    raw = b"".join([_decompressed(x) for x in rows.column("words").to_pylist()])
    offsets = np.append(0, np.cumsum(np.concatenate(lengths), dtype=np.int64)).astype(np.int32)
    coded = pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(raw)]).dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype("<i4")
    ends = np.cumsum([len(x) for x in lengths]).tolist()
    uses = [codes[a:b].tobytes() for a, b in zip([0, *ends], ends, strict=False)]
    one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
    return pa.table([rows.column("bucket").slice(0, 1), one(coded.dictionary), one(pa.array(rows.column("slice").to_pylist(), pa.int64())), one(pa.array(uses, pa.binary()))], ["bucket", "words", "slices", "uses"])


def _blob(values: list[np.ndarray], kind: str) -> bytes:
    return np.concatenate([*values, np.zeros(0, kind)]).astype(kind).tobytes()


def _taken(values: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The stretches of ``values`` that begin at ``begin`` and have ``size``, one after the other."""
    stop = np.cumsum(size)
    return values[np.repeat(begin - (stop - size), size) + np.arange(stop[-1] if len(stop) else 0)]


def _bytes_of(path: str, ids: np.ndarray) -> bytes:
    tokens = {v: k for k, v in ranks_of(path).items()}
    return b"".join([tokens[i] for i in ids.tolist()])


def _sent_back(path: str):
    """Folded buckets to a row for each slice: its pieces' ids and decoded bytes, in the slice's order."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _little_memory()
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                words, lists, decoded = (pc.list_flatten(row.column(c)) for c in ("words", "ids", "decoded"))
                sizes = np.asarray(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False), np.int64)
                flat = pc.list_flatten(lists).to_numpy(zero_copy_only=False).astype("<u4")
                lengths = np.asarray(pc.fill_null(pc.binary_length(decoded), 0).to_numpy(zero_copy_only=False), np.int64)
                raw = np.frombuffer(b"".join(d for d in decoded.to_pylist() if d), np.uint8)
                begin, start = np.cumsum(sizes) - sizes, np.cumsum(lengths) - lengths
                # Pieces that were too long to fold.
                long = np.flatnonzero(~pc.is_valid(lists).to_numpy(zero_copy_only=False))
                own = [np.array(merged_by_heap(words[i].as_py(), ranks_of(path)), "<u4") for i in long.tolist()]
                text = [_bytes_of(path, x) for x in own]
                begin[long], sizes[long] = len(flat) + np.cumsum([0, *map(len, own)])[:-1], [len(x) for x in own]
                start[long], lengths[long] = len(raw) + np.cumsum([0, *map(len, text)])[:-1], [len(x) for x in text]
                flat, raw = np.concatenate([flat, *own]), np.concatenate([raw, *[np.frombuffer(x, np.uint8) for x in text]])
                slices, uses = row.column("slices")[0].as_py(), row.column("uses")[0].as_py()
                out = []
                for ident, use in zip(slices, uses, strict=True):
                    c = np.frombuffer(use, "<i4")
                    out.append((ident, len(c), _blob([sizes[c]], "<u4"), _blob([_taken(flat, begin[c], sizes[c])], "<u4"), _blob([lengths[c]], "<u4"), _taken(raw, start[c], lengths[c]).tobytes()))
                if out:
                    ident, n, *blobs = zip(*out, strict=True)
                    columns = [pa.array(ident, pa.int64()), pa.array([row.column("bucket")[0].as_py()] * len(out), pa.int32()), pa.array(n, pa.int32())]
                    packed = [pa.array([_compressed(np.frombuffer(x, "<u4" if c < 3 else np.uint8)) for x in column], pa.binary()) for c, column in enumerate(blobs)]
                    yield pa.record_batch([*columns, *packed], ["slice", "bucket", "n", "sizes", "ids", "lengths", "decoded"])

    return work


def _compressed(values: np.ndarray) -> bytes:
    """Of four-byte numbers all first bytes, then all second ones, and so on, since they compress better."""
    body = values.astype("<u4", copy=False).view(np.uint8).reshape(-1, 4).T if values.dtype.itemsize == 4 else values
    return pa.compress(body.tobytes(), codec="zstd", asbytes=True)


def _numbers(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(_decompressed(blob), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view("<u4")


def _decompressed(blob: bytes) -> bytes:
    return pa.CompressedInputStream(pa.BufferReader(blob), "zstd").read()


def _assembled(digests: bool):
    """A slice's numbers and its pieces' ids and bytes to a row for each document."""

    def work(numbers: pa.Table, folded: pa.Table) -> pa.Table:
        _little_memory()
        names = ["doc_id", "n_tokens", *(("ids_sha256", "decoded_sha256") if digests else ("ids", "decoded"))]
        kinds = [pa.int64(), pa.int64(), *((pa.string(), pa.string()) if digests else (pa.list_(pa.int32()), pa.binary()))]
        if not numbers.num_rows:
            raise RuntimeError("pieces without a slice: the documents were not read twice alike")
        row, parts = numbers.combine_chunks(), []
        docs, valid, counts = (pc.list_flatten(row.column(c)) for c in ("docs", "valid", "counts"))
        counts = np.asarray(counts.to_numpy(), np.int64)
        codes, place = _numbers(row.column("codes")[0].as_py()), _numbers(row.column("places")[0].as_py())
        folded = folded.sort_by("bucket")
        read = lambda c: _numbers if c != "decoded" else lambda b: np.frombuffer(_decompressed(b), np.uint8)
        columns = {c: np.concatenate([*map(read(c), folded.column(c).to_pylist()), np.zeros(0, np.uint8 if c == "decoded" else "<u4")]) for c in ("sizes", "ids", "lengths", "decoded")}
        sizes, lengths, flat, body = (columns[c] for c in ("sizes", "lengths", "ids", "decoded"))
        sizes, lengths = sizes.astype(np.int64), lengths.astype(np.int64)
        if counts.sum() != len(codes) or len(place) != len(sizes):
            raise RuntimeError("a slice without its pieces: the documents were not read twice alike")
        begin, start = np.cumsum(sizes) - sizes, np.cumsum(lengths) - lengths
        ends = np.cumsum(counts)
        # A few documents at a time, so that the ids of a slice are never all there.
        for a in range(0, len(counts), 256):
            b = min(len(counts), a + 256)
            low = int(ends[a - 1]) if a else 0
            c = place[codes[low : ends[b - 1]]]
            size, length = sizes[c], lengths[c]
            ids, text = _taken(flat, begin[c], size), _taken(body, start[c], length).tobytes()
            own = np.concatenate(([0], ends[a:b] - low))
            at, cut = np.concatenate(([0], np.cumsum(size)))[own], np.concatenate(([0], np.cumsum(length)))[own]
            who = pa.array(np.asarray(docs.slice(a, b - a)), mask=~np.asarray(valid.slice(a, b - a).to_numpy(zero_copy_only=False), bool))
            view, data, pairs = memoryview(ids.tobytes()), memoryview(text), list(zip(at.tolist(), at.tolist()[1:], cut.tolist(), cut.tolist()[1:], strict=False))
            if digests:
                rest = [pa.array([hashlib.sha256(view[4 * i : 4 * j]).hexdigest() for i, j, _, _ in pairs], pa.string()), pa.array([hashlib.sha256(data[i:j]).hexdigest() for _, _, i, j in pairs], pa.string())]
            else:
                rest = [pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids.astype(np.int32))), pa.array([bytes(data[i:j]) for _, _, i, j in pairs], pa.binary())]
            parts.append(pa.record_batch([who, pa.array(np.diff(at)), *rest], names))
        return pa.Table.from_batches(parts, pa.schema(list(zip(names, kinds, strict=True))))

    return work


def encode_decode(df: DataFrame, path: str | None = None, digests: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n_tokens``, ``ids`` (array<int>) and ``decoded`` (binary) of every text, or their digests."""
    path, spark = path or vocabulary(), df.sparkSession
    docs = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    # As many buckets as keep the pieces of one to what a task holds, whatever the input.
    buckets = min(BUCKETS_MOST, max(partitions(spark), 2 * docs.rdd.getNumPartitions()))
    pieces = docs.mapInArrow(_sliced(buckets, False), SLICED).select("slice", "bucket", "words", "lengths")
    met = pieces.groupBy("bucket").applyInArrow(_met, "bucket int, words array<binary>, slices array<bigint>, uses array<binary>")
    folded = met.withColumn("ranks", rank_literal(spark, path)).withColumn("ids", _let(F.col("ranks"), lambda m: F.transform(F.col("words"), lambda w: folded_ids(w, m)))).drop("ranks")
    folded = folded.withColumn("tokens", token_literal(spark, path)).withColumn("decoded", _let(F.col("tokens"), lambda t: F.transform(F.col("ids"), lambda i: joined_tokens(i, t)))).drop("tokens")
    back = folded.mapInArrow(_sent_back(path), FOLDED)
    numbers = docs.mapInArrow(_sliced(buckets, True), SLICED).drop("bucket", "words", "lengths")
    end = "ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded binary"
    return numbers.groupBy("slice").cogroup(back.groupBy("slice")).applyInArrow(_assembled(digests), f"doc_id long, n_tokens long, {end}")


def op7_folded_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(table(spark, sf_dir, "documents"), digests=True)
