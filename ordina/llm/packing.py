"""Operator 3: packing by first-fit decreasing over a tournament tree of bin capacities, in randomised groups.

A document is its token ids (vocabulary of a public tokenizer, no special tokens added) and one closing id.  It is cut
into full sequences and a remainder; pieces are dealt to groups by a hash, about GROUP pieces each, and each group is
packed by itself: pieces by falling length, each into the first bin that still holds it, found by a walk from the root
of a tree whose nodes hold the greatest room left below them.

Tokens: words are split and lower-cased in the JVM, Arrow's dictionary encoding finds a batch's distinct words, and only
words a worker does not remember go through the tokenizer.  Texts with a character outside the ranges in SAFE, where the
engines' tables of letters and cases might differ, and texts with ``<|`` go through the tokenizer whole.  Strings of
special tokens in a text are ordinary text.

Null or empty text: the closing id alone.  Repeated rows: each is packed (under its id), dealt by its own row number.  Null
doc_id: packed like others.  Empty table: empty result.  Only the id and the text are read, so other columns cannot clash.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, table, text_columns

LENGTH, CLOSING, GROUP, REMEMBERED = 2048, 1, 2048, 800_000
#: Characters for which splitting and lower-casing are the same everywhere: ASCII but its controls, Latin letters, punctuation.
SAFE = "^[\\x09-\\x0D\\x20-\\x7E¡-įı-ǃǍ-ǰǴ-ȗ‐-‧‰-⁞€]*$"
#: Fixed value: the vocabulary's own way to split (contractions, runs of letters, single digits, runs of the rest).
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Words:
    """Ids (bytes of little-endian uint32) of words and of whole texts.

    Remembers at most REMEMBERED words; the half met first is then forgotten, which costs time, never a result.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        names = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(names.values()) + 1, bool)
        self.closes[[i for name, i in names.items() if name.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {}

    def of_texts(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _new(self, words: list[str]) -> list[bytes]:
        """Words in one text, apart by spaces, are split again into just these words; a word's last token says so."""
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
        ends = ((np.flatnonzero(self.closes[ids]) + 1) * 4).tolist()
        if len(ends) != len(words):
            return self.of_texts(words)
        raw = ids.tobytes()
        return [raw[i:j] for i, j in zip([0, *ends], ends, strict=False)]

    def of_words(self, words: list[str]) -> list[bytes]:
        known = self.known
        found = [known.get(w) for w in words]
        new = [i for i, f in enumerate(found) if f is None]
        if len(known) + len(new) > REMEMBERED:
            for w in list(islice(known, len(known) // 2)):
                del known[w]
        for at in range(0, len(new), 1024):
            part = new[at : at + 1024]
            for i, ids in zip(part, self._new([words[i] for i in part]), strict=True):
                found[i] = known[words[i]] = ids
        return found


@lru_cache(maxsize=1)
def worker_words(path: str) -> Words:
    """One for all tasks of a Python worker."""
    return Words(path)


def ids_of_batch(words: Words, lists: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a batch of documents, closing ids included, and where each document begins (n + 1 numbers)."""
    n = len(texts)
    coded = pc.list_flatten(lists).dictionary_encode()
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    pieces = words.of_words(coded.dictionary.to_pylist())
    counts = np.asarray(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False), np.int64)
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces)) // 4
    begin = np.concatenate(([0], np.cumsum(sizes)))
    flat = np.frombuffer(b"".join(pieces), "<u4")
    owner = np.repeat(np.arange(n), counts)
    of_word = sizes[code] if len(code) else np.zeros(0, np.int64)
    totals = np.bincount(owner, weights=of_word, minlength=n).astype(np.int64)
    whole = np.flatnonzero(pc.is_valid(texts).to_numpy(zero_copy_only=False))
    others = [np.frombuffer(x, "<u4") for x in words.of_texts([texts[i].as_py() for i in whole.tolist()])] if len(whole) else []
    totals[whole] = [len(x) for x in others]
    starts = np.concatenate(([0], np.cumsum(totals + 1)))
    ids = np.full(starts[-1], CLOSING, np.uint32)
    if len(code):
        ends = np.cumsum(of_word)
        within = np.arange(ends[-1]) - np.repeat(ends - of_word, of_word)
        place = np.ones(starts[-1], bool)
        place[starts[1:] - 1] = False
        for i in whole.tolist():
            place[starts[i] : starts[i + 1]] = False
        ids[place] = flat[np.repeat(begin[code], of_word) + within]
    for i, x in zip(whole.tolist(), others, strict=True):
        ids[starts[i] : starts[i + 1] - 1] = x
    return ids, starts


def pieces(docs: DataFrame, path: str, length: int = LENGTH) -> DataFrame:
    """``doc_id``, ``start``, ``length``, ``ids_crc32``, ``doc_tokens`` of every piece of every document."""
    text = F.coalesce("text", F.lit(""))
    easy = text.rlike(SAFE) & ~F.contains(text, F.lit("<|"))
    split = docs.select("doc_id", F.length(text).alias("n"), easy.alias("easy"), text.alias("text"))
    split = split.select("doc_id", F.when(F.col("easy"), F.regexp_extract_all(F.lower("text"), F.lit(SPLIT), F.lit(0))).alias("words"), F.when(~F.col("easy"), F.col("text")).alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = worker_words(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                ids, starts = ids_of_batch(words, part.column("words"), part.column("text"))
                total = np.diff(starts)
                cuts = -(-total // length)
                doc = np.repeat(np.arange(part.num_rows), cuts)
                start = (np.arange(len(doc)) - np.repeat(np.cumsum(cuts) - cuts, cuts)) * length
                size = np.minimum(length, total[doc] - start)
                raw, at_byte = ids.astype("<u4").tobytes(), (starts[:-1][doc] + start) * 4
                crc = [zlib.crc32(memoryview(raw)[a : a + 4 * k]) for a, k in zip(at_byte.tolist(), size.tolist(), strict=True)]
                yield pa.record_batch([part.column("doc_id").take(pa.array(doc)), pa.array(start), pa.array(size), pa.array(crc, pa.int64()), pa.array(total[doc])], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return split.mapInArrow(work, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each size; no size is over ``capacity``."""
    n = len(sizes)
    leaves = 1 << max(0, (n - 1).bit_length())
    room = [capacity] * (2 * leaves)
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i in np.argsort(-sizes, kind="stable").tolist():
        size, node = int(sizes[i]), 1
        while node < leaves:
            node *= 2
            if room[node] < size:
                node += 1
        bins[i], offsets[i] = node - leaves, capacity - room[node]
        room[node] -= size
        while node > 1:
            node //= 2
            best = max(room[2 * node], room[2 * node + 1])
            if room[node] == best:
                break
            room[node] = best
    return bins, offsets


def pack(pieces_of_all: DataFrame, capacity: int = LENGTH, group: int = GROUP) -> DataFrame:
    """Pieces (written rows) with ``sequence_id`` and ``offset``."""
    n = pieces_of_all.count()
    groups = max(1, round(n / group))
    columns = pieces_of_all.columns
    # Each row's own number is in the hash, so that repeated rows are dealt to all groups.
    dealt = pieces_of_all.withColumn("__group", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", F.monotonically_increasing_id()), F.lit(groups)).cast("long"))

    def work(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True], kind="stable")
        bins, offsets = first_fit_decreasing(part["length"].to_numpy(), capacity)
        return part[columns].assign(sequence_id=part["__group"].to_numpy() * (1 << 32) + bins, offset=offsets)

    schema = T.StructType([*pieces_of_all.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return dealt.groupBy("__group").applyInPandas(work, schema)


def pack_documents(df: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    docs = text_columns(df, id_col, text_col)
    return pack(materialize(pieces(docs, path or vocabulary()), "pieces"))


def op3_ffd_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
