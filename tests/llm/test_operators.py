"""Each operator against a plain version on a small fixture, with nulls, empties, ties, repeats and clashing names."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from ordina.llm import ann_codes, bpe, components, language_id, line_dedup, packing, pii, pivot_search, simhash_dedup, substring_dedup, url_filter

DOCS = "doc_id long, text string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(b):
    return hashlib.sha256(b).hexdigest()


def group(pairs, nodes):
    at = {n: n for n in nodes}

    def root(x):
        while at[x] != x:
            x = at[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        at[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1200)] + [(5, 5), (None, 3)]
    got = components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    want = group([(a, b) for a, b in edges if a is not None], {x for e in edges for x in e if x is not None})
    by_root = {}
    for r in got:
        by_root.setdefault(r["root"], set()).add(r["node"])
    expected = {}
    for n, r in want.items():
        expected.setdefault(r, set()).add(n)
    assert sorted(map(sorted, by_root.values())) == sorted(sorted(v) for v in expected.values() if len(v) > 1)
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def vectors(n=400, dim=16, seed=2):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dim)).astype(np.float32)
    x[7], x[9] = x[5], x[5]
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    return x.astype(np.float64), rows + [(None, [1.0] * dim, 1), (1000, None, 1), (1050, [float("nan")] * dim, 1), (1100, [], 1), rows[3], (1200, [1.0, 2.0], 1), (1201, [1.0, 2.5], 1)]


VECTORS = "vec_id long, embedding array<float>, raw int"


def by_query(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    return out


def test_one_bit_ann_has_recall(spark):
    x, rows = vectors()
    index = ann_codes.build_index(spark.createDataFrame(rows + [(1150, [0.0] * 16, 1)], VECTORS))
    got = by_query(ann_codes.nearest(index, index.where("vec_id % 50 = 0")).collect())
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = 0
    # Vectors of another length meet only each other.
    assert [v for v, _ in got.pop(1200)] == [1201] and sorted(got) == list(range(0, 400, 50))
    for q, found in got.items():
        score = unit @ unit[q]
        score[q] = -9
        best = np.lexsort((np.arange(400), -score))[:5]
        hits += len({v for v, _ in found} & set(best.tolist()))
        assert all(abs(s - score[v]) < 1e-12 for v, s in found) and len(found) == 5
    assert hits >= 0.9 * 5 * len(got)
    empty = ann_codes.build_index(spark.createDataFrame([], VECTORS))
    assert ann_codes.nearest(empty, empty).count() == 0


def test_one_bit_ann_on_the_given_vectors(spark):
    """Recall against brute force over the whole table."""
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select("vec_id", "embedding").collect()
    keep = [r for r in rows if r["embedding"] and all(v is not None and np.isfinite(v) for v in r["embedding"]) and any(r["embedding"])]
    ids, x = np.array([r["vec_id"] for r in keep]), np.array([r["embedding"] for r in keep], float)
    unit, hits = x / np.linalg.norm(x, axis=1, keepdims=True), 0
    got = by_query(ann_codes.op1_one_bit_ann(spark, "/root/testdata/sf0.01").collect())
    assert sorted(got) == sorted(int(i) for i in ids if i % 50 == 0)
    for i in np.flatnonzero(ids % 50 == 0):
        score = unit @ unit[i]
        score[i] = -9
        hits += len({v for v, _ in got[int(ids[i])]} & set(ids[np.lexsort((ids, -score))[:5]].tolist()))
    assert hits >= 0.95 * 5 * len(got)


def test_different_vectors_of_one_id_all_count(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [0.0, 2.0]), (1, [0.0, 2.0]), (1, [3.0, 0.5]), (2, [-1.0, -1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    index = ann_codes.build_index(df)
    got = by_query(ann_codes.nearest(index, index.where("vec_id = 0")).collect())[0]
    assert [v for v, _ in got] == [1, 1, 1, 1, 2][: len(got)] and abs(got[0][1] - 1) < 1e-12 and len(got) == 5
    table = pivot_search.scaled_vectors(df)
    whole = [(v, int(np.dot(np.array(q) * 256, np.array(e) * 256))) for q in ([1.0, 0.0], [0.0, 1.0]) for v, e in {(v, tuple(e)) for v, e in rows} if v]
    want = sorted(set(whole), key=lambda x: (-x[1], x[0]))[:5]
    assert by_query(pivot_search.PivotIndex(table).top(table.where("vec_id = 0")).collect())[0] == want


@pytest.mark.parametrize("at_once", [20_000, 0])
def test_pivot_search_is_exact(spark, monkeypatch, at_once):
    monkeypatch.setattr(pivot_search, "META_AT_ONCE", at_once)
    x, rows = vectors()
    table = pivot_search.scaled_vectors(spark.createDataFrame(rows, VECTORS))
    got = by_query(pivot_search.PivotIndex(table).top(table.where("vec_id % 50 = 0")).collect())
    whole = np.floor(x * 256).astype(np.int64)
    for q in range(0, 400, 50):
        score = whole @ whole[q]
        score[q] = -(10**12)
        best = np.lexsort((np.arange(400), -score))[:5]
        assert got[q] == [(int(v), int(score[v])) for v in best]
    assert got.pop(1200) == [(1201, 256 * 256 + 512 * 640)] and len(got) == 8
    assert pivot_search.exact_scores(np.array([[2.0**40]]), np.array([[2.0**30]]))[0, 0] == 2**63 - 1


def test_language_id(spark):
    rng = random.Random(4)
    words = {"en": "the and of house water with this".split(), "de": "der und das haus wasser mit nicht schön".split(), "fr": "le et la maison eau avec été pas".split(), "es": "el y la casa agua con niño año".split()}
    rows = [(i, " ".join(rng.choice(words[v]) for _ in range(30)), v) for i, v in enumerate(list(words) * 50)]
    df = spark.createDataFrame([*rows, (None, "the house", "en"), (900, None, "en"), (901, "123 !!", "de"), (902, "", "fr"), (903, "der und das", None)], "doc_id long, text string, lang string")
    model = language_id.learn(df)
    predicted = language_id.predict(df.union(df.where("doc_id = 0")).selectExpr("doc_id", "text", "lang", "1 as score", "2 as text__"), model)
    got = predicted.collect()
    assert predicted.columns == ["doc_id", "text", "lang", "text__", "lang_pred", "score"] and len(got) == len(rows) + 6
    assert all(r["lang_pred"] == r["lang"] for r in got if r["doc_id"] is not None and r["doc_id"] < 900)
    assert all(0 <= r["score"] <= 1 for r in got)
    assert {r["doc_id"]: r["lang_pred"] for r in got if r["doc_id"] in (900, 901, 902, 903)} == {900: "und", 901: "und", 902: "und", 903: "de"}
    assert language_id.learn(df.where("false")) is None
    assert {r["lang_pred"] for r in language_id.predict(df, None).collect()} == {"und"}
    assert [r[0] for r in df.where("doc_id < 9").orderBy("doc_id").select(language_id.held_out()).collect()] == [zlib.crc32(str(i).encode()) % 3 == 1 for i in range(9)]


def test_language_id_on_held_out_documents(spark):
    """Documents that nothing was learned from, against their labels; and more languages than a few."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = docs.where("lang is not null").join(language_id.op2_hierarchical_language_id(spark, "/root/testdata/sf0.01").where("held_out"), "doc_id").where("lang_pred <> 'und'")
    right, n = held.selectExpr("count_if(lang = lang_pred)", "count(*)").first()
    assert n > 200 and right >= 0.97 * n
    rng = random.Random(41)
    own = {f"l{k}": [f"{rng.choice('bcdfgklm')}{k}x{rng.choice('aeiou')}".translate(str.maketrans("0123456789", "qwrtzpsjvh")) for _ in range(9)] for k in range(70)}
    rows = [(i, " ".join(rng.choice(ws) for _ in range(40)), v) for i, (v, ws) in enumerate(list(own.items()) * 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert len(language_id.learn(df).languages) == 70
    x = [language_id.vector(t) for _, t, _ in rows[:50]]
    sparse = language_id.Rows([np.flatnonzero(v) for v in x], [v[v > 0] for v in x])
    w, g = np.arange(language_id.DIMS + 1.0), np.arange(50.0)
    dense = np.hstack([np.stack(x), np.ones((50, 1))])
    assert np.allclose(sparse.times(w), dense @ w) and np.allclose(sparse.weighed(g), dense.T @ g)


def test_packing_deals_repeated_rows(spark):
    df = spark.range(20_000).selectExpr("cast(null as bigint) as doc_id", "'' as text", "1 as words", "2 as __group")
    sizes = packing.pack_documents(df).groupBy(F.shiftright("sequence_id", 32)).count().collect()
    assert sum(r["count"] for r in sizes) == 20_000 and max(r["count"] for r in sizes) < 3000


def test_packing(spark):
    from tokenizers import Tokenizer

    rng = random.Random(5)
    texts = [" ".join(rng.choice(["it's", "Straße", "ÉTÉ", "x1", "hello!!", "we'll"]) for _ in range(rng.randrange(900))) for _ in range(60)]
    rows = list(enumerate([*texts, None, "", "日本語", "<|endoftext|> a", "İ ΣΑΣ", "y" * 9000])) + [(None, "no id")]
    tool = Tokenizer.from_file(packing.vocabulary())
    tool.encode_special_tokens = True
    ids = {d: np.array([*tool.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for d, t in rows}
    got = packing.pack_documents(spark.createDataFrame(rows, DOCS)).collect()
    bins, covered = {}, {}
    for r in got:
        own = ids[r["doc_id"]]
        assert zlib.crc32(own[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"] and r["doc_tokens"] == len(own)
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        covered[r["doc_id"]] = covered.get(r["doc_id"], 0) + r["length"]
    assert covered == {d: len(x) for d, x in ids.items()}
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack_documents(spark.createDataFrame([], DOCS)).count() == 0
    sizes = np.array([rng.randint(1, 2048) for _ in range(300)])
    where, offset = packing.first_fit_decreasing(sizes, 2048)
    room, want = [], np.zeros(300, int)
    for i in np.argsort(-sizes, kind="stable"):
        k = next((k for k, r in enumerate(room) if r >= sizes[i]), len(room))
        room += [2048] * (k == len(room))
        room[k] -= sizes[i]
        want[i] = k
    assert (where == want).all() and (offset + sizes <= 2048).all()


def line_reference(docs):
    """Brute force: all pairs of distinct normal lines."""
    def words(line):
        return [w for w in re.split(r"[^\w]+|_", line.lower()) if w]

    def edit(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    first = {}
    for d, t in sorted((d, t) for d, t in docs if d is not None and t is not None):
        for pos, line in enumerate(t.split("\n")):
            if ws := words(line):
                first.setdefault(" ".join(ws), (d, pos))
    keys = sorted(first)
    near = [(a, b) for i, a in enumerate(keys) for b in keys[i + 1 :] if edit(a, b) <= 0.2 * max(len(a), len(b)) + 1e-9]
    roots = group(near, keys)
    keep = {}
    for k in keys:
        keep[roots[k]] = min(keep.get(roots[k], first[k]), first[k])
    out = []
    for d, t in docs:
        kept = None if t is None else "\n".join(x for pos, x in enumerate(t.split("\n")) if d is None or not (ws := words(x)) or keep[roots[" ".join(ws)]] == (d, pos))
        out.append((d, kept))
    return out


def test_line_dedup(spark):
    rng = random.Random(6)
    stock = [" ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) for _ in range(30)) for _ in range(12)]

    def line():
        ws = rng.choice(stock).split()
        if rng.random() < 0.5:
            ws[rng.randrange(30)] = rng.choice(["beta", "x", "omega"])
        return (" ".join(ws)).title() if rng.random() < 0.3 else " ".join(ws) + rng.choice(["", "!", "."])

    docs = [(i, "\n".join(line() for _ in range(rng.randrange(6)))) for i in range(30)] + [(100, None), (101, ""), (102, "---\n---"), (None, stock[0])]
    df = spark.createDataFrame([(d, t, 7, 8) for d, t in docs], "doc_id long, text string, n_removed int, __gone int")
    # A repeated row is the same document, and has the same result.
    got = line_dedup.dedup_lines(df.union(df.where("doc_id = 3"))).distinct()
    assert got.columns == ["doc_id", "text", "__gone", "n_lines", "n_removed"]
    assert sorted(map(str, ((r["doc_id"], r["text"]) for r in got.collect()))) == sorted(map(str, line_reference(docs)))
    assert line_dedup.dedup_lines(df.where("false")).count() == 0


def test_line_dedup_long_lines_and_a_frequent_word(spark, monkeypatch):
    rng = random.Random(31)
    word = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    long = [word(7) for _ in range(9000)]
    near = [w if rng.random() > 0.02 else word(7) for w in long]
    docs = [(1, " ".join(long)), (2, " ".join(near)), (3, " ".join(long[:4000])), (4, "\n".join(["same line again"] * 500))]
    docs += [(1000 + i, " ".join(["the"] * 6 + [word(12), word(12)])) for i in range(600)]
    tried, counted = [], line_dedup._verified
    monkeypatch.setattr(line_dedup, "_verified", lambda pairs, words: tried.append(pairs.count()) or counted(pairs, words))
    got = {r["doc_id"]: r["n_removed"] for r in line_dedup.dedup_lines(spark.createDataFrame(docs, DOCS)).collect()}
    assert got == {d: {2: 1, 4: 499}.get(d, 0) for d, _ in docs}
    # Lines of one frequent word are far from all pairs of each other.
    assert sum(tried) < 600


def test_substring_dedup(spark):
    rng = random.Random(7)
    docs = [(i, " ".join(rng.choice("ab") for _ in range(rng.randrange(70)))) for i in range(80)] + [(500, None), (501, " \n"), (502, "x " * 90)]
    first, words = {}, {d: WORD.findall(t or "") for d, t in docs}
    for d in sorted(words):
        for i in range(len(words[d]) - 19):
            first.setdefault(tuple(words[d][i : i + 20]), (d, i))
    want = {}
    for d, ws in words.items():
        gone = set()
        for i in range(len(ws) - 19):
            if first[tuple(ws[i : i + 20])] != (d, i):
                gone |= set(range(i, i + 20))
        want[d] = (len(ws), len(gone), " ".join(w for i, w in enumerate(ws) if i not in gone))
    df = spark.createDataFrame([(d, t, 1, 2) for d, t in [*docs, (502, "x " * 90), (None, "x " * 90)]], "doc_id long, text string, bucket int, th int").repartition(5)
    rows = substring_dedup.remove_repeats(df).collect()
    assert len(rows) == len(docs) + 2
    for r in rows:
        assert (r["n_words"], r["n_removed"], r["text"]) == (want[r["doc_id"]] if r["doc_id"] is not None else (90, 0, " ".join(["x"] * 90)))
    assert substring_dedup.remove_repeats(df.where("false")).count() == 0
    # One very long text, whose second half repeats its first.
    long = [f"w{i}" for i in range(60_000)]
    row = substring_dedup.remove_repeats(spark.createDataFrame([(1, " ".join(long * 2))], DOCS)).first()
    assert (row["n_words"], row["n_removed"], row["text"]) == (120_000, 60_000, " ".join(long))


def test_simhash_dedup(spark):
    rng = random.Random(8)
    base = [" ".join(rng.choice("one two three four five six seven".split()) for _ in range(60)) for _ in range(10)]
    docs = []
    for i in range(80):
        ws = rng.choice(base).split()
        if rng.random() < 0.6:
            ws[rng.randrange(60)] = "Changed"
        docs.append((i, " ".join(ws)))
    docs += [(200, None), (201, "  "), (202, "a b"), (203, "a b"), (204, " ".join(f"long{i}" for i in range(50_000)))]

    def plain(t):
        ws = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        hs = [xxhash.xxh64_intdigest(" ".join(ws[i : i + 3]).encode(), 42) for i in range(max(1, len(ws) - 2))] if ws else []
        return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs)) if hs else 0

    fps = {d: plain(t) for d, t in docs}
    roots = group([(a, b) for a in fps for b in fps if a < b and (fps[a] ^ fps[b]).bit_count() <= 3], fps)
    df = spark.createDataFrame([(d, t, 1, 2) for d, t in docs], "doc_id long, text string, fp int, root int")
    some = simhash_dedup.near_duplicates(spark.createDataFrame([(None, "a b"), (5, "a b"), (None, "c d e")], DOCS)).collect()
    assert {(r["doc_id"], r["component_id"]) for r in some} == {(None, None), (None, 5), (5, 5)}
    assert sorted(map(str, simhash_dedup.keep_one(df).columns)) == ["doc_id", "fp", "root", "text"]
    got = {r["doc_id"]: (r["fp"] & (2**64 - 1), r["component_id"]) for r in simhash_dedup.near_duplicates(df).collect()}
    assert got == {d: (fps[d], roots[d]) for d in fps}
    nodes = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in set(fps.values())], "fp long")
    tiled = [(r["a"] & (2**64 - 1), r["b"] & (2**64 - 1)) for r in simhash_dedup.fingerprint_links(nodes, tile=2).collect()]
    by_fp = group(tiled, set(fps.values()))
    assert all((by_fp[fps[a]] == by_fp[fps[b]]) == (roots[a] == roots[b]) for a in fps for b in fps)
    assert sorted(r["doc_id"] for r in simhash_dedup.keep_one(df.union(df.where("doc_id = 202"))).collect()) == sorted(set(roots.values()))
    assert simhash_dedup.near_duplicates(df.where("false")).count() == 0


def test_bpe(spark):
    import tiktoken

    tool = tiktoken.Encoding("own", pat_str=bpe.pattern(), mergeable_ranks=bpe.ranks_of(bpe.vocabulary()), special_tokens={})
    texts = ["Hello world, it's 2024!", None, "", "   ", "naïve Straße ½ ﬁ", "日本語\u0085 x", "a" * 300, "<|endoftext|>", "tab\t\n\n x"]
    rng = random.Random(9)
    texts += ["".join(rng.choice("abcdehinrst") for _ in range(n)) for n in (127, 128, 129, 5000)]
    rows = list(enumerate(texts)) + [(None, "no id"), (0, texts[0])]
    df = spark.createDataFrame([(d, t, 1, 2) for d, t in rows], "doc_id long, text string, words int, slice int")
    got = sorted(((r["doc_id"], r["ids"], bytes(r["decoded"])) for r in bpe.encode_decode(df).collect()), key=str)
    assert got == sorted(((d, tool.encode_ordinary(t or ""), (t or "").encode()) for d, t in rows), key=str)
    digest = {r["doc_id"]: r for r in bpe.encode_decode(df, digests=True).collect()}
    assert digest[4]["ids_sha256"] == sha(np.array(tool.encode_ordinary(texts[4]), "<u4").tobytes()) and digest[4]["decoded_sha256"] == sha(texts[4].encode())
    word = "".join(random.Random(9).choice("abcdehinrst") for _ in range(400)).encode()
    assert bpe.merged_by_heap(word, bpe.ranks_of(bpe.vocabulary())) == tool.encode_ordinary(word.decode())
    assert bpe.encode_decode(df.where("false")).count() == 0


def test_bpe_splits_and_slices(monkeypatch):
    import pyarrow as pa
    import regex

    rng = random.Random(13)
    parts = ["'", "'s", "'ll", "'re", " ", "  ", "\n", "\t", "a", "S", "1", "½", "!", "é", "日", "\u0301", "\x85", "\x1c", "\u00a0", "\u200b", "\0", "😀", "ve", "d", "_"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(12))) for _ in range(5000)] + [None, ""]
    pieces, counts = bpe.split_pieces(pa.array(texts, pa.string()))
    assert bpe.pattern() == bpe.KNOWN_PATTERN
    assert [p.decode() for p in pieces.to_pylist()] == [p for t in texts for p in (*regex.findall(bpe.pattern(), t or ""), "\0")]
    monkeypatch.setattr(bpe, "SLICE", 1)
    whole = pa.record_batch([pa.array([1, None, 3], pa.int64()), pa.array(["a b", None, "b"])], ["doc_id", "text"])
    read = lambda numbers: [r for b in bpe._sliced(3, numbers)(iter([whole, whole.slice(0, 0), whole])) for r in b.to_pylist()]
    words, rows = {}, read(True)
    for r in sorted(read(False), key=lambda r: (r["slice"], r["bucket"])):
        cut = np.cumsum([0, *bpe._numbers(r["lengths"]).tolist()]).tolist()
        words.setdefault(r["slice"], []).extend(bpe._decompressed(r["words"])[i:j] for i, j in zip(cut, cut[1:]))
    assert len(rows) == 2 and sorted(words) == sorted(r["slice"] for r in rows)
    for r in rows:
        own = [words[r["slice"]][c] for c in bpe._numbers(r["places"])[bpe._numbers(r["codes"])]]
        assert (own, r["counts"], r["valid"]) == ([b"a", b" b", b"b"], [2, 0, 1], [True, False, True])


PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def test_pii(spark):
    rng = random.Random(10)
    for _ in range(3000):
        text = "".join(rng.choice("a1@.+- ()25x") for _ in range(rng.randrange(40)))
        want = []
        for k, p in enumerate(PATTERNS):
            for m in re.finditer(p, text):
                digits = "".join(c for c in m[0] if c.isdigit())
                if (True, k == 1 and all(int(x) <= 255 for x in m[0].split(".")), 12 <= len(digits) <= 19 and pii.luhn(digits), 9 <= len(digits) <= 15)[k]:
                    want.append((m.start(), k, m.end()))
        assert pii.base_spans(text) == sorted(want)
    assert pii.base_spans("1.2.3." + "0" * 5000) == [(0, 1, 5006)] and pii.base_spans("1.2.3." + "9" * 5000) == []
    texts = ["mail é a.b@c.de now", None, "", "the number is 0301 2345678 and", "in 2019-04-12, at 10:22:31, 3.14159265 of 2018/2019", "write me: joe (at) site (dot) org", "fe80::1ff:fe23:4567:890a", 'x token = "55cf1b56d3d000479a9bdb231e139ff0e3d87397" y', "4111.1111.1111.1111", "word: something-else_here"]
    df = spark.createDataFrame([(i, t, 1) for i, t in [*enumerate(texts), (None, texts[0]), (0, texts[0])]], "doc_id long, text string, spans int")
    rows = pii.find_personal_data(df).collect()
    got = {r["doc_id"]: r for r in rows}
    assert len(rows) == 12 and got[0]["spans"] == got[None]["spans"] == "email:7:15" and got[0]["base_sha256"] == sha(b"email:7:15") and got[0]["n_email"] == 1
    assert got[1]["spans"] == "" == got[2]["spans"] and got[1]["base_sha256"] == sha(b"")
    kinds = {i: got[i]["spans"].split(":")[0] for i in range(3, 10)}
    assert kinds == {3: "phone", 4: "", 5: "email", 6: "ip", 7: "secret", 8: "card", 9: ""}
    clean = pii.redact(df)
    assert clean.columns == df.columns and clean.where("doc_id = 0").first()["text"] == "mail é [EMAIL] now" and clean.where("doc_id = 7").first()["text"] == 'x token = "[SECRET]" y'
    assert pii.find_personal_data(df.where("false")).count() == 0


def test_pii_many_candidates_take_little_time():
    import time

    trees = pii.Boosted(*pii.made_up_halves())
    text = " ".join(f"the number is 030 {(i * 7919 + 2345678) % 9_000_000 + 1_000_000} and" for i in range(100_000))
    began = time.time()
    base, every = pii.all_spans(text, trees)
    assert not base and len(every) > 50_000 and all(a[2] <= b[0] for a, b in zip(every, every[1:])) and time.time() - began < 60


def test_pii_thresholds_hold_on_labels_of_documents(spark):
    """Candidates of the given documents that no tree has seen, held against their labels."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    trees, seen, right, found = pii.learn(docs), 0, 0, 0
    for text in (r["text"] or "" for r in docs.collect()):
        base = pii.base_spans(text)
        free = [c for c in pii.candidates(text) if all(c[2] <= s or e <= c[0] for s, _, e in base)]
        own = [(c, label) for c in free if (label := pii.weak_label(text, c, base)) is not None]
        for c, label in own:
            taken = trees.probability(np.array([pii.features(text, c)]))[0] >= trees.threshold[c[1]]
            seen, right, found = seen + label, right + (taken and label), found + taken
    assert seen > 10 and right >= 0.95 * found and right >= 0.9 * seen


def test_url_filter(spark):
    rng = random.Random(11)
    rules = [("net", "/", "block"), ("a.net", "/en/", "allow"), ("b.a.net", "/", "block"), ("a.net", "/", "allow"), ("com", "/x", "block"), ("c.com", "/x/y", "allow"), ("net", "/", "block"), (None, "/", "block")]
    urls = [f"http://{'.'.join(rng.choice('abc') for _ in range(rng.randrange(3)))}{rng.choice(['', '.', 'A.'])}{rng.choice(['net', 'com', 'a.net', 'c.com', 'NET'])}{rng.choice(['', '/', '/en/1', '/x/y?q', '/x#t', '?a/b', '#z'])}" for _ in range(200)]
    urls += [None, "", "nothing", "x://", "://net/", "http://net:80/", "http://net./"]
    pages = spark.createDataFrame([(i, u, "old", 5) for i, u in enumerate(urls)], "page_id long, url string, host string, rule int").withColumns({"stack": F.lit(7), "__url": F.lit(8), "__mine": F.lit(9)})

    def judge(u):
        if u is None or "://" not in u:
            return "", "", None, "allow"
        rest = re.split(r"[?#]", u.split("://", 1)[1], maxsplit=1)[0]
        host = rest.split("/")[0]
        path, host = rest[len(host) :], "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
        return host, path, max(fits)[2] if fits else None, max(fits)[3] if fits else "allow"

    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    assert url_filter.judge_urls(pages, table).columns == ["page_id", "url", "stack", "__url", "__mine", "host", "path", "rule", "verdict"]
    hosts = pages.select(url_filter.parse(F.col("url"))[0].alias("host")).distinct()
    stacks = lambda n: sorted(map(str, url_filter.sweep(hosts, table.dropna(), n).collect()))
    assert stacks(3) == stacks(100_000)
    assert url_filter.judge_urls(pages.union(pages), table).count() == 2 * len(urls)
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge_urls(pages, table).collect()}
    assert got == {i: judge(u) for i, u in enumerate(urls)}
    assert {r["verdict"] for r in url_filter.judge_urls(pages, table.where("false")).collect()} == {"allow"}
    assert url_filter.judge_urls(pages.where("false"), table).count() == 0


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(12)
    rows = [(i, "\n".join(" ".join(rng.choice("the house and water of tree".split()) for _ in range(12)) for _ in range(3)) + " mail a@b.de", "en", "s", 1) for i in range(40)] + [(50, "123", "en", "s", 3), (51, None, "en", "s", 0)]
    spark.createDataFrame([*rows, (60, rows[0][1], "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialize(stage(spark, docs, str(tmp_path)), "stage")
        assert docs.columns == list(corpus_pipeline.COLUMNS), name
        kept.append({r["doc_id"] for r in docs.collect()})
    assert kept[0] == {*range(40), 60} and kept[1] == kept[0] and kept[3] == kept[2] <= kept[1]
    assert not docs.where("text like '%a@b.de%'").count()
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == kept[3]
    spark.read.parquet(f"{tmp_path}/documents.parquet").where("false").withColumn("stack", F.lit(1)).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
