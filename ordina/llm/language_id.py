"""Operator 2: language identification by hierarchical discrimination.

A text is lower-cased; bytes of ASCII characters that are not letters count as one kind of blank; each byte trigram is
hashed to one of DIMS features and a text is its vector of square roots of relative frequencies (length 1).  A linear
classifier (one squared-hinge machine for each family, against the rest) names the language family first; inside it,
one-versus-one linear support vector machines vote among its languages.  The score is the product of the family's
and the language's logistic scores of the margins.

Learning takes about PER_LANGUAGE labelled texts of each language, however many languages there are, chosen by a hash of the
id (their features are made on the executors and stay sparse on the driver); everything else covers all rows.  FAMILIES names the known families; another code is a family
of its own.  Whole texts are read, in learning and in prediction.

Null text, or a text without a letter: ``und`` with score 0 (as for every text where nothing was learned).  Null lang rows
are not learned from.  Null doc_id: predicted, never learned from, ``held_out`` false.  Repeated rows: each predicted.
Empty table: empty result.  Other columns of the input are kept, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import byte_slices, restored, shielded, table

DIMS, PER_LANGUAGE, C = 1 << 13, 500, 20.0
#: Languages by family.
FAMILIES = {
    "germanic": ("en", "de", "nl", "af", "sv", "da", "no", "nb", "nn", "is", "fy", "lb", "yi"),
    "romance": ("fr", "es", "it", "pt", "ca", "gl", "ro", "oc", "la"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "sl", "hr", "sr", "bs", "mk", "bg"),
    "uralic": ("fi", "et", "hu"), "baltic": ("lt", "lv"), "turkic": ("tr", "az", "kk", "uz"), "semitic": ("ar", "he", "mt"),
    "indic": ("hi", "ur", "bn", "mr", "ne", "pa", "gu"), "sinitic": ("zh", "yue"), "celtic": ("ga", "cy", "br", "gd"),
}
_FAMILY = {code: name for name, codes in FAMILIES.items() for code in codes}
_BLANK = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))


def family_of(lang: str) -> str:
    return _FAMILY.get(lang.split("-")[0].lower(), lang)


def trigrams(text: str) -> np.ndarray:
    """Hashed trigrams of a text; those of blanks only are left out."""
    raw = b" ".join(text.lower().encode().translate(_BLANK).split())
    b = np.frombuffer(b" " + raw + b" ", np.uint8).astype(np.uint32)
    return (((b[:-2] << 16 | b[1:-1] << 8 | b[2:]) * np.uint32(2654435761)) >> np.uint32(19)).astype(np.int64)


def vector(text: str) -> np.ndarray:
    counts = np.bincount(trigrams(text), minlength=DIMS)[:DIMS]
    return np.sqrt(counts / max(1, counts.sum())).astype(np.float32)


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


class Rows:
    """Sparse rows: where the values of each row begin, their columns and values.  The last column is always 1 (the bias)."""

    def __init__(self, columns: list[np.ndarray], values: list[np.ndarray]):
        self.n = len(columns)
        one = np.full(1, DIMS, np.int64)
        self.columns = np.concatenate([x for c in columns for x in (c, one)]) if columns else np.zeros(0, np.int64)
        self.values = np.concatenate([x for v in values for x in (v, np.ones(1, np.float32))]) if values else np.zeros(0, np.float32)
        self.sizes = np.array([len(c) + 1 for c in columns], np.int64)
        self.begin = np.cumsum(self.sizes) - self.sizes

    def some(self, rows: np.ndarray) -> Rows:
        cut = [slice(self.begin[i], self.begin[i] + self.sizes[i] - 1) for i in rows.tolist()]
        return Rows([self.columns[c] for c in cut], [self.values[c] for c in cut])

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.add.reduceat(self.values * w[self.columns], self.begin)

    def weighed(self, g: np.ndarray) -> np.ndarray:
        """The sum of the rows, each times its number."""
        return np.bincount(self.columns, weights=self.values * np.repeat(g, self.sizes), minlength=DIMS + 1)


def squared_hinge(x: Rows, sign: np.ndarray, steps: int = 150) -> np.ndarray:
    """Weights (the last is the bias) of a linear machine with squared hinge loss, by accelerated gradient steps."""
    share = np.where(sign > 0, 0.5 / max(1, (sign > 0).sum()), 0.5 / max(1, (sign < 0).sum()))
    w = np.zeros(DIMS + 1)
    v, rate = w.copy(), 1 / (1 / C + 4.0)
    for t in range(steps):
        slack = np.maximum(0, 1 - sign * x.times(v))
        step = v - rate * (v / (C * 10) - 2 * x.weighed(share * sign * slack))
        v = step + t / (t + 3) * (step - w)
        w = step
    return w.astype(np.float32)


class Hierarchy:
    """Families' machines and, inside each family, a machine for each pair of languages."""

    def __init__(self, x: Rows, langs: list[str]):
        names = np.array(langs)
        self.languages = sorted(set(langs))
        fams = np.array([family_of(v) for v in langs])
        self.families = sorted(set(fams.tolist()))
        self.members = {f: [v for v in self.languages if family_of(v) == f] for f in self.families}
        one = lambda mask: squared_hinge(x, np.where(mask, 1, -1))
        self.by_family = np.stack([one(fams == f) for f in self.families]) if len(self.families) > 1 else np.zeros((len(self.families), DIMS + 1), np.float32)
        self.pairs = {f: [(i, j, self._pair(x, names, own[i], own[j])) for i in range(len(own)) for j in range(i + 1, len(own))] for f, own in self.members.items()}

    @staticmethod
    def _pair(x: Rows, names: np.ndarray, a: str, b: str) -> np.ndarray:
        rows = np.flatnonzero((names == a) | (names == b))
        return squared_hinge(x.some(rows), np.where(names[rows] == a, 1, -1))

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        x = np.hstack([x, np.ones((len(x), 1), np.float32)])
        margin = x @ self.by_family.T
        fam = margin.argmax(axis=1)
        logistic = lambda m: 1 / (1 + np.exp(-3.0 * m.astype(np.float64)))
        score = logistic(margin.max(axis=1)) if len(self.families) > 1 else np.ones(len(x))
        found = np.empty(len(x), object)
        for k, f in enumerate(self.families):
            rows = np.flatnonzero(fam == k)
            own = self.members[f]
            sure = np.zeros((len(rows), len(own)))
            for i, j, w in self.pairs[f]:
                p = logistic(x[rows] @ w)
                sure[:, i] += p
                sure[:, j] += 1 - p
            best = sure.argmax(axis=1)
            found[rows] = np.array(own, object)[best]
            score[rows] *= sure[np.arange(len(rows)), best] / max(1, len(own) - 1) if len(own) > 1 else 1.0
        return found.tolist(), np.clip(score, 0, 1)


def learn(df: DataFrame, per_language: int = PER_LANGUAGE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Hierarchy | None:
    """A hierarchy from about ``per_language`` labelled texts of each language."""
    rows = df.select(F.col(f"`{id_col}`").cast("string").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"), F.col(f"`{lang_col}`").cast("string").alias("lang"))
    rows = rows.where("doc_id is not null and lang is not null")
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # a row a language
    if not counts:
        return None
    share = F.create_map(*[F.lit(x) for v, n in sorted(counts.items()) for x in (v, min(1.0, per_language / n))])
    chosen = rows.where((F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30) < F.try_element_at(share, F.col("lang"))) & F.col("text").isNotNull())
    chosen = chosen.select("lang", "text", F.xxhash64("doc_id", "text").alias("place"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(v, np.flatnonzero(c := vector(t)).astype(np.uint16).tobytes(), c[c > 0].tobytes(), o) for v, t, o in zip(*(c.to_pylist() for c in batch.columns), strict=True) if has_letter(t)]
            yield pa.record_batch([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.string(), pa.binary(), pa.binary(), pa.int64()))], ["lang", "at", "value", "place"])

    # About per_language rows a language; twice as many at most, whatever ids are repeated.
    got = chosen.mapInArrow(work, "lang string, at binary, value binary, place long").orderBy("place", "lang").limit(2 * per_language * len(counts)).collect()
    got.sort(key=lambda r: (r["lang"], bytes(r["at"]), bytes(r["value"])))
    if not got:
        return None
    x = Rows([np.frombuffer(r["at"], np.uint16).astype(np.int64) for r in got], [np.frombuffer(r["value"], np.float32) for r in got])
    return Hierarchy(x, [r["lang"] for r in got])


def predict(df: DataFrame, model: Hierarchy | None, text_col: str = "text") -> DataFrame:
    """``df`` with ``lang_pred`` and ``score`` (replacing columns of these names)."""
    rows, names = shielded(df, ("lang_pred", "score"), text__=F.col(f"`{text_col}`").cast("string"))
    kept = [f for f in rows.schema.fields if f.name != "text__"]
    schema = T.StructType([*kept, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch, "text__", 4 << 20):
                for a in range(0, part.num_rows, 256):
                    own = part.slice(a, 256)
                    texts = own.column("text__").to_pylist()
                    usable = [i for i, t in enumerate(texts) if model is not None and has_letter(t)]
                    langs, scores = ["und"] * len(texts), np.zeros(len(texts))
                    if usable:
                        found, sure = model.predict(np.stack([vector(texts[i]) for i in usable]))
                        scores[usable] = sure
                        for i, v in zip(usable, found, strict=True):
                            langs[i] = v
                    yield pa.record_batch([*own.columns[:-1], pa.array(langs, pa.string()), pa.array(scores)], [*(f.name for f in kept), "lang_pred", "score"])

    return restored(rows.mapInArrow(work, schema), names, {}, {"lang_pred": F.col("lang_pred"), "score": F.col("score")})


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def op2_hierarchical_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = learn(docs.where(~held_out()))
    return predict(docs.select("doc_id", held_out().alias("held_out"), "text"), model).select("doc_id", "held_out", "lang_pred", "score")
