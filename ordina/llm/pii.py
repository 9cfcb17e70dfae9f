"""Operator 8: personal data by candidate generators and gradient-boosted trees.

Generators propose spans with high recall, overlaps included: the four base patterns, whose checked matches always stay, and
loose ones for each kind and for secrets (:func:`candidates`): spelled-out or local e-mail addresses, IPv6, card-like and
phone-like groups of digits with any separators or none, values assigned to names, long runs that mix letters and digits.

Each loose candidate gets format and context features; boosted trees score it.  What they learn from are labels that
:func:`weak_label` gives to candidates of the documents themselves (a bounded sample, SAMPLE_DOCS documents): checksums, base
matches, known forms of keys, cue words, and benign forms (dates, times, versions, ISBNs, decimals) that another generator
claims; where these are silent or disagree there is no label.  What a label was given by (the checksum, the cue, the form)
is no feature.  Seeded made-up lines of many forms stand in for what a corpus does not hold.  A logistic fit on the half of
the labelled candidates that the trees have not seen, the documents' and the made-up ones', turns scores into probabilities,
and each kind's threshold is the least one, 0.5 at least, at which those candidates are at least PRECISION pure; a kind
without such a threshold adds nothing.  Accepted candidates that overlap a base span, or a better candidate, give way.

Offsets are code points, ends exclusive.  Null or empty text: no spans.  Null doc_id: judged like others.  Repeated rows:
each judged.  Empty table: empty result.  Base patterns are searched whole and in time that is linear in the text; loose
candidates of a text of n of them are chosen in n log n steps.  Other columns cannot clash: spans are found from the id and
the text alone, and ``redact`` changes the text in place.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_slices, table

KINDS = ("email", "ip", "card", "phone", "secret")
#: Purity that a threshold needs on held-out candidates; trees; made-up candidates; documents learned from; candidates of one.
PRECISION, TREES, SAMPLES, SAMPLE_DOCS, OF_A_DOC, SEED = 0.99, 40, 4000, 20_000, 20, 11
Span = tuple[int, int, int]  # start, kind (place in KINDS), end

# The base patterns.  The look-behinds and possessive runs change no match: a run of digits that fails at its
# first digit fails at all others.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
# The loose ones.
_AT = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?(?:@|[\[({<] ?at ?[\])}>]| at ) ?[A-Za-z0-9-]{1,63}(?:(?:\.| ?[\[({<] ?dot ?[\])}>] ?| dot )[A-Za-z0-9-]{1,63}){0,5}")
_COLONS = re.compile(r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{1,4}:|::)(?:[0-9A-Fa-f]{0,4}:){1,7}[0-9A-Fa-f]{0,4}(?![0-9A-Za-z:])")
_GROUPS = re.compile(r"(?<![0-9A-Za-z])(?:\+|00)?[(]?[0-9]{1,19}(?:[\x20()./-]{1,2}[0-9]{1,19}){0,11}(?![0-9A-Za-z])")
_VALUE = re.compile(r"[A-Za-z_][A-Za-z0-9_.-]{1,40} ?[=:] ?[\"'`]?([^\s\"'`,;]{6,200})")
_MIXED = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{16,200}={0,2}(?![A-Za-z0-9+/_=-])")
# What labels are given by.  Fixed values: words that announce a kind, words that announce something else, forms of keys.
_CUES = {
    0: re.compile(r"mail|contact|write|reach|courriel|correo|schreib", re.I), 1: re.compile(r"\bip\b|ipv[46]|addr|host|server|ping", re.I),
    2: re.compile(r"card|visa|master|amex|credit|debit|tarjeta|carte|karte", re.I), 3: re.compile(r"call|tel|phone|mobile|cell|fax|sms|anruf|appel|llam", re.I),
    4: re.compile(r"passw|passwd|pwd|token|secret|api.?key|private|credential|bearer|contrase|kennwort", re.I),
}
_AGAINST = re.compile(r"order|invoice|isbn|version|part|ref|page|score|[$\u20ac\u00a3]|date|build|serial|commit|sha|md5|uuid|copyright|\u00a9|chapter|doi", re.I)
_KEYS = re.compile(r"(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[abpr]-[A-Za-z0-9-]{10,}|AIza[0-9A-Za-z_-]{35}|eyJ[A-Za-z0-9_-]{10,}|sk_(?:live|test)_[0-9a-zA-Z]{16,}")
_BENIGN = re.compile(r"(?:19|20)[0-9]{2}[-/.][0-9]{1,2}[-/.][0-9]{1,2}|[0-9]{1,2}[-/.][0-9]{1,2}[-/.](?:19|20)?[0-9]{2}|[0-9]{1,2}:[0-9]{2}(?::[0-9]{2})?|97[89][- ]?(?:[0-9][- ]?){9}[0-9]|[0-9]+\.[0-9]+|(?:19|20)[0-9]{2}[-/ ](?:19|20)[0-9]{2}|[0-9]{1,6}(?:[-/][0-9]{1,6})?|[0-9]{1,3}(?:[ .][0-9]{3})+|[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}|[A-Za-z]+(?:[-_/][A-Za-z]+)*")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Checked matches of the four patterns, by start, then kind."""
    found: list[Span] = []
    past, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > past and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            found.append((start, 0, m.end()))
            past = m.end()
            at = text.find("@", past)
        else:
            past, at = at + 1, text.find("@", at + 1)
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p) <= 3 and int(p or "0") <= 255 for p in (q.lstrip("0") for q in m[0].split("."))):
                found.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12:
                digits = m[0].replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and luhn(digits):
                    found.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                    found.append((m.start(), 3, m.end()))
    return sorted(found)


def candidates(text: str) -> list[Span]:
    """Loose candidates, overlaps included."""
    found: list[Span] = []
    if "@" in text or " at " in text or (("(" in text or "[" in text or "{" in text or "<" in text) and "at" in text):
        found += [(m.start(), 0, m.end()) for m in _AT.finditer(text) if m[0].rfind(".") > 0 or "dot" in m[0] or "@" in m[0]]
    if _DIGIT.search(text):
        if ":" in text:
            found += [(m.start(), 1, m.end()) for m in _COLONS.finditer(text)]
        for m in _GROUPS.finditer(text):
            n = sum("0" <= c <= "9" for c in m[0])
            if 7 <= n <= 15:
                found.append((m.start(), 3, m.end()))
            if 12 <= n <= 19:
                found.append((m.start(), 2, m.end()))
        found += [(m.start(), 4, m.end()) for m in _MIXED.finditer(text) if _DIGIT.search(m[0])]
    if "=" in text or ":" in text:
        found += [(m.start(1), 4, m.end(1)) for m in _VALUE.finditer(text)]
    return sorted(set(found))


def features(text: str, span: Span) -> list[float]:
    """Format of the span and of what is around it; nothing that labels are given by."""
    start, kind, end = span
    own, before, after = text[start:end], text[max(0, start - 24) : start], text[end : end + 12]
    digits = sum("0" <= c <= "9" for c in own)
    upper, lower = sum("A" <= c <= "Z" for c in own), sum("a" <= c <= "z" for c in own)
    hexa = sum(c in "0123456789abcdefABCDEF" for c in own)
    groups = [len(g) for g in re.split(r"[^0-9A-Za-z]+", own) if g] or [0]
    counts = [own.count(c) for c in set(own)]
    entropy = -sum(n / len(own) * math.log2(n / len(own)) for n in counts)
    turns = sum(a.isdigit() != b.isdigit() for a, b in zip(own, own[1:], strict=False))
    return [
        kind, len(own), digits, upper, lower, len(own) - digits - upper - lower, hexa / len(own), len(groups), max(groups), min(groups), groups[0], groups[-1],
        entropy, turns, len(counts), own.count("."), own.count("-"), own.count(" "), own.count(":"), own.count("/"), float(own[0] in "+("), float(own[0] == "0"),
        float(before[-1:] in "=:\"'`" and before != ""), float(before[-1:].isspace()), float(before.rstrip()[-1:] in ("=", ":")), float(bool(_DIGIT.search(before[-4:]))), float(after[:1] in "\"'`" and after != ""),
        float(after[:1] in ".,;" and after != ""), float(bool(_DIGIT.search(after[:4]))), float(sum(c.isalpha() for c in before)),
    ]


def weak_label(text: str, span: Span, base: list[Span]) -> bool | None:
    """What checksums, base matches, key forms, cue words and benign forms say of a candidate; None if nothing, or not the same."""
    start, kind, end = span
    own, before = text[start:end], text[max(0, start - 24) : start]
    digits = "".join(c for c in own if "0" <= c <= "9")
    said: list[bool] = []
    for s, k, e in base:
        if s < end and start < e:
            # A base match of the kind that reaches as far; one of another kind speaks against it.
            said.append(k == kind and s <= start + 1 and end <= e + 1)
    if kind == 2 and not said:
        said.append(luhn(digits) and digits[:1] in "3456")
    if kind == 4 and _KEYS.fullmatch(own):
        said.append(True)
    if _BENIGN.fullmatch(own):
        said.append(False)
    cue, against = bool(_CUES[kind].search(before)), bool(_AGAINST.search(before))
    if cue != against:
        said.append(cue)
    return said[0] if said and all(x == said[0] for x in said) else None


def made_up(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Features and true labels of candidates in seeded lines of many forms; no word announces them."""
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[rng.integers(len(xs))]
    of = lambda letters, k: "".join(pick(letters) for _ in range(k))
    num = lambda k: of("0123456789", k)
    word = lambda: of("abcdefghijklmnoprstuvw", rng.integers(2, 9))
    hexa = lambda k: of("0123456789abcdef", k)
    alnum = lambda k: of("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", k)

    def card() -> str:
        body = pick("3456") + num(14)
        body += next(c for c in "0123456789" if luhn(body + c))
        sep = pick((".", "/", "--", "  ", " - "[1:]))
        return sep.join(body[i : i + 4] for i in range(0, 16, 4))

    def phone() -> str:
        sep = pick(" .-/")
        forms = (f"({num(3)}) {num(3)}-{num(4)}", sep.join((num(3), num(3), num(4))), f"0{num(2)}{sep}{num(7)}", f"0{num(1)}{sep}" + sep.join(num(2) for _ in range(4)), f"00{num(2)}{sep}{num(3)}{sep}{num(6)}", f"{num(3)}{sep}{num(4)}", f"0{num(9)}", f"06-{num(8)}")
        return pick(forms)

    def address() -> str:
        whole = [of("123456789abcdef", 1) + hexa(rng.integers(1, 4)) for _ in range(8)]
        cut = rng.integers(1, 7)
        return pick((":".join(whole), ":".join(whole[:cut]) + "::" + ":".join(whole[cut + 1 : cut + 1 + rng.integers(1, 3)]), f"2001:{hexa(3)}::{hexa(1)}", f"fe80::{whole[0]}:{whole[1]}"))

    at, dot = lambda: pick(("(at)", " (at) ", "[at]", " [at] ", "{at}", " at ")), lambda: pick((".", " (dot) ", "[dot]", " dot "))
    real = {
        0: lambda: f"{word()}{pick(('', '.', '_'))}{pick((word(), num(2)))}{at()}{word()}{dot()}{pick(('com', 'org', 'net', 'de', 'fr', 'es'))}", 1: address, 2: card, 3: phone,
        4: lambda: pick((f'password={pick((hexa(18), alnum(12)))}', f'token = "{hexa(40)}"', f"AKIA{of('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 16)}", f"ghp_{alnum(36)}", f"key: {alnum(rng.integers(20, 44))}", alnum(rng.integers(24, 64)), f"secret='{alnum(20)}'")),
    }
    fake = {
        0: lambda: pick((f"{word()} at {word()}. {word().capitalize()}", f"{word()} (at) {word()} {word()}.", f"{word()}@ {word()}")), 1: lambda: pick((f"{num(2)}:{num(2)}:{num(2)}", ":".join(num(2) for _ in range(4)), f"{num(1)}:{num(2)}:{num(2)}:{num(1)}")),
        2: lambda: pick((num(12), num(16), f"978-{num(1)}-{num(4)}-{num(4)}-{num(1)}", f"{num(4)}/{num(4)}/{num(4)}")), 3: lambda: pick((f"20{num(2)}-{num(2)}-{num(2)}", f"{num(2)}.{num(2)}.19{num(2)}", f"{num(4)}.{num(5)}", f"{num(3)} {num(3)} {num(3)}"[: rng.integers(9, 12)], f"{num(8)}", f"20{num(2)}/20{num(2)}", f"{num(1)}.{num(1)}.{num(2)}.{num(4)}")),
        4: lambda: pick((f"{word()}: {word()}{word()}", f"{word()}={word()}", f"note: {word()}-{word()}", f"{word()}-{word()}-{word()}-{num(1)}", f"width={num(6)}", f"http://{word()}.org/{word()}/{word()}", f"{hexa(8)}-{hexa(4)}-{hexa(4)}-{hexa(4)}-{hexa(12)}", f"{word()}_{word()}_{word()}_{num(2)}", f"size: {num(4)}x{num(4)}")),
    }
    x, y = [], []
    while len(x) < n:
        kind, true = int(rng.integers(5)), bool(rng.integers(2))
        own = (real if true else fake)[kind]()
        head = " ".join(word() for _ in range(rng.integers(1, 5))) + pick((" ", ". ", ", ", " (", "\n"))
        text = head + own + pick((" ", ".", ", ", ") ", "\n")) + word()
        for c in candidates(text):
            if c[1] == kind and c[0] < len(head) + len(own) and c[2] > len(head):
                x.append(features(text, c))
                y.append(true and c[2] - c[0] >= 0.6 * len(own.split("=")[-1].split(": ")[-1].strip("\"' ")))
    return np.array(x[:n], float), np.array(y[:n], float)


class Boosted:
    """Gradient-boosted depth-3 trees under logistic loss, with a calibrated probability and a threshold for each kind."""

    def __init__(self, x: np.ndarray, y: np.ndarray, held_x: np.ndarray, held_y: np.ndarray, trees: int = TREES, rate: float = 0.3):
        self.trees: list = []
        margin = np.zeros(len(y))
        for _ in range(trees):
            p = 1 / (1 + np.exp(-margin))
            tree = self._grow(x, y - p, p * (1 - p), 3)
            self.trees.append(tree)
            margin += rate * self._value(tree, x)
        self.rate = rate
        m = self.margin(held_x)
        a, b = 1.0, 0.0
        for _ in range(400):
            p = 1 / (1 + np.exp(-(a * m + b)))
            a, b = a - 0.05 * np.mean((p - held_y) * m), b - 0.05 * np.mean(p - held_y)
        self.scale = (a, b)
        prob = self.probability(held_x)
        self.threshold = {}
        for kind in range(len(KINDS)):
            own, good = prob[held_x[:, 0] == kind], held_y[held_x[:, 0] == kind]
            order = np.argsort(-own)
            pure = np.cumsum(good[order]) / np.arange(1, len(order) + 1) >= PRECISION
            self.threshold[kind] = max(0.5, own[order][np.flatnonzero(pure)[-1]]) if pure.any() else 2.0

    def _grow(self, x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int):
        leaf = g.sum() / (h.sum() + 1.0)
        best = (1e-6, None, None)
        for f in range(x.shape[1]) if depth else ():
            for cut in np.unique(np.quantile(x[:, f], np.linspace(0.05, 0.95, 12))):
                left = x[:, f] <= cut
                if 5 <= left.sum() <= len(g) - 5:
                    gain = sum(g[s].sum() ** 2 / (h[s].sum() + 1.0) for s in (left, ~left)) - g.sum() ** 2 / (h.sum() + 1.0)
                    best = max(best, (gain, f, cut), key=lambda b: b[0])
        if best[1] is None:
            return leaf
        left = x[:, best[1]] <= best[2]
        return (best[1], best[2], self._grow(x[left], g[left], h[left], depth - 1), self._grow(x[~left], g[~left], h[~left], depth - 1))

    def _value(self, tree, x: np.ndarray) -> np.ndarray:
        if not isinstance(tree, tuple):
            return np.full(len(x), tree)
        return np.where(x[:, tree[0]] <= tree[1], self._value(tree[2], x), self._value(tree[3], x))

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.rate * sum(self._value(t, x) for t in self.trees)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.scale[0] * self.margin(x) + self.scale[1])))


@lru_cache(maxsize=1)
def made_up_halves() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    return *made_up(SAMPLES, SEED), *made_up(SAMPLES, SEED + 1)


def learn(df: DataFrame, sample: int = SAMPLE_DOCS, text_col: str = "text") -> Boosted:
    """Trees from the weak labels of at most about ``sample`` documents (chosen by a hash of the text) and made-up lines."""
    docs = df.select(F.col(f"`{text_col}`").cast("string").alias("text")).where("text is not null")
    share = min(1.0, sample / max(1, docs.count()))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                base, own = base_spans(text), []
                for c in candidates(text):
                    if (label := weak_label(text, c, base)) is not None and len(own) < OF_A_DOC:
                        own.append([float(label), float(zlib.crc32(text[c[0] : c[2]].encode()) % 2), *features(text, c)])
                rows += own
            places = [float(zlib.crc32(repr(r).encode())) for r in rows]
            yield pa.record_batch([pa.array(rows, pa.list_(pa.float64())), pa.array(places, pa.float64())], ["row", "place"])

    chosen = docs.where(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < int(share * (1 << 30)) + (share == 1.0))
    # However often a text with candidates is repeated, no more than this comes to the driver.
    got = sorted(r["row"] for r in chosen.mapInArrow(work, "row array<double>, place double").distinct().orderBy("place", "row").limit(2 * sample).collect())
    x, y, held_x, held_y = made_up_halves()
    if got:
        rows = np.array(got)
        for half in (0, 1):
            own = rows[rows[:, 1] == half]
            if half == 0:
                x, y = np.concatenate([x, own[:, 2:]]), np.concatenate([y, own[:, 0]])
            else:
                held_x, held_y = np.concatenate([held_x, own[:, 2:]]), np.concatenate([held_y, own[:, 0]])
    return Boosted(x, y, held_x, held_y)


def all_spans(text: str, trees: Boosted) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans."""
    base, loose = base_spans(text), candidates(text)
    if not loose:
        return base, base
    # Base spans of different kinds may overlap; as stretches they do not.
    taken: list[tuple[int, int]] = []
    for s, _, e in base:
        if taken and s < taken[-1][1]:
            taken[-1] = (taken[-1][0], max(e, taken[-1][1]))
        else:
            taken.append((s, e))
    free = lambda s, e: (i := bisect_left(taken, (e,))) == 0 or taken[i - 1][1] <= s
    loose = [c for c in loose if free(c[0], c[2])]
    if not loose:
        return base, base
    more: list[Span] = []
    prob = trees.probability(np.array([features(text, c) for c in loose], float))
    for p, c in sorted(zip(prob.tolist(), loose, strict=True), key=lambda z: (-z[0], z[1])):
        if p >= trees.threshold[c[1]] and free(c[0], c[2]):
            insort(taken, (c[0], c[2]))
            more.append(c)
    return base, sorted([*base, *more])


def written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def redacted(text: str, spans: list[Span]) -> str:
    """Each stretch of overlapping spans becomes ``[KIND]`` of its first span."""
    out, at = [], 0
    for s, k, e in spans:
        if s >= at:
            out += [text[at:s], f"[{KINDS[k].upper()}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def find_personal_data(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n_email``, ``n_ip``, ``n_card``, ``n_phone``, ``base_sha256``, ``spans`` of every whole text."""
    trees = learn(df, text_col=text_col)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch, "text"):
                rows = [all_spans(t or "", trees) for t in part.column("text").to_pylist()]
                counts = [pa.array([sum(x[1] == k for x in b) for b, _ in rows], pa.int64()) for k in range(4)]
                sha = pa.array([hashlib.sha256(written(b).encode()).hexdigest() for b, _ in rows], pa.string())
                yield pa.record_batch([part.column("doc_id"), *counts, sha, pa.array([written(a) for _, a in rows], pa.string())], ["doc_id", *(f"n_{k}" for k in KINDS[:4]), "base_sha256", "spans"])

    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return docs.mapInArrow(work, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redact(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with its spans redacted in the text; null stays null; all other columns stay as they are."""
    trees = learn(df, text_col=text_col)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            texts = [t if t is None else redacted(t, all_spans(t, trees)[1]) for t in batch.column(at).to_pylist()]
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    return df.mapInArrow(work, df.schema)


def op8_boosted_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(table(spark, sf_dir, "documents"))
