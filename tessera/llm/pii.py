"""Personal data by boosted trees over candidate spans.

Generators with high recall propose spans, which may overlap: the base patterns, and looser ones (written-out addresses,
digits with unusual separators, numbers without a prefix).  Boosted trees score every candidate, those of the base patterns too, by its
format and its context; thresholds by kind, calibrated on held-out candidates, select what is redacted.  Spans of the base patterns
always stay, others are added in the order of their scores where they overlap none.

The trees learn from a bounded number of windows of the given texts: spans of the base patterns in them count as personal data, and seeded
rules write personal data in other formats, and numbers that are none, between their words.  Every text is searched whole in its
own task, in n log n time for n spans.  Looser generators stop at 64 characters for a name or a host label and at 8 groups of 6 digits;
this bounds added spans only.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import prepare

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int, int]  # start, kind, end

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
HOST = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A run of digits is tried once, at its start, as later starts in it cannot match either.
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
HAS_DIGIT = re.compile(r"[0-9]")

#: Looser generators.
WRITTEN = re.compile(r"[\w.+-]{1,64}\s?[\[({]\s?at\s?[\])}]\s?[\w-]{1,64}(?:\s?(?:\.|[\[({]\s?dot\s?[\])}])\s?[\w-]{1,64}){1,8}", re.IGNORECASE)
QUAD = re.compile(r"(?<![0-9.])[0-9]{1,3}(?:\[\.\]|\(\.\)|\s\.\s?)[0-9]{1,3}(?:\[\.\]|\(\.\)|\s\.\s?|\.)[0-9]{1,3}(?:\[\.\]|\(\.\)|\s\.\s?|\.)[0-9]{1,3}(?![0-9])")
GROUPS = re.compile(r"(?<![0-9A-Za-z])\(?[0-9]{1,6}\)?(?:[\s./ ‐-―_-]{1,2}\(?[0-9]{1,6}\)?){1,7}(?![0-9A-Za-z])")
RUN = re.compile(r"(?<![0-9A-Za-z])[0-9]{9,19}(?![0-9A-Za-z])")
CUES = tuple(re.compile(p, re.IGNORECASE) for p in (r"\bmail\b|e-mail", r"\bip\b|\bhost\b|address", r"card|visa|master|credit|payment", r"phone|\btel\b|call|mobile|fax|contact", r"order|invoice|\bid\b|version|\bno\b|serial|total|date|isbn"))


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    """What the base pattern finds: leftwards from each @ to the start of the local part, rightwards over the host."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = HOST.match(text, at) if start < at else None
        if m:
            yield start, 0, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[Span]:
    """Spans of the base patterns that pass their checks, by start and kind."""
    found: list[Span] = []
    if "@" in text:
        found += _emails(text)
    if HAS_DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                found.append((m.start(), 1, m.end()))
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 14:
                digits = m[0].replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    found.append((m.start(), 2, m.end()))
        for m in PHONE.finditer(text):
            if 10 <= len(re.findall("[0-9]", m[0])) <= 15:
                found.append((m.start(), 3, m.end()))
    return sorted(found)


def loose_spans(text: str) -> list[Span]:
    """Spans that the looser generators propose."""
    found: list[Span] = []
    low = text.lower() if ("(" in text or "[" in text or "{" in text) else ""
    if low and "at" in low and ("(at" in low or "[at" in low or "{at" in low or "( at" in low or "[ at" in low):
        found += [(m.start(), 0, m.end()) for m in WRITTEN.finditer(text)]
    if HAS_DIGIT.search(text):
        found += [(m.start(), 1, m.end()) for m in QUAD.finditer(text)]
        for pattern in (GROUPS, RUN):
            for m in pattern.finditer(text):
                n = sum(c.isdigit() for c in m[0])
                if 13 <= n <= 19:
                    found.append((m.start(), 2, m.end()))
                if 7 <= n <= 15:
                    found.append((m.start(), 3, m.end()))
    return found


def features(text: str, span: Span) -> list[float]:
    """Format of a candidate and what stands within 24 characters of it."""
    start, kind, end = span
    s = text[start:end]
    digits = "".join(c for c in s if c in "0123456789")
    groups = re.findall(r"[0-9]+", s)
    seps = [c for c in s if not c.isalnum()]
    before, after = text[max(0, start - 24) : start], text[end : end + 24]
    cue = [float(bool(p.search(before))) for p in CUES]
    small = sum(int(g) <= 255 for g in groups if len(g) <= 3)
    return [
        float(kind), float(len(s)), float(len(digits)), float(len(groups)), float(max(map(len, groups), default=0)), float(min(map(len, groups), default=0)),
        float(len(groups[-1])) if groups else 0.0, float(luhn(digits)) if digits else 0.0, float(digits[:1] or -1), float(len(seps)), float(len(set(seps))), float("(" in s), float("." in s), float("-" in s), float("/" in s), float(":" in s),
        float(small), float(sum(c.isalpha() for c in s)), float(before[-1:].isalnum()), float(after[:1].isalnum()), float("+" in before[-2:]), float("=" in before[-3:] or '"' in before[-2:]), *cue,
    ]


class Trees:
    """Gradient boosting for the logistic loss: shallow trees on cuts at quantiles."""

    def __init__(self, rounds: int = 40, depth: int = 3, rate: float = 0.3):
        self.rounds, self.depth, self.rate = rounds, depth, rate
        self.trees: list[list[tuple[int, float, float]]] = []
        self.start = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        mean = y.mean().clip(0.01, 0.99)
        self.start = float(np.log(mean / (1 - mean)))
        splits = [(f, float(t)) for f, c in enumerate(x.T) for t in np.unique(np.quantile(c, np.linspace(0.05, 0.95, 19)))]
        below = np.stack([x[:, f] <= t for f, t in splits], axis=1).astype(float)
        z = np.full(len(y), self.start)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-z))
            g, h = y - p, p * (1 - p)
            # nodes in heap order: (feature, cut, value); a feature of -1 is a leaf
            tree, where = [], [np.ones(len(y), bool)]
            for node in range(2 ** (self.depth + 1) - 1):
                rows = where[node]
                gs, hs = g[rows].sum(), h[rows].sum()
                split, left = (-1, 0.0), np.zeros(len(y), bool)
                if node < 2**self.depth - 1 and rows.sum() > 10:
                    ga, ha = (g * rows) @ below, (h * rows) @ below
                    gain = ga * ga / (ha + 1) + (gs - ga) ** 2 / (hs - ha + 1) - gs * gs / (hs + 1)
                    best = int(np.argmax(np.round(gain, 9)))
                    if gain[best] > 1e-3:
                        split, left = splits[best], below[:, best] > 0
                where += [rows & left, rows & ~left] if split[0] >= 0 else [np.zeros(len(y), bool)] * 2
                tree.append((*split, float(self.rate * gs / (hs + 1))))
            self.trees.append(tree)
            z = z + self._walk(tree, x)
        return self

    @staticmethod
    def _walk(tree: list[tuple[int, float, float]], x: np.ndarray) -> np.ndarray:
        f, t, v = (np.array(c) for c in zip(*tree))
        at = np.zeros(len(x), int)
        for _ in range(len(tree).bit_length() - 1):
            inner = f[at] >= 0
            right = x[np.arange(len(x)), np.maximum(f[at], 0)] > t[at]
            at = np.where(inner, 2 * at + 1 + right, at)
        return v[at]

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log odds that each candidate is personal data."""
        return self.start + sum((self._walk(t, x) for t in self.trees), np.zeros(len(x)))


def _digits(rng: random.Random, n: int) -> str:
    return "".join(rng.choice("0123456789") for _ in range(n))


def _card(rng: random.Random) -> str:
    body = rng.choice("3456") + _digits(rng, rng.choice((13, 14, 14, 14)))
    return next(body + c for c in "0123456789" if luhn(body + c))


def _word(rng: random.Random) -> str:
    return "".join(rng.choice("abcdefghilmnoprstuv") for _ in range(rng.randint(2, 9)))


def written_out(rng: random.Random) -> tuple[str, int, str]:
    """(cue, kind, span) of personal data in a format that the base patterns do not have."""
    kind, sep = rng.randrange(4), rng.choice((" ", ".", "‑", "–", "/", "_"))
    if kind == 0:
        o, c = rng.choice(("[]", "()", "{}"))
        return "", kind, f"{_word(rng)} {o}at{c} {_word(rng)} {rng.choice(('.', f'{o}dot{c}'))} com"
    if kind == 1:
        return "", kind, rng.choice(("[.]", "(.)")).join(str(rng.randint(1, 254)) for _ in range(4))
    if kind == 2:
        d = _card(rng)
        return rng.choice(("", "card ", "visa: ")), kind, sep.join(d[i : i + 4] for i in range(0, len(d), 4))
    a, b, c = _digits(rng, 3), _digits(rng, 3), _digits(rng, 4)
    s = rng.choice((f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}{sep}{b}{sep}{c}"))
    return rng.choice(("", "tel ")) if s.startswith("(") else rng.choice(("tel ", "phone: ", "call ", "mobile ")), kind, s


def harmless(rng: random.Random) -> tuple[str, str]:
    """(cue, text) of what looks like personal data and is none."""
    kind, sep = rng.randrange(4), rng.choice((" ", ".", "‑", "–", "/", "_"))
    if kind == 0:
        return "", f"{_word(rng)} (at {_word(rng)}). {_word(rng)}" if rng.random() < 0.2 else _digits(rng, rng.randint(9, 19))
    if kind == 1:
        return rng.choice(("", "version ")), ".".join(_digits(rng, rng.choice((1, 2, 3, 4))) for _ in range(rng.choice((2, 3, 5, 6))))
    if kind == 2:
        s = rng.choice((_digits(rng, rng.randint(9, 19)), sep.join(_digits(rng, rng.choice((1, 2, 3, 4, 5))) for _ in range(rng.randint(2, 6)))))
        return rng.choice(("", "", "order ", "invoice no ", "id ", "total ")), s
    year, month, day = rng.randint(1900, 2100), rng.randint(1, 12), rng.randint(1, 28)
    s = (f"{year}-{month:02}-{day:02}", f"{day:02}/{month:02}/{year}", f"{_digits(rng, 3)} {_digits(rng, 3)} {_digits(rng, 3)}", f"{_digits(rng, 4)}-{_digits(rng, 4)}", _digits(rng, rng.randint(9, 15)), f"{_digits(rng, 3)}-{_digits(rng, 3)}-{_digits(rng, 4)}")
    return rng.choice(("", "", "order ", "isbn ", "date ", "serial ")), rng.choice(s)


def examples(windows: list[str], n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of candidates: those of the base patterns in ``windows``, and ``n`` that rules write between words of windows."""
    rng = random.Random(seed)
    x, y = [], []

    def add(text: str, span: Span, good: bool) -> None:
        x.append(features(text, span))
        y.append(float(good))

    for text in windows:
        for span in base_spans(text):
            add(text, span, True)
    for i in range(n):
        good = i % 2 == 1
        if good:
            cue, kind, s = written_out(rng)
        else:
            (cue, s), kind = harmless(rng), -1
        words = (rng.choice(windows) if windows else "").split()[:40] or [_word(rng), _word(rng)]
        at = rng.randint(0, len(words))
        before = "".join(f"{w} " for w in words[:at]) + cue
        text = f"{before}{s}{rng.choice((' ', '. ', ', '))}{' '.join(words[at:])}"
        for span in loose_spans(text):
            if span[0] < len(before) + len(s) and span[2] > len(before):  # what else the window has is not known
                add(text, span, good and span[1] == kind and span[0] >= len(before) and span[2] <= len(before) + len(s))
    return np.array(x), np.array(y)


class Model:
    """Trees, and for each kind the log odds from which on a candidate is taken."""

    def __init__(self, windows: list[str], precision: float = 0.99, n: int = 1500):
        rng = random.Random(7)
        windows = windows + [" ".join(_word(rng) for _ in range(20)) for _ in range(200 - len(windows))]  # few texts teach little about context
        self.trees = Trees().fit(*examples(windows[::2], n, 5))
        x, y = examples(windows[1::2], n, 6)  # held out
        z = self.trees.score(x)
        self.least = []
        for kind in range(len(KINDS)):
            of = x[:, 0] == kind
            order = np.argsort(-z[of], kind="stable")
            right = np.cumsum(y[of][order]) / np.arange(1, of.sum() + 1)
            enough = np.flatnonzero(right >= precision)
            self.least.append(max(float(z[of][order][enough[-1]]), 0.0) if len(enough) else math.inf)


def windows(docs: DataFrame, n: int = 800, width: int = 400, text_col: str = "text") -> list[str]:
    """At most ``n`` windows of ``width`` characters, at places given by hashes, of the texts with the least hashes."""
    text = F.col(f"`{text_col}`")
    place = F.pmod(F.xxhash64(text, F.lit(1)), F.greatest(F.lit(1), F.length(text) - width)).cast("int") + 1
    rows = docs.where(F.length(text) > 0).select(F.xxhash64(text).alias("h"), F.substring(text, place, F.lit(width)).alias("w"))
    least = rows.select("h").distinct().orderBy("h").limit(n)  # copies count once; at most n rows, so they may be broadcast
    chosen = rows.join(F.broadcast(least), "h").groupBy("h").agg(F.min("w").alias("w"))
    return [r.w for r in chosen.orderBy("h").collect()]


class Taken:
    """Spans that do not overlap, by place."""

    def __init__(self, spans: list[Span]):
        self.ends: list[tuple[int, int]] = []  # (end, start), ascending
        for s, _, e in sorted(spans):
            if self.ends and s < self.ends[-1][0]:
                self.ends[-1] = (max(e, self.ends[-1][0]), self.ends[-1][1])
            else:
                self.ends.append((e, s))

    def meets(self, span: Span) -> bool:
        i = bisect_right(self.ends, (span[0], math.inf))
        return i < len(self.ends) and self.ends[i][1] < span[2]

    def add(self, span: Span) -> None:
        insort(self.ends, (span[2], span[0]))


def find(texts: list[str], model: Model) -> list[tuple[list[Span], list[Span], int, int]]:
    """(base spans, added spans, candidates, base spans that score below their threshold) of each text."""
    base = [base_spans(t) for t in texts]
    loose = [loose_spans(t) for t in texts]
    every = [(k, c) for k, spans in enumerate(base) for c in spans] + [(k, c) for k, spans in enumerate(loose) for c in spans]
    n_base = sum(map(len, base))
    z = model.trees.score(np.array([features(texts[k], c) for k, c in every])) if every else np.zeros(0)
    least = np.array(model.least)[[c[1] for _, c in every]] if every else np.zeros(0)
    doubted = [0] * len(texts)
    for k, _ in (every[i] for i in np.flatnonzero(z[:n_base] < least[:n_base])):
        doubted[k] += 1
    added: list[list[Span]] = [[] for _ in texts]
    taken = {}
    for i in np.argsort(-z, kind="stable"):
        k, c = every[i]
        if i >= n_base and z[i] >= least[i]:
            if k not in taken:
                taken[k] = Taken(base[k])
            if not taken[k].meets(c):
                taken[k].add(c)
                added[k].append(c)
    return [(b, sorted(a), len(b) + len(c), d) for b, a, c, d in zip(base, added, loose, doubted)]


def listed(spans: list[Span]) -> str:
    """kind:start:end by start and kind, joined by commas."""
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def redacted(text: str, spans: list[Span]) -> str:
    """The text with [KIND] in place of each span; overlapping spans give one mark, that of the first."""
    out, done = [], 0
    for s, k, e in sorted(spans):
        if s >= done:
            out += [text[done:s], f"[{KINDS[k].upper()}]"]
        done = max(done, e)
    return "".join(out) + text[done:]


def train(docs: DataFrame, text_col: str = "text") -> Model:
    """A model from windows of at most 800 texts, half of them for calibration; it also works without any."""
    return Model(windows(docs, text_col=text_col))


def detect(docs: DataFrame, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row its id, n_email, n_ip, n_card, n_phone and base_sha256 (base spans), spans (all), n_added, n_candidates and n_doubted.

    n_candidates counts the spans that were scored, n_doubted the base spans among them that the trees alone would not take.  Positions are
    code points, ends exclusive.  Null and empty texts have no spans; equal texts have equal spans; an empty table gives no rows.
    """
    prepare(docs.sparkSession)
    model = model or train(docs, text_col)
    id_type = docs.schema[id_col].dataType.simpleString()
    more = ("n_added", "n_candidates", "n_doubted")
    names = [id_col, *(f"n_{k}" for k in KINDS), "base_sha256", "spans", *more]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = find([t or "" for t in b.column(1).to_pylist()], model)
            counts = [pa.array([sum(s[1] == k for s in base) for base, *_ in found], pa.int64()) for k in range(len(KINDS))]
            sums = pa.array([hashlib.sha256(listed(base).encode()).hexdigest() for base, *_ in found], pa.string())
            spans = pa.array([listed(base + added) for base, added, *_ in found], pa.string())
            counted = [pa.array(c, pa.int64()) for c in ([len(f[1]) for f in found], [f[2] for f in found], [f[3] for f in found])]
            yield pa.RecordBatch.from_arrays([b.column(0), *counts, sums, spans, *counted], names=names)

    rows = docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"))
    counted = ", ".join(f"{n} long" for n in more)
    return rows.mapInArrow(run, f"`{id_col}` {id_type}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, {counted}")


def redact(docs: DataFrame, model: Model | None = None, text_col: str = "text") -> DataFrame:
    """``docs`` with every span of its texts replaced by its kind; null texts stay null."""
    prepare(docs.sparkSession)
    model = model or train(docs, text_col)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(at).to_pylist()
            found = find([t or "" for t in texts], model)
            new = [t if t is None else redacted(t, base + added) for t, (base, added, *_) in zip(texts, found)]
            columns = [pa.array(new, pa.string()) if i == at else c for i, c in enumerate(b.columns)]
            yield pa.RecordBatch.from_arrays(columns, names=b.schema.names)

    return docs.mapInArrow(run, docs.schema)
