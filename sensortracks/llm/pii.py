"""Personal data: fixed patterns, and a semi-Markov conditional random field.

The base spans of each kind are the leftmost non-overlapping matches of a fixed
pattern.  The semi-Markov field looks at zones, runs of words with a digit or an @:
candidate segments of up to ``MAX_WORDS`` words and ``MAX_CHARS`` characters get a score from features of the whole
span (digits, separators, check digits, shape), single words may stay outside, and
dynamic programming over bounded segments chooses boundaries and kinds jointly.

The field's weights are learned here, by gradient ascent on the conditional
likelihood, from at most ``TRAIN_ZONES`` zones of a hash sample of the documents
with the base spans as labels.  A learned segment is added where it overlaps no base span.
"""

from __future__ import annotations

import math
import random
import re
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensortracks.llm.common import free_name

KINDS = ("email", "ip", "card", "phone")
MAX_WORDS = 6
MAX_CHARS = 100
TRAIN_ZONES = 1000
TRAIN_DOCS = 20_000
EPOCHS = 6
# The base patterns; looking back for a digit only spares restarts inside a run of digits.
EMAIL_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
EMAIL_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
SHAPES = {"email": re.compile(r"[\w.%+-]+@[\w-]+(\.[\w-]+)+"), "ip": re.compile(r"\d+(\.\d+){3}"),
          "card": re.compile(r"\d(?:[ -]?\d)+"), "phone": re.compile(r"\+?\(?\d[\d ().-]+\d")}
EDGE = ".,;:!?\"'<>[]{}|=*#$&"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _only_digits(s: str) -> str:
    return "".join([c for c in s if "0" <= c <= "9"])


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base, by start, then kind."""
    out = []
    at, free = text.find("@"), 0
    while at >= 0:
        m = EMAIL_DOMAIN.match(text, at + 1)
        if m:
            start = at
            while start > free and text[start - 1] in EMAIL_LOCAL:
                start -= 1
            if start < at:
                out.append((start, 0, m.end()))
                free = m.end()
        at = text.find("@", max(at + 1, free))
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = _only_digits(m[0])
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= len(_only_digits(m[0])) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


# the semi-Markov field

_MARK = re.compile(r"[0-9@]")
_JOIN = frozenset("()-+.")
Word = tuple[int, int]


def zones(text: str) -> list[list[Word]]:
    """Runs of words (start, end) that hold a digit or an @, or only signs that join numbers, one white space apart."""
    out: list[list[Word]] = []
    n, at = len(text), 0
    while m := _MARK.search(text, at):
        start, end = m.start(), m.end()
        while start > at and not text[start - 1].isspace():
            start -= 1
        while end < n and not text[end].isspace():
            end += 1
        word = (start, end)
        gap = start - out[-1][-1][1] if out else 0
        if out and gap == 1:
            out[-1].append(word)
        elif out and 2 < gap <= 5 and all(c in _JOIN for c in text[out[-1][-1][1] + 1:start - 1]):
            out[-1] += [(out[-1][-1][1] + 1, start - 1), word]
        else:
            out.append([word])
        at = end
    return out


def segment(text: str, zone: list[Word], i: int, j: int) -> Word | None:
    """Span of words i to j of a zone without signs at its edges; None if it is empty or too long."""
    a, b = zone[i][0], zone[j][1]
    if b - a > MAX_CHARS + 2 * len(EDGE):
        return None
    while a < b and text[a] in EDGE:
        a += 1
    while b > a and text[b - 1] in EDGE:
        b -= 1
    return (a, b) if 0 < b - a <= MAX_CHARS else None


def features(s: str) -> tuple[str, ...]:
    """Features of a whole candidate span."""
    digits = _only_digits(s)
    n = len(digits)
    letters = sum(c.isalpha() for c in s)
    parts = s.split(".")
    out = [f"n{n}" if n < 20 else "n20", f"@{min(s.count('@'), 2)}", f".{min(s.count('.'), 4)}",
           "letters" if letters else "no letter", "plus" if s[0] == "+" else "no plus",
           f"dash{min(s.count('-'), 4)}", f"blank{min(s.count(' '), 5)}",
           "bracket" if "(" in s else "no bracket"]
    out += [k for k, shape in SHAPES.items() if shape.fullmatch(s)] or ["no shape"]
    if 14 <= n <= 19:
        out.append("check digit" if luhn(digits) else "no check digit")
    if len(parts) == 4 and all(p.isdigit() and p.isascii() and len(p) < 4 for p in parts):
        out.append("bytes" if all(int(p) < 256 for p in parts) else "no bytes")
    return tuple(out)


class Field:
    """A semi-Markov conditional random field over the words of a zone; label 0 is outside, k + 1 kind k."""

    def __init__(self, weights: dict | None = None):
        self.w: dict = defaultdict(float, weights or {})
        self.known: dict[str, list[float]] = {}

    def scores(self, s: str) -> list[float]:
        fs = features(s)
        return [sum(self.w[f, y] for f in fs) for y in range(1, len(KINDS) + 1)]

    def arcs(self, text: str, zone: list[Word]) -> list[tuple[int, int, int, float, str]]:
        """(first word, word after, label, score, span text) of every candidate segment."""
        out = []
        for i in range(len(zone)):
            out.append((i, i + 1, 0, 0.0, ""))
            for j in range(i, min(i + MAX_WORDS, len(zone))):
                span = segment(text, zone, i, j)
                if span is None:
                    continue
                s = text[span[0]:span[1]]
                out += [(i, j + 1, y, v, s) for y, v in enumerate(self.scores(s), 1)]
        return out

    def best(self, text: str, zone: list[Word]) -> list[tuple[int, int, int]]:
        """(start, kind number, end) of the segmentation with the highest score."""
        n = len(zone)
        top: list = [(-math.inf, None)] * (n + 1)
        top[0] = (0.0, None)
        for i, j, y, v, _ in self.arcs(text, zone):
            if top[i][0] + v > top[j][0]:
                top[j] = (top[i][0] + v, (i, y))
        out, j = [], n
        while j:
            i, y = top[j][1]
            if y:
                a, b = segment(text, zone, i, j - 1)
                out.append((a, y - 1, b))
            j = i
        return out[::-1]

    def learn(self, data: list[tuple[str, list[Word], set]], epochs: int = EPOCHS, rate: float = 0.3,
              shrink: float = 1e-3, seed: int = 5) -> Field:
        """Stochastic gradient ascent on the likelihood of the labelled segmentations, by forward-backward sums."""
        data = list(data)
        mix = random.Random(seed)
        for epoch in range(epochs):
            mix.shuffle(data)
            step = rate / (1 + epoch)
            for text, zone, gold in data:
                arcs, n = self.arcs(text, zone), len(zone)
                fwd, back = [-math.inf] * (n + 1), [-math.inf] * (n + 1)
                fwd[0] = back[n] = 0.0
                for i, j, _, v, _ in arcs:
                    fwd[j] = _add(fwd[j], fwd[i] + v)
                for i, j, _, v, _ in sorted(arcs, key=lambda a: -a[0]):
                    back[i] = _add(back[i], back[j] + v)
                for i, j, y, v, s in arcs:
                    if not y:
                        continue
                    wrong = ((i, j, y) in gold) - math.exp(fwd[i] + v + back[j] - fwd[n])
                    if abs(wrong) > 1e-4:
                        for f in features(s):
                            self.w[f, y] += step * (wrong - shrink * self.w[f, y])
        return self


def _add(a: float, b: float) -> float:
    if a < b:
        a, b = b, a
    return a if b == -math.inf else a + math.log1p(math.exp(b - a))


def labelled(text: str) -> Iterator[tuple[str, list[Word], set]]:
    """Each zone of a text, by itself, with the segments that are base spans."""
    base = {(a, b): k for a, k, b in base_spans(text)}
    for zone in zones(text):
        left, right = zone[0][0], zone[-1][1]
        own = [(a - left, b - left) for a, b in zone]
        part = text[left:right]
        gold = set()
        for i in range(len(own)):
            for j in range(i, min(i + MAX_WORDS, len(own))):
                span = segment(part, own, i, j)
                if span and (k := base.get((span[0] + left, span[1] + left))) is not None:
                    gold.add((i, j + 1, k + 1))
        yield part, own, gold


def _training(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        found = {part for t in pdf["text"] for part, own, _ in labelled(t) if len(own) <= 4 * MAX_WORDS
                 and len(part) <= 4 * MAX_CHARS}
        yield pd.DataFrame({"zone": sorted(found)}, dtype="object")


def learn_field(docs: DataFrame, text: str = "text", max_zones: int = TRAIN_ZONES,
                max_docs: int = TRAIN_DOCS) -> Field:
    """A field learned from up to ``max_zones`` short zones of about ``max_docs`` documents drawn over the whole table."""
    rows = docs.select(F.col(text).alias("text")).dropna()
    n = rows.count()
    rows = rows.filter(F.pmod(F.xxhash64("text"), F.lit(max(1, n // max_docs))) == 0)
    found = rows.mapInPandas(_training, "zone string").distinct().orderBy(F.xxhash64("zone"), "zone").limit(max_zones)
    return Field().learn([x for r in found.collect() for x in labelled(r["zone"])])


def personal_spans(text: str, field: Field) -> tuple[list, list]:
    """Base spans, and all spans with those that the field adds."""
    base = base_spans(text)
    taken = sorted((a, b) for a, _, b in base)
    more, at = [], 0
    for zone in zones(text):
        for a, k, b in field.best(text, zone):
            while at < len(taken) and taken[at][1] <= a:
                at += 1
            if not any(x < b and a < y for x, y in taken[at:at + 8]):
                more.append((a, k, b))
    return base, sorted(base + more)


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def find_personal(docs: DataFrame, field: Field, text: str = "text") -> DataFrame:
    """``docs`` with base_spans and spans: arrays of struct(kind, start, end) by start, then kind; ends exclusive.

    Offsets count code points.  A null text counts as empty and has no spans.
    Columns named like a result column are replaced.
    """
    weights = dict(field.w)
    one = "array<struct<kind:string,start:int,end:int>>"
    model: list = []

    @F.pandas_udf(f"base_spans {one}, spans {one}")
    def found(texts: pd.Series) -> pd.DataFrame:
        if not model:
            model.append(Field(weights))
        rows = [personal_spans(t or "", model[0]) for t in texts]
        return pd.DataFrame({name: [[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in r[c]] for r in rows]
                             for c, name in enumerate(("base_spans", "spans"))})

    names = ("base_spans", "spans")
    docs = docs.drop(*[c for c in docs.columns if c.lower() in names])
    tmp = free_name(docs, "_found")
    return docs.withColumn(tmp, found(F.col(text))).select(*docs.columns, *[F.col(f"{tmp}.{n}").alias(n) for n in names])


def _joined(spans: str):
    return F.array_join(F.transform(F.col(spans), lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _count(spans: str, kind: str):
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, the number of base spans of each kind, the digest of the base and all spans as text."""
    found = find_personal(docs.select("doc_id", "text"), learn_field(docs))
    counts = [_count("base_spans", k).alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(_joined("base_spans"), 256).alias("base_sha256"),
                        _joined("spans").alias("spans"))


def redacted(docs: DataFrame, field: Field, text: str = "text") -> DataFrame:
    """``docs`` with every span of ``text`` replaced by its kind in brackets; overlapping spans by the first one's."""
    weights = dict(field.w)
    model: list = []

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        if not model:
            model.append(Field(weights))
        return pd.Series([t if t is None else _redact(t, personal_spans(t, model[0])[1]) for t in texts], dtype="object")

    return docs.withColumn(text, clean(F.col(text)))


def _redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    out, at = [], 0
    for a, k, b in spans:
        if a >= at:
            out += [text[at:a], f"[{KINDS[k]}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])
