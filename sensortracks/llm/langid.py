"""Language identification by rank-order profiles.

A profile is the list of a language's (or document's) most frequent character
n-grams, n = 1 to 3, inside words padded with one space on either side.  A document
gets the language whose profile has the least out-of-place distance: the sum, over
the document's profile, of the difference in rank, or the profile length for an
n-gram that the language's profile lacks.

Only letters count; everything else separates words.  N-grams are 63-bit numbers of
three code points, so one sort of the trigrams of a text also gives its bigrams and
unigrams as groups of equal prefixes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sensortracks.llm.common import free_name, held_out, merged, runs

PROFILE = 400
CHUNK_CHARS = 1 << 20
SPACE = 32
_LETTER: list = []


def _letters() -> np.ndarray:
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _LETTER[0]


def letters_only(text: str) -> np.ndarray:
    """Code points of a text in lower case, each run of other characters as one space, padded."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[codes]
    after = np.r_[False, letter[:-1]]
    kept = np.where(letter, codes, SPACE)[letter | after]
    if not letter.any():
        return np.zeros(0, np.int64)
    tail = [] if kept[-1] == SPACE else [SPACE]
    return np.r_[[SPACE], kept, tail].astype(np.int64)


def grams(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams (1 to 3) of padded code points with their counts."""
    c = np.r_[codes, 0, 0]
    tri, n = np.unique(c[:-2] << 42 | c[1:-1] << 21 | c[2:], return_counts=True)
    mid = tri >> 21 & 0x1FFFFF
    first = tri >> 42
    keys, counts = [], []
    ok = (mid != SPACE) & (mid != 0) & (tri & 0x1FFFFF != 0)
    keys.append(tri[ok])
    counts.append(n[ok])
    for drop, ok in ((21, (mid != 0) & ~((first == SPACE) & (mid == SPACE))), (42, first != SPACE)):
        k = tri[ok] >> drop << drop
        at = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.zeros(0, int)
        keys.append(k[at])
        counts.append(np.add.reduceat(n[ok], at) if len(k) else n[:0])
    return np.concatenate(keys), np.concatenate(counts)


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(lang, gram, n) of each task, merged as it goes."""
    held: dict[str, list] = {}

    def rows():
        for lang, parts in held.items():
            k, n = merged([p[0] for p in parts], [p[1] for p in parts])
            yield pd.DataFrame({"lang": lang, "gram": k, "n": n})

    size = 0
    for pdf in batches:
        for lang, part in pdf.groupby("lang"):
            texts = part["text"].tolist()
            for a, b in runs([len(t) for t in texts], CHUNK_CHARS):
                codes = [letters_only(t) for t in texts[a:b]]
                k, n = grams(np.concatenate(codes))
                held.setdefault(lang, []).append((k, n))
                size += len(k)
        if size > 1 << 21:
            for lang, parts in held.items():
                held[lang] = [merged([p[0] for p in parts], [p[1] for p in parts])]
            size = sum(len(p[0][0]) for p in held.values())
            if size > 1 << 20:
                yield from rows()
                held, size = {}, 0
    yield from rows()


def language_profiles(docs: DataFrame, text: str = "text", lang: str = "lang", size: int = PROFILE) -> DataFrame:
    """(lang, gram, rank from 0): the ``size`` most frequent n-grams of each language, ties to the smaller n-gram.

    Learns from rows whose text and language are not null.
    """
    rows = docs.select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang")).dropna()
    counts = rows.mapInPandas(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(
        F.sum("n").alias("n"))
    w = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    return (counts.withColumn("rank", F.row_number().over(w) - 1).filter(F.col("rank") < size)
            .select("lang", "gram", "rank"))


class Profiles:
    """The profiles of all languages as one sorted list of n-grams and a matrix of ranks."""

    def __init__(self, rows: pd.DataFrame, size: int = PROFILE):
        self.size = size
        self.langs = sorted(rows["lang"].unique())
        self.keys = np.unique(rows["gram"].to_numpy(np.int64))
        self.ranks = np.full((len(self.keys) + 1, len(self.langs)), -1, np.int64)
        at = np.searchsorted(self.keys, rows["gram"].to_numpy(np.int64))
        self.ranks[at, np.searchsorted(self.langs, rows["lang"].to_numpy())] = rows["rank"].to_numpy()

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and 1 less the distance as a share of the largest possible one."""
        codes = letters_only(text or "")
        if not len(codes) or not self.langs:
            return "und", 0.0
        k, n = grams(codes)
        k = k[np.lexsort((k, -n))[: self.size]]
        at = np.searchsorted(self.keys, k)
        at[at == len(self.keys)] = 0
        at[self.keys[at] != k] = len(self.keys)
        ranks = self.ranks[at]
        apart = np.where(ranks < 0, self.size, np.abs(ranks - np.arange(len(k))[:, None])).sum(0)
        best = int(apart.argmin())
        return self.langs[best], float(1 - apart[best] / (self.size * len(k)))


def identify(docs: DataFrame, profiles: DataFrame, text: str = "text", size: int = PROFILE) -> DataFrame:
    """``docs`` with lang_pred and score (0 to 1).

    The profiles (languages x ``size`` rows) go to every task.  Defined results:
    ``und`` and 0 for a null text or one without a letter, or if no language was
    learned; ties go to the language first in the alphabet; each repeated row gets
    its own, equal result; an empty table gives an empty result.  Columns named
    lang_pred or score are replaced, all others stay.
    """
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ("lang_pred", "score")])
    model = Profiles(profiles.toPandas(), size)

    @F.pandas_udf("lang_pred string, score double")
    def predicted(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([model.predict(t) for t in texts], columns=["lang_pred", "score"])

    p = free_name(docs, "_p")
    return docs.withColumn(p, predicted(F.col(text))).select(
        *docs.columns, F.col(p)["lang_pred"].alias("lang_pred"), F.col(p)["score"].alias("score"))


def identify_documents(docs: DataFrame) -> DataFrame:
    """Documents with held_out, lang_pred and score; learned from those not held out (crc32 of the id mod 4)."""
    train = docs.filter(~held_out("doc_id", 4))
    return identify(docs.drop("held_out"), language_profiles(train)).withColumn("held_out", held_out("doc_id", 4))
