"""Importance resampling of documents towards a target distribution.

Documents and target texts are bags of hashed word n-grams.  A bucket's gain is the
log ratio of its smoothed share in the target and in the documents, a document's
weight is the sum of its features' gains, and the documents with the highest weight
plus Gumbel noise are a draw without replacement in proportion to the importance weights.

Features come batch by batch: the texts of a batch are joined with a sentinel byte that no
word holds, one pass of a pattern finds all words, ``searchsorted`` on the documents'
offsets says whose word each one is, and n-grams whose first and last word have
different owners are masked out before ``bincount``.  The hash of an n-gram is put together
from the hashes of its words (a CRC of joined bytes is a linear function of the parts'),
so every distinct word of a batch is hashed once.

Corpus counts are summed in Spark over all rows, one row a bucket and partition at most; the
gains (one number a bucket) go to every task.  The draw is a distributed sort.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensortracks.llm.common import runs, saved
from sensortracks.operators.common import with_ordinal

BUCKETS = 10_000
GRAMS = 3
LEAST_WORDS = 20
PERCENT = 5
SEED = 42
CHUNK_BYTES = 1 << 20
SENTINEL = b"\x00"
# A-Z become a-z; words are runs of digits, a-z and bytes of non-ASCII characters.
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_INSIDE = np.array([WORD.match(bytes([b])) is not None for b in range(256)])
REACH = 64


def _byte_steps() -> np.ndarray:
    """table[n, k, v]: byte k of a CRC having value v, moved over n zero bytes."""
    one = np.empty(256, np.uint32)
    for v in range(256):
        c = v
        for _ in range(8):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
        one[v] = c
    table = np.empty((REACH + 1, 4, 256), np.uint32)
    table[0] = np.arange(256, dtype=np.uint32) << (8 * np.arange(4, dtype=np.uint32)[:, None])
    for n in range(1, REACH + 1):
        table[n] = one[table[n - 1] & 255] ^ table[n - 1] >> 8
    return table


_STEPS = _byte_steps()


def _moved(crc: np.ndarray, n: np.ndarray) -> np.ndarray:
    """CRCs after ``n`` more bytes, but for these bytes' own CRC: crc(a + b) = _moved(crc(a), len(b)) ^ crc(b)."""
    crc, n = crc.copy(), n.copy()
    while len(far := np.flatnonzero(n > REACH)):
        c = crc[far]
        crc[far] = _STEPS[REACH, 0, c & 255] ^ _STEPS[REACH, 1, c >> 8 & 255] ^ _STEPS[REACH, 2, c >> 16 & 255] \
            ^ _STEPS[REACH, 3, c >> 24]
        n[far] -= REACH
    return _STEPS[n, 0, crc & 255] ^ _STEPS[n, 1, crc >> 8 & 255] ^ _STEPS[n, 2, crc >> 16 & 255] ^ _STEPS[n, 3, crc >> 24]


class _Words(dict):
    """word -> its number; crc and size by number."""

    def __init__(self):
        super().__init__()
        self.crc: list[int] = []
        self.size: list[int] = []

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self.crc)
        self.crc.append(zlib.crc32(word))
        self.size.append(len(word))
        return n


def features(texts: list[str | None], buckets: int = BUCKETS) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Words of each text, and (owner, bucket) of all its n-grams, one pair of arrays for each n."""
    data = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    joined = SENTINEL.join(data).translate(LOWER)
    ends = np.cumsum([len(d) + 1 for d in data])
    words = _Words()
    number = np.fromiter(map(words.__getitem__, WORD.findall(joined)), np.int64)
    inside = _INSIDE[np.frombuffer(joined, np.uint8)]
    owner = np.searchsorted(ends, np.flatnonzero(inside & ~np.r_[False, inside[:-1]]), side="right")
    crc, size = np.array(words.crc, np.uint32)[number], np.array(words.size, np.int64)[number]
    out, gram = [], crc
    for n in range(1, GRAMS + 1):
        if n > 1:
            space = _moved(gram[:-1], np.ones(len(gram[:-1]), np.int64)) ^ np.uint32(zlib.crc32(b" "))
            gram = _moved(space, size[n - 1:]) ^ crc[n - 1:]
        whole = owner[:len(gram)] == owner[n - 1:]
        out.append((owner[:len(gram)][whole], (gram[whole] % buckets).astype(np.int64)))
    return np.bincount(owner, minlength=len(texts)), out


def _chunks(pdf: pd.DataFrame, column: str) -> Iterator[tuple[pd.DataFrame, list]]:
    texts = pdf[column].tolist()
    for a, b in runs([len(t or "") for t in texts], CHUNK_BYTES):
        yield pdf.iloc[a:b], texts[a:b]


def bucket_counts(rows: DataFrame, text: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): features of all texts, for buckets that have one."""

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(buckets, np.int64)
        for pdf in batches:
            for _, texts in _chunks(pdf, "text"):
                for _, bucket in features(texts, buckets)[1]:
                    total += np.bincount(bucket, minlength=buckets)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": at, "n": total[at]})

    counts = rows.select(F.col(text).alias("text")).mapInPandas(counted, "bucket long, n long")
    return counts.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, text: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """The gain of every bucket, in thousandths, towards ``target``; ``buckets`` numbers come to the driver."""
    sides = bucket_counts(docs, text, buckets).select("bucket", F.col("n").alias("s"), F.lit(0).alias("t")).unionByName(
        bucket_counts(target, text, buckets).select("bucket", F.lit(0).alias("s"), F.col("n").alias("t")))
    got = sides.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")).toPandas()
    s, t = np.zeros(buckets), np.zeros(buckets)
    s[got["bucket"]], t[got["bucket"]] = got["s"], got["t"]
    ratio = (t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def weighted(docs: DataFrame, gain: np.ndarray, text: str = "text", seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) of every document."""
    buckets = len(gain)

    def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for part, texts in _chunks(pdf, "text"):
                n_words, grams = features(texts, buckets)
                n, weight = np.zeros(len(part), np.int64), np.zeros(len(part), np.int64)
                for owner, bucket in grams:
                    n += np.bincount(owner, minlength=len(part))
                    np.add.at(weight, owner, gain[bucket])
                yield pd.DataFrame({"doc_id": part["doc_id"].astype("Int64"), "n_words": n_words, "n_features": n,
                                    "weight": weight})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))
    out = rows.mapInPandas(summed, "doc_id long, n_words long, n_features long, weight long")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    return out.withColumn("score", (F.col("weight") + noise).cast("long"))


def resample(docs: DataFrame, target: DataFrame, text: str = "text", percent: int = PERCENT,
             least_words: int = LEAST_WORDS, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every document; rank is null for those that are not drawn.

    Defined results: a null text has no words, so weight 0, and is never drawn; a null id
    is hashed as an empty string and comes after all others of its score; repeated rows are different
    documents that may both be drawn, the order among equal ones is open; an empty target gives
    every bucket one virtual feature; an empty table gives an empty result.  Other columns of
    ``docs`` are not read.
    """
    # saved: the sort reads its input twice
    scored = saved(weighted(docs, gains(docs, target, text, buckets), text, seed))
    scored = scored.withColumn("able", F.col("n_words") >= least_words).withColumn("row", F.monotonically_increasing_id())
    placed = with_ordinal(scored, [F.desc("able"), F.desc("score"), F.asc_nulls_last("doc_id"), F.desc("weight"),
                                   F.desc("n_features"), F.asc("row")], "place")
    able = placed.groupBy().agg(F.coalesce(F.sum(F.col("able").cast("long")), F.lit(0)).alias("n")).scalar()
    drawn = F.col("able") & (F.col("place") <= F.floor(F.lit(percent) * able / F.lit(100)))
    return placed.select("doc_id", "n_features", "weight", "score", F.when(drawn, F.col("place")).alias("rank"))
