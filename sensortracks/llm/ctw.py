"""Language-model scoring by context-tree weighting over bytes.

Texts are read as their words joined by one space, A-Z in lower case, as UTF-8
bytes, closed by an end symbol.  A byte is eight binary decisions; every decision
(the bits of the byte so far) has its own context tree over the ``DEPTH`` bytes
before.  A node estimates its bit by Krichevsky-Trofimov from the counts below it,
and context-tree weighting mixes the estimates of all depths:

    Pw(node) = 1/2 Pe(node) + 1/2 product of Pw(children),   Pw = Pe at full depth.

Learning counts (context, byte) grams over the training texts; the tree is built
level by level with grouped sums.  The learned weights are then fixed: a text's
probability is the product over its bytes of the mixture's conditional
probabilities, so every text is scored by the same model whatever the order.

The table of grams (distinct windows of DEPTH + 1 bytes) and that of words grow with the corpus and stay
distributed.  Only the most frequent entries of each (``TOP_WORDS``, ``TOP_GRAMS``) go to every task, a
bound on memory, not on results: other entries of a text leave the task as rows and
meet their values in a join.  Frequent keys never reach that join, so it has no hot key.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensortracks.llm.common import held_out, merged, runs, written
from sensortracks.session import discard

DEPTH = 5
TOP_WORDS = 1 << 18
TOP_GRAMS = 1 << 19
CHUNK_BYTES = 1 << 20
TASK_BYTES = 16 << 20
END = 0xFF  # occurs in no UTF-8 text: closes a text, and pads the context before its first byte
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def words_in(text: str | None) -> list[bytes]:
    """Words of a text: bytes between runs of space, tab, LF, VT, FF, CR; A-Z in lower case."""
    return (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()


def gram_keys(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows of depth + 1 bytes, one per byte and end symbol of each text, and the windows per text."""
    pad, end = bytes([END]) * depth, bytes([END])
    joined = np.frombuffer(b"".join(pad + t + end for t in texts), np.uint8)
    keys = np.zeros(max(0, len(joined) - depth), np.int64)
    for j in range(depth + 1):
        keys = keys << 8 | joined[j:len(joined) - depth + j]
    lengths = np.array([len(t) + 1 for t in texts])
    starts = np.cumsum(lengths + depth) - (lengths + depth)
    real = np.ones(len(keys), bool)
    for j in range(depth):  # windows whose last byte is padding of the next text
        gone = starts[1:] - depth + j
        real[gone] = False
    return keys[real], lengths


def _count_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    seen: Counter = Counter()
    for pdf in batches:
        for text in pdf["text"]:
            seen.update(words_in(text))
            seen[b""] += 1
        if len(seen) > 400_000:
            yield pd.DataFrame({"word": list(seen.keys()), "n": list(seen.values())})
            seen = Counter()
    yield pd.DataFrame({"word": list(seen.keys()), "n": list(seen.values())})


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word binary, n): tokens of all texts; the empty word stands for the end of a text."""
    return _few(docs.select(F.col(text).alias("text"))).mapInPandas(_count_words, "word binary, n long").groupBy(
        "word").agg(F.sum("n").alias("n"))


def _few(rows: DataFrame) -> DataFrame:
    """``rows`` in tasks of about TASK_BYTES of text, so that a task can combine what it counts.

    Only joins small partitions; never fewer tasks than twice the cores.
    """
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return rows.coalesce(max(2 * rows.sparkSession.sparkContext.defaultParallelism, math.ceil(size / TASK_BYTES)))


def gram_counts(docs: DataFrame, train: Column, text: str = "text", depth: int = DEPTH) -> DataFrame:
    """(gram, n): every window of all texts, with its count in the training texts (0: seen elsewhere only)."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys, counts, size = [], [], 0
        for pdf in batches:
            for learn, part in pdf.groupby("train"):
                texts = [b" ".join(words_in(t)) for t in part["text"]]
                for a, b in runs([len(t) for t in texts], CHUNK_BYTES):
                    k, n = np.unique(gram_keys(texts[a:b], depth)[0], return_counts=True)
                    keys.append(k)
                    counts.append(n if learn else np.zeros_like(n))
                    size += len(k)
                    if size > 1 << 21:
                        k, n = merged(keys, counts)
                        if len(k) > 1 << 20:
                            yield pd.DataFrame({"gram": k, "n": n})
                            k, n = k[:0], n[:0]
                        keys, counts, size = [k], [n], len(k)
        if keys:
            k, n = merged(keys, counts)
            yield pd.DataFrame({"gram": k, "n": n})

    rows = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text"),
                       F.coalesce(train, F.lit(False)).alias("train"))
    return _few(rows).mapInPandas(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def _log_gamma(x: Column) -> Column:
    """ln Gamma(x) for x >= 1/2: Stirling's series after eight steps up."""
    z = x + 8
    up = x * (x + 1) * (x + 2) * (x + 3) * (x + 4) * (x + 5) * (x + 6) * (x + 7)
    return ((z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi)
            + 1 / (12 * z) - 1 / (360 * z * z * z) + 1 / (1260 * z * z * z * z * z) - F.log(up))


def _log_kt(n0: Column, n1: Column) -> Column:
    """ln of the Krichevsky-Trofimov probability of n0 zeros and n1 ones in some order."""
    a, b = n0.cast("double"), n1.cast("double")
    return F.when(a + b == 0, F.lit(0.0)).otherwise(
        _log_gamma(a + 0.5) + _log_gamma(b + 0.5) - math.log(math.pi) - _log_gamma(a + b + 1))


def _bits(grams: DataFrame, *more: str) -> DataFrame:
    """Eight rows a gram: its context, the bits of the byte so far (with a leading 1), the next bit."""
    byte = F.col("gram").bitwiseAND(255)
    steps = F.array(*[F.struct(
        (F.shiftright(byte, 8 - j) + (1 << j)).cast("int").alias("so_far"),
        F.shiftright(byte, 7 - j).bitwiseAND(1).cast("int").alias("bit")) for j in range(8)])
    return grams.select("gram", F.shiftright("gram", 8).alias("ctx"), *more, F.explode(steps).alias("s")).select(
        "gram", "ctx", *more, "s.so_far", "s.bit")


def gram_log_probs(counts: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(gram, n, lp), written: log10 of the weighted conditional probability of a window's last byte after the others."""
    old: list[str] = []
    counts = written(counts, old)
    bits = _bits(counts, "n")
    # dealt by context before the eight rows a gram, so that one row a gram is shuffled
    level = _bits(counts.repartition(F.shiftright("gram", 8).alias("ctx")), "n").groupBy("ctx", "so_far").agg(
        F.sum(F.when(F.col("bit") == 0, F.col("n")).otherwise(0)).alias("n0"),
        F.sum(F.when(F.col("bit") == 1, F.col("n")).otherwise(0)).alias("n1"))
    level = written(level.withColumn("pw", _log_kt(F.col("n0"), F.col("n1"))).withColumn("stop", F.lit(1.0)), old)
    levels = [level]
    for d in range(depth - 1, -1, -1):
        below = level.withColumn("ctx", F.col("ctx").bitwiseAND(256 ** d - 1))
        level = below.groupBy("ctx", "so_far").agg(
            F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("pw").alias("kids"))
        level = level.withColumn("pe", _log_kt(F.col("n0"), F.col("n1"))).withColumn(
            "top", F.greatest("pe", "kids"))
        level = level.withColumn("pw", F.col("top") + F.log(
            0.5 * F.exp(F.col("pe") - F.col("top")) + 0.5 * F.exp(F.col("kids") - F.col("top"))))
        level = written(level.select("ctx", "so_far", "n0", "n1", "pw",
                                   F.least(F.lit(1.0), 0.5 * F.exp(F.col("pe") - F.col("pw"))).alias("stop")), old)
        levels.append(level)
    one = (F.col("n1") + 0.5) / (F.col("n0") + F.col("n1") + 1)
    mix = None
    for d, level in enumerate(reversed(levels)):
        node = level.select("ctx", "so_far", "stop", one.alias("one"))
        if mix is None:
            mix = node.select("ctx", "so_far", (F.col("stop") * F.col("one")).alias("p1"),
                              (1 - F.col("stop")).alias("rest"))
            continue
        up = mix.withColumnRenamed("ctx", "up")
        mix = (node.withColumn("up", F.col("ctx").bitwiseAND(256 ** (d - 1) - 1)).join(up, ["up", "so_far"])
               .select("ctx", "so_far", (F.col("p1") + F.col("rest") * F.col("stop") * F.col("one")).alias("p1"),
                       (F.col("rest") * (1 - F.col("stop"))).alias("rest")))
    p = F.when(F.col("bit") == 1, F.col("p1")).otherwise(1 - F.col("p1"))
    out = written(bits.join(mix, ["ctx", "so_far"]).groupBy("gram").agg(
        F.first("n").alias("n"), F.sum(F.log10(p)).alias("lp")))
    discard(counts.sparkSession, old)
    return out


class Table:
    """Hash table of fixed size from gram keys to values, two slots a key; a key that lost both counts as absent."""

    FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)

    def __init__(self, keys: np.ndarray, values: np.ndarray, bits: int = 21):
        """``keys`` come with the most frequent first; those win a slot."""
        self.shift = np.uint64(64 - bits)
        self.keys = np.full(1 << bits, -1, np.int64)
        self.values = np.zeros(1 << bits)
        for factor in self.FACTORS:
            at = self.slot(keys, factor)
            free = self.keys[at] == -1
            at, keys_in, values_in = at[free][::-1], keys[free][::-1], values[free][::-1]
            self.keys[at] = keys_in
            self.values[at] = values_in
            lost = self.keys[self.slot(keys, factor)] != keys
            keys, values = keys[lost], values[lost]

    def slot(self, keys: np.ndarray, factor: np.uint64) -> np.ndarray:
        return (keys.astype(np.uint64) * factor >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values (0 where absent) and which keys are there."""
        at = self.slot(keys, self.FACTORS[0])
        there = self.keys[at] == keys
        out = np.where(there, self.values[at], 0.0)
        rest = np.flatnonzero(~there)
        if len(rest):
            at = self.slot(keys[rest], self.FACTORS[1])
            found = self.keys[at] == keys[rest]
            out[rest[found]] = self.values[at[found]]
            there[rest[found]] = True
        return out, there


def frequent(counts: DataFrame, top: int) -> pa.Table:
    """The rows of ``counts`` with the largest n, as many whole steps of n (a sixteenth of a power of two) as fit in ``top``.

    Only a histogram of the steps and at most ``top`` rows reach the driver.
    """
    step = F.floor(16 * F.log2(F.col("n") + 1)).cast("int")
    room, least = top, 1
    for row in sorted(counts.filter("n > 0").groupBy(step.alias("step")).count().collect(), reverse=True):
        if row["count"] > room:
            least = row["step"] + 1
            break
        room -= row["count"]
    return counts.filter((F.col("n") > 0) & (step >= least)).toArrow().sort_by([("n", "descending")])


_PART = "rid long, kind int, key binary, n long, tokens long, known long, base double, score double, bytes long"


def _keys(grams: np.ndarray) -> list[bytes]:
    """Eight bytes a gram, most significant first."""
    data = grams.astype(">i8").tobytes()
    return [data[i:i + 8] for i in range(0, len(data), 8)]


def _scorer(words, grams, depth: int):
    tables: list = []

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if not tables:
            tables.append(dict(zip(*words.value, strict=True)))
            tables.append(Table(*grams.value))
        known, table = tables
        for pdf in batches:
            rids = pdf["rid"].to_numpy()
            tokens = [words_in(t) for t in pdf["text"]]
            for a, b in runs([sum(map(len, t)) + len(t) for t in tokens], CHUNK_BYTES):
                texts = [b" ".join(t) for t in tokens[a:b]]
                keys, lengths = gram_keys(texts, depth)
                lp, there = table.get(keys)
                starts = np.cumsum(lengths) - lengths
                part = {"rid": rids[a:b], "kind": 0, "key": [b"%d" % r for r in rids[a:b]], "n": 1,
                        "score": np.add.reduceat(lp, starts), "bytes": lengths}
                rare_rid, rare_word, rare_n, part["tokens"], part["known"], part["base"] = [], [], [], [], [], []
                for rid, ws in zip(rids[a:b], tokens[a:b], strict=True):
                    found = [known.get(w) for w in ws]
                    found.append(known.get(b""))
                    hits = [x for x in found if x is not None]
                    if len(hits) < len(found):
                        rare = Counter(w for w, x in zip(ws, found) if x is None)  # noqa: B905
                        rare_rid.extend([rid] * len(rare))
                        rare_word.extend(rare.keys())
                        rare_n.extend(rare.values())
                    part["tokens"].append(len(ws) + 1)
                    part["known"].append(len(hits))
                    part["base"].append(math.fsum(hits))
                yield pd.DataFrame(part)[["rid", "kind", "key", "n", "tokens", "known", "base", "score", "bytes"]]
                none = {"tokens": 0, "known": 0, "base": 0.0, "score": 0.0, "bytes": 0}
                if rare_rid:
                    yield pd.DataFrame({"rid": rare_rid, "kind": 1, "key": rare_word, "n": rare_n, **none})
                if not there.all():
                    row = np.repeat(np.arange(b - a), lengths)[~there]
                    order = np.lexsort((keys[~there], row))
                    row, miss = row[order], keys[~there][order]
                    first = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (miss[1:] != miss[:-1])])
                    yield pd.DataFrame({
                        "rid": rids[a:b][row[first]], "kind": 2,
                        "key": _keys(miss[first]),
                        "n": np.diff(np.r_[first, len(row)]), **none})
    return score


def score_documents(docs: DataFrame, depth: int = DEPTH, top_words: int = TOP_WORDS,
                    top_grams: int = TOP_GRAMS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte of every document.

    Learns from documents that are not held out (crc32 of the id modulo 7 is not 2).
    Defined results: a null or empty text has only the end token and the end symbol;
    repeated rows each get a row; an empty table gives an empty result; with nothing
    to learn from, N and V are 0 and the model is uniform.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", "text")
    train = ~held_out("doc_id", 7)
    words = written(word_counts(rows.filter(train)))
    total, kinds = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    grams = gram_log_probs(gram_counts(rows, train, depth=depth), depth)
    best = frequent(words, top_words)
    common = (best["word"].to_pylist(), np.log10(best["n"].to_numpy() + 1.0).tolist())
    best = frequent(grams, top_grams)
    often = (best["gram"].to_numpy(), best["lp"].to_numpy())
    score = _scorer(spark.sparkContext.broadcast(common), spark.sparkContext.broadcast(often), depth)
    ids = rows.withColumn("rid", F.monotonically_increasing_id())
    parts = ids.select("rid", "text").mapInPandas(score, _PART)
    values = words.select(F.lit(1).alias("kind"), F.col("word").alias("key"), F.log10(F.col("n") + 1).alias("v")).union(
        grams.select(F.lit(2), F.unhex(F.lpad(F.hex("gram"), 16, "0")), "lp"))
    rare = F.col("kind") == 1
    found = parts.join(values, ["kind", "key"], "left").groupBy("rid").agg(
        F.sum("tokens").alias("n_tokens"),
        F.sum(F.col("known") + F.when(rare & F.col("v").isNotNull(), F.col("n")).otherwise(0)).alias("n_known"),
        F.sum(F.col("base") + F.when(rare, F.coalesce("v", F.lit(0.0)) * F.col("n")).otherwise(0.0)).alias("base"),
        F.sum(F.col("score") + F.when(F.col("kind") == 2, F.col("v") * F.col("n")).otherwise(0.0)).alias("score"),
        F.sum("bytes").alias("bytes"))
    out = found.join(ids.select("rid", "doc_id"), "rid")
    return out.select(
        "doc_id", held_out("doc_id", 7).alias("held_out"), "n_tokens", "n_known",
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") - F.col("n_tokens") * F.log10(F.lit(float(total + kinds + 1)))).alias("base_score"),
        "score", (-F.col("score") / math.log10(2) / F.col("bytes")).alias("bits_per_byte"))
