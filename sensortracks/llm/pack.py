"""Packing documents into sequences by vector best fit.

A piece needs three things of a bin: tokens, a place for one document, and attention
cost (the square of its length, as attention stays inside a document).  Pieces go in
decreasing size to the open bin that fits best under every constraint: least
residual norm after placing (``rule="norm"``), or greatest weighted dot product of
demand and residual (``rule="dot"``).

Groups of at most about ``GROUP`` pieces, dealt by a hash, are packed side by side.
Bins that a round leaves with room to spare are opened again and their pieces packed
once more in groups of their own, so that each round leaves only a few such bins a group.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensortracks.llm.bpe import PATTERN, encoder
from sensortracks.llm.common import saved

TOKENS = 1024
DOCS = TOKENS  # as many as the tokens of a sequence can hold
GROUP = 8192
ROUNDS = 2
SPARE = 0.01
WEIGHTS = (1.0, 0.01, 0.01)
LONG = 200_000
SEPARATOR = 2  # fixed value: the id that closes a document


def cut(n: int, capacity: int) -> Iterator[tuple[int, int, int]]:
    """(piece, start, length): all of ``capacity`` but the first, which takes the rest."""
    first = n % capacity or capacity
    yield 0, 0, min(first, n)
    for k, start in enumerate(range(first, n, capacity), 1):
        yield k, start, capacity


class Ids:
    """Ids of a tokenizer file's vocabulary by the compiled encoder of an installed library.

    The file's merges are in the order of their ids, so its tokens serve as ranks;
    special tokens in a text become their ids.  Very long texts go through the tree encoder
    of ``bpe``, whose work and memory are bounded; ids are the same.
    """

    def __init__(self, path: str):
        self.tree = encoder(path)
        special = self.tree.special
        ranks = {b: i for i, b in self.tree.bytes_of.items() if i not in special.values()}
        self.enc = tiktoken.Encoding("packing", pat_str=PATTERN.replace(r"\p{White_Space}", r"\s").replace(
            r"\P{White_Space}", r"\S"), mergeable_ranks=ranks, special_tokens=special)

    def __call__(self, text: str | None) -> np.ndarray:
        if text and len(text) > LONG:
            return np.frombuffer(self.tree.encode_many([text])[0], "<u4")
        return self.enc.encode_to_numpy(text or "", allowed_special="all").astype("<u4", copy=False)


_IDS: dict[str, Ids] = {}


def pieces_of(docs: DataFrame, path: str, text: str = "text", capacity: int = TOKENS) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document's ids with the closing id."""

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if path not in _IDS:
            _IDS[path] = Ids(path)
        ids_of = _IDS[path]
        for pdf in batches:
            out = []
            for at, text in enumerate(pdf["text"]):
                ids = np.append(ids_of(text), np.uint32(SEPARATOR))
                out += [(at, k, s, n, zlib.crc32(ids[s:s + n].data)) for k, s, n in cut(len(ids), capacity)]
            got = pd.DataFrame(out, columns=["at", "piece", "start", "length", "ids_crc32"])
            got.insert(0, "doc_id", pdf["doc_id"].astype("Int64").array[got.pop("at").to_numpy(int)])
            yield got

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInPandas(made, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(lengths: np.ndarray, capacity: int = TOKENS, max_docs: int = DOCS, max_cost: float | None = None,
             weights: tuple[float, float, float] = WEIGHTS, rule: str = "norm") -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece.

    Pieces go by decreasing length, equal ones in their order.  A piece that alone is
    over a capacity gets a bin of its own; ties between bins go to the oldest.
    """
    max_cost = float(max_cost or capacity * capacity)
    caps = np.array([capacity, max_docs, max_cost], float)
    w = np.array(weights, float)
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    room = np.empty((3, len(lengths)))  # residuals of open bins as shares of the capacity
    name = np.empty(len(lengths), np.int64)
    used = np.zeros(len(lengths), np.int64)
    n_open = n_bins = 0
    least = lengths.min() / capacity if len(lengths) else 0.0
    for i in np.argsort(-lengths, kind="stable"):
        need = np.array([lengths[i], 1.0, float(lengths[i]) ** 2]) / caps
        have = room[:, :n_open]
        fits = np.flatnonzero((have >= need[:, None] - 1e-12).all(0))
        if len(fits):
            if rule == "norm":
                left = have[:, fits] - need[:, None]
                at = fits[(w @ (left * left)).argmin()]
            else:
                at = fits[((w * need) @ have[:, fits]).argmax()]
        else:
            at = n_open
            room[:, at] = 1.0
            name[at] = n_bins
            n_open += 1
            n_bins += 1
        room[:, at] -= need
        bins[i] = name[at]
        offsets[i] = used[name[at]]
        used[name[at]] += lengths[i]
        if room[0, at] < least - 1e-12 or room[1, at] < 0.5 / max_docs:  # full: closed
            n_open -= 1
            room[:, at:n_open] = room[:, at + 1:n_open + 1]
            name[at:n_open] = name[at + 1:n_open + 1]
    return bins, offsets


def pack(pieces: DataFrame, capacity: int = TOKENS, max_docs: int = DOCS, max_cost: float | None = None,
         weights: tuple[float, float, float] = WEIGHTS, rule: str = "norm", group: int = GROUP,
         rounds: int = ROUNDS) -> DataFrame:
    """``pieces`` (with a long column length) with sequence_id and offset.

    Full pieces are sequences by themselves.  Defined results: pieces of length 0
    are packed like others; an empty table gives an empty result; repeated rows are
    different pieces.  Columns named sequence_id or offset are replaced.
    """
    names = ("sequence_id", "offset")
    pieces = pieces.drop(*[c for c in pieces.columns if c.lower() in names])
    rows = saved(pieces.select(F.struct("*").alias("_row"), F.col("length").alias("_n"),
                               F.monotonically_increasing_id().alias("_id")))
    done = [rows.filter(F.col("_n") >= capacity).select(
        "_id", (-1 - F.col("_id")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))]
    open_ = rows.filter(F.col("_n") < capacity).select("_id", "_n")
    for turn in range(rounds):
        n = open_.count()
        groups = max(1, math.ceil(n / group))
        last = turn == rounds - 1 or groups == 1

        def packed(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("_id")
            lengths = pdf["_n"].to_numpy(np.int64)
            bins, offsets = best_fit(lengths, capacity, max_docs, max_cost, weights, rule)
            fill = np.bincount(bins, lengths)
            return pd.DataFrame({"_id": pdf["_id"], "_n": lengths, "_g": pdf["_g"], "_bin": bins, "offset": offsets,
                                 "_spare": fill[bins] < (1 - SPARE) * capacity})

        dealt = open_.withColumn("_g", F.pmod(F.xxhash64(F.lit(turn), "_id"), F.lit(groups)))
        out = saved(dealt.groupBy("_g").applyInPandas(
            packed, "_id long, _n long, _g long, _bin long, offset long, _spare boolean"))
        number = (F.lit(turn) * F.lit(1 << 56) + F.col("_g") * F.lit(1 << 28) + F.col("_bin")).alias("sequence_id")
        done.append((out if last else out.filter(~F.col("_spare"))).select("_id", number, "offset"))
        if last:
            break
        open_ = out.filter("_spare").select("_id", "_n")
    placed = done[0]
    for more in done[1:]:
        placed = placed.unionByName(more)
    return rows.join(placed, "_id").select(*[F.col("_row")[c].alias(c) for c in pieces.columns], *names)


def pack_documents(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every document.

    A null text counts as empty: one piece with only the closing id.
    """
    return pack(pieces_of(docs, path, text))
