"""Packing documents into near-equal windows by Karmarkar-Karp multiway differencing.

A document's ids are cut into windows of their own as often as one is full; the rest is one
piece.  Pieces are dealt by a hash into groups of about ``GROUP``, and each group is one
differencing problem over as many windows as its tokens need: every piece starts as a partial
partition of its own (one load, all others zero); the two partial partitions with the
largest imbalance (largest load less smallest) are merged so that the large loads of one meet
the small loads of the other; until one is left.  Where its largest load is over the capacity by more than ``SLACK``, the
number of windows rises and the group is differenced again.  A smaller excess is cut off and goes to
the windows with the most room, as documents may be cut anywhere: with documents of some hundred tokens
the near-equal windows are some tens of tokens apart, and to raise their number until all fit costs 3.4 %
of padding on the test documents, against 0.03 % this way.

A window may end at any power of two without padding.  So a window that is left with
more than ``SPARE`` tokens of padding (in small tables and odd groups) is divided at powers of two.
"""

from __future__ import annotations

import heapq
import math
import os
import re
import zlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensortracks.llm.bpe import byte_letters

TOKENS = 2048
GROUP = 4096
SLACK = 256
SPARE = 32
END = 1  # fixed value: the id that closes a document
CACHE = 100_000
COLUMNS = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
# The file's pattern, where a text has only the characters of ``ODD``'s complement. These are
# in normal form, have one small letter each, and their class (letter, digit, other) is the same in every Unicode version.
CHUNK = re.compile("[^\\x20\\x09-\\x0D]+")
LETTERS = "a-zA-Z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u0177"
ODD = re.compile(f"[^\\x20-\\x7E\\x09-\\x0D\u2010-\u2027{LETTERS}]|<\\|")
TOKEN = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[0-9]|[^\\x20\\x09-\\x0D0-9{LETTERS}]+")


class Ids:
    """Ids of a tokenizer file whose words end in a mark of their own.

    Merges are in the order of their ids, so the file's tokens serve as the ranks of a
    compiled encoder; the end of a word is the byte 0, which ordinary text does not hold, and joins the
    word's last byte before any merge.  Chunks between white space that hold an odd
    character (or may hold a special token) go to the tokenizer itself, one by one, and are kept.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids are kept in two bytes")
        letters, mark = byte_letters(), "</w>"
        ranks = {}
        for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items():
            word = token.removesuffix(mark)
            if all(c in letters for c in word):
                ranks[bytes(letters[c] for c in word) + b"\0" * (word != token)] = i
        self.enc = tiktoken.Encoding("words", pat_str="[^\\x00]+\\x00", mergeable_ranks=ranks, special_tokens={})
        self.odd: dict[str, np.ndarray] = {}

    def _plain(self, text: str) -> np.ndarray:
        words = TOKEN.findall(text.lower())
        return self.enc.encode_to_numpy("\0".join([*words, ""]), disallowed_special=()).astype("<u2")

    def _odd(self, chunk: str) -> np.ndarray:
        if chunk not in self.odd:
            if len(self.odd) > CACHE:
                self.odd.clear()
            self.odd[chunk] = np.array(self.tokenizer.encode(chunk, add_special_tokens=False).ids, "<u2")
        return self.odd[chunk]

    def __call__(self, text: str) -> np.ndarray:
        if not ODD.search(text):
            return self._plain(text)
        parts = groupby(CHUNK.findall(text), key=lambda c: ODD.search(c) is not None)
        out = [np.zeros(0, "<u2")]
        for odd, chunks in parts:
            out += [self._odd(c) for c in chunks] if odd else [self._plain(" ".join(chunks))]
        return np.concatenate(out)


_IDS: dict[str, Ids] = {}


def ids_of(texts: list[str | None], path: str) -> Iterator[bytes]:
    """The ids of each text (null: empty) and the closing id, as little-endian unsigned 16-bit integers."""
    if path not in _IDS:
        _IDS[path] = Ids(path)
    for text in texts:
        yield np.append(_IDS[path](text or ""), np.array([END], "<u2")).tobytes()


def _crc(ids: bytes) -> int:
    return zlib.crc32(np.frombuffer(ids, "<u2").astype("<u4").data)


def pieces_of(docs: DataFrame, path: str, text: str = "text", capacity: int = TOKENS) -> DataFrame:
    """(doc_id, start, length, doc_tokens, ids_crc32, ids): full windows and the rest of every document; only
    the rest, which may be cut again, has its ids."""

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for at, ids in enumerate(ids_of(pdf["text"].tolist(), path)):
                n = len(ids) // 2
                full = n // capacity * capacity
                out += [(at, s, capacity, n, _crc(ids[2 * s:2 * (s + capacity)]), None) for s in range(0, full, capacity)]
                if full < n:
                    out.append((at, full, n - full, n, 0, ids[2 * full:]))
            got = pd.DataFrame(out, columns=["at", "start", "length", "doc_tokens", "ids_crc32", "ids"])
            got.insert(0, "doc_id", pdf["doc_id"].astype("Int64").array[got.pop("at").to_numpy(int)])
            yield got

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInPandas(made, "doc_id long, start long, length long, doc_tokens long, ids_crc32 long, ids binary")


def difference(lengths: np.ndarray, windows: int) -> np.ndarray:
    """The window of every piece, by differencing over ``windows`` windows.

    A partial partition is its loads in falling order, less the smallest, with the set of
    pieces behind each; loads of zero without pieces are left out.  Sets are kept as a forest.
    """
    n = len(lengths)
    up = np.arange(n)
    if windows <= 1 or n <= windows:
        return np.zeros(n, np.int64) if windows <= 1 else up
    order = np.argsort(-lengths, kind="stable")
    heap = [(-int(lengths[i]), k) for k, i in enumerate(order)]
    parts = {k: (lengths[i:i + 1].astype(np.int64), up[i:i + 1].copy()) for k, i in enumerate(order)}
    turn = n
    while len(heap) > 1:
        (_, x), (_, y) = heapq.heappop(heap), heapq.heappop(heap)
        (a, sa), (b, sb) = parts.pop(x), parts.pop(y)
        if len(a) < len(b):
            a, sa, b, sb = b, sb, a, sa
        both = len(a) + len(b) - windows
        if both == 1 == len(b):  # one piece into the least load of a full partition
            load, root = a[-1] + b[0], sa[-1]
            up[sb[0]] = root
            at = len(a) - 1 - np.searchsorted(a[-2::-1], load, side="right")
            a[at + 1:], sa[at + 1:] = a[at:-1].copy(), sa[at:-1].copy()
            a[at], sa[at] = load, root
        else:
            if both > 0:
                a[len(a) - both:] += b[len(b) - both:][::-1]
                up[sb[len(b) - both:][::-1]] = sa[len(a) - both:]
                b, sb = b[:len(b) - both], sb[:len(sb) - both]
            a, sa = np.concatenate([a, b]), np.concatenate([sa, sb])
            fall = np.argsort(-a, kind="stable")
            a, sa = a[fall], sa[fall]
        if len(a) == windows:
            a -= a[-1]
        parts[turn] = a, sa
        heapq.heappush(heap, (-int(a[0]), turn))
        turn += 1
    while not (up == up[up]).all():
        up = up[up]
    return np.unique(up, return_inverse=True)[1]


def balanced(lengths: np.ndarray, capacity: int = TOKENS, slack: int = SLACK) -> np.ndarray:
    """The window of every piece; windows from the fewest that hold the tokens upwards, until none is over by more than ``slack``."""
    if not len(lengths):
        return np.zeros(0, np.int64)
    windows = max(1, math.ceil(int(lengths.sum()) / capacity))
    while True:
        at = difference(lengths, windows)
        if np.bincount(at, lengths).max() <= capacity + slack:
            return at
        windows += 1


def filled(lengths: np.ndarray, at: np.ndarray, capacity: int = TOKENS) -> list[list[tuple[int, int, int]]]:
    """(piece, first id, length) of the parts of every window, none over capacity: what is over is cut off at the
    window's end and goes where there is most room, in as many parts as it takes."""
    parts: list[list] = [[] for _ in range(int(at.max()) + 1)] if len(at) else []
    for piece in np.lexsort((-lengths, at)):
        parts[at[piece]].append((int(piece), 0, int(lengths[piece])))
    loose, room = [], []
    for k, window in enumerate(parts):
        over = sum(p[2] for p in window) - capacity
        if over < 0:
            room.append((over, k))
        while over > 0:
            piece, first, n = window.pop()
            keep = max(0, n - over)
            if keep:
                window.append((piece, first, keep))
            loose.append((piece, first + keep, n - keep))
            over -= n - keep
    heapq.heapify(room)
    for piece, first, n in sorted(loose, key=lambda p: -p[2]):
        while n:
            if not room:
                parts.append([])
                room.append((-capacity, len(parts) - 1))
            free, k = heapq.heappop(room)
            m = min(n, -free)
            parts[k].append((piece, first, m))
            if m < -free:
                heapq.heappush(room, (free + m, k))
            first, n = first + m, n - m
    return parts


def laid_out(parts: list, capacity: int = TOKENS, spare: int = SPARE) -> list[tuple[int, int, int, int, int]]:
    """(piece, first id, length, window, offset) of every part; windows with more padding than ``spare`` end at powers of two."""
    out, number = [], 0
    for window in parts:
        left = sum(p[2] for p in window)
        sizes = [left]
        if capacity - left > spare:
            sizes = [1 << b for b in range(left.bit_length() - 1, -1, -1) if left >> b & 1]
        k = used = 0
        for piece, first, n in window:
            while n:
                m = min(n, sizes[k] - used)
                out.append((piece, first, m, number + k, used))
                first, n, used = first + m, n - m, used + m
                if used == sizes[k]:
                    k, used = k + 1, 0
        number += len(sizes)
    return out


def pack_documents(docs: DataFrame, path: str, text: str = "text", capacity: int = TOKENS, group: int = GROUP,
                   slack: int = SLACK, spare: int = SPARE) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece of every document.

    Defined results: a null text counts as empty, one piece with only the closing id; a null
    id keeps its rows; repeated rows are different documents; pieces of equal length are in the order of
    their rows; an empty table gives an empty result; other columns of ``docs`` are not read.
    """
    rows = pieces_of(docs, path, text, capacity).withColumn("id", F.monotonically_increasing_id())
    groups = max(1, math.ceil(docs.count() / group))  # a document has one rest at most

    def packed(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        pdf["doc_id"] = pdf["doc_id"].astype("Int64")
        full = pdf[pdf["length"] == capacity].assign(offset=0)
        full["sequence_id"] = -1 - full.pop("id")
        rest = pdf[pdf["length"] < capacity].reset_index(drop=True)
        lengths, ids = rest["length"].to_numpy(np.int64), rest["ids"].tolist()
        out = np.array(laid_out(filled(lengths, balanced(lengths, capacity, slack), capacity), capacity, spare),
                       np.int64).reshape(-1, 5)
        cut = rest.loc[out[:, 0]].reset_index(drop=True)
        cut["start"] += out[:, 1]
        cut["length"], cut["offset"] = out[:, 2], out[:, 4]
        cut["sequence_id"] = cut["g"] * (1 << 32) + out[:, 3]
        cut["ids_crc32"] = [_crc(ids[p][2 * f:2 * (f + n)]) for p, f, n in out[:, :3].tolist()]
        return pd.concat([full, cut])[COLUMNS]

    dealt = rows.withColumn("g", F.pmod(F.xxhash64("id"), F.lit(groups)))
    return dealt.groupBy("g").applyInPandas(packed, ", ".join(f"{c} long" for c in COLUMNS))
