"""Byte-level BPE encoding and decoding.

A word's merges follow a segment tree over the ranks of adjacent pairs: each leaf
holds the rank of the pair that starts there, the root the least rank and, among
equal ones, the leftmost place.  A merge changes three leaves, each in logarithmic
time, until the root says that no pair can merge.  ``merge_word`` does this for one
word of any length; ``merge_words`` does the same for many short words at once, one
row of a matrix of trees each.

Words repeat, so a task keeps what it has encoded.  A space between two characters
that are not white space always starts a new word of the pattern; texts are cut
there first and the parts looked up.  The vocabulary file is a parameter.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensortracks.llm.common import free_name, runs

# The byte-level pattern of this vocabulary, with white space by its Unicode property.
PATTERN = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
           r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")
NONE = np.int64(1) << 40
SHORT = 64
CACHE = 400_000


def byte_letters() -> dict[str, int]:
    """The printable character that stands for each byte in vocabulary files, and its byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Encodes and decodes with a byte-level BPE vocabulary (a tokenizers JSON file)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes_of = {i: t.encode() for t, i in self.special.items()}
        for token, i in vocab.items():
            if i not in self.bytes_of:
                self.bytes_of[i] = bytes(letters[c] for c in token)
        self.byte_id = np.zeros(256, np.int64)
        for c, b in letters.items():
            self.byte_id[b] = vocab[c]
        self.size = max(self.bytes_of) + 1
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        key = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(key)
        self.pair_key, self.pair_rank, self.pair_made = key[order], order.astype(np.int64), made[order]
        self.made_by_rank = made
        self.rank_of = dict(zip(key.tolist(), range(len(key)), strict=True))
        self.words = regex.compile(PATTERN)
        self.marks = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) or "(?!)")
        self.bytes_at = [self.bytes_of.get(i, b"") for i in range(self.size)]
        self.cache: dict[str, bytes] = {}  # parts as they stand
        self.spaced: dict[str, bytes] = {}  # parts without the space before them; no end is white space

    # one word

    def merge_word(self, word: bytes) -> list[int]:
        """Ids of one word by a segment tree over its adjacent pairs."""
        ids = self.byte_id[np.frombuffer(word, np.uint8)].tolist()
        n = len(ids)
        if n < 2:
            return ids
        leaves = 1 << (n - 2).bit_length()
        nothing = int(NONE) * n
        tree = [nothing] * (2 * leaves)  # rank * n + place, so that equal ranks go to the leftmost place
        get, size = self.rank_of.get, self.size

        def key(i: int, j: int) -> int:
            r = get(ids[i] * size + ids[j])
            return nothing if r is None else r * n + i

        for i in range(n - 1):
            tree[leaves + i] = key(i, i + 1)
        for k in range(leaves - 1, 0, -1):
            tree[k] = min(tree[2 * k], tree[2 * k + 1])
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def put(i: int, value: int) -> None:
            k = leaves + i
            tree[k] = value
            k >>= 1
            while k:
                least = min(tree[2 * k], tree[2 * k + 1])
                if tree[k] == least:
                    break
                tree[k] = least
                k >>= 1

        while tree[1] < nothing:
            rank, i = divmod(tree[1], n)
            j = after[i]
            ids[i] = int(self.made_by_rank[rank])
            after[i] = k = after[j]
            if j < n - 1:
                put(j, nothing)
            if k < n:
                before[k] = i
                put(i, key(i, k))
            elif i < n - 1:
                put(i, nothing)
            if before[i] >= 0:
                put(before[i], key(before[i], i))
        out, i = [], 0
        while i < n:
            out.append(ids[i])
            i = after[i]
        return out

    # many short words

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.size + right
        at = np.searchsorted(self.pair_key, key)
        at[at == len(self.pair_key)] = 0
        return np.where((self.pair_key[at] == key) & (left >= 0) & (right >= 0), self.pair_rank[at], NONE)

    def merge_words(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of words of 2 to SHORT bytes: a matrix of segment trees, a row a word, merged in step."""
        w = max(map(len, words))
        leaves = 1 << max(0, (w - 2).bit_length())
        rows = np.arange(len(words))
        lengths = np.array([len(x) for x in words])
        ids = np.full((len(words), leaves + 1), -1, np.int64)
        ids[:, :w][np.arange(w) < lengths[:, None]] = self.byte_id[np.frombuffer(b"".join(words), np.uint8)]
        after = np.tile(np.arange(1, leaves + 2), (len(words), 1))
        before = np.tile(np.arange(-1, leaves), (len(words), 1))
        tree = np.full((len(words), 2 * leaves), NONE * leaves, np.int64)
        place = np.arange(leaves)
        ranks = self._ranks(ids[:, :-1], ids[:, 1:])
        tree[:, leaves:] = np.where(ranks < NONE, ranks * leaves + place, NONE * leaves)
        width = leaves
        while width > 1:
            tree[:, width // 2:width] = np.minimum(tree[:, width:2 * width:2], tree[:, width + 1:2 * width:2])
            width //= 2

        def put(r: np.ndarray, i: np.ndarray, value: np.ndarray) -> None:
            k = i + leaves
            tree[r, k] = value
            k = k >> 1
            while len(k) and k[0] > 0:
                tree[r, k] = np.minimum(tree[r, 2 * k], tree[r, 2 * k + 1])
                k = k >> 1

        live = rows
        while len(live := live[tree[live, 1] < NONE * leaves]):
            rank, i = np.divmod(tree[live, 1], leaves)
            j = after[live, i]
            ids[live, i] = self.made_by_rank[rank]
            ids[live, j] = -1
            k = after[live, j]
            after[live, i] = k
            inside = j < leaves
            put(live[inside], j[inside], np.full(inside.sum(), NONE * leaves))
            there = k <= leaves
            before[live[there], k[there]] = i[there]
            right = np.where(there, ids[live, np.minimum(k, leaves)], -1)
            ranks = self._ranks(ids[live, i], right)
            put(live, i, np.where(ranks < NONE, ranks * leaves + i, NONE * leaves))
            p = before[live, i]
            has = p >= 0
            r, p, i = live[has], p[has], i[has]
            ranks = self._ranks(ids[r, p], ids[r, i])
            put(r, p, np.where(ranks < NONE, ranks * leaves + p, NONE * leaves))
        flat = ids[ids >= 0]
        return np.split(flat, np.cumsum((ids >= 0).sum(1))[:-1])

    # texts

    def _encode_parts(self, parts: list[str]) -> list[bytes]:
        """Ids of parts: texts whose ends are ends of words."""
        split = [[x.encode("utf-8", "surrogatepass") for x in self.words.findall(p)] for p in parts]
        known: dict[bytes, bytes] = {}
        short = []
        for word in {x for ws in split for x in ws}:
            if len(word) < 2:
                known[word] = self.byte_id[np.frombuffer(word, np.uint8)].astype("<u4").tobytes()
            elif len(word) <= SHORT:
                short.append(word)
            else:
                known[word] = np.array(self.merge_word(word), "<u4").tobytes()
        short.sort(key=len)
        for a in range(0, len(short), 4096):
            part = short[a:a + 4096]
            for word, ids in zip(part, self.merge_words(part), strict=True):
                known[word] = ids.astype("<u4").tobytes()
        return [b"".join([known[x] for x in ws]) for ws in split]

    def _fill(self, cache: dict, parts: list[str], before: str = "") -> None:
        for a in range(0, len(parts), 20_000):
            some = parts[a:a + 20_000]
            cache.update(zip(some, self._encode_parts([before + p for p in some]), strict=True))

    def _parts(self, text: str) -> list[str]:
        """``text`` cut before each space that has no white space beside it."""
        chunks = text.split(" ")
        out = [chunks[0]]
        cut = bool(chunks[0]) and not chunks[0][-1].isspace()
        for c in chunks[1:]:
            if cut and c and not c[0].isspace():
                out.append(" " + c)
            else:
                out[-1] += " " + c
            cut = bool(c) and not c[-1].isspace()
        return [x for x in out if x]

    def encode_many(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers; a null text counts as empty."""
        if len(self.cache) + len(self.spaced) > CACHE:
            self.cache.clear()
            self.spaced.clear()
        out: list = [None] * len(texts)
        plain, cut = [], []
        cache, spaced = self.cache, self.spaced
        new, new_spaced = set(), set()
        for at, text in enumerate(texts):
            text = text or ""
            if any(m in text for m in self.special):
                pieces, end = [], 0
                for m in self.marks.finditer(text):
                    pieces += [*self._parts(text[end:m.start()]), m[0]]
                    end = m.end()
                cut.append((at, pieces + self._parts(text[end:])))
                continue
            head, *rest = text.split(" ")
            fresh = set(rest).difference(spaced)
            if head[-1:].isspace() or rest and not head or any(
                    not c or c[0].isspace() or c[-1].isspace() for c in fresh):
                cut.append((at, self._parts(text)))
                continue
            new_spaced |= fresh
            if head not in cache:
                new.add(head)
            plain.append((at, head, rest))
        for mark, i in self.special.items():
            cache[mark] = np.array([i], "<u4").tobytes()
        new.update(p for _, ps in cut for p in ps if p not in cache)
        self._fill(cache, list(new))
        self._fill(spaced, list(new_spaced), " ")
        for at, head, rest in plain:
            out[at] = cache[head] + b"".join(map(spaced.__getitem__, rest))
        for at, ps in cut:
            out[at] = b"".join(map(cache.__getitem__, ps))
        return out

    def decode(self, ids: bytes) -> str:
        """Text of encoded ids; bytes that are no UTF-8 become replacement characters."""
        return b"".join(map(self.bytes_at.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of a vocabulary file, made once in each Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def groups_of_texts(texts: list, chars: int = 1 << 20) -> Iterator[list]:
    for a, b in runs([len(t or "") for t in texts], chars):
        yield texts[a:b]


def encode_decode(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``docs`` with ids (binary: little-endian unsigned 32-bit), n_tokens and decoded.

    Defined results: a null or empty text has no ids and decodes to the empty text;
    special tokens of the vocabulary that stand in a text become their ids, as the
    library does by default; repeated rows each get their own, equal result; an empty
    table gives an empty result.  Columns named like a result column are replaced, all others stay.
    """
    @F.pandas_udf("ids binary, n_tokens long, decoded string")
    def coded(texts: pd.Series) -> pd.DataFrame:
        enc = encoder(path)
        ids = [x for part in groups_of_texts(texts.tolist()) for x in enc.encode_many(part)]
        return pd.DataFrame({"ids": ids, "n_tokens": [len(x) // 4 for x in ids],
                             "decoded": [enc.decode(x) for x in ids]})

    names = ("ids", "n_tokens", "decoded")
    docs = docs.drop(*[c for c in docs.columns if c.lower() in names])
    c = free_name(docs, "_c")
    return docs.withColumn(c, coded(F.col(text))).select(*docs.columns, *[F.col(c)[n].alias(n) for n in names])


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document."""
    coded = encode_decode(docs.select("doc_id", "text"), path)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
