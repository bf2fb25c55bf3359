"""Rows and plain-Python counterparts shared by the training-data tests."""

import re
import zlib

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, shard int, kept string, _words int"
LONG = " ".join(f"word{i % 977} tail{i}" for i in range(30_000))
NEAR = "the quick brown fox jumps over the lazy dog and then runs far away from all of the angry hounds in the yard"
EDGE = [
    (1, None, "en", "a", None), (2, "", "en", "a", 0), (3, " \t\n ", "en", None, 4), (4, "12 34 !!", None, "a", 8),
    (5, NEAR, "en", "a", 1), (6, NEAR, "en", "a", 1), (6, NEAR, "en", "a", 1), (7, NEAR.upper() + " today", "en", "a", 1),
    (None, "text of a row without an id", "en", "b", 1), (9, LONG, "en", "a", len(LONG)), (10, "one two", "de", "a", 7),
    (11, "One  TWO", "de", "a", 8), (12, "aé中 b", "fr", "a", 4), (13, "x" * 20_000, "fr", "a", 1),
    (14, "mail joe.b@mail.example.org or +1 (555) 010-9999, ip 10.0.0.1 card 4111 1111 1111 1111", "en", "a", 1),
    (15, "<|endoftext|> end", "en", "a", 1),
]


def edge(spark):
    rows = [(*r, 1.0, 7, "x", 3) for r in EDGE]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words(text):
    return WORD.findall(lower(text))


def rest(doc_id, mod):
    return None if doc_id is None else zlib.crc32(str(doc_id).encode()) % mod


def shingles(text):
    w = words(text)
    return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def components(docs):
    """Smallest reachable id of every (id, text), by comparing all texts that share a shingle."""
    sets = [(d, shingles(t)) for d, t in docs]
    up = list(range(len(sets)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    seen = {}
    for i, (_, s) in enumerate(sets):
        common = {}
        for x in s:
            for j in seen.setdefault(x, []):
                common[j] = common.get(j, 0) + 1
            seen[x].append(i)
        for j, n in common.items():
            if 100 * n >= 75 * (len(s) + len(sets[j][1]) - n):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(sets):
        r = root(i)
        if d is not None:
            least[r] = min(least.get(r, d), d)
    return [least.get(root(i)) for i in range(len(sets))]


def quality(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept) of a text."""
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    many = {}
    for x in windows:
        many[x] = many.get(x, 0) + 1
    inside = {i + k for i, x in enumerate(windows) if many[x] > 1 for k in range(3)}
    n, chars, symbols = len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text)
    failed = n < 50 or 100 * len(inside) > 50 * n
    dup = len(lines) - len(set(lines))
    bad = (2 * symbols > n or 2 * dup > len(lines) or chars < 2 * n or chars > 20 * n
           or 2 * sum(c in "0123456789" for c in text) > chars or n and 2 * max(map(len, w)) > chars)
    return n, chars, symbols, dup, len(inside), failed, not failed and not bad
