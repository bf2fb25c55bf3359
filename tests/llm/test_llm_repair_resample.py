"""Conversation repair, importance resampling and differencing windows against plain versions."""

import hashlib
import heapq
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from llm_cases import EDGE, edge, empty, lower

SF = "/root/testdata/sf0.001"
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
CONV = "conv_id long, turn long, role string, text string, conv string, rid long, kind int"


# conversations

def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def plain_repair(rows):
    """Counts, cost, edits and digest of one conversation: a search over (rows done, state) by cost, then edits."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
    seen, fault = set(), []
    for _, _, role, text in rows:
        bare = text.rstrip(" \t\n\x0b\x0c\r")
        fault.append("blank" if not bare else "duplicate" if (role, text) in seen else
                     "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    turns = {r[1] for r in rows if r[1] is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    initials = [r[2][:1] for r in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
    follows = {"": "su", "s": "u", "u": "a", "a": "u"}
    heap, done = [(0, "", 0, "", ())], set()
    while True:
        cost, edits, i, last, lines = heapq.heappop(heap)
        if i == len(rows) and last in ("", "a"):
            break
        if (i, last) in done:
            continue
        done.add((i, last))
        for role in ("user", "assistant"):
            if role[0] in follows[last]:
                heapq.heappush(heap, (cost + 2, edits + "I", i, role[0], (*lines, role + ":")))
        if i < len(rows):
            _, _, role, text = rows[i]
            heapq.heappush(heap, (cost + 3, edits + "D", i + 1, last, lines))
            if fault[i] in ("", "truncated"):
                more = int(fault[i] == "truncated")
                if role[:1] and role[:1] in follows[last]:
                    heapq.heappush(heap, (cost + more, edits + "K", i + 1, role[0], (*lines, f"{role}:{text}")))
                for new in ("user", "assistant"):
                    if new[0] in follows[last]:
                        heapq.heappush(heap, (cost + 2 + more, edits + "R", i + 1, new[0], (*lines, f"{new}:{text}")))
    digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
    return gaps, *[fault.count(x) for x in ("blank", "duplicate", "truncated")], illegal, cost, edits, digest


def made_conversations():
    r = random.Random(11)
    rows = []
    for conv in range(120):
        for turn in range(r.choice([1, 2, 5, 9])):
            role = r.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            text = r.choice(["So. ", "no end", "why? \n", "", " \t", None, "is it!\r", f"number {turn}."])
            rows.append((conv if conv else None, r.choice([turn, turn, 3, None]), role, text))
    return rows


def as_frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2) for r in rows], CONV).repartition(3)


def test_repair_equals_plain_search(spark):
    from sensortracks.llm.convrepair import damaged, repair

    rows = made_conversations()
    df = as_frame(spark, rows)
    assert sorted(map(repr, map(tuple, damaged(df).collect()))) == sorted(map(repr, damage(rows)))
    got = {r["conv_id"]: tuple(r)[1:] for r in repair(damaged(df), df).collect()}
    groups = {r[0]: [] for r in rows}
    for r in damage(rows):
        groups[r[0]].append(r)
    assert got == {c: plain_repair(g) for c, g in groups.items()}


def test_repair_of_long_conversation(spark):
    """One conversation with most rows lies over many runs and tasks; one that loses all its rows stays."""
    from sensortracks.llm import convrepair

    r = random.Random(5)
    rows = [(1, t // 2, r.choice(["user", "assistant", "assistant", "system"]), r.choice(["a.", "b", "", f"{t % 40}."]))
            for t in range(3000)] + [(2, 0, "user", "Hi."), (2, 1, "assistant", "Yes.")]
    names = as_frame(spark, [*rows, (3, 0, "user", "gone")])
    got = {x["conv_id"]: tuple(x)[1:] for x in convrepair.repair(as_frame(spark, rows), names, run=150).collect()}
    assert got[1] == plain_repair(rows[:3000])
    assert got[2] == plain_repair(rows[3000:])
    assert got[3] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())
    none = spark.createDataFrame([], CONV)
    assert convrepair.repair(none, none).collect() == []


def test_runs_join_like_one_sequence():
    """Costs and edits by runs of any length, and by the grammar, equal those of one sequence."""
    from sensortracks.llm import convrepair as c

    r = random.Random(2)
    for _ in range(60):
        line = bytes(r.randrange(c.SYMBOLS) for _ in range(r.randint(1, 60))) * r.choice([1, 4])
        whole = c.Grammar([line, line, line])
        cost, to, more = c._best_end(whole.cost[whole.tops[0]], whole.rank[whole.tops[0]])
        text = whole.audit(whole.tops[0], c.START, to) + more
        assert whole.audit(whole.tops[2], c.START, to) + more == text
        cuts = sorted({0, len(line), *(r.randrange(len(line)) for _ in range(3))})
        parts = [line[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        g = c.Grammar(parts)
        pdf = pd.DataFrame({"conv": "x", "rid": range(len(parts)), "head": 1, "tail": 1, "low": 0, "high": 0,
                            "cost": [g.cost[t].ravel() for t in g.tops], "rank": [g.rank[t].ravel() for t in g.tops]})
        way = c._joined(pdf)
        assert way["cost"].iloc[0] == cost
        assert "".join(g.audit(t, e // 4, e % 4) + i for t, e, i in
                       zip(g.tops, way["entry"], way["inserts"], strict=True)) == text


def test_grammar_shares_rules():
    from sensortracks.llm.convrepair import SYMBOLS, Grammar

    one = Grammar([bytes([3, 5] * 64)])
    many = Grammar([bytes([3, 5] * 64)] * 50)
    assert len(many.cost) < len(one.cost) + 12 and len(one.cost) < SYMBOLS + 20


# resampling

def plain_features(text):
    w = re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
    return len(w), [zlib.crc32(" ".join(w[i:i + n]).encode()) % 10000 for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def plain_resample(docs, target):
    s, t = np.zeros(10000), np.zeros(10000)
    for side, texts in ((s, [x for _, x in docs]), (t, target)):
        for text in texts:
            np.add.at(side, plain_features(text)[1], 1)
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.sum() + 10000) / ((s[b] + 1) * (t.sum() + 10000)))) for b in range(10000)]
    rows = []
    for doc, text in docs:
        n, f = plain_features(text)
        h = int(hashlib.sha256(f"42:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        rows.append([doc, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((r for r in rows if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[:5 * len(able) // 100], 1):
        r[4] = k
    return sorted(map(repr, (tuple(r[:5]) for r in rows)))


def test_resample_equals_plain(spark):
    from sensortracks.llm.dsir import resample

    docs = [(i, t) for i, t in duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()]
    docs += [(r[0], r[1]) for r in EDGE] + [(900, "Long " + "é" * 300 + " end."), (901, "a\0b c\nd")]
    target = [t for (t,) in duckdb.sql(f"SELECT text FROM '{SF}/benchmark.parquet'").fetchall()] + [None, ""]
    frame = spark.createDataFrame([(d, t, 1, "x", 2) for d, t in docs], "doc_id long, text string, place int, able string, row int")
    got = resample(frame.repartition(3), spark.createDataFrame([(t,) for t in target], "text string"))
    assert sorted(map(repr, map(tuple, got.collect()))) == plain_resample(docs, target)


def test_resample_edges(spark):
    from sensortracks.llm.dsir import resample

    rows = resample(edge(spark), empty(spark)).collect()
    assert len(rows) == len(EDGE) and all(r["n_features"] == 0 for r in rows if r["doc_id"] in (1, 2, 3))
    assert resample(empty(spark), edge(spark)).collect() == []


# differencing

@pytest.fixture(scope="module")
def word_bpe():
    return Tokenizer.from_file(WORD_BPE)


def test_ids_equal_library(word_bpe):
    from sensortracks.llm.kkpack import ids_of

    r = random.Random(3)
    letters = "abcdefgstrelvmdABZéÈœŒßñ019 '  .,-_|<>\n\t“’²µ́"
    texts = ["ΑΣ ΑΣ.", "á́ \x1c c\x85d", "don't'll 'S <|endoftext|> x<|startoftext|>y", "각 Å ﬁ İ ǅ ĳ", "x\0y \0", None, "",
             "-" * 3000, "ab" * 5000, *["".join(r.choice(letters) for _ in range(r.randint(1, 120))) for _ in range(3000)],
             *[t for (t,) in duckdb.sql(f"SELECT text FROM '{SF}/documents.parquet'").fetchall()]]
    for text, ids in zip(texts, ids_of(texts, WORD_BPE), strict=True):
        assert np.frombuffer(ids, "<u2").tolist() == [*word_bpe.encode(text or "", add_special_tokens=False).ids, 1], text


def plain_difference(lengths, windows):
    """Differencing with whole tuples of loads."""
    heap = [(-n, k, [n] + [0] * (windows - 1)) for k, n in enumerate(sorted(lengths, reverse=True))]
    heapq.heapify(heap)
    turn = len(lengths)
    while len(heap) > 1:
        (_, _, a), (_, _, b) = heapq.heappop(heap), heapq.heappop(heap)
        loads = sorted((x + y for x, y in zip(a, b[::-1], strict=True)), reverse=True)
        heapq.heappush(heap, (loads[-1] - loads[0], turn, [x - loads[-1] for x in loads]))
        turn += 1
    return -heap[0][0]


@pytest.mark.parametrize("windows", [2, 3, 7])
def test_difference(windows):
    from sensortracks.llm.kkpack import difference

    r = random.Random(windows)
    for _ in range(40):
        lengths = np.array([r.randint(1, 300) for _ in range(r.randint(windows + 1, 40))])
        loads = np.bincount(difference(lengths, windows), lengths, minlength=windows)
        assert len(loads) == windows and loads.sum() == lengths.sum()
        assert loads.max() - loads.min() == plain_difference(lengths.tolist(), windows)


def test_windows_rise_and_fill():
    from sensortracks.llm.kkpack import balanced, filled, laid_out

    at = balanced(np.array([90, 90, 90]), 100, slack=10)
    assert len(set(at)) == 3
    at = balanced(np.array([70, 70, 70, 70]), 100, slack=10)  # 3 windows would hold the tokens: one load is 140
    assert len(set(at)) == 4
    r = random.Random(1)
    for slack in (0, 16, 100):
        lengths = np.array([r.randint(1, 99) for _ in range(200)])
        parts = filled(lengths, balanced(lengths, 100, slack), 100)
        out = laid_out(parts, 100, spare=4)
        done = np.zeros(200, int)
        for piece, first, n, _, _ in sorted(out):
            assert first == done[piece]
            done[piece] += n
        assert (done == lengths).all()
        sizes = np.bincount([w for *_, w, _ in out], [n for _, _, n, _, _ in out])
        assert sizes.max() <= 100 and all(s >= 96 or s & (s - 1) == 0 for s in sizes.astype(int))


def test_pack_documents(spark, word_bpe):
    from sensortracks.llm.kkpack import pack_documents

    got = pack_documents(edge(spark), WORD_BPE, group=8).toPandas()
    texts = sorted(((r[0] if r[0] is not None else -1, r[1] or "") for r in EDGE))
    ids = [(d, [*word_bpe.encode(t, add_special_tokens=False).ids, 1]) for d, t in texts]
    assert got["length"].sum() == sum(len(x) for _, x in ids)
    for doc, x in ids:
        mine = got[got["doc_id"].fillna(-1) == doc]
        assert (mine["doc_tokens"] == len(x)).all()
        pieces = sorted({(int(s), int(n), int(c)) for s, n, c in zip(mine["start"], mine["length"], mine["ids_crc32"], strict=True)})
        if sum(1 for d, _ in ids if d == doc) == 1:
            assert [s for s, _, _ in pieces] == np.cumsum([0, *[n for _, n, _ in pieces]])[:-1].tolist()
        for s, n, c in pieces:
            assert zlib.crc32(np.array(x[s:s + n], "<u4").tobytes()) == c
    for _, window in got.groupby("sequence_id"):
        window = window.sort_values("offset")
        assert window["offset"].tolist() == np.cumsum([0, *window["length"]])[:-1].tolist()
        total = int(window["length"].sum())
        assert total <= 2048 and (2048 - total <= 32 or total & (total - 1) == 0)
    assert pack_documents(empty(spark), WORD_BPE).collect() == []


def test_padding_is_little(spark):
    from sensortracks.llm.queries import QUERIES

    got = QUERIES["op13_kkpack"](spark, SF).groupBy("sequence_id").agg(F.sum("length").alias("n")).toPandas()["n"]
    padding = sum(2048 - n for n in got if n & (n - 1))
    assert padding <= 0.01 * got.sum()


@pytest.mark.parametrize("name", ["op11_convrepair", "op12_dsir"])
def test_oracle(spark, name):
    from oracle_compare import _rows, duck_connection

    from sensortracks.llm.queries import ORACLES, QUERIES

    assert _rows(QUERIES[name](spark, SF).toPandas()) == _rows(duck_connection(SF).execute(ORACLES[name]).fetchdf())
