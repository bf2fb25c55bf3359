"""Repair of conversation structure by a dynamic program over grammar-compressed sequences.

A conversation is a sequence of rows, each a symbol: the role's initial and the row's fault.
Edits (keep, rerole, delete, insert) turn it into one whose initials match ``(s?(ua)+)?``.  The
four states are what was put out last (nothing, system, user, assistant), and a symbol's
transfer matrix holds, for every pair of states, the least cost of its row and the edits that have it.

Sequences are compressed by Re-Pair: the most frequent pair of adjacent symbols becomes a
rule, again and again, over the sequences of many conversations at once.  A rule's matrix is
the min-plus product of its two symbols' matrices, so each is worked out once, bottom-up, and
shared by every conversation that holds it.  The edits of an entry are a rope: the
state in the middle names the entry of the left and of the right symbol, whose ropes follow each
other.  Ropes of one row of a matrix are ranked in the order of their strings: two edits from
one state that end in different states differ, and neither is the other's beginning (both end with
the last row's edit), so a product compares by the left rank alone.

In Spark: damage, order and faults are DataFrame code (one range sort, so a long
conversation lies over many tasks); runs of at most ``RUN`` rows are the sequences; equal ones
are evaluated once.  Runs of one conversation are joined by their 4 x 4 costs and ranks only.  The repaired
text is hashed in one pass over the rows of each conversation, which holds a batch and the edits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensortracks.llm.common import WHITE, saved

# The costs of the edits.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
RUN = 1 << 13
BLOCK = 1 << 16
LEAST_USES = 4
# Symbols. 0 is a row that has to go; role class (s, u, a, other) * 2 + truncated + 1 all others.
GONE, SYMBOLS = 0, 9
NEXT_USER, START, SYSTEM, USER, ASSISTANT = (0, 1, 3), 0, 1, 2, 3
STOP = (START, ASSISTANT)
FAR = 1 << 40


def damaged(rows: DataFrame) -> DataFrame:
    """``rows`` (conv_id, turn, role, text) with the contract's damage; null roles and texts are one space."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"),
                   F.coalesce(F.col("turn").cast("string"), space))
    kind, text = F.crc32(key) % 20, F.coalesce("text", space)
    out = rows.select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(F.coalesce("role", space)).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"), kind.alias("kind"))
    out = out.filter("kind <> 0").withColumn("copies", F.when(F.col("kind") == 3, 2).otherwise(1))
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))).drop("kind", "copies", "copy")


def _key() -> Column:
    return F.coalesce(F.concat(F.lit("v"), F.col("conv_id").cast("string")), F.lit("null"))


def _order() -> list[Column]:
    return [F.asc_nulls_first("turn"), F.asc("role"), F.asc("text")]


def _marked(rows: DataFrame) -> DataFrame:
    """(conv, rid, turn, timeless, initial, blank, truncated, first): every row in its place; first says that no equal
    row comes before it in the conversation."""
    bare = F.rtrim(F.col("text"), F.lit(WHITE))
    initial = F.substring("role", 1, 1)
    line = rows.withColumn("conv", _key()).withColumn("spread", F.monotonically_increasing_id()).orderBy(
        "conv", *_order(), "spread")
    line = saved(line.select(
        "conv", F.monotonically_increasing_id().alias("rid"), F.coalesce("turn", F.lit(0)).alias("turn"),
        F.col("turn").isNull().alias("timeless"),
        F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3).alias("initial"),
        (bare == "").alias("blank"), (~F.substring(bare, -1, 1).isin(".", "!", "?")).alias("truncated"),
        F.md5(F.concat_ws(":", F.char_length("role"), "role", "text")).alias("said")))
    # the first of its kind is known by its rid, which is unique: no join on a key that one conversation fills
    first = line.filter("not blank").groupBy("conv", "said").agg(F.min("rid").alias("rid"))
    both = line.drop("said").withColumn("first", F.lit(0)).unionByName(first.select(
        "conv", "rid", F.lit(0).cast("long").alias("turn"), F.lit(False).alias("timeless"), F.lit(0).alias("initial"),
        F.lit(False).alias("blank"), F.lit(False).alias("truncated"), F.lit(1).alias("first")))
    return both.repartitionByRange("rid").sortWithinPartitions("rid", "first")


def _runs_of(batches: Iterator[pd.DataFrame], run: int) -> Iterator[pd.DataFrame]:
    """Runs of one conversation's rows inside one sorted partition, with what their counts need."""
    rest = None
    for pdf in batches:
        part = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
        cut = _cuts(part["conv"].to_numpy(), part["first"].to_numpy(), run)
        done = cut[-1] if len(cut) else 0  # the last run may go on
        if done:
            yield _described(part.iloc[:done].reset_index(drop=True), run)
        rest = part.iloc[done:].reset_index(drop=True)
    if rest is not None and len(rest):
        yield _described(rest, run)


def _cuts(conv: np.ndarray, first: np.ndarray, run: int) -> np.ndarray:
    """Starts of runs: where the conversation changes, and every ``run`` rows; never between a row and its marker."""
    start = np.flatnonzero(np.r_[True, conv[1:] != conv[:-1]])
    place = np.arange(len(conv)) - np.repeat(start, np.diff(np.r_[start, len(conv)]))
    many = np.flatnonzero((place > 0) & (place % run == 0))
    many = many - (first[many] == 1)  # a marker follows its row: cut before the row
    return np.unique(np.r_[start, many])


def _described(part: pd.DataFrame, run: int) -> pd.DataFrame:
    starts = _cuts(part["conv"].to_numpy(), part["first"].to_numpy(), run)
    marker = part["first"].to_numpy() == 1
    known = np.r_[marker[1:], False][~marker]
    of = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(part)]))[~marker]
    rows = part[~marker]
    at = np.searchsorted(of, np.arange(len(starts)))
    blank, initial = rows["blank"].to_numpy(bool), rows["initial"].to_numpy(np.int64)
    again = ~blank & ~known
    cut = rows["truncated"].to_numpy(bool) & ~blank & known
    symbol = np.where(blank | again, GONE, initial * 2 + cut + 1).astype(np.uint8)
    ill = np.r_[_illegal(initial[:-1], initial[1:]) & (of[:-1] == of[1:]), False]
    null, turn = rows["timeless"].to_numpy(bool), rows["turn"].to_numpy(np.int64)
    new = np.r_[True, (turn[1:] != turn[:-1]) | null[:-1] | (of[1:] != of[:-1])] & ~null
    add = lambda x: np.add.reduceat(x.astype(np.int64), at)
    size = add(np.ones(len(of)))
    data = symbol.tobytes()
    big = np.int64(1) << 62
    low = np.minimum.reduceat(np.where(null, big, turn), at)
    out = pd.DataFrame({
        "conv": rows["conv"].to_numpy()[at], "rid": rows["rid"].to_numpy()[at],
        "symbols": [data[a:a + n] for a, n in zip(at, size, strict=True)],
        "blank": add(blank), "duplicate": add(again), "truncated": add(cut), "illegal": add(ill), "turns": add(new),
        "head": initial[at], "tail": initial[at + size - 1],
        "low": pd.array(low, "Int64"), "high": pd.array(np.maximum.reduceat(np.where(null, -big, turn), at), "Int64")})
    out.loc[low == big, ["low", "high"]] = pd.NA
    return out


def _illegal(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return ~(((a == 0) & (b == 1)) | ((a == 1) & (b == 2)) | ((a == 2) & (b == 1)))


# ---- matrices: costs [..., from, to], the state in the middle, ranks of the ropes of one row ----

def _ranked(cost: np.ndarray, key: np.ndarray) -> np.ndarray:
    """The place of each reachable entry among those of its row, by ``key``."""
    return np.argsort(np.argsort(np.where(cost < FAR, key, FAR), axis=-1, kind="stable"), axis=-1, kind="stable")


def _first_matrices() -> tuple[np.ndarray, list, np.ndarray]:
    """Costs, edits and ranks of the single rows: inserts that lead to a state, then one edit of the row."""
    cost = np.full((SYMBOLS, 4, 4), FAR, np.int64)
    edits: list = [[[None] * 4 for _ in range(4)] for _ in range(SYMBOLS)]
    for symbol in range(SYMBOLS):
        options = [(s, s, DELETE, "D") for s in range(4)]
        if symbol != GONE:
            role, extra = divmod(symbol - 1, 2)
            extra *= TRUNCATED
            options += [(s, USER, REROLE + extra, "R") for s in NEXT_USER] + [(USER, ASSISTANT, REROLE + extra, "R")]
            options += {0: [(START, SYSTEM, extra, "K")], 1: [(s, USER, extra, "K") for s in NEXT_USER],
                        2: [(USER, ASSISTANT, extra, "K")], 3: []}[role]
        for a in range(4):
            for b, inserts in _INSERTED[a].items():
                for s, to, c, edit in options:
                    new = (INSERT * inserts + c, "I" * inserts + edit)
                    if s == b and (edits[symbol][a][to] is None or new < (cost[symbol, a, to], edits[symbol][a][to])):
                        cost[symbol, a, to], edits[symbol][a][to] = new
    names = sorted({e for m in edits for r in m for e in r if e})
    key = np.array([[[names.index(e) if e else 0 for e in r] for r in m] for m in edits])
    return cost, edits, _ranked(cost, key)


# state -> {state reached by inserts alone: how many}
_INSERTED = [{0: 0, 2: 1, 3: 2}, {1: 0, 2: 1, 3: 2}, {2: 0, 3: 1}, {3: 0, 2: 1}]


def product(ca, ra, cb, rb):
    """Min-plus product of two matrices with ranks: costs, middle states, ranks; ties by the left rank."""
    total = ca[:, :, None] + cb[None, :, :]
    cost = total.min(axis=1)
    mid = np.where(total == cost[:, None, :], ra[:, :, None], 9).argmin(axis=1)
    row = np.arange(4)[:, None]
    key = ra[row, mid] * 4 + rb[mid, np.arange(4)[None, :]]
    cost = np.minimum(cost, FAR)
    return cost, mid, _ranked(cost, key)


class Grammar:
    """Rules of Re-Pair over some sequences, with one matrix a rule."""

    def __init__(self, sequences: list[bytes]):
        cost, self.edits, rank = _first_matrices()
        self.cost, self.rank = list(cost), list(rank)
        self.mid: list = [None] * SYMBOLS
        self.pair: list = [None] * SYMBOLS
        sizes = np.array([len(s) for s in sequences], np.int64)
        line = np.frombuffer(b"".join(sequences), np.uint8).astype(np.int64)
        owner = np.repeat(np.arange(len(sequences)), sizes)
        while len(line) > 1:
            near = owner[1:] == owner[:-1]
            width = len(self.cost)
            codes = (line[:-1] * width + line[1:])[near]
            if not len(codes):
                break
            found, uses = np.unique(codes, return_counts=True)
            if uses.max() < LEAST_USES:
                break
            a, b = divmod(int(found[uses.argmax()]), width)
            hit = np.flatnonzero(near & (line[:-1] == a) & (line[1:] == b))
            if a == b:  # every second place of a run of overlapping hits
                first = np.r_[True, np.diff(hit) > 1]
                place = np.arange(len(hit)) - np.flatnonzero(first)[np.cumsum(first) - 1]
                hit = hit[place % 2 == 0]
            line[hit] = self._rule(a, b)
            keep = np.ones(len(line), bool)
            keep[hit + 1] = False
            line, owner = line[keep], owner[keep]
        bounds = np.searchsorted(owner, np.arange(len(sequences) + 1))
        self.tops = [self._chain(line[a:b].tolist()) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]

    def _rule(self, a: int, b: int) -> int:
        cost, mid, rank = product(self.cost[a], self.rank[a], self.cost[b], self.rank[b])
        self.cost.append(cost)
        self.rank.append(rank)
        self.mid.append(mid)
        self.pair.append((a, b))
        return len(self.cost) - 1

    def _chain(self, symbols: list[int]) -> int:
        """One symbol for what is left of a sequence, halves first, so that ropes stay shallow."""
        if len(symbols) == 1:
            return symbols[0]
        half = len(symbols) // 2
        return self._rule(self._chain(symbols[:half]), self._chain(symbols[half:]))

    def audit(self, symbol: int, start: int, end: int) -> str:
        """The edits of an entry: its rope, from left to right."""
        out, todo = [], [(symbol, start, end)]
        while todo:
            symbol, i, j = todo.pop()
            if self.pair[symbol] is None:
                out.append(self.edits[symbol][i][j])
            else:
                k = int(self.mid[symbol][i, j])
                a, b = self.pair[symbol]
                todo += [(b, k, j), (a, i, k)]
        return "".join(out)


def _last_inserts(end: int) -> tuple[int, str] | None:
    """Cost and edits that lead from a state to one where a conversation may end."""
    ways = [(INSERT * n, "I" * n) for to, n in _INSERTED[end].items() if to in STOP]
    return min(ways) if ways else None


def _best_end(cost: np.ndarray, rank: np.ndarray, start: int = START) -> tuple[int, int, str]:
    """Least cost from ``start`` to an end, the last row's state there, and the inserts after it."""
    ends = []
    for to in range(4):
        more = _last_inserts(to)
        if cost[start, to] < FAR and more:
            ends.append((int(cost[start, to]) + more[0], int(rank[start, to]), to, more[1]))
    total, _, to, inserts = min(ends)
    return total, to, inserts


def _evaluated(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Matrices of distinct sequences: costs and ranks, and the edits from each state to each state.  A sequence that is
    a whole conversation has only the best edits."""
    def made(sequences: list[bytes], whole: list[bool]) -> pd.DataFrame:
        grammar = Grammar(sequences)
        out = []
        for s, top, one in zip(sequences, grammar.tops, whole, strict=True):
            cost, rank = grammar.cost[top], grammar.rank[top]
            if one:
                total, to, inserts = _best_end(cost, rank)
                out.append((s, one, [total], [], [grammar.audit(top, START, to) + inserts]))
            else:
                out.append((s, one, cost.ravel().tolist(), rank.ravel().tolist(), [
                    grammar.audit(top, i, j) if cost[i, j] < FAR else "" for i in range(4) for j in range(4)]))
        return pd.DataFrame(out, columns=["symbols", "whole", "cost", "rank", "edits"])

    sequences, whole, held = [], [], 0
    for pdf in batches:
        for s, one in zip(pdf["symbols"], pdf["whole"], strict=True):
            sequences.append(bytes(s))
            whole.append(bool(one))
            held += len(s)
            if held >= BLOCK:
                yield made(sequences, whole)
                sequences, whole, held = [], [], 0
    if sequences:
        yield made(sequences, whole)


def _joined(pdf: pd.DataFrame) -> pd.DataFrame:
    """The states between the runs of one conversation, from its end back: least cost, then the first run's rank.

    illegal and turns are what two runs that meet add: an illegal pair of roles, a turn that both hold.
    """
    pdf = pdf.sort_values("rid", ignore_index=True)
    costs = [np.array(c).reshape(4, 4) for c in pdf["cost"]]
    ranks = [np.array(r).reshape(4, 4) for r in pdf["rank"]]
    ends = [_last_inserts(s) for s in range(4)]
    ahead = np.array([e[0] if e else FAR for e in ends])
    steps = []
    for cost, rank in zip(costs[::-1], ranks[::-1], strict=True):
        total = np.where(cost < FAR, cost + ahead[None, :], 2 * FAR)
        ahead = total.min(axis=1)
        steps.append(np.where(total == ahead[:, None], rank, 9).argmin(axis=1))
    state, entry = START, []
    for step in steps[::-1]:
        entry.append(state * 4 + int(step[state]))
        state = int(step[state])
    tail = [""] * (len(pdf) - 1) + [ends[state][1]]
    head, last = pdf["head"].to_numpy(np.int64), pdf["tail"].to_numpy(np.int64)
    low, high = pdf["low"].astype("Int64"), pdf["high"].astype("Int64")
    return pd.DataFrame({
        "conv": pdf["conv"], "rid": pdf["rid"], "entry": entry, "inserts": tail, "cost": int(ahead[START]),
        "illegal": np.r_[0, _illegal(last[:-1], head[1:])], "turns": (low == high.shift()).fillna(False).astype(int)})


class _Writer:
    """Digest of one conversation's repaired rows, put together row by row from its edits."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state, self.digest, self.lines = audit, 0, START, hashlib.sha256(), 0

    def _put(self, role: str, text: str) -> None:
        self.digest.update(("\n" * (self.lines > 0) + f"{role}:{text}").encode("utf-8", "surrogatepass"))
        self.lines += 1
        self.state = {"s": SYSTEM, "u": USER, "a": ASSISTANT}[role[0]]

    def _turn(self) -> str:
        return "assistant" if self.state == USER else "user"

    def inserts(self) -> None:
        while self.audit[self.at:self.at + 1] == "I":
            self._put(self._turn(), "")
            self.at += 1

    def row(self, role: str, text: str) -> None:
        self.inserts()
        edit = self.audit[self.at]
        self.at += 1
        if edit != "D":
            self._put(role if edit == "K" else self._turn(), text)

    def end(self) -> str:
        self.inserts()
        return self.digest.hexdigest()


def _repaired(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The digest of every conversation's repaired rows; a row with the edits (kind 0) comes before its rows."""
    conv, writer = None, None
    for pdf in batches:
        out = []
        for c, kind, audit, role, text in zip(pdf["conv"], pdf["kind"], pdf["audit"], pdf["role"], pdf["text"], strict=True):
            if kind:
                writer.row(role, text)
                continue
            if writer:
                out.append((conv, writer.end()))
            conv, writer = c, _Writer(audit)
        yield pd.DataFrame(out, columns=["conv", "repaired_sha256"])
    if writer:
        yield pd.DataFrame([(conv, writer.end())], columns=["conv", "repaired_sha256"])


_RUNS = ("conv string, rid long, symbols binary, blank long, duplicate long, truncated long, illegal long, turns long, "
         "head long, tail long, low long, high long")


def audits(rows: DataFrame, run: int = RUN) -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated, illegal, cost, audit) of every conversation that has rows."""
    spark = rows.sparkSession
    runs = saved(_marked(rows).mapInPandas(partial(_runs_of, run=run), _RUNS))
    several = runs.groupBy("conv").agg(F.count("*").alias("n")).filter("n > 1").select("conv", F.lit(False).alias("whole"))
    runs = saved(runs.join(several, "conv", "left").withColumn("whole", F.coalesce("whole", F.lit(True))))
    solved = saved(runs.select("symbols", "whole").distinct().repartition(
        int(spark.conf.get("spark.sql.shuffle.partitions")), "symbols").mapInPandas(
        _evaluated, "symbols binary, whole boolean, cost array<long>, rank array<long>, edits array<string>"))
    faults = ["blank", "duplicate", "truncated"]
    gap = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0))
    one = runs.filter("whole").join(solved.filter("whole").select("symbols", "cost", "edits"), "symbols").select(
        "conv", gap.alias("gaps"), *faults, "illegal", F.col("cost")[0].alias("cost"), F.col("edits")[0].alias("audit"))

    parts = runs.filter("not whole")
    tables = solved.filter("not whole").drop("whole")
    way = parts.select("conv", "rid", "symbols", "head", "tail", "low", "high").join(
        tables.select("symbols", "cost", "rank"), "symbols").groupBy("conv").applyInPandas(
        _joined, "conv string, rid long, entry int, inserts string, cost long, illegal long, turns long")
    edits = parts.join(way.select("rid", "entry", "inserts", F.col("cost").alias("total"), F.col("illegal").alias("more"),
                                  F.col("turns").alias("same")), "rid").join(tables.select("symbols", "edits"), "symbols")
    text = F.concat(F.expr("edits[entry]"), "inserts")
    long = edits.groupBy("conv").agg(
        *[F.sum(c).alias(c) for c in (*faults, "illegal", "turns", "more", "same")], F.min("low").alias("low"),
        F.max("high").alias("high"), F.min("total").alias("cost"),
        F.array_sort(F.collect_list(F.struct("rid", text.alias("text")))).alias("parts"))
    long = long.withColumn("turns", F.col("turns") - F.col("same"))
    return one.unionByName(long.select(
        "conv", gap.alias("gaps"), *faults, (F.col("illegal") + F.col("more")).alias("illegal"), "cost",
        F.array_join(F.transform("parts", lambda p: p["text"]), "").alias("audit")))


def repair(rows: DataFrame, conversations: DataFrame, run: int = RUN) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256 of every
    conversation of ``conversations``, whose rows are ``rows`` (conv_id, turn, role, text).

    Defined results: a conversation without rows has zeros, no edits and the digest of nothing; rows with equal
    turns are in the order of role and text, and repeated rows are duplicates; a null conv_id is a
    conversation of its own; null turns come first and count in no gap; null roles and texts are one
    space; an empty table gives an empty result.  Other columns are not read.
    """
    space = F.lit(" ")
    rows = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", space).alias("role"),
                       F.coalesce("text", space).alias("text"))
    known = saved(audits(rows, run))
    told = known.select("conv", F.lit(0).alias("kind"), "audit", F.lit(None).cast("long").alias("turn"),
                        F.lit("").alias("role"), F.lit("").alias("text"))
    said = rows.select(_key().alias("conv"), F.lit(1).alias("kind"), F.lit("").alias("audit"), "turn", "role", "text")
    line = told.unionByName(said).repartition("conv").sortWithinPartitions("conv", "kind", *_order())
    digests = line.select("conv", "kind", "audit", "role", "text").mapInPandas(
        _repaired, "conv string, repaired_sha256 string")
    names = conversations.select("conv_id").distinct().withColumn("conv", _key())
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in (
        "gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return names.join(known, "conv", "left").join(digests, "conv", "left").select(
        "conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
