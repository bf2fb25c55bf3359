"""Near-duplicate documents by an LSH forest over MinHash signatures.

A document's set is its distinct shingles of five words.  Documents with equal sets
are one class and link at once; everything else works on one row a class.

A signature of ``TREES`` x ``STRIDE`` MinHash values is read in ``TREES`` orders; order
t starts at value ``STRIDE`` * t and is ``DEPTH`` values long.  Sorting the classes by an order
lays a prefix tree out in a line: a row's neighbours are the rows with the longest
common prefix.  Each row is paired with the next ``REACH`` rows that share at
least ``LEAST`` values, so the depth adapts to the region: few values where documents are
sparse, many where they are dense, and the pairs grow with the rows, not with the
square of a group.  The line is range-partitioned, so a dense region is split too;
the rows next to a partition's ends are paired in a second, small step.

Pairs whose signatures agree in less than half of their values are dropped (links
agree in three quarters, 5.7 standard deviations more).  All others are confirmed on
full sets: 100 * common >= 75 * union.  Confirmation goes in two rounds: each class's
likeliest pair to a smaller and to a larger class, then every pair that still joins two components; a
pair inside a component cannot change the result.

Where more rows than a row meets share ``LEAST`` values (a crowded run), each row is paired with the next
one only, and links may lie outside these pairs: a template's copies that link to the template only.  The rows of
crowded runs that lie in more than one component go through an exact join, which has no cap:
two sets with a link share one of their rarest quarter of shingles.  Shingles in up to
``FEW`` of these rarest quarters are joined pair by pair, with the length and position filters;
sets that are tied by more frequent ones form clusters, compared block by block in full.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sensortracks.llm.common import free_name, runs, saved
from sensortracks.operators.graph import connected_components

WORDS = 5
PERCENT = 75
TREES, STRIDE, DEPTH = 24, 4, 8
LEAST, REACH = 3, 3
CHUNK_BYTES = 1 << 19
FEW, CELL_ITEMS, CELL_ROWS, COLUMNS = 32, 1 << 18, 1024, 2048
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_ODD = np.random.RandomState(20262).randint(0, 1 << 62, 512, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE = _ODD[:256]
_PLACE = _ODD[256:256 + WORDS]
_HASH = _ODD[300:300 + TREES * STRIDE]
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_POWERS: list = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
_BASE = 0x9E3779B97F4A7C15


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2**64."""
    if len(_POWERS[0]) < n:
        size = max(n, 1 << 20)
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[k] = np.cumprod(steps)
    return _POWERS[0][:n], _POWERS[1][:n]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's shingles; a text without words has none.

    A text of fewer than five words has one shingle, all of its words.
    """
    data = [(t or "").encode("utf-8", "surrogatepass").translate(LOWER) for t in texts]
    joined = np.frombuffer(b" ".join(data) + b" ", np.uint8)
    blank = _BLANK[joined]
    starts = np.flatnonzero(~blank & np.r_[True, blank[:-1]])
    ends = np.flatnonzero(blank & np.r_[False, ~blank[:-1]])
    up, down = _powers(len(joined) + 1)
    sums = np.zeros(len(joined) + 1, np.uint64)
    np.cumsum(_BYTE[joined] * up[:-1], out=sums[1:])
    words = _mix((sums[ends] - sums[starts]) * down[starts])
    sizes = np.array([len(d) + 1 for d in data])
    bounds = np.searchsorted(starts, np.r_[0, np.cumsum(sizes)])
    n = len(words) - WORDS + 1
    rolled = np.zeros(max(n, 0), np.uint64)
    for j in range(WORDS):
        rolled += words[j:j + len(rolled)] * _PLACE[j]
    rolled = _mix(rolled)
    out = []
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if b - a >= WORDS:
            out.append(np.unique(rolled[a:b - WORDS + 1]))
        elif b > a:
            few = words[a:b] * _PLACE[:b - a]
            out.append(_mix(np.array([few.sum() + np.uint64(b - a)], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """A row of 32-bit MinHash values for each set; every set must have an element."""
    joined = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    out = np.empty((len(sets), len(_HASH)), ">u4")
    for k, odd in enumerate(_HASH):
        out[:, k] = np.minimum.reduceat(((joined * odd) >> np.uint64(32)).astype(np.uint32), starts)
    return out


def _described(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        texts = pdf.pop("text").tolist()
        for a, b in runs([len(t or "") for t in texts], CHUNK_BYTES):
            sets = shingle_sets(texts[a:b])
            full = [s for s in sets if len(s)]
            sigs = iter(signatures(full)) if full else iter(())
            yield pdf.iloc[a:b].assign(
                n_shingles=[len(s) for s in sets],
                set_id=[hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets],
                sig=[next(sigs).tobytes() if len(s) else None for s in sets])


def _orders(classes: DataFrame) -> DataFrame:
    """(tree, key, node): the signature of every class in every order."""
    wide = F.concat("sig", F.substring("sig", 1, 4 * DEPTH))
    keys = F.array(*[F.struct(F.lit(t).alias("tree"), wide.substr(F.lit(4 * STRIDE * t + 1), F.lit(4 * DEPTH)).alias("key"))
                     for t in range(TREES)])
    return classes.select("node", F.explode(keys).alias("k")).select("k.tree", "k.key", "node")


def _pairs(tree: np.ndarray, key: np.ndarray, node: np.ndarray) -> pd.DataFrame:
    """Pairs of sorted rows at most REACH apart that share at least LEAST values.

    A row of a crowded run meets its next row only: links that this misses are
    found by the exact join of such runs, so more pairs here would be work twice.
    """
    a, b = [], []
    crowd = np.zeros(len(node), bool)
    crowd[_crowd_rows(tree, key)] = True
    for lag in range(1, REACH + 1):
        same = (key[:-lag, :LEAST] == key[lag:, :LEAST]).all(1) & (tree[:-lag] == tree[lag:])
        if lag > 1:
            same &= ~(crowd[:-lag] & crowd[lag:])
        a.append(node[:-lag][same])
        b.append(node[lag:][same])
    a, b = np.concatenate(a), np.concatenate(b)
    return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)})


def _crowd_rows(tree: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Places of the rows in runs of more than REACH + 1 sorted rows that share at least LEAST values."""
    far = REACH + 1
    same = (key[:-far, :LEAST] == key[far:, :LEAST]).all(1) & (tree[:-far] == tree[far:])
    return np.unique(np.flatnonzero(same)[:, None] + np.arange(far + 1))


def _crowded(tree: np.ndarray, key: np.ndarray, node: np.ndarray) -> pd.DataFrame:
    """Rows of crowded runs, with the shared values."""
    i = _crowd_rows(tree, key)
    return pd.DataFrame({"a": node[i], "b": node[i], "tree": tree[i], "key": [k.tobytes() for k in key[i, :LEAST]]})


def _neighbours(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pairs (kind 0) and crowded rows (kind 2) of one sorted partition; its first and last rows also leave (kind 1)."""
    rest = None
    first = True

    def ends(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.assign(a=pdf["node"], b=pdf["node"], kind=1)[["a", "b", "tree", "key", "kind"]]

    for pdf in batches:
        pdf = pdf.reset_index(drop=True)
        if first and len(pdf):
            yield ends(pdf.head(REACH + 1))
            first = False
        part = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
        key = np.frombuffer(b"".join(part["key"]), ">u4").reshape(len(part), -1)
        line = part["tree"].to_numpy(), key, part["node"].to_numpy()
        yield _pairs(*line).drop_duplicates().assign(tree=-1, key=None, kind=0)
        yield _crowded(*line).assign(kind=2)
        rest = part.tail(REACH + 1)
    if rest is not None:
        yield ends(rest)


def _across(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    pdf = pd.concat(list(batches), ignore_index=True)
    if len(pdf):
        key = np.frombuffer(b"".join(pdf["key"]), ">u4").reshape(len(pdf), -1)
        line = pdf["tree"].to_numpy(), key, pdf["node"].to_numpy()
        yield _pairs(*line).assign(tree=-1, key=None, kind=0)
        yield _crowded(*line).assign(kind=2)


def candidates(classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs and crowded runs: (a, b, agree), distinct pairs of classes with the share of their signatures that
    agrees, at least half; (run, node), the classes of every run with more rows than a row meets."""
    line = _orders(classes).repartitionByRange("tree", "key", "node").sortWithinPartitions("tree", "key", "node")
    schema = "a long, b long, tree int, key binary, kind int"
    found = saved(line.mapInPandas(_neighbours, schema))
    # a few rows a partition, in one sorted line: pairs over the borders (pairs found twice do no harm)
    border = found.filter("kind = 1").select("tree", "key", F.col("a").alias("node")).distinct()
    border = border.coalesce(1).sortWithinPartitions("tree", "key", "node").mapInPandas(_across, schema)
    found = found.filter("kind <> 1").unionByName(saved(border))
    pairs = found.filter("kind = 0 and a <> b").select("a", "b").distinct()
    crowds = found.filter("kind = 2").select(F.xxhash64("tree", "key").alias("run"), F.col("a").alias("node"))

    @F.pandas_udf("double")
    def agree(x: pd.Series, y: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype=float)
        x, y = (np.frombuffer(b"".join(s), ">u4").reshape(len(s), -1) for s in (x, y))
        return pd.Series((x == y).mean(1))

    sig = classes.select("node", "sig")
    both = (pairs.join(sig.withColumnsRenamed({"node": "a", "sig": "sa"}), "a")
            .join(sig.withColumnsRenamed({"node": "b", "sig": "sb"}), "b"))
    return both.select("a", "b", agree("sa", "sb").alias("agree")).filter("agree >= 0.5"), crowds


def _linked(x: pd.Series, y: pd.Series) -> pd.Series:
    out = []
    seen: dict[str, np.ndarray] = {}
    for s, t in zip(x, y, strict=True):
        for text in (s, t):
            if text not in seen:
                if len(seen) > 500:
                    seen.clear()
                seen[text] = shingle_sets([text])[0]
        a = seen[s] if s in seen else shingle_sets([s])[0]
        b = seen[t]
        common = len(np.intersect1d(a, b, assume_unique=True))
        out.append(100 * common >= PERCENT * (len(a) + len(b) - common))
    return pd.Series(out, dtype=bool)


def confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs whose full shingle sets are similar enough; ``texts`` is (node, text)."""
    both = (pairs.select("a", "b").join(texts.withColumnsRenamed({"node": "a", "text": "ta"}), "a")
            .join(texts.withColumnsRenamed({"node": "b", "text": "tb"}), "b"))
    return both.filter(F.pandas_udf(_linked, "boolean")("ta", "tb")).select("a", "b")


def _sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        texts = pdf["text"].tolist()
        for a, b in runs([len(t or "") for t in texts], CHUNK_BYTES):
            sets = shingle_sets(texts[a:b])
            yield pd.DataFrame({"node": pdf["node"].iloc[a:b].to_numpy(), "size": [len(s) for s in sets],
                                "shingles": [s.view(np.int64) for s in sets]})


def _linking(pdf: pd.DataFrame) -> pd.DataFrame:
    """Links that join different labels, between two blocks of sets or inside one; as many as joins need."""
    first = pdf["block"].to_numpy() == pdf["i"].iloc[0]
    if first.all() or not first.any():
        left = right = np.arange(len(pdf))
    else:
        left, right = np.flatnonzero(first), np.flatnonzero(~first)
    node, size, label = (pdf[c].to_numpy() for c in ("node", "size", "label"))
    out = []
    if (label != label[0]).any():
        row = np.repeat(np.arange(len(pdf)), size)
        _, word, count = np.unique(np.concatenate(pdf["shingles"].tolist()), return_inverse=True, return_counts=True)
        often = count > 1
        row, word = row[often[word]], (np.cumsum(often) - 1)[word[often[word]]]
        order = np.argsort(word, kind="stable")
        row, word = row[order], word[order]
        common = np.zeros((len(left), len(right)), np.float32)
        for at in range(0, int(often.sum()), COLUMNS):
            a, b = np.searchsorted(word, [at, at + COLUMNS])
            has = np.zeros((len(pdf), COLUMNS), np.float32)
            has[row[a:b], word[a:b] - at] = 1
            common += has[left] @ has[right].T
        label = label.copy()
        for k, x in enumerate(left):
            n = common[k].astype(np.int64)
            near = right[100 * n >= PERCENT * (size[x] + size[right] - n)]
            near = near[label[near] != label[x]]
            if len(near):
                others, at = np.unique(label[near], return_index=True)
                out += [(node[x], node[y]) for y in near[at]]
                label[np.isin(label, others)] = label[x]
    return pd.DataFrame(out, columns=["a", "b"], dtype="int64")


def crowd_links(crowds: DataFrame, labels: DataFrame, texts: DataFrame) -> DataFrame | None:
    """(a, b): links that join different ``labels`` of classes in a crowded run, enough to join all that are
    linked; None if no run has two labels.

    Two sets with a link share a shingle among the first ``size - ceil(0.75 * size) + 1`` of each, in any one order of
    all shingles; the order is by the number of sets.  Every pair that shares one is compared in full.
    """
    at = saved(crowds.distinct().join(labels, "node", "left").select("run", "node", F.coalesce("label", "node").alias("label")))
    mixed = saved(at.groupBy("run").agg(F.min("label").alias("x"), F.max("label").alias("y")).filter("x < y").select("run"))
    if mixed.isEmpty():
        return None
    active = saved(at.join(mixed, "run").select("node", "label").distinct())
    sets = saved(texts.join(active, "node").select("node", "text").mapInPandas(
        _sets, "node long, size long, shingles array<long>").join(active, "node"))
    items = sets.select("node", "label", "size", F.explode("shingles").alias("w"))
    counts = saved(items.groupBy("w").agg(F.count("*").alias("n")).filter("n > 1"))
    ranked = items.join(counts, "w", "left").withColumn("place", F.row_number().over(
        Window.partitionBy("node").orderBy(F.coalesce("n", F.lit(1)), "w")))
    early = saved(ranked.filter("n > 1 and place <= size - (3 * size + 3) div 4 + 1").select(
        "w", "node", "label", "size", (F.col("size") - F.col("place") + 1).alias("left")))
    words = saved(early.groupBy("w").agg(F.count("*").alias("n"), F.min("label").alias("x"), F.max("label").alias("y"),
                                         F.min("node").alias("least")).filter("x < y").select("w", "n", "least"))

    side = saved(early.join(words.filter(F.col("n") <= FEW).select("w"), "w"))
    x, y = (side.select("w", *[F.col(c).alias(f"{c}_{e}") for c in ("node", "label", "size", "left")]) for e in "ab")
    pairs = x.join(y, "w").filter(
        "node_a < node_b and label_a <> label_b and 4 * least(size_a, size_b) >= 3 * greatest(size_a, size_b) "
        "and 7 * least(left_a, left_b) >= 3 * (size_a + size_b)")
    pairs = saved(pairs.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct())
    full = sets.select("node", "shingles")
    both = (pairs.join(full.withColumnsRenamed({"node": "a", "shingles": "sa"}), "a")
            .join(full.withColumnsRenamed({"node": "b", "shingles": "sb"}), "b")
            .withColumn("n", F.size(F.array_intersect("sa", "sb"))))
    links = both.filter(100 * F.col("n") >= PERCENT * (F.size("sa") + F.size("sb") - F.col("n"))).select("a", "b")

    tied = saved(early.join(words.filter(F.col("n") > FEW).select("w", "least"), "w").select("node", "least").distinct())
    if not tied.isEmpty():
        rows = saved(sets.join(connected_components(tied, "node", "least").withColumnRenamed("label", "cluster"), "node"))
        blocks = saved(rows.groupBy("cluster").agg(
            F.ceil(F.greatest(F.sum("size") / CELL_ITEMS, F.count("*") / CELL_ROWS)).cast("int").alias("blocks"),
            F.min("label").alias("x"), F.max("label").alias("y")).filter("x < y").select("cluster", "blocks"))
        rows = rows.join(F.broadcast(blocks), "cluster").withColumn(
            "block", F.pmod(F.xxhash64("node"), "blocks").cast("int")).withColumn(
            "other", F.explode(F.expr("sequence(0, blocks - 1)")))
        rows = rows.select("cluster", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block",
                           "node", "label", "size", "shingles")
        links = links.unionByName(rows.groupBy("cluster", "i", "j").applyInPandas(_linking, "a long, b long"))
    return saved(links)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, n_shingles, component_id, kept, first_row) of every row of ``docs``.

    component_id is the smallest doc_id reachable over links, the document's own
    included; kept says that it is this document; first_row marks exactly one row of
    each component (the first with the smallest doc_id).  text_key (md5 of the text)
    names the text.  Defined results: documents without words are linked with
    nothing; null ids take part and count as larger than any other; equal texts are
    equal sets; an empty table gives an empty result.
    """
    key = F.md5(F.coalesce(F.col("text"), F.lit("")))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    described = saved(rows.select("doc_id", "text", key.alias("text_key"), F.monotonically_increasing_id().alias("rid"))
                      .mapInPandas(_described, "doc_id long, text_key string, rid long, n_shingles long, "
                                               "set_id binary, sig binary"))
    full = described.filter("set_id is not null")
    groups = saved(full.groupBy("set_id").agg(F.min("rid").alias("node"), F.min("doc_id").alias("least_doc")))
    classes = saved(full.join(groups.select("node"), full["rid"] == F.col("node"))
                    .select("node", "doc_id", "text_key", "sig"))
    pairs, crowds = candidates(classes)
    pairs = saved(pairs)

    # texts of the classes that are in a pair or a crowded run, one row a class
    needed = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).unionByName(
        crowds.select("node")).distinct().join(classes, "node")
    needed = needed.select("node", F.col("doc_id").alias("_d"), F.col("text_key").alias("_k"))
    texts = saved(_texts_of(rows, needed, key))

    likely = F.struct("agree", F.xxhash64("a", "b"))
    above = pairs.groupBy("a").agg(F.max_by("b", likely).alias("b"))
    below = pairs.groupBy("b").agg(F.max_by("a", likely).alias("a"))
    first = saved(above.unionByName(below).distinct())
    links = saved(confirmed(first, texts))
    labels = connected_components(links, "a", "b")
    left = pairs.select("a", "b").join(first, ["a", "b"], "left_anti")
    for end in ("a", "b"):
        left = left.join(labels.withColumnsRenamed({"node": end, "label": f"l{end}"}), end, "left").withColumn(
            f"l{end}", F.coalesce(f"l{end}", end))
    more = saved(confirmed(left.filter("la <> lb"), texts))
    labels = connected_components(links.unionByName(more), "a", "b")
    rest = crowd_links(crowds, labels, texts)
    if rest is not None:
        labels = connected_components(labels.select(F.col("node").alias("a"), F.col("label").alias("b")).unionByName(rest),
                                      "a", "b")

    at = saved(groups.join(labels, "node", "left").select(
        "set_id", F.coalesce("label", "node").alias("component"), "least_doc"))
    # saved, so that the join below has two plain sides and a large component can be split
    least = saved(at.groupBy("component").agg(F.min("least_doc").alias("component_id")))
    at = at.join(least, "component").select("set_id", "component", F.col("component_id"))
    out = described.drop("sig").join(at, "set_id", "left")
    alone = F.col("set_id").isNull()
    out = saved(out.select("doc_id", "text_key", "n_shingles", "rid", F.when(alone, F.col("doc_id")).otherwise(
        F.col("component_id")).alias("component_id"), F.when(alone, -1 - F.col("rid")).otherwise(
        F.col("component")).alias("component")))
    chosen = out.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "rid")).alias("c"))
    chosen = chosen.select(F.col("c.rid").alias("rid"), F.lit(True).alias("first_row"))
    return out.join(chosen, "rid", "left").select(
        "doc_id", "text_key", "n_shingles", "component_id",
        F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"),
        F.coalesce("first_row", F.lit(False)).alias("first_row"))


def _texts_of(rows: DataFrame, needed: DataFrame, key) -> DataFrame:
    """(node, text): the text of every needed class, found by document id and text; once, if rows repeat."""
    found = rows.withColumn("_k", key).withColumn("_d", F.coalesce("doc_id", F.lit(-1))).drop("doc_id")
    found = found.join(needed.withColumn("_d", F.coalesce("_d", F.lit(-1))), ["_d", "_k"])
    once = Window.partitionBy("_d", "_k", "node").orderBy("node")
    return found.withColumn("_n", F.row_number().over(once)).filter("_n = 1").select("node", "text")


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are the first of their group, with all their columns.

    Defined results: null, empty and blank texts are linked with nothing and stay, once per
    document id and text; of repeated rows one stays; an empty table gives an empty result.
    """
    kd, kt, kn = (free_name(docs, x) for x in ("_kd", "_kt", "_kn"))
    dropped = near_duplicates(docs)
    key = F.md5(F.coalesce(F.col("text"), F.lit("")))
    keep = dropped.filter("first_row").select(
        F.coalesce("doc_id", F.lit(-1)).alias(kd), F.col("text_key").alias(kt)).distinct()
    rows = docs.withColumn(kd, F.coalesce(F.col("doc_id").cast("long"), F.lit(-1))).withColumn(kt, key)
    once = Window.partitionBy(kd, kt).orderBy(kd)
    return rows.join(keep, [kd, kt], "left_semi").withColumn(kn, F.row_number().over(once)).filter(
        F.col(kn) == 1).select(*docs.columns)
