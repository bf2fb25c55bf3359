"""Approximate nearest neighbours by a permutation index.

A vector is represented by the order in which it sees ``PIVOTS`` pivot vectors, nearest
first.  Pivots are distinct and apart from each other, so that copies and near copies of one
vector, however many, are one pivot.  It is posted under its ``POSTED`` nearest pivots, in the inverted file of each.  A
query reads the files of its own ``POSTED`` nearest pivots, ranks what it finds there by
the footrule distance of the two orders (places beyond ``PREFIX`` count as ``PREFIX``), and
compares the best of them with the original vectors by exact cosine.

The index lies in blocks of about ``BLOCK`` vectors, each with its inverted files; every
query visits every block and takes from each the best ``DEPTH`` share of the block's rows by
footrule (``LEAST`` at least), so the number that is compared grows with the data.
Blocks are dealt by a hash of the id and the row: copies of one vector, and rows of one id, spread
over all of them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sensortracks.llm.common import saved

PIVOTS = 256
POSTED = 16
PREFIX = 128
BLOCK = 4096
QUERIES = 4096
DEPTH = 0.1
LEAST = 64
TOP = 5
DRAWN = 16  # vectors that are looked at for each pivot
APART = (0.9, 0.99, 0.999, 1 - 1e-9)  # cosines that pivots stay under, as long as there are enough


def usable(vectors: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """(vec_id, v): rows with an id and a vector without null or non-finite components that is not zero."""
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    ok = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    some = F.exists(v, lambda x: x != 0)
    return vectors.select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("v")).filter(
        F.col("vec_id").isNotNull() & F.col("v").isNotNull() & ok & some)


def places(x: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """Place of every pivot in the order of each row of unit vectors, nearest first, at most ``prefix``."""
    order = np.argsort(-(x @ pivots.T), axis=1, kind="stable")
    out = np.empty(order.shape, np.int16)
    np.put_along_axis(out, order, np.minimum(np.arange(order.shape[1]), prefix).astype(np.int16)[None, :], axis=1)
    return out


def _matrix(vectors) -> tuple[np.ndarray, np.ndarray]:
    x = np.array([np.asarray(v, float) for v in vectors])
    return x, np.sqrt((x * x).sum(1))


def pivots_apart(x: np.ndarray, n: int) -> np.ndarray:
    """At most ``n`` of the unit vectors, in their order, each under a cosine of APART to all others."""
    chosen = np.zeros(len(x), bool)
    near = np.full(len(x), -np.inf)
    for most in APART:
        for i in range(len(x)):
            if chosen.sum() == n:
                return x[chosen]
            if near[i] < most:
                chosen[i] = True
                near = np.maximum(near, x @ x[i])
    return x[chosen]


def search_block(ids: np.ndarray, vectors, query_ids: np.ndarray, query_vectors, pivots: np.ndarray, top: int = TOP,
                 posted: int = POSTED, prefix: int = PREFIX, depth: float = DEPTH, least: int = LEAST) -> pd.DataFrame:
    """The ``top`` rows of one block for each query: query_id, vec_id, score."""
    order = np.argsort(ids, kind="stable")  # equal distances go to the smaller id
    ids = ids[order]
    x, norms = _matrix([vectors[i] for i in order])
    q, q_norms = _matrix(query_vectors)
    posted, prefix = min(posted, len(pivots)), min(prefix, len(pivots))
    rank, q_rank = (places(a / n[:, None], pivots, prefix) for a, n in ((x, norms), (q, q_norms)))
    files = [np.flatnonzero(rank[:, p] < posted) for p in range(len(pivots))]
    want = max(least, math.ceil(depth * len(ids)))
    out = []
    for i, own in enumerate(query_ids):
        found = np.zeros(len(ids), bool)
        for p in np.flatnonzero(q_rank[i] < posted):
            found[files[p]] = True
        found[ids == own] = False
        rows = np.flatnonzero(found)
        if len(rows) < top:  # too few share a file: the whole block is ranked
            rows = np.flatnonzero(ids != own)
        if len(rows) > want:
            apart = np.abs(rank[rows] - q_rank[i]).sum(1, dtype=np.int32)
            rows = rows[np.argsort(apart, kind="stable")[:want]]
        score = (x[rows] * q[i]).sum(1) / (norms[rows] * q_norms[i])
        best = np.argsort(-score, kind="stable") if len(rows) <= top else np.lexsort((ids[rows], -score))[:top]
        out.append(pd.DataFrame({"query_id": own, "vec_id": ids[rows[best]], "score": score[best]}))
    return pd.concat(out, ignore_index=True) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})


def dealt(rows: DataFrame, blocks: int) -> DataFrame:
    """``rows`` (with the number of the row) and the block of each."""
    return rows.withColumn("block", F.pmod(F.xxhash64("vec_id", "row"), F.lit(blocks)).cast("int"))


def nearest(vectors: DataFrame, is_query, top: int = TOP, vec_id: str = "vec_id", vector: str = "embedding",
            n_pivots: int = PIVOTS) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``top`` nearest found of each query, ties to the smaller id.

    The pivots are at most ``n_pivots`` of a sample of the distinct vectors by a hash of the vector.
    Defined results: unusable vectors (null, zero, with null or non-finite
    components, without id, of another length than the most) take no part; a
    repeated query id is one query; rows with the query's own id are not its neighbours; an
    empty table, or one without queries, gives an empty result.
    """
    rows = saved(usable(vectors, vec_id, vector).withColumn("row", F.monotonically_increasing_id()))
    size = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    schema = "query_id long, vec_id long, score double"
    if size is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = rows.filter(F.size("v") == size["d"])
    sample = rows.select("v").distinct().orderBy(F.xxhash64("v"), "v").limit(DRAWN * n_pivots).toPandas()
    drawn, norms = _matrix(sample["v"])
    pivots = vectors.sparkSession.sparkContext.broadcast(pivots_apart(drawn / norms[:, None], n_pivots))
    blocks = max(1, math.ceil(size["count"] / BLOCK))
    queries = rows.filter(is_query(F.col("vec_id"))).dropDuplicates(["vec_id"])
    parts = max(1, math.ceil(queries.count() / QUERIES))

    def cell(key, data: Iterator[pd.DataFrame] | pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(data) or not len(asked):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        return search_block(data["vec_id"].to_numpy(), data["v"].tolist(), asked["vec_id"].to_numpy(),
                            asked["v"].tolist(), pivots.value, top)

    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    data = dealt(rows, blocks).withColumn("part", numbers(parts))
    asked = queries.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int")).withColumn(
        "block", numbers(blocks))
    found = data.groupBy("block", "part").cogroup(asked.groupBy("block", "part")).applyInPandas(cell, schema)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order).cast("int")).filter(F.col("rank") <= top).select(
        "query_id", "rank", "vec_id", "score")
