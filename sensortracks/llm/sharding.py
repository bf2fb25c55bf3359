"""Uniform shuffle into shards of exact sizes (DataFrame functions only).

Method: a communication matrix says how many rows each input partition sends to
each shard.  Its rows are exact multivariate hypergeometric draws, so permuting
locally, sending by the matrix and permuting again inside each shard gives every
assignment with these shard sizes the same chance.

The matrix is drawn down a tree of partitions with ``FAN`` children a node: a node
knows how many of its rows go to each shard and splits that vector over its
children.  No task ever sees more than ``FAN`` counts, and there are
log(partitions) levels.  A single hypergeometric draw inverts the distribution
function, summed outwards from the mode until what is left is below the precision
of a double.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sensortracks.llm.common import saved

FAN = 16
BUCKET_ROWS = 4096


def _uniform(*parts: Column) -> Column:
    """A double in [0, 1) from a hash of the parts."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") / F.lit(float(1 << 53))


def hypergeometric(total: Column, marked: Column, drawn: Column, u: Column) -> Column:
    """How many of ``drawn`` of ``total`` items are among the ``marked`` ones; u is uniform in [0, 1)."""
    d = lambda c: c.cast("double")
    low = F.greatest(F.lit(0).cast("long"), drawn + marked - total)
    high = F.least(drawn, marked)
    mode = F.least(high, F.greatest(low, F.floor(
        (d(drawn) + 1) * (d(marked) + 1) / (d(total) + 2)).cast("long")))
    spread = F.sqrt(d(drawn) * d(marked) / F.greatest(d(total), F.lit(1.0)))
    reach = F.ceil(14 * spread).cast("long") + 60
    # weights relative to the mode; step: 0, 1, .. upwards, then -1, -2, .. downwards
    steps = F.concat(F.sequence(F.lit(0).cast("long"), F.least(high - mode, reach)),
                     F.when(mode > low, F.sequence(F.lit(-1).cast("long"), -F.least(mode - low, reach)))
                     .otherwise(F.array().cast("array<bigint>")))
    one = F.lit(1.0)

    def weight(last: Column, k: Column) -> Column:
        x = d(mode + k)
        up = (d(marked) - x + 1) * (d(drawn) - x + 1) / (x * (d(total) - d(marked) - d(drawn) + x))
        y = x + 1
        down = y * (d(total) - d(marked) - d(drawn) + y) / ((d(marked) - y + 1) * (d(drawn) - y + 1))
        return F.when(k == 0, one).when(k > 0, last * up).when(k == -1, down).otherwise(last * down)

    whole = F.aggregate(
        steps, F.struct(F.lit(0.0).alias("w"), F.lit(0.0).alias("sum")),
        lambda a, k: F.transform(F.array(weight(a["w"], k)), lambda w: F.struct(
            w.alias("w"), (a["sum"] + w).alias("sum")))[0],
        lambda a: a["sum"])
    found = F.aggregate(
        steps, F.struct(F.lit(0.0).alias("w"), (u * whole).alias("left"), F.lit(None).cast("long").alias("x")),
        lambda a, k: F.transform(F.array(weight(a["w"], k)), lambda w: F.struct(
            w.alias("w"), (a["left"] - w).alias("left"),
            F.coalesce(a["x"], F.when(a["left"] < w, mode + k)).alias("x")))[0],
        lambda a: F.coalesce(a["x"], mode))
    return F.when(low >= high, low).otherwise(found)


def _split(parent: DataFrame, children: DataFrame, level: int, seed: int) -> DataFrame:
    """(node, vec) of one level down: each parent's vector dealt over its children."""
    kids = children.groupBy(F.shiftright("node", int(math.log2(FAN))).alias("parent")).agg(
        F.sort_array(F.collect_list(F.struct("node", "n"))).alias("kids"))
    rows = parent.withColumnRenamed("node", "parent").join(kids, "parent")

    def child(acc: Column, kid: Column) -> Column:
        rest = acc["rest"]

        def shard(a: Column, s: Column) -> Column:
            have = F.get(rest, s)
            got = hypergeometric(a["total"], have, a["need"],
                                 _uniform(F.lit(seed), F.lit(level), kid["node"], s))
            return F.transform(F.array(got), lambda x: F.struct(
                (a["total"] - have).alias("total"), (a["need"] - x).alias("need"),
                F.concat(a["vec"], F.array(x)).alias("vec")))[0]

        dealt = F.aggregate(
            F.sequence(F.lit(0), F.size(rest) - 1),
            F.struct(F.aggregate(rest, F.lit(0).cast("long"), lambda x, y: x + y).alias("total"),
                     kid["n"].alias("need"), F.array().cast("array<bigint>").alias("vec")),
            shard, lambda a: a["vec"])
        return F.transform(F.array(dealt), lambda v: F.struct(
            F.zip_with(rest, v, lambda x, y: x - y).alias("rest"),
            F.concat(acc["out"], F.array(F.struct(kid["node"].alias("node"), v.alias("vec")))).alias("out")))[0]

    dealt = F.aggregate(
        F.col("kids"),
        F.struct(F.col("vec").alias("rest"),
                 F.array().cast("array<struct<node:bigint,vec:array<bigint>>>").alias("out")),
        child, lambda a: a["out"])
    return rows.select(F.explode(dealt).alias("c")).select("c.node", "c.vec")


def communication_matrix(counts: DataFrame, n_shards: int, seed: int) -> DataFrame:
    """(node, vec): rows that partition ``node`` sends to each shard.

    ``counts`` is (node long, n long), a row per partition.  Column sums are the
    shard sizes (at most one apart), row sums the partition counts.
    """
    spark = counts.sparkSession
    total, most = counts.agg(F.sum("n"), F.max("node")).first()
    if not total:
        return spark.createDataFrame([], "node bigint, vec array<bigint>")
    sizes = [total // n_shards + (s < total % n_shards) for s in range(n_shards)]
    depth = 0
    while FAN ** depth <= most:
        depth += 1
    levels = spark.range(1).select(F.col("id").alias("node"), F.array(
        *[F.lit(x).cast("long") for x in sizes]).alias("vec"))
    for level in range(depth - 1, -1, -1):
        below = counts.groupBy(F.shiftright("node", level * int(math.log2(FAN))).alias("node")).agg(
            F.sum("n").alias("n"))
        levels = _split(levels, below, level, seed)
    return levels


def shard_rows(df: DataFrame, n_shards: int = 8, seed: int = 20261) -> DataFrame:
    """``df`` with shard (int, from 0) and slot (long, gapless from 0 in each shard).

    Shard sizes differ by one at most, whatever keys, sources or copies the rows
    have; every arrangement has the same chance.  Rows are told apart by their
    place in a saved copy of ``df``, so nulls and repeated rows need no care.
    Columns of the input named shard or slot are replaced.
    """
    df = df.drop(*[c for c in df.columns if c.lower() in ("shard", "slot")])
    rows = saved(df.select(F.struct("*").alias("_row") if df.columns else F.struct(F.lit(0)).alias("_row"),
                           F.spark_partition_id().cast("long").alias("_p"),
                           F.monotonically_increasing_id().alias("_r")))
    counts = saved(rows.groupBy(F.col("_p").alias("node")).agg(F.count(F.lit(1)).alias("n")))
    total = counts.agg(F.sum("n")).first()[0] or 0
    matrix = communication_matrix(counts, n_shards, seed).withColumnRenamed("node", "_p")
    matrix = matrix.withColumn("_ends", F.transform(
        F.sequence(F.lit(1), F.lit(n_shards)),
        lambda s: F.aggregate(F.slice("vec", F.lit(1), s), F.lit(0).cast("long"), lambda x, y: x + y)))
    local = Window.partitionBy("_p").orderBy(F.xxhash64(F.lit(seed + 1), F.col("_r")), "_r")
    sent = (rows.withColumn("_k", F.row_number().over(local) - 1).join(matrix.select("_p", "_ends"), "_p")
            .withColumn("shard", F.size(F.filter("_ends", lambda e: e <= F.col("_k"))))
            .select("_row", "_r", "shard", F.xxhash64(F.lit(seed + 2), F.col("_r")).alias("_h")))
    buckets = max(1, math.ceil(total / n_shards / BUCKET_ROWS))
    sent = saved(sent.withColumn("_b", F.pmod(F.col("_h"), F.lit(buckets))))
    before = Window.partitionBy("shard").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = sent.groupBy("shard", "_b").agg(F.count(F.lit(1)).alias("_n")).select(
        "shard", "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    place = Window.partitionBy("shard", "_b").orderBy("_h", "_r")
    return (sent.withColumn("_k", F.row_number().over(place) - 1).join(starts, ["shard", "_b"])
            .select(*[F.col("_row")[c].alias(c) for c in df.columns], "shard",
                    (F.col("_start") + F.col("_k")).cast("long").alias("slot")))
