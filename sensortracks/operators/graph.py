"""Connected components of an edge table by contraction and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensortracks.session import discard, written


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst",
                         group: list[str] | None = None) -> DataFrame:
    """(group..., node, label) with label = smallest node id of the component.

    Every round points each node to its smallest neighbour (or itself), follows the
    pointers to their roots by pointer jumping, and contracts the edges to roots;
    edges inside a root disappear.  It ends when no edge is left.  Each round at
    least halves the nodes that still have edges and a chain of n pointers takes
    log2(n) jumps, so a path of any length takes O(log n) joins; nothing is capped.
    Results of every step are written to the shared folder, which cuts the lineage,
    and deleted at the end.  Node ids may be of any orderable type; edges with a null end are ignored.
    """
    group, old = group or [], []
    spark = edges.sparkSession
    e = written(edges.select(*group, F.col(src).alias("a"), F.col(dst).alias("b")).dropna(subset=["a", "b"]), old)
    labels = written(e.select(*group, F.explode(F.array("a", "b")).alias("node")).distinct()
                     .withColumn("label", F.col("node")), old)
    own = len(old)  # the place of the table that labels reads
    e = written(_between(e), old)
    while not e.isEmpty():
        both = e.unionByName(e.select(*group, F.col("b").alias("a"), F.col("a").alias("b")))
        up = both.groupBy(*group, F.col("a").alias("node")).agg(F.min("b").alias("_b"))
        up = _roots(written(up.select(*group, "node", F.least("node", "_b").alias("label")), old), group, old)
        e = written(_between(_through(_through(e, up, group, "a"), up, group, "b")), old)
        labels, own = written(_through(labels, up, group, "label"), old), len(old)
    discard(spark, old[:own - 1] + old[own:])
    return labels


def _between(e: DataFrame) -> DataFrame:
    return e.filter(F.col("a") != F.col("b")).distinct()


def _through(df: DataFrame, up: DataFrame, group: list[str], col: str) -> DataFrame:
    """``df`` with ``col`` replaced by its label in ``up``, where it has one."""
    to = up.select(*group, F.col("node").alias(col), F.col("label").alias("_to"))
    rest = [c for c in df.columns if c not in (*group, col)]
    return df.join(to, [*group, col], "left").select(*group, *rest, F.coalesce("_to", F.col(col)).alias(col))


def _roots(up: DataFrame, group: list[str], old: list[str]) -> DataFrame:
    """Pointers followed to their ends: each jump doubles the distance."""
    while True:
        to = up.select(*group, F.col("node").alias("label"), F.col("label").alias("_to"))
        up = written(up.join(to, [*group, "label"]).select(
            *group, "node", F.col("_to").alias("label"), (F.col("_to") != F.col("label")).alias("_moved")), old)
        if up.filter("_moved").isEmpty():
            return up.drop("_moved")
        up = up.drop("_moved")
