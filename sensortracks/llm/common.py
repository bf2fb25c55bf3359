"""Helpers shared by the training-data operators."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sensortracks.session import checkpoint_dir, ship_package, written  # noqa: F401

# The white space that separates words (space, tab, LF, VT, FF, CR).
WHITE = " \t\n\x0b\x0c\r"
BATCH_ROWS = 1000
WHITE_RE = "[\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> None:
    """Ship the package to the workers, name the shared checkpoint folder, keep Arrow batches of texts small."""
    ship_package(spark)
    checkpoint_dir(spark)
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def saved(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder, with its lineage cut."""
    prepare(df.sparkSession)
    return df.checkpoint(eager=True)


def held_out(doc_id: str | Column, mod: int, rest: int = 2) -> Column:
    """Is crc32 of the id as text, modulo ``mod``, equal to ``rest``?  A null id is not held out."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string")) % mod == rest, F.lit(False))


def free_name(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have yet."""
    taken = {c.lower() for c in df.columns}
    name = base
    while name.lower() in taken:
        name = "_" + name
    return name


def runs(sizes, limit: int):
    """(start, end) of consecutive runs whose sizes sum to ``limit`` at most; a larger item is a run of its own."""
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if len(sizes) > start:
        yield start, len(sizes)


def merged(keys: list, counts: list):
    """Distinct keys and summed counts of several (keys, counts) pairs of arrays."""
    k, n = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k, kind="stable")
    k, n = k[order], n[order]
    first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.zeros(0, int)
    return k[first], np.add.reduceat(n, first) if len(k) else n
