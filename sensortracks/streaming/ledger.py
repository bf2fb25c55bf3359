"""Tables that a stream writes batch by batch, each batch once.

A batch's rows go to a folder of their own, and then one small file in ``_ledger`` named after
the batch id says which folder counts.  A batch whose file is there
is not written again, and there is one file a batch, so of several attempts one counts; folders of attempts that
broke off are in no entry and never read, and a batch that is replayed, smaller or empty
changes nothing more.  Readers list the ledger, one name a batch, and read just those folders.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


class LedgerTable:
    """A table under ``path``, clustered by ``cluster``: files hold ranges of these columns, sorted."""

    def __init__(self, spark: SparkSession, path: str, cluster: list[str]):
        self.spark, self.path, self.cluster = spark, path.rstrip("/"), cluster

    def entries(self) -> dict[int, str]:
        """Batch id -> folder of all batches that count."""
        fs, at = _fs(self.spark, f"{self.path}/_ledger")
        if not fs.exists(at):
            return {}
        out = {}
        for status in fs.listStatus(at):
            if status.getPath().getName().isdigit():
                stream = fs.open(status.getPath())
                out[int(status.getPath().getName())] = stream.readUTF()
                stream.close()
        return out

    def append(self, batch: DataFrame, batch_id: int) -> bool:
        """Write a batch; False if its id is in the ledger already (the rows are then left out)."""
        fs, entry = _fs(self.spark, f"{self.path}/_ledger/{batch_id}")
        if fs.exists(entry):
            return False
        folder = f"batch-{batch_id}-{uuid.uuid4().hex}"
        rows = batch.withColumn("batch_id", F.lit(batch_id).cast("long"))
        rows.repartitionByRange(*self.cluster).sortWithinPartitions(*self.cluster).write.parquet(f"{self.path}/{folder}")
        # written aside and renamed: an entry is whole or missing, and there is one a batch
        _, aside = _fs(self.spark, f"{self.path}/_ledger/.{folder}")
        stream = fs.create(aside, False)
        stream.writeUTF(folder)
        stream.close()
        if fs.rename(aside, entry):
            return True
        fs.delete(aside, False)
        return False

    def read(self) -> DataFrame | None:
        """The rows of all batches that count, with their ``batch_id``; None before the first."""
        folders = [f"{self.path}/{f}" for f in self.entries().values()]
        return self.spark.read.parquet(*folders) if folders else None

    def writer(self):
        """A ``foreachBatch`` function."""
        def write(batch: DataFrame, batch_id: int) -> None:
            self.append(batch, batch_id)
        return write
