"""Tables that cut the lineage of iterative jobs.

Each table is written as parquet below the folder the cluster names in
``spark.checkpoint.dir`` and read back, so a lost executor costs a re-read and
never a retraining, later readers get column pruning, and Catalyst gets a
measured size to choose its join strategy by.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a private one only in local mode."""
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if root:
        return root
    if not context.master.startswith("local"):
        raise RuntimeError(
            "set spark.checkpoint.dir to a folder that every executor can reach"
        )
    root = tempfile.mkdtemp(prefix="marginspark-")
    context.setCheckpointDir(root)
    return context.getCheckpointDir()


# Bytes of a row group: what few tasks have written is read by many.
ROW_GROUP = 16 << 20


class Workspace:
    """One run's folder.  Superseded tables are dropped by the job that wrote
    them; the tables a result reads from stay, as checkpoint files do."""

    def __init__(self, spark: SparkSession, root: str | None = None) -> None:
        self.spark = spark
        self.root = f"{(root or shared_dir(spark)).rstrip('/')}/run-{uuid.uuid4().hex}"
        self._count = 0
        self._paths: dict[int, str] = {}

    def save(self, df: DataFrame, name: str) -> DataFrame:
        self._count += 1
        path = f"{self.root}/{self._count:04d}-{name}"
        df.write.option("parquet.block.size", ROW_GROUP).parquet(path)
        self._paths[self._count] = path
        table = self.spark.read.schema(df.schema).parquet(path)
        table._marginspark_table = self._count
        return table

    def drop(self, table: DataFrame | None) -> None:
        """Delete a table made by :meth:`save` once nothing reads it any more."""
        self._delete(getattr(table, "_marginspark_table", None))

    def path(self, table: DataFrame) -> str:
        """Where a table made by :meth:`save` is stored."""
        return self._paths[table._marginspark_table]

    def mark(self) -> int:
        """A point in time for :meth:`release`."""
        return self._count

    def release(self, mark: int, *keep: DataFrame) -> None:
        """Delete the tables made since ``mark`` but for those to ``keep``."""
        kept = {getattr(table, "_marginspark_table", None) for table in keep}
        for number in [n for n in self._paths if n > mark and n not in kept]:
            self._delete(number)

    def _delete(self, number: int | None) -> None:
        path = self._paths.pop(number, None)
        if path is None:
            return
        jvm_path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        jvm_path.getFileSystem(conf).delete(jvm_path, True)


_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def arrow_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """For the jobs that run inside: at most ``rows`` rows go to or from a Python
    worker at once."""
    before = spark.conf.get(_ROWS)
    spark.conf.set(_ROWS, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(_ROWS, before)


def widen(df: DataFrame) -> DataFrame:
    """Spread a scan over the cores when it has fewer splits than there are
    cores (small inputs); at scale the input splits are left as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def spread(df: DataFrame) -> DataFrame:
    """As :func:`widen`, keeping what had to be moved; larger inputs are simply
    scanned again, since storing them would cost more."""
    wide = widen(df)
    return df if wide is df else wide.persist()
