"""Cutting lineage with tables written to the folder that all executors share.

A result kept here survives the loss of any executor: it is Parquet in ``spark.checkpoint.dir``, never a block held by
one machine. The folder is the session's own setting; only where it is unset (tests, a laptop) a temporary one is made.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session, or a new temporary folder where it is unset."""
    conf = spark.sparkContext.getConf()
    if found := conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    if not conf.get("spark.master", "").startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    made = tempfile.mkdtemp(prefix="tallyline-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


class Scratch:
    """Tables of one run in the shared folder. They go when released, at the latest when the driver's JVM ends."""

    def __init__(self, spark: SparkSession, tag: str):
        self.spark, self.root, self._paths = spark, f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}", {}
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(self.root))
        self._fs.deleteOnExit(self._path(self.root))

    def path(self) -> str:
        return f"{self.root}/{uuid.uuid4().hex}"

    def keep(self, df: DataFrame) -> DataFrame:
        """Write ``df`` once and return a scan of what was written: no lineage, known size, any executor can read it."""
        path = self.path()
        df.write.parquet(path)
        kept = self.spark.read.schema(df.schema).parquet(path)
        self._paths[id(kept)] = (kept, path)
        return kept

    def measured(self, df: DataFrame, **aggregates: Column) -> tuple[DataFrame, dict]:
        """``keep``, and aggregates of the rows taken in the same job.

        A task that runs again after a loss may be counted twice: good for whether there is anything, and for shares.
        """
        seen = Observation()
        kept = self.keep(df.observe(seen, *(c.alias(name) for name, c in aggregates.items())))
        return kept, seen.get

    def released(self) -> None:
        """Delete all that this run has kept, for a caller that has read its result (or written it elsewhere)."""
        self._paths.clear()
        self._fs.delete(self._path(self.root), True)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        self.released()

    def release(self, *kept: DataFrame) -> None:
        """Delete tables that nothing reads any more."""
        for df in kept:
            if found := self._paths.pop(id(df), None):
                self._fs.delete(self._path(found[1]), True)


def spread(df: DataFrame) -> DataFrame:
    """``df``, dealt over all cores if it is a scan of fewer splits than there are cores.

    For passes that cost much more than moving their rows: a table in one small file would otherwise keep one core busy.
    A large table has splits enough and is left alone, so nothing is shuffled at scale.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df
