"""A folder of tables that only grow by files, with an atomic replacement of whole versions."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Store:
    """Tables of one workspace. Appended tables are folders of Parquet; replaced ones have versions and a pointer.

    A pointer is a small file that is renamed into place after its version is complete: readers see the old version or
    the new one, never half of either.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def init(self, *names: str) -> None:
        """Make the folders of tables that aren't there yet; what is there stays."""
        for name in names:
            self._fs.mkdirs(self._path(f"{name}/rows"))

    def append(self, name: str, df: DataFrame) -> None:
        df.write.mode("append").parquet(f"{self.root}/{name}/rows")

    def replace(self, name: str, df: DataFrame) -> str:
        """Write a new version and make it the current one; returns its name. Older versions stay for running readers."""
        version = uuid.uuid4().hex
        df.write.parquet(f"{self.root}/{name}/{version}")
        self.publish(f"{name}/CURRENT", {"version": version})
        return version

    def publish(self, name: str, value: dict) -> None:
        """Make ``value`` the content of the pointer ``name`` in one step: readers see the old value or the new one."""
        draft = self._path(f"{name}.{uuid.uuid4().hex}")
        out = self._fs.create(draft, True)
        out.write(bytearray(json.dumps(value).encode()))
        out.close()
        options = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = self._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri())
        context.rename(draft, self._path(name), options)

    def published(self, name: str) -> dict | None:
        """The value of a pointer; None if there is none."""
        pointer = self._path(name)
        if not self._fs.exists(pointer):
            return None
        source = self._fs.open(pointer)
        try:
            return json.loads(bytes(source.readAllBytes()).decode())
        finally:
            source.close()

    def _current(self, name: str) -> str | None:
        return (self.published(f"{name}/CURRENT") or {}).get("version")

    def read(self, name: str, schema: str) -> DataFrame:
        """The table's rows; an empty table if nothing was written or it was cleared."""
        version = self._current(name)
        folder = self._path(f"{name}/{version or 'rows'}")
        reader = self.spark.read.schema(schema)
        return reader.parquet(folder.toString()) if self._fs.exists(folder) else self.spark.createDataFrame([], schema)

    def clear(self, *names: str) -> None:
        for name in names:
            self._fs.delete(self._path(name), True)


MODEL_LOG = "model_id string, weights map<string,double>, bias double, flag_threshold double, review_threshold double, n_decisions int, metrics map<string,double>, active boolean, at timestamp"


def log_model(store: Store, model, active: bool = True) -> None:
    """Record a model (a ``tuning.TunedModel``) as the active one, or record that none is (``model`` None)."""
    m = model
    row = (m.model_id, m.weights, m.bias, m.flag_threshold, m.review_threshold, m.n_decisions, {k: float(v) for k, v in m.train_metrics.items()}, active) if m else (None,) * 7 + (False,)
    fields = MODEL_LOG.rpartition(", ")[0]
    store.append("models", store.spark.createDataFrame([row], fields).withColumn("at", F.current_timestamp()))


def active_model(store: Store):
    """The model recorded last, if it is active; None otherwise."""
    from tallyline.operators.tuning import TunedModel

    last = store.read("models", MODEL_LOG).orderBy(F.desc("at")).limit(1).collect()
    if not last or not last[0]["active"]:
        return None
    r = last[0]
    return TunedModel(dict(r["weights"]), r["bias"], r["flag_threshold"], r["review_threshold"], r["n_decisions"], dict(r["metrics"]), r["model_id"])
