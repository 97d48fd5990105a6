"""Tables in shared storage between the steps of a long plan."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
import weakref
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from siftwood.session import ensure_importable


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in `spark.checkpoint.dir`.

    Only a local master, whose executors share the driver's disk, gets a temporary folder where none is named; elsewhere that is an error.
    """
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if where is None:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            return current.get()
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        where = tempfile.mkdtemp(prefix="siftwood-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", where)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(where)
    return where


def _delete(spark_ref, path: str) -> None:
    spark = spark_ref()
    try:
        if spark is not None and spark.sparkContext._jsc is not None:
            jvm = spark.sparkContext._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session has ended, and its shared folder is the cluster's to clean
        pass


def spread(df: DataFrame) -> DataFrame:
    """A small table over all cores: one that has not a full split for each core, whose few row groups would leave most cores idle.

    So at most cores x `maxPartitionBytes` are ever shuffled; larger tables stay as they are read.
    """
    spark = df.sparkSession
    cores, split = spark.sparkContext.defaultParallelism, spark.conf.get("spark.sql.files.maxPartitionBytes")
    full = cores * int(spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(split))
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < full else df


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    """What is run inside runs under these settings of the session."""
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


class Scratch:
    """A folder of written tables under the shared checkpoint folder.

    The tables cut lineage: an executor lost later re-reads them instead of recomputing. Results read them lazily, so the folder stays
    until `close()` (a result has it as `_siftwood_scratch`) or the end of the driver; `drop` frees what no later step reads.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = ensure_importable(spark)
        self.path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        atexit.register(_delete, weakref.ref(spark), self.path)

    def close(self) -> None:
        _delete(weakref.ref(self.spark), self.path)

    def write(self, df: DataFrame, name: str, free: bool = False) -> DataFrame:
        """free: `df` is not run again, so its shuffle files go once the table is written."""
        at = f"{self.path}/{name}"
        with settings(self.spark, {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"} if free else {}):
            df.write.option("compression", "zstd").parquet(at)
        return self.spark.read.schema(df.schema).parquet(at)

    def drop(self, name: str) -> None:
        """Frees a table that no later step reads."""
        _delete(weakref.ref(self.spark), f"{self.path}/{name}")

    def keep(self, df: DataFrame) -> DataFrame:
        df._siftwood_scratch = self
        return df
