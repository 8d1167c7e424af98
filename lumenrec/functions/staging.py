"""Tables written once to the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_collected: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only a local-mode session without it gets a folder of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or _own.get(spark.sparkContext.applicationId)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = _own[spark.sparkContext.applicationId] = tempfile.mkdtemp(prefix="spark-")
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if _collected:
        _collected[-1].append(path)
    return path


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """What is written inside leaves no shuffle files behind; else they stay until the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet and rereads it, so lineage ends there and a lost executor costs nothing."""
    return written(df, new_path(df.sparkSession, name))


def written(df: DataFrame, path: str) -> DataFrame:
    """stage() to a path that the caller deletes."""
    with shuffles_dropped(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder on whatever file system it is; one that isn't there is no error."""
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def staged_tables(spark: SparkSession) -> Iterator[None]:
    """Whatever is staged inside is deleted at the end: results are to be written or collected before.

    with staged_tables(spark):
        k_core(df).write.parquet(path)
    """
    _collected.append([])
    try:
        yield
    finally:
        for path in _collected.pop():
            delete(spark, path)


class Scratch:
    """The staged tables of one run of an operator, in a folder of their own; drop() deletes those that no later step reads."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path, self._written = spark, new_path(spark, name), {}

    def stage(self, df: DataFrame, name: str, by: str | None = None) -> DataFrame:
        """df, written and reread; by: a column of few values, a folder each, so that filters on it read few of them."""
        paths = self._written.setdefault(name, [])
        paths.append(f"{self.path}/{name}-{len(paths)}")
        if by:
            df.repartition(by).write.partitionBy(by).parquet(paths[-1])
        else:
            df.write.parquet(paths[-1])
        return self.spark.read.schema(df.schema).parquet(paths[-1])

    def drop(self, *names: str) -> None:
        for path in [p for n in names for p in self._written.pop(n, [])]:
            delete(self.spark, path)

    def keep(self, *names: str) -> None:
        """Drops all others."""
        self.drop(*[n for n in self._written if n not in names])
