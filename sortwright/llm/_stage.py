"""Intermediate tables in the folder that the whole cluster shares.

A staged table cuts lineage and survives the loss of executors. Its root is ``runtime.shared_root``.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from ..runtime import shared_root, ship

#: Frees the shuffle files of a finished write at once rather than at the next garbage collection.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_made: list[str] = []


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Deletes the workspaces made inside, but for lasting ones, once what was read from them is written elsewhere."""
    mark = len(_made)
    yield
    for path in _made[mark:]:
        Workspace.remove(spark, path)
    del _made[mark:]


class Workspace:
    """A folder of staged tables. Tables that later steps no longer need can be dropped early."""

    def __init__(self, spark: SparkSession, name: str, lasting: bool = False) -> None:
        ship(spark)
        self.spark = spark
        self.path = f"{shared_root(spark)}/sortwright/{name}-{uuid.uuid4().hex}"
        if not lasting:
            _made.append(self.path)

    def save(self, df: DataFrame, name: str, **options: str) -> DataFrame:
        path = f"{self.path}/{name}"
        before = self.spark.conf.get(_CLEANUP, None)
        try:
            self.spark.conf.set(_CLEANUP, "true")
            df.write.mode("overwrite").options(**options).parquet(path)
        finally:
            if before is None:
                self.spark.conf.unset(_CLEANUP)
            else:
                self.spark.conf.set(_CLEANUP, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        self.remove(self.spark, f"{self.path}/{name}")

    @staticmethod
    def remove(spark: SparkSession, path: str) -> None:
        """Deletes a staged table through Hadoop's file system, so any shared store works."""
        _system(spark, path)[0].delete(_system(spark, path)[1], True)


def _system(spark: SparkSession, path: str):  # noqa: ANN202
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def write_file(spark: SparkSession, path: str, text: str) -> None:
    """Writes a small file beside its final name and renames it, so that a reader sees the old or the new one."""
    fs, target = _system(spark, path)
    _, draft = _system(spark, f"{path}.{uuid.uuid4().hex}")
    out = fs.create(draft, True)
    out.write(bytearray(text.encode()))
    out.close()
    fs.delete(target, False)
    fs.rename(draft, target)


def read_file(spark: SparkSession, path: str) -> str:
    fs, target = _system(spark, path)
    stream = fs.open(target)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()
