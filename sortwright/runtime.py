"""What a session needs before this package's Python code can run on its executors."""

from __future__ import annotations

import os
import sys
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()
_own_roots: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder for stages that the whole cluster shares: ``spark.checkpoint.dir`` of the session.

    A session on this machine alone may leave it unset and gets a temporary folder; a cluster may not.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_roots:
        _own_roots[app] = "file://" + tempfile.mkdtemp(prefix="sortwright-")
    return _own_roots[app]


def by_value(module: str) -> None:
    """Classes of a module that Spark's helper processes on the driver read travel whole, not by name."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


def ship(spark: SparkSession) -> None:
    """Sends this package's source to the executors, once for each application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    home = Path(__file__).resolve().parent
    out = Path(tempfile.mkdtemp(prefix="sortwright-src-")) / "sortwright_src.zip"
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for root, _, names in os.walk(home):
            for name in sorted(n for n in names if n.endswith(".py")):
                path = Path(root) / name
                z.write(path, path.relative_to(home.parent).as_posix())
    sc.addPyFile(str(out))
    _shipped.add(sc.applicationId)


def staged(df: DataFrame, name: str) -> DataFrame:
    """The rows written to a table of their own in the shared folder and read again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_root(spark)}/sortwright/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
