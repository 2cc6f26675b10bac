"""Tables with one row a key that outlive a run: verdicts and vectors.

A store is a folder of runs, each bucketed and sorted by key, one file a bucket, and numbered manifests; the last whole
manifest names the runs that count, oldest first. Putting rows writes a run and then a manifest. When there
are more than ``RUNS`` runs they are merged into one, the newest row of a key staying, and buckets double while they are too large. So
the number of files is bounded however often rows are put, and looking up joins the rows with each run where it
lies: the store's side is neither shuffled nor sorted.

A run without a manifest, from a crash, counts for nothing and goes with the next merge; a manifest that exists already makes
the second of two writers start its step again on top of the first. Readers that hold an older manifest
keep the runs it names until the merge after.
"""

from __future__ import annotations

import json
import re
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Runs beside which a new one may stand, buckets of a new store, and bytes of a bucket beyond which their number doubles.
RUNS = 4
BUCKETS = 8
BUCKET_BYTES = 128 << 20


@dataclass(frozen=True)
class Manifest:
    number: int
    buckets: int
    runs: tuple[tuple[str, int], ...]  # folder and buckets


class KeyedStore:
    def __init__(self, spark: SparkSession, path: str, schema: str, key: str = "key", buckets: int = BUCKETS, runs: int = RUNS, bucket_bytes: int = BUCKET_BYTES) -> None:
        self.spark, self.path, self.key, self.most, self.bucket_bytes = spark, path.rstrip("/"), key, runs, bucket_bytes
        if "://" not in self.path:
            self.path = f"file://{self.path}"
        self.schema, self.start = T._parse_datatype_string(schema), buckets
        self._home = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        self._fs = self._home.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):  # noqa: ANN202
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path, name)

    def _names(self) -> list[str]:
        return [s.getPath().getName() for s in self._fs.listStatus(self._home)] if self._fs.exists(self._home) else []

    def manifest(self) -> Manifest:
        """The last that is whole."""
        numbers = sorted((int(m[1]) for n in self._names() if (m := re.fullmatch(r"manifest-(\d+)\.json", n))), reverse=True)
        for number in numbers:
            stream = self._fs.open(self._at(f"manifest-{number}.json"))
            try:
                held = json.loads(bytes(stream.readAllBytes()))
                return Manifest(number, held["buckets"], tuple(map(tuple, held["runs"])))
            except ValueError:
                continue
            finally:
                stream.close()
        return Manifest(max(numbers, default=0), self.start, ())

    def _commit(self, base: Manifest, buckets: int, runs: tuple[tuple[str, int], ...]) -> bool:
        """Writes the manifest after ``base``; false if another writer has."""
        taken = [int(m[1]) for n in self._names() if (m := re.fullmatch(r"manifest-(\d+)\.json", n))]
        number = max([base.number, *taken]) + 1
        if self.manifest() != base:
            return False
        try:
            out = self._fs.create(self._at(f"manifest-{number}.json"), False)
        except Exception as e:
            if "already exists" in str(e).lower() or "FileAlreadyExists" in str(e):
                return False
            raise
        out.write(bytearray(json.dumps({"buckets": buckets, "runs": runs}).encode()))
        out.close()
        return True

    def _table(self, run: str, buckets: int) -> str:
        """A run as a bucketed table of this session's catalogue, over the files where they are."""
        name = f"keyed_{run.replace('-', '_')}"
        if not self.spark.catalog.tableExists(name):
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.schema.fields)
            self.spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (`{self.key}`) SORTED BY (`{self.key}`) INTO {buckets} BUCKETS LOCATION '{self.path}/{run}'")
        return name

    def _run(self, run: str, buckets: int) -> DataFrame:
        return self.spark.table(self._table(run, buckets))

    def _write(self, rows: DataFrame, buckets: int) -> tuple[str, int]:
        run = f"run-{uuid.uuid4().hex}"
        put = rows.select(*[F.col(f.name).cast(f.dataType) for f in self.schema.fields]).repartition(buckets, self.key)
        put.write.bucketBy(buckets, self.key).sortBy(self.key).format("parquet").option("path", f"{self.path}/{run}").saveAsTable(f"keyed_{run.replace('-', '_')}")
        return run, buckets

    def _one_each(self, rows: DataFrame) -> DataFrame:
        """One row a key; of several the greatest by its other columns."""
        others = [f.name for f in self.schema.fields if f.name != self.key]
        kept = rows.where(F.col(self.key).isNotNull()).groupBy(self.key).agg(F.max(F.struct(*others)).alias("_row"))
        return kept.select(self.key, "_row.*")

    def put(self, rows: DataFrame) -> None:
        """Adds rows; they replace those of equal keys. Rows without a key are dropped, and of equal keys among them one stays."""
        run = self._write(self._one_each(rows), self.manifest().buckets)
        while True:
            base = self.manifest()
            if self._commit(base, base.buckets, (*base.runs, run)):
                break
        if len(base.runs) + 1 > self.most:
            self.merge()

    def merge(self) -> None:
        """Makes one run of all. Files that neither this manifest nor the one before names go."""
        base = self.manifest()
        if not base.runs:
            return
        size = sum(self._fs.getContentSummary(self._at(r)).getLength() for r, _ in base.runs)
        buckets = base.buckets
        while size > buckets * self.bucket_bytes:
            buckets *= 2
        if self._commit(base, buckets, (self._write(self.read(base), buckets),)):
            kept = {r for r, _ in (*base.runs, *self.manifest().runs)}
            for name in self._names():
                number = re.fullmatch(r"manifest-(\d+)\.json", name)
                if (name.startswith("run-") and name not in kept) or (number and int(number[1]) < base.number):
                    self._fs.delete(self._at(name), True)
                    if name.startswith("run-"):
                        self.spark.sql(f"DROP TABLE IF EXISTS keyed_{name.replace('-', '_')}")

    def read(self, manifest: Manifest | None = None) -> DataFrame:
        """All rows, the newest of each key."""
        m = manifest or self.manifest()
        if not m.runs:
            return self.spark.createDataFrame([], self.schema)
        if len(m.runs) == 1:
            return self._run(*m.runs[0])
        others = [f.name for f in self.schema.fields if f.name != self.key]
        every = None
        for age, run in enumerate(m.runs):
            rows = self._run(*run).select(self.key, F.struct(*others).alias("_row"), F.lit(age).alias("_age"))
            every = rows if every is None else every.unionByName(rows)
        return every.groupBy(self.key).agg(F.max_by("_row", "_age").alias("_row")).select(self.key, "_row.*")

    def lookup(self, rows: DataFrame, key: str) -> DataFrame:
        """The rows with ``held``: a struct of the store's row for their key, null without one. A null key has none.

        Keys are looked up once each, in the runs where they lie, and joined back to their rows.
        """
        names = [f.name for f in self.schema.fields]
        found = rows.select(F.col(key).alias("_k")).where("_k is not null").distinct()
        newest = []
        for age, run in reversed(list(enumerate(self.manifest().runs))):
            side = self._run(*run).select(F.col(self.key).alias(f"_k{age}"), F.struct(*names).alias(f"_held{age}"))
            found = found.join(side.hint("merge"), found["_k"] == side[f"_k{age}"], "left").drop(f"_k{age}")
            newest.append(F.col(f"_held{age}"))
        held = F.coalesce(*newest) if newest else F.lit(None).cast(T.StructType(self.schema.fields))
        return rows.drop("held").join(found.select("_k", held.alias("held")), F.col(key) == F.col("_k"), "left").drop("_k")
