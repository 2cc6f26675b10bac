"""New arrivals, handled once they stop changing.

A keyed processor holds, for each path, the last signature and since when it stands. A path is settled at
the first observation at least ``settle`` after that; it is then handled once, until it goes away. A path that was there
before the watch counts as handled until it goes away; that it went is kept, so it is handled when it comes back.
The clock is carried in the data, so replays agree.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from datetime import datetime

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType, TimestampType

from ..runtime import by_value, ship
from ..sources.listing import SHARDS, register

SETTLED = StructType([StructField("path", StringType()), StructField("sig", StringType()), StructField("since", TimestampType()), StructField("settled_at", TimestampType())])
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Settle(StatefulProcessor):
    def __init__(self, seconds: float, preset: set[str] | None = None) -> None:
        self.seconds, self.preset = seconds, preset or set()

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("settle", StructType([StructField("sig", StringType()), StructField("since", DoubleType()), StructField("handled", BooleanType())]))

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timer) -> Iterator[Row]:  # noqa: ANN001
        path = key[0]
        now = self.state.get() if self.state.exists() else None
        sig, since, handled = now if now is not None else (None, None, path in self.preset)
        out = []
        for r in sorted(rows, key=lambda r: (r["observed_at"], r["seq"] if "seq" in r else 0)):
            at: datetime = r["observed_at"]
            if r["gone"]:
                sig, since, handled = None, None, False
            elif handled:
                continue
            elif sig != r["sig"]:
                sig, since = r["sig"], at.timestamp()
            elif at.timestamp() - since >= self.seconds:
                out.append(Row(path=path, sig=sig, since=datetime.fromtimestamp(since, at.tzinfo), settled_at=at))
                handled = True
        if sig is None and not handled and path not in self.preset:
            self.state.clear()
        else:
            self.state.update((sig, since, handled))
        yield from out

    def close(self) -> None:
        pass


class Watch(StatefulProcessor):
    """The same for whole looks at a folder: a key is a shard of a root, its state the last look, so what a look lacks has gone.

    State holds for each path its signature, since when, and whether it was handled; paths of the initial state were there before.
    """

    def __init__(self, seconds: float) -> None:
        self.seconds = seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        value = StructType([StructField("sig", StringType()), StructField("since", DoubleType()), StructField("handled", BooleanType())])
        self.known = handle.getMapState("known", StructType([StructField("path", StringType())]), value)

    def handleInitialState(self, key: tuple, initialState: Row, timerValues) -> None:  # noqa: ANN001
        if initialState["path"] is not None:
            self.known.updateValue((initialState["path"],), ("", 0.0, True))

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: ANN001
        looks: dict[datetime, dict[str, str]] = {}
        for r in rows:
            look = looks.setdefault(r["observed_at"], {})
            if r["path"] is not None:
                look[r["path"]] = r["sig"]
        known = {k[0]: tuple(v) for k, v in self.known.iterator()}
        before, out = dict(known), []
        for at in sorted(looks):
            look = looks[at]
            known = {p: v for p, v in known.items() if p in look}
            for path, sig in sorted(look.items()):
                old, since, handled = known.get(path, (None, 0.0, False))
                if handled:
                    continue
                if old != sig:
                    known[path] = (sig, at.timestamp(), False)
                elif at.timestamp() - since >= self.seconds:
                    known[path] = (sig, since, True)
                    out.append(Row(path=path, sig=sig, since=datetime.fromtimestamp(since, at.tzinfo), settled_at=at))
        for path in before.keys() - known.keys():
            self.known.removeKey((path,))
        for path, value in known.items():
            if before.get(path) != value:
                self.known.updateValue((path,), value)
        yield from out

    def close(self) -> None:
        pass


def watch_stream(looks: DataFrame, seconds: float = 8, existing: DataFrame | None = None) -> DataFrame:
    """path, sig, since and settled_at of each settled arrival, from a stream of looks (``folder_observations``); existing: a look
    at what was there before and counts as handled until it goes. It matters in the first batch alone."""
    spark = looks.sparkSession
    ship(spark)
    by_value(__name__)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    before = existing if existing is not None else spark.createDataFrame([], "root string, shard int, path string")
    start = before.select("root", "shard", "path").groupBy("root", "shard")
    return looks.groupBy("root", "shard").transformWithState(Watch(seconds), SETTLED, "append", "none", start)


def settle_stream(observations: DataFrame, seconds: float = 8, existing: set[str] | None = None) -> DataFrame:
    """path, sig, since and settled_at of each settled arrival; existing: paths to treat as handled already."""
    spark = observations.sparkSession
    ship(spark)
    by_value(__name__)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    return observations.groupBy("path").transformWithState(Settle(seconds, existing), SETTLED, "append", "none")


def settled_runs(observations: DataFrame, seconds: float, order: str = "seq") -> DataFrame:
    """The same over a finished table, as gaps and islands: path, sig, since and settled_at of every settled run. A path
    that is gone ends its run, so the same signature later is a new one."""
    w = Window.partitionBy("path").orderBy("observed_at", order)
    change = F.coalesce(((F.lag("sig").over(w) != F.col("sig")) | F.col("gone") | F.lag("gone").over(w)).cast("int"), F.lit(1))
    runs = observations.withColumn("_run", F.sum(change).over(w)).where(~F.col("gone"))
    begun = runs.withColumn("since", F.min("observed_at").over(Window.partitionBy("path", "_run")))
    late = begun.where(F.expr(f"timestampdiff(MICROSECOND, since, observed_at) >= {int(seconds * 1e6)}"))
    return late.groupBy("path", "_run").agg(F.min("observed_at").alias("settled_at"), F.first("since").alias("since"), F.first("sig").alias("sig")).drop("_run")


def first_settled(observations: DataFrame, seconds: float, order: str = "seq") -> DataFrame:
    """Only the first run of each path: what a watch that never sees it go handles."""
    return settled_runs(observations, seconds, order).groupBy("path").agg(F.min(F.struct("settled_at", "since", "sig")).alias("f")).select("path", "f.settled_at", "f.since", "f.sig")


def sweep(entries: DataFrame, now: Column, seconds: float) -> DataFrame:
    """Adds ``ready``: not changed within the last seconds."""
    return entries.withColumn("ready", now.cast("double") - F.col("mtime").cast("double") >= seconds)


def route(items: DataFrame, when_unsure: str) -> DataFrame:
    """Adds ``route``: left, filed, review or asked."""
    unsure = {"review_folder": "review", "ask": "asked", "leave": "left"}[when_unsure]
    return items.withColumn("route", F.when(F.col("category").isNull(), "left").when(F.col("review"), unsure).otherwise("filed"))


def _looks(spark: SparkSession, reader, folders: list[str], ignore: list[str], owned: set[str] | frozenset, shards: int):  # noqa: ANN001, ANN202
    register(spark)
    return reader.format("folder_observations").options(roots=json.dumps(folders), ignore=json.dumps(list(ignore)), owned=json.dumps(sorted(owned)), shards=str(shards)).load()


def observe(spark: SparkSession, folders: list[str], ignore: list[str] = (), owned: set[str] = frozenset(), shards: int = SHARDS) -> DataFrame:
    """A stream of looks at the folders."""
    return _looks(spark, spark.readStream, folders, ignore, owned, shards)


def present(spark: SparkSession, folders: list[str], ignore: list[str] = (), owned: set[str] = frozenset(), shards: int = SHARDS) -> DataFrame:
    """One look at the folders."""
    return _looks(spark, spark.read, folders, ignore, owned, shards)


def start(looks: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, settle_seconds: float = 8, interval: float = 5, existing: DataFrame | None = None, once: bool = False) -> StreamingQuery:
    """Runs the watch: handle gets each batch of settled paths; a batch that fails is run again."""
    writer = watch_stream(looks, settle_seconds, existing).writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{interval} seconds")).start()
