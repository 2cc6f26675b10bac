"""Folder listings as Spark data sources.

Spark's own file index hides names that begin with a dot or underscore and lists no folders, and its
stream never returns to a changed path. ``folder_listing`` lists one level or a tree, in parallel over
the given roots; ``folder_observations`` is what is there now, once or at each trigger of a stream.
Both see the file systems that executors mount.
"""

from __future__ import annotations

import fnmatch
import json
import os
import sys
import time
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, InputPartition, IsNotNull, LessThan, LessThanOrEqual, Not

from ..runtime import by_value, ship

ENTRY = "path string, name string, rel string, kind string, size long, mtime timestamp, head binary, tail binary, depth int, hidden boolean"
OBSERVATION = "root string, shard int, path string, name string, kind string, sig string, mtime timestamp, observed_at timestamp"
#: Tasks, and keys of state, for each watched folder.
SHARDS = 4
#: Files of a folder counted for its signature before it stops.
MANY = 2000


def _ignored(name: str, globs: list[str]) -> bool:
    return any(fnmatch.fnmatchcase(name.lower(), g.lower()) for g in globs)


def level(root: str, ignore: list[str] = (), owned: set[str] | frozenset = frozenset(), folders: bool = True) -> list[os.DirEntry]:
    """The entries of one folder: no links, nothing ignored or owned; files first, by name without case."""
    with os.scandir(root) as found:
        kept = [e for e in found if not e.is_symlink() and not _ignored(e.name, list(ignore)) and e.name not in owned and (e.is_file() or (folders and e.is_dir()))]
    return sorted(kept, key=lambda e: (e.is_dir(), e.name.lower()))


def subfolders(at: str) -> list[str]:
    with os.scandir(at) as found:
        return sorted(e.path for e in found if e.is_dir(follow_symlinks=False))


def tree(root: str, at: str, depth: int, hidden: bool, ignore: list[str], deep: bool = True) -> Iterator[tuple[str, str]]:
    """Files from a folder of the root on, as path and relative path of at most ``depth`` parts; of that folder alone if not deep."""
    for here, dirs, files in os.walk(at):
        rel = os.path.relpath(here, root)
        parts = 0 if rel == "." else rel.count(os.sep) + 1
        dirs[:] = sorted(d for d in dirs if deep and (hidden or not d.startswith(".")) and parts + 1 < depth and not os.path.islink(os.path.join(here, d)))
        for name in sorted(files) if parts < depth else ():
            path = os.path.join(here, name)
            if (hidden or not name.startswith(".")) and not _ignored(name, ignore) and os.path.isfile(path) and not os.path.islink(path):
                yield path, name if rel == "." else f"{rel}/{name}"


def signature(path: str) -> str | None:
    """Changes while a file or folder is being written; null if it cannot be read."""
    try:
        if not os.path.isdir(path):
            st = os.stat(path)
            return f"file:{st.st_size}:{st.st_mtime}"
        count = total = 0
        newest = 0.0
        for at, _, files in os.walk(path):
            for name in files:
                st = os.stat(os.path.join(at, name))
                count, total, newest = count + 1, total + st.st_size, max(newest, st.st_mtime)
                if count > MANY:
                    return f"dir:{count}:{total}:{newest}"
        return f"dir:{count}:{total}:{newest}"
    except OSError:
        return None


def _moment(seconds: float) -> datetime:
    return datetime.fromtimestamp(seconds, timezone.utc)


class Part(InputPartition):
    """A folder of a root: with all below it, or its own files alone."""

    def __init__(self, root: str, at: str, deep: bool) -> None:
        self.root, self.at, self.deep = root, at, deep


class ListingReader(DataSourceReader):
    """Reads one level of each root, or with the option tree all below, in about ``tasks`` parts.

    Filters on depth, hidden and kind are taken over: a tree is not entered where they would drop what is found.
    """

    def __init__(self, options: dict) -> None:
        self.roots = json.loads(options["roots"])
        self.ignore = json.loads(options.get("ignore", "[]"))
        self.owned = set(json.loads(options.get("owned", "[]")))
        self.tree = options.get("tree", "false") == "true"
        self.tasks = int(options.get("tasks", "16"))
        self.folders = options.get("folders", "true") == "true"
        self.depth, self.hidden = sys.maxsize, True

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Gives back what it does not take over."""
        for f in filters:
            match f:
                case LessThanOrEqual(("depth",), n):
                    self.depth = min(self.depth, n)
                case LessThan(("depth",), n):
                    self.depth = min(self.depth, n - 1)
                case EqualTo(("hidden",), False) | Not(EqualTo(("hidden",), True)):
                    self.hidden = False
                case EqualTo(("kind",), "file"):
                    self.folders = False
                case IsNotNull(("depth" | "hidden" | "kind" | "path" | "name" | "rel",)):
                    pass
                case _:
                    yield f

    def partitions(self) -> list[Part]:
        if not self.tree:
            return [Part(r, r, False) for r in self.roots]
        done, open_ = [], [Part(r, r, True) for r in self.roots]
        # Folders are opened level by level until there are parts enough; the driver looks into no more than that.
        while open_ and len(done) + len(open_) < self.tasks:
            inner = []
            for p in open_:
                below = [] if self._parts(p) + 1 >= self.depth else [d for d in subfolders(p.at) if self.hidden or not os.path.basename(d).startswith(".")]
                done.append(Part(p.root, p.at, False))
                inner += [Part(p.root, d, True) for d in below]
            open_ = inner
        return done + open_

    @staticmethod
    def _parts(p: Part) -> int:
        rel = os.path.relpath(p.at, p.root)
        return 0 if rel == "." else rel.count(os.sep) + 1

    def read(self, partition: Part) -> Iterator[tuple]:
        if self.tree:
            found = ((p, rel, "file") for p, rel in tree(partition.root, partition.at, self.depth, self.hidden, self.ignore, partition.deep))
        else:
            found = ((e.path, e.name, "folder" if e.is_dir() else "file") for e in level(partition.root, self.ignore, self.owned, self.folders))
        for path, rel, kind in found:
            hidden = any(part.startswith(".") for part in rel.split("/"))
            if (hidden and not self.hidden) or rel.count("/") >= self.depth:
                continue
            try:
                st = os.stat(path)
                head = tail = None
                if kind == "file":
                    with open(path, "rb") as f:
                        head = f.read(8192)
                        if st.st_size >= 512:
                            f.seek(-512, 2)
                            tail = f.read(512)
            except OSError:
                st, head, tail = None, None, None
            yield path, os.path.basename(path), rel, kind, st.st_size if st else None, _moment(st.st_mtime) if st else None, head, tail, rel.count("/") + 1, hidden


class FolderListing(DataSource):
    """Entries of the folders in the option roots (a JSON list)."""

    @classmethod
    def name(cls) -> str:
        return "folder_listing"

    def schema(self) -> str:
        return ENTRY

    def reader(self, schema) -> ListingReader:  # noqa: ANN001
        return ListingReader(self.options)


class Shard(InputPartition):
    """The entries of a root whose names fall into one shard, as seen at a time (microseconds)."""

    def __init__(self, root: str, shard: int, at: int) -> None:
        self.root, self.shard, self.at = root, shard, at


class Observer:
    """What both readers of observations share. A shard lists the names of its root, but looks only at its own entries."""

    def __init__(self, options: dict) -> None:
        self.roots, self.ignore = json.loads(options["roots"]), json.loads(options.get("ignore", "[]"))
        self.owned, self.shards = set(json.loads(options.get("owned", "[]"))), int(options.get("shards", SHARDS))

    def planned(self, at: int) -> list[Shard]:
        return [Shard(root, i, at) for root in self.roots for i in range(self.shards)]

    def read(self, shard: Shard) -> Iterator[tuple]:
        now = _moment(shard.at / 1e6)
        # Each shard says that it looked, so that what is not there any more is missed.
        yield shard.root, shard.shard, None, None, None, None, None, now
        for e in level(shard.root, self.ignore, self.owned) if os.path.isdir(shard.root) else []:
            if zlib.crc32(e.name.encode("utf-8", "surrogateescape")) % self.shards == shard.shard and (sig := signature(e.path)) is not None:
                yield shard.root, shard.shard, e.path, e.name, "folder" if e.is_dir() else "file", sig, _moment(e.stat().st_mtime), now


class ObservationReader(Observer, DataSourceReader):
    def partitions(self) -> list[Shard]:
        return self.planned(time.time_ns() // 1000)


class ObservationStream(Observer, DataSourceStreamReader):
    """An offset is the time of a look and nothing else; what was there before is in the state of who reads the stream.

    A batch that is run again looks again: it sees what is there then, under the time of the first look.
    """

    def initialOffset(self) -> dict:
        return {"at": 0}

    def latestOffset(self) -> dict:
        return {"at": time.time_ns() // 1000}

    def partitions(self, start: dict, end: dict) -> list[Shard]:
        return self.planned(end["at"])


class FolderObservations(DataSource):
    """What is in the folders of the option roots (a JSON list), by shards of names: once, or at each trigger of a stream."""

    @classmethod
    def name(cls) -> str:
        return "folder_observations"

    def schema(self) -> str:
        return OBSERVATION

    def reader(self, schema) -> ObservationReader:  # noqa: ANN001
        return ObservationReader(self.options)

    def streamReader(self, schema) -> ObservationStream:  # noqa: ANN001
        return ObservationStream(self.options)


def register(spark: SparkSession) -> None:
    ship(spark)
    by_value(__name__)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FolderListing)
    spark.dataSource.register(FolderObservations)


def scan(spark: SparkSession, root: str, ignore: list[str] = (), owned: set[str] = frozenset(), folders: bool = True) -> DataFrame:
    """One level of a folder, files first, by name without case."""
    register(spark)
    rows = spark.read.format("folder_listing").options(roots=json.dumps([root]), ignore=json.dumps(list(ignore)), owned=json.dumps(sorted(owned)), folders=str(folders).lower()).load()
    return rows.orderBy(F.col("kind") == "folder", F.lower("name"))


def listed_tree(spark: SparkSession, root: str, ignore: list[str] = (), tasks: int = 16) -> DataFrame:
    """All files below a folder, in several tasks; filters on depth and hidden keep it from being entered."""
    register(spark)
    return spark.read.format("folder_listing").options(roots=json.dumps([root]), ignore=json.dumps(list(ignore)), tree="true", tasks=str(tasks)).load()


def gather(spark: SparkSession, root: str, ignore: list[str] = (), limit: int = 300, depth: int = 4) -> DataFrame:
    """Visible files of a tree, an even sample of at most limit by path."""
    from ..operators.rules import even_sample

    return even_sample(listed_tree(spark, root, ignore).where((F.col("depth") <= depth) & ~F.col("hidden")), "path", limit)
