"""Tables that change together: immutable segments, and one manifest per version that names those which count.

A commit writes its rows as segments that nobody reads yet and then puts one manifest in place, under the next version number and only if nobody
took that number. So a batch becomes visible in all its tables at once or not at all, a repeated batch is known by
its number, and two writers cannot overwrite each other: who comes second works again on the newer version.

A table with a key is merged on read: of the rows of a key the one of the highest version counts. A batch writes the rows it changed, in
the buckets they fall in, and reads only the buckets it names. Segments of one level are merged into one of the next when
there are `MERGE` of them, so a row is rewritten as often as the logarithm of the number of batches.
"""
from __future__ import annotations

import functools
import json
import time
import uuid
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from countersign.sources.tables import BUCKETS, bucket_of

MERGE = 8  # segments of one level that are merged
TRIES = 20  # versions that others may take before a writer gives up
ROWS_A_WRITER = 1 << 20
WRITERS = 4  # segments written at a time


class Conflict(RuntimeError):
    """Another writer took the version."""


@dataclass(frozen=True)
class Table:
    """Schema, the columns that identify a row (none: rows are only appended), the event column that places it, and a number that spreads a hot event."""

    schema: T.StructType
    key: tuple[str, ...] = ()
    place: str | None = None
    spread: str | None = None


@dataclass(frozen=True)
class Segment:
    name: str
    level: int
    buckets: tuple[int, ...]


@dataclass(frozen=True)
class Manifest:
    version: int
    done: dict[str, int] = field(default_factory=dict)
    segments: dict[str, tuple[Segment, ...]] = field(default_factory=dict)

    def text(self) -> str:
        segments = {t: [[s.name, s.level, list(s.buckets)] for s in held] for t, held in self.segments.items()}
        return json.dumps({"version": self.version, "done": self.done, "segments": segments})

    @staticmethod
    def of(text: str) -> Manifest:
        raw = json.loads(text)
        return Manifest(raw["version"], raw["done"], {t: tuple(Segment(n, v, tuple(b)) for n, v, b in held) for t, held in raw["segments"].items()})


EMPTY = Manifest(-1)


class Files:
    """The few file operations a manifest needs, through Spark's own file systems."""

    def __init__(self, spark: SparkSession):
        self._jvm, self._gateway = spark._jvm, spark.sparkContext._gateway
        self._conf = spark._jsc.hadoopConfiguration()

    def _path(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def _fs(self, path: str):
        return self._path(path).getFileSystem(self._conf)

    def names(self, folder: str) -> list[str]:
        fs = self._fs(folder)
        return [e.getPath().getName() for e in fs.listStatus(self._path(folder))] if fs.exists(self._path(folder)) else []

    def read(self, path: str) -> str:
        stream = self._fs(path).open(self._path(path))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def put_new(self, path: str, text: str) -> None:
        """Write a file under a name of its own and rename it; fails if `path` is there."""
        beside = f"{path}.{uuid.uuid4().hex}.tmp"
        stream = self._fs(path).create(self._path(beside), False)
        stream.write(bytearray(text.encode()))
        stream.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(path).getFileSystem(self._conf).getUri(), self._conf)
        kind = getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename")
        try:
            context.rename(self._path(beside).makeQualified(self._fs(path).getUri(), None), self._path(path).makeQualified(self._fs(path).getUri(), None), self._gateway.new_array(kind, 0))
        except Exception as e:
            self.remove(beside)
            if "FileAlreadyExists" in str(e):
                raise Conflict(path) from e
            raise

    def move(self, path: str, to: str) -> None:
        self._fs(path).mkdirs(self._path(to).getParent())
        if not self._fs(path).rename(self._path(path), self._path(to)):
            raise OSError(f"cannot move {path} to {to}")

    def remove(self, path: str) -> None:
        self._fs(path).delete(self._path(path), True)


class Store:
    def __init__(self, spark: SparkSession, root: str, tables: dict[str, Table], buckets: int = BUCKETS):
        self.spark, self.root, self.tables, self.buckets = spark, root.rstrip("/"), tables, buckets
        self.files = Files(spark)

    # --- versions ---

    def _versions(self) -> list[int]:
        names = self.files.names(f"{self.root}/_manifest")
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def head(self) -> Manifest:
        """The newest version; -1 where nothing was committed."""
        versions = self._versions()
        return self.at(versions[-1]) if versions else EMPTY

    def at(self, version: int) -> Manifest:
        return Manifest.of(self.files.read(f"{self.root}/_manifest/v{version:012d}.json"))

    def _publish(self, manifest: Manifest) -> Manifest:
        self.files.put_new(f"{self.root}/_manifest/v{manifest.version:012d}.json", manifest.text())
        return manifest

    # --- reading ---

    def read(self, name: str, head: Manifest | None = None, buckets: Iterable[int] | None = None) -> DataFrame:
        """Rows of a version, of some buckets only if they are named."""
        rows = self._raw(name, (head or self.head()).segments.get(name, ()), buckets)
        return self._newest(name, rows).filter("not _deleted").select(*self.tables[name].schema.fieldNames())

    def _stored(self, name: str) -> T.StructType:
        own = [T.StructField("_deleted", T.BooleanType()), T.StructField("_version", T.LongType())]
        return T.StructType([*self.tables[name].schema.fields, *own])

    def _raw(self, name: str, segments: tuple[Segment, ...], buckets: Iterable[int] | None = None) -> DataFrame:
        wanted = None if buckets is None else set(buckets)
        paths = [f"{self.root}/{name}/{s.name}/bucket={b}" for s in segments for b in s.buckets if wanted is None or b in wanted]
        schema = self._stored(name)
        # Paths, not a filter: a version reads what it names, whatever else lies in the folder.
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _newest(self, name: str, rows: DataFrame) -> DataFrame:
        key = self.tables[name].key
        if not key:
            return rows
        body = F.struct(*[c for c in rows.columns if c not in key])
        return rows.groupBy(*key).agg(F.max_by(body, "_version").alias("_row")).select(*key, "_row.*")

    # --- writing ---

    def write(self, name: str, rows: DataFrame, version: int, level: int = 0) -> Segment | None:
        """Rows as a segment that no version names yet; none if there are no rows."""
        table = self.tables[name]
        own = {"_deleted": F.lit(False), "_version": F.lit(version).cast("long")}
        have = set(rows.columns)
        columns = [(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in table.schema.fields]
        columns += [F.coalesce(F.col(c), v).alias(c) if c in have else v.alias(c) for c, v in own.items()]
        segment = f"s{version:012d}-{uuid.uuid4().hex}"
        bucket = bucket_of(table.place, self.buckets) if table.place else F.lit(0)
        placed = rows.select(*columns).withColumn("bucket", F.coalesce(bucket, F.lit(0)))
        if table.place:
            # A bucket goes to one writer, a hot one to several.
            spread = F.floor(F.col(table.spread) / ROWS_A_WRITER) if table.spread else F.lit(0)
            placed = placed.repartition("bucket", spread)
        path = f"{self.root}/{name}/{segment}"
        placed.write.partitionBy("bucket").parquet(path)
        buckets = tuple(sorted(int(n.split("=")[1]) for n in self.files.names(path) if n.startswith("bucket=")))
        return Segment(segment, level, buckets) if buckets else None

    def advance(self, stream: str, number: int, work: Callable[[Manifest], dict[str, DataFrame | None]]) -> Manifest:
        """Commit what `work(head)` yields as the batch `number` of a stream, unless it is committed already.

        If another writer takes the version meanwhile, the work is done again on what that one left.
        """
        for tried in range(TRIES):
            head = self.head()
            if head.done.get(stream, -1) >= number:
                return head
            frames = {n: rows for n, rows in work(head).items() if rows is not None}
            # Segments do not see one another: small ones need not wait for the large.
            with ThreadPoolExecutor(WRITERS) as pool:
                written = dict(zip(frames, pool.map(lambda n: self.write(n, frames[n], head.version + 1), frames)))
            segments = dict(head.segments)
            for n, segment in written.items():
                if segment is not None:
                    segments[n] = (*segments.get(n, ()), segment)
            try:
                return self._publish(Manifest(head.version + 1, {**head.done, stream: number}, segments))
            except Conflict:
                time.sleep(min(2.0, 0.05 * 2**tried))
        raise Conflict(f"{stream} {number}: {TRIES} versions were taken by others")

    def merge(self, name: str, most: int = MERGE) -> Manifest:
        """Merge the segments of each full level into one of the next; of a key the newest row stays."""
        while True:
            head = self.head()
            held = head.segments.get(name, ())
            level = next((v for v in sorted({s.level for s in held}) if sum(s.level == v for s in held) >= most), None)
            if level is None:
                return head
            full = tuple(s for s in held if s.level == level)
            rows = self._newest(name, self._raw(name, full))
            if self.tables[name].key and not any(s.level > level for s in held):
                rows = rows.filter("not _deleted")  # nothing older is left to hide
            merged = self.write(name, rows, head.version + 1, level + 1)
            kept = tuple(s for s in held if s.level != level)
            place = sum(s.level > level for s in held)
            segments = {**head.segments, name: (*kept[:place], *([merged] if merged else []), *kept[place:])}
            try:
                self._publish(replace(head, version=head.version + 1, segments=segments))
            except Conflict:
                continue

    def expire(self, keep: int = 10) -> None:
        """Remove all versions but the last `keep`, and segments that those do not name; a writer at work has newer segments."""
        versions = self._versions()
        if not versions:
            return
        for v in versions[:-keep]:
            self.files.remove(f"{self.root}/_manifest/v{v:012d}.json")
        named = {s.name for v in versions[-keep:] for held in self.at(v).segments.values() for s in held}
        for name in self.tables:
            for segment in self.files.names(f"{self.root}/{name}"):
                if segment.startswith("s") and segment not in named and int(segment[1:13]) <= versions[-1]:
                    self.files.remove(f"{self.root}/{name}/{segment}")


def buckets_of(rows: DataFrame, column: str = "event_id", buckets: int = BUCKETS) -> list[int]:
    """The buckets that rows fall in: `buckets` numbers at most."""
    return sorted(r[0] for r in rows.filter(F.col(column).isNotNull()).select(bucket_of(column, buckets)).distinct().collect())


def union_all(frames: list[DataFrame]) -> DataFrame:
    return functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
