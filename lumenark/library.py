"""A library: seven tables under one root, each a series of immutable versions.

A table is dealt into buckets by hash of its key (KEYS), one folder a bucket and write.
A commit writes new folders, whose names no other writer uses, and then one pointer file
that lists the current folders of every table, so several tables change together and a
reader never sees half a mutation. Appends add folders and write their own rows alone. A
row update finds the buckets that hold its rows, writes these anew and names all others
again; images and their faces share buckets, so lists of people are made anew there only.

Commits are optimistic. What a mutation replaces was read at a snapshot; the commit is
refused (`Conflict`) if a bucket that it replaces, or a table that it relies on, has
changed since. The pointer file is created exclusively, so of two commits with one
number the second is refused too.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .schemas import CORE_TABLES, LAZY_TABLES, MEDIA_DEFAULTS, SCHEMA_VERSION, schema

#: What tables are dealt by; meta is a few rows in one folder.
KEYS = {"images": "image_id", "faces": "image_id", "ocr": "image_id", "album_items": "image_id", "people": "person_id", "albums": "album_id"}
BUCKETS, BUCKET = 16, "__bucket"
#: How files are sorted, so that statistics of row groups skip most of them, and which other columns get bloom filters for lookups of one value.
SORTED = {"images": "image_id", "faces": "person_id", "ocr": "image_id", "album_items": "album_id"}
LOOKUPS = {"images": ("path", "content_hash"), "faces": ("face_id", "image_id")}
#: Seconds after which a folder that no commit names, or a pointer file without its end, belongs to a writer that is gone.
GRACE = 24 * 3600.0


class NotFound(LookupError):
    """A row, table or library that does not exist."""


class SchemaMismatch(RuntimeError):
    """The stored library was made by another schema version or model."""


class Conflict(RuntimeError):
    """Another writer committed first; read again and repeat."""


@dataclass(frozen=True)
class Snapshot:
    """The tables as of one commit."""

    library: Library
    n: int
    tables: dict[str, dict]

    def has(self, name: str) -> bool:
        return name in self.tables

    def version(self, name: str) -> int:
        return self.tables.get(name, {}).get("v", 0)

    def buckets(self, name: str) -> int:
        """How many buckets a table has; 0 if its folders are not dealt."""
        return self.tables.get(name, {}).get("buckets", 0)

    def dirs(self, name: str, buckets: list[int] | None = None) -> list[str]:
        every = self.tables[name]["dirs"]
        return every if buckets is None else [x for x in every if bucket_of(x) in buckets]

    def table(self, name: str, columns: tuple[str, ...] | None = None, buckets: list[int] | None = None) -> DataFrame:
        """A table, or some of its buckets."""
        if not self.has(name):
            raise NotFound(name)
        df = self.library._stored(name, self.dirs(name, buckets), self.tables[name].get("whole", False))
        for c, default in MEDIA_DEFAULTS.items():
            if name == "images" and c not in df.columns:
                df = df.withColumn(c, F.lit(default))
        return df.select(*columns) if columns else df

    def touched(self, name: str, rows: Column | DataFrame) -> list[int] | None:
        """Buckets of the rows where a condition holds, or of the keys in a frame: as many numbers as there are buckets at most. None: the table is not dealt, all of it is touched."""
        if not (n := self.buckets(name)):
            return None
        src = rows if isinstance(rows, DataFrame) else self.table(name).where(rows)
        return sorted(r[0] for r in src.select(bucket(KEYS[name], n)).distinct().collect())


def bucket(key: str, n: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key).cast("bigint")), F.lit(n)).cast("int").alias(BUCKET)


def bucket_of(folder: str) -> int | None:
    return int(folder.rpartition("=")[2]) if f"/{BUCKET}=" in folder else None


class Library:
    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        """buckets: of tables that are made or rewritten whole from now on."""
        self.spark, self.root, self.n_buckets = spark, root.rstrip("/"), buckets
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._text = jvm.org.apache.commons.io.IOUtils.toString
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._known: dict[int, dict[str, dict]] = {}  # commits never change

    # The pointer.
    def _commits(self) -> list[int]:
        at = self._path(f"{self.root}/_commits")
        if not self._fs.exists(at):
            return []
        return sorted(int(s.getPath().getName().split(".")[0]) for s in self._fs.listStatus(at) if s.getPath().getName().endswith(".json"))

    def _commit_file(self, n: int):
        return self._path(f"{self.root}/_commits/{n}.json")

    def _read(self, n: int) -> dict[str, dict] | None:
        """The folders that a commit names; none if its file has no end."""
        if n not in self._known:
            stream = self._fs.open(self._commit_file(n))
            try:
                text = self._text(stream, "UTF-8")
            finally:
                stream.close()
            if not text.endswith("\n"):
                return None
            self._known[n] = json.loads(text)
        return self._known[n]

    def snapshot(self) -> Snapshot:
        """The last whole commit. A writer that is just writing its pointer is waited for."""
        for n in reversed(self._commits()):
            for _ in range(50):
                if (got := self._read(n)) is not None:
                    return Snapshot(self, n, got)
                if time.time() - self._fs.getFileStatus(self._commit_file(n)).getModificationTime() / 1000 > 5:
                    break
                time.sleep(0.2)
        return Snapshot(self, 0, {})

    def pointers(self) -> dict[str, dict]:
        """By table: the last commit that changed it (v), its folders (dirs), how many buckets it is dealt into (buckets)."""
        return self.snapshot().tables

    def _write(self, name: str, df: DataFrame, folder: str, buckets: int) -> list[str]:
        """The folders written."""
        out, at = self._conform(name, df), f"{self.root}/{name}/{folder}"
        if not buckets:
            out.write.parquet(at)
            return [folder]
        # Rows of a bucket meet in few files; large buckets are split, small ones share a task.
        dealt = out.withColumn(BUCKET, bucket(KEYS[name], buckets)).hint("rebalance", BUCKET)
        writer = dealt.sortWithinPartitions(BUCKET, SORTED.get(name, KEYS[name])).write
        for c in LOOKUPS.get(name, ()):
            writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true").option(f"parquet.enable.dictionary#{c}", "false")
        writer.partitionBy(BUCKET).parquet(at)
        return sorted(f"{folder}/{s.getPath().getName()}" for s in self._fs.listStatus(self._path(at)) if s.isDirectory() and s.getPath().getName().startswith(BUCKET))

    def commit(self, tables: dict[str, DataFrame], drop: tuple[str, ...] = (), added: dict[str, DataFrame] | None = None, patched: dict[str, tuple[list[int] | None, DataFrame]] | None = None, at: Snapshot | None = None, unchanged: tuple[str, ...] = ()) -> None:
        """Replaces tables whole (tables) or some buckets of them (patched: buckets, their new rows), adds rows (added), and makes all of it current at once.

        at: the snapshot at which replaced rows were read; needed where a table exists.
        unchanged: tables that must not have changed since either.
        """
        now = self.snapshot()
        changed_ = [t for t in (*tables, *(patched or {}), *unchanged) if now.has(t)]
        if at is None and changed_:
            raise ValueError(f"{changed_[0]} exists: give the snapshot that its new rows were made from")
        n, token, pointer = max([now.n, *self._commits()]) + 1, uuid.uuid4().hex[:12], {k: dict(v) for k, v in now.tables.items() if k not in drop}
        for name in (*tables, *unchanged):
            if at is not None and now.version(name) != at.version(name):
                raise Conflict(f"{name} has changed since commit {at.n}")
        for name, (which, df) in (patched or {}).items():
            if sorted(now.dirs(name, which)) != sorted(at.dirs(name, which)):
                raise Conflict(f"rows of {name} have changed since commit {at.n}")
            kept = [x for x in now.dirs(name) if which is not None and bucket_of(x) not in which]
            pointer[name] = {**pointer[name], "v": n, "dirs": kept + self._write(name, df, f"{n}-{token}-part", now.buckets(name))}
        for name, df in tables.items():
            size = self.n_buckets if name in KEYS else 0
            pointer[name] = {"v": n, "dirs": self._write(name, df, f"{n}-{token}-set", size), "buckets": size, "whole": True}
        for name, df in (added or {}).items():
            had = pointer.get(name, {"dirs": [], "buckets": self.n_buckets if name in KEYS else 0, "whole": True})
            pointer[name] = {**had, "v": n, "dirs": had["dirs"] + self._write(name, df, f"{n}-{token}-add", had.get("buckets", 0))}
        try:
            out = self._fs.create(self._commit_file(n), False)
        except Exception as e:
            if "exists" in str(e).lower():
                raise Conflict("another writer committed first") from None
            raise
        out.write(bytearray((json.dumps(pointer) + "\n").encode()))
        out.close()

    def _conform(self, name: str, df: DataFrame) -> DataFrame:
        cols = [(F.col(f.name) if f.name in df.columns else F.lit(MEDIA_DEFAULTS.get(f.name))).cast(f.dataType).alias(f.name) for f in schema(name).fields]
        return df.select(*cols)

    # Reading.
    def has(self, name: str) -> bool:
        return self.snapshot().has(name)

    def ready(self) -> bool:
        return {"images", "faces", "people"} <= self.pointers().keys()

    def require_ready(self) -> None:
        if not self.ready():
            raise NotFound("the library has no index")

    def version(self, name: str) -> int:
        """Caches are valid while this stays the same."""
        return self.snapshot().version(name)

    def table(self, name: str, columns: tuple[str, ...] | None = None) -> DataFrame:
        return self.snapshot().table(name, columns)

    def _stored(self, name: str, dirs: list[str], whole: bool) -> DataFrame:
        """whole: every file has all columns."""
        if not dirs:
            return self.spark.createDataFrame([], schema(name))
        paths = [f"{self.root}/{name}/{x}" for x in dirs]
        return self.spark.read.schema(schema(name)).parquet(*paths) if whole else self.spark.read.option("mergeSchema", len(dirs) > 1).parquet(*paths)

    def row(self, name: str, key: str, value, columns: tuple[str, ...] | None = None):
        """One row; by a table's own key, only its bucket is read."""
        at = self.snapshot()
        own = KEYS.get(name) == key and at.buckets(name)
        part = at.touched(name, self.spark.range(1).select(F.lit(value).alias(key))) if own else None
        got = at.table(name, columns, part).where(F.col(key) == F.lit(value)).limit(1).collect()
        if not got:
            raise NotFound(f"{name} {value}")
        return got[0]

    # Making.
    def create(self, meta: dict[str, str], drop_existing: bool = False) -> None:
        """Core tables; text and album tables stay if there are any."""
        if self.ready() and not drop_existing:
            return
        empty = {t: self.spark.createDataFrame([], schema(t)) for t in CORE_TABLES if t != "meta"}
        self.commit(empty | {"meta": self._meta_rows(meta)}, at=self.snapshot())

    def ensure(self, *names: str) -> None:
        """Tables that are made when first needed."""
        at = self.snapshot()
        missing = [t for t in names or LAZY_TABLES if not at.has(t)]
        if missing:
            self.commit({t: self.spark.createDataFrame([], schema(t)) for t in missing}, at=at)

    def ensure_media_columns(self) -> bool:
        """Adds columns that an older library lacks; true if anything was added."""
        at = self.snapshot()
        df = self._stored("images", at.dirs("images"), at.tables["images"].get("whole", False))
        if set(MEDIA_DEFAULTS) <= set(df.columns):
            return False
        self.commit({"images": df}, at=at)
        return True

    def _meta_rows(self, meta: dict[str, str]) -> DataFrame:
        return self.spark.createDataFrame(sorted((str(k), str(v)) for k, v in ({"schema_version": SCHEMA_VERSION} | meta).items()), schema("meta"))

    def read_meta(self) -> dict[str, str]:
        return {r.key: r.value for r in self.table("meta").collect()}

    def write_meta(self, meta: dict[str, str]) -> None:
        self.commit({"meta": self._meta_rows(meta)}, at=self.snapshot())

    def verify_compatible(self, expected: dict[str, str]) -> None:
        have = self.read_meta()
        for k, v in ({"schema_version": SCHEMA_VERSION} | expected).items():
            if have.get(k) != str(v):
                raise SchemaMismatch(f"{k} is {have.get(k)}, expected {v}")

    # Mutation.
    def append(self, rows: dict[str, DataFrame], at: Snapshot | None = None, unchanged: tuple[str, ...] = ()) -> None:
        """Writes these rows alone."""
        self.commit({}, added=rows, at=at, unchanged=unchanged)

    def updated(self, name: str, where: Column, values: dict[str, Column]) -> DataFrame:
        return changed(self.table(name), where, values)

    def update(self, name: str, where: Column, values: dict[str, Column]) -> None:
        """Writes the buckets of rows where the condition holds."""
        at = self.snapshot()
        which = at.touched(name, where)
        if which != []:
            self.commit({}, patched={name: (which, changed(at.table(name, buckets=which), where, values))}, at=at)

    def without(self, name: str, keys: DataFrame, on: str) -> DataFrame:
        return without(self.table(name), keys, on)

    def parts_without(self, at: Snapshot, gone: DataFrame, names: list[str]) -> dict[str, tuple[list[int] | None, DataFrame]]:
        """For `commit`: the touched buckets of tables dealt by image, without some images."""
        out = {}
        for t in names:
            if at.has(t) and (which := at.touched(t, gone)) != []:
                out[t] = which, without(at.table(t, buckets=which), gone, "image_id")
        return out

    def remove_images(self, ids: DataFrame, cascade: bool = True) -> None:
        """Images with their faces and texts; with cascade, album items too."""
        self.replace_images(ids, {}, cascade)

    def replace_images(self, gone: DataFrame | None, rows: dict[str, DataFrame], cascade: bool = False, at: Snapshot | None = None) -> None:
        """Removes images and adds rows in one commit, so that no reader misses a changed file. at: where ids of the rows were taken."""
        fixed = ("images",) if at is not None else ()
        at = at or self.snapshot()
        names = ["images", "faces", "ocr"] + ["album_items"] * cascade
        self.commit({}, added=rows, patched=self.parts_without(at, gone, names) if gone is not None else {}, at=at, unchanged=fixed)

    def next_id(self, name: str, key: str) -> int:
        top = self.table(name).agg(F.max(key)).first()[0]
        return 0 if top is None else top + 1

    def allocate(self, df: DataFrame, name: str, key: str) -> DataFrame:
        """Ids from max + 1 on. Numbers within a partition and the partitions' offsets, so no task numbers all rows."""
        start = self.next_id(name, key)
        from .storage import saved

        marked = saved(self.spark, df.withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id()), "allocate")
        sizes = marked.groupBy("__part").count()
        before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
        offsets = sizes.select("__part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__before"))  # one row per partition
        nth = F.row_number().over(Window.partitionBy("__part").orderBy("__at"))
        return marked.join(F.broadcast(offsets), "__part").withColumn(key, (F.lit(start - 1) + F.col("__before") + nth).cast("bigint")).drop("__part", "__at", "__before")

    def compact(self, keep: int = 1, grace: float = GRACE) -> None:
        """Rewrites tables whose buckets have several writes, dealt anew; then drops old commits, and folders that no kept commit names and that are older than `grace` seconds (younger ones may belong to a writer that has not committed yet)."""
        at = self.snapshot()
        worn = [t for t in at.tables if len(at.dirs(t)) > len({bucket_of(x) for x in at.dirs(t)}) or not at.tables[t].get("whole") or at.buckets(t) != (self.n_buckets if t in KEYS else 0)]
        if worn:
            self.commit({t: at.table(t) for t in worn}, at=at)
        commits = self._commits()
        live = [p for n in commits[-keep:] if (p := self._read(n)) is not None]
        for n in commits[:-keep]:
            self._fs.delete(self._commit_file(n), False)
        old = time.time() - grace
        for t in at.tables:
            used = {x.split("/")[0] for p in live for x in p.get(t, {}).get("dirs", [])}
            for s in self._fs.listStatus(self._path(f"{self.root}/{t}")):
                if s.getPath().getName() not in used and s.getModificationTime() / 1000 <= old:
                    self._fs.delete(s.getPath(), True)


def changed(df: DataFrame, where: Column, values: dict[str, Column]) -> DataFrame:
    """Rows with new values where the condition holds; null does not hold."""
    hit = F.coalesce(where, F.lit(False))
    return df.select(*[F.when(hit, values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in df.columns])


def without(df: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """Rows whose key is not among these."""
    return df.join(keys.select(on).distinct(), on, "left_anti")


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))
