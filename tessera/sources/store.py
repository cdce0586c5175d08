"""Versioned snapshot + block store on plain parquet, written by touched part.

All four tables are cut into buckets by a hash of the folder that a row
belongs to. Layout under ``root``::

    folders/<dir>/bucket=B/      id, path, total_size, file_count
    files/<dir>/bucket=B/        id, folder_id, folder_path, name, size
    block_heads/<dir>/bucket=B/  block_id, column_headers, n_rows, rule_version, rule_hash, block_file
    block_rows/<dir>/bucket=B/   block_id, row_number, entries   (sorted by block_id in each file; read with ``cells``, their map)
    _commits/v=N/                a row per table: its schema and the directory of each bucket (written last)

A commit writes only the buckets that it touches, to a directory of its own, and
names for every other bucket the directory that holds it already; so a change of
one folder rewrites one bucket. A version is visible only once its commit rows
exist, so a job that dies half-way leaves nothing a reader can see, and no two
writers ever write the same directory.
"""

from __future__ import annotations

import datetime as dt
import json
import uuid
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TABLES = ("folders", "files", "block_heads", "block_rows")
#: The column that names a row's folder.
FOLDER_OF = {"folders": "path", "files": "folder_path", "block_heads": "block_id", "block_rows": "block_id"}
SORTED_BY = {"folders": ["path"], "files": ["folder_path", "name"], "block_heads": ["block_id"], "block_rows": ["block_id", "row_number"]}
BUCKETS = 16  # of a new store; an existing one keeps its own number. A thousand suit a billion files

COMMIT = ("version long, updated_at timestamp_ntz, n_buckets int, table_name string, schema string, max_id long, "
          "parts array<struct<bucket:int,dir:string>>")


def _stored(columns: list[str]) -> list[str]:
    """The columns of a table that its files hold: a map of entries that are there
    is made from them when it is read."""
    return [c for c in columns if c != "cells" or "entries" not in columns]


class ConcurrentCommit(FileExistsError):
    """Another writer committed the version first. ``buckets``: those that it
    changed since the version that this writer started from."""

    def __init__(self, version: int, buckets: set[int]):
        super().__init__(f"version {version} was committed by another writer, which changed buckets {sorted(buckets)}")
        self.version, self.buckets = version, buckets


@dataclass
class Part:
    """One table of one version: where its buckets are, and its largest id."""

    schema: T.StructType
    dirs: dict[int, str] = field(default_factory=dict)
    max_id: int = 0


class VersionedStore:
    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.spark = spark
        self.root = root.rstrip("/")
        self._known: dict[int, dict[str, Part]] = {}
        cur = self.commits()
        own = None if cur is None else cur.select("n_buckets").first()
        self.buckets = buckets if own is None else int(own[0])

    def bucket(self, folder: Column | str) -> Column:
        return F.pmod(F.xxhash64(folder), F.lit(self.buckets)).cast("int")

    def buckets_of(self, folders: DataFrame) -> list[int]:
        """The different buckets of ``folders`` (folder_path): at most the store's
        number of buckets."""
        return sorted(r[0] for r in folders.select(self.bucket("folder_path")).distinct().collect())

    def inside(self, folder: str, buckets: Iterable[int]) -> Column:
        return self.bucket(folder).isin(list(buckets))

    def _at(self, path: str):
        """A path and its file system."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{path}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def commits(self) -> DataFrame | None:
        path, fs = self._at("_commits")
        return self.spark.read.schema(COMMIT).parquet(path.toString()) if fs.exists(path) else None

    def current(self) -> tuple[int, dt.datetime] | None:
        """(version, updated_at) of the newest committed version, or None."""
        c = self.commits()
        if c is None:
            return None
        row = c.orderBy(F.col("version").desc()).select("version", "updated_at").first()
        return None if row is None else (int(row[0]), row[1])

    def tables(self, version: int) -> dict[str, Part]:
        """Where a version's tables are. A committed version never changes, so it
        is read once."""
        if version in self._known:
            return self._known[version]
        c = self.commits()
        rows = [] if c is None else c.where(F.col("version") == version).collect()
        found = {r.table_name: Part(T.StructType.fromJson(json.loads(r.schema)), {p.bucket: p.dir for p in r.parts}, r.max_id)
                 for r in rows}
        if found:
            self._known[version] = found
        return found

    def read(self, table: str, version: int | None = None, buckets: Iterable[int] | None = None) -> DataFrame:
        """A table of a version (the current one by default), or only some of its
        buckets: files of others are not listed."""
        if version is None:
            cur = self.current()
            if cur is None:
                raise FileNotFoundError(f"no committed version under {self.root}")
            version = cur[0]
        part = self.tables(version).get(table)
        if part is None:
            raise FileNotFoundError(f"version {version} under {self.root} has no {table}")
        some = part.dirs if buckets is None else {b: part.dirs[b] for b in buckets if b in part.dirs}
        paths = [f"{self.root}/{table}/{d}/bucket={b}" for b, d in sorted(some.items())]
        if not paths:
            return self.spark.createDataFrame([], part.schema)
        own = _stored(part.schema.names)
        df = self.spark.read.schema(T.StructType([part.schema[c] for c in own])).parquet(*paths)
        return df if own == part.schema.names else df.withColumn("cells", F.map_from_entries("entries")).select(*part.schema.names)

    def read_block(self, block_id: str, version: int | None = None) -> DataFrame:
        """Rows of one block: only its bucket is listed, and of that the row groups
        whose block_id range and Bloom filter can hold it are read."""
        one = self.spark.range(1).select(F.lit(block_id).alias("folder_path"))
        return self.read("block_rows", version, self.buckets_of(one)).where(F.col("block_id") == F.lit(block_id))

    def _write(self, table: str, df: DataFrame, dir: str, ordered: bool = False) -> Part:
        """Writes a table's rows by bucket. A large bucket spans many tasks and
        files. The largest id is observed by the write itself. The rows of an
        ``ordered`` table are not shuffled first: each task has few folders already."""
        ids = "id" in df.columns
        plain = T.StructType([T.StructField(f.name, f.dataType) for f in df.schema.fields])
        placed = df.select(*_stored(df.columns)).withColumn("bucket", self.bucket(FOLDER_OF[table]))
        if not ordered:
            placed = placed.hint("rebalance", F.col("bucket"))
        placed = placed.sortWithinPartitions("bucket", *SORTED_BY[table])
        seen = Observation(f"{table}-{dir}")
        if ids:
            placed = placed.observe(seen, F.max("id").alias("max_id"))
        writer = placed.write.mode("errorifexists").partitionBy("bucket")
        if table == "block_rows":
            writer = writer.option("parquet.bloom.filter.enabled#block_id", "true")
        writer.parquet(f"{self.root}/{table}/{dir}")
        path, fs = self._at(f"{table}/{dir}")
        found = [s.getPath().getName() for s in fs.listStatus(path)]
        held = {int(n.split("=")[1]): dir for n in found if n.startswith("bucket=")}
        return Part(plain, held, int(seen.get["max_id"] or 0) if ids else 0)

    def commit(self, tables: dict[str, DataFrame], updated_at: dt.datetime, version: int | None = None, *,
               base: int | None = None, touched: Iterable[int] | None = None, ordered: Iterable[str] = ()) -> int:
        """Write the given tables as the next version, then its commit rows.

        With ``touched`` the tables hold the rows of these buckets only, and all
        other buckets are those of version ``base``; else a table is replaced as a
        whole. ``base``: the version that the tables were made from; if another
        one has been committed since, nothing is, and ConcurrentCommit says which
        buckets it changed. ``ordered``: large tables that come in order of their folders."""
        cur = self.current()
        before = self.tables(base if base is not None else cur[0]) if cur is not None else {}
        if version is None:
            version = (0 if cur is None else cur[0] + 1) if base is None else base + 1
        if cur is not None and cur[0] >= version:
            raise ConcurrentCommit(version, self.changed_since(version - 1))
        dir = f"v={version}-{uuid.uuid4().hex[:12]}"
        gone = None if touched is None else set(touched)
        parts = dict(before) if gone is not None else {}
        for name, df in tables.items():
            part = self._write(name, df, dir, name in ordered)
            old = before.get(name)
            if gone is not None and old is not None:
                part.dirs |= {b: d for b, d in old.dirs.items() if b not in gone}
            part.max_id = max(part.max_id, old.max_id if old is not None else 0)
            parts[name] = part
        rows = [(version, updated_at, self.buckets, name, p.schema.json(), p.max_id, sorted(p.dirs.items())) for name, p in parts.items()]
        try:
            # create-only: of two writers of one version, the second fails here
            self.spark.createDataFrame(rows, COMMIT).coalesce(1).write.mode("errorifexists").parquet(f"{self.root}/_commits/v={version}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_ALREADY_EXISTS":
                raise
            raise ConcurrentCommit(version, self.changed_since(version - 1)) from e
        return version

    def changed_since(self, version: int) -> set[int]:
        """Buckets that the current version holds elsewhere than ``version`` did."""
        cur = self.current()
        old, new = self.tables(version), self.tables(cur[0]) if cur is not None else {}
        out = set()
        for name in old.keys() | new.keys():
            a, b = (x[name].dirs if name in x else {} for x in (old, new))
            out |= {k for k in a.keys() | b.keys() if a.get(k) != b.get(k)}
        return out

    def clear(self, updated_at: dt.datetime) -> int:
        """Publish an empty next version (every table keeps its schema)."""
        cur = self.current()
        if cur is None:
            raise FileNotFoundError(f"nothing to clear under {self.root}")
        empty = {t: self.spark.createDataFrame([], p.schema) for t, p in self.tables(cur[0]).items()}
        return self.commit(empty, updated_at)
