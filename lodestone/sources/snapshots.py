"""Stored tables that change: versions written beside one another, and one small file that names the last.

A store is a folder. A commit writes its tables to a new folder, then creates the next manifest, a JSON
file that names that folder and a fingerprint of what it was made from. A manifest is created whole
under its number or not at all, so a writer that fails leaves no version, readers never see half of
one, and of two writers of one number the second is told so. Only manifests pass through the driver.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from hashlib import sha256

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from ..operators.tables import last_wins


class Conflict(RuntimeError):
    """Another writer has committed the version that this one was about to commit."""


class Store:
    """The versions of one or more tables in a folder that all executors reach."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm
        self._name = jvm.org.apache.hadoop.fs.Path
        self._files = self._name(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        at = self._name(f"{self.path}/manifests")
        if not self._files.exists(at):
            return []
        names = [f.getPath().getName() for f in self._files.listStatus(at)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict | None:
        """What a version is: its number, folder, fingerprint and tables; the last by default."""
        if version is None:
            version = next(iter(self.versions()[::-1]), None)
            if version is None:
                return None
        stream = self._files.open(self._name(f"{self.path}/manifests/{version:012d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def commit(self, tables: dict[str, DataFrame | Callable[[dict[str, DataFrame]], DataFrame]], fingerprint: str | None = None, after: int | None = None, by: str | None = None) -> dict:
        """A new version of these tables, written in order; one may be made from those before it as they
        were written, by a function of them. by: a column whose values are folders, which a filter on it
        prunes. after: the version that they were made from, the last if not
        given; where another one has followed it by then, Conflict is raised and nothing changes."""
        if after is None:
            after = (self.versions() or [0])[-1]
        folder = f"{self.path}/data/{after + 1}-{uuid.uuid4().hex}"
        done: dict[str, DataFrame] = {}
        for name, frame in tables.items():
            frame = frame(done) if callable(frame) else frame
            writer = frame.write.option("compression", "zstd")
            (writer.partitionBy(by) if by in frame.columns else writer).parquet(f"{folder}/{name}")
            done[name] = self.spark.read.schema(frame.schema).parquet(f"{folder}/{name}").select(*frame.columns)
        made = {"version": after + 1, "folder": folder, "fingerprint": fingerprint, "tables": {n: f.schema.jsonValue() for n, f in done.items()}}
        final = self._name(f"{self.path}/manifests/{after + 1:012d}.json")
        draft = self._name(f"{self.path}/manifests/.{uuid.uuid4().hex}")
        out = self._files.create(draft, False)
        out.write(bytearray(json.dumps(made).encode()))
        out.close()
        if self._files.exists(final) or not self._files.rename(draft, final):
            self._files.delete(draft, False)
            raise Conflict(f"version {after + 1} of {self.path} is there already")
        return made

    def read(self, table: str = "rows", version: int | None = None) -> DataFrame:
        found = self.manifest(version)
        if found is None or table not in found["tables"]:
            raise KeyError(f"no table {table!r} in {self.path}")
        schema = StructType.fromJson(found["tables"][table])
        return self.spark.read.schema(schema).parquet(f"{found['folder']}/{table}").select(*[f"`{c}`" for c in schema.names])

    def refreshed(self, fingerprint: str, build: Callable[[], dict[str, DataFrame]], by: str | None = None) -> bool:
        """Builds a new version where the last was made from something else; whether it did."""
        last = self.manifest()
        if last is not None and last["fingerprint"] == fingerprint:
            return False
        self.commit(build(), fingerprint, after=last["version"] if last else 0, by=by)
        return True

    def changed(self, change: Callable[[DataFrame], DataFrame], table: str = "rows") -> dict:
        """The next version of one table as a change of the last; other tables are taken along."""
        last = self.manifest()
        if last is None:
            raise KeyError(f"no version in {self.path}")
        tables = {n: self.read(n, last["version"]) for n in last["tables"]}
        tables[table] = change(tables[table])
        return self.commit(tables, last["fingerprint"], after=last["version"])

    def merge(self, upserts: DataFrame, keys: list[str], seq: str, deletes: DataFrame | None = None, table: str = "rows") -> dict:
        """The next version with rows put in by key, the greatest sequence winning over what is there and
        among themselves, and the keys of `deletes` taken out."""

        def change(rows: DataFrame) -> DataFrame:
            both = last_wins(rows.unionByName(upserts.select(*rows.columns)), keys, seq)
            return both if deletes is None else both.join(deletes.select(*keys).distinct(), keys, "left_anti").select(*rows.columns)

        return self.changed(change, table)

    def vacuum(self, keep: int = 2) -> int:
        """Removes all but the last versions and folders that no manifest names; the number of versions
        removed. Only for when no older version is being read and no writer is at work."""
        numbers = self.versions()
        gone, kept = numbers[: max(0, len(numbers) - keep)], numbers[-keep:]
        named = {self.manifest(v)["folder"].rsplit("/", 1)[1] for v in kept}
        for v in gone:
            self._files.delete(self._name(f"{self.path}/manifests/{v:012d}.json"), False)
        at = self._name(f"{self.path}/data")
        for f in self._files.listStatus(at) if self._files.exists(at) else []:
            if f.getPath().getName() not in named:
                self._files.delete(f.getPath(), True)
        return len(gone)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, in any store that Spark reaches."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def fingerprint(frame: DataFrame, *versions: str) -> str | None:
    """A mark of the files that a frame reads (names, sizes, times) and of its plan; None where it reads
    no files, so that nothing can be said. Folders are listed, no row is read."""
    spark = frame.sparkSession
    name = spark._jvm.org.apache.hadoop.fs.Path
    files = frame.inputFiles()
    if not files:
        return None
    by_folder: dict[str, set[str]] = {}
    for f in files:
        folder, _, file = f.rpartition("/")
        by_folder.setdefault(folder, set()).add(file)
    seen = []
    for folder, names in by_folder.items():
        at = name(spark._jvm.java.net.URI(folder + "/"))
        for s in at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at):
            p = s.getPath()
            if p.toUri().getRawPath().rpartition("/")[2] in names or p.getName() in names:
                seen.append(f"{p}|{s.getLen()}|{s.getModificationTime()}")
    return sha256(json.dumps([sorted(seen), frame.semanticHash(), versions]).encode()).hexdigest()

