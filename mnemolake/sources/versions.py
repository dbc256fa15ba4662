"""A store of several tables with versions: new files first, then one manifest that makes them visible.

    root/data/<table>/<unique folder>/part-*.parquet
    root/manifests/<12-digit version>.json

A commit writes the tables that change under new folders and then creates the next manifest, which names the folder of
every table, those taken over from the version before included. Creating a file that exists fails, so of two writers
who start from one version only one commits. Until the manifest is there, and if a run fails before, readers see the old
version; files that no manifest names are swept by ``vacuum``. Everything goes through Spark and its file system API.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession


class Conflict(RuntimeError):
    """Another commit took the version number, or the store moved on since it was read."""


class VersionedTables:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _manifest(self, version: int) -> str:
        return f"{self.root}/manifests/{version:012d}.json"

    def _numbers(self) -> list[int]:
        """Manifest numbers, one per commit, also of those whose writer died half-way."""
        folder = self._path(f"{self.root}/manifests")
        if not self._fs.exists(folder):
            return []
        names = [f.getPath().getName() for f in self._fs.listStatus(folder)]
        return sorted(int(n[:12]) for n in names if n.endswith(".json") and n[:12].isdigit())

    def _read(self, version: int) -> dict | None:
        """A manifest's content; None for one that is not whole."""
        stream = self._fs.open(self._path(self._manifest(version)))
        try:
            raw = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        try:
            return json.loads(raw)
        except ValueError:
            return None

    def versions(self) -> list[int]:
        """Readable versions, oldest first."""
        return [v for v in self._numbers() if self._read(v) is not None]

    def manifest(self, version: int | None = None) -> dict:
        """Manifest of a version, the newest readable one by default; an empty store has version 0 without tables."""
        if version is not None:
            found = self._read(version) if version in self._numbers() else None
            if found is None:
                raise ValueError(f"no version {version}")
            return found
        for v in reversed(self._numbers()):
            found = self._read(v)
            if found is not None:
                return found
        return {"version": 0, "tables": {}, "note": {}}

    def tables(self, version: int | None = None) -> dict[str, DataFrame]:
        return {n: self.spark.read.parquet(path) for n, path in self.manifest(version)["tables"].items()}

    def table(self, name: str, version: int | None = None) -> DataFrame:
        return self.spark.read.parquet(self.manifest(version)["tables"][name])

    def stage(self, name: str, df: DataFrame, partition_by: list[str] | None = None) -> str:
        """Write a table's new files; they are invisible until a manifest names the folder that is returned."""
        folder = f"{self.root}/data/{name}/{uuid.uuid4().hex}"
        writer = df.write.mode("errorifexists")
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(folder)
        return folder

    def publish(self, tables: Mapping[str, str], based_on: int, note: Mapping | None = None) -> int:
        """Make ``tables`` (name: staged folder), and no others, the version after ``based_on``.

        Where the store has moved on since, or another writer is first, Conflict is raised and nothing becomes visible.
        """
        now = self.manifest()["version"]
        if now != based_on:
            raise Conflict(f"based on version {based_on}, but the store is at {now}")
        version = max([now, *self._numbers()]) + 1
        body = {"version": version, "tables": dict(tables), "note": dict(note or {})}
        try:
            out = self._fs.create(self._path(self._manifest(version)), False)
        except Exception as e:
            raise Conflict(f"version {version} is taken") from e
        try:
            out.write(bytearray(json.dumps(body).encode()))
        finally:
            out.close()
        return version

    def commit(self, changed: Mapping[str, DataFrame], based_on: int | None = None, note: Mapping | None = None) -> int:
        """Write the changed tables and make them the next version; the others stay as they are.

        ``based_on`` is the version that the change was computed from, the newest by default. ``note`` is kept in the
        manifest.
        """
        now = self.manifest()
        if based_on is not None and now["version"] != based_on:
            raise Conflict(f"based on version {based_on}, but the store is at {now['version']}")
        folders = {name: self.stage(name, df) for name, df in changed.items()}
        return self.publish({**now["tables"], **folders}, now["version"], note)

    def vacuum(self, keep: int = 1) -> list[str]:
        """Delete data folders that none of the newest ``keep`` versions names; returns them. No writer may be at work."""
        kept = self.versions()[-keep:] if keep else []
        named = {p for v in kept for p in self.manifest(v)["tables"].values()}
        gone = []
        top = self._path(f"{self.root}/data")
        for table in self._fs.listStatus(top) if self._fs.exists(top) else []:
            for folder in self._fs.listStatus(table.getPath()):
                path = f"{self.root}/data/{table.getPath().getName()}/{folder.getPath().getName()}"
                if path not in named:
                    self._fs.delete(folder.getPath(), True)
                    gone.append(path)
        for v in self._numbers():
            if v not in kept and kept and v < kept[0]:
                self._fs.delete(self._path(self._manifest(v)), False)
        return gone
