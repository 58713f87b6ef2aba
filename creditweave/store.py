"""A data set whose tables change together: versions are manifests, published by compare-and-swap.

A writer puts its tables into folders of its own and then publishes one manifest that names them, as the version after the one it
read. The manifest appears whole, and only if nobody published that version before: of two writers that start from one version, one
wins and the other is refused, with nothing of it left behind. Readers go by a manifest, so they see all tables of one commit."""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import DataFrame, SparkSession

from .schemas import RESET_ORDER, empty

_HEAD = "_versions"


class Conflict(RuntimeError):
    """Somebody else published a version after the one that was read."""


class Store:
    """The tables in a folder that all readers and writers share; its file system must rename atomically (as HDFS and local ones do)."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path(self.folder).getFileSystem(self._conf)

    def version(self) -> int:
        """The newest published version; 0 where there is none."""
        head = self._path(f"{self.folder}/{_HEAD}")
        if not self._fs.exists(head):
            return 0
        found = [f.getPath().getName() for f in self._fs.listStatus(head)]
        return max((int(n) for n in found if n.isdecimal()), default=0)

    def manifest(self, version: int | None = None) -> dict[str, str]:
        """Folders of the tables of a version (the newest, if none is given), by name."""
        at = self.version() if version is None else version
        if not at:
            return {}
        stream = self._fs.open(self._path(f"{self.folder}/{_HEAD}/{at:012d}"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())["tables"]
        finally:
            stream.close()

    def read(self, name: str, version: int | None = None) -> DataFrame:
        """A table of a version; a known table that was never published has no rows."""
        where = self.manifest(version).get(name)
        if where is None:
            return empty(self.spark, name)
        return self.spark.read.parquet(f"{self.folder}/{where}")

    def is_populated(self, version: int | None = None) -> bool:
        """Whether any table of the data set has a row."""
        held = self.manifest(version)
        return any(name in held and not self.read(name, version).limit(1).isEmpty() for name in RESET_ORDER)

    def publish(self, base: int, tables: dict[str, DataFrame], note: str = "") -> int:
        """Publishes tables as version base + 1, together; the others stay as they are in `base`. Raises Conflict if that version
        is published already. Tables may be computed from those of `base`: no file of it is touched."""
        if self.version() != base:
            raise Conflict(f"version {base} is no longer the newest")
        run, own = uuid.uuid4().hex, {}
        for name, df in tables.items():
            own[name] = f"{name}/{run}"
            df.write.parquet(f"{self.folder}/{own[name]}")
        text = json.dumps({"tables": {**self.manifest(base), **own}, "base": base, "note": note}, sort_keys=True)
        if not self._claim(base + 1, text.encode()):
            for where in own.values():
                self._fs.delete(self._path(f"{self.folder}/{where}"), True)
            raise Conflict(f"version {base + 1} was published by another writer")
        return base + 1

    def _claim(self, version: int, text: bytes) -> bool:
        """Puts a manifest in its place, whole, unless there is one."""
        draft, final = (f"{self.folder}/{_HEAD}/{n}" for n in (f"draft-{uuid.uuid4().hex}", f"{version:012d}"))
        stream = self._fs.create(self._path(draft), False)
        try:
            stream.write(bytearray(text))
        finally:
            stream.close()
        try:
            if self._fs.getUri().getScheme() == "file":  # a local rename would replace what is there, a link does not
                os.link(self._path(draft).toUri().getPath(), self._path(final).toUri().getPath())
                return True
            return bool(self._fs.rename(self._path(draft), self._path(final)))
        except FileExistsError:
            return False
        finally:
            self._fs.delete(self._path(draft), False)

    def reset(self, base: int) -> int:
        """Publishes a version in which every table of the data set is empty; the audit log keeps its rows."""
        return self.publish(base, {name: empty(self.spark, name) for name in RESET_ORDER}, "reset")

