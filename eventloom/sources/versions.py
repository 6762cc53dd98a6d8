"""Versions of a table in a folder: rows are written beside the old ones, and one small file then says which are the table.

``data/part=<id>`` holds rows, written once and never changed. ``_manifests/<number>.json`` lists the parts of a version, and
the newest number is the table: a job that fails before it writes that file changes nothing for readers, and a reader that
has begun goes on with the parts it knows. Parts that neither the newest version nor the one before it lists are removed.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from py4j.java_gateway import JavaObject
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

KEPT_VERSIONS = 2


class ConcurrentChange(RuntimeError):
    """Another job has published a version since this one read the table."""


@dataclass(frozen=True)
class Version:
    """``number`` 0 is a table that has none yet. ``files`` is where the ledger of imported files lies, if there is one."""

    number: int = 0
    parts: tuple[str, ...] = field(default=())
    files: str | None = None


class VersionedFolder:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _at(self, *names: str) -> JavaObject:
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *names]))

    def _system(self) -> JavaObject:
        return self._at().getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def part_path(self, part: str) -> str:
        return f"{self.path}/data/part={part}"

    def files_path(self, name: str) -> str:
        return f"{self.path}/_files/{name}"

    def _numbers(self) -> list[int]:
        folder, system = self._at("_manifests"), self._system()
        if not system.exists(folder):
            return []
        names = (status.getPath().getName() for status in system.listStatus(folder))
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith("."))

    def _read(self, number: int) -> Version:
        stream = self._system().open(self._at("_manifests", f"{number}.json"))
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        known = json.loads(text)
        return Version(number, tuple(known["parts"]), known["files"])

    def newest(self) -> Version:
        numbers = self._numbers()
        return self._read(numbers[-1]) if numbers else Version()

    def new_part(self) -> str:
        return f"p{uuid.uuid4().hex}"

    def publish(self, before: Version, parts: tuple[str, ...], files: str | None = None) -> Version:
        """Make ``parts`` the table, in one step. ``before`` is the version that the change was made from."""
        system, after = self._system(), Version(before.number + 1, parts, files)
        draft, place = self._at("_manifests", f".{uuid.uuid4().hex}"), self._at("_manifests", f"{after.number}.json")
        stream = system.create(draft, False)
        try:
            stream.writeBytes(json.dumps({"parts": parts, "files": files}))
        finally:
            stream.close()
        if self._numbers()[-1:] > [before.number] or not system.rename(draft, place):
            system.delete(draft, False)
            raise ConcurrentChange(f"{self.path} has a version after {before.number}")
        self._clean()
        return after

    def _clean(self) -> None:
        """Remove what only versions before the last few list, and those versions' manifests."""
        system, numbers = self._system(), self._numbers()
        old, kept = numbers[:-KEPT_VERSIONS], [self._read(n) for n in numbers[-KEPT_VERSIONS:]]
        parts, files = {p for v in kept for p in v.parts}, {v.files for v in kept}
        for number in old:
            version = self._read(number)
            for part in set(version.parts) - parts:
                system.delete(self._at("data", f"part={part}"), True)
            if version.files and version.files not in files:
                system.delete(self._at("_files", version.files), True)
            system.delete(self._at("_manifests", f"{number}.json"), False)

    def read(self, schema: StructType, version: Version | None = None) -> DataFrame:
        """The rows of a version, the newest if none is named; its schema is known, so no file is opened to find it."""
        version = version or self.newest()
        if not version.number:  # a plain folder of parquet files, or none, which is an error
            return self.spark.read.schema(schema).parquet(self.path)
        if not version.parts:
            return self.spark.createDataFrame([], schema)
        paths = [self.part_path(p) for p in version.parts]
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/data").parquet(*paths)
