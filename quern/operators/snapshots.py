"""Tables that change together: data folders of unique names, and one manifest a version that names them.

A writer puts its data into new folders, which nobody sees, and then publishes the next version with one rename, which fails
if another writer was faster; so a version is there as a whole or not at all, and no version ever changes. What a writer that was lost
had put aside is named by no manifest; ``vacuum`` deletes it.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


class Conflict(RuntimeError):
    """The version exists already: another writer was faster, or the same batch was committed before."""


def _count(observation: Observation, name: str) -> int:
    """What a job has counted; a plan that is known to have no rows counts nothing."""
    try:
        return observation.get[name]
    except (Py4JJavaError, KeyError):
        return 0


class Snapshots:
    """Versions of a set of tables (name: schema) in one folder. A part is a folder of a table, with facts about it that the writer gave."""

    def __init__(self, spark: SparkSession, root: str, schemas: Mapping[str, str]):
        self.spark, self.root, self.schemas = spark, root.rstrip("/"), dict(schemas)

    def _path(self, inside: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{inside}")

    def _fs(self):
        return self._path("x").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The newest version, 0 before the first."""
        found = self._fs().globStatus(self._path("manifest/*.json")) or []
        return max((int(x.getPath().getName()[:-5]) for x in found), default=0)

    def parts(self, version: int | None = None) -> dict[str, list[dict]]:
        """The parts of each table: ``folder`` and facts."""
        version = self.version() if version is None else version
        if version == 0:
            return {name: [] for name in self.schemas}
        stream = self._fs().open(self._path(f"manifest/{version:09d}.json"))
        try:
            return {name: [] for name in self.schemas} | json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def read(self, name: str, version: int | None = None) -> DataFrame:
        return self.scan(name, self.parts(version)[name])

    def scan(self, name: str, parts: Sequence[dict]) -> DataFrame:
        """The rows of some parts of a table."""
        if not parts:
            return self.spark.createDataFrame([], self.schemas[name])
        rows = self.spark.read.schema(self.schemas[name]).option("basePath", f"{self.root}/data/{name}")
        return rows.parquet(*(f"{self.root}/{p['folder']}" for p in parts)).select(*self._columns(name))

    def _columns(self, name: str) -> list[str]:
        return self.spark.createDataFrame([], self.schemas[name]).columns

    def put(self, name: str, rows: DataFrame, partition_by: Sequence[str] = (), options: Mapping[str, str] | None = None, **facts) -> dict:
        """Write rows as a part that no version has yet; all parts of a table are partitioned by the same columns."""
        folder = f"data/{name}/part={uuid.uuid4().hex}"
        counted = Observation()
        writer = rows.select(*self._columns(name)).observe(counted, F.count(F.lit(1)).alias("rows")).write.options(**(options or {}))
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(f"{self.root}/{folder}")
        return {"folder": folder, "rows": _count(counted, "rows"), **facts}

    # ------------------------------------------------------------ changes that say what they did

    def insert(self, name: str, incoming: DataFrame, keys: Sequence[str]) -> dict[str, int]:
        """Publish incoming rows whose key the table does not have, each key once; returns version, inserted and skipped, counted by the job that writes."""
        base = self.version()
        parts, offered = self.parts(base)[name], Observation()
        seen = incoming.observe(offered, F.count(F.lit(1)).alias("n"))
        fresh = seen.dropDuplicates(list(keys)).join(self.scan(name, parts).select(*keys), list(keys), "left_anti")
        part = self.put(name, fresh)
        version = self.commit(base, {name: [*parts, part]})
        return {"version": version, "inserted": part["rows"], "skipped": _count(offered, "n") - part["rows"]}

    def delete(self, name: str, gone: DataFrame, keys: Sequence[str]) -> dict[str, int]:
        """Publish the table without the rows of these keys; returns version and deleted. Only parts that hold such rows are written anew."""
        base = self.version()
        parts, deleted = self.parts(base)[name], 0
        out = []
        for part in parts:
            rows = self.scan(name, [part])
            if rows.join(gone.select(*keys), list(keys), "left_semi").isEmpty():
                out.append(part)
                continue
            left = self.put(name, rows.join(gone.select(*keys), list(keys), "left_anti"))
            deleted += part["rows"] - left["rows"]
            out.append({**part, **left})
        return {"version": self.commit(base, {name: out}), "deleted": deleted}

    def commit(self, base: int, tables: Mapping[str, Sequence[dict]]) -> int:
        """Publish the version after ``base`` with these parts; tables that are not named keep those of ``base``."""
        return self._publish(base + 1, {**self.parts(base), **{name: list(parts) for name, parts in tables.items()}})

    def _publish(self, number: int, content: dict) -> int:
        aside, final = self._path(f"aside/{uuid.uuid4().hex}"), self._path(f"manifest/{number:09d}.json")
        fs, jvm = self._fs(), self.spark._jvm
        out = fs.create(aside, True)
        out.write(json.dumps(content).encode())
        out.close()
        fs.mkdirs(final.getParent())
        plain = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self.spark._jsc.hadoopConfiguration()).rename(aside, final, plain)
        except Py4JJavaError as error:
            fs.delete(aside, False)
            if "FileAlreadyExists" in error.java_exception.getClass().getName():
                raise Conflict(f"version {number} of {self.root} exists") from None
            raise
        return number

    def vacuum(self, keep: int = 1) -> int:
        """Delete data that none of the newest ``keep`` versions names, and older manifests; not while others write. Returns the folders deleted."""
        newest, gone = self.version(), 0
        live = {p["folder"] for v in range(max(1, newest - keep + 1), newest + 1) for parts in self.parts(v).values() for p in parts}
        for entry in self._fs().globStatus(self._path("data/*/part=*")) or []:
            if f"data/{entry.getPath().getParent().getName()}/{entry.getPath().getName()}" not in live:
                gone += bool(self._fs().delete(entry.getPath(), True))
        for v in range(1, newest - keep + 1):
            self._fs().delete(self._path(f"manifest/{v:09d}.json"), False)
        return gone


class SnapshotTable:
    """One table in numbered versions."""

    def __init__(self, spark: SparkSession, root: str, schema: str):
        self.tables = Snapshots(spark, root, {"rows": schema})

    def version(self) -> int:
        return self.tables.version()

    def read(self, version: int | None = None) -> DataFrame:
        """A version, by default the newest; version 0 is empty."""
        return self.tables.read("rows", version)

    def write(self, rows: DataFrame, version: int | None = None) -> int:
        """Write the next version, or the one of this number; ``Conflict`` if it is there, whose rows then stay."""
        base = self.version() if version is None else version - 1
        content = {"rows": [self.tables.put("rows", rows)]}
        return self.tables._publish(base + 1, content)


__all__ = ["Conflict", "Snapshots", "SnapshotTable"]
