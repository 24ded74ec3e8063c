"""Sharding by size-tiered compaction.

Arrivals are appended as small immutable runs. Compaction looks at the runs by size tier (powers
of four): where a tier holds at least ``fanout`` runs, they are merged in order into files of about
the target size. A manifest lists the live shards; a new one is written aside and renamed into
place, so a reader sees the old or the new version and never a mixture. Each writer's data go into a
folder of a name of its own, so a writer that lost a race or an executor leaves nothing but files that
no manifest names, and never touches those of another.

Only the runs that are merged are read and moved, each once, to the task that writes their target file: target files
are numbered and the tasks with them, so no task gets more than one (at most one and a half target
sizes). Everything is DataFrame code. The folders of the live shards are listed on the driver, as
the files of any scan are.

Edge cases: a null text counts no bytes; rows with a null run key form one run; repeated rows are
kept; an empty table commits an empty manifest; extra columns are stored as they are, whatever their
names (a reader chooses the prefix of the manifest's columns).
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm.shared import free, land, small_enough, whole

MANIFEST = "shard_id string, folder string, run long, tier int, n_rows long, n_bytes long, version int"


def tier(n_bytes: Column, base: int) -> Column:
    """0 below ``base`` bytes, then one tier for each factor of four; whole-number arithmetic."""
    return F.floor(F.length(F.bin(F.floor(n_bytes / F.lit(base)).cast("long"))) / 2).cast("int")


class ShardStore:
    """Versioned shards in one folder of any file system that Spark writes to."""

    def __init__(self, spark: SparkSession, root: str, target_bytes: int = 64 << 20, fanout: int = 4, base_bytes: int = 64 << 10, span: int = 1024):
        self.spark, self.root = spark, root.rstrip("/")
        self.target_bytes, self.fanout, self.base_bytes, self.span = target_bytes, fanout, base_bytes, span

    # -------------------------------------------------------------- manifest

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _fs(self):
        return self._path("").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The newest committed version, 0 if none is."""
        folder = self._path("manifest")
        if not self._fs().exists(folder):
            return 0
        names = [x.getPath().getName() for x in self._fs().listStatus(folder)]
        return max([0, *(int(n[1:]) for n in names if n.startswith("v"))])

    def manifest(self, version: int | None = None) -> DataFrame:
        version = self.version() if version is None else version
        if version == 0:
            return self.spark.range(0).select(*[F.lit(None).cast(kind).alias(name) for name, kind in (x.split() for x in MANIFEST.split(", "))])
        return self.spark.read.schema(MANIFEST).parquet(f"{self.root}/manifest/v{version:09d}")

    def _commit(self, shards: DataFrame, base: int) -> int:
        """Publish the version after ``base``: written aside, then renamed; the rename fails if the version exists."""
        aside, final = self._path(f"aside/{uuid.uuid4().hex}"), self._path(f"manifest/v{base + 1:09d}")
        shards.withColumn("version", F.lit(base + 1)).coalesce(1).write.parquet(aside.toString())
        self._fs().mkdirs(final.getParent())
        jvm, gateway = self.spark._jvm, self.spark.sparkContext._gateway
        plain = gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self.spark._jsc.hadoopConfiguration()).rename(aside, final, plain)
        return base + 1

    # -------------------------------------------------------------- writing

    def append(self, docs: DataFrame, run: Column, text_col: str = "text", gather: bool = False) -> int:
        """Write arrivals, each run a folder of its own, and commit them as new shards.

        Rows stay in the tasks that read them, so a run is as many files as tasks have rows of it. Where
        the rows of a run do not lie together, ``gather`` shuffles them first, a task for about each target size.
        """
        base = self.version()
        top = f"data/{uuid.uuid4().hex}"
        (key,) = free(docs.columns, "run")
        rows = docs.withColumn(key, F.coalesce(run.cast("long"), F.lit(-1)))
        sizes = rows.groupBy(F.col(key).alias("run")).agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.octet_length(whole(text_col))).alias("n_bytes"))
        if gather:
            parts, number = free(rows.columns, "parts", "number")
            wide = sizes.select(F.col("run").alias(key), F.ceil(F.col("n_bytes") / self.target_bytes).alias(parts))
            rows = rows.join(small_enough(wide, 24), key).withColumn(number, F.pmod(F.xxhash64(whole(text_col)), F.greatest(parts, F.lit(1))))
            rows = rows.repartition(key, number).drop(parts, number)
        rows.write.option("compression", "zstd").partitionBy(key).parquet(f"{self.root}/{top}")
        new = sizes.select(
            F.format_string("v%d-run%d", F.lit(base + 1), "run").alias("shard_id"),
            F.format_string(f"{top}/{key}=%d", "run").alias("folder"),
            "run",
            tier(F.col("n_bytes"), self.base_bytes).alias("tier"),
            "n_rows",
            "n_bytes",
        )
        return self._commit(self.manifest(base).drop("version").unionByName(new), base)

    def plan(self, version: int) -> DataFrame:
        """The manifest with ``into``: the shard a run is merged into, null if it stays.

        Runs of at least half the target stay. The rest, by tier and span of run numbers, are laid
        end to end from small to large and cut at multiples of the target size.
        """
        shards = self.manifest(version).withColumn("part", F.floor(F.col("run") / self.span))
        small = F.col("n_bytes") * 2 < self.target_bytes
        group = Window.partitionBy("tier", "part")
        line = group.orderBy("n_bytes", "run", "shard_id")
        runs = shards.where(small).withColumn("runs", F.count(F.lit(1)).over(group))
        runs = runs.withColumn("file", F.floor((F.sum("n_bytes").over(line) - F.col("n_bytes")) / self.target_bytes))
        runs = runs.withColumn("mates", F.count(F.lit(1)).over(Window.partitionBy("tier", "part", "file")))
        name = F.format_string("v%d-tier%d-part%d-file%d", F.lit(version + 1), "tier", "part", "file")
        runs = runs.withColumn("into", F.when((F.col("runs") >= self.fanout) & (F.col("mates") > 1), name)).drop("runs", "file", "mates")
        return runs.unionByName(shards.where(~small).withColumn("into", F.lit(None).cast("string"))).drop("part")

    def compact(self, schema, text_col: str = "text") -> int:
        """Merge similarly sized runs into target-sized files and commit; returns the new version."""
        base = self.version()
        plan = self.plan(base)
        names = self._names(schema)
        shard, at, folder, number = free(names, "shard", "at", "folder", "number")
        merged = plan.where("into is not null").select(F.col("folder").alias(folder), F.col("into").alias(shard))
        # one row a target file
        targets = merged.select(shard).distinct().withColumn(number, F.row_number().over(Window.orderBy(shard)) - 1)
        merged = land(merged.join(targets, shard), "merged")
        files, new = merged.agg(F.max(number)).first()[0], f"data/{uuid.uuid4().hex}"
        if files is not None:
            rows = self._scan(schema, at, merged.select(folder)).join(small_enough(merged, 168), F.col(at) == F.col(folder)).drop(at, folder)
            rows = rows.repartitionById(files + 1, F.col(number)).drop(number)
            rows.write.option("compression", "zstd").partitionBy(shard).parquet(f"{self.root}/{new}")
        grown = plan.where("into is not null").groupBy("into").agg(F.sum("n_rows").alias("n_rows"), F.sum("n_bytes").alias("n_bytes"), F.min("run").alias("run"))
        grown = grown.select(
            F.col("into").alias("shard_id"), F.format_string(f"{new}/{shard}=%s", "into").alias("folder"), "run", tier(F.col("n_bytes"), self.base_bytes).alias("tier"), "n_rows", "n_bytes"
        )
        return self._commit(plan.where("into is null").drop("into", "version").unionByName(grown), base)

    # -------------------------------------------------------------- reading

    @staticmethod
    def _names(schema) -> list[str]:
        return list(schema.names) if hasattr(schema, "names") else [f.split()[0] for f in schema.split(",")]

    def _scan(self, schema, folder: str, folders: DataFrame) -> DataFrame:
        """The rows of the shards in these folders, each with its folder."""
        paths = [f"{self.root}/{r[0]}" for r in folders.toLocalIterator()]
        rows = self.spark.read.schema(schema)
        if not paths:
            kind = schema if isinstance(schema, str) else ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
            return self.spark.createDataFrame([], f"{kind}, `{folder}` string")
        rows = rows.option("recursiveFileLookup", "true").parquet(*paths)
        inside = F.regexp_extract(rows.metadataColumn("_metadata")["file_path"], "(data/[^/]+/[^/=]+=[^/]+)/[^/]+$", 1)
        return rows.select("*", inside.alias(folder))

    def read(self, schema, version: int | None = None, prefix: str = "shard_") -> DataFrame:
        """The live rows of a version with their shard's manifest columns, whose names start with ``prefix``."""
        columns = {"id": "shard_id", "tier": "tier", "rows": "n_rows", "bytes": "n_bytes", "version": "version"}
        at, folder = free([*self._names(schema), *(prefix + c for c in columns)], "at", "folder")
        shards = self.manifest(version).select(F.col("folder").alias(folder), *(F.col(c).alias(prefix + n) for n, c in columns.items()))
        return self._scan(schema, at, shards.select(folder)).join(small_enough(shards, 200), F.col(at) == F.col(folder)).drop(at, folder)

    def vacuum(self) -> None:
        """Delete data folders that the newest manifest does not name; not while others write."""
        live = {r.top for r in self.manifest().select(F.substring_index("folder", "/", 2).alias("top")).distinct().toLocalIterator()}
        for entry in self._fs().listStatus(self._path("data")) if self._fs().exists(self._path("data")) else []:
            if f"data/{entry.getPath().getName()}" not in live:
                self._fs().delete(entry.getPath(), True)
