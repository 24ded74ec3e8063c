"""Intermediate tables that several consumers read, and exact order statistics over them."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, MapType, StringType, StructField, StructType


def stored(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder that ``spark.checkpoint.dir`` names, without its lineage.

    Only a local session without that setting gets a temporary folder; a cluster must name one.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        shared = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not shared:
            if not context.master.startswith("local") or "cluster" in context.master:
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            shared = tempfile.mkdtemp(prefix="quern-")
        context.setCheckpointDir(shared)
        _gone_at_exit(df.sparkSession, context.getCheckpointDir())
    return df.checkpoint()


def landed(df: DataFrame, tag: str) -> DataFrame:
    """``df`` computed once and kept beside the stored tables as compressed columns, of which later scans read what they need: for wide rows."""
    path = scratch_folder(df.sparkSession, tag)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _gone_at_exit(spark, path: str) -> None:
    """The file system deletes the folder when the driver's JVM ends."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(where)
    fs.deleteOnExit(where)


#: A stored table is broadcast only if its values were summed up and take at most so many bytes.
BROADCAST_BYTES = 16 << 20


def _bytes(field: StructField) -> Column:
    """About what a value takes in memory."""
    value, kind = F.col(f"`{field.name}`"), field.dataType
    if isinstance(kind, (StringType, BinaryType)):
        return F.coalesce(F.octet_length(value), F.lit(0)) + 16
    if isinstance(kind, ArrayType) and not isinstance(kind.elementType, (StringType, BinaryType, ArrayType, StructType, MapType)):
        return F.coalesce(F.size(value), F.lit(0)) * 8 + 24
    if isinstance(kind, (ArrayType, StructType, MapType)):
        return F.coalesce(F.octet_length(F.to_json(F.struct(value))), F.lit(0)) + 64
    return F.lit(8)


def few(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """A stored table, marked for broadcast if its values were measured and take at most ``limit`` bytes."""
    size = df.agg(F.sum(sum((_bytes(f) for f in df.schema.fields), F.lit(16)))).first()[0]
    return F.broadcast(df) if (size or 0) <= limit else df


def order_statistics(rows: DataFrame, keys: Sequence[str], value: str, places: Sequence[str]) -> DataFrame:
    """(keys..., n, p): for each group the values at the given places of its sorted values, an array in their order.

    ``places`` are SQL expressions of n, the number of values that are not null, counting from 0; at a
    place between two values the result lies between them in proportion. Equal values are counted
    before anything moves, and groups are spread over tasks by ranges of values, so neither a large
    group nor a frequent value is gathered anywhere.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("__v")).agg(F.count(F.lit(1)).alias("__c"))
    held = stored(counts.repartitionByRange(*keys, "__v").withColumn("__part", F.spark_partition_id()))
    group = Window.partitionBy(*keys)
    parts = held.groupBy(*keys, "__part").agg(F.sum("__c").alias("__held"))
    parts = parts.withColumn("__before", F.sum("__held").over(group.orderBy("__part")) - F.col("__held")).withColumn("n", F.sum("__held").over(group)).drop("__held")
    names = {k: f"__k{i}" for i, k in enumerate(keys)}
    parts = parts.withColumnsRenamed({**names, "__part": "__p"})
    same = F.col("__part") == F.col("__p")
    for k, other in names.items():
        same = same & F.col(k).eqNullSafe(F.col(other))
    inside = Window.partitionBy(*keys, "__part").orderBy("__v")
    placed = held.join(parts, same).withColumn("__start", F.col("__before") + F.sum("__c").over(inside) - F.col("__c"))
    at = lambda place: F.max(F.when((F.col("__start") <= place) & (place < F.col("__start") + F.col("__c")), F.col("__v")))
    picked = []
    for k, place in enumerate(places):
        where = F.expr(f"cast({place} as double)")
        picked += [at(F.floor(where)).alias(f"__low{k}"), at(F.ceil(where)).alias(f"__high{k}")]
    found = placed.groupBy(*keys, "n").agg(*picked)
    between = []
    for k, place in enumerate(places):
        part = F.expr(f"cast({place} as double)") - F.floor(F.expr(f"cast({place} as double)"))
        between.append(F.when(part == 0, F.col(f"__low{k}")).otherwise(F.col(f"__low{k}") * (1 - part) + F.col(f"__high{k}") * part))
    return found.select(*keys, "n", F.array(*between).alias("p"))


def percentiles(rows: DataFrame, keys: Sequence[str], value: str, shares: Sequence[float]) -> DataFrame:
    """(keys..., n, p): interpolated percentiles of each group."""
    return order_statistics(rows, keys, value, [f"(n - 1) * {share}D" for share in shares])


def join_groups(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``left`` with the other columns of ``right``, matched on keys that may be null; groups of ``left`` all stay."""
    if not keys:
        return left.join(right, how="left")
    other = right.withColumnsRenamed({k: f"__k{i}" for i, k in enumerate(keys)})
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    return left.join(other, same, "left").drop(*(f"__k{i}" for i in range(len(keys))))


def scratch_folder(spark, tag: str) -> str:
    """A new folder's path beside the stored tables, deleted with them."""
    stored(spark.range(0))
    return f"{spark.sparkContext.getCheckpointDir().rstrip('/')}/{tag}-{uuid.uuid4().hex}"
