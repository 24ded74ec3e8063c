"""What several of the operators need: scratch tables, checked broadcasts and byte-level text kernels.

The kernels work on whole Arrow string arrays with NumPy, so no text is touched by a Python
loop over its characters.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, the only white space of the word and line contracts.
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: A side is broadcast only after its rows were counted and found to stay under this many bytes.
BROADCAST_BYTES = 16 << 20

#: Arrow batches are worked on in slices of at most this many bytes of text (or one document).
SLICE_BYTES = 1 << 20

_IS_BLANK = np.zeros(256, bool)
_IS_BLANK[[ord(c) for c in BLANKS]] = True
_LOWERED = np.arange(256, dtype=np.uint8)
_LOWERED[65:91] += 32

_roots: dict[str, str] = {}
#: Scratch folders in the order in which they were named.
_named: list[str] = []


# ---------------------------------------------------------------- scratch tables


def scratch_root(spark: SparkSession) -> str:
    """Folder for this application's scratch tables, under ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder; a cluster must name one.
    The file system deletes the folder when the driver's JVM ends, also after ``spark.stop()``.
    """
    app = spark.sparkContext.applicationId
    if app not in _roots:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared:
            if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            shared = "file://" + tempfile.mkdtemp(prefix="quern-")
        _roots[app] = f"{shared.rstrip('/')}/quern-{app}"
        where, fs = _file_system(spark, _roots[app])
        fs.mkdirs(where)
        fs.deleteOnExit(where)
    return _roots[app]


def _file_system(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    where, fs = _file_system(spark, path)
    return fs.exists(where)


def remove(spark: SparkSession, path: str) -> None:
    where, fs = _file_system(spark, path)
    fs.delete(where, True)


def scratch_path(spark: SparkSession, tag: str) -> str:
    _named.append(f"{scratch_root(spark)}/{tag}-{uuid.uuid4().hex}")
    return _named[-1]


def land(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as a scratch table and return a scan of it, which cuts the lineage."""
    path = scratch_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def land_alone(spark: SparkSession, make: Callable[[], DataFrame], tag: str) -> tuple[DataFrame, str]:
    """Land what ``make`` returns and delete all scratch folders named meanwhile; also the table's path."""
    before = len(_named)
    out = land(make(), tag)
    path = _named.pop()
    for other in _named[before:]:
        remove(spark, other)
    del _named[before:]
    return out, path


def small_enough(keys: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Mark ``keys`` for broadcast if its counted rows fit ``limit``, else leave it to a shuffle."""
    return F.broadcast(keys) if keys.limit(limit // row_bytes + 1).count() * row_bytes <= limit else keys


#: Keys that hold at least this part of all rows count as heavy, so there are at most so many of them.
HEAVY = 2048


def join_spread(rows: DataFrame, table: DataFrame, keys: list[str], weight: str, total: int | None = None) -> DataFrame:
    """Inner join of many rows with a table that has one row a key, without gathering a frequent key's rows.

    ``table[weight]`` says how many of the ``total`` rows have the key. Keys with a 2048th of the
    rows or more, of which there can only be 2048, are broadcast and their rows stay where they are;
    all others meet in a shuffle. Both inputs are read twice, so they should be scratch tables.
    """
    total = rows.count() if total is None else total
    heavy = F.col(weight) * HEAVY >= max(total, 1)
    few, rest = table.where(heavy).drop(weight), table.where(~heavy).drop(weight)
    if few.isEmpty():
        return rows.join(rest, keys)
    spread = rows.join(F.broadcast(few), keys)
    return spread.unionByName(rows.join(F.broadcast(few.select(*keys)), keys, "left_anti").join(rest, keys))


def free(columns: list[str], *names: str) -> list[str]:
    """The names, lengthened by underscores where a column has them already (in any case)."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


#: What tells a row of stored files from all others: a hash of its file's name, and its place there.
LOCATOR = "struct<file:bigint,row:bigint>"


def located(docs: DataFrame, keep: str | None = None) -> tuple[DataFrame, str]:
    """``docs`` with a column (of type ``LOCATOR``) that names each of its rows for good, and that column's name.

    Repeated rows and rows without an id can only be told apart so. The rows of a plain file scan
    are named by their files, without a copy; what else ``docs`` may be is landed first, in the folder
    ``keep`` or as a scratch table.
    """
    if docs._jdf.queryExecution().analyzed().getClass().getSimpleName() != "LogicalRelation" or not docs.inputFiles():
        if keep is None:
            docs = land(docs, "located")
        else:
            docs.write.parquet(keep)
            docs = docs.sparkSession.read.schema(docs.schema).parquet(keep)
    (name,) = free(docs.columns, "row")
    return docs.select("*", locator(docs).alias(name)), name


def file_hash(path: Column) -> Column:
    """Hash of a file's address as Spark reports it, however many slashes follow the scheme."""
    return F.xxhash64(F.regexp_replace(path, "^([A-Za-z][A-Za-z0-9+.-]*):/+", "$1:/"))


def locator(scan: DataFrame) -> Column:
    place = scan.metadataColumn("_metadata")
    return F.struct(file_hash(place["file_path"]).alias("file"), place["row_index"].alias("row"))


def drop_rows(docs: DataFrame, gone: DataFrame, row_col: str) -> DataFrame:
    """``located`` rows without those whose locator is in the one column of ``gone``; the locators go."""
    (name,) = free(docs.columns, "gone")
    gone = land(gone.toDF(name), "gone")
    return docs.join(small_enough(gone, 40), docs[row_col] == F.col(name), "left_anti").drop(row_col)


# ---------------------------------------------------------------- expressions


def whole(column: str) -> Column:
    """The text, null read as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def ascii_lower(column: Column) -> Column:
    """A-Z lower-cased and nothing else; texts that are ASCII throughout take the fast way."""
    return F.when(F.octet_length(column) == F.length(column), F.lower(column)).otherwise(F.translate(column, UPPER, LOWER))


def word_count(column: str) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` words, JVM-side."""
    return F.regexp_count(whole(column), F.lit(f"[^{BLANKS}]+")).cast("long")


def hash128(column: Column) -> list[Column]:
    """Two independently seeded 64-bit hashes; with 10^13 keys a clash has odds under 10^-12."""
    return [F.xxhash64(column).alias("h1"), F.xxhash64(F.lit("second"), column).alias("h2")]


# ---------------------------------------------------------------- Arrow kernels


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows with at most ``limit`` bytes of text (one row at least)."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    total = np.cumsum(size, dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        before = total[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(total, before + limit, "right")))
        yield batch.slice(at, end - at)
        at = end


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and the offsets of each; null reads as empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, offsets, data = texts.buffers()
    if len(texts) == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


class Words:
    """The words of a slice of texts: byte positions, and for each text the range of its words."""

    def __init__(self, texts: pa.Array):
        self.data, self.offsets = text_bytes(texts)
        n = len(self.data)
        self.solid = ~_IS_BLANK[self.data]
        edge = np.zeros(n + 1, bool)
        edge[self.offsets] = True
        before, after = np.zeros(n, bool), np.zeros(n, bool)
        if n:
            before[1:] = self.solid[:-1]
            after[:-1] = self.solid[1:]
        self.starts = np.flatnonzero(self.solid & (~before | edge[:-1]))
        self.ends = np.flatnonzero(self.solid & (~after | edge[1:])) + 1
        #: word range of text i: first[i] .. first[i + 1]
        self.first = np.searchsorted(self.starts, self.offsets)
        self.count = np.diff(self.first)

    def __len__(self) -> int:
        return len(self.starts)

    def owner(self) -> np.ndarray:
        """For each word, the text that holds it."""
        return np.repeat(np.arange(len(self.count)), self.count)

    def array(self, lowered: bool = False) -> pa.LargeStringArray:
        """The words themselves."""
        data = self.data[self.solid]
        if lowered:
            data = _LOWERED[data]
        at = np.zeros(len(self.starts) + 1, np.int64)
        np.cumsum(self.ends - self.starts, out=at[1:])
        return pa.LargeStringArray.from_buffers(len(self.starts), pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(data)))

    def joined(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Lower-cased words of each text with one space between; byte starts and ends of the words in it."""
        n = len(self.data)
        keep = self.solid.copy()
        inside = np.flatnonzero(self.ends < n)
        gap = inside[~self.solid[self.ends[inside]]]
        keep[self.ends[gap]] = True
        data = _LOWERED[self.data]
        data[self.ends[gap]] = 32
        size = self.ends - self.starts
        step = size.copy()
        step[gap] += 1
        begin = np.cumsum(step) - step
        return data[keep], begin, begin + size

    def totals(self, per_byte: np.ndarray) -> np.ndarray:
        """Sum of a value of each byte over each text."""
        run = np.zeros(len(self.data) + 1, np.int64)
        np.cumsum(per_byte, out=run[1:])
        return np.diff(run[self.offsets])
