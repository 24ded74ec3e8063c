"""Exact deduplication as a stateful stream.

Arrivals are logged as narrow rows (id, SHA-256 digest, arrival, content locator). A Structured
Streaming aggregation consumes the log; its keyed state lives in RocksDB on the executors' disks,
has no watermark and so never expires, and holds for each digest the number of rows seen and the
identifier and locator of the row that stays. A locator is the file and the place in it where the
row's content is stored: an arrival that is a plain file scan is located where it lies, any other is
written to the log's folder first. A digest that was hit has the full bytes of its rows compared,
those of earlier arrivals fetched by their locators, so a digest clash can never drop a document.

Everything is DataFrame code; the stream's sink only writes a table.

Edge cases: a null text counts as empty; null ids take part, and lose to any other id; repeated
rows are separate rows of one group, of which one stays; an empty input gives an empty result;
other columns are not looked at, whatever their names. Files of earlier arrivals must stay where
they were. An arrival that is given again under its name, as after a failure anywhere, is the same arrival: what it left
is used or written anew, and it counts once (give it again before the next one). Several writers get arrivals of their own.
"""

from __future__ import annotations

import hashlib
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.shared import LOCATOR, _file_system, drop_rows, exists, file_hash, join_spread, land, located, locator, remove, scratch_path, small_enough, whole

_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_STORE = {
    "spark.sql.streaming.stateStore.providerClass": _ROCKS,
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "64",
    # a store is closed when its task has committed: open ones hold memory and preallocated files
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}

_LOG = f"id long, digest binary, arrival int, locator {LOCATOR}"
_KEEP = f"struct<id:bigint,arrival:int,locator:{LOCATOR}>"
#: The texts behind a digest that stands for several: one row a text.
_APART = f"digest binary, text string, n long, keep {_KEEP}, arrival int"
_FILES = "file long, path string, text_col string, arrival int"


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _best() -> Column:
    return F.max(F.struct("id", "arrival", "locator")).alias("keep")


class DedupLog:
    """Digest log plus the stream's state, both in one folder that can be appended to forever.

    ``files_per_batch`` bounds a micro-batch. A restart after a failure resumes from the stream's
    own checkpoint: a batch that is replayed overwrites the folder it wrote before.
    """

    def __init__(self, spark, root: str, files_per_batch: int = 64, digest=sha256):
        self.spark, self.root, self.files_per_batch, self.digest = spark, root.rstrip("/"), files_per_batch, digest

    def _read(self, name: str, schema: str) -> DataFrame:
        if not exists(self.spark, f"{self.root}/{name}"):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}")

    def _file(self, inside: str):
        return _file_system(self.spark, f"{self.root}/{inside}")

    def _claim(self, inside: str, content: str) -> bool:
        """Create a small file; False if it is there already."""
        where, fs = self._file(inside)
        try:
            out = fs.create(where, False)
        except Py4JJavaError as error:
            if "AlreadyExists" in error.java_exception.getClass().getName():
                return False
            raise
        out.write(content.encode())
        out.close()
        return True

    def _number(self, name: str) -> int:
        """The arrival's number: the one its name has already, or the next that no writer has."""
        known = f"arrivals/{hashlib.sha256(name.encode()).hexdigest()}"
        where, fs = self._file(known)
        if not fs.exists(where):
            pattern, _ = self._file("numbers/*")
            number = max((int(x.getPath().getName()) for x in fs.globStatus(pattern) or []), default=0) + 1
            while not self._claim(f"numbers/{number:09d}", name):
                number += 1
            if self._claim(known, str(number)):
                return number
        stream = fs.open(where)
        try:
            return int(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def log(self, arrival: int | None = None) -> DataFrame:
        """The rows of an arrival, or of all of them."""
        inside = "log" if arrival is None else f"log/{arrival:09d}"
        if not exists(self.spark, f"{self.root}/{inside}"):
            return self.spark.createDataFrame([], _LOG)
        return self.spark.read.schema(_LOG).option("recursiveFileLookup", "true").parquet(f"{self.root}/{inside}")

    def append(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None, name: str | None = None) -> tuple[DataFrame, str, int]:
        """Log an arrival (``row_col``: one that ``located`` returned); returns it as ``located`` does, and its number.

        ``name`` tells arrivals apart, so that one given again counts once; without a name every call is an arrival of its own.
        """
        arrival = self._number(name or uuid.uuid4().hex)
        logged, content = exists(self.spark, f"{self.root}/log/{arrival:09d}"), f"{self.root}/content/{arrival}"
        if row_col:
            row = row_col
        elif logged and exists(self.spark, content):
            docs, row = located(self.spark.read.schema(docs.schema).parquet(content))
        else:
            if exists(self.spark, content):
                remove(self.spark, content)
            docs, row = located(docs, content)
        if logged:
            return docs, row, arrival
        jvm = self.spark._jvm
        files = [(address, jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(address)).toString(), text_col) for address in docs.inputFiles()]
        files = self.spark.createDataFrame(files, "address string, path string, text_col string").withColumn("file", file_hash(F.col("address")))
        files.select("file", "path", "text_col").coalesce(1).write.mode("overwrite").parquet(f"{self.root}/files/arrival={arrival}")
        rows = docs.select(F.col(id_col).cast("long").alias("id"), self.digest(whole(text_col)).alias("digest"), F.lit(arrival).alias("arrival"), F.col(row).alias("locator"))
        aside, final = f"{self.root}/aside/{uuid.uuid4().hex}", f"{self.root}/log/{arrival:09d}"
        rows.write.parquet(aside)
        # the stream sees an arrival as a whole or not at all
        (source, _), (target, fs) = _file_system(self.spark, aside), _file_system(self.spark, final)
        fs.mkdirs(target.getParent())
        plain = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self.spark._jsc.hadoopConfiguration()).rename(source, target, plain)
        return docs, row, arrival

    def update(self) -> None:
        """Let the stream take in what was appended since it last ran."""
        conf, seen = self.spark.conf, f"{self.root}/updates"
        before = {k: conf.get(k, None) for k in _STORE}
        try:
            for k, v in _STORE.items():
                conf.set(k, v)
            arrivals = self.spark.readStream.schema(_LOG).option("maxFilesPerTrigger", self.files_per_batch).option("recursiveFileLookup", "true").parquet(f"{self.root}/log")
            state = arrivals.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), _best())
            query = (
                state.writeStream.outputMode("update")
                .option("checkpointLocation", f"{self.root}/stream")
                .foreachBatch(lambda batch, k: batch.write.mode("overwrite").parquet(f"{seen}/batch={k}"))
                .trigger(availableNow=True)
                .start()
            )
            query.awaitTermination()
        finally:
            for k, v in before.items():
                conf.unset(k) if v is None else conf.set(k, v)

    def state(self) -> DataFrame:
        """The newest state of each digest: digest, n, keep (id, arrival and locator)."""
        updates = self._read("updates", f"digest binary, n long, keep {_KEEP}, batch int")
        return updates.groupBy("digest").agg(F.max("n").alias("n"), F.max("keep").alias("keep"))

    def fetch(self, kept: DataFrame) -> DataFrame:
        """``kept`` (with ``keep``) and the text that each locator leads to; only files that hold one are read."""
        files = self._read("files", _FILES).join(kept.select(F.col("keep.arrival").alias("arrival"), F.col("keep.locator.file").alias("file")).distinct(), ["arrival", "file"])
        out = None
        for column in [r.text_col for r in files.select("text_col").distinct().toLocalIterator()]:
            # the list of files, not of documents
            paths = [r.path for r in files.where(F.col("text_col") == column).select("path").distinct().toLocalIterator()]
            scan = self.spark.read.schema(f"`{column}` string").parquet(*paths)
            texts = scan.select(whole(f"`{column}`").alias("text"), locator(scan).alias("place"))
            found = texts.join(small_enough(kept, 120), F.col("place") == F.col("keep.locator")).drop("place")
            out = found if out is None else out.unionByName(found)
        return out if out is not None else kept.withColumn("text", F.lit(""))

    def clashes(self, docs: DataFrame, arrival: int, row: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """Compare the full texts behind every digest that this arrival hit; the rows of ``_APART`` where they differ.

        Grouping by the text itself compares its bytes and combines copies before the shuffle, so a hot group costs one row
        a task. Of earlier arrivals one text stands for a digest, fetched by its locator, or each of its texts if they were
        found to differ before.
        """
        hits = land(self.state().where("n > 1").select("digest"), "hits")
        rows = docs.select(F.col(id_col).cast("long").alias("id"), whole(text_col).alias("text"), F.lit(arrival).alias("arrival"), F.col(row).alias("locator"))
        rows = rows.withColumn("digest", self.digest(F.col("text"))).join(small_enough(hits, 64), "digest", "left_semi")
        groups = rows.groupBy("digest", "text").agg(F.count(F.lit(1)).alias("n"), _best())
        if arrival > 1:
            now = self.log(arrival).select("digest").distinct()
            known = self._read("apart", _APART).where(F.col("arrival") < arrival)
            newest = known.groupBy("digest").agg(F.max("arrival").alias("arrival"))
            known = land(known.join(newest, ["digest", "arrival"]).select("digest", "text", "n", "keep"), "apart")
            before = self.log().where(F.col("arrival") < arrival).join(small_enough(hits, 64), "digest", "left_semi").join(now, "digest", "left_semi")
            before = before.join(known.select("digest").distinct(), "digest", "left_anti").groupBy("digest").agg(F.count(F.lit(1)).alias("n"), _best())
            before = self.fetch(land(before, "before")).select("digest", "text", "n", "keep")
            groups = groups.unionByName(before).unionByName(known.join(now, "digest", "left_semi"))
            groups = groups.groupBy("digest", "text").agg(F.sum("n").alias("n"), F.max("keep").alias("keep"))
        # one text a digest, but for clashes: the texts themselves are stored only then
        several = land(groups.groupBy("digest").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1").select("digest"), "several")
        if several.isEmpty():
            return self.spark.createDataFrame([], _APART)
        apart = land(groups.join(several, "digest", "left_semi").withColumn("arrival", F.lit(arrival)), "apart")
        apart.drop("arrival").write.mode("overwrite").parquet(f"{self.root}/apart/arrival={arrival}")
        return apart


def exact_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    files_per_batch: int = 64,
    digest=sha256,
    root: str | None = None,
    row_col: str | None = None,
    name: str | None = None,
) -> DataFrame:
    """One row for each row of ``docs``: id, digest, keep_id, group_size, kept; of ``located`` rows also locator.

    Of rows with equal text the one with the largest id stays (of repeated rows of that id, one). With
    a ``root`` that has seen arrivals before, groups and the rows that stay count these too; ``name`` as in ``DedupLog.append``.
    """
    log = DedupLog(docs.sparkSession, root or scratch_path(docs.sparkSession, "exact"), files_per_batch, digest)
    docs, row, arrival = log.append(docs, id_col, text_col, row_col, name)
    log.update()
    place = ["locator"] if row_col else []
    stays = F.col("keep.id").alias("keep_id"), F.col("n").alias("group_size"), (F.struct("arrival", "locator") == F.struct("keep.arrival", "keep.locator")).alias("kept")
    rows = join_spread(log.log(arrival), land(log.state().withColumn("rows", F.col("n")), "state"), ["digest"], "rows").select("id", "digest", *stays, *place)
    apart = log.clashes(docs, arrival, row, id_col, text_col)
    if apart.isEmpty():
        return rows
    # Digests that stand for several texts: decide these rows by their bytes.
    digests = apart.select("digest").distinct()
    texts = docs.select(F.col(id_col).cast("long").alias("id"), digest(whole(text_col)).alias("digest"), whole(text_col).alias("text"), F.lit(arrival).alias("arrival"), F.col(row).alias("locator"))
    told = texts.join(apart.drop("arrival"), ["digest", "text"]).select("id", "digest", *stays, *place)
    return rows.join(digests, "digest", "left_anti").select(*told.columns).unionByName(told)


def drop_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the copies, one row of each text; columns and texts unchanged."""
    docs, row = located(docs)
    rows = exact_groups(docs, id_col, text_col, row_col=row, **options)
    return drop_rows(docs, rows.where(~F.col("kept")).select("locator"), row)


__all__ = ["DedupLog", "exact_groups", "drop_exact", "sha256"]
