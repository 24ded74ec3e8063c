"""Versions of documents by keyed state: what a delivery is compared with lies in the state store, so no batch reads the version table.

A document's state is its active hash, version and the time since when it is open. Every delivery gets an outcome (new, changed,
skipped_no_change), and the changes of a batch are appended under its number. A batch that is replayed, the first included, starts from
the state before it, has the same clock (a stream's current time is part of its offset log) and writes the same rows to the same place.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from quern import schemas
from quern.functions import text as T
from quern.operators import ingest
from quern.streaming.stateful import use_rocksdb

_CHANGE = "document_id string, version_index int, hash_payload string, body_text string, valid_us long, outcome string"


class _Active(StatefulProcessor):
    """The active version of a document."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.active = handle.getValueState("active", "hash string, version int, since_us long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        # of several deliveries of a document in a batch the newest counts
        newest = max(rows, key=lambda r: (r["updated_us"], r["hash_payload"]))
        known, index, since = self.active.get() if self.active.exists() else (None, 0, None)
        outcome = "new" if known is None else "skipped_no_change" if known == newest["hash_payload"] else "changed"
        if outcome != "skipped_no_change":
            index, since = index + 1, newest["valid_us"]
            self.active.update((newest["hash_payload"], index, since))
        yield Row(document_id=key[0], version_index=index, hash_payload=newest["hash_payload"], body_text=newest["body_text"] if outcome != "skipped_no_change" else None, valid_us=newest["valid_us"], outcome=outcome)

    def close(self) -> None:
        pass


class VersionStream:
    """JSON payloads landing in a folder become document versions; bad ones are quarantined with their error."""

    def __init__(self, spark: SparkSession, landing: str, root: str, source_type: str = "github_issue", max_files: int = 1000):
        self.spark, self.landing, self.root, self.source_type, self.max_files = spark, landing, root.rstrip("/"), source_type, max_files

    def _checked(self) -> DataFrame:
        payloads = self.spark.readStream.schema(f"{schemas.ISSUE}, _corrupt_record string").option("maxFilesPerTrigger", self.max_files).json(self.landing)
        return ingest.validate(payloads, self.source_type != "github_issue")

    def _write(self, rows: DataFrame, name: str, mode: str):
        sink = lambda batch, number: batch.write.mode("overwrite").parquet(f"{self.root}/{name}/batch={number}")
        return rows.writeStream.foreachBatch(sink).outputMode(mode).option("checkpointLocation", f"{self.root}/check-{name}").trigger(availableNow=True).start()

    def run(self) -> None:
        """Take in what has landed."""
        use_rocksdb(self.spark)
        bad = self._checked().where("error_code is not null").select("id", "html_url", "_corrupt_record", "error_field", "error_code", "error_category")
        quarantine = self._write(bad, "quarantine", "append")
        good = ingest.not_corrupt(ingest.split_valid(self._checked())[0])
        rows = ingest.to_documents(good, self.source_type)
        rows = rows.select("document_id", "hash_payload", "body_text", F.unix_micros("updated_at").alias("updated_us"), F.unix_micros("valid_from").alias("valid_us"))
        changes = rows.groupBy("document_id").transformWithState(_Active(), _CHANGE, "append", "none")
        versions = self._write(changes, "changes", "append")
        versions.awaitTermination()
        quarantine.awaitTermination()

    def _read(self, name: str, schema: str) -> DataFrame:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        if not where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where):
            return self.spark.createDataFrame([], f"{schema}, batch int")
        return self.spark.read.schema(f"{schema}, batch int").parquet(f"{self.root}/{name}")

    def outcomes(self) -> DataFrame:
        """Every delivery that counted, with its batch."""
        return self._read("changes", _CHANGE)

    def quarantined(self) -> DataFrame:
        return self._read("quarantine", "id long, html_url string, _corrupt_record string, error_field string, error_code string, error_category string")

    def versions(self) -> DataFrame:
        """The version table: each version is closed by the next."""
        rows = self.outcomes().where("outcome <> 'skipped_no_change'")
        following = F.lead("valid_us").over(Window.partitionBy("document_id").orderBy("version_index"))
        return rows.withColumn("closed", following).select(
            "document_id", T.uuid5(T.DOCUMENT_NAMESPACE, F.concat_ws(":", "document_id", F.col("version_index").cast("string"), "hash_payload")).alias("version_id"), "version_index", "body_text",
            F.lit(None).cast("string").alias("source_payload_uri"), "hash_payload", F.timestamp_micros("valid_us").alias("valid_from"), F.timestamp_micros("closed").alias("valid_to"), F.col("closed").isNull().alias("is_active"),
        )


__all__ = ["VersionStream"]
