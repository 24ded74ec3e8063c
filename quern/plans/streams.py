"""Queries that run streams with keyed state to their end and return what they have written."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from quern.operators.staging import scratch_folder
from quern.plans.common import Catalog, table
from quern.plans.layers import LAYERS, external_ids, payload_deliveries
from quern.plans.operations import OPERATIONS
from quern.streaming.pipelines import merged_sketches, sketch_quantiles, windowed_sketches
from quern.streaming.stateful import WorkQueue, status_changes
from quern.streaming.versions import VersionStream

STREAMS = Catalog()


def fail_as_told(key: str, payload: str, attempt: int) -> str | None:
    """Work that fails as often as its payload says."""
    told = json.loads(payload)
    return told["code"] if attempt <= told["fails"] else None


_FAILS = "CASE doc_id % 5 WHEN 0 THEN 2 WHEN 1 THEN 9 WHEN 2 THEN 1 ELSE 0 END"
_CODE = "CASE doc_id % 5 WHEN 0 THEN 'transient_network' WHEN 1 THEN 'transient_rate_limited' WHEN 2 THEN 'validation_malformed_json' END"


@STREAMS.add(
    f"""WITH job AS (SELECT doc_id, {_FAILS} AS fails, {_CODE} AS code FROM documents),
    tried AS (SELECT *, unnest(range(1, CASE WHEN code LIKE 'transient%' THEN least(fails + 1, 4) ELSE 1 END + 1)) AS attempt FROM job)
    SELECT doc_id::VARCHAR AS key, attempt::INTEGER AS attempt, CASE WHEN attempt > fails THEN 'delivered' WHEN code LIKE 'transient%' AND attempt <= 3 THEN 'retry' ELSE 'dead' END AS status,
           CASE WHEN attempt <= fails THEN code END AS error_code, CASE WHEN attempt <= fails AND code LIKE 'transient%' AND attempt <= 3 THEN 100 * (1 << (attempt - 1)) END::BIGINT AS wait_ms
    FROM tried"""
)
def retry_deliveries(spark, sf_dir):
    """Documents as work: some fail twice and are delivered on the third attempt, some are given up after the fourth, some at once."""
    landing, root = scratch_folder(spark, "landing"), scratch_folder(spark, "queue")
    jobs = table(spark, sf_dir, "documents").select("doc_id", F.to_json(F.struct(F.expr(_FAILS).alias("fails"), F.expr(_CODE).alias("code"), "text")).alias("payload"))
    jobs.select(F.col("doc_id").cast("string").alias("key"), "payload").write.json(landing)
    queue = WorkQueue(spark, landing, root, fail_as_told, retries=3, wait_seconds=0.1)
    queue.drain(jobs.select("doc_id").distinct().count(), seconds=1800.0, every_seconds=0.5)
    return queue.events().where("status <> 'duplicate'").select("key", "attempt", "status", "error_code", "wait_ms")


@STREAMS.add(OPERATIONS.sql["status_transition_durations"])
def ingestion_events(spark, sf_dir):
    """Status changes over three deliveries, a tenth of whose events come a delivery late, and a last one that lets the watermark pass."""
    landing, root = scratch_folder(spark, "landing"), scratch_folder(spark, "changes")
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), "event_type")
    first, last = rows.agg(F.min(F.unix_micros("ts")), F.max(F.unix_micros("ts"))).first()
    third = max(1, (last - first) // 3 + 1)
    delivered = rows.withColumn("delivery", F.least(F.lit(2), F.floor((F.unix_micros("ts") - first) / third) + (F.col("event_id") % 10 == 0).cast("int")))
    schema = "event_id long, user_id long, ts timestamp, event_type string"
    end = spark.range(1).select(F.lit(None).cast("long").alias("event_id"), F.lit(-1).cast("long").alias("user_id"), F.timestamp_micros(F.lit(last + 9 * third)).alias("ts"), F.lit("end").alias("event_type"))
    for part in [*(delivered.where(F.col("delivery") == k).drop("delivery") for k in range(3)), end]:
        part.write.mode("append").parquet(landing)
        changes = status_changes(spark.readStream.schema(schema).parquet(landing), "user_id", "ts", "event_type", f"{2 * third // 1_000_000 + 1} seconds", "event_id")
        query = changes.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/check").outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    found = spark.read.parquet(f"{root}/out").where("key <> '-1'")
    return found.select(F.col("tie").alias("event_id"), F.col("key").cast("long").alias("user_id"), F.col("status").alias("event_type"), F.coalesce("previous_status", F.lit("")).alias("previous_status"), F.coalesce("duration_since_previous_ms", F.lit(-1)).cast("long").alias("duration_since_previous_ms"))


@STREAMS.add(LAYERS.sql["ingestion_stream"])
def version_stream(spark, sf_dir):
    """Versions by keyed state, over the same deliveries as ``ingestion_stream``; the last one is taken in twice, as after a failure."""
    landing, root = scratch_folder(spark, "landing"), scratch_folder(spark, "versions")
    rows, deliveries = payload_deliveries(spark, sf_dir)
    stream = VersionStream(spark, landing, root)
    for lines in [*deliveries, deliveries[-1]]:
        lines.write.mode("append").text(landing)
        stream.run()
    return stream.versions().join(external_ids(rows), "document_id").select("external_id", "version_index", "is_active")


@STREAMS.add("SELECT event_type, count(value) AS n, true AS median_close, true AS p95_close FROM events GROUP BY event_type")
def sketched_percentiles(spark, sf_dir):
    """Median and 95th percentile of each type from the merged sketches of a stream's windows; close: the exact rank is off by 2 % at most."""
    events = table(spark, sf_dir, "events").select("event_type", F.col("ts").cast("timestamp").alias("ts"), "value")
    landing, root = scratch_folder(spark, "landing"), scratch_folder(spark, "sketches")
    events.write.parquet(landing)
    live = windowed_sketches(spark.readStream.schema(events.schema).parquet(landing), "1 day", size=400)
    sink = lambda batch, number: batch.write.mode("overwrite").parquet(f"{root}/out")  # noqa: E731  the whole result each time
    live.writeStream.foreachBatch(sink).outputMode("complete").option("checkpointLocation", f"{root}/check").trigger(availableNow=True).start().awaitTermination()
    found = sketch_quantiles(merged_sketches(spark.read.parquet(f"{root}/out"), "event_type"), [0.5, 0.95])
    below = lambda k: F.count_if(F.col("value") <= F.col("quantiles")[k]) / F.count("value")
    rows = events.join(F.broadcast(found.select("event_type", "n", "quantiles")), "event_type").groupBy("event_type", "n").agg((F.abs(below(0) - 0.5) <= 0.02).alias("median_close"), (F.abs(below(1) - 0.95) <= 0.02).alias("p95_close"))
    return rows.select("event_type", "n", "median_close", "p95_close")
