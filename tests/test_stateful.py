"""Streams with keyed state: retries with timers, and status changes out of order."""

from __future__ import annotations

import json
import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from quern.operators import ingest
from quern.streaming.stateful import WorkQueue, late_events, status_changes


def _work(key, payload, attempt):
    """Fails as often as the payload says, with its code."""
    p = json.loads(payload)
    if p.get("raise") and attempt <= p["fails"]:
        raise ConnectionError("gone")
    return p["code"] if attempt <= p["fails"] else None


def test_work_is_tried_again_delivered_or_dead(spark, tmp_path):
    landing, root = tmp_path / "landing", f"file://{tmp_path}/queue"
    landing.mkdir()
    line = lambda key, fails, code, **more: json.dumps({"key": key, "payload": json.dumps({"fails": fails, "code": code, **more})})
    (landing / "1.json").write_text("\n".join([line("good", 0, None), line("twice", 2, "transient_network"), line("never", 99, "transient_rate_limited"), line("bad", 1, "validation_malformed_json"), line("good", 0, None), line("raises", 1, None, **{"raise": True})]))
    queue = WorkQueue(spark, f"file://{landing}", root, _work, retries=3, wait_seconds=0.2)
    queue.drain(5, 200, 0.3)
    by = {}
    for r in queue.events().where("status <> 'duplicate'").orderBy("at_ms", "attempt").collect():
        by.setdefault(r.key, []).append((r.attempt, r.status, r.error_code, r.wait_ms, r.at_ms))
    short = {k: [x[:4] for x in v] for k, v in by.items()}
    t, v = "transient_network", "transient_rate_limited"
    assert short["good"] == [(1, "delivered", None, None)]
    assert short["twice"] == [(1, "retry", t, 200), (2, "retry", t, 400), (3, "delivered", None, None)]
    assert short["never"] == [(1, "retry", v, 200), (2, "retry", v, 400), (3, "retry", v, 800), (4, "dead", v, None)]
    assert short["bad"] == [(1, "dead", "validation_malformed_json", None)]
    assert short["raises"] == [(1, "retry", "transient_ConnectionError", 200), (2, "delivered", None, None)]
    for rows in by.values():
        # nothing is tried before its wait is over
        assert all(b[4] - a[4] >= a[3] for a, b in zip(rows, rows[1:], strict=False))
    assert {(r.key, r.attempts) for r in queue.dead_letters().collect()} == {("never", 4), ("bad", 1)}
    assert queue.events().where("status = 'duplicate'").count() == 1
    # a restart goes on from the state: what is done stays done, what is new is worked on
    (landing / "2.json").write_text("\n".join([line("twice", 0, None), line("new", 1, t)]))
    queue.drain(6, 200, 0.3)
    assert queue.events().where("key = 'new'").count() == 2
    assert queue.events().where("key = 'twice' and status = 'duplicate'").count() == 1


def test_status_changes_out_of_order(spark, tmp_path):
    rng, start = random.Random(4), datetime(2024, 1, 1)
    rows = [(k, f"run{rng.randint(0, 5)}", start + timedelta(seconds=30 * k, microseconds=rng.randint(0, 999_999)), rng.choice(["received", "validated", "failed"])) for k in range(120)]
    rows += [(200, "run1", rows[50][2], "same time"), (201, "run9", rows[60][2], "lonely")]
    schema = "event_id long, run_id string, event_ts timestamp, status string"
    shuffled = sorted(rows, key=lambda r: r[2] + timedelta(seconds=rng.randint(0, 500)))
    parts = [shuffled[:40], shuffled[40:90], shuffled[90:], [(999, "end", start + timedelta(days=9), "end")], [(1000, "run1", start, "late"), (1001, "end", start + timedelta(days=10), "end")]]
    source, out = tmp_path / "in", f"file://{tmp_path}/out"
    late = 0
    for k, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"file://{source}")
        events = spark.readStream.schema(schema).parquet(f"file://{source}")
        changes = status_changes(events, "run_id", "event_ts", "status", "10 minutes", "event_id")
        query = changes.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"file://{tmp_path}/check").outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
        late += late_events(query)
    got = spark.read.parquet(out).where("key <> 'end'").select("key", F.col("tie").alias("event_id"), "status", "previous_status", "duration_since_previous_ms").collect()
    want = ingest.transitions(spark.createDataFrame(rows, schema), tie="event_id").select(F.col("run_id").alias("key"), "event_id", "status", "previous_status", "duration_since_previous_ms").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, want), key=repr)
    assert late == 1


def test_versions_by_keyed_state_survive_replays(spark, tmp_path):
    from quern.streaming.versions import VersionStream
    from tests.test_ingest import GOOD

    landing, root = tmp_path / "landing", tmp_path / "out"
    landing.mkdir()
    stream = VersionStream(spark, f"file://{landing}", f"file://{root}")
    deliveries = [
        [GOOD, GOOD | {"id": 2, "number": 2}, GOOD | {"id": -5}],
        [GOOD, GOOD | {"id": 2, "number": 2, "body": "second"}, GOOD | {"id": 3, "number": 3}],
        [GOOD | {"id": 2, "number": 2}, GOOD | {"id": 3, "number": 3, "body": "older", "updated_at": "2020-01-01T00:00:00Z"}, GOOD | {"id": 3, "number": 3}],
    ]
    rows = lambda: sorted((r.document_id, r.version_index, r.hash_payload, str(r.valid_from), str(r.valid_to), r.is_active) for r in stream.versions().collect())
    for k, payloads in enumerate(deliveries):
        (landing / f"{k}.json").write_text("\n".join([*(json.dumps(p) for p in payloads), "{broken"]))
        stream.run()
        seen, bad = rows(), stream.quarantined().count()
        for name in ("changes", "quarantine"):
            for file in (f"{k}", f".{k}.crc"):
                (root / f"check-{name}" / "commits" / file).unlink(missing_ok=True)
        stream.run()
        assert rows() == seen and stream.quarantined().count() == bad
    by = {}
    for d, index, *_, active in seen:
        by.setdefault(d, []).append((index, active))
    # 1 never changed, 2 went there and back, 3 came once (an older delivery beside a newer one does not count)
    assert sorted(by.values()) == [[(1, False), (2, False), (3, True)], [(1, True)], [(1, True)]]
    assert bad == 4
    assert {r.outcome: r["count"] for r in stream.outcomes().groupBy("outcome").count().collect()} == {"new": 3, "changed": 2, "skipped_no_change": 2}
