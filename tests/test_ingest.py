"""Payload validation, versions, runs, streaming ingestion, sources and sinks."""

from __future__ import annotations

import datetime as dt
import hashlib
import http.server
import json
import threading
import time

import pytest
from pyspark.sql import functions as F

from quern import schemas
from quern.operators import ingest as I
from quern.operators import ops
from quern.sources import readers
from quern.streaming import pipelines

GOOD = {"id": 1, "html_url": "https://github.com/o/r/issues/1", "title": "T", "body": "B", "created_at": "2024-01-01T00:00:00Z", "updated_at": "2024-01-02T00:00:00Z", "user": {"login": "u"}, "labels": [{"name": "bug"}], "repository_url": "r", "number": 1, "state": "open"}


def frame(spark, *payloads):
    lines = spark.createDataFrame([(json.dumps(p),) for p in payloads], "j string")
    return lines.select(F.from_json("j", schemas.ISSUE).alias("p"), "j").select("p.*", "j")


@pytest.mark.parametrize(
    "change,code",
    [
        ({}, None), ({"id": None}, "validation_missing_required_field"), ({"id": 0}, "validation_schema_mismatch"), ({"html_url": "https://x.org"}, "validation_field_constraint"),
        ({"html_url": "https://GitHub.corp/1"}, None), ({"title": "t" * 257}, "validation_payload_too_large"), ({"body": "b" * 65536}, "validation_payload_too_large"), ({"body": None, "title": None, "state": None}, None),
        ({"created_at": "2024-01-01 10:00"}, "validation_field_constraint"), ({"created_at": "2024-01-01T10:00:00-05:00"}, None), ({"updated_at": ""}, "validation_field_constraint"), ({"user": None}, "validation_missing_required_field"),
        ({"user": {}}, "validation_missing_required_field"), ({"user": {"login": "u" * 40}}, "validation_payload_too_large"), ({"number": -1}, "validation_schema_mismatch"), ({"state": "merged"}, "validation_schema_mismatch"),
        ({"labels": [{"name": "x"}] * 101}, "validation_payload_too_large"),
    ],
)
def test_validation(spark, change, code):
    row = I.validate(frame(spark, GOOD | change)).first()
    assert row.error_code == code and row.error_category == (code and "validation")


def test_error_categories(spark):
    codes = [f"{c}_{e}" for c, es in schemas.ERROR_CODES.items() for e in es] + ["odd"]
    got = {r.c: (r.k, r.r) for r in spark.createDataFrame([(c,) for c in codes], "c string").select("c", I.error_category(F.col("c")).alias("k"), I.is_retryable(F.col("c")).alias("r")).collect()}
    assert got["infra_storage_full"] == ("infrastructure", False) and got["transient_network"] == ("transient", True) and got["odd"] == ("internal", False)
    assert len(got) == 18


def test_documents_and_hashes(spark):
    row = I.to_documents(frame(spark, GOOD, GOOD | {"body": "other"}).drop("j"), "github_issue", "acme").collect()
    assert row[0].document_id == row[1].document_id and row[0].hash_payload != row[1].hash_payload
    assert row[0].hash_content == hashlib.sha256(b"B").hexdigest() and row[0].labels == ["bug"] and row[0].extra["state"] == "open"
    exact = I.to_documents(frame(spark, GOOD), "github_issue", raw="j").first()
    assert exact.hash_payload == hashlib.sha256(json.dumps(GOOD, sort_keys=True).encode()).hexdigest()
    other = I.to_documents(frame(spark, GOOD).drop("j"), "github_issue").first()
    assert other.document_id != row[0].document_id
    assert I.to_documents(frame(spark, GOOD).drop("j"), "github_issue_comment").first().title is None


def test_versions_follow_every_change(spark):
    day = lambda k: dt.datetime(2024, 1, k)
    history = spark.createDataFrame([("d", day(1), "A"), ("d", day(2), "A"), ("d", day(3), "B"), ("d", day(4), "A"), ("e", day(1), "X")], "document_id string, valid_from timestamp, hash_payload string")
    got = [(r.document_id, r.hash_payload, r.version_index, r.is_active) for r in I.build_versions(history).orderBy("document_id", "version_index").collect()]
    assert got == [("d", "A", 1, False), ("d", "B", 2, False), ("d", "A", 3, True), ("e", "X", 1, True)]


def test_tables(spark):
    now = spark.createDataFrame([(1, "a", "k"), (2, "b", "k")], "id int, v string, keep string")
    new = spark.createDataFrame([(2, "B", "new"), (3, "c", "new")], "id int, v string, keep string")
    assert {tuple(r) for r in I.upsert(now, new, "id", ("keep",)).collect()} == {(1, "a", "k"), (2, "B", "k"), (3, "c", "new")}
    assert [r.id for r in I.insert_new(now, new.unionByName(new), ["id"]).collect()] == [3]
    marked = {r.id: r.v for r in I.mark(now, new, "id", {"v": F.lit("x")}).collect()}
    assert marked == {1: "a", 2: "x"}
    events = spark.createDataFrame([(1, "s1", 1), (1, "s2", 2)], "id int, state string, at int")
    assert I.latest_state(events, "id", "state", "at").first().state == "s2"


def test_runs(spark):
    at = lambda s: dt.datetime(2024, 1, 1, 0, 0, s)
    events = spark.createDataFrame([("r", at(0), "received", None), ("r", at(2), "validated", "h"), ("r", at(2), "validated", None), ("r", at(5), "failed", None), ("s", at(1), "received", None)], "run_id string, event_ts timestamp, status string, payload_hash string")
    rows = I.transitions(events).where("run_id = 'r'").orderBy("event_ts").collect()
    assert [(r.status, r.previous_status, r.duration_since_previous_ms) for r in rows] == [("received", None, None), ("validated", "received", 2000), ("failed", "validated", 3000)]
    states = {r.run_id: r for r in I.run_states(events).collect()}
    assert (states["r"].status, states["r"].payload_hash, states["r"].finished_at) == ("failed", "h", at(5)) and states["s"].finished_at is None
    page = I.list_runs(I.run_states(events), 1, 0, status="failed", payload_hash=None).collect()
    assert [r.run_id for r in page] == ["r"]
    assert {r.status: r.n for r in I.count_by(I.run_states(events), "status").collect()} == {"failed": 1, "received": 1}


def test_streaming_ingestion(spark, tmp_path):
    landing, root = tmp_path / "landing", f"file://{tmp_path}/out"
    landing.mkdir()
    stream = pipelines.IngestionStream(spark, f"file://{landing}", root)

    def deliver(name, *payloads):
        (landing / name).write_text("\n".join(p if isinstance(p, str) else json.dumps(p) for p in payloads))
        stream.start().awaitTermination()

    deliver("1.json", GOOD, GOOD | {"id": 2, "number": 2}, GOOD | {"id": -5}, "{broken")
    assert stream.versions.read().count() == 2
    deliver("2.json", GOOD, GOOD | {"id": 2, "body": "changed", "number": 2})
    rows = stream.versions.read().orderBy("document_id", "version_index").collect()
    assert len(rows) == 3 and sum(r.is_active for r in rows) == 2 and max(r.version_index for r in rows) == 2
    assert all((r.valid_to is None) == r.is_active for r in rows)
    deliver("3.json", GOOD)
    assert stream.versions.read().count() == 3
    bad = spark.read.json(f"{root}/quarantine")
    assert bad.count() == 2
    events = {r.status: r["count"] for r in spark.read.json(f"{root}/events").groupBy("status").count().collect()}
    assert events == {"received": 7, "validated": 5, "dedupe_checked": 5, "raw_stored": 3, "registered": 3, "skipped_no_change": 2, "failed": 2}
    steps = stream.durations().collect()
    assert len(steps) == 23 and all((r.previous_status is None) == (r.status == "received") and (r.duration_since_previous_ms or 0) >= 0 for r in steps)
    assert stream.events().where("status = 'failed'").where("retry_after_seconds is null").count() == 2
    assert spark.read.parquet(f"{root}/chunks").where("error is null").count() == 3


def test_replayed_batches_change_nothing(spark, tmp_path):
    """A driver that dies between a batch's writes and its commit sees the batch again, the first one too."""
    landing, root = tmp_path / "landing", tmp_path / "out"
    landing.mkdir()
    stream = pipelines.IngestionStream(spark, f"file://{landing}", f"file://{root}")
    tables = lambda: (
        sorted((r.document_id, r.version_index, r.hash_payload, r.is_active) for r in stream.versions.read().collect()),
        spark.read.parquet(f"file://{root}/chunks").count(),
        sorted((r.batch, r.document_id or "", r.status) for r in stream.events().collect()),
    )
    seen = []
    for k, payloads in enumerate(([GOOD, GOOD | {"id": 2, "number": 2}, GOOD | {"id": -5}], [GOOD | {"body": "changed"}, GOOD | {"id": 3, "number": 3}])):
        (landing / f"{k}.json").write_text("\n".join(json.dumps(p) for p in payloads))
        stream.start().awaitTermination()
        seen.append(tables())
        for name in (f"{k}", f".{k}.crc"):
            (root / "checkpoint" / "commits" / name).unlink(missing_ok=True)
        stream.start().awaitTermination()
        assert tables() == seen[k]
        # and if it dies before it publishes
        for name in (f"checkpoint/commits/{k}", f"checkpoint/commits/.{k}.crc", f"versions/manifest/{k + 1:09d}.json", f"versions/manifest/.{k + 1:09d}.json.crc"):
            (root / name).unlink(missing_ok=True)
        stream.start().awaitTermination()
        assert tables() == seen[k]
    assert len(seen[1][0]) == 4


def test_windows_stream_and_batch_agree(spark, tmp_path):
    rows = [(dt.datetime(2024, 1, 1, 0, k % 60), "a" if k % 2 else "b", float(k)) for k in range(120)]
    frame_ = spark.createDataFrame(rows, "ts timestamp, event_type string, value double")
    frame_.write.parquet(str(tmp_path / "in"))
    live = pipelines.windowed_latency(spark.readStream.schema(frame_.schema).parquet(str(tmp_path / "in")))
    query = live.writeStream.format("memory").queryName("live").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(spark.table("live")) == key(pipelines.windowed_latency(frame_)) and spark.table("live").count() == 24
    assert pipelines.sessions(frame_.withColumn("user_id", F.lit(1))).count() == 1


def test_payload_folder(spark, tmp_path):
    root = f"file://{tmp_path}/raw"
    rows = frame(spark, GOOD, GOOD | {"id": 2}).drop("j").withColumn("received_at", F.lit("2024-03-04 05:06:07").cast("timestamp")).withColumn("document_id", F.col("id").cast("string"))
    readers.write_payloads(rows, root)
    (tmp_path / "raw" / "ingest_date=20240304" / "x.json").write_text("{not json\n")
    back = readers.read_payloads(spark, root).cache()
    assert back.where("_corrupt_record is null").count() == 2 and back.where("_corrupt_record is not null").count() == 1
    assert I.validate(back.drop("ingest_date")).where("error_code = 'validation_malformed_json'").count() == 1
    assert readers.replay(rows, "2").count() == 1
    assert readers.not_pull_requests(frame(spark, GOOD, GOOD | {"pull_request": "x"})).count() == 1


def test_evaluation_files(spark, tmp_path):
    samples = readers.sample_questions(spark)
    readers.write_samples(samples, f"file://{tmp_path}/set", "golden")
    back = readers.read_samples(spark, f"file://{tmp_path}/set")
    assert back.count() == 10 and back.where("sample_id = 'q1'").first().metadata == {"task_type": "incident_rca"}
    metrics = spark.createDataFrame([("a", 0.5), ("b", 1.0)], "metric string, value double")
    readers.write_metrics(metrics, f"file://{tmp_path}/m", "base")
    assert {tuple(r) for r in readers.read_metrics(spark, f"file://{tmp_path}/m").collect()} == {("a", 0.5), ("b", 1.0)}
    (tmp_path / "texts").mkdir()
    (tmp_path / "texts" / "one.md").write_text("# One\n\ntext")
    assert [tuple(r) for r in readers.read_texts(spark, f"file://{tmp_path}/texts").collect()] == [("one", "# One\n\ntext")]
    feed = spark.createDataFrame([("1", "q", 0.2, False)], "record_id string, question string, failure_score double, promoted boolean")
    for _ in range(2):
        readers.append_failures(feed, f"file://{tmp_path}/feed")
    assert readers.read_failures(spark, f"file://{tmp_path}/feed").count() == 2


def test_generated_corpora(spark):
    assert readers.synthetic_corpus(spark, 12).where("doc_id = 'synthetic-000011'").first().body.startswith("# Incident 11\n\nService degradation observed in region-1.")
    listed = readers.list_sources(readers.sample_corpus(spark)).collect()
    assert listed[0].preview == "# Pods that would not start" and listed[0].url == "/sources/cluster-incident"


def test_paged_rest_source(spark):
    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            page = int(self.path.rsplit("=", 1)[1])
            body = json.dumps([{"id": 10 * page}, {"id": 10 * page + 1, "pull_request": {}}]).encode()
            self.send_response(200)
            if page < 3:
                self.send_header("Link", f'<http://127.0.0.1:{self.server.server_port}/i?page={page + 1}>; rel="next", <x>; rel="last"')
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    readers.register(spark)
    rows = spark.read.format("paged_json").option("urls", f"http://127.0.0.1:{server.server_port}/i?page=1").load().collect()
    server.shutdown()
    assert [json.loads(r.payload)["id"] for r in rows] == [10, 20, 30]
    assert readers.next_link(None) is None and readers.next_link('<a>; rel="last"') is None
    assert readers.rate_limit_wait({"X-RateLimit-Remaining": "0", "X-RateLimit-Reset": "110"}, 100.0) == 10.0 and readers.rate_limit_wait({}, 1.0) == 0.0


def test_intents(spark):
    cases = {"": "capability", "  Hi! ": "greeting", "thank you": "greeting", "what else can you do?": "capability", "who are you": "capability", "tell me a joke": "off_topic", "hey bot": "greeting", "why do pods wait for nodes": "rag", "weather " + "w " * 20: "rag", "good   morning": "greeting"}
    got = ops.guide(spark.createDataFrame([(q,) for q in cases] + [(None,)], "query string")).collect()
    assert all(r.intent == cases.get(r.query or "") for r in got) and all((r.guide_answer is None) == (r.intent == "rag") for r in got)


def test_operations(spark):
    spans = spark.createDataFrame([("t", "1", dt.datetime(2024, 1, 1), 5.0, "ok"), ("t", "2", dt.datetime(2024, 1, 1), 9.0, "error"), ("u", "3", dt.datetime(2024, 1, 2), 1.0, "ok")], "trace_id string, span_id string, start_ts timestamp, duration_ms double, status string")
    assert [(r.trace_id, r.duration_ms, r.status) for r in ops.recent_traces(spans, 5).collect()] == [("u", 1.0, "ok"), ("t", 9.0, "error")]
    series = spark.createDataFrame([("c", {"b": "2", "a": "1"}, "counter", 1.0, 1), ("c", {"a": "1", "b": "2"}, "counter", 2.0, 2), ("g", {}, "gauge", 5.0, 1), ("g", {}, "gauge", 4.0, 2), ("h", {}, "histogram", 1.0, 1), ("h", {}, "histogram", 3.0, 2)], "name string, labels map<string,string>, kind string, value double, ts long")
    lines = {r.line.replace("2.8999999999999995", "2.9") for r in ops.exposition(ops.registry(series)).collect()}
    assert lines == {'c{a="1",b="2"} 3.0', "g 4.0", 'h{stat="p50"} 2.0', 'h{stat="p95"} 2.9', 'h{stat="count"} 2.0'}
    health = lambda *s: ops.system_health(spark.createDataFrame([(x,) for x in s], "status string")).first().status
    assert (health("healthy", "degraded"), health("degraded", "unhealthy"), health("healthy")) == ("degraded", "unhealthy", "healthy")
    load = ops.load_summary(spark.createDataFrame([("k", float(x)) for x in range(1, 21)], "k string, latency_ms double"), ["k"]).first()
    assert (load.requests, load.p50_ms, load.p95_ms, load.errors) == (20, 10.5, 19.0, 0) and load.qps == pytest.approx(20 / 0.21)
    tiers = {r.tier: r for r in ops.capacity(spark).collect()}
    assert round(tiers["10K"].storage_mb, 1) == 390.6 and tiers["1M"].query_p95_ms == 205 and tiers["100K"].bottlenecks == "vector_index_size,disk_budget"


def test_payload_queries_see_whole_texts(spark, tmp_path):
    from quern.plans import operations

    texts = {0: "t\n" + "a" * 65100 + "b", 12: "t\n" + "a" * 65100 + "c", 26: "t\n" + "d" * 65536}
    spark.createDataFrame([(i, t, "en", "s") for i, t in texts.items()], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.external_id - 1: r.hash_content for r in operations.payload_documents(spark, str(tmp_path)).collect()}
    assert found == {i: hashlib.sha256(texts[i].encode()).hexdigest() for i in (0, 12)}
    assert {r.doc_id: r.error_code for r in operations.validate_payloads(spark, str(tmp_path)).collect()} == {0: "", 12: "", 26: "validation_payload_too_large"}
    assert [tuple(r) for r in operations.error_category_counts(spark, str(tmp_path)).collect()] == [("validation_payload_too_large", 1)]


def test_sketches_of_windows_merge_to_the_whole(spark, tmp_path):
    import random

    rng = random.Random(6)
    values = sorted((rng.expovariate(1 / 50), k) for k in range(4000))
    rows = [("a" if k % 3 else "b", dt.datetime(2024, 1, 1) + dt.timedelta(seconds=k), v) for v, k in values] + [("a", dt.datetime(2024, 1, 1), None)]
    schema = "event_type string, ts timestamp, value double"
    spark.createDataFrame(rows, schema).write.parquet(f"file://{tmp_path}/in")
    live = pipelines.windowed_sketches(spark.readStream.schema(schema).parquet(f"file://{tmp_path}/in"))
    query = live.writeStream.format("memory").queryName("sketches").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    windows = spark.table("sketches")
    assert windows.count() > 20
    merged = pipelines.sketch_quantiles(pipelines.merged_sketches(windows, "event_type"), [0.5, 0.95]).collect()
    for r in merged:
        own = sorted(v for t, _, v in rows if t == r.event_type and v is not None)
        assert r.n == len(own)
        for share, value in zip((0.5, 0.95), r.quantiles, strict=True):
            assert abs(sum(v <= value for v in own) / len(own) - share) < 0.025


def test_paged_source_as_a_stream_fetches_what_is_new(spark, tmp_path):
    items = [{"id": k, "updated_at": f"2024-01-0{k}T00:00:00Z"} for k in range(1, 6)] + [{"id": 90}, {"id": 91, "updated_at": "2024-01-02T00:00:00Z", "pull_request": {}}]
    asked = []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            query = dict(x.split("=", 1) for x in self.path.split("?")[1].split("&"))
            asked.append(query)
            found = [x for x in items if x.get("updated_at", "") >= query.get("since", "")]
            at = int(query.get("page", 0))
            self.send_response(200)
            if len(found) > at + 2:
                self.send_header("Link", f'<http://127.0.0.1:{self.server.server_port}/i?page={at + 2}&since={query.get("since", "")}>; rel="next"')
            self.end_headers()
            self.wfile.write(json.dumps(found[at : at + 2]).encode())

        def log_message(self, *args):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    readers.register(spark)

    def run():
        rows = spark.readStream.format("paged_json").option("urls", f"http://127.0.0.1:{server.server_port}/i?page=0").option("lag", "0").load()
        query = rows.writeStream.format("json").option("path", f"file://{tmp_path}/out").option("checkpointLocation", f"file://{tmp_path}/check").trigger(availableNow=True).start()
        query.awaitTermination()
        return sorted(json.loads(r.payload)["id"] for r in spark.read.schema("payload string").json(f"file://{tmp_path}/out").collect())

    assert run() == [1, 2, 3, 4, 5, 90] and not any("since" in q and q["since"] for q in asked)
    # a change after the first run, and one that is in the future still
    stamp = dt.datetime.now(dt.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    items[2] = {"id": 3, "updated_at": stamp}
    items.append({"id": 7, "updated_at": "2999-01-01T00:00:00Z"})
    time.sleep(1.1)
    asked.clear()
    assert run() == [1, 2, 3, 3, 4, 5, 90]
    assert asked and all(q["since"] > "2024-02" for q in asked)
    server.shutdown()
